"""More named queries: names, classes, domains' rules, provenance, settled graphs, text, programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import extraction, temporal, text
from factloom.operators import conflict, eras, ontology, query, reach, rules
from factloom.plans import domains
from factloom.plans.catalogue import MEMBERS, ORD, QUERIES, SHIP, SQL, event_facts, g_of, query_of, read, rule_named, settled, shipments, three, tree
from factloom.plans.program import call_value, run_program
from factloom.plans.storage import written
from factloom.schema import Graph, complete
from factloom.sources import builders
from factloom.sources.graphs import add, relational


def key(column: str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def stated(df: DataFrame, at: Column, subject: Column, relation: str, obj: Column, *more: Column) -> DataFrame:
    return complete(df.select(at.alias("triple_id"), subject.alias("subject"), F.lit(relation).alias("relation"), obj.cast("string").alias("object"), *more))


def listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Names and single facts


@query_of("SELECT o_orderkey, CASE WHEN c_custkey % 2 = 0 THEN 'customer#' || c_custkey ELSE c_name END AS canonical FROM orders JOIN customer ON o_custkey = c_custkey")
def canonical_names(spark, sf_dir):
    """Names on orders by the alias table, which knows every second customer."""
    c = read(spark, sf_dir, "customer")
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    alias = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("surface"), key("c_custkey", "customer#").alias("canonical"))
    g = Graph(stated(o, F.col("o_orderkey"), key("o_orderkey"), "PLACED_BY", F.col("c_name")), alias)
    return query.named(g, "object", "canonical").select(F.col("triple_id").alias("o_orderkey"), "canonical")


@query_of("WITH {fact} SELECT CASE WHEN s = 'customer#7' THEN 'out' ELSE 'in' END AS direction, s AS subject, r AS relation, o AS object FROM fact WHERE s = 'customer#7' OR o = 'customer#7'")
def entity_card(spark, sf_dir):
    return query.entity_card(g_of(spark, sf_dir), "customer#7").select("direction", "subject", "relation", "object")


@query_of("SELECT CAST(user_id AS VARCHAR) AS subject, CAST(event_id AS VARCHAR) AS object FROM events WHERE event_type = 'click'")
def scoped_values(spark, sf_dir):
    return query.scoped_values(event_facts(spark, sf_dir), "click", "DID")


@query_of("SELECT 'DID' AS relation, count(DISTINCT event_id) AS n_positions, count(DISTINCT event_type) AS n_scopes FROM events WHERE event_type <> 'view'")
def scope_positions(spark, sf_dir):
    return eras.positions(event_facts(spark, sf_dir))


@query_of(f"WITH {SHIP} SELECT s AS subject, o AS object, scope, CAST(min(id) AS BIGINT) AS id FROM ship GROUP BY s, o, scope")
def add_first_wins(spark, sf_dir):
    """All shipments put into a graph that has every second one: the first of each fact stays."""
    f = shipments(spark, sf_dir)
    return add(f.where("triple_id % 2 = 0"), f).select("subject", "object", "scope", F.col("triple_id").alias("id"))


@query_of("SELECT 'customer#' || o_custkey AS subject, CAST(count(*) AS VARCHAR) AS object, 'computed:count' AS source_article FROM orders GROUP BY o_custkey")
def written_back(spark, sf_dir):
    """Orders of each customer counted, kept as facts and asked for again."""
    g = g_of(spark, sf_dir)
    n = g.facts.where("relation = 'PLACED_BY'").groupBy(F.col("object").alias("subject")).agg(F.count("*").alias("value")).withColumn("relation", F.lit("N_ORDERS"))
    return builders.written_back(g, n, "count").facts.where("relation = 'N_ORDERS'").select("subject", "object", "source_article")


@query_of(f"WITH {SHIP} SELECT id FROM (SELECT id FROM ship ORDER BY round(c, 6), id LIMIT 6)")
def least_sure(spark, sf_dir):
    f = shipments(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))
    return query.least_sure(f).select(F.col("triple_id").alias("id"))


@query_of("SELECT DISTINCT c_name AS subject FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY subject LIMIT 10")
def first_distinct(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return query.first_distinct(o.select(F.col("c_name").alias("subject")), "subject")


# Joins over several relations


def people(spark, sf_dir) -> DataFrame:
    """Customers born in the nation they are of; they die in the one of their number; every order is a conquest."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    name, at = key("c_custkey", "c"), F.col("c_custkey") * 10
    f = stated(c, at, name, "BORN_IN", F.col("c_nationkey"))
    f = f.unionByName(stated(c, at + 1, name, "DIED_IN", F.col("c_custkey") % 25))
    f = f.unionByName(stated(c, at + 2, name, "TUTORED_BY", F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2).cast("string"))))
    f = f.unionByName(stated(c.where("c_acctbal > 5000"), at + 3, name, "IS_A", F.lit("MULTI_CONQUEROR")))
    return f.unionByName(stated(o, F.col("o_orderkey") * 10 + 10**9, key("o_custkey", "c"), "INFLUENCED_BY", F.col("o_orderpriority")))


@query_of("SELECT 'c' || c_custkey AS subject, CAST(c_nationkey AS VARCHAR) AS object FROM customer WHERE c_nationkey = c_custkey % 25")
def same_place(spark, sf_dir):
    return reach.same_place(people(spark, sf_dir))


@query_of("SELECT 'c' || c_custkey AS subject, 'c' || c_custkey // 2 AS teachers, coalesce((SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS influences FROM customer WHERE c_acctbal > 5000")
def teachers_of_many(spark, sf_dir):
    out = reach.teachers_of_many(people(spark, sf_dir))
    return out.select("subject", *(F.array_join(c, "|").alias(c) for c in ("teachers", "influences")))


@query_of("SELECT 'c' || c_custkey AS subject, 'c' || c_custkey // 2 AS middle, 'c' || c_custkey // 4 AS object FROM customer")
def two_hops(spark, sf_dir):
    return reach.two_hops(people(spark, sf_dir), "TUTORED_BY")


@query_of("WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c EXCEPT SELECT a, b FROM e")
def without_direct(spark, sf_dir):
    e = tree(spark, sf_dir)
    return reach.without_direct(rules.closure(e), e)


@query_of("WITH RECURSIVE c AS (SELECT CAST(190 AS BIGINT) AS node UNION SELECT (node - 1) // 2 FROM c WHERE node > 1) SELECT 'p' || node AS node FROM c JOIN part ON p_partkey = node WHERE node < 190 AND node > 0 AND p_size % 2 = 0")
def reachable_in_class(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    e = tree(spark, sf_dir)
    f = stated(e, F.col("a"), key("a", "p"), "RELATED_TO", key("b", "p"))
    f = f.unionByName(stated(p.where("p_size % 2 = 0"), F.col("p_partkey") + 10**9, key("p_partkey", "p"), "IS", F.lit("EVEN")))
    return reach.reachable_in_class(f, "p190", "RELATED_TO", "IS", "EVEN")


@query_of("WITH e AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0 AND p_size < 5), r AS (SELECT a AS x FROM e UNION SELECT b FROM e) SELECT DISTINCT 'l' || l_orderkey || '.' || l_linenumber AS subject FROM lineitem WHERE l_quantity > 49 OR l_partkey IN (SELECT x FROM r)")
def flagged_or_in_ring(spark, sf_dir):
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    name = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    held = stated(l, F.col("l_orderkey") * 100 + F.col("l_linenumber"), name, "ACCOUNT", F.col("l_partkey"))
    small = tree(spark, sf_dir).join(p.where("p_size < 5").select(F.col("p_partkey").alias("a")), "a", "left_semi")
    shares = stated(small, -F.col("a"), key("a"), "SHARES_DEVICE", key("b"))
    flagged = l.where("l_quantity > 49").select(name.alias("subject"))
    return reach.flagged_or_in_ring(flagged, held.unionByName(shares), "ACCOUNT", "SHARES_DEVICE")


@query_of("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS object FROM lineitem WHERE l_quantity >= 40 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 5)")
def dropped_steps(spark, sf_dir):
    """Parts of large shipments that no small one has, as steps of two procedures."""
    scope = F.when(F.col("l_quantity") >= 40, "large").when(F.col("l_quantity") < 5, "small")
    l = read(spark, sf_dir, "lineitem")
    f = stated(l, F.col("l_orderkey") * 100 + F.col("l_linenumber"), F.lit("shop"), "STEP", F.col("l_partkey"), scope.alias("scope"), F.col("l_linenumber").alias("seq"))
    return reach.dropped_steps(f, "large", "small").select("object").distinct()


@query_of("WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0), c AS (SELECT CAST(3 AS BIGINT) AS node UNION SELECT e.a FROM c JOIN e ON c.node = e.b) SELECT DISTINCT p_brand AS b FROM part JOIN c ON node = p_partkey")
def trust_boundary(spark, sf_dir):
    e = tree(spark, sf_dir).select(key("b").alias("a"), key("a").alias("b"))
    return reach.boundary(e, read(spark, sf_dir, "part").select(key("p_partkey").alias("a"), F.col("p_brand").alias("b")), "3")


@query_of("WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0), c AS (SELECT CAST(3 AS BIGINT) AS node UNION SELECT e.a FROM c JOIN e ON c.node = e.b) SELECT CAST(p_partkey AS VARCHAR) AS node FROM part JOIN c ON node = p_partkey WHERE p_size = 7")
def side_effects(spark, sf_dir):
    p = read(spark, sf_dir, "part").where("p_size = 7")
    e = tree(spark, sf_dir).select(key("b").alias("a"), key("a").alias("b"))
    return reach.effects(stated(p, F.col("p_partkey"), key("p_partkey"), "WRITES_TO", F.lit("disk")), e, "3")


# Eras


@query_of("""WITH v AS (SELECT DISTINCT year(l_shipdate) AS y, l_suppkey AS x FROM lineitem), n AS (SELECT y, count(*) AS n FROM v GROUP BY y),
i AS (SELECT a.y AS a, b.y AS b, count(*) AS k FROM v a JOIN v b ON a.x = b.x AND a.y < b.y GROUP BY 1, 2)
SELECT round(avg(1 - coalesce(k, 0) / (p.n + q.n - coalesce(k, 0))), 6) AS distance, count(*) AS n FROM n p JOIN n q ON p.y < q.y LEFT JOIN i ON i.a = p.y AND i.b = q.y""")
def mean_distance(spark, sf_dir):
    v = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), F.col("l_suppkey").alias("x"))
    return eras.mean_distance(v, "y", "x").select(F.round("distance", 6).alias("distance"), "n")


@query_of("""WITH y AS (SELECT DISTINCT year(l_shipdate) AS y, l_suppkey % 10 AS x, l_returnflag AS f FROM lineitem WHERE l_partkey = 7)
SELECT 's' || x AS value, string_agg(DISTINCT 'y' || y, '|' ORDER BY 'y' || y) FILTER (f = 'A') AS affirmed, string_agg(DISTINCT 'y' || y, '|' ORDER BY 'y' || y) FILTER (f = 'R') AS rejected FROM y GROUP BY x HAVING count(*) FILTER (f = 'A') > 0 AND count(*) FILTER (f = 'R') > 0""")
def reversals(spark, sf_dir):
    """Groups of suppliers of a part whose shipments are kept in some year and returned in one."""
    l = read(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')")
    year = F.year("l_shipdate").cast("string")
    f = stated(l, F.col("l_orderkey") * 100 + F.col("l_linenumber"), key("l_partkey", "p"), "HAS_PROPERTY", F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")), year.alias("valid_from"), year.alias("valid_to"), F.col("l_returnflag").alias("scope"))
    f = f.withColumn("relation", F.when(F.col("scope") == "R", "REJECTS_PROPERTY").otherwise(F.col("relation")))
    e = spark.createDataFrame([(f"y{y}", y, y) for y in range(1990, 2010)], "name string, from_year int, to_year int")
    out = eras.reversals(eras.projections(f, e, "p7"))
    return out.select("value", *(F.array_join(c, "|").alias(c) for c in ("affirmed", "rejected")))


@query_of(f"SELECT l_orderkey, l_linenumber, strftime(greatest(o_orderdate, l_shipdate), '%Y-%m-%d') AS low, strftime(least(o_orderdate + INTERVAL 30 DAY, l_shipdate + INTERVAL 10 DAY), '%Y-%m-%d') AS high, {ORD.format('greatest(o_orderdate, l_shipdate)')} > {ORD.format('least(o_orderdate + INTERVAL 30 DAY, l_shipdate + INTERVAL 10 DAY)')} AS empty FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def interval_intersection(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c, d: F.date_format(F.date_add(c, d), "yyyy-MM-dd")
    low, high, empty = temporal.intersection(F.array(day("o_orderdate", 0), day("l_shipdate", 0)), F.array(day("o_orderdate", 30), day("l_shipdate", 10)))
    return x.select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"), empty.alias("empty"))


@query_of("SELECT l_orderkey, l_linenumber, o_orderdate <= l_shipdate + INTERVAL 10 DAY AND l_shipdate <= o_orderdate + INTERVAL 30 DAY AS touch, greatest(o_orderdate, l_shipdate) < least(o_orderdate + INTERVAL 30 DAY, l_shipdate + INTERVAL 10 DAY) AS overlap FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def interval_overlap(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    o = lambda c, d: temporal.ord_of_date(F.date_add(c, d))
    ends = o("o_orderdate", 0), o("o_orderdate", 30), o("l_shipdate", 0), o("l_shipdate", 10)
    return x.select("l_orderkey", "l_linenumber", temporal.intersects(*ends).alias("touch"), temporal.strictly_overlaps(*ends).alias("overlap"))


# Rules, proofs and ontologies


@query_of("WITH {fact} SELECT c.s AS subject, n.o AS object FROM fact c JOIN fact n ON c.o = n.s WHERE c.r = 'IN_NATION' AND n.r = 'IN_REGION'")
def rule_taught_conqueror(spark, sf_dir):
    f = relational(spark, sf_dir).withColumn("relation", F.when(F.col("relation") == "IN_NATION", "TUTORED").when(F.col("relation") == "IN_REGION", "CONQUERED").otherwise(F.col("relation")))
    return rule_named("taught_conqueror").plan(Graph(f)).select("subject", "object")


@query_of("WITH t AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0) SELECT 'p' || x.a AS subject, 'p' || y.b AS object, 'book#' || least(x.a, y.a) || '|book#' || greatest(x.a, y.a) AS sources FROM t x JOIN t y ON x.b = y.a")
def trace_sources(spark, sf_dir):
    """Grandchildren, and the facts that each rests on."""
    e = tree(spark, sf_dir)
    f = written(stated(e, F.col("a"), key("a", "p"), "CHILD_OF", key("b", "p"), F.lit("book").alias("source_article"), F.col("a").cast("int").alias("source_sentence_idx")))
    closed, proofs, _ = rules.fixpoint(Graph(f), [rule_named("grandchild")])
    number = lambda s: F.substring_index(s, "#", -1).cast("long")
    ordered = F.array_sort("sources", lambda a, b: F.when(number(a) < number(b), -1).when(number(a) > number(b), 1).otherwise(0))
    return rules.trace_sources(closed.facts, proofs).join(proofs.select("triple_id", "subject", "object"), "triple_id").select("subject", "object", F.array_join(ordered, "|").alias("sources"))


@query_of("WITH t AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0) SELECT rule AS rule_name, count(*) AS n FROM (SELECT 'grandchild' AS rule FROM t x JOIN t y ON x.b = y.a UNION ALL SELECT 'family_progenitor' FROM (SELECT DISTINCT b FROM t WHERE b NOT IN (SELECT a FROM t))) GROUP BY rule")
def derivation_counts(spark, sf_dir):
    e = tree(spark, sf_dir)
    f = stated(e, F.col("a"), key("a", "p"), "CHILD_OF", key("b", "p"))
    return domains.derivation_counts(rules.fixpoint(Graph(f))[1])


@query_of("SELECT rule_name, CAST(x.p_partkey AS VARCHAR) AS a FROM (SELECT 'grandchild' AS rule_name, p_partkey FROM part WHERE p_partkey = 100) x")
def why_derived(spark, sf_dir):
    e = tree(spark, sf_dir)
    _, proofs, _ = rules.fixpoint(Graph(stated(e, F.col("a"), key("a", "p"), "CHILD_OF", key("b", "p"))), [rule_named("grandchild")])
    return rules.why(proofs, "p100", "GRANDCHILD_OF", "p24").select("rule_name", F.element_at("inputs", 1).cast("string").alias("a"))


@query_of(f"WITH {SHIP}, n AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), j AS (SELECT s, n_name AS o, id, c, vf, vt, row_number() OVER (PARTITION BY s, n_name ORDER BY id) AS k FROM ship JOIN n ON ship.o = 'supplier#' || s_suppkey) SELECT s AS subject, o AS object, round(c * 0.5, 6) AS confidence, vf AS valid_from, vt AS valid_to FROM j WHERE k = 1")
def derived_confidence_and_time(spark, sf_dir):
    """A part comes from its supplier's nation, as surely and as long as the first facts that say so."""
    live = relational(spark, sf_dir).where("relation = 'IN_NATION' AND subject LIKE 'supplier#%'").withColumn("confidence", F.lit(0.5))
    g = Graph(shipments(spark, sf_dir).unionByName(live.select(*live.columns)))
    closed, _, _ = rules.fixpoint(g, [rules.compose("from_nation", "SUPPLIED_BY", "IN_NATION", "FROM_NATION")])
    return closed.facts.where("relation = 'FROM_NATION'").select("subject", "object", F.round("confidence", 6).alias("confidence"), "valid_from", "valid_to")


@query_of("WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT 'p' || a AS subject, 'p' || b AS object FROM c")
def linked_rule(spark, sf_dir):
    e = tree(spark, sf_dir)
    closed, _, _ = rules.fixpoint(Graph(stated(e, F.col("a"), key("a", "p"), "REFERRED", key("b", "p"))), [domains.linked("REFERRED")])
    return closed.facts.select("subject", "object")


@query_of("WITH {fact} SELECT s AS subject, r AS relation, o AS object FROM (SELECT s, r, o FROM fact WHERE r = 'IN_NATION' UNION SELECT s, 'LOCATED_IN', o FROM fact WHERE r = 'IN_NATION' UNION SELECT o, 'HOSTS', s FROM fact WHERE r = 'IN_NATION' UNION SELECT s, 'IS_A', 'Resident' FROM fact WHERE r = 'IN_NATION' UNION SELECT o, 'IS_A', k FROM fact, (VALUES ('Country'), ('State')) AS v(k) WHERE r = 'IN_NATION')")
def ontology_equivalences(spark, sf_dir):
    """Equivalent properties and classes, an inverse, domain and range."""
    f = relational(spark, sf_dir).where("relation = 'IN_NATION'")
    ont = ontology.Ontology().equivalent_properties("IN_NATION", "LOCATED_IN").inverse_properties("LOCATED_IN", "HOSTS").domain("IN_NATION", "Resident").range("IN_NATION", "Country").equivalent_classes("Country", "State")
    return three(rules.fixpoint(Graph(f), ontology.compile_to_rules(ont))[0].facts)


def part_classes(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    one = stated(p, F.col("p_partkey") * 2, key("p_partkey", "part#"), "IS_A", F.col("p_type"))
    return one.unionByName(stated(p, F.col("p_partkey") * 2 + 1, key("p_partkey", "part#"), "IS_A", F.col("p_brand")))


@query_of("SELECT 'part#' || p_partkey AS subject, t || '|' || b AS object FROM part, (SELECT min(p_type) AS t, min(p_brand) AS b FROM part) WHERE p_type = t AND p_brand = b")
def disjoint_classes(spark, sf_dir):
    t, b = read(spark, sf_dir, "part").agg(F.min("p_type"), F.min("p_brand")).head()
    return ontology.disjoint_markers(Graph(part_classes(spark, sf_dir)), t, b).select("subject", "object")


@query_of("SELECT 'part#' || p_partkey AS subject, class FROM part, (SELECT min(p_type) AS t, min(p_brand) AS b FROM part), (VALUES ('Both'), ('Either')) AS v(class) WHERE CASE class WHEN 'Both' THEN p_type = t AND p_brand = b ELSE p_type = t OR p_brand = b END")
def class_expressions(spark, sf_dir):
    t, b = read(spark, sf_dir, "part").agg(F.min("p_type"), F.min("p_brand")).head()
    return ontology.memberships(part_classes(spark, sf_dir), ontology.Ontology().class_intersection("Both", t, b).class_union("Either", t, b))


@query_of("SELECT 'part#' || p_partkey AS subject, 'disjoint:' || t || '|' || b AS why FROM part, (SELECT min(p_type) AS t, min(p_brand) AS b FROM part) WHERE p_type = t AND p_brand = b UNION ALL SELECT DISTINCT 'part#' || l_partkey, 'cardinality:SUPPLIED_BY' FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 30")
def inconsistencies(spark, sf_dir):
    t, b = read(spark, sf_dir, "part").agg(F.min("p_type"), F.min("p_brand")).head()
    f = part_classes(spark, sf_dir).unionByName(shipments(spark, sf_dir))
    return ontology.inconsistencies(f, ontology.Ontology().disjoint_with(t, b).cardinality("SUPPLIED_BY", max=30))


BOXED = "ship AS (SELECT l_orderkey * 100 + l_linenumber AS id, 'order#' || l_orderkey AS s, 'part#' || l_partkey AS o, l_shipdate AS f, l_shipdate + INTERVAL 20 DAY AS t FROM lineitem)"


@query_of(f"WITH {BOXED} SELECT DISTINCT a.o AS subject, 'HOLDS:' || least(a.s, b.s) || '|' || greatest(a.s, b.s) AS object FROM ship a JOIN ship b ON a.o = b.o AND a.id < b.id AND a.s <> b.s AND greatest(a.f, b.f) < least(a.t, b.t)")
def inverse_functional_conflicts(spark, sf_dir):
    """Parts that two orders hold at one time."""
    l = read(spark, sf_dir, "lineitem")
    day = lambda d, out: F.date_format(F.date_add("l_shipdate", d), "yyyy-MM-dd").alias(out)
    f = stated(l, F.col("l_orderkey") * 100 + F.col("l_linenumber"), key("l_orderkey", "order#"), "HOLDS", key("l_partkey", "part#"), day(0, "valid_from"), day(20, "valid_to"))
    return ontology.functional_markers(Graph(f), "HOLDS", inverse=True).select("subject", "object").distinct()


# Settled graphs

LEFT = """, w AS ({0}), lost AS (SELECT DISTINCT m.conflict, m.s, m.o, m.vf, m.vt FROM m ANTI JOIN w ON m.conflict = w.conflict AND m.id = w.id),
kept AS (SELECT DISTINCT m.conflict, m.s, m.o, m.vf, m.vt FROM m SEMI JOIN w ON m.conflict = w.conflict AND m.id = w.id),
gone AS (SELECT DISTINCT s, o, vf, vt FROM (SELECT * FROM lost EXCEPT SELECT * FROM kept)),
staying AS (SELECT * FROM ship ANTI JOIN gone USING (s, o, vf, vt))"""
CHOSEN = "SELECT conflict, id FROM (SELECT *, count(*) FILTER (r = 1) OVER (PARTITION BY conflict) AS n FROM (SELECT *, rank() OVER (PARTITION BY conflict ORDER BY f DESC, t DESC) AS r FROM m)) WHERE n <> 1 OR r = 1"


@query_of(f"{MEMBERS}{LEFT.format(CHOSEN)} SELECT id FROM staying")
def resolve_conflicts(spark, sf_dir):
    """Shipments that are left when the latest supplier of a part wins."""
    ont = ontology.Ontology().functional_property("SUPPLIED_BY")
    out, _, _, _ = conflict.reason_and_resolve(Graph(shipments(spark, sf_dir)), [], ont, [conflict.latest_wins])
    return out.facts.select(F.col("triple_id").alias("id"))


@query_of(f"WITH {SHIP.replace('1 - l_discount AS c', '5 * l_discount AS c')}, pair AS (SELECT DISTINCT a.s, least(a.o, b.o) AS x, greatest(a.o, b.o) AS y FROM ship a JOIN ship b ON a.s = b.s AND a.id < b.id AND a.o <> b.o AND a.scope = b.scope AND greatest(a.f, b.f) < least(a.t, b.t)), m AS (SELECT p.s || '/SUPPLIED_BY:' || x || '|' || y AS conflict, ship.* FROM pair p JOIN ship ON ship.s = p.s AND ship.o IN (x, y)){LEFT.format(CHOSEN)} SELECT s AS subject, o AS object, vf AS valid_from, scope, round(k + 1e-9, 6) AS confidence FROM (SELECT s, o, vf, scope, CASE WHEN count(*) = 1 THEN min(c) ELSE 1 - product(1 - c) END AS k FROM staying GROUP BY s, o, vf, vt, scope) WHERE k >= 0.2249")
def purify(spark, sf_dir):
    """Latest suppliers, told once each, those of little confidence left out."""
    f = shipments(spark, sf_dir).withColumn("confidence", (1 - F.col("confidence")) * 5)
    out, _ = conflict.purify(Graph(f), ontology.Ontology().functional_property("SUPPLIED_BY"), [conflict.latest_wins], 0.2249)
    return out.facts.select("subject", "object", "valid_from", "scope", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"))


@query_of(f"{MEMBERS} SELECT '{ontology.FUNCTIONAL}' AS kind, count(DISTINCT conflict) AS n FROM m")
def conflict_counts(spark, sf_dir):
    m = written(ontology.functional_markers(Graph(shipments(spark, sf_dir)), "SUPPLIED_BY").select("subject", "relation", "object").distinct())
    marked = complete(m.withColumn("triple_id", -F.abs(F.xxhash64("subject", "object")) - 1))
    found = conflict.detect_conflicts(Graph(shipments(spark, sf_dir).unionByName(marked)))
    return domains.conflict_counts(found)


@query_of(f"{MEMBERS} SELECT conflict, id FROM m")
def policy_keep_all(spark, sf_dir):
    return settled(spark, sf_dir, [conflict.keep_all])


# Utterances and items


def utterances(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    long, asks = F.when(F.length("text") > 200, "long"), F.when(F.col("text").contains(","), "comma")
    acts, tones = F.element_at(F.array(*map(F.lit, ("oath", "question", "command"))), (F.col("conv_id") % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("bitter", "weary"))), (F.col("turn") % 2 + 1).cast("int"))
    who = F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("who"), (F.col("conv_id") % 7).cast("string")))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("place"), F.array_compact(F.array("role", long, asks)).alias("themes"), who.alias("addressee"), acts.alias("speech_act"), F.when(F.col("turn") % 3 != 0, tones).alias("mood"))


UTTERED = """u AS (SELECT conv_id * 100 + turn AS k, list_filter([role, CASE WHEN length(text) > 200 THEN 'long' END, CASE WHEN contains(text, ',') THEN 'comma' END], lambda x: x IS NOT NULL) AS th,
 CASE WHEN conv_id % 4 <> 0 THEN 'who' || conv_id % 7 ELSE 'crew' END AS who, ['oath', 'question', 'command'][conv_id % 3 + 1] AS act, CASE WHEN turn % 3 <> 0 THEN ['bitter', 'weary'][turn % 2 + 1] ELSE 'oratorical' END AS mood FROM conversations),
 v AS (SELECT CASE WHEN k < 100 THEN 'u' || lpad(CAST(k AS VARCHAR), 2, '0') ELSE 'u' || k END AS s, * FROM u), th AS (SELECT s, unnest(th) AS o FROM v), fr AS (SELECT o, count(*) AS n FROM th GROUP BY o)"""


@query_of(f"WITH {UTTERED} SELECT s AS subject, 'HAS_THEME' AS relation, th.o AS object, round(CASE WHEN mx <= 1 THEN 1 ELSE 0.5 + 0.5 * ln(n) / ln(mx) END, 6) AS confidence FROM th JOIN fr ON th.o = fr.o, (SELECT max(n) AS mx FROM fr) UNION ALL SELECT s, 'ADDRESSED_TO', who, 1.0 FROM v UNION ALL SELECT s, 'IS_SPEECH_ACT', act, 1.0 FROM v UNION ALL SELECT s, 'HAS_MOOD', mood, 1.0 FROM v")
def utterance_graph(spark, sf_dir):
    return builders.utterance_graph(utterances(spark, sf_dir), "talks").facts.select("subject", "relation", "object", F.round("confidence", 6).alias("confidence"))


@query_of(f"WITH {UTTERED} SELECT o AS theme, n FROM fr")
def theme_frequencies(spark, sf_dir):
    return builders.theme_frequencies(utterances(spark, sf_dir))


@query_of(f"""WITH {UTTERED}, co AS (SELECT DISTINCT a.o AS x, b.o AS y FROM th a JOIN th b ON a.s = b.s AND a.o < b.o)
SELECT x AS subject, 'CO_OCCURS_WITH' AS relation, y AS object FROM co UNION SELECT s, 'HAS_SPEECH_LABEL', act FROM v UNION SELECT s, 'HAS_SPEECH_LABEL', mood FROM v
UNION SELECT s, 'IS', 'CONFRONTATIONAL_UTTERANCE' FROM v WHERE act IN ({listed(domains.CONFRONTATIONAL)}) UNION SELECT s, 'IS', 'INTROSPECTIVE_UTTERANCE' FROM v WHERE mood IN ({listed(domains.INTROSPECTIVE)})
UNION SELECT o, 'IS', 'ISOLATED_THEME' FROM th WHERE o NOT IN (SELECT x FROM co) UNION SELECT who, 'IS', 'PEACEFUL_ADDRESSEE' FROM v WHERE who NOT IN (SELECT who FROM v WHERE act IN ({listed(domains.CONFRONTATIONAL)}))""")
def utterance_rules(spark, sf_dir):
    g = builders.utterance_graph(utterances(spark, sf_dir), "talks")
    return three(rules.fixpoint(g, domains.utterance_rules())[0].facts.where("source_article = '(derived)'"))


def items(spark, sf_dir) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    sub = F.when(k % 4 == 0, "undo").when(k % 4 == 1, "revert").otherwise("other")
    commands = F.when(k % 5 == 0, F.array(F.lit("cd x"), F.lit("RM -RF y"))).when(k % 5 == 1, F.array(F.lit("ls")))
    return p.select(k.alias("place"), key("p_partkey", "i").alias("item_id"), F.col("p_type").alias("topic"), sub.alias("subtopic"), F.lit("how-to").alias("intent"), commands.alias("commands"), F.when(k % 3 == 0, F.array(F.lit("mind"))).alias("cautions"), F.array(F.concat(F.lit("i"), (k + 1).cast("string"))).alias("related_items"))


@query_of("""WITH p AS (SELECT p_partkey AS k, 'i' || p_partkey AS s, p_type AS t FROM part)
SELECT s AS subject, 'HAS_TOPIC' AS relation, t AS object FROM p UNION ALL SELECT s, 'HAS_SUBTOPIC', CASE k % 4 WHEN 0 THEN 'undo' WHEN 1 THEN 'revert' ELSE 'other' END FROM p UNION ALL SELECT s, 'HAS_INTENT', 'how-to' FROM p
UNION ALL SELECT s, 'HAS_COMMANDS', 'yes' FROM p WHERE k % 5 < 2 UNION ALL SELECT s, 'USES_DESTRUCTIVE_COMMAND', 'rm -rf' FROM p WHERE k % 5 = 0 UNION ALL SELECT s, 'HAS_CAUTION', 'yes' FROM p WHERE k % 3 = 0 UNION ALL SELECT s, 'RELATED_TO', 'i' || (k + 1) FROM p
UNION ALL SELECT s, 'NEEDS_OPERATOR_ATTENTION', 'yes' FROM p WHERE k % 3 = 0 UNION ALL SELECT s, 'NEEDS_OPERATOR_ATTENTION', 'rm -rf' FROM p WHERE k % 5 = 0
UNION ALL SELECT s, 'IS', 'RECOVERY_OPERATION' FROM p WHERE k % 4 < 2 UNION ALL SELECT s, 'IS', 'SAFE_TO_AUTOMATE' FROM p WHERE k % 5 = 1 AND k % 3 <> 0""")
def item_rules(spark, sf_dir):
    """Items as facts, and what their rules add."""
    g = builders.item_graph(items(spark, sf_dir), "manual")
    return three(rules.fixpoint(g, domains.item_rules())[0].facts)


@query_of("SELECT DISTINCT 'order#' || o_orderkey AS subject, 'COMPLIANCE_RISK' AS relation, 'c' || o_custkey AS object FROM orders WHERE o_orderstatus = 'F'")
def compliance_risk(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    f = stated(o, F.col("o_orderkey"), key("o_orderkey", "order#"), "OPAQUE_DEP", key("o_custkey", "c"))
    f = f.unionByName(stated(o.where("o_orderstatus = 'F'"), F.col("o_orderkey") + 10**9, key("o_orderkey", "order#"), "HANDLES_PII", F.lit("yes")))
    return domains.compliance_risk().plan(Graph(f)).select("subject", "relation", "object")


# Text


STEMS = "CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN regexp_matches(t, '[sx]es$') AND length(t) > 3 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"


@query_of(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '(\\w+)'), lambda t: length(t) > 1 AND t NOT IN ({listed(text.STOPWORDS)})), lambda t: {STEMS}))), '|') AS tokens FROM conversations")
def content_tokens(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(text.content_tokens(F.col("text"))), "|").alias("tokens"))


@query_of("SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z\"''])', '\\1\x01\\2', 'g'), '\x01'), lambda s: trim(s)), lambda s: length(s) BETWEEN 15 AND 600), '|') AS sentences FROM conversations")
def split_sentences(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.split_sentences(F.col("text")), "|").alias("sentences"))


def _moods_sql() -> str:
    parts = " || ".join(f"(CASE WHEN contains(q, '{w}') THEN '{''.join(x + '|' for x in m)}' ELSE '' END)" for w, m in text.MOODS.items())
    return f"SELECT conv_id, turn, {parts} AS moods FROM (SELECT conv_id, turn, lower(CASE turn % 3 WHEN 0 THEN 'Why, do you regret it? ' WHEN 1 THEN 'What! Stop. ' ELSE 'You die ' END || text) AS q FROM conversations)"


@query_of(_moods_sql())
def question_moods(spark, sf_dir):
    start = F.when(F.col("turn") % 3 == 0, "Why, do you regret it? ").when(F.col("turn") % 3 == 1, "What! Stop. ").otherwise("You die ")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(text.moods(F.concat(start, "text")), lambda m: F.concat(m, F.lit("|"))), "").alias("moods"))


@query_of("SELECT p_partkey, replace(p_name, ' ', ' OF ') || ' ' || lower(p_type) AS name FROM part")
def normalize_entity(spark, sf_dir):
    """Possessives and words said twice go."""
    said = F.concat(F.regexp_replace("p_name", " ", "'s OF of "), F.lit("  "), F.lower("p_type"), F.lit(" "), F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", text.normalize_entity(said).alias("name"))


@query_of(f"SELECT p_partkey, length(w) >= 3 AND w NOT IN ({listed(extraction.STOPWORDS)}) AND len(list_filter(string_split(trim(w), ' '), lambda t: length(t) > 2)) > 0 AS keep FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN substr(p_name, 1, CAST(p_partkey % 6 AS INTEGER)) WHEN 1 THEN 'when' ELSE 'a ' || substr(p_name, 1, 2) END AS w FROM part)")
def is_meaningful(spark, sf_dir):
    w = F.when(F.col("p_size") % 3 == 0, F.col("p_name").substr(F.lit(1), (F.col("p_partkey") % 6).cast("int"))).when(F.col("p_size") % 3 == 1, "when").otherwise(F.concat(F.lit("a "), F.substring("p_name", 1, 2)))
    return read(spark, sf_dir, "part").select("p_partkey", extraction.is_meaningful(w).alias("keep"))


@query_of("SELECT p_partkey, p_partkey % 3 <> 1 AND NOT (p_size % 2 = 0 AND p_partkey % 3 = 0) AS valid FROM part")
def valid_triple(spark, sf_dir):
    """Nothing founds itself, in whatever case; a fact needs both ends."""
    k, p = F.col("p_partkey") % 3, read(spark, sf_dir, "part")
    relation = F.when(F.col("p_size") % 2 == 0, "FOUNDED").otherwise("KNOWS")
    return p.select("p_partkey", extraction.valid_triple(F.col("p_brand"), relation, F.when(k == 0, F.upper("p_brand")).when(k == 1, "").otherwise(F.col("p_type"))).alias("valid"))


@query_of("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_type || ' ' || p_name END AS object FROM part")
def strip_trailing_subject(spark, sf_dir):
    s = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise("who")
    return read(spark, sf_dir, "part").select("p_partkey", extraction.strip_trailing_subject(s, F.concat_ws(" ", "p_type", "p_name")).alias("object"))


@query_of("SELECT p_partkey, p_name || ' sold theirs, and ' || p_name || ' knew ' || p_name || ' of thistle ' || p_name AS text FROM part")
def resolve_pronouns(spark, sf_dir):
    said = F.lit("He sold theirs, and she knew who of thistle They")
    return read(spark, sf_dir, "part").select("p_partkey", extraction.resolve_pronouns(said, F.col("p_name")).alias("text"))


# Programs


@query_of("SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity * (3 + ~CAST(l_linenumber % 2 AS BIGINT)), 6) AS value FROM lineitem")
def program_div_not(spark, sf_dir):
    code = [("LOAD", "p"), ("LOAD", "q"), ("DIV", ""), ("PUSH", "3"), ("LOAD", "t"), ("NOT", ""), ("ADD", ""), ("MUL", ""), ("RET", "")]
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), (F.col("l_linenumber") % 2).alias("t"))
    return run_program(l, {"main": code}, "main", ["p", "q", "t"]).select("l_orderkey", "l_linenumber", F.round("value", 6).alias("value"))


@query_of("SELECT l_orderkey, l_linenumber, round(l_quantity * s_acctbal + 3, 6) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def program_fetch(spark, sf_dir):
    """A fact for every row's supplier, and one that all rows read."""
    s = read(spark, sf_dir, "supplier")
    one = spark.createDataFrame([(-1, "policy", "FEE", "3")], "triple_id long, subject string, relation string, object string")
    facts = stated(s, F.col("s_suppkey"), key("s_suppkey"), "BALANCE", F.col("s_acctbal")).unionByName(complete(one))
    code = [("LOAD", "q"), ("FETCH", "@s|BALANCE"), ("MUL", ""), ("FETCH", "policy|FEE"), ("ADD", ""), ("RET", "")]
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("s"))
    return run_program(l, {"main": code}, "main", ["q", "s"], facts=facts).select("l_orderkey", "l_linenumber", F.round("value", 6).alias("value"))


@query_of("SELECT p_partkey, (p_size * 10 + 5)::DOUBLE AS value, array_to_string(list_transform(range(0, CAST(p_size AS BIGINT)), lambda i: CAST(i * i AS VARCHAR)), ',') AS emitted FROM part")
def program_map_opaque(spark, sf_dir):
    """MAP emits squares and leaves their number; a value taken on trust comes on top."""
    programs = {"main": [("LOAD", "p_size"), ("MAP", "square"), ("PUSH", "10"), ("MUL", ""), ("OPAQUE", "oracle"), ("ADD", ""), ("RET", "")], "square": [("LOAD", "i"), ("DUP", ""), ("MUL", ""), ("RET", "")]}
    out = run_program(read(spark, sf_dir, "part"), programs, "main", ["p_size"], oracles={"oracle": 5.0}, emits="e")
    return out.select("p_partkey", "value", F.array_join(F.transform("e", lambda x: x.cast("long").cast("string")), ",").alias("emitted"))


@query_of("SELECT p_partkey, (1 - p_size % 2)::DOUBLE AS value FROM part")
def program_mutual_recursion(spark, sf_dir):
    """Even and odd call one another."""
    step = lambda n, other, at_zero: [("STORE", "n"), ("LOAD", "n"), ("JZ", "8"), ("LOAD", "n"), ("PUSH", "1"), ("SUB", ""), ("CALL", other), ("RET", ""), ("PUSH", at_zero), ("RET", "")]
    programs = {"even": step("n", "odd", "1"), "odd": step("n", "even", "0")}
    return call_value(read(spark, sf_dir, "part"), programs, "even", ["p_size"]).select("p_partkey", "value")


@query_of("SELECT p_partkey, bit_count(p_size)::DOUBLE AS value FROM part")
def program_popcount(spark, sf_dir):
    """Bits that are set, counted by a loop."""
    code = [("STORE", "n"), ("PUSH", "0"), ("STORE", "c"), ("LOAD", "n"), ("JZ", "16"), ("LOAD", "c"), ("LOAD", "n"), ("PUSH", "1"), ("AND", ""), ("ADD", ""), ("STORE", "c"), ("LOAD", "n"), ("PUSH", "1"), ("SHR", ""), ("STORE", "n"), ("JMP", "3"), ("LOAD", "c"), ("RET", "")]
    return call_value(read(spark, sf_dir, "part"), {"popcount": code}, "popcount", ["p_size"]).select("p_partkey", "value")


@query_of("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND c_acctbal < 0 THEN 0 WHEN o_totalprice > 300000 THEN 2 ELSE 1 END::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def program_decide(spark, sf_dir):
    """Refuse, review or pass an order, by a selector that two checks make."""
    programs = {
        "main": [("LOAD", "price"), ("CALL", "large"), ("LOAD", "balance"), ("PUSH", "0"), ("LT", ""), ("ADD", ""), ("LOAD", "price"), ("CALL", "large"), ("MUL", ""), ("DISPATCH", "0:pass,1:review,2:refuse"), ("RET", "")],
        "large": [("PUSH", "300000"), ("GT", ""), ("RET", "")],
        "pass": [("PUSH", "1")],
        "review": [("PUSH", "2")],
        "refuse": [("PUSH", "0")],
    }
    x = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return run_program(x.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance")), programs, "main", ["price", "balance"]).select("o_orderkey", "value")
