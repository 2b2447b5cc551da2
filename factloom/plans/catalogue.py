"""Named queries over the driver's tables, each with the SQL that says what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import confidence as conf
from factloom.functions import temporal, text
from factloom.operators import conflict, eras, ontology, query, reach, rules
from factloom.plans import program
from factloom.plans.program import run_program
from factloom.plans.storage import written
from factloom.schema import Graph, complete
from factloom.sources.graphs import relational

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "chain_customer_nation_region"

FACT_SQL = """fact AS (
  SELECT n_name AS s, 'IN_REGION' AS r, r_name AS o, 1000000000000 + n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer#' || c_custkey, 'IN_NATION', n_name, 2000000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier#' || s_suppkey, 'IN_NATION', n_name, 3000000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'order#' || o_orderkey, 'PLACED_BY', 'customer#' || o_custkey, 4000000000000 + o_orderkey FROM orders)"""


def query_of(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.replace("{fact}", FACT_SQL)
        return f

    return keep


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g_of(spark, sf_dir: str) -> Graph:
    return Graph(relational(spark, sf_dir))


def three(df: DataFrame) -> DataFrame:
    return df.select("subject", "relation", "object")


# Lookups, scopes, counts


@query_of("WITH {fact} SELECT s AS subject, r AS relation, o AS object FROM fact WHERE s = 'customer#7'")
def out_facts(spark, sf_dir):
    return three(query.out_facts(g_of(spark, sf_dir), "customer#7"))


@query_of("WITH {fact} SELECT s AS subject, r AS relation, o AS object FROM fact WHERE o = (SELECT n_name FROM nation WHERE n_nationkey = 7) AND r = 'IN_NATION'")
def in_facts(spark, sf_dir):
    name = read(spark, sf_dir, "nation").where("n_nationkey = 7").head()["n_name"]
    return three(query.in_facts(g_of(spark, sf_dir), name, "IN_NATION"))


@query_of("WITH {fact} SELECT DISTINCT e AS entity FROM (SELECT s AS e FROM fact UNION ALL SELECT o FROM fact)")
def entities(spark, sf_dir):
    return query.entities(g_of(spark, sf_dir))


@query_of("WITH {fact}, n AS (SELECT n_name AS x FROM nation WHERE n_nationkey = 3) SELECT DISTINCT e AS entity FROM (SELECT o AS e FROM fact, n WHERE s = x UNION ALL SELECT s FROM fact, n WHERE o = x)")
def neighbours(spark, sf_dir):
    return query.neighbours(g_of(spark, sf_dir), read(spark, sf_dir, "nation").where("n_nationkey = 3").head()["n_name"])


@query_of("WITH {fact} SELECT r AS relation, count(*) AS n FROM fact GROUP BY r")
def relation_counts(spark, sf_dir):
    return query.relation_counts(relational(spark, sf_dir))


@query_of("WITH {fact} SELECT e AS entity, count(*) AS n, CAST(sum(out) AS BIGINT) AS n_out, CAST(sum(1 - out) AS BIGINT) AS n_in FROM (SELECT s AS e, 1 AS out FROM fact UNION ALL SELECT o, 0 FROM fact) GROUP BY e")
def degrees(spark, sf_dir):
    return query.degrees(relational(spark, sf_dir))


@query_of("WITH {fact}, c AS (SELECT r, o, count(*) AS n, min(id) AS f FROM fact GROUP BY r, o) SELECT r AS relation, o AS object, n, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, f) AS k FROM c) WHERE k <= 5")
def top_objects(spark, sf_dir):
    return query.top_objects(relational(spark, sf_dir))


@query_of("WITH {fact} SELECT a.s AS start, c.o AS \"end\" FROM fact a JOIN fact b ON a.o = b.s JOIN fact c ON b.o = c.s WHERE a.r = 'PLACED_BY' AND b.r = 'IN_NATION' AND c.r = 'IN_REGION'")
def chain_customer_nation_region(spark, sf_dir):
    g = g_of(spark, sf_dir)
    start = g.facts.where("relation = 'PLACED_BY'").select(F.col("subject").alias("start"))
    return query.chain_query(g, start, ["PLACED_BY", "IN_NATION", "IN_REGION"]).select("start", "end")


@query_of("WITH {fact} SELECT s AS subject FROM (SELECT DISTINCT s FROM fact WHERE r = 'IN_NATION') x WHERE NOT EXISTS (SELECT 1 FROM fact p WHERE p.r = 'PLACED_BY' AND p.o = x.s)")
def naf_no_orders(spark, sf_dir):
    f = relational(spark, sf_dir)
    turned = f.where("relation = 'PLACED_BY'").select(F.col("object").alias("subject"), F.lit("PLACED").alias("relation"), F.lit("").alias("object"))
    return query.missing(three(f).unionByName(turned), "IN_NATION", "PLACED")


def event_facts(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("int")
    return complete(e.select(F.col("event_id").alias("triple_id"), F.col("user_id").cast("string").alias("subject"), F.lit("DID").alias("relation"), F.col("event_id").cast("string").alias("object"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("scope"), seq.alias("seq")))


@query_of("SELECT CAST(event_id AS VARCHAR) AS object, CASE WHEN event_type <> 'view' THEN event_type END AS scope FROM events WHERE event_type IN ('click', 'view')")
def scope_view(spark, sf_dir):
    return query.in_scope(event_facts(spark, sf_dir), "click").select("object", "scope")


@query_of("SELECT CAST(event_id AS VARCHAR) AS object, seq FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events) WHERE event_type = 'click'")
def ordered_scope(spark, sf_dir):
    return query.ordered_scope(event_facts(spark, sf_dir), "click").select("object", "seq")


@query_of("SELECT DISTINCT event_type AS scope FROM events WHERE event_type <> 'view'")
def scopes(spark, sf_dir):
    return query.scopes(event_facts(spark, sf_dir))


@query_of("SELECT a.n_name AS a, b.n_name AS b, r_name AS object FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name JOIN region ON a.n_regionkey = r_regionkey")
def shared_region(spark, sf_dir):
    return query.shared_objects(relational(spark, sf_dir), "IN_REGION")


# Time


def shipments(spark, sf_dir) -> DataFrame:
    """Which supplier a part comes from, for the 20 days from a shipment."""
    l = read(spark, sf_dir, "lineitem")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return complete(l.select(
        key.alias("triple_id"), F.concat(F.lit("part#"), F.col("l_partkey").cast("string")).alias("subject"), F.lit("SUPPLIED_BY").alias("relation"),
        F.concat(F.lit("supplier#"), F.col("l_suppkey").cast("string")).alias("object"), F.col("l_returnflag").alias("source_article"), F.col("l_linenumber").alias("source_sentence_idx"),
        day("l_shipdate").alias("valid_from"), day(F.date_add("l_shipdate", 20)).alias("valid_to"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_linestatus").alias("scope"),
    ))


ORD = "(year({0}) * 384 + (month({0}) - 1) * 32 + day({0}) - 1)"
SHIP = f"""ship AS (SELECT l_orderkey * 100 + l_linenumber AS id, 'part#' || l_partkey AS s, 'supplier#' || l_suppkey AS o, l_returnflag AS src, l_linestatus AS scope, 1 - l_discount AS c,
  strftime(l_shipdate, '%Y-%m-%d') AS vf, strftime(l_shipdate + INTERVAL 20 DAY, '%Y-%m-%d') AS vt,
  {ORD.format("l_shipdate")} AS f, {ORD.format("(l_shipdate + INTERVAL 20 DAY)")} AS t FROM lineitem)"""


@query_of(f"SELECT o_orderkey, CAST({ORD.format('o_orderdate')} AS BIGINT) AS ord, CAST(year(o_orderdate) * -384 AS BIGINT) AS bc FROM orders")
def date_ord(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    bc = F.concat(F.year("o_orderdate").cast("string"), F.lit(" BC"))
    return o.select("o_orderkey", temporal.date_ord(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ord"), temporal.date_ord(bc).alias("bc"))


@query_of(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {ORD.format("o_orderdate")} AS xf, {ORD.format("(o_orderdate + INTERVAL 30 DAY)")} AS xt, {ORD.format("l_shipdate")} AS yf, {ORD.format("(l_shipdate + INTERVAL 10 DAY)")} AS yt FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN xf = yf AND xt = yt THEN 'equal' WHEN xt < yf - 1 THEN 'before' WHEN yt < xf - 1 THEN 'after' WHEN xt = yf - 1 OR xt = yf THEN 'meets' WHEN yt = xf - 1 OR yt = xf THEN 'met_by'
 WHEN xf = yf AND xt < yt THEN 'starts' WHEN xf = yf AND yt < xt THEN 'started_by' WHEN yf < xf AND xt < yt THEN 'during' WHEN xf < yf AND yt < xt THEN 'contains' WHEN xt = yt AND xf > yf THEN 'finishes' WHEN xt = yt AND yf > xf THEN 'finished_by'
 WHEN xf < yf AND yf <= xt AND xt < yt THEN 'overlaps' WHEN yf < xf AND xf <= yt AND yt < xt THEN 'overlapped_by' END AS relation FROM x""")
def allen_relation(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    o = lambda c, d: temporal.ord_of_date(F.date_add(c, d))
    # ordinals are a step of their own: the relation names each many times
    x = x.select("l_orderkey", "l_linenumber", o("o_orderdate", 0).alias("xf"), o("o_orderdate", 30).alias("xt"), o("l_shipdate", 0).alias("yf"), o("l_shipdate", 10).alias("yt"))
    return x.select("l_orderkey", "l_linenumber", temporal.relation(*map(F.col, ("xf", "xt", "yf", "yt"))).alias("relation"))


@query_of(f"WITH {SHIP} SELECT id FROM ship WHERE 1995 * 384 + 5 * 32 + 16 BETWEEN f AND t")
def valid_at(spark, sf_dir):
    low, high = temporal.date_ord(F.col("valid_from")), temporal.date_ord(F.col("valid_to"))
    return shipments(spark, sf_dir).where(temporal.valid_at(low, high, temporal.date_ord(F.lit("1995-06-17")))).select(F.col("triple_id").alias("id"))


@query_of("WITH p AS (SELECT c_nationkey AS key, o_orderkey AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders JOIN customer ON o_custkey = c_custkey) SELECT a.key, a.id AS a, b.id AS b, b.day - a.day AS gap FROM p a JOIN p b ON a.key = b.key AND b.day - a.day BETWEEN 0 AND 2 AND (b.day > a.day OR b.id > a.id)")
def contemporaries_band(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return query.band_pairs(o.select(F.col("c_nationkey").alias("key"), F.col("o_orderkey").alias("id"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("at")), 2)


# Confidence


@query_of("SELECT l_orderkey, round(product(1 - l_discount) + 1e-9, 6) AS c_and, round(1 - product(1 - l_tax) + 1e-9, 6) AS c_or, min(1 - l_discount) AS c_min FROM lineitem GROUP BY l_orderkey")
def noisy_combinations(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(1 - F.col("l_discount")).alias("d"), conf.noisy_or_agg(F.col("l_tax")).alias("o"))
    return x.select("l_orderkey", F.round(conf.noisy_and(F.col("d")) + 1e-9, 6).alias("c_and"), F.round(F.col("o") + 1e-9, 6).alias("c_or"), conf.min_confidence(F.col("d")).alias("c_min"))


# Rules and axioms


@query_of("WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
def transitive_closure(spark, sf_dir):
    k = F.col("p_partkey")
    e = read(spark, sf_dir, "part").where((k > 1) & (F.floor((k - 1) / 2) > 0)).select(k.alias("a"), F.floor((k - 1) / 2).cast("long").alias("b"))
    return rules.closure(e)


@query_of("SELECT r_regionkey AS a FROM region")
def cycle_detect(spark, sf_dir):
    r = read(spark, sf_dir, "region")
    n = r.count()
    e = r.select(F.col("r_regionkey").alias("a"), ((F.col("r_regionkey") + 1) % n).cast("int").alias("b"))
    return rules.closure(e).where("a = b").select("a")


@query_of("WITH p AS (SELECT p_partkey AS k, (p_partkey - 1) // 2 AS u FROM part) SELECT a.k AS child, b.u AS grandparent FROM p a JOIN p b ON a.u = b.k WHERE b.u > 0")
def grandparent_two_hop(spark, sf_dir):
    k = F.col("p_partkey")
    f = read(spark, sf_dir, "part").where(F.floor((k - 1) / 2) > 0).select(k.alias("triple_id"), k.cast("string").alias("subject"), F.lit("CHILD_OF").alias("relation"), F.floor((k - 1) / 2).cast("string").alias("object"), F.lit("part").alias("source_article"))
    out = rules.compose("grandchild", "CHILD_OF", "CHILD_OF", "GRANDCHILD_OF").plan(Graph(complete(f)))
    return out.select(F.col("subject").cast("long").alias("child"), F.col("object").cast("long").alias("grandparent"))


@query_of("""WITH {fact}, one AS (SELECT s, r, o FROM fact WHERE r IN ('IN_REGION', 'IN_NATION')),
two AS (SELECT DISTINCT s, 'LOCATED_IN' AS r, o FROM one), three AS (SELECT * FROM two UNION SELECT a.s, 'LOCATED_IN', b.o FROM two a JOIN two b ON a.o = b.s)
SELECT s AS subject, r AS relation, o AS object FROM (SELECT s, r, o FROM three UNION SELECT o, 'HAS_PLACE', s FROM three UNION SELECT o, 'IS_A', 'Place' FROM three UNION SELECT o, 'IS_A', 'Customer' FROM fact WHERE r = 'PLACED_BY')""")
def ontology_closure(spark, sf_dir):
    g = Graph(relational(spark, sf_dir))
    ont = ontology.Ontology("places").sub_property_of("IN_REGION", "LOCATED_IN").sub_property_of("IN_NATION", "LOCATED_IN").transitive_property("LOCATED_IN").inverse_properties("LOCATED_IN", "HAS_PLACE").range("LOCATED_IN", "Place").range("PLACED_BY", "Customer")
    closed, _, _ = rules.fixpoint(g, ontology.compile_to_rules(ont))
    return three(closed.facts).where(F.col("relation").isin("LOCATED_IN", "HAS_PLACE", "IS_A")).distinct()


@query_of("SELECT 'region#' || a.r_regionkey AS subject, 'region#' || b.r_regionkey AS object FROM region a JOIN region b ON abs(a.r_regionkey - b.r_regionkey) = 1")
def symmetric_property(spark, sf_dir):
    r = F.col("r_regionkey")
    f = read(spark, sf_dir, "region").where("r_regionkey > 0").select(r.cast("long").alias("triple_id"), F.concat(F.lit("region#"), r.cast("string")).alias("subject"), F.lit("NEXT_TO").alias("relation"), F.concat(F.lit("region#"), (r - 1).cast("string")).alias("object"))
    closed, _, _ = rules.fixpoint(Graph(complete(f)), ontology.compile_to_rules(ontology.Ontology().symmetric_property("NEXT_TO")))
    return closed.facts.select("subject", "object")


@query_of("SELECT DISTINCT 'part#' || p_partkey AS subject, c AS object FROM (SELECT p_partkey, p_type AS c FROM part UNION ALL SELECT p_partkey, 'Product' FROM part WHERE p_type = (SELECT min(p_type) FROM part))")
def subclass_membership(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    first = p.agg(F.min("p_type")).head()[0]
    f = complete(p.select(F.col("p_partkey").alias("triple_id"), F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("subject"), F.lit("IS_A").alias("relation"), F.col("p_type").alias("object")))
    closed, _, _ = rules.fixpoint(Graph(f), ontology.compile_to_rules(ontology.Ontology().subclass_of(first, "Product")))
    return closed.facts.select("subject", "object")


CLASH = f"{SHIP}, pair AS (SELECT DISTINCT a.s, least(a.o, b.o) AS x, greatest(a.o, b.o) AS y FROM ship a JOIN ship b ON a.s = b.s AND a.id < b.id AND a.o <> b.o AND a.scope = b.scope AND greatest(a.f, b.f) < least(a.t, b.t))"


@query_of(f"WITH {CLASH} SELECT s AS subject, 'SUPPLIED_BY:' || x || '|' || y AS object FROM pair")
def functional_conflicts(spark, sf_dir):
    return ontology.functional_markers(Graph(shipments(spark, sf_dir)), "SUPPLIED_BY").select("subject", "object").distinct()


def clashes(spark, sf_dir) -> DataFrame:
    f = shipments(spark, sf_dir)
    m = written(ontology.functional_markers(Graph(f), "SUPPLIED_BY").select("subject", "relation", "object").distinct())
    marked = complete(m.withColumn("triple_id", -F.abs(F.xxhash64("subject", "object")) - 1))
    return conflict.detect_conflicts(Graph(f.unionByName(marked))).withColumn("conflict", F.concat_ws("/", "subject", "detail"))


MEMBERS = f"WITH {CLASH}, m AS (SELECT p.s || '/SUPPLIED_BY:' || x || '|' || y AS conflict, ship.*, CASE src WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.5 ELSE 0.1 END AS score FROM pair p JOIN ship ON ship.s = p.s AND ship.o IN (x, y))"


def settled(spark, sf_dir, policies) -> DataFrame:
    authority = spark.createDataFrame([("A", 0.9), ("N", 0.5), ("R", 0.1)], "source string, score double")
    return conflict.survivors(clashes(spark, sf_dir), policies, authority).where("keep").select("conflict", F.col("triple_id").alias("id"))


def winners(*keys: str) -> str:
    ranks = ", ".join(f"rank() OVER (PARTITION BY conflict ORDER BY {k}) AS r{n}" for n, k in enumerate(keys))
    ones = ", ".join(f"count(*) FILTER (r{n} = 1) OVER (PARTITION BY conflict) AS n{n}" for n in range(len(keys)))
    case = " ".join(f"WHEN n{n} = 1 THEN r{n} = 1" for n in range(len(keys)))
    return f"{MEMBERS}, k AS (SELECT *, {ranks} FROM m), o AS (SELECT *, {ones} FROM k) SELECT conflict, id FROM o WHERE CASE {case} ELSE true END"


@query_of(winners("f DESC, t DESC"))
def policy_latest(spark, sf_dir):
    return settled(spark, sf_dir, [conflict.latest_wins])


@query_of(winners("c DESC"))
def policy_confidence(spark, sf_dir):
    return settled(spark, sf_dir, [conflict.highest_confidence])


@query_of(winners("score DESC"))
def policy_authority(spark, sf_dir):
    return settled(spark, sf_dir, [conflict.authority_wins])


@query_of(winners("score DESC", "f DESC, t DESC", "c DESC"))
def policy_chain(spark, sf_dir):
    return settled(spark, sf_dir, [conflict.authority_wins, conflict.latest_wins, conflict.highest_confidence])


@query_of("SELECT 'part#' || l_partkey AS subject, 'supplier#' || l_suppkey AS object, count(*) AS n, round(CASE WHEN count(*) = 1 THEN min(l_discount * 5) ELSE 1 - product(1 - l_discount * 5) END + 1e-9, 6) AS confidence, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS source_article FROM lineitem GROUP BY l_partkey, l_suppkey")
def corroborate(spark, sf_dir):
    f = shipments(spark, sf_dir).withColumn("confidence", (1 - F.col("confidence")) * 5)
    none = F.lit(None).cast("string")
    out = conflict.corroborate(f.withColumn("valid_from", none).withColumn("valid_to", none).withColumn("scope", none))
    return out.select("subject", "object", "n", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), "source_article")


@query_of(f"WITH {SHIP} SELECT id FROM ship WHERE c >= 0.95")
def prune_below(spark, sf_dir):
    return conflict.prune_below(shipments(spark, sf_dir), 0.95)[0].select(F.col("triple_id").alias("id"))


@query_of("SELECT 'order#' || l_orderkey AS subject, 'HAS_SUPPLIER' AS property, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 5")
def cardinality_violation(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    f = l.select(F.concat(F.lit("order#"), F.col("l_orderkey").cast("string")).alias("subject"), F.lit("HAS_SUPPLIER").alias("relation"), F.col("l_suppkey").cast("string").alias("object"))
    return ontology.cardinality_violations(f, ontology.Ontology().cardinality("HAS_SUPPLIER", max=5))


@query_of("SELECT DISTINCT 'order#' || o_orderkey AS subject, 'AutoOrder' AS class FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def some_values_class(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    first = c.agg(F.min("c_mktsegment")).head()[0]
    is_a = c.select(F.col("c_custkey").cast("string").alias("subject"), F.lit("IS_A").alias("relation"), F.col("c_mktsegment").alias("object"))
    by = o.select(F.concat(F.lit("order#"), F.col("o_orderkey").cast("string")).alias("subject"), F.lit("PLACED_BY").alias("relation"), F.col("o_custkey").cast("string").alias("object"))
    return ontology.memberships(is_a.unionByName(by), ontology.Ontology().some_values("AutoOrder", "PLACED_BY", first))


# Eras


@query_of("""WITH v AS (SELECT DISTINCT year(l_shipdate) AS y, l_suppkey AS x FROM lineitem), n AS (SELECT y, count(*) AS n FROM v GROUP BY y),
i AS (SELECT a.y AS a, b.y AS b, count(*) AS k FROM v a JOIN v b ON a.x = b.x AND a.y < b.y GROUP BY 1, 2)
SELECT CAST(p.y AS INTEGER) AS a, CAST(q.y AS INTEGER) AS b, round(1 - coalesce(k, 0) / (p.n + q.n - coalesce(k, 0)), 6) AS distance FROM n p JOIN n q ON p.y < q.y LEFT JOIN i ON i.a = p.y AND i.b = q.y""")
def jaccard_eras(spark, sf_dir):
    v = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), F.col("l_suppkey").alias("x"))
    return eras.jaccard(v, "y", "x").select("a", "b", F.round("distance", 6).alias("distance"))


@query_of("WITH t AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS x FROM lineitem) SELECT a.x AS low, b.x AS high, count(*) AS n FROM t a JOIN t b ON a.k = b.k AND a.x < b.x GROUP BY 1, 2")
def co_occurrence(spark, sf_dir):
    return query.co_occurring(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


# Programs

PRICE = {"price": [("LOAD", "l_extendedprice"), ("PUSH", "1"), ("LOAD", "l_discount"), ("SUB", ""), ("MUL", ""), ("DUP", ""), ("PUSH", "50000"), ("GT", ""), ("JZ", "12"), ("PUSH", "0.9"), ("MUL", ""), ("RET", ""), ("RET", "")]}


@query_of("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice * (1 - l_discount) > 50000 THEN l_extendedprice * (1 - l_discount) * 0.9 ELSE l_extendedprice * (1 - l_discount) END, 6) AS value FROM lineitem")
def program_price(spark, sf_dir):
    out = run_program(read(spark, sf_dir, "lineitem"), PRICE, "price", ["l_extendedprice", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", F.round("value", 6).alias("value"))


@query_of("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * p_size WHEN 1 THEN p_size + 1 ELSE (p_size & 6) << 1 END::DOUBLE AS value FROM part")
def program_dispatch(spark, sf_dir):
    programs = {
        "main": [("LOAD", "p_size"), ("LOAD", "p_size"), ("PUSH", "3"), ("MOD", ""), ("DISPATCH", "0:square,1:next,2:bits")],
        "square": [("DUP", ""), ("MUL", "")],
        "next": [("PUSH", "1"), ("ADD", "")],
        "bits": [("PUSH", "6"), ("AND", ""), ("PUSH", "1"), ("SHL", "")],
    }
    return run_program(read(spark, sf_dir, "part"), programs, "main", ["p_size"]).select("p_partkey", "value")


@query_of("SELECT p_partkey, (p_size * (p_size - 1) / 2)::DOUBLE AS value FROM part")
def program_fold(spark, sf_dir):
    programs = {"main": [("PUSH", "0"), ("LOAD", "p_size"), ("FOLD", "sum")], "sum": [("LOAD", "acc"), ("LOAD", "i"), ("ADD", "")]}
    return run_program(read(spark, sf_dir, "part"), programs, "main", ["p_size"]).select("p_partkey", "value")


@query_of("SELECT p_partkey, (p_size // 2)::DOUBLE AS value FROM part")
def program_filter(spark, sf_dir):
    programs = {"main": [("LOAD", "p_size"), ("FILTER", "odd")], "odd": [("LOAD", "i"), ("PUSH", "2"), ("MOD", "")]}
    return run_program(read(spark, sf_dir, "part"), programs, "main", ["p_size"]).select("p_partkey", "value")


@query_of("SELECT l_orderkey, l_linenumber, gcd(CAST(l_quantity AS BIGINT), l_partkey)::DOUBLE AS value FROM lineitem")
def program_gcd(spark, sf_dir):
    gcd = [("LOAD", "b"), ("JZ", "10"), ("LOAD", "a"), ("LOAD", "b"), ("MOD", ""), ("STORE", "t"), ("LOAD", "b"), ("STORE", "a"), ("LOAD", "t"), ("JMP", "12"), ("LOAD", "a"), ("RET", ""), ("STORE", "b"), ("JMP", "0")]
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_partkey").alias("b"))
    return run_program(df, {"gcd": gcd}, "gcd", ["a", "b"]).select("l_orderkey", "l_linenumber", "value")


# Text


@query_of(r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)^how\s+(?:do\s+i|can\s+i|to)|^what''?s? the way to|\b(?:undo|delete|remove|create|make|add|fix|amend|revert)\b') THEN 'how-to' WHEN regexp_matches(text, '(?i)^what\s+is|^what\s+does|^what''?s? a ') THEN 'what-is' WHEN regexp_matches(text, '(?i)\bvs\b|\bversus\b|difference between') THEN 'compare' WHEN regexp_matches(text, '(?i)^why\s+|\bwhy\s+does\b|\bwhy\s+am\s+i\b') THEN 'why' ELSE 'how-to' END AS intent FROM conversations")
def question_intent(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.detect_intent(F.col("text")).alias("intent"))


def _topics_sql() -> str:
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {quoted(w)})' for w in words)} THEN {quoted(key)} END" for key, words in text.TOPICS.items())
    return f"SELECT conv_id, turn, concat_ws(',', {cases}) AS topics FROM conversations"


@query_of(_topics_sql())
def question_topics(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.told(F.col("text")), ",").alias("topics"))


def _markup_sql() -> str:
    out = "html"
    for pattern, by in text.MARKUP:
        flags = "g" + ("s" if "(?s)" in pattern else "")
        p = pattern.replace("(?s)", "").replace("'", "''")
        out = f"regexp_replace({out}, '{p}', '{by.replace('$', chr(92))}', '{flags}')"
    return f"SELECT page_id, md5(trim({out})) AS prose_md5 FROM pages"


@query_of(_markup_sql())
def strip_markup(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_markup(F.col("html")).cast("binary")).alias("prose_md5"))


# Reach, orders and groups


def tree(spark, sf_dir) -> DataFrame:
    """a, b: each part and the part of half its number."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").where((k > 1) & (F.floor((k - 1) / 2) > 0)).select(k.alias("a"), F.floor((k - 1) / 2).cast("long").alias("b"))


TREE = "e AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE p_partkey > 1 AND (p_partkey - 1) // 2 > 0)"


@query_of(f"WITH RECURSIVE {TREE}, c AS (SELECT a AS start, b AS node FROM e WHERE a IN (SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) UNION SELECT c.start, e.b FROM c JOIN e ON c.node = e.a) SELECT start, node FROM c")
def reach_from(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return reach.reach(tree(spark, sf_dir), p.where(F.col("p_brand") == p.agg(F.min("p_brand")).head()[0]).select(F.col("p_partkey").alias("start")))


@query_of(f"WITH RECURSIVE {TREE}, c AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS hop UNION SELECT e.a, c.hop + 1 FROM c JOIN e ON c.node = e.b) SELECT CAST(hop AS INTEGER) AS hop, count(*) AS n FROM c GROUP BY hop")
def layers_from(spark, sf_dir):
    e = tree(spark, sf_dir).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return reach.layers(e, spark.range(5, 6).select(F.col("id").alias("start"))).groupBy("hop").agg(F.count("*").alias("n"))


@query_of(f"WITH RECURSIVE {TREE}, h AS (SELECT p_partkey AS a, p_brand AS b FROM part), c AS (SELECT a AS node FROM h WHERE b = (SELECT min(p_brand) FROM part) UNION SELECT e.a FROM c JOIN e ON c.node = e.b) SELECT node FROM c")
def blast_radius(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return reach.blast_radius(tree(spark, sf_dir), p.select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("b")), p.agg(F.min("p_brand")).head()[0])


@query_of("WITH {fact} SELECT list_transform([a.id, b.id, c.id], lambda x: CAST(x AS BIGINT))::VARCHAR AS path FROM fact a JOIN fact b ON b.s = a.o JOIN fact c ON c.s = b.o WHERE a.s = 'order#32' AND b.r = 'IN_NATION' AND c.r = 'IN_REGION'")
def find_paths(spark, sf_dir):
    g = g_of(spark, sf_dir)
    end = g.facts.where("subject = 'order#32'").select("object").head()
    nation = g.facts.where(F.col("subject") == end[0]).where("relation = 'IN_NATION'").head()["object"]
    region = g.facts.where(F.col("subject") == nation).where("relation = 'IN_REGION'").head()["object"]
    return query.find_paths(g, "order#32", region).select(F.concat(F.lit("["), F.array_join(F.transform("path", lambda x: x.cast("string")), ", "), F.lit("]")).alias("path"))


@query_of("SELECT CAST(user_id AS VARCHAR) AS scope, CAST(event_id AS VARCHAR) AS a, CAST(n AS VARCHAR) AS b FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL")
def precedes(spark, sf_dir):
    e = event_facts(spark, sf_dir)
    return reach.precedes(e.withColumn("scope", F.col("subject")), relation="DID")


@query_of("SELECT a.n_name AS subject, 'NEIGHBOUR_OF' AS relation, b.n_name AS object FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def group_pairs(spark, sf_dir):
    return reach.group_pairs(relational(spark, sf_dir), "IN_REGION", "NEIGHBOUR_OF")


@query_of("WITH {fact} SELECT s AS subject, o AS object FROM fact WHERE r = 'IN_NATION' AND s IN (SELECT o FROM fact WHERE r = 'PLACED_BY')")
def exposed(spark, sf_dir):
    f = relational(spark, sf_dir)
    turned = f.where("relation = 'PLACED_BY'").select(F.col("object").alias("subject"), F.lit("PLACED").alias("relation"), F.lit("").alias("object"))
    return reach.exposed(three(f).unionByName(turned), "PLACED", "IN_NATION")


@query_of("SELECT 'order#' || l_orderkey AS subject, CASE WHEN count(DISTINCT l_returnflag) = 2 THEN 'both' ELSE min(l_returnflag) END AS side FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_orderkey")
def class_overlap(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    f = l.select(F.concat(F.lit("order#"), F.col("l_orderkey").cast("string")).alias("subject"), F.lit("FLAG").alias("relation"), F.col("l_returnflag").alias("object"))
    return query.overlap(f, "FLAG", "A", "N")


ERAS = [("early", 1992, 1994), ("middle", 1994, 1996), ("late", 1997, 9999)]


@query_of(f"WITH {SHIP}, e AS (SELECT * FROM (VALUES {', '.join(map(str, ERAS))}) AS v(era, a, b)) SELECT era, count(*) AS n FROM e JOIN ship ON t >= a * 384 AND f <= b * 384 GROUP BY era")
def facts_in_eras(spark, sf_dir):
    e = spark.createDataFrame(ERAS, "name string, from_year int, to_year int")
    return eras.facts_in_eras(shipments(spark, sf_dir), e).groupBy("era").agg(F.count("*").alias("n"))


@query_of(f"WITH {SHIP}, e AS (SELECT * FROM (VALUES {', '.join(map(str, ERAS))}) AS v(era, a, b)), h AS (SELECT DISTINCT era, a, o FROM e JOIN ship ON t >= a * 384 AND f <= b * 384 WHERE s = 'part#7'), n AS (SELECT era, lag(era) OVER (ORDER BY a) AS p FROM e) SELECT n.era, coalesce((SELECT string_agg(o, ',' ORDER BY o) FROM h WHERE h.era = n.era AND o NOT IN (SELECT o FROM h h2 WHERE h2.era = n.p)), '') AS appeared, coalesce((SELECT string_agg(o, ',' ORDER BY o) FROM h WHERE h.era = n.p AND o NOT IN (SELECT o FROM h h2 WHERE h2.era = n.era)), '') AS retired FROM n")
def era_drift(spark, sf_dir):
    e = spark.createDataFrame(ERAS, "name string, from_year int, to_year int")
    shaped = eras.projections(shipments(spark, sf_dir), e, "part#7", ("SUPPLIED_BY",))
    out = eras.drift(shaped, "supplied_by")
    return out.select("era", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("appeared", "retired")))


# Standard rules over lives made of orders: born with the first, died with the last


def lives(spark, sf_dir) -> Graph:
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    born = o.select(F.col("o_custkey").alias("triple_id"), name.alias("subject"), F.lit("BORN_DATE").alias("relation"), F.concat((F.col("a") - 1990 + F.col("o_custkey") * 7 % 2000).cast("string"), F.when(F.col("o_custkey") % 5 == 0, " BC").otherwise(" AD")).alias("object"))
    died = o.select((F.col("o_custkey") + 10**9).alias("triple_id"), name.alias("subject"), F.lit("DIED_DATE").alias("relation"), F.concat((F.col("b") - 1990 + F.col("o_custkey") * 7 % 2000).cast("string"), F.when(F.col("o_custkey") % 5 == 0, " BC").otherwise(" AD")).alias("object"))
    return Graph(complete(born.unionByName(died)))


LIVES = "l AS (SELECT o_custkey AS k, min(year(o_orderdate)) - 1990 + o_custkey * 7 % 2000 AS a, max(year(o_orderdate)) - 1990 + o_custkey * 7 % 2000 AS b, CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE 1 END AS s FROM orders GROUP BY o_custkey)"


def rule_named(name: str):
    return next(r for r in rules.standard_rules() if r.name == name)


@query_of(f"WITH {LIVES} SELECT 'c' || k AS subject, (b - a) * s || ' years' AS object FROM l WHERE (b - a) * s BETWEEN 1 AND 120")
def rule_lived_for(spark, sf_dir):
    return rule_named("lived_for").plan(lives(spark, sf_dir)).select("subject", "object")


@query_of(f"WITH {LIVES} SELECT 'c' || k AS subject, CASE WHEN s < 0 THEN CASE WHEN a >= 800 THEN 'ancient_archaic_era' WHEN a >= 400 THEN 'ancient_classical_era' ELSE 'ancient_hellenistic_era' END WHEN a < 500 THEN 'late_antiquity' WHEN a < 1500 THEN 'medieval' WHEN a < 1800 THEN 'early_modern' WHEN a < 1900 THEN 'nineteenth_century' WHEN a < 2000 THEN 'twentieth_century' ELSE 'twenty_first_century' END AS object FROM l")
def rule_lived_in(spark, sf_dir):
    return rule_named("lived_in").plan(lives(spark, sf_dir)).select("subject", "object")


@query_of(f"WITH {LIVES}, y AS (SELECT k, a * s AS y FROM l) SELECT 'c' || p.k AS subject, 'c' || q.k AS object FROM y p JOIN y q ON q.y - p.y BETWEEN 0 AND 50 AND p.k <> q.k AND (q.y > p.y OR q.k > p.k)")
def rule_contemporary(spark, sf_dir):
    return rule_named("contemporary").plan(lives(spark, sf_dir)).select("subject", "object")


@query_of(f"WITH {LIVES} SELECT 'c' || k AS subject FROM l WHERE s < 0 AND a BETWEEN 301 AND 500")
def born_between(spark, sf_dir):
    return query.born_between(lives(spark, sf_dir).facts, 301, 500, bc=True).select("subject")


@query_of("SELECT 'supplier#' || l_suppkey AS subject FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 2")
def rule_at_least(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    f = complete(l.select(key.alias("triple_id"), F.concat(F.lit("supplier#"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("CONQUERED").alias("relation"), F.col("l_partkey").cast("string").alias("object")))
    return rule_named("multi_conqueror").plan(Graph(f)).select("subject")


@query_of("SELECT DISTINCT CAST(u AS VARCHAR) AS subject FROM (SELECT (p_partkey - 1) // 2 AS u FROM part WHERE (p_partkey - 1) // 2 > 0) WHERE u NOT IN (SELECT p_partkey FROM part WHERE (p_partkey - 1) // 2 > 0)")
def rule_progenitor(spark, sf_dir):
    k = F.col("p_partkey")
    f = complete(tree(spark, sf_dir).select(F.col("a").alias("triple_id"), F.col("a").cast("string").alias("subject"), F.lit("CHILD_OF").alias("relation"), F.col("b").cast("string").alias("object")))
    return rule_named("family_progenitor").plan(Graph(f)).select("subject")


DESCENT = """WITH RECURSIVE t AS (SELECT p_partkey AS a, (p_partkey - 1) // 2 AS b FROM part WHERE (p_partkey - 1) // 2 > 0),
two AS (SELECT x.a, y.b FROM t x JOIN t y ON x.b = y.a), d AS (SELECT a, b FROM two UNION SELECT x.a, d.b FROM d JOIN t x ON x.b = d.a)"""


@query_of(DESCENT + " SELECT CAST(a AS VARCHAR) AS subject, r AS relation, CAST(b AS VARCHAR) AS object FROM (SELECT a, 'INTELLECTUAL_DESCENDANT_OF' AS r, b FROM d UNION SELECT a, 'INFLUENCED_BY', b FROM d UNION SELECT a, 'INFLUENCED_BY', b FROM t)")
def rules_of_descent(spark, sf_dir):
    e = tree(spark, sf_dir)
    f = complete(e.select(F.col("a").alias("triple_id"), F.col("a").cast("string").alias("subject"), F.lit("TUTORED_BY").alias("relation"), F.col("b").cast("string").alias("object")))
    closed, _, _ = rules.fixpoint(Graph(f))
    return three(closed.facts.where("relation IN ('INTELLECTUAL_DESCENDANT_OF', 'INFLUENCED_BY')"))


# More programs


@query_of("SELECT p_partkey, (100 + CASE p_size % 2 WHEN 0 THEN p_size ELSE -1 END)::DOUBLE AS value FROM part")
def program_shared_stack(spark, sf_dir):
    """The chosen program works on what lies below the selector; steps have addresses with gaps."""
    programs = {
        "main": [("LOAD", "p_size", 10), ("PUSH", "100", 20), ("JMP", "50", 30), ("PUSH", "7", 40), ("LOAD", "p_size", 50), ("PUSH", "2", 60), ("MOD", "", 70), ("DISPATCH", "0:keep,1:drop", 80), ("ADD", "", 90)],
        "keep": [("DUP", ""), ("POP", "")],
        "drop": [("SWAP", ""), ("POP", ""), ("PUSH", "-1")],
    }
    return run_program(read(spark, sf_dir, "part"), programs, "main", ["p_size"]).select("p_partkey", "value")


@query_of("SELECT p_partkey, p_size::DOUBLE * 0 AS value, coalesce(list_transform(list_reverse(range(1, CAST(p_size AS BIGINT) + 1)), lambda x: x * x)::VARCHAR, '[]') AS emitted FROM part")
def program_emits(spark, sf_dir):
    """A loop that emits squares on its way down."""
    loop = [("LOAD", "n"), ("JZ", "9"), ("LOAD", "n"), ("DUP", ""), ("MUL", ""), ("EMIT", ""), ("POP", ""), ("CALL", "less"), ("JMP", "10"), ("JMP", "15"), ("LOAD", "n"), ("PUSH", "1"), ("SUB", ""), ("STORE", "n"), ("JMP", "0"), ("PUSH", "0")]
    programs = {"main": loop, "less": [("RET", "")]}
    out = run_program(read(spark, sf_dir, "part").withColumn("n", F.col("p_size")), programs, "main", ["n"], emits="e")
    return out.select("p_partkey", "value", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x.cast("long").cast("string")), ", "), F.lit("]")).alias("emitted"))


@query_of("SELECT 'c' || c_custkey AS subject FROM customer WHERE c_acctbal > 5000 AND c_nationkey % 2 = 1")
def score_flags(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    row = lambda r, v, block: c.select((F.col("c_custkey") + block * 10**9).alias("triple_id"), name.alias("subject"), F.lit(r).alias("relation"), v.cast("string").alias("object"))
    policy = spark.createDataFrame([(0, "policy", "LARGE", "5000")], "triple_id long, subject string, relation string, object string")
    facts = complete(row("BALANCE", F.col("c_acctbal"), 1).unionByName(row("NATION", F.col("c_nationkey"), 2)).unionByName(policy))
    code = [("LOAD", "balance"), ("FETCH", "policy|LARGE"), ("GT", ""), ("LOAD", "nation"), ("PUSH", "2"), ("MOD", ""), ("AND", ""), ("RET", "")]
    return program.score_flags(facts, {"score": code}, "score", {"balance": "BALANCE", "nation": "NATION"})
