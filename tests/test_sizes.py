"""What shuffles grow with: exchanges that both sides share, rounds and sides that have nothing new, small tables."""

from pyspark.sql import functions as F

from factloom.operators import conflict, ontology, query, rules
from factloom.plans import storage
from factloom.schema import graph

SHIPPED = [{"subject": "p", "relation": "R", "object": o, "valid_from": a, "valid_to": b, "source_article": "A"} for o, a, b in (("x", "2001-01-01", "2001-01-20"), ("y", "2001-01-05", "2001-01-25"), ("z", "2003-01-01", "2003-01-20"))]


def planned(df) -> str:
    """The plan as it is before it adapts."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_both_sides_of_markers_are_shuffled_once(spark):
    found = ontology.functional_markers(graph(spark, SHIPPED), "R", timed=False)
    assert [r[0] for r in found.select("object").collect()] == ["R:x|y"]
    assert "ReusedExchange" in planned(found.select("subject", "object"))


def test_a_rule_is_not_planned_again_without_new_facts_it_rests_on(spark):
    calls = []

    def plan(g):
        calls.append(1)
        return ontology.functional_markers(g, "R", timed=False)

    closed, _, stats = rules.fixpoint(graph(spark, SHIPPED), [rules.Rule("once", plan, 0, ("R",), rests=("R",), makes=(ontology.FUNCTIONAL,))])
    assert (len(calls), stats["per_stratum"], closed.facts.count()) == (1, {0: [1]}, 4)


def test_pairs_of_two_new_facts_are_made_once(spark):
    g = graph(spark, [("a", "T", "b"), ("b", "T", "c"), ("c", "T", "d")])
    rule, new = rules.transitive("T"), F.col("subject") != "a"
    last = rules.Round(g.facts.where(new), g.facts.where(~new), frozenset({"T"}))
    assert sorted(map(tuple, rule.delta(g, last).select("subject", "object").collect())) == [("a", "c"), ("b", "d")]


def test_few_authorities_go_to_the_members(spark):
    members = graph(spark, SHIPPED, authorities={"A": 0.5}).facts.withColumn("conflict_id", F.lit(1))
    out = conflict.survivors(members, [conflict.latest_wins], graph(spark, SHIPPED, authorities={"A": 0.5}).authority)
    assert "BroadcastHashJoin" in planned(out)
    assert [r[0] for r in out.where("keep").select("object").collect()] == ["z"]


def test_points_meet_few_points_in_vain(spark):
    deal = query.bins(50)
    rows = spark.range(5000).select(F.floor(F.col("id") / 5).alias("y"))
    a, b = rows.select("y", F.explode(deal(F.col("y"), 50)).alias("bin")), rows.select(F.col("y").alias("z"), F.explode(deal(F.col("y"), 0)).alias("bin"))
    met, near = a.join(b, "bin").agg(F.count("*"), F.count_if((F.col("z") - F.col("y")).between(0, 50))).head()
    assert near == 5 * 5 * sum(min(51, 1000 - y) for y in range(1000)) and met < 1.3 * near  # twice with bins of the width


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS", 10)
    pairs = spark.range(200).selectExpr("id div 2 AS k", "id AS x")
    assert storage.parts(pairs) == 20
    assert "hashpartitioning(k" in planned(query.co_occurring(pairs, "k", "x")) and ", 20), REPARTITION_BY_NUM" in planned(query.co_occurring(pairs, "k", "x"))
    assert rules.closure(spark.range(1, 40).selectExpr("id AS a", "id + 1 AS b")).count() == 39 * 40 // 2
