"""Lookups, scopes, chains, paths and counts over a graph's facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.storage import parts, written
from factloom.schema import Graph, canonical


def canonicalize(g: Graph, name: str) -> Column:
    """The canonical name, one hop, as a literal (one row of the alias table is read)."""
    hit = g.alias.where(F.col("surface") == name).select("canonical").head() if g.alias is not None else None
    return F.lit(hit[0] if hit else name)


def out_facts(g: Graph, entity: str, relation: str | None = None) -> DataFrame:
    """Facts whose stored subject is the entity's canonical name, in order of arrival."""
    found = g.facts.where(F.col("subject") == canonicalize(g, entity))
    return (found.where(F.col("relation") == relation) if relation else found).orderBy("triple_id")


def in_facts(g: Graph, entity: str, relation: str | None = None) -> DataFrame:
    found = g.facts.where(F.col("object") == canonicalize(g, entity))
    return (found.where(F.col("relation") == relation) if relation else found).orderBy("triple_id")


def entities(g: Graph) -> DataFrame:
    return g.facts.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()


def neighbours(g: Graph, entity: str) -> DataFrame:
    name = canonicalize(g, entity)
    near = g.facts.where((F.col("subject") == name) | (F.col("object") == name))
    both = F.array(F.when(F.col("subject") == name, F.col("object")), F.when(F.col("object") == name, F.col("subject")))
    return near.select(F.explode(both).alias("entity")).where("entity is not null").distinct()


def entity_card(g: Graph, entity: str, k: int | None = None) -> DataFrame:
    """The entity's facts with their direction."""
    name = canonicalize(g, entity)
    near = g.facts.where((F.col("subject") == name) | (F.col("object") == name))
    card = near.withColumn("direction", F.when(F.col("subject") == name, "out").otherwise("in")).orderBy(F.col("direction").desc(), "triple_id")
    return card.limit(k) if k else card


def in_scope(facts: DataFrame, scope: str | None, ordered: bool = False) -> DataFrame:
    """Facts of a scope and of none; ordered: by place in the sequence, then as they came."""
    found = facts.where(F.col("scope").isNull() | (F.col("scope") == scope)) if scope is not None else facts.where(F.col("scope").isNull())
    return found.orderBy(F.col("seq").asc_nulls_last(), "source_sentence_idx", "triple_id") if ordered else found


def ordered_scope(facts: DataFrame, scope: str) -> DataFrame:
    return in_scope(facts, scope, True).where(F.col("scope") == scope)


def scopes(facts: DataFrame) -> DataFrame:
    return facts.select("scope").where("scope is not null").distinct()


def steps(facts: DataFrame) -> DataFrame:
    """Every fact as two steps: along it and against it."""
    way = F.array(F.struct(F.col("subject").alias("a"), F.col("object").alias("b"), F.lit(True).alias("along")), F.struct(F.col("object").alias("a"), F.col("subject").alias("b"), F.lit(False).alias("along")))
    return facts.select("triple_id", "relation", F.explode(way).alias("w")).select("triple_id", "relation", "w.a", "w.b", "w.along")


def chain_query(g: Graph, start: str | DataFrame, relations: list[str]) -> DataFrame:
    """End of every chain of the relations, each followed both ways; a bag, with the path's facts.

    start: an entity, or a DataFrame with a column ``start`` to follow chains from all of its rows at once.
    """
    at = g.spark.range(1).select(canonicalize(g, start).alias("start")) if isinstance(start, str) else start.select("start")
    at = at.withColumn("end", F.col("start")).withColumn("path", F.array().cast("array<bigint>"))
    every = steps(g.facts.where(F.col("relation").isin(relations)))
    for r in relations:
        hop = every.where(F.col("relation") == r).select("a", "b", "triple_id")
        at = at.join(hop, at["end"] == hop["a"]).select("start", F.col("b").alias("end"), F.array_append("path", F.col("triple_id")).alias("path"))
    return at


def find_paths(g: Graph, start: str, end: str, max_hops: int = 4, max_paths: int | None = 5) -> DataFrame:
    """Shortest undirected paths as arrays of triple_id: breadth first, one predecessor a node, all into the end.

    start = end: one empty path; max_paths None: all. Each hop is one join on the frontier; the loop stops at the first hop that
    arrives.
    """
    spark, names = g.spark, [canonicalize(g, start), canonicalize(g, end)]
    same = spark.range(1).select((names[0] == names[1]).alias("x")).head()[0]
    if same:
        return spark.range(1).select(F.array().cast("array<bigint>").alias("path"))
    every = written(steps(g.facts))
    # a node's place in its layer is its predecessors' places and the step to it, compared from the start
    step = "array<struct<back:boolean,id:bigint>>"
    front = spark.range(1).select(names[0].alias("node"), F.array().cast("array<bigint>").alias("path"), F.array().cast(step).alias("place"))
    visited = front.select("node")
    for _ in range(max_hops):
        hop = front.join(every, front["node"] == every["a"]).select("b", F.array_append("path", F.col("triple_id")).alias("path"), F.array_append("place", F.struct((~F.col("along")).alias("back"), F.col("triple_id").alias("id"))).alias("place"))
        hop = hop.join(visited, hop["b"] == visited["node"], "left_anti")
        hop = written(hop)
        found = hop.where(F.col("b") == names[1])
        if found.take(1):
            return found.orderBy("place").limit(max_paths).select("path") if max_paths else found.select("path")
        first = hop.groupBy("b").agg(F.min_by("path", "place").alias("path"), F.min("place").alias("place"))
        if not first.take(1):
            break
        front = written(first.select(F.col("b").alias("node"), "path", "place"))
        visited = visited.union(front.select("node"))
    return spark.createDataFrame([], "path array<bigint>")


def relation_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("relation").agg(F.count("*").alias("n"))


def degrees(facts: DataFrame) -> DataFrame:
    """How often an entity shows, as subject and as object."""
    role = F.array(F.struct(F.col("subject").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("entity"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return facts.select(F.explode(role).alias("r")).groupBy(F.col("r.entity").alias("entity")).agg(F.count("*").alias("n"), F.sum("r.o").alias("n_out"), F.sum("r.i").alias("n_in"))


def top_objects(facts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent objects of each relation; ties by first arrival."""
    counted = facts.groupBy("relation", "object").agg(F.count("*").alias("n"), F.min("triple_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select("relation", "object", "n", "rank")


def shared_objects(facts: DataFrame, relation: str) -> DataFrame:
    """Pairs of different subjects (a < b) with an object of the relation in common."""
    x = facts.where(F.col("relation") == relation).select("subject", "object").distinct()
    a, b = x.withColumnRenamed("subject", "a"), x.withColumnRenamed("subject", "b")
    return a.join(b, "object").where("a < b").select("a", "b", "object")


def missing(facts: DataFrame, having: str, lacking: str) -> DataFrame:
    """Subjects of one relation that are subject of no fact of another."""
    has = facts.where(F.col("relation") == having).select("subject").distinct()
    return has.join(facts.where(F.col("relation") == lacking).select("subject"), "subject", "left_anti")


def bins(width: int) -> Callable[[Column, int], Column]:
    """The bins from a place to one some way on, of at most a fifth of the width or of one."""
    wide = max(1, width // 5)
    return lambda at, on: F.sequence(F.floor(at / wide), F.floor((at + on) / wide))


def band_pairs(points: DataFrame, width: int) -> DataFrame:
    """points (key, id, at long): pairs of a key at most width apart, earlier first (ties: smaller id first).

    Points are dealt to bins and looked for in the bins that the width reaches: an equi-join, never a comparison of all
    pairs. Bins are a small part of the width, so that a point meets nearly all of a bin: few comparisons are in vain,
    and the later points come in runs that repeat, which files of pairs (there are many) hold in little room.
    """
    deal = bins(width)
    a = points.select("key", F.col("id").alias("a"), F.col("at").alias("at_a"), F.explode(deal(F.col("at"), width)).alias("bin"))
    b = points.select("key", F.col("id").alias("b"), F.col("at").alias("at_b"), F.explode(deal(F.col("at"), 0)).alias("bin"))
    near = (F.col("at_b") - F.col("at_a")).between(0, width) & ((F.col("at_b") > F.col("at_a")) | (F.col("b") > F.col("a")))
    return a.join(b, ["key", "bin"]).where(near).select("key", "a", "b", (F.col("at_b") - F.col("at_a")).alias("gap"))


def first_fact(facts: DataFrame, relation: str) -> DataFrame:
    """Each subject's first object of a relation."""
    return facts.where(F.col("relation") == relation).groupBy("subject").agg(F.min_by("object", "triple_id").alias("object"))


def named(g: Graph, column: str, out: str) -> DataFrame:
    return canonical(g.facts, column, g.alias, out)


def of_relation(facts: DataFrame, relation: str) -> DataFrame:
    return facts.where(F.col("relation") == relation).orderBy("triple_id")


def has(g: Graph, entity: str, relation: str) -> bool:
    """Whether the entity, by its canonical name, is the subject of a fact of the relation."""
    return bool(g.facts.where((F.col("subject") == canonicalize(g, entity)) & (F.col("relation") == relation)).take(1))


def scoped_values(facts: DataFrame, scope: str, relation: str) -> DataFrame:
    """subject, object of a scope's own facts of a relation, without global ones."""
    return facts.where((F.col("scope") == scope) & (F.col("relation") == relation)).select("subject", "object")


def born_between(facts: DataFrame, low: int, high: int, bc: bool = False, relation: str = "BORN_DATE", k: int | None = None) -> DataFrame:
    """subject, object of births in years low to high, both included; the k first subjects as they came, if k is given.

    BC: years of `N BC` as they are counted there; else the digits that a date begins with.
    """
    pattern = r"^(\d+)\s*BC" if bc else r"^(\d+)"
    year = F.regexp_extract("object", pattern, 1)
    hit = facts.where(F.col("relation") == relation).where(F.when(year != "", year.cast("long")).between(low, high))
    first = hit.groupBy("subject").agg(F.min_by("object", "triple_id").alias("object"), F.min("triple_id").alias("_at"))
    return (first.orderBy("_at").limit(k) if k else first).drop("_at")


def first_distinct(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k first values of a column in order."""
    return df.select(column).distinct().orderBy(column).limit(k)


def least_sure(facts: DataFrame, k: int = 6) -> DataFrame:
    return facts.orderBy("confidence", "triple_id").limit(k)


def overlap(facts: DataFrame, relation: str, one: str, other: str) -> DataFrame:
    """subject, side: of two classes of a relation, who is in both, or in one only."""
    f = facts.where((F.col("relation") == relation) & F.col("object").isin(one, other)).groupBy("subject").agg(F.collect_set("object").alias("c"))
    return f.select("subject", F.when(F.size("c") == 2, "both").otherwise(F.element_at("c", 1)).alias("side"))


def co_occurring(pairs: DataFrame, group: str, item: str) -> DataFrame:
    """low, high, n: items that share a group, and how many groups they share."""
    t = pairs.select(F.col(group).alias("k"), F.col(item).alias("x")).repartition(parts(pairs), "k").distinct()  # dealt once, for this and the join
    return t.withColumnRenamed("x", "low").join(t.withColumnRenamed("x", "high"), "k").where("low < high").groupBy("low", "high").agg(F.count("*").alias("n"))
