"""Who reaches whom: frontier searches, layers, program calls and black boxes, orders of steps, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.query import canonicalize, steps
from factloom.plans.storage import written
from factloom.schema import Graph


def layers(edges: DataFrame, starts: DataFrame, max_hops: int = 64) -> DataFrame:
    """start, node, hop: every node reached from each start (itself at hop 0) and in how many hops at least.

    edges (a, b); starts (start). A hop is one join of the newest layer, which is written on its own.
    """
    edges = written(edges.select("a", "b").distinct())
    at = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")).distinct())
    seen = at
    for hop in range(1, max_hops + 1):
        new = at.join(edges, at["node"] == edges["a"]).select("start", F.col("b").alias("node")).distinct()
        at = written(new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if not at.take(1):
            return seen
        seen = seen.union(at)
    return seen


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: what each start leads to; the start itself only if it lies on a cycle."""
    first = starts.join(edges, F.col("start") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
    # layers from the second nodes on, so that a way back to the start shows
    ways = layers(edges, first.select(F.col("node").alias("start")).distinct()).select(F.col("start").alias("via"), F.col("node").alias("to"))
    return first.join(ways, first["node"] == ways["via"]).select("start", F.col("to").alias("node")).distinct()


def edges_of(facts: DataFrame, relation: str) -> DataFrame:
    return facts.where(F.col("relation") == relation).select(F.col("subject").alias("a"), F.col("object").alias("b"))


def layer_sizes(g: Graph, seed: str, hops: int = 3) -> DataFrame:
    """hop, n: how many entities are first met at each hop from the seed, facts taken both ways."""
    start = g.spark.range(1).select(canonicalize(g, seed).alias("start"))
    return layers(steps(g.facts).select("a", "b"), start, hops).groupBy("hop").agg(F.count("*").alias("n"))


def calls(facts: DataFrame, opcode: str = "CALL") -> DataFrame:
    """a, b: which program names which by an opcode."""
    return facts.where((F.col("relation") == opcode) & F.col("seq").isNotNull() & (F.col("object") != "")).select(F.col("scope").alias("a"), F.col("object").alias("b")).distinct()


def architecture(facts: DataFrame) -> DataFrame:
    """Stored programs as facts of whom they call and which black boxes they hold: subject, relation, object."""
    shape = lambda df, r: df.select(F.col("a").alias("subject"), F.lit(r).alias("relation"), F.col("b").alias("object"))
    return shape(calls(facts), "CALLS").unionByName(shape(calls(facts, "OPAQUE"), "OPAQUE_DEP"))


def within(edges: DataFrame, entry: str) -> DataFrame:
    """node: the entry and all that it reaches."""
    return layers(edges, edges.sparkSession.createDataFrame([(entry,)], "start string")).select("node").distinct()


def transitive_opaque(facts: DataFrame, entry: str) -> DataFrame:
    """label: the black boxes that a program holds or calls, however deep (calls of CALL only)."""
    return boundary(calls(facts), calls(facts, "OPAQUE"), entry).withColumnRenamed("b", "label")


def boundary(edges: DataFrame, held: DataFrame, entry: str) -> DataFrame:
    """b: what the entry and all that it reaches hold; held (a, b)."""
    return held.join(within(edges, entry), F.col("a") == F.col("node"), "left_semi").select("b").distinct()


def blast_radius(edges: DataFrame, held: DataFrame, box: str) -> DataFrame:
    """node: the holders of a box and all that lead to one."""
    holders = held.where(F.col("b") == box).select(F.col("a").alias("start")).distinct()
    return layers(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), holders).select("node").distinct()


def effects(facts: DataFrame, edges: DataFrame, entry: str, relations: tuple[str, ...] = ("WRITES_TO", "EMITS_EVENT")) -> DataFrame:
    """node: what the entry reaches, itself included, that has an effect outside."""
    acting = facts.where(F.col("relation").isin(*relations)).select(F.col("subject").alias("node")).distinct()
    return within(edges, entry).join(acting, "node", "left_semi")


def exposed(facts: DataFrame, having: str = "HANDLES_PII", to: str = "OPAQUE_DEP") -> DataFrame:
    """subject, object: facts of ``to`` whose subject has a fact of ``having``."""
    mine = facts.where(F.col("relation") == having).select("subject").distinct()
    return facts.where(F.col("relation") == to).join(mine, "subject", "left_semi").select("subject", "object").distinct()


def precedes(facts: DataFrame, scope: str | None = None, relation: str = "STEP") -> DataFrame:
    """scope, a, b: each step and the one after it."""
    s = facts.where((F.col("relation") == relation) & F.col("seq").isNotNull())
    s = s.where(F.col("scope") == scope) if scope is not None else s
    after = F.lead("object").over(Window.partitionBy("scope").orderBy("seq", "triple_id"))
    return s.select("scope", F.col("object").alias("a"), after.alias("b")).where("b is not null")


def dropped_steps(facts: DataFrame, whole: str, short: str, relation: str = "STEP") -> DataFrame:
    """object, seq: steps of one procedure that another has not."""
    of = lambda scope: facts.where((F.col("relation") == relation) & (F.col("scope") == scope))
    return of(whole).join(of(short).select("object"), "object", "left_anti").select("object", "seq")


def group_pairs(facts: DataFrame, relation: str, out: str = "COLLEAGUE_OF") -> DataFrame:
    """subject, relation, object: all ordered pairs of different subjects with one object (its output is that large)."""
    x = facts.where(F.col("relation") == relation).select("subject", "object").distinct()
    other = x.withColumnRenamed("subject", "with")
    return x.join(other, "object").where(F.col("subject") != F.col("with")).select("subject", F.lit(out).alias("relation"), F.col("with").alias("object")).distinct()


def rings(facts: DataFrame, relation: str) -> DataFrame:
    """entity: both ends of every fact of the relation, which are all that its closure links."""
    return facts.where(F.col("relation") == relation).select(F.explode(F.array("subject", "object")).alias("entity")).distinct()


def flagged_or_in_ring(flagged: DataFrame, facts: DataFrame, holder: str, relation: str) -> DataFrame:
    """subject: those flagged, and those whose ``holder`` is a member of a ring."""
    held = facts.where(F.col("relation") == holder).join(rings(facts, relation), F.col("object") == F.col("entity"), "left_semi").select("subject")
    return flagged.select("subject").union(held).distinct()


def reachable_in_class(facts: DataFrame, seed: str, over: str, relation: str, value: str) -> DataFrame:
    """node: what the seed reaches over a relation and that is of a class."""
    edges, seeds = edges_of(facts, over), facts.sparkSession.createDataFrame([(seed,)], "start string")
    of = facts.where((F.col("relation") == relation) & (F.col("object") == value)).select(F.col("subject").alias("node"))
    return reach(edges, seeds).join(of, "node", "left_semi").select("node").distinct()


def teachers_of_many(facts: DataFrame, teaching: str = "TUTORED_BY", shaped: str = "INFLUENCED_BY", marked: str = "MULTI_CONQUEROR") -> DataFrame:
    """subject, teachers, influences of everyone of the marked class: sorted arrays."""
    many = facts.where((F.col("relation") == "IS_A") & (F.col("object") == marked)).select("subject").distinct()
    of = lambda r, name: facts.where(F.col("relation") == r).groupBy("subject").agg(F.array_sort(F.collect_set("object")).alias(name))
    none = F.array().cast("array<string>")
    return many.join(of(teaching, "teachers"), "subject").join(of(shaped, "influences"), "subject", "left").withColumn("influences", F.coalesce("influences", none))


def same_place(facts: DataFrame, one: str = "BORN_IN", other: str = "DIED_IN") -> DataFrame:
    """subject, object: objects that a subject has by both relations."""
    a, b = (facts.where(F.col("relation") == r).select("subject", "object") for r in (one, other))
    return a.join(b, ["subject", "object"], "left_semi").distinct()


def two_hops(facts: DataFrame, relation: str) -> DataFrame:
    """subject, middle, object: every fact and what follows on it."""
    f = facts.where(F.col("relation") == relation)
    a, b = f.select("subject", F.col("object").alias("middle")), f.select(F.col("subject").alias("middle"), "object")
    return a.join(b, "middle").select("subject", "middle", "object")


def without_direct(closure: DataFrame, direct: DataFrame) -> DataFrame:
    """a, b of a closure that are not linked directly."""
    return closure.select("a", "b").join(direct.select("a", "b"), ["a", "b"], "left_anti")


def path_text(triples: Column) -> Column:
    """`A --R--> B <--S-- C` of an array of facts (subject, relation, object), each arrow as its fact is stated."""
    start = F.struct(triples[0]["subject"].alias("at"), triples[0]["subject"].alias("text"))

    def walk(acc: Column, t: Column) -> Column:
        along = acc["at"] == t["subject"]
        to = F.when(along, t["object"]).otherwise(t["subject"])
        arrow = F.when(along, F.concat(F.lit(" --"), t["relation"], F.lit("--> "))).otherwise(F.concat(F.lit(" <--"), t["relation"], F.lit("-- ")))
        return F.struct(to.alias("at"), F.concat(acc["text"], arrow, to).alias("text"))

    return F.when(F.size(triples) == 0, "(empty path)").otherwise(F.aggregate(triples, start, walk)["text"])


def format_paths(g: Graph, paths: DataFrame) -> DataFrame:
    """paths (path array<bigint>) with ``text``."""
    marked = paths.withColumn("_p", F.xxhash64("path"))
    told = marked.select("_p", F.posexplode("path").alias("n", "triple_id")).join(g.facts.select("triple_id", "subject", "relation", "object"), "triple_id")
    rows = told.groupBy("_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "subject", "relation", "object"))), lambda x: F.struct(x["subject"].alias("subject"), x["relation"].alias("relation"), x["object"].alias("object"))).alias("_t"))
    none = F.array().cast("array<struct<subject:string,relation:string,object:string>>")
    return marked.join(rows, "_p", "left").withColumn("text", path_text(F.coalesce("_t", none))).drop("_p", "_t")
