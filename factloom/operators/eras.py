"""Facts by era: what holds in one, what comes and goes, what turns around, how far apart vocabularies are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.temporal import YEAR, date_ord

FAR = 10**9


def facts_in_eras(facts: DataFrame, eras: DataFrame) -> DataFrame:
    """facts with ``era`` for each era (name, from_year, to_year) that their interval meets; ends without a date are open.

    Eras are a stated list, a few rows, so the comparison is with each of them.
    """
    rows = eras.select("name", "from_year", "to_year").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} eras")
    dated = facts.withColumn("_low", F.coalesce(date_ord(F.col("valid_from")), F.lit(-FAR))).withColumn("_high", F.coalesce(date_ord(F.col("valid_to")), F.lit(FAR)))
    hits = [F.when((F.col("_high") >= r[1] * YEAR) & (F.col("_low") <= r[2] * YEAR), F.lit(r[0])) for r in rows]
    return dated.withColumn("era", F.explode(F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"))).drop("_low", "_high")


#: Eras that a list may have.
MOST = 1_000


def projections(facts: DataFrame, eras: DataFrame, subject: str, relations: tuple[str, ...] = ("IS_A", "HAS_PROPERTY", "REJECTS_PROPERTY", "EXPLAINED_BY")) -> DataFrame:
    """era, n_facts, a sorted array of objects for each relation (named in lower case), and the vocabulary of relations.

    n_facts counts all facts of the era, the rest is about the subject; eras without a fact are there, too.
    """
    held = facts_in_eras(facts, eras)
    mine = F.col("subject") == subject
    sets = [F.array_sort(F.collect_set(F.when(mine & (F.col("relation") == r), F.col("object")))).alias(r.lower()) for r in relations]
    by = held.groupBy("era").agg(F.count("*").alias("n_facts"), *sets, F.array_sort(F.collect_set(F.when(mine, F.col("relation")))).alias("vocabulary"))
    none = F.array().cast("array<string>")
    out = eras.select(F.col("name").alias("era"), "from_year").join(by, "era", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0).cast("long")))
    return out.select("era", "from_year", "n_facts", *(F.coalesce(c, none).alias(c) for c in (*(r.lower() for r in relations), "vocabulary")))


def drift(projected: DataFrame, column: str = "is_a") -> DataFrame:
    """era, appeared, retired: what a set gained and lost since the era before (by from_year)."""
    before = F.coalesce(F.lag(column).over(Window.partitionBy(F.lit(1)).orderBy("from_year", "era")), F.array().cast("array<string>"))  # as many rows as eras
    return projected.withColumn("_before", before).select("era", F.array_except(column, "_before").alias("appeared"), F.array_except("_before", column).alias("retired"))


def reversals(projected: DataFrame, affirmed: str = "has_property", rejected: str = "rejects_property") -> DataFrame:
    """value, affirmed, rejected: values of both sets in some era, with the eras of each in order."""
    of = lambda c, name: projected.select(F.explode(c).alias("value"), F.struct("from_year", "era").alias("e")).groupBy("value").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["era"]).alias(name))
    return of(affirmed, "affirmed").join(of(rejected, "rejected"), "value")


def jaccard(pairs: DataFrame, era: str, item: str) -> DataFrame:
    """a, b, distance: of the sets of items of each two eras (a before b) with any.

    Shared items are counted by a join on the item, not by comparing sets.
    """
    v = pairs.select(F.col(era).alias("era"), F.col(item).alias("x")).distinct()
    n = v.groupBy("era").agg(F.count("*").alias("n"))
    k = v.withColumnRenamed("era", "a").join(v.withColumnRenamed("era", "b"), "x").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    both = n.select(F.col("era").alias("a"), F.col("n").alias("na")).join(n.select(F.col("era").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    shared = F.coalesce("k", F.lit(0))
    return both.join(k, ["a", "b"], "left").select("a", "b", (1 - shared / (F.col("na") + F.col("nb") - shared)).alias("distance"))


def mean_distance(pairs: DataFrame, era: str, item: str) -> DataFrame:
    return jaccard(pairs, era, item).agg(F.avg("distance").alias("distance"), F.count("*").alias("n"))


def positions(facts: DataFrame) -> DataFrame:
    """relation, n_positions, n_scopes: how many different objects the scopes hold of each relation."""
    f = facts.where(F.col("scope").isNotNull())
    return f.groupBy("relation").agg(F.count_distinct("object").alias("n_positions"), F.count_distinct("scope").alias("n_scopes"))
