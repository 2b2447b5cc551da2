"""The record of the engine: a fact with provenance, validity, confidence, scope and place in a sequence."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = "subject string, relation string, object string, source_article string, source_sentence_idx int, valid_from string, valid_to string, confidence double, scope string, seq int"
COLUMNS = [c.split()[0] for c in FACT.split(", ")]
DERIVED = "(derived)"


@dataclass(frozen=True)
class Graph:
    """Facts (with triple_id, the order of arrival), aliases (surface, canonical), authorities (source, score)."""

    facts: DataFrame
    alias: DataFrame | None = None
    authority: DataFrame | None = None
    n_articles: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    def over(self, facts: DataFrame) -> Graph:
        return replace(self, facts=facts)


def complete(df: DataFrame) -> DataFrame:
    """df with all columns of a fact, missing ones at their defaults."""
    defaults = {"confidence": F.lit(1.0), "source_sentence_idx": F.lit(-1)}
    types = dict(c.split() for c in FACT.split(", "))
    return df.select(*([F.col("triple_id").cast("long")] if "triple_id" in df.columns else []), *(
        (F.coalesce(F.col(c), defaults[c]) if c in defaults and c in df.columns else F.col(c) if c in df.columns else defaults.get(c, F.lit(None))).cast(types[c]).alias(c) for c in COLUMNS
    ))


def numbered(df: DataFrame, *order: Column | str, start: int = 0) -> DataFrame:
    """df with triple_id, from start on and with gaps, by the given order; without one, as the rows come.

    The order is a sort over all tasks, each of which numbers its own rows.
    """
    df = df.orderBy(*order) if order else df
    return df.withColumn("triple_id", F.monotonically_increasing_id() + F.lit(start))


def graph(spark: SparkSession, rows: list[tuple] | list[dict], aliases: dict[str, str] | None = None, authorities: dict[str, float] | None = None) -> Graph:
    """A small graph from rows of the first columns of a fact, in order."""
    full = []
    for i, r in enumerate(rows):
        r = r if isinstance(r, dict) else dict(zip(COLUMNS, r))
        values = [r.get(c) for c in COLUMNS]
        values[COLUMNS.index("confidence")] = float(r["confidence"]) if r.get("confidence") is not None else 1.0
        full.append((i, *values))
    facts = spark.createDataFrame(full, "triple_id long, " + FACT)
    alias = spark.createDataFrame(list(aliases.items()), "surface string, canonical string") if aliases else None
    authority = spark.createDataFrame([(k, float(v)) for k, v in authorities.items()], "source string, score double") if authorities else None
    return Graph(facts, alias, authority)


def canonical(df: DataFrame, column: str, alias: DataFrame | None, out: str) -> DataFrame:
    """df with the canonical name of a column, one hop of aliases; a name without one is its own."""
    if alias is None:
        return df.withColumn(out, F.col(column))
    named = alias.select(F.col("surface").alias("_surface"), F.col("canonical").alias("_canonical")).dropDuplicates(["_surface"])
    return df.join(named, F.col(column) == F.col("_surface"), "left").withColumn(out, F.coalesce("_canonical", column)).drop("_surface", "_canonical")
