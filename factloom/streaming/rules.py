"""Stateless rules over a stream of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_relabel(facts: DataFrame, relation: str, out: str, swap: bool = False) -> DataFrame:
    """Facts of a relation under another, row by row; fit for batch and stream."""
    s, o = ("object", "subject") if swap else ("subject", "object")
    return facts.where(F.col("relation") == relation).select(F.col(s).alias("subject"), F.lit(out).alias("relation"), F.col(o).alias("object"), *[c for c in facts.columns if c not in ("subject", "relation", "object")])


def stream_distinct(facts: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first of each fact within the delay; older state goes."""
    return facts.withWatermark(time, delay).dropDuplicatesWithinWatermark(["subject", "relation", "object"])
