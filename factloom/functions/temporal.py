"""Dates as ordinals, and Allen's relations between closed intervals, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinals order dates; a year strides over more than any day within one.
YEAR, MONTH = 384, 32
RELATIONS = ["equal", "before", "after", "meets", "met_by", "starts", "started_by", "during", "contains", "finishes", "finished_by", "overlaps", "overlapped_by"]
INVERSE = {"equal": "equal", "before": "after", "after": "before", "meets": "met_by", "met_by": "meets", "starts": "started_by", "started_by": "starts", "during": "contains", "contains": "during", "finishes": "finished_by", "finished_by": "finishes", "overlaps": "overlapped_by", "overlapped_by": "overlaps"}


def date_ord(text: Column) -> Column:
    """The ordinal of YYYY-MM-DD, YYYY-MM, a year of 1 to 4 digits, `N BC` or `N AD`; null for anything else."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, r"^(\d{1,4})(?:-(\d{2}))?(?:-(\d{2}))?", i)
    number = lambda c: F.when(c == "", 1).otherwise(c.cast("long"))
    iso = part(1).cast("long") * YEAR + (number(part(2)) - 1) * MONTH + number(part(3)) - 1
    age = F.regexp_extract(t, r"^(\d{1,4})", 1).cast("long") * YEAR
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}(-\d{2})?$") | t.rlike(r"^\d{1,4}$"), iso)
        .when(t.rlike(r"(?i)^\d{1,4}\s*BC$"), -age)
        .when(t.rlike(r"(?i)^\d{1,4}\s*AD$"), age)
    )


def ord_of_date(day: Column) -> Column:
    """The ordinal of a date."""
    return F.year(day).cast("long") * YEAR + (F.month(day) - 1) * MONTH + F.dayofmonth(day) - 1


def is_unbounded(low: Column, high: Column) -> Column:
    """Neither end is a date."""
    return date_ord(low).isNull() & date_ord(high).isNull()


def is_instant(low: Column, high: Column) -> Column:
    return yes(date_ord(low) == date_ord(high))


def is_empty(low: Column, high: Column) -> Column:
    """The start comes after the end, as in the interval of what excludes itself, 1 to 0."""
    return yes(date_ord(low) > date_ord(high))


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def intersects(xf: Column, xt: Column, yf: Column, yt: Column) -> Column:
    """Closed intervals share a point; a null end is open."""
    return F.coalesce(xt >= yf, F.lit(True)) & F.coalesce(yt >= xf, F.lit(True))


def strictly_overlaps(xf: Column, xt: Column, yf: Column, yt: Column) -> Column:
    """They share more than a point."""
    return F.coalesce(F.greatest(xf, yf) < F.least(xt, yt), F.lit(True))


def allen(name: str, xf: Column, xt: Column, yf: Column, yt: Column) -> Column:
    if name not in RELATIONS:
        raise ValueError(f"no such relation: {name}")
    if INVERSE[name] != name and name in ("after", "met_by", "started_by", "contains", "finished_by", "overlapped_by"):
        return allen(INVERSE[name], yf, yt, xf, xt)
    return {
        "equal": lambda: xf.eqNullSafe(yf) & xt.eqNullSafe(yt),
        "before": lambda: yes(xt < yf - 1),
        "meets": lambda: yes((xt == yf - 1) | (xt == yf)),
        "starts": lambda: yes((xf == yf) & (xt < yt)),
        "during": lambda: yes((yf < xf) & (xt < yt)),
        "finishes": lambda: yes((xt == yt) & (xf > yf)),
        "overlaps": lambda: F.when(xf.isNull() | xt.isNull() | yf.isNull() | yt.isNull(), intersects(xf, xt, yf, yt)).otherwise((xf < yf) & (yf <= xt) & (xt < yt)),
    }[name]()


def relation(xf: Column, xt: Column, yf: Column, yt: Column) -> Column:
    """The first of RELATIONS that holds, or null."""
    out = None
    for name in RELATIONS:
        held = allen(name, xf, xt, yf, yt)
        out = F.when(held, name) if out is None else out.when(held, name)
    return out


def valid_at(low: Column, high: Column, point: Column) -> Column:
    """Whether a point lies in a closed interval; a point that is no date lies in none."""
    return point.isNotNull() & F.coalesce(point >= low, F.lit(True)) & F.coalesce(point <= high, F.lit(True))


def intersection(starts: Column, ends: Column) -> tuple[Column, Column, Column]:
    """Of arrays of date strings: the latest start, the earliest end (as written), whether they exclude each other."""
    pair = lambda a: F.transform(a, lambda s: F.struct(date_ord(s).alias("o"), s.alias("s")))
    known = lambda a: F.filter(pair(a), lambda p: p["o"].isNotNull())
    low = F.reduce(known(starts), F.lit(None).cast("struct<o:bigint,s:string>"), lambda a, x: F.when(a.isNull() | (x["o"] > a["o"]), x).otherwise(a))
    high = F.reduce(known(ends), F.lit(None).cast("struct<o:bigint,s:string>"), lambda a, x: F.when(a.isNull() | (x["o"] < a["o"]), x).otherwise(a))
    return low["s"], high["s"], F.coalesce(low["o"] > high["o"], F.lit(False))


def compose(first: str, second: str) -> list[str]:
    """Relations that may hold between x and z, given x-y and y-z; all where the table has no row."""
    if first == "equal":
        return [second]
    if second == "equal":
        return [first]
    if first == second and first in ("before", "after"):
        return [first]
    return list(RELATIONS)
