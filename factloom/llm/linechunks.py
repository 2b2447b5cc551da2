"""Removal of repeated multi-line chunks, with DataFrame functions only.

A text's lines are cut after a line where a hash rolling over it and the line before is divisible by the mean
chunk length, so that boundaries follow the content and survive shifts. Chunks of two lines or more that show
again, anywhere, are removed but for their first place; hashes find candidates, the chunks' own bytes decide.
Repeats without a boundary on either side stay; `dedupe_runs` finds those too, by every pair of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import documents, text_of, written

MEAN, LEAST = 4, 2


def number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column, mean: int = MEAN) -> Column:
    """array<struct<no, lines, body>> of a text that is not null."""
    lines = F.split(text, "\n", -1)

    def cut(lines: Column) -> Column:
        hashes = F.transform(lines, number)

        def ends(h: Column) -> Column:
            last = F.size(h) - 1
            rolled = F.transform(h, lambda x, i: (F.when(i > 0, F.get(h, i - 1)).otherwise(0) * 31 + x) % mean)
            return F.filter(F.transform(rolled, lambda x, i: F.when((x == 0) | (i == last), i)), lambda i: i.isNotNull())

        def bodies(e: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.when(i > 0, F.get(e, i - 1) + 1).otherwise(0)
                return F.struct(i.cast("int").alias("no"), (x - start + 1).cast("int").alias("lines"), F.array_join(F.slice(lines, start + 1, x - start + 1), "\n").alias("body"))

            return F.transform(e, one)

        return let(let(hashes, ends), bodies)

    return let(lines, cut)


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyed(docs: DataFrame) -> DataFrame:
    """The input row as one struct, so that no name of its clashes, with its text, its place in order and its key."""
    same = F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_of())
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        text_of().alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"),
        F.unhex(F.md5(same.cast("binary"))).alias("k"),
    )


def has(numbers: str, no: Column) -> Column:
    return F.array_contains(F.coalesce(F.col(numbers), F.array().cast("array<int>")), no)


def dedupe_lines(docs: DataFrame, mean: int = MEAN, least: int = LEAST) -> DataFrame:
    """docs with n_lines, n_chunks, n_removed_chunks, n_removed_lines and kept_text; other columns stay.

    The first place of a chunk is its smallest (doc_id, number in the document); null ids come last. Null text is
    empty (one line, one chunk, kept as it is). A chunk that repeats within one document is removed there too.
    Rows that are the same in doc_id and text are one document, and each keeps what that keeps. Input columns of the
    added names are replaced; all other names are left alone. An empty table gives no rows.

    No join is on a chunk: a chunk's first place is a minimum, found with partial sums on each side, and goes to the
    row that holds it; a row's chunks that are first nowhere are repeats. So no task holds a common chunk's rows.
    """
    added = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "kept_text")
    rows = keyed(docs)
    cut = rows.select("d", "k", F.explode(chunks(F.col("text"), mean)).alias("c")).where(F.col("c.lines") >= least)
    place = F.struct("d", F.col("c.no").alias("no"), "k")
    firsts = cut.groupBy(F.unhex(F.md5(F.col("c.body").cast("binary"))).alias("h")).agg(F.min(place).alias("f"), F.count("*").alias("n"))
    # a row's chunks that are the first of their hash, and those of them that have others
    candidates = written(firsts.groupBy("f.k").agg(F.collect_set("f.no").alias("first"), F.collect_set(F.when(F.col("n") > 1, F.col("f.no"))).alias("lead")))
    # Texts are dealt by row once, without other columns: candidates' bytes and the final texts read the same exchange.
    dealt = rows.select("k", "d", "text").dropDuplicates(["k"]).join(candidates, "k", "left")
    again = lambda c: (c["lines"] >= least) & (~has("first", c["no"]) | has("lead", c["no"]))
    # only candidate chunks carry their bytes
    bodies = dealt.select("d", "k", F.explode(F.filter(chunks(F.col("text"), mean), again)).alias("c"))
    place = F.struct("d", F.col("c.no").alias("no"), "k")
    keep = bodies.groupBy("c.body").agg(F.min(place).alias("f")).groupBy("f.k").agg(F.collect_set("f.no").alias("keep"))
    parts = dealt.join(keep, "k", "left").withColumn("c", chunks(F.col("text"), mean))
    gone = lambda c: again(c) & ~has("keep", c["no"])
    add = lambda a, c: a + c["lines"]
    zero = F.lit(0).cast("int")
    done = parts.withColumn("gone", F.filter("c", gone)).select(
        "k",
        F.struct(
            F.aggregate("c", zero, add).cast("long").alias("n_lines"),
            F.size("c").cast("long").alias("n_chunks"),
            F.size("gone").cast("long").alias("n_removed_chunks"),
            F.aggregate("gone", zero, add).cast("long").alias("n_removed_lines"),
            F.array_join(F.transform(F.filter("c", lambda c: ~gone(c)), lambda c: c["body"]), "\n").alias("kept_text"),
        ).alias("new"),
    )
    names = [c for c in docs.columns if c not in added]
    out = F.struct(*(F.col("row")[c].alias(c) for c in names), *(F.col("new")[c].alias(c) for c in added))
    return rows.select("row", "k").join(done, "k").select(out.alias("out")).select("out.*")


def dedupe_runs(docs: DataFrame) -> DataFrame:
    """docs with n_lines, n_removed_lines and kept_text; other columns stay.

    Each line of a run of two lines or more that shows at an earlier place goes, wherever the run begins: every pair
    of neighbouring lines is looked up, so that nothing depends on boundaries. Pairs are equal if their SHA-256 is.
    Places are ordered by doc_id (null ids last), then row, then line, so that of each line one place stays. Two lines
    of white space are no repeat. Rows that are the same in doc_id and text are one document, and each keeps what
    that keeps. Null text is one empty line. Input columns of the added names are replaced. An empty table gives no
    rows. As in `dedupe_lines`, no join is on a pair: first places go to the rows that hold them.
    """
    added = ("n_lines", "n_removed_lines", "kept_text")
    rows = keyed(docs).withColumn("lines", F.split("text", "\n", -1)).drop("text")

    def pairs(lines: Column, use) -> Column:
        """use(number, both lines) of each pair that is not of white space only."""

        def one(line: Column, i: Column) -> Column:
            both = F.concat_ws("\n", line, F.get(lines, i + 1))
            return F.when((i + 1 < F.size(lines)) & both.rlike(r"\S"), use(i, both))

        return F.filter(F.transform(lines, one), lambda x: x.isNotNull())

    sha = lambda i, both: F.struct(i.alias("i"), F.unhex(F.sha2(both.cast("binary"), 256)).alias("h"))
    places = rows.select("d", "k", F.explode(pairs(F.col("lines"), sha)).alias("p"))
    first = places.groupBy("p.h").agg(F.min(F.struct("d", "k", "p.i")).alias("f")).groupBy("f.k").agg(F.collect_set("f.i").alias("first"))
    parts = rows.join(first, "k", "left").withColumn("gone", F.array_except(pairs(F.col("lines"), lambda i, both: i), F.coalesce("first", F.array().cast("array<int>"))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.concat("gone", F.transform("gone", lambda i: i + 1)))
    names = [c for c in docs.columns if c not in added]
    out = F.struct(
        *(F.col("row")[c].alias(c) for c in names),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_removed_lines"),
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n").alias("kept_text"),
    )
    return parts.withColumn("left", left).select(out.alias("out")).select("out.*")


def op6_line_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedupe_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


def chunk_sql(source: str) -> str:
    """CTEs of DuckDB, ending in cut(doc_id, no, lines, body, gone): every chunk of the table `source`."""
    return f"""
l0 AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {source}
), l1 AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l0
), l2 AS (
  SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + h) % {MEAN} = 0 AS stop FROM l1
), l3 AS (
  SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM l2
), c0 AS (
  SELECT doc_id, no, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM l3 GROUP BY doc_id, no
), cut AS (
  SELECT *, lines >= {LEAST} AND row_number() OVER (PARTITION BY body ORDER BY lines < {LEAST}, doc_id, no) > 1 AS gone FROM c0
)"""


SQL = f"""
WITH {chunk_sql('documents')}
SELECT doc_id, CAST(sum(lines) AS BIGINT) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
       CAST(coalesce(sum(lines) FILTER (gone), 0) AS BIGINT) AS n_removed_lines,
       md5(coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_md5
FROM cut GROUP BY doc_id
"""
