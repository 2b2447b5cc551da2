"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt by length, longest first; a task cuts its share into buckets of neighbouring lengths. A first pass
over the longest vectors gives each query a score that k of them reach; with it, or the running k-th best score, each
bucket has a local cosine threshold. A threshold above 1 skips the bucket; a low one prunes by length; a high one
prunes by coordinates: first by the feasible ranges of the query's focus coordinates, then by partial products over
more and more of its largest coordinates and what the rest can add at most. Survivors are verified with whole products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import written

K = 10
#: Queries sent to the executors at once (a bound on what is broadcast), vectors in a bucket, vectors of the first pass.
QUERY_BLOCK, BUCKET, SEEDS = 16_384, 1_024, 4_096
#: Focus coordinates with feasible ranges, and shares of the coordinates after which partial products are compared.
FOCUS, PARTS = 4, (0.25, 0.5, 0.75)
#: Local thresholds under this prune by length, others by coordinates.
COORDINATE_FROM = 0.1


def clean(vectors: DataFrame, scale: int) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    out = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T in whole numbers; through doubles where no sum can reach 2^53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


class Pairs(AccumulatorParam):
    """Whole products, and pairs of queries and vectors, as `top_k` counts them: accumulator([0, 0], Pairs())."""

    def zero(self, value):
        return [0, 0]

    def addInPlace(self, a, b):  # noqa: N802
        return [a[0] + b[0], a[1] + b[1]]


class Search:
    """The best k of each query over the buckets it is shown."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, reached: np.ndarray | None = None):
        """reached: for each query, a score that k candidates have or exceed (-inf if none is known)."""
        self.ids, self.v, self.k = ids, vectors, k
        f = vectors.astype(np.float64)
        self.norm = np.sqrt((f * f).sum(1))
        self.unit = f / np.where(self.norm == 0, 1, self.norm)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf) if reached is None else reached.astype(np.float64)
        #: whole products computed, of so many pairs
        self.products = self.pairs = 0

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (ids != self.ids[i]) & (scores >= self.least[i])
        ids, scores = ids[keep], scores[keep]
        if not len(ids):
            return
        order = np.lexsort((ids, -scores))[: self.k]
        merged = sorted(self.best[i] + [(-int(s), int(v)) for s, v in zip(scores[order], ids[order])])[: self.k]
        self.best[i] = merged
        if len(merged) == self.k:
            self.least[i] = max(self.least[i], -merged[-1][0])

    def bucket(self, ids: np.ndarray, c: np.ndarray) -> None:
        self.pairs += len(self.ids) * len(ids)
        f = c.astype(np.float64)
        norm = np.sqrt((f * f).sum(1))
        order = np.argsort(-norm, kind="stable")
        ids, c, f, norm = ids[order], c[order], f[order], norm[order]
        unit = f / np.where(norm == 0, 1, norm)[:, None]
        top = self.norm * norm[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(top > 0, self.least / top, np.where(self.least > 0, np.inf, -np.inf))
        local -= 1e-9 * (1 + np.abs(np.where(np.isfinite(local), local, 0)))
        by_length = np.flatnonzero(local <= COORDINATE_FROM)
        if len(by_length):
            # the shortest vector that any of them can still need: |q||x| >= the k-th best
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.norm[by_length] > 0, self.least[by_length] / self.norm[by_length], -np.inf)
            upto = len(norm) if (need <= 0).any() else max(1, int(np.searchsorted(-norm, -need.min() * (1 - 1e-9), "right")))
            for at in range(0, len(by_length), 256):
                rows = by_length[at : at + 256]
                scores = product(self.v[rows], c[:upto])
                self.products += scores.size
                for i, s in zip(rows, scores):
                    self.add(i, ids[:upto], s)
        columns = np.ascontiguousarray(unit.T)
        for i in np.flatnonzero((local > COORDINATE_FROM) & (local <= 1)):
            some = self.feasible(i, local[i], columns)
            if len(some):
                self.products += len(some)
                self.add(i, ids[some], product(self.v[i : i + 1], c[some])[0])

    def feasible(self, i: int, t: float, columns: np.ndarray) -> np.ndarray:
        """The vectors of a bucket (unit vectors in columns) whose cosine with query i can reach t."""
        unit, focus = self.unit[i], self.focus[i]
        alive = np.ones(columns.shape[1], bool)
        for j in focus[:FOCUS]:
            q = unit[j]
            slack = math.sqrt(max(0.0, (1 - t * t) * (1 - q * q))) + 1e-9
            # cos >= t holds a coordinate to q t +- slack, or beyond q's own side if q is past t
            low = q * t - slack if q > -t else -1.0
            high = q * t + slack if q < t else 1.0
            alive &= (columns[j] >= low) & (columns[j] <= high)
        some, done = np.flatnonzero(alive), 0
        partial, square = np.zeros(len(some)), np.zeros(len(some))
        for part in PARTS:
            upto = int(part * len(focus))
            if upto <= done or not len(some):
                continue
            js = focus[done:upto]
            block = columns[js] if len(some) == columns.shape[1] else columns[js[:, None], some]
            partial += unit[js] @ block
            square += (block * block).sum(0)
            rest = math.sqrt(max(0.0, 1 - (unit[focus[:upto]] ** 2).sum()))
            keep = partial + rest * np.sqrt(np.maximum(0.0, 1 - square)) + 1e-7 >= t
            some, partial, square, done = some[keep], partial[keep], square[keep], upto
        return some


def reached(ids: np.ndarray, vectors: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query over the seeds, -inf where they are fewer."""
    out = np.full(len(ids), -np.inf)
    for at in range(0, len(ids), 256):
        s = product(vectors[at : at + 256], seeds).astype(np.float64)
        s[ids[at : at + 256, None] == seed_ids[None, :]] = -np.inf
        if s.shape[1] >= k:
            out[at : at + 256] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    # doubles hold scores to 53 bits; beyond, what is reached may be a little less
    return np.where(np.abs(out) < 2**53, out, out - np.abs(out) * 1e-15)


def by_dimension(rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A pandas frame (vec_id, q) as ids and a matrix for each dimension."""
    groups = rows.groupby(rows["q"].map(len)) if len(rows) else ()
    return {int(d): (x["vec_id"].to_numpy(np.int64), np.array(x["q"].tolist(), np.int64).reshape(len(x), int(d))) for d, x in groups}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = 1024, block: int = QUERY_BLOCK, bucket: int = BUCKET, seeds: int = SEEDS, counter=None) -> DataFrame:
    """The k highest inner products of every query with all vectors but those of its own id.

    vectors, queries: vec_id, embedding. Result: query_id, rank, vec_id, score; ties go to the smaller vec_id.
    Null ids, null vectors and vectors with null or non-finite components take no part. Vectors are compared
    with those of their own dimension only; an empty vector scores 0 against other empty ones. A query row that
    is repeated counts once; repeated candidate rows are candidates each. Empty tables: no rows.
    Queries go to the executors in blocks of about ``block`` rows, each block against all vectors; sums stay
    exact up to 64 bits. ``counter``, an accumulator of `Pairs`, is told the whole products computed and the
    pairs of queries and vectors.
    """
    spark = vectors.sparkSession
    candidates = clean(vectors, scale).withColumn("norm", F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    candidates = candidates.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    asked = clean(queries, scale).distinct()
    blocks = max(1, math.ceil(asked.count() / block))
    longest = by_dimension(candidates.orderBy(F.desc("norm"), "vec_id").limit(seeds).select("vec_id", "q").toPandas())  # at most `seeds` rows
    candidates = candidates.select("vec_id", "q")
    if blocks > 1:
        candidates, asked = written(candidates), written(asked)  # dealt and sorted once for all blocks
    out = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)) == b)
        held = by_dimension(mine.toPandas())  # at most about `block` rows
        sent = spark.sparkContext.broadcast({d: (ids, v, reached(ids, v, *longest[d], k) if d in longest else None) for d, (ids, v) in held.items()})

        def search(batches, sent=sent):
            runs = {dim: Search(ids, v, k, known) for dim, (ids, v, known) in sent.value.items()}
            wait: dict[int, list] = {}

            def flush(dim):
                rows = wait.pop(dim, [])
                if rows and dim in runs:
                    ids, m = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
                    for at in range(0, len(ids), bucket):
                        runs[dim].bucket(ids[at : at + bucket], m[at : at + bucket])

            for batch in batches:
                ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                sizes = np.diff(offsets)
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    m = flat[offsets[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)
                    wait.setdefault(int(dim), []).append((ids[rows].astype(np.int64), m))
                    if sum(len(x[0]) for x in wait[int(dim)]) >= bucket:
                        flush(int(dim))
            for dim in list(wait):
                flush(dim)
            for run in runs.values():
                if counter is not None:
                    counter.add([run.products, run.pairs])
                rows = [(int(q), n, v, -s) for n, (q, best) in enumerate(zip(run.ids, run.best)) for s, v in best]
                if rows:
                    q, n, v, s = (np.array(x, np.int64) for x in zip(*rows))
                    n = n + run.v.shape[1] * (1 << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(v), pa.array(s)], ["query_id", "n", "vec_id", "score"])

        found = candidates.mapInArrow(search, "query_id long, n long, vec_id long, score long").withColumn("b", F.lit(b))
        if blocks > 1:
            found = written(found)
            sent.unpersist()
        out = found if out is None else out.union(found)
    kept = out.groupBy("b", "n", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return kept.select("query_id", F.posexplode("best").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )


def op2_norm_bucket_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: CAST(p[1] * p[2] AS HUGEINT))) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
