"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on bytes; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def remainder_is(column: str, modulus: int, remainder: int) -> Column:
    """crc32(column as text) mod modulus = remainder; null ids: false."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == F.lit(remainder), F.lit(False))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, safe against lost executors."""
    path = os.path.join(shared_folder(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now; it does so when the driver collects its garbage."""
    for _ in range(2):  # Python gives its references up in a thread of its own
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the white space of ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def zstd():
    """This process's compressor and decompressor."""
    global _zstd
    if _zstd is None:
        import zstandard

        _zstd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _zstd


_zstd = None


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes (small values leave planes of zeros)."""
    squeeze, parts = zstd()[0], []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1) if len(a) else np.zeros((0, a.dtype.itemsize), np.uint8)
        body = squeeze.compress(np.ascontiguousarray(raw.T).tobytes())
        parts.append(len(a).to_bytes(8, "little") + len(body).to_bytes(8, "little") + a.dtype.str.encode().ljust(8) + body)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    expand, out, at = zstd()[1], [], 0
    while at < len(data):
        n, size = int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 16], "little")
        kind = np.dtype(data[at + 16 : at + 24].strip().decode())
        raw = expand.decompress(data[at + 24 : at + 24 + size], max_output_size=max(1, n * kind.itemsize))
        planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += 24 + size
    return out


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of edges (a long, b long): node, root (the smallest node of its component).

    Alternates large-star and small-star steps, each a partial minimum and a join on a node; every round is
    written to the shared folder. No rows: no rows. Raises if it has not settled after ``rounds``.
    """

    def stars(sym: DataFrame, large: bool) -> DataFrame:
        least = sym.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m")) if large else least
        joined = sym.join(least, "u")
        if large:
            return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = written(now), None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        far = stars(both, True).where("u <> v").distinct()
        now = written(stars(far, False).where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
