"""Best-fit packing with large-item matching.

Token counts are dealt out through a histogram of lengths (one entry per length up to the capacity, however many
documents): pieces above a third of the capacity are matched greedily, two to a sequence at most, each with the
longest partner that fits; shorter ones go to the tightest gap that holds them, longest first. The plan is a
list of intervals of ranks within a length, joined back to the pieces.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import documents, text_of, written

CAPACITY, END = 1024, 2
#: Pieces that share a rank group; ranks are counted within groups and offset by the groups before.
RANK_GROUP = 8_000


class Encoder:
    """Token ids of texts by a public tokenizer's file, as `tokenizers` gives them, special tokens in a text included.

    That library takes several times as long as the byte-pair encoder of `tiktoken`, which gives the same ids for a
    text without a special token when it has the same ranks; they are read from the same file. Texts with a special
    token go to `tokenizers` itself.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or P.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(self.letters())}
        ranks = {bytes(map(byte.__getitem__, t)): n for t, n in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.plain = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def letters() -> str:
        """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        return "".join(chr(b if b in shown else 256 + hidden.index(b)) for b in range(256))

    def encode(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder, kept over its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens; the first may be shorter."""
    first = n % capacity if n > capacity and n % capacity else min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, past rank, first sequence, offset), and the number of sequences.

    Every rank of every length of the histogram falls in exactly one row.
    """
    left = {n: c for n, c in histogram.items() if c > 0 and 0 < n <= capacity}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    bins: dict[int, list[list]] = {}  # gap -> [lengths, how many]

    def put(items: tuple[int, ...], count: int) -> None:
        bins.setdefault(capacity - sum(items), []).append([items, count])

    for n in large:
        c, twice = left.pop(n, 0), 2 * n <= capacity
        while c:
            partners = [m for m in large if m in left and left[m] and m + n <= capacity]
            if twice and (not partners or partners[0] <= n):
                if c > 1:
                    put((n, n), c // 2)
                c %= 2
                if not c:
                    break
                twice = False
                continue
            if partners:
                m = partners[0]
                k = min(c, left[m])
                put((n, m), k)
                c, left[m] = c - k, left[m] - k
            else:
                put((n,), c)
                c = 0
    gaps = sorted(bins)
    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        c = left[n]
        while c:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                gap, items, have = capacity, (), c
            else:
                gap = gaps[at]
                items, have = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(at)
            each = min(gap // n, c)
            k = min(have, c // each)
            for lengths, count in (((*items, *[n] * each), k), (items, have - k if items else 0)):
                if count:
                    g = capacity - sum(lengths)
                    if g not in bins:
                        bisect.insort(gaps, g)
                    bins.setdefault(g, []).append([lengths, count])
            c -= k * each
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for gap in sorted(bins):
        for lengths, count in bins[gap]:
            offset = 0
            for n in lengths:
                rows.append((n, used[n], used[n] + count, sequence, offset))
                used[n], offset = used[n] + count, offset + n
            sequence += count
    return rows, sequence


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token ids and the end id."""

    def encode(batches):
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*enc.encode(text), end], "<u4")
                for i, (s, n) in enumerate(cut(len(ids), capacity)):
                    for column, x in zip(out, (doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes()))):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (a written table with doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = rows.sparkSession
    total = rows.count()
    groups = max(1, total // RANK_GROUP)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # one row per length and salt, each of some thousand pieces
    before = counts.select("length", "salt", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    table, _ = plan(histogram, capacity)
    spans = spark.createDataFrame(table or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    # the plan's size depends on the capacity alone: a few rows for each length; a salt's ranks meet few of them
    slots = before.join(F.broadcast(spans), "length").where("low < before + n AND high > before").drop("n")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    rank = F.col("within") + F.col("before")
    placed = dealt.withColumn("within", within).join(slots, ["length", "salt"]).withColumn("rank", rank).where("rank >= low AND rank < high")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id, text; other columns are ignored. Null text is empty: the end id alone. Only documents longer
    than the capacity are cut. Repeated rows are packed each; an empty table gives no rows.
    """
    return pack_pieces(written(pieces(docs, capacity, end, path)), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
