"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is the sum of rows of a hashed table, one for the whole word and one for each of its beginnings of a few
lengths, so that inflected forms share what their stem says; filters of several widths run over the words, each keeps its
highest value over the text, and a logistic layer scores them. Trained in numpy on every labelled row, from random
tables and filters: rows are dealt to blocks, each epoch every block learns on from the network of the epoch before, and
the mean of what the blocks changed makes the next. A first training leaves some rows out, for the thresholds.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, documents, pack, remainder_is, table, text_of, unpack, written

#: Labelled rows of a block, about; blocks follow a hash of the id, so cores and partitions do not change the network.
BLOCK = 4_000
#: Rows of the table whose changes travel together.
CHUNK = 4_096
BUCKETS, DIM, WIDTHS, FILTERS, EPOCHS = 1 << 17, 8, (1, 2, 3), 8, 12
#: Step, shares of words left out of each look at a clean and a toxic text, and one in how many labelled rows set thresholds.
RATE, DROP, SPARE, KEPT = 0.2, 0.3, 0.1, 5
STEMS = (3, 4, 5, 6)
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Bytes of text whose words are told apart at once.
PIECE = 2 << 20
#: The parts of filters in order of their place in the filter, then of width: the number of the width, the place.
PARTS = np.array([(k, j) for j in range(max(WIDTHS)) for k, w in enumerate(WIDTHS) if j < w])
POOLED, WIDER = FILTERS * len(WIDTHS), [sum(w > j for w in WIDTHS) for j in range(max(WIDTHS))]
EACH, ALONE = np.arange(POOLED), 512


def hashed(word: bytes) -> list[int]:
    """Rows of a word and its beginnings; case (A-Z) and marks at its ends do not count. Row BUCKETS is always zero."""
    from xxhash import xxh64_intdigest

    w = word.translate(LOWER).strip(MARKS)
    if not w:
        return [BUCKETS] * (len(STEMS) + 1)
    return [xxh64_intdigest(w, 0) % BUCKETS, *(xxh64_intdigest(w[:n], n) % BUCKETS if len(w) > n else BUCKETS for n in STEMS)]


def buckets(text: str | None) -> np.ndarray:
    """(words, rows of each) of a whole text; one row of zeros where it has no word."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    return np.array([hashed(x) for x in w] or [[BUCKETS] * (len(STEMS) + 1)], np.int32)


def xxh64(of: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each row of bytes (rows, fewer than 32 bytes)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    size = of.shape[1]
    h = np.full(len(of), (seed + int(p5) + size) % 2**64, np.uint64)
    for at in range(0, size - 7, 8):
        h = turned(h ^ turned(np.ascontiguousarray(of[:, at : at + 8]).view("<u8")[:, 0] * p2, 31) * p1, 27) * p1 + p4
    at = size // 8 * 8
    if size - at >= 4:
        h = turned(h ^ np.ascontiguousarray(of[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64) * p1, 23) * p2 + p3
        at += 4
    for k in range(at, size):
        h = turned(h ^ of[:, k].astype(np.uint64) * p5, 11) * p1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def hashed_all(words: pa.Array) -> np.ndarray:
    """hashed() of each word of a binary array, in one array."""
    from xxhash import xxh64_intdigest

    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer((words.buffers()[2] or b"")[: ends[-1]], np.uint8)
    data = np.frombuffer(LOWER, np.uint8)[data]
    inner = np.flatnonzero(~np.isin(data, np.frombuffer(MARKS, np.uint8)))  # bytes that are no marks
    first, last = np.searchsorted(inner, ends[:-1]), np.searchsorted(inner, ends[1:])
    sizes, out = np.zeros(len(words), np.int64), np.full((len(words), len(STEMS) + 1), BUCKETS, np.int32)
    some = np.flatnonzero(last > first)
    starts = np.zeros(len(words), np.int64)
    starts[some] = inner[first[some]]
    sizes[some] = inner[last[some] - 1] + 1 - starts[some]
    for size in np.unique(sizes[some]).tolist():
        of = np.flatnonzero(sizes == size)
        if size < 32:
            out[of, 0] = xxh64(data[starts[of][:, None] + np.arange(size)], 0) % np.uint64(BUCKETS)
        else:
            out[of, 0] = [xxh64_intdigest(data[a : a + size].tobytes(), 0) % BUCKETS for a in starts[of].tolist()]
    for k, n in enumerate(STEMS):
        of = np.flatnonzero(sizes > n)
        out[of, k + 1] = xxh64(data[starts[of][:, None] + np.arange(n)], n) % np.uint64(BUCKETS)
    return out


def pieces(texts: pa.Array) -> list[tuple[int, int]]:
    """Where pieces of about one size in all begin and end; a longer text is one."""
    piece = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def worded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text of a string array without nulls has, the words' numbers, and the rows of each number."""
    lengths = np.zeros(len(texts), np.int32)
    words = []
    for a, b in pieces(texts):
        lists = pc.ascii_split_whitespace(texts[a:b])
        found = lists.flatten().cast(pa.binary())
        real = pc.greater(pc.binary_length(found), 0)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        lengths[a:b] = np.diff(np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int32)])[ends])
        words.append(found.filter(real))
    lists = found = real = ends = None
    numbered = pa.chunked_array(words, pa.binary()).dictionary_encode().chunks  # they share one dictionary
    numbers = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in numbered)])
    return lengths, numbers, hashed_all(numbered[-1].dictionary if numbered else pa.array([], pa.binary()))


def embed(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each word's sum of rows, by its ids (words, rows of each)."""
    return rows.take(ids.T, 0).sum(0)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.table[BUCKETS] = 0
        drawn = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        # the last layer's weights, the filters' biases, the filters by part
        self.dense = np.concatenate([np.full(POOLED, 0.1, np.float32), np.zeros(POOLED, np.float32), *(drawn[k][j].T.ravel() for k, j in PARTS)])
        self.at = np.float32(-1.0)
        self.thresholds: dict[str, float] = {}

    @property
    def out(self) -> np.ndarray:
        return self.dense[:POOLED]

    @property
    def parts(self) -> np.ndarray:
        """(parts, filters, dimensions)"""
        return self.dense[2 * POOLED :].reshape(len(PARTS), FILTERS, DIM)

    @property
    def filters(self) -> list[np.ndarray]:
        """For each width (places, dimensions, filters)."""
        return [self.parts[PARTS[:, 0] == k].transpose(0, 2, 1) for k in range(len(WIDTHS))]

    @property
    def bias(self) -> list[np.ndarray]:
        return list(self.dense[POOLED : 2 * POOLED].reshape(len(WIDTHS), FILTERS))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pooled values of a text's word rows, where each was found (widths, filters), and x padded to the widest filter."""
        if len(x) < max(WIDTHS):
            x = np.concatenate([x, np.zeros((max(WIDTHS) - len(x), DIM), np.float32)])
        # highest values lie in rows; products of ALONE words stay on one thread
        flat, n, first = self.parts.reshape(-1, DIM), len(x), len(WIDTHS)
        y = np.empty((len(flat), n), np.float32)
        for a in range(0, n, ALONE):
            np.matmul(flat, x[a : a + ALONE].T, out=y[:, a : a + ALONE])
        y = y.reshape(len(PARTS), FILTERS, n)
        z = y[:first]
        for j in range(1, max(WIDTHS)):
            wider = WIDER[j]
            z[-wider:, :, : n - j] += y[first : first + wider, :, j:]
            z[-wider:, :, n - j] = -np.inf
            first += wider
        where = z.argmax(2)
        return np.maximum(z.reshape(POOLED, n)[EACH, where.ravel()] + self.dense[POOLED : 2 * POOLED], 0), where, x

    def score(self, x: np.ndarray) -> float:
        z = float(self.pooled(x)[0] @ self.out + self.at)
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))

    def start(self, n: list[int]) -> np.ndarray | None:
        """Ready to learn from n[0] clean and n[1] toxic texts: the weight of a text of each class; None if one class has none."""
        if not min(n):
            self.at = np.float32(4.0 if n[1] else -4.0)
            self.out[:] = 0
            return None
        self.squares = np.full_like(self.dense, 1e-2)
        self.rows2 = np.full(BUCKETS + 1, 1e-2, np.float32)
        return 0.5 * sum(n) / np.array(n, float)

    def fit(self, texts: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> None:
        y = np.array(labels, int)
        weight = self.start([int((y == 0).sum()), int((y == 1).sum())])
        r = np.random.default_rng(seed)
        if weight is not None:
            ends = np.cumsum([len(t) for t in texts])
            for _ in range(epochs):
                self.learn(np.concatenate(texts), np.split(np.arange(ends[-1]), ends[:-1]), y, weight, r)

    def learn(self, rows: np.ndarray, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, r: np.random.Generator) -> None:
        """One look at each text, in random order. Texts are numbers of words, rows tells each word's (words, rows of each)."""
        table, rows2, dense, squares, out, parts = self.table, self.rows2, self.dense, self.squares, self.out, self.parts
        grown, slope = np.zeros_like(table), np.empty_like(dense)
        labels = y.tolist()
        for i in r.permutation(len(labels)).tolist():
            # other words get their turn at the maximum; a toxic text may be so by one word, so it loses fewer
            text = texts[i]
            text = text[r.random(len(text)) > (SPARE if labels[i] else DROP)]
            if not len(text):
                continue
            ids = rows.take(text, 0)
            h, where, x = self.pooled(embed(table, ids))
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(h @ out + self.at)))))
            g = np.float32((p - labels[i]) * weight[labels[i]])
            if abs(g) < 1e-3:
                continue
            dh = g * out * (h > 0)
            d = dh.reshape(len(WIDTHS), FILTERS).take(PARTS[:, 0], 0)
            at = where.take(PARTS[:, 0], 0) + PARTS[:, 1:]
            by = d[:, :, None]
            live = np.flatnonzero((at < len(text)) & (d != 0))
            towards = (parts * by).reshape(-1, DIM).take(live, 0)
            slope[:POOLED] = g * h + 1e-4 * out
            slope[POOLED : 2 * POOLED] = dh
            np.multiply(x.take(at, 0), by, out=slope[2 * POOLED :].reshape(parts.shape))
            squares += slope * slope
            dense -= RATE * slope / np.sqrt(squares)
            self.at -= np.float32(RATE * 0.2 * g)
            # a row may come more than once; each time it holds the same sum
            to = ids.take(at.ravel().take(live), 0).T
            np.add.at(grown, to, towards)
            to = to.ravel()
            total = grown.take(to, 0)
            grown[to] = 0
            squared = rows2.take(to) + np.einsum("ij,ij->i", total, total) / DIM
            rows2[to] = squared
            table[to] = table.take(to, 0) - RATE * total / np.sqrt(squared)[:, None]
            table[BUCKETS] = 0

    def flat(self) -> np.ndarray:
        """All that learns but the table, in one array."""
        return np.concatenate([self.dense, self.squares, [self.at]])

    def move(self, by: np.ndarray) -> None:
        """Adds to what flat() shows."""
        for p, change in zip((self.dense, self.squares), np.split(by[:-1].astype(np.float32), 2)):
            p += change
        self.at = np.float32(self.at + by[-1])

    def calibrate(self, texts: list[np.ndarray], labels: list[int], langs: list[str]) -> None:
        """For each language, the threshold of best F1 over rows that were not trained on (0.5 where it has one class)."""
        counts: dict[str, np.ndarray] = {}
        for t, y, lang in zip(texts, labels, langs):
            counts.setdefault(lang, np.zeros((2, len(CUTS) + 1), int))[y, reached(self.score(embed(self.table, t)))] += 1
        self.thresholds = {lang: best_cut(n) for lang, n in sorted(counts.items())}


CUTS = np.linspace(0.05, 0.95, 19)


def reached(score: float) -> int:
    """How many of the cuts a score reaches."""
    return int(np.searchsorted(CUTS, score, "right"))


def best_cut(n: np.ndarray) -> float:
    """The cut of best F1, by how many texts of each class reach so many cuts (n[class, cuts]); 0.5 where one class has none."""
    if not n.sum(1).all():
        return 0.5
    over = n[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    f1 = 2 * over[1] / np.maximum(1, over.sum(0) + n[1].sum())
    return float(max(zip(f1, -np.abs(CUTS - 0.5), CUTS))[2])


def among(ids: DataFrame, n: int) -> Callable[[DataFrame], DataFrame]:
    """Keeps nearly only rows whose doc_id is one of n ids, and all of those, by a map of 16 bits an id that is broadcast.

    So the texts of other rows need not travel to a join.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(16 * n))
    bits = ids.groupBy((spot / 32768).cast("long").alias("_part")).agg(F.bitmap_construct_agg((spot % 32768)).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (spot % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.pmod(F.floor(byte / F.pow(F.lit(2), spot % 8)), F.lit(2)) == 1
    return lambda df: df.join(F.broadcast(bits), ((spot / 32768).cast("long") == F.col("_part")) & there, "left_semi")


def tokenized(batches):
    """A row for each block, from rows of block, doc_id, text, lang, toxic and kept, in order of the first three.

    A row without a text says toxic and kept for the rows of its id that follow; rows of other ids do not count.
    """
    stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for block, rows in groupby(stream, key=lambda r: r[0]):
        texts, labels, kept, langs, now = [], [], [], [], None
        for _, doc_id, text, lang, *said in rows:
            if text is None:
                now = doc_id, *said
            if text is None or now is None or now[0] != doc_id:
                continue
            texts.append(text), labels.append(now[1]), kept.append(now[2]), langs.append(lang)
        if not texts:
            continue
        sizes, found, rows = worded(pa.array(texts, pa.string()))
        if len(blank := np.flatnonzero(sizes == 0)):  # learned from as one word of zeros
            found, rows = np.insert(found, np.cumsum(sizes)[blank], len(rows)), np.concatenate([rows, np.full((1, len(STEMS) + 1), BUCKETS, np.int32)])
            sizes[blank] = 1
        data = pack(sizes, found, rows.ravel(), np.array(labels, np.int8), np.array(kept, np.int8))
        texts = sizes = found = rows = None
        pa.default_memory_pool().release_unused()  # else workers keep it while they wait
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([langs], pa.list_(pa.string()))], ["block", "data", "langs"])


def opened(data: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """A block's rows of words, texts as numbers of words, labels, and whether they are kept for thresholds."""
    sizes, found, rows, labels, kept = unpack(data)
    return rows.reshape(-1, len(STEMS) + 1), np.split(found, np.cumsum(sizes[:-1])), labels.astype(int), kept > 0


def epoch(blocks: DataFrame, net: Network, weight: np.ndarray, spare: bool, seed: int) -> None:
    """One look at every text (those kept for thresholds left out if spare); net becomes the mean over blocks.

    A row of the table takes the mean over the blocks that changed it; others would only hold it back.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(net)

    def learn(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, texts, y, kept = opened(data)
                if spare:
                    texts, y = [t for t, k in zip(texts, kept) if not k], y[~kept]
                before, mine = sent.value, copy.deepcopy(sent.value)
                mine.learn(rows, texts, y, weight, np.random.default_rng([seed, block]))
                rows = np.flatnonzero((mine.table != before.table).any(1) | (mine.rows2 != before.rows2)).astype(np.int32)
                by = np.column_stack([mine.table[rows] - before.table[rows], mine.rows2[rows] - before.rows2[rows]])
                out = [(-1, mine.flat() - before.flat())]
                for chunk in np.unique(rows // CHUNK).tolist():
                    here = rows // CHUNK == chunk
                    out.append((chunk, rows[here], by[here].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, *_ in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([pack(*a) for _, *a in out], pa.binary())], ["chunk", "block", "data"]
                )

    def mean(batches):
        stream = ((c, d) for batch in batches for c, d in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
        for chunk, parts in groupby(stream, key=lambda r: r[0]):
            total, times = 0, np.zeros((CHUNK, 1), int)
            for _, data in parts:
                *rows, by = unpack(data)
                if chunk < 0:
                    total, times[0] = total + by.astype(float), times[0] + 1
                    continue
                if not times.any():
                    total = np.zeros((CHUNK, DIM + 1))
                total[rows[0] - chunk * CHUNK] += by.reshape(-1, DIM + 1)
                times[rows[0] - chunk * CHUNK] += 1
            here = np.flatnonzero(times)
            out = [total / times[0, 0]] if chunk < 0 else [here + chunk * CHUNK, (total[here] / times[here]).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack(*out)], pa.binary())], ["chunk", "data"])

    changed = blocks.mapInArrow(learn, "chunk long, block long, data binary").repartition("chunk").sortWithinPartitions("chunk", "block")
    for chunk, data in changed.mapInArrow(mean, "chunk long, data binary").collect():  # the table's size at most
        *rows, by = unpack(data)
        if chunk < 0:
            net.move(by)
        else:
            by = by.reshape(-1, DIM + 1).astype(np.float32)
            net.table[rows[0]] += by[:, :DIM]
            net.rows2[rows[0]] += by[:, DIM]
    sent.unpersist()


def thresholds(blocks: DataFrame, net: Network) -> dict[str, float]:
    """For each language with both classes among the texts kept, the threshold of best F1 over those."""
    sent = blocks.sparkSession.sparkContext.broadcast(net)

    def count(batches):
        net = sent.value
        for batch in batches:
            for data, langs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows, texts, y, kept = opened(data)
                at = np.flatnonzero(kept).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[i] for i in at], pa.string()), pa.array(y[at], pa.int32()), pa.array([reached(net.score(embed(net.table, rows[texts[i]]))) for i in at], pa.int32())], ["lang", "toxic", "cuts"]
                )

    cells = blocks.mapInArrow(count, "lang string, toxic int, cuts int").groupBy("lang", "toxic", "cuts").agg(F.count("*").alias("n"))
    both = cells.groupBy("lang").agg(F.collect_list(F.struct("toxic", "cuts", "n")).alias("cells"), F.min("toxic").alias("least"), F.max("toxic").alias("most")).where("least <> most")
    out = {}
    for lang, found in both.select("lang", "cells").collect():  # languages that have toxic and clean texts
        n = np.zeros((2, len(CUTS) + 1), int)
        for toxic, cuts, k in found:
            n[toxic, cuts] = k
        out[lang] = best_cut(n)
    return dict(sorted(out.items()))


def train(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> Network:
    """labels: doc_id, toxic (a document labelled twice is toxic if one says so); docs: doc_id, text, lang.

    Learns from every row of docs with a label. Rows of one id are learned from each.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    kept = F.pmod(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("kept")).cast("binary")), F.lit(KEPT)) == 0
    marked = marked.withColumn("kept", kept.cast("int"))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull())
    net = Network()
    if not (known := marked.count()):
        net.start([0, 0])
        return net
    docs = among(marked, known)(docs)
    counted = {(r[0], r[1]): r[2] for r in docs.select("doc_id").join(marked, "doc_id").groupBy("toxic", "kept").count().collect()}  # four rows at most
    n, rest = ([sum(c for (y, spare), c in counted.items() if y == k and spare <= most) for k in (0, 1)] for most in (1, 0))
    weight = net.start(n)
    if weight is None:
        return net
    many = -(-sum(n) // BLOCK)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(many)).alias("block")
    lang = F.coalesce(F.col("lang"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    none = F.lit(None).cast("string")
    rows = docs.select(block, "doc_id", text_of().alias("text"), lang.alias("lang"), F.lit(None).cast("int").alias("toxic"), F.lit(None).cast("int").alias("kept"))
    rows = rows.union(marked.select(block, "doc_id", none.alias("text"), none.alias("lang"), "toxic", "kept")).repartition(many, "block")
    blocks = written(rows.sortWithinPartitions("block", "doc_id", F.asc_nulls_first("text"), "lang").mapInArrow(tokenized, "block long, data binary, langs array<string>"))
    # thresholds come from rows that a first training leaves out; the second learns from all
    if min(rest):
        first = Network()
        part = first.start(rest)
        for k in range(max(1, epochs // 2)):
            epoch(blocks, first, part, True, 11 + k)
        net.thresholds = thresholds(blocks, first)
    for k in range(epochs):
        epoch(blocks, net, weight, False, 11 + k)
    return net


def scored(texts: pa.Array, net: Network) -> list[float]:
    """The score of each text of a string array without nulls."""
    sizes, found, rows = worded(texts)
    words = embed(net.table, rows)
    return [net.score(words.take(text, 0)) for text in np.split(found, np.cumsum(sizes[:-1]))]


def score_documents(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with score; a column of that name is replaced. Null and empty texts get the score of no words."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a table of fixed size
    own = "_".join(["text", *names])  # longer than any name, so like none

    def run(batches):
        net = sent.value
        for batch in batches:
            texts = batch.column(len(names))
            scores = [x for a, b in pieces(texts) for x in scored(texts[a:b], net)]
            texts = None
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", score double"
    return docs.select(*names, text_of().alias(own)).mapInArrow(run, schema)


def op8_cnn_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = train(docs, table(spark, sf_dir, "labels").where(~remainder_is("doc_id", 5, 0)))
    out = score_documents(docs, net, ["doc_id", "lang"])
    cuts = F.create_map(*(F.lit(x) for kv in net.thresholds.items() for x in kv)) if net.thresholds else F.create_map(F.lit("und"), F.lit(0.5))
    return out.select(
        "doc_id",
        remainder_is("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= F.coalesce(F.try_element_at(cuts, F.coalesce("lang", F.lit("und"))), F.lit(0.5))).cast("int").alias("toxic_by_language"),
    )
