"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into passages of words. A randomised SVD of the TF-IDF passages of all of them,
its products summed over partitions, gives a latent space; passages of documents whose cosine with an item's passage there
reaches a threshold are candidates. A candidate is a leak if the longest common subsequence with the item's words
covers most of them, or a fair part with the item's closing words (its answer) besides: paraphrases keep those.
"""

from __future__ import annotations

from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import documents, table, text_of, written

#: Words of an item's passage (documents are searched by windows of twice that, overlapping by half), rank of the
#: latent space as a share of the items' passages (and at least so much), and rounds of the range finder.
PASSAGE, RANK, LEAST_RANK, ROUNDS = 24, 0.4, 16, 2
#: Words in more than this share of passages weigh nothing.
COMMON = 0.02
COSINE, COVER, PARTIAL, ANSWER = 0.15, 0.6, 0.5, 8
#: Items that are searched for at once, in a latent space of their own; more are searched for block by block.
ITEM_BLOCK = 256
#: Words of documents whose windows are compared at once, and that are multiplied at once (so that caches hold them); words
#: of the vocabulary whose partial sums travel together.
BATCH, PRODUCT, CHUNK = 60_000, 15_000, 32
#: Marks of ASCII to spaces.
PLAIN = bytes(32 if 32 < b < 127 and not chr(b).isalnum() else b for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Case-folded words, in every script, without marks of ASCII."""
    return (text or "").casefold().encode("utf-8", "surrogatepass").translate(PLAIN).split()


def numbers(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """A text's words by their number in the vocabulary, -1 for others."""
    w = plain_words(text)
    return np.fromiter(map(vocabulary.get, w, repeat(-1)), np.int32, len(w))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        m = where.get(x, 0) & row
        if m:
            row = (row + m) | (row - m)
            row &= full
    return len(a) - row.bit_count()


def is_leak(item: list, region: list, cover: float = COVER, partial: float = PARTIAL) -> tuple[bool, float]:
    """Whether the region holds the item, and the share of the item's words found there in order."""
    if not item:
        return False, 0.0
    share, span = 0.0, len(item) + max(4, len(item) // 4)
    present = set(item)
    hits = np.array([x in present for x in region], np.int64)
    if not len(region):
        return False, 0.0
    sums = np.r_[0, np.cumsum(hits)]
    step = max(1, len(item) // 8)
    for at in range(0, max(1, len(region) - span + step), step):
        end = min(len(region), at + span)
        if sums[end] - sums[at] >= share * len(item) and sums[end] - sums[at] >= partial * len(item):
            share = max(share, lcs(item, region[at:end]) / len(item))
    if share >= cover:
        return True, share
    answer = item[-ANSWER:]
    told = share >= partial and any(region[i : i + len(answer)] == answer for i in range(len(region) - len(answer) + 1))
    return told, share


def windows(texts: list[np.ndarray], weight: np.ndarray, basis: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors and lengths of the texts' windows of 2 x size words, one at each block of size words.

    The third array has each text's first window; a block of nothing after each text keeps texts apart.
    """
    blocks = np.array([-(-len(x) // size) + 1 for x in texts])
    base = np.cumsum(blocks) - blocks
    at = np.concatenate([b + np.arange(len(x)) // size for b, x in zip(base, texts)])
    ids = np.concatenate(texts)
    live = np.flatnonzero(ids >= 0)
    live = live[weight[ids[live]] > 0]
    latent, square = np.zeros((blocks.sum() + 1, basis.shape[1]), np.float32), np.zeros(blocks.sum() + 1, np.float32)
    if len(live):
        at, w = at[live], ids[live]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        latent[at[starts]] = np.add.reduceat(basis[w], starts, axis=0)
        square[at[starts]] = np.add.reduceat(weight[w] ** 2, starts)
    return latent[:-1] + latent[1:], np.sqrt(square[:-1] + square[1:]), base


def passages(words: list, size: int = PASSAGE) -> list[list]:
    """Passages of size words; the last one reaches back to have as many."""
    return [words[i : i + size] for i in range(0, len(words) - size, size)] + [words[-size:]]


def dense(rows: list[list[bytes]], vocabulary: dict[bytes, int], weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        for w in r:
            if (k := vocabulary.get(w)) is not None:
                out[i, k] += weight[k]
    return out


def numbered(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id and words: each text's words by their numbers (see stored), written once for the passes over them."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(vocabulary), stored(vocabulary)

    def run(batches):
        for batch in batches:
            found = [numbers(t, sent.value).astype(kind).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "words"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words binary"))


def stored(vocabulary: dict[bytes, int]) -> type:
    return np.int16 if len(vocabulary) < 1 << 15 else np.int32


def document_frequency(docs: DataFrame, vocabulary: dict[bytes, int], size: int) -> tuple[np.ndarray, int]:
    """Passages of all documents (as of numbered) that hold each word of the vocabulary, and the number of passages."""
    v, kind = len(vocabulary), stored(vocabulary)

    def count(batches):
        total, n = np.zeros(v, np.int64), 0
        for batch in batches:
            for words in batch.column(0).to_pylist():
                x = np.frombuffer(words, kind).astype(np.int64)
                n += -(-len(x) // size)
                live = np.flatnonzero(x >= 0)
                pairs = np.unique(live // size * v + x[live])
                total += np.bincount(pairs % v, minlength=v)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.flatnonzero(total), v], pa.int64()), pa.array(np.r_[total[total > 0], n], pa.int64())], ["w", "n"])

    out, n = np.zeros(v, np.int64), 0
    for w, c in docs.select("words").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n")).collect():  # a row per word of the items
        if w == v:
            n = c
        else:
            out[w] = c
    return out, n


def latent_space(docs: DataFrame, items: np.ndarray, vocabulary: dict[bytes, int], weight: np.ndarray, rank: int, rounds: int, size: int, total: int) -> np.ndarray:
    """(words, rank): an orthonormal basis of the leading right singular directions of the TF-IDF passages.

    The passages are the items' and those of all documents (as of numbered, total of them), which count as one document
    on the mean. The range finder multiplies a random block by the matrix and its transpose, in partial sums over partitions.
    """
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(len(vocabulary), min(rank, len(vocabulary)))))[0].astype(np.float32)
    spark, kind = docs.sparkSession, stored(vocabulary)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((weight, (q * weight[:, None]).astype(np.float32)))

        def multiply(batches, sent=sent):
            weight, q = sent.value
            y = np.zeros(q.shape)

            def add(texts):
                ids = np.concatenate(texts)
                passage = np.repeat(np.cumsum([0, *(-(-len(x) // size) for x in texts[:-1])]), [len(x) for x in texts])
                passage += np.concatenate([np.arange(len(x)) // size for x in texts])
                live = np.flatnonzero(ids >= 0)
                live = live[weight[ids[live]] > 0]
                if len(live):
                    ids, passage = ids[live], passage[live]
                    new = np.r_[True, passage[1:] != passage[:-1]]
                    part = np.add.reduceat(q.take(ids, 0), np.flatnonzero(new), axis=0)
                    by = np.argsort(ids, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(ids[by]) > 0])
                    words = ids[by][starts]
                    y[words] += np.add.reduceat(part.take((np.cumsum(new) - 1)[by], 0), starts, axis=0) * weight[words][:, None]

            for batch in batches:
                texts, n = [], 0
                for words in batch.column(0).to_pylist():
                    texts.append(np.frombuffer(words, kind))
                    n += len(texts[-1])
                    if n > PRODUCT:
                        add(texts)
                        texts, n = [], 0
                if texts:
                    add(texts)
            chunks = [k for k in range(0, len(y), CHUNK) if y[k : k + CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([y[k : k + CHUNK].astype(np.float32).tobytes() for k in chunks], pa.binary())], ["chunk", "y"])

        def add_up(batches, wide=q.shape[1]):
            rows = ((c, d) for batch in batches for c, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for chunk, parts in groupby(rows, key=lambda r: r[0]):
                y = sum(np.frombuffer(d, np.float32).astype(float) for _, d in parts).reshape(-1, wide)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([y.tobytes()], pa.binary())], ["chunk", "y"])

        y = (items.T @ (items @ q) * 4).astype(float)
        parts = docs.select("words").mapInArrow(multiply, "chunk long, y binary").repartition("chunk").sortWithinPartitions("chunk", "y")
        for chunk, part in parts.mapInArrow(add_up, "chunk long, y binary").collect():  # the items' words times the rank
            y[chunk : chunk + CHUNK] += np.frombuffer(part).reshape(-1, q.shape[1]) / max(1, total)
        q = np.linalg.qr(y)[0].astype(np.float32)
    return q


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER, partial: float = PARTIAL, size: int = PASSAGE, rank: float = RANK, block: int = ITEM_BLOCK, check: bool = True) -> DataFrame:
    """doc_id, item_id, cosine, cover: one row for each leak of an item into a document.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and empty texts and items hold
    and match nothing. Rows and items without an id are searched like others and reported with null. Repeated rows
    report each. ``check=False`` returns all candidates of the cosine search.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("text <> ''").distinct()
    blocks = -(-asked.count() // block)
    total = docs.count() if blocks else 0
    schema, out = "doc_id long, item_id long, cosine double, cover double", None
    for b in range(blocks):
        mine = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).collect()  # about `block` items
        items = sorted(((r[0], plain_words(r[1])) for r in mine), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        items = [x for x in items if x[1]]
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, x in items for w in x}))}
        if not vocabulary:
            continue
        told = numbered(docs, vocabulary)
        df, n = document_frequency(told, vocabulary, size)
        idf = np.log((n + 1.0) / (df + 1.0)) + 0.01
        weight = np.where(df > COMMON * max(n, 20), 0, idf).astype(np.float32)
        cuts = [(k, p) for k, (_, x) in enumerate(items) for p in passages(x, size)]
        matrix = dense([p for _, p in cuts], vocabulary, weight)
        space = latent_space(told, matrix, vocabulary, weight, max(LEAST_RANK, int(rank * len(cuts))), ROUNDS, size, total)
        latent = matrix @ space
        norms = np.linalg.norm(latent, axis=1)
        # items of common words only have no direction; they are compared by their words alone, in every text
        bare = [k for k in range(len(items)) if not any(weight[vocabulary[w]] > 0 for w in items[k][1])]
        sent = spark.sparkContext.broadcast((items, vocabulary, weight, (space * weight[:, None]).astype(np.float32), [k for k, _ in cuts], (latent / np.maximum(norms, 1e-9)[:, None]).astype(np.float32), bare))

        def search(batches, sent=sent, kind=stored(vocabulary)):
            items, vocabulary, weight, basis, owner, latent, bare = sent.value
            owner = np.array(owner)
            told = [[vocabulary[w] for w in words] for _, words in items]

            def compare(ids, texts):
                v, length, base = windows(texts, weight, basis, size)
                best: dict[tuple[int, int], list] = {(n, k): [0.0, None] for n in range(len(texts)) for k in bare}
                live = np.flatnonzero(length > 0)
                for at in range(0, len(live), 4096):
                    rows = live[at : at + 4096]
                    product = v[rows] @ latent.T
                    hits = np.nonzero(product >= cosine * length[rows][:, None])
                    which = np.searchsorted(base, rows[hits[0]], "right") - 1
                    cos = product[hits] / length[rows[hits[0]]]
                    for n, w, c, x in zip(which.tolist(), rows[hits[0]].tolist(), owner[hits[1]].tolist(), cos.tolist()):
                        hit = best.setdefault((n, c), [0.0, []])
                        hit[0] = max(hit[0], x)
                        hit[1].append(w - int(base[n]))
                for (n, k), (cos, at) in sorted(best.items()):
                    item, words, share, leak = told[k], texts[n], 0.0, False
                    if check:
                        regions, reach = [], len(item) + size
                        for w in sorted(set(at)) if at is not None else [0]:
                            low, high = (max(0, w * size - reach), (w + 2) * size + reach) if at is not None else (0, len(words))
                            if regions and low <= regions[-1][1]:
                                regions[-1][1] = high
                            else:
                                regions.append([low, high])
                        for low, high in regions:
                            region = words[low:high].tolist()
                            there = set(region)
                            if sum(x in there for x in item) >= partial * len(item):
                                one, part = is_leak(item, region, cover, partial)
                                leak, share = leak or one, max(share, part)
                    if leak or not check:
                        yield ids[n], items[k][0], cos, share

            for batch in batches:
                found: list[tuple] = []
                ids, texts, total = [], [], 0
                for doc, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = np.frombuffer(seen, kind).astype(np.int32)
                    if len(x):
                        ids.append(doc), texts.append(x)
                        total += len(x)
                    if total > BATCH:
                        found += compare(ids, texts)
                        ids, texts, total = [], [], 0
                if ids:
                    found += compare(ids, texts)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "cosine", "cover"])

        got = told.mapInArrow(search, schema)
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], schema)


def op10_lsa_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("cover", 4).alias("cover"))
