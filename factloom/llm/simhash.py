"""SimHash near-duplicates with BK-trees.

A document is 64 majority bits over the hashes of its word shingles. Distinct fingerprints are dealt to shards
by two of radius + 2 blocks of bits (four of 16 for radius 2): fingerprints within the radius agree on two blocks at
least, so each link shows in some shard; a shard of too many is dealt anew by parts of its other bits, of which one
agrees, too. Trees of all shards would not fit a broadcast, so each is built in the task that its shard goes to. A shard holds a BK-tree (children keyed by their distance to the parent), followed only along
edges within the radius; its links go through a union-find and leave as one link per member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import connected, documents, words, written

SHINGLE, RADIUS = 3, 2
#: Shards with more fingerprints are dealt anew by a part of their other bits.
HOT = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    w = words(text)
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) > shingle else [b" ".join(w)]
    h = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64, max(1, len(w) - shingle + 1))
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


class BKTree:
    def __init__(self):
        self.root = None

    def near(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                todo.extend(children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children)
        return found

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = (x, {})
                return
            node = node[1][d]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """One link per member of each group within the shard, to the group's smallest value."""
    tree, parent = BKTree(), {x: x for x in values}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in parent:
        for y in tree.near(x, radius):
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
        tree.add(x)
    return [(x, r) for x in parent if (r := find(x)) != x]


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """prints: distinct f long; hot: fingerprints of a shard beyond which it is dealt anew. a, b: links that connect all fingerprints within the radius."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [[*range(a, b)] for a, b in zip(cuts, cuts[1:])]
    pairs = list(combinations(range(radius + 2), 2))
    mask = lambda bits: F.lit(int(np.uint64(sum(1 << b for b in bits)).view(np.int64)))
    key = lambda n, i, j: F.xxhash64(F.lit(n), F.col("f").bitwiseAND(mask(blocks[i] + blocks[j])))
    keys = F.array(*(F.struct(key(n, i, j).alias("key"), F.lit(n).alias("n")) for n, (i, j) in enumerate(pairs)))
    rows = prints.select("f", F.explode(keys).alias("k")).select("k.key", "k.n", "f")
    large = written(rows.groupBy("key").count().where(F.col("count") > hot).select("key"))
    if large.take(1):
        rest = [[b for x in range(radius + 2) if x not in p for b in blocks[x]] for p in pairs]
        parts = lambda k: F.element_at(F.array(*(mask(bits[k :: radius + 1]) for bits in rest)), F.col("n") + 1)
        again = F.array(*(F.xxhash64("key", F.lit(k), F.col("f").bitwiseAND(parts(k))) for k in range(radius + 1)))
        split = rows.join(large, "key", "left_semi").select(F.explode(again).alias("key"), "f")
        rows = rows.join(large, "key", "left_anti").select("key", "f").union(split)

    def search(batches):
        last, run = None, []

        def out(found):
            a, b = (np.array([p[i] for p in found], np.uint64).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            found = []
            ends = np.r_[starts[1:], len(key)]
            for s, e in zip(starts.tolist(), ends.tolist()):
                if s == 0 and last == key[0]:
                    run.extend(f[s:e].tolist())
                else:
                    if len(run) > 1:
                        found += shard_links(run, radius)
                    run = f[s:e].tolist()
            if len(key):
                last = key[-1]
            if found:
                yield out(found)
        if len(run) > 1 and (found := shard_links(run, radius)):
            yield out(found)

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.select("key", "f").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id linked to it, however far).

    docs: doc_id, text; other columns are ignored. Null text is empty; a text without words has fingerprint zero,
    linked like any other. Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows stay
    rows; rows with a null doc_id keep their component, whose id is null only if no row of it has an id.
    """

    def prints(batches):
        for batch in batches:
            f = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], ["doc_id", "f"])

    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(prints, "doc_id long, f long"))
    least = written(rows.groupBy("f").agg(F.min("doc_id").alias("least")))
    roots = connected(links(least.select("f"), radius))
    joined = least.join(roots.withColumnRenamed("node", "f"), "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    label = joined.where(F.col("root").isNotNull()).join(ids, "root").select("f", "component_id")
    return rows.join(label, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
