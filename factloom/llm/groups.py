"""Documents in groups of bounded size, and messages between groups and buckets of keys.

A group is some megabytes of texts, dealt by a hash of the row. Groups ask buckets of keys, buckets answer groups;
messages are rows (to int, kind int, data binary) whose arrays are packed, so a shuffle moves a few bytes a key.
A message holds many keys where groups are few and never less than one, so there are no more of them than keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import text_of

#: Bytes of text in a group, and of texts packed together before they are sent.
GROUP_BYTES, BLOCK_BYTES = 8_000_000, 24_000_000
#: Bytes of text for each bucket of keys, so that a bucket's task holds as much whatever the input; and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 16_000_000, 60_000
MESSAGE = "to int, kind int, data binary"
TEXT, NEWS = 0, 1


def row(to: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["to", "kind", "data"])


def rows(items: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(items), 64):
        to, kind, data = zip(*items[at : at + 64])
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["to", "kind", "data"])


def counts(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[int, int]:
    """Groups for the texts, and buckets for their keys."""
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, -(-size // group_bytes)), min(MOST_BUCKETS, max(1, tasks, -(-size // BUCKET_BYTES)))


def dealt(docs: DataFrame, groups: int, held: F.Column | None = None) -> DataFrame:
    """g int, doc_id long, held boolean, text string."""
    g = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text_of()), F.lit(groups)).cast("int")
    return docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), (held if held is not None else F.lit(False)).alias("held"), text_of().alias("text"))


def encode_texts(ids: list, held: list, texts: list[bytes]) -> bytes:
    import zstandard

    head = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(texts, pa.large_binary())], ["id", "held", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as w:
        w.write_batch(head)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def decode_texts(data: bytes) -> list[tuple[int | None, bool, bytes]]:
    import zstandard

    size = zstandard.frame_content_size(data)
    t = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data, max_output_size=size)).read_all()
    return list(zip(t["id"].to_pylist(), t["held"].to_pylist(), t["text"].to_pylist()))


def text_messages(docs: DataFrame) -> DataFrame:
    """docs (g, doc_id, held, text) as messages to their groups."""

    def send(batches):
        wait: dict[int, list[list]] = {}
        size = 0
        for batch in batches:
            for g, i, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                t = t.encode("utf-8", "surrogatepass")
                for column, x in zip(wait.setdefault(g, [[], [], []]), (i, h, t)):
                    column.append(x)
                size += len(t)
            if size > BLOCK_BYTES:
                for g in list(wait):
                    yield row(g, TEXT, encode_texts(*wait.pop(g)))
                size = 0
        for g in list(wait):
            yield row(g, TEXT, encode_texts(*wait.pop(g)))

    return docs.mapInArrow(send, MESSAGE)


def deliver(messages: DataFrame, parts: int, handle: Callable[[int, dict[int, list[bytes]]], Iterator[pa.RecordBatch]], schema: str = MESSAGE) -> DataFrame:
    """handle(to, kind -> data of its messages) for each receiver, one at a time."""

    def run(batches):
        now, got = None, {}
        for batch in batches:
            for to, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if to != now:
                    if now is not None:
                        yield from handle(now, got)
                    now, got = to, {}
                got.setdefault(kind, []).append(data)
        if now is not None:
            yield from handle(now, got)

    return messages.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(run, schema)


def group_documents(blocks: list[bytes]) -> list[tuple[int | None, bool, bytes]]:
    """A group's documents in an order that does not depend on how its messages arrived; null ids last."""
    found = [d for b in blocks for d in decode_texts(b)]
    return sorted(found, key=lambda d: (d[0] is None, d[0] or 0, d[2]))


def delta(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def undelta(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)
