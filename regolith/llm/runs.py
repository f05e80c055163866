"""Chunks of documents and packed runs of numbers that travel between tasks as single binary values.

A chunk is a written row that holds some MB of texts; what a task elsewhere finds out about it comes back by its
number. So records go through the shuffle as sorted, compressed arrays and never as a row for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
LAST = np.int64(2**63 - 1)
_KINDS = ("u1", "i1", "i2", "i4", "i8", "u4", "u8")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the bytes of one rank lie together, so small numbers cost little."""
    head, raw = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [_KINDS.index(a.dtype.str[1:]), len(a)]
        raw.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, np.int64).tobytes() + b"".join(raw))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in head.tolist():
        dtype = np.dtype(_KINDS[kind])
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += size * dtype.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The array in the smallest integer type that holds it."""
    top = int(np.abs(a).max()) if len(a) else 0
    return a.astype(np.int8 if top < 2**7 else np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def deltas(a: np.ndarray) -> np.ndarray:
    """Steps of an ascending array, for pack(); np.cumsum undoes it."""
    return narrow(np.diff(a.astype(np.int64), prepend=np.int64(0)))


def join_texts(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def cut_texts(data: bytes, sizes: np.ndarray) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(sizes)
    return [raw[s:e] for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


class Numbers:
    """Numbers for the chunks of a task, none used by another task."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def __call__(self) -> int:
        self.next += 1
        return self.next


CHUNK_SCHEMA = "chunk long, head binary, texts binary"


def write_chunks(documents: DataFrame, written: Callable[[DataFrame, str], DataFrame], tag: str) -> DataFrame:
    """The documents' whole texts in numbered chunks: head packs doc_id (LAST for null), null marks and sizes."""

    def run(batches):
        number, ids, texts, held = Numbers(), [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= CHUNK_BYTES or len(ids) >= 1 << 16:
                    yield _chunk(number(), ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield _chunk(number(), ids, texts)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    return written(docs.mapInArrow(run, CHUNK_SCHEMA), tag)


def _chunk(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    head = pack(np.array([LAST if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array([len(t) for t in texts], np.int64))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([head], pa.binary()), pa.array([join_texts(texts)], pa.binary())], names=["chunk", "head", "texts"])


def opened(head: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """doc_ids, null marks and texts of a chunk."""
    ids, null, sizes = unpack(head)
    return ids, null.astype(bool), cut_texts(texts, sizes)


def by_chunk(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows(chunk, body) and the chunks, brought together: in a task's order the rows of a chunk come before it."""
    both = rows.select("chunk", "body", F.lit(None).cast("binary").alias("head"), F.lit(None).cast("binary").alias("texts"), F.lit(0).alias("kind")).unionByName(
        chunks.select("chunk", F.lit(None).cast("binary").alias("body"), "head", "texts", F.lit(1).alias("kind"))
    )
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").drop("kind")


def gathered(batches) -> Iterator[tuple[int, list[bytes], bytes, bytes]]:
    """Over by_chunk(): number, bodies, head and texts of each chunk."""
    bodies: list[bytes] = []
    for batch in batches:
        for number, body, head, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if head is None:
                bodies.append(body)
            else:
                yield number, bodies, head, texts
                bodies = []


def dealing(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of parts shuffle partitions a value that a repartition by hash sends there, so that buckets are dealt evenly."""
    values = spark.range(20 * parts + 200).select(F.col("id").cast("int").alias("v"))
    rows = values.groupBy(F.pmod(F.hash("v"), F.lit(parts)).alias("p")).agg(F.min("v").alias("v")).collect()
    out = np.arange(parts)
    for r in rows:
        out[r["p"]] = r["v"]
    return out


def text_bytes(documents: DataFrame) -> int:
    return int(documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)


def bucket_count(spark: SparkSession, size: int, bucket_bytes: int) -> tuple[int, int]:
    """Shuffle partitions, and buckets of about bucket_bytes each, as many for every partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts, -(-max(parts, -(-size // bucket_bytes)) // parts) * parts
