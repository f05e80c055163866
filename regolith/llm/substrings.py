"""Repeated windows of words across documents, found by super-k-mer partitioning.

Consecutive windows that share a minimiser (the smallest hash among the m-word runs inside) are packed
as one string of words and sent to the bucket of the minimiser, so equal windows always meet. Sorting
the windows of a bucket counts them exactly and finds the smallest document of each.

Hot passages do not make hot buckets. Before a string travels, equal ones of a chunk of text are
combined to the one of the smallest document; in the others all of its windows are repeats already.
And m-word runs that take more than one in FREQUENT of all strings are passed over as minimisers
while a window has any other, so what surrounds a common line chooses its bucket; a window of frequent
runs alone goes by its own hash, which splits what they would gather. Buckets are as many as the bytes of
all texts ask for, so a task holds one of bounded size at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import row_key, written
from regolith.llm.wordstream import Words, chunks, mix, span_hashes

WINDOW = 13
MINIMISER_WORDS = 3
FREQUENT = 5_000
#: Bytes of text for each bucket.
BUCKET_BYTES = 8 << 20
CHUNK_BYTES = 6 << 20
_LAST = np.int64(2**63 - 1)
_DEMOTED = np.uint64(1 << 63)


def minimisers(words: Words, window: int, m: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that lie within one text, and their minimisers."""
    h = words.hashes()
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = h[: n - m + 1].copy()
    for k in range(1, m):
        runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + h[k : n - m + 1 + k])
    runs >>= np.uint64(1)
    if len(frequent):
        runs[np.isin(runs, frequent)] |= _DEMOTED
    width, least, have = window - m + 1, runs, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    owner = words.owner()
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    low = least[at]
    lost = np.flatnonzero(low >= _DEMOTED)
    if len(lost):
        low[lost] = span_hashes(h, at[lost], at[lost] + window) >> np.uint64(1)
    return at, low


def superkmers(words: Words, window: int, m: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each run of windows that share one."""
    at, low = minimisers(words, window, m, frequent)
    if not len(at):
        return at, at, low
    new = np.flatnonzero((np.diff(at) != 1) | (low[1:] != low[:-1]) | (words.owner()[at[1:]] != words.owner()[at[:-1]])) + 1
    first = np.concatenate(([0], new))
    return at[first], np.diff(np.concatenate((first, [len(at)]))), low[first]


def _key():
    """32 bits that tell apart rows with one doc_id and other texts."""
    return row_key().bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _ids(rows: list[tuple]) -> np.ndarray:
    return np.array([_LAST if r[0] is None else r[0] for r in rows], dtype=np.int64)


def _survey(docs: DataFrame, window: int, m: int) -> tuple[np.ndarray, int]:
    """The minimisers of over one in FREQUENT of all packed strings (at most FREQUENT values), and the bytes of all texts."""

    def run(batches):
        for rows in chunks(batches, CHUNK_BYTES):
            _, _, low = superkmers(Words([r[-1] for r in rows]), window, m, np.zeros(0, np.uint64))
            value, count = np.unique(low, return_counts=True)
            # what is rare in every chunk is rare in all: half the threshold of the chunk is kept
            keep = count * 2 * FREQUENT >= len(low)
            keep &= count >= 4
            none = np.zeros(keep.sum(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(value[keep], np.uint64(0)).view(np.int64)), pa.array(np.append(count[keep], 0)),
                    pa.array(np.append(none, len(low))), pa.array(np.append(none, sum(len(r[-1]) for r in rows))),
                ],
                names=["low", "n", "total", "bytes"],
            )

    counts = docs.select("data").mapInArrow(run, "low long, n long, total long, bytes long").groupBy("low").agg(*(F.sum(c).alias(c) for c in ("n", "total", "bytes")))
    counts = written(counts, "frequent")
    total, size = counts.agg(F.sum("total"), F.sum("bytes")).first()
    got = counts.where((F.col("n") > 0) & (F.col("n") * FREQUENT > (total or 0)) & (F.col("n") >= 16)).select("low").collect()
    return np.array(sorted(r["low"] for r in got), dtype=np.int64).view(np.uint64), int(size or 0)


def _pack(low: np.ndarray, head: np.ndarray, texts: list[bytes]) -> bytes:
    """Records of one bucket as one compressed string: minimisers, keys, ids, (first word, windows, bytes), packed words.

    Minimisers and row keys do not compress, so 32 bits of each travel.
    """
    ids, keys, at, count = head
    sizes = np.array([at, count, [len(t) for t in texts]], dtype=np.int32)
    raw = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + keys.astype(np.uint32).tobytes() + ids.tobytes() + sizes.tobytes() + b"".join(texts)
    return np.int64(len(low)).tobytes() + zstandard.ZstdCompressor(level=6).compress(raw)


def _unpack(data: bytes):
    n = int(np.frombuffer(data[:8], np.int64)[0])
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    low, keys, ids = np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint32, n, 4 * n), np.frombuffer(raw, np.int64, n, 8 * n)
    sizes = np.frombuffer(raw, np.int32, 3 * n, 16 * n).reshape(3, n).astype(np.int64)
    ends = np.cumsum(sizes[2]) + 28 * n
    return low, np.vstack((ids, keys.astype(np.int64), sizes)), raw, ends - sizes[2], ends


def labels(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of parts shuffle partitions a value that a repartition by hash sends there, so that buckets are dealt evenly."""
    values = spark.range(20 * parts + 200).select(F.col("id").cast("int").alias("v"))
    rows = values.groupBy(F.pmod(F.hash("v"), F.lit(parts)).alias("p")).agg(F.min("v").alias("v")).collect()
    out = np.arange(parts)
    for r in rows:
        out[r["p"]] = r["v"]
    return out


def _spans_batch(spans: list[tuple[int, int, int, int]], bucket: int = -1, dealt: int = 0) -> pa.RecordBatch:
    """Repeats of a document, as rows of the same schema as packed strings."""
    i, k, s, e = zip(*spans, strict=True) if spans else ((), (), (), ())
    n = len(spans)
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket] * n, pa.int32()), pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array([None] * n, pa.binary()), pa.array([dealt] * n, pa.int32())],
        names=["bucket", "id", "row_key", "first", "last", "packed", "dealt"],
    )


_SCHEMA = "bucket int, id long, row_key long, first long, last long, packed binary, dealt int"


def _send(batches, window: int, m: int, frequent: np.ndarray, buckets: int, deal: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed strings for the buckets, and the repeats that a chunk shows by itself."""
    for rows in chunks(batches, CHUNK_BYTES):
        words = Words([b" ".join(r[-1].split()) for r in rows])
        first, count, low = superkmers(words, window, m, frequent)
        if not len(first):
            continue
        end = first + count + window - 1
        owner = words.owner()[first]
        ids = _ids(rows)[owner]
        keys = np.array([r[1] for r in rows], dtype=np.int64)[owner]
        at = first - words.first[owner]
        same = span_hashes(words.hashes(), first, end)
        data, start, stop = words.data, words.starts[first].tolist(), words.ends[end - 1].tolist()

        # equal strings: that of the smallest document travels, the others are repeats of it
        order = np.lexsort((first, ids, count, same))
        fresh = np.concatenate(([True], (same[order][1:] != same[order][:-1]) | (count[order][1:] != count[order][:-1])))
        leader = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        pairs = zip(order[~fresh].tolist(), leader[~fresh].tolist(), strict=True)
        repeat = np.array([data[start[j] : stop[j]] == data[start[i] : stop[i]] for j, i in pairs], dtype=bool) & (ids[order[~fresh]] > ids[leader[~fresh]])
        spans = order[~fresh][repeat]
        travel = np.concatenate((order[fresh], order[~fresh][~repeat]))
        if len(spans):
            yield from _local(zip(ids[spans].tolist(), keys[spans].tolist(), at[spans].tolist(), (at + count + window - 1)[spans].tolist(), strict=True), buckets, deal)

        bucket = (low[travel] % np.uint64(buckets)).astype(np.int64)
        travel = travel[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        texts = [data[start[i] : stop[i]] for i in travel.tolist()]
        head = np.array([ids[travel], keys[travel], at[travel], count[travel]], dtype=np.int64)
        names, begins = np.unique(bucket, return_index=True)
        ends = np.append(begins[1:], len(bucket))
        for k in range(0, len(names), 64):
            packed = [_pack(low[travel[x:y]], head[:, x:y], texts[x:y]) for x, y in zip(begins[k : k + 64].tolist(), ends[k : k + 64].tolist(), strict=True)]
            none = pa.array([None] * len(packed), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[k : k + 64], pa.int32()), none, none, none, none, pa.array(packed, pa.binary()), pa.array(deal[names[k : k + 64] % len(deal)], pa.int32())],
                names=["bucket", "id", "row_key", "first", "last", "packed", "dealt"],
            )


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Union of the spans of each row, touching ones joined."""
    out: list[list] = []
    for i, k, s, e in sorted(spans):
        if out and out[-1][0] == i and out[-1][1] == k and s <= out[-1][3]:
            out[-1][3] = max(out[-1][3], e)
        else:
            out.append([i, k, s, e])
    return [tuple(x) for x in out]


def _local(spans, buckets: int, deal: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A chunk's own repeats, dealt over the buckets."""
    by: dict[int, list] = {}
    for s in merged(spans):
        by.setdefault((s[0] ^ s[1]) % buckets, []).append(s)
    for b, part in by.items():
        yield _spans_batch(part, b, int(deal[b % len(deal)]))


def _repeats(low, ids, keys, at, count, texts, window: int) -> list[tuple[int, int, int, int]]:
    """Repeats among records of one minimiser: windows are sorted, each run's smallest document is kept clean."""
    entries = []
    for r, text in enumerate(texts):
        words = text.split(b" ")
        for k in range(int(count[r])):
            entries.append((b" ".join(words[k : k + window]), int(ids[r]), r, k))
    entries.sort()
    spans, i = [], 0
    while i < len(entries):
        j, smallest = i, entries[i][1]
        while j < len(entries) and entries[j][0] == entries[i][0]:
            if entries[j][1] > smallest:
                _, d, r, k = entries[j]
                spans.append((d, int(keys[r]), int(at[r]) + k, int(at[r]) + k + window))
            j += 1
        i = j
    return spans


def _receive(batches, window: int) -> Iterator[pa.RecordBatch]:
    """Counts the windows of the task's buckets, one bucket after the other (rows are sorted by bucket)."""
    bucket, held = None, []

    def close():
        if len(held) < 1:
            return
        low = np.concatenate([h[0] for h in held])
        head = np.concatenate([h[1] for h in held], axis=1)
        part = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        start, end = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        order = np.argsort(low, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(low[order])) + 1, [len(order)]))
        spans = []
        for g0, g1 in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist(), strict=True):
            of = order[g0:g1]
            if (head[0][of] == head[0][of[0]]).all():
                continue  # one document
            texts = [held[part[r]][2][start[r] : end[r]] for r in of.tolist()]
            spans += _repeats(low, head[0][of], head[1][of], head[2][of], head[3][of], texts, window)
        if spans:
            yield _spans_batch(merged(spans))

    for batch in batches:
        passed = batch.filter(pa.compute.is_valid(batch.column(1)))
        if passed.num_rows:
            yield passed
        for b, packed in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if packed is None:
                continue
            if b != bucket:
                yield from close()
                bucket, held = b, []
            held.append(_unpack(packed))
    yield from close()


def repeated_spans(documents: DataFrame, window: int = WINDOW, m: int = MINIMISER_WORDS) -> DataFrame:
    """Word spans (first, last exclusive) of windows that also start in a document with a smaller doc_id.

    id is doc_id, or the largest long for a null one: such rows repeat others, and none repeats them.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("row_key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    frequent, size = _survey(docs, window, m)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = -(-max(parts, -(-size // BUCKET_BYTES)) // parts) * parts  # as many for each partition
    deal = labels(spark, parts)

    def send(batches):
        return _send(batches, window, m, frequent, buckets, deal)

    def receive(batches):
        return _receive(batches, window)

    dealt = docs.mapInArrow(send, _SCHEMA).repartition(parts, "dealt").sortWithinPartitions("bucket")
    return dealt.mapInArrow(receive, _SCHEMA).select("id", "row_key", "first", "last")


def remove_repeats(documents: DataFrame, window: int = WINDOW, m: int = MINIMISER_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed (words covered by repeated windows), kept_text.

    Windows are judged on the input texts. Of rows that share a doc_id none repeats the other; texts of
    fewer words than a window lose nothing; null texts have no words. A null doc_id counts as larger than
    any other and stays null. Repeated rows and further columns are harmless.
    """
    spans = repeated_spans(documents, window, m).groupBy("id", "row_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = spans.select(F.col("id").alias("_id"), F.col("row_key").alias("_key"), "spans")
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("_id"),
        _key().alias("_key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
    )

    def squeeze(batches):
        for batch in batches:
            data = [zstandard.ZstdCompressor(level=6).compress(b" ".join(t.split())) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=batch.schema.names)

    small = docs.mapInArrow(squeeze, docs.schema)
    joined = small.join(spans, ["_id", "_key"], "left").select("doc_id", F.transform("spans", lambda s: F.array(s["first"], s["last"])).alias("spans"), "data")

    def finish(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for spans, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = zstandard.ZstdDecompressor().decompress(data).split()
                n_words.append(len(words))
                if spans:
                    gone = np.zeros(len(words), bool)
                    for s, e in spans:
                        gone[s:e] = True
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")

