"""Alignment of two tokenizers over a corpus, by external spill counting.

Each chunk of documents is encoded by both vocabularies. Byte offsets where tokens of both end cut a document into
groups; each stretch between neighbouring ends of either is one link of an A token and a B token. The chunk's
(id pair, document) records are radix-partitioned by A id, sorted and written as compressed runs: a head with
the pairs and their numbers of documents, a body with the documents and how often each holds the pair.

Heads of a partition meet and are merged by a heap over their blocks, A id by A id, which counts every pair and knows
each A id's highest count as soon as the id is passed. Then the written runs stream past the counts, each
contributing sums for the documents of its chunk. Heads hold a pair once for a chunk, and the runs of a partition
are dealt over as many tasks as needed, so a frequent id gathers nowhere.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import written
from regolith.llm.runs import CHUNK_BYTES, Numbers, bucket_count, dealing, deltas, narrow, pack, text_bytes, unpack
from regolith.llm.wordstream import mix

#: Bytes of all texts for each partition of the pairs.
BUCKET_BYTES = 32 << 20
#: Runs of a partition for each task that they stream through.
RUNS_PER_TASK = 2_000
#: Runs merged at a time, and records of a block of them.
FAN, BLOCK = 128, 1 << 15
#: Fixed value: the split of texts before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Side:
    """A vocabulary: encode(text) gives ids, token_bytes the bytes of each."""

    def __init__(self, encode: Callable[[str], np.ndarray], token_bytes: list[bytes]):
        self.encode, self.token_bytes = encode, token_bytes
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)

    def covers(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())) == text


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level(path: str) -> Side:
    """A byte-level vocabulary of a tokenizers file, its ids being the order of its merges; texts get a space before them."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", []) if t.get("special")}
    letters = _byte_letters()
    vocabulary = model["model"]["vocab"]
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        table[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    ranks = {table[i]: i for t, i in vocabulary.items() if t not in special}
    coder = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda text: np.array(coder.encode_ordinary(" " + text), np.int64), table)


def piece_level(path: str) -> Side:
    """A sentencepiece vocabulary that puts a space before texts itself."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(pieces.get_piece_size()):
        p = pieces.id_to_piece(i)
        table.append(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
    return Side(lambda text: np.array(pieces.encode(text), np.int64), table)


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}


def load(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Both vocabularies, read once for each worker."""
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = byte_level(a_path), piece_level(b_path)
    return _sides[a_path, b_path]


_DIGITS = np.array([[ord(c) for c in f"{i:06d}"] + [0] for i in range(100_000)], np.uint8)
_SHOWN = np.array([[k >= 6 - len(str(i)) for k in range(6)] + [True] for i in range(100_000)])


def _digit_tables(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..top in rows, right-justified, with a place for what follows; and which of them show."""
    if top < len(_DIGITS):
        return _DIGITS, _SHOWN
    size = len(str(top))
    return (
        np.array([[ord(c) for c in f"{i:0{size}d}"] + [0] for i in range(top + 1)], np.uint8),
        np.array([[k >= size - len(str(i)) for k in range(size)] + [True] for i in range(top + 1)]),
    )


class Aligned:
    """Groups and links of the documents of a chunk; a document without tokens has neither."""

    def __init__(self, texts: list[str | None], a: Side, b: Side):
        n, none = len(texts), np.zeros(0, np.int64)
        ids_a, ids_b = [none] * n, [none] * n
        for k, text in enumerate(texts):
            if text:
                data = b" " + text.encode()
                x, y = a.encode(text), b.encode(text)
                if a.covers(x, data) and b.covers(y, data):
                    ids_a[k], ids_b[k] = x, y
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
        end_a, end_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        doc_a = np.repeat(np.arange(n), self.n_a)
        at = np.searchsorted(end_b, end_a)
        self.cut_a = end_b[np.minimum(at, max(len(end_b) - 1, 0))] == end_a if len(end_b) else np.zeros(0, bool)
        self.cut_b = np.zeros(len(end_b), bool)
        self.cut_b[at[self.cut_a]] = True
        self.n_groups = np.bincount(doc_a[self.cut_a], minlength=n)
        # one link for each stretch between neighbouring ends
        ends = np.sort(np.concatenate((end_a, end_b[~self.cut_b])))
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        self.link_doc = doc_a[link_a]
        self.links = (self.a[link_a] << 32) | self.b[link_b]
        self.n_links = np.bincount(self.link_doc, minlength=n)

    def group_hashes(self) -> list[str]:
        """sha256 of "a1,a2|b1;..." of each document; empty without tokens."""
        cum_a, cum_b = (np.concatenate(([0], np.flatnonzero(c) + 1)) for c in (self.cut_a, self.cut_b))
        group_a = np.cumsum(self.cut_a) - self.cut_a
        group_b = np.cumsum(self.cut_b) - self.cut_b
        total = len(self.a) + len(self.b)
        ids, after = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        place_a, place_b = np.arange(len(self.a)) + cum_b[group_a], np.arange(len(self.b)) + cum_a[group_b + 1]
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[self.cut_a]], after[place_b[self.cut_b]] = ord("|"), ord(";")
        digits, shown = _digit_tables(int(ids.max()) if total else 0)
        out, step, upto = [], 1 << 18, np.cumsum(self.n_a + self.n_b)
        pieces, sizes = [], np.empty(total, np.int64)
        for s in range(0, total, step):
            part = digits[ids[s : s + step]]
            part[:, -1] = after[s : s + step]
            show = shown[ids[s : s + step]]
            sizes[s : s + step] = show.sum(axis=1)
            pieces.append(part[show].tobytes())
        text, ends = b"".join(pieces), np.concatenate(([0], np.cumsum(sizes)))
        for s, e in zip((upto - self.n_a - self.n_b).tolist(), upto.tolist(), strict=True):
            out.append(hashlib.sha256(text[ends[s] : ends[e] - 1]).hexdigest() if e > s else "")
        return out


def _radix(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Partition of each pair, by its A id."""
    return (mix((keys >> 32).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _runs(aligned: Aligned, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Partition, head and body of the sorted runs of a chunk."""
    order = np.lexsort((aligned.link_doc, aligned.links))
    keys, docs = aligned.links[order], aligned.link_doc[order]
    new_pair = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    new = new_pair.copy()
    new[1:] |= docs[1:] != docs[:-1]
    record = np.flatnonzero(new)
    often = np.diff(np.append(record, len(keys)))
    docs, pair = docs[record], np.flatnonzero(new_pair[record])
    n_docs = np.diff(np.append(pair, len(record)))
    keys = keys[record][pair]
    bucket = _radix(keys, buckets)
    by = np.argsort(bucket, kind="stable")
    for of in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        if len(of):
            n = n_docs[of]
            rows = np.repeat(pair[of] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield int(bucket[of[0]]), pack(deltas(keys[of]), narrow(n)), pack(narrow(docs[rows]), narrow(often[rows]))


_TOKENS = "bucket int, chunk long, head binary, body binary"


def _encode(batches, load_sides: Callable[[], tuple[Side, Side]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs of each chunk, and in bucket -1 what is known of its documents."""
    number = Numbers()
    a, b = load_sides()

    def chunk(ids, texts):
        aligned, at = Aligned(texts, a, b), number()
        hashes = aligned.group_hashes()
        null = np.array([i is None for i in ids], np.uint8)
        known = pack(np.array([i or 0 for i in ids], np.int64), null, aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links, np.frombuffer("".join(hashes).encode(), np.uint8))
        rows = [(-1, at, None, known), *((p, at, head, body) for p, head, body in _runs(aligned, buckets))]
        for k in range(0, len(rows), 64):
            p, c, head, body = zip(*rows[k : k + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.int64()), pa.array(head, pa.binary()), pa.array(body, pa.binary())], names=["bucket", "chunk", "head", "body"])

    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t or "")
            if held >= CHUNK_BYTES or len(ids) >= 1 << 15:
                yield from chunk(ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield from chunk(ids, texts)


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending (keys, counts), equal keys added up, from runs of ascending keys by a heap over their blocks."""
    runs = [r for r in runs if len(r[0])]
    heap = [(int(keys[min(block, len(keys)) - 1]), k) for k, (keys, _) in enumerate(runs)]
    heapq.heapify(heap)
    at = [0] * len(runs)
    while heap:
        upto = heap[0][0]  # no block that ends here or later hides a smaller key
        parts = []
        for k in [x[1] for x in heap]:
            keys, counts = runs[k]
            cut = at[k] + int(np.searchsorted(keys[at[k] : at[k] + block], upto, side="right"))
            if cut > at[k]:
                parts.append((keys[at[k] : cut], counts[at[k] : cut]))
                at[k] = cut
        while heap and heap[0][0] == upto:
            _, k = heapq.heappop(heap)
            if at[k] < len(runs[k][0]):
                heapq.heappush(heap, (int(runs[k][0][min(at[k] + block, len(runs[k][0])) - 1]), k))
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        yield keys[first], np.add.reduceat(counts[order], first)


def _whole(runs) -> tuple[np.ndarray, np.ndarray]:
    parts = list(merge_runs(runs))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2


class Merger:
    """Takes runs one by one and keeps at most FAN of each generation: equal pairs of many runs are soon one."""

    def __init__(self):
        self.generations: list[list] = [[]]

    def add(self, run, generation: int = 0) -> None:
        if generation == len(self.generations):
            self.generations.append([])
        self.generations[generation].append(run)
        if len(self.generations[generation]) >= FAN:
            runs, self.generations[generation] = self.generations[generation], []
            self.add(_whole(runs), generation + 1)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs in order, their counts, and whether no pair of the A id has a higher one."""
        keys, counts, best = [], [], []
        held_keys, held_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def close(k, c):
            if len(k):
                first = np.flatnonzero(np.concatenate(([True], (k[1:] >> 32) != (k[:-1] >> 32))))
                top = np.repeat(np.maximum.reduceat(c, first), np.diff(np.append(first, len(k))))
                keys.append(k), counts.append(c), best.append((c == top).astype(np.uint8))

        for k, c in merge_runs([r for g in self.generations for r in g]):
            k, c = np.concatenate((held_keys, k)), np.concatenate((held_counts, c))
            whole = int(np.searchsorted(k, (k[-1] >> 32) << 32))  # the last A id may go on in the next block
            close(k[:whole], c[:whole])
            held_keys, held_counts = k[whole:], c[whole:]
        close(held_keys, held_counts)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts, best))


def pair_counts(tokens: DataFrame, parts: int, deal: np.ndarray) -> DataFrame:
    """(bucket, body): all pairs of a partition with their counts and best marks."""

    def run(batches):
        bucket, merger = None, Merger()

        def close():
            keys, counts, best = merger.counts()
            body = pack(deltas(keys), narrow(counts), best.astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], names=["bucket", "body"])

        for batch in batches:
            for b, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket is not None and b != bucket:
                    yield close()
                    merger = Merger()
                bucket = b
                keys, n = unpack(head)
                merger.add((np.cumsum(keys, dtype=np.int64), n.astype(np.int64)))
        if bucket is not None:
            yield close()

    heads = tokens.where("bucket >= 0").select("bucket", "head")
    return heads.withColumn("dealt", _dealt(deal, parts)).repartition(parts, "dealt").sortWithinPartitions("bucket").select("bucket", "head").mapInArrow(run, "bucket int, body binary")


def _dealt(deal: np.ndarray, parts: int):
    return F.element_at(F.array(*(F.lit(int(x)) for x in deal)), (F.pmod(F.col("bucket"), F.lit(parts)) + 1).cast("int"))


def _contributions(tokens: DataFrame, counts: DataFrame, parts: int, runs: int) -> DataFrame:
    """(chunk, body): per document of a chunk and partition the links of highest count, and the counts summed over links."""
    spread = -(-runs // RUNS_PER_TASK)
    none = F.lit(None).cast("binary")
    known = counts.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"), F.lit(-1).cast("long").alias("chunk"), none.alias("head"), "body")
    asked = tokens.where("bucket >= 0").select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(spread)).cast("int").alias("part"), "chunk", "head", "body")

    def run(batches):
        keys = total = best = None
        for batch in batches:
            rows = []
            for chunk, head, body in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if chunk < 0:
                    keys, total, best = unpack(body)
                    keys, total, best = np.cumsum(keys, dtype=np.int64), total.astype(np.int64), best.astype(np.int64)
                    continue
                pairs, n = unpack(head)
                docs, often = unpack(body)
                at = np.searchsorted(keys, np.cumsum(pairs, dtype=np.int64))
                docs, often = docs.astype(np.int64), often.astype(np.int64)
                sums = np.zeros((2, int(docs.max()) + 1), np.int64)
                np.add.at(sums[0], docs, often * np.repeat(best[at], n))
                np.add.at(sums[1], docs, often * np.repeat(total[at], n))
                some = np.flatnonzero(sums[1])
                rows.append((chunk, pack(deltas(some), narrow(sums[0, some]), narrow(sums[1, some]))))
            for k in range(0, len(rows), 256):
                c, body = zip(*rows[k : k + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(body, pa.binary())], names=["chunk", "body"])

    both = known.unionByName(asked).repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part", "chunk")
    return both.mapInArrow(run, "chunk long, body binary")


def _finish(batches) -> Iterator[pa.RecordBatch]:
    bodies: list[bytes] = []
    for batch in batches:
        for body, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not kind:
                bodies.append(body)
                continue
            ids, null, n_a, n_b, n_groups, n_links, marks = unpack(body)
            sums = np.zeros((2, len(ids)), np.int64)
            for some, best, total in map(unpack, bodies):
                some = np.cumsum(some, dtype=np.int64)
                sums[0, some] += best
                sums[1, some] += total
            bodies = []
            text, held = marks.tobytes().decode(), np.cumsum(n_a > 0)
            hashes = [text[64 * (k - 1) : 64 * k] if n else "" for k, n in zip(held.tolist(), n_a.tolist(), strict=True)]
            columns = (n_a, n_b, n_groups, n_links, *sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=null.astype(bool)), *(pa.array(c.astype(np.int64), pa.int64()) for c in columns), pa.array(hashes, pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def align(documents: DataFrame, a_path: str, b_path: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A document is a row: rows that repeat a doc_id or a text count each, a null doc_id stays null. Null and empty
    texts, and texts that either vocabulary does not give back byte for byte, have no tokens and zeros, and an
    empty hash. Of equal counts of an A id all are its highest. Further columns and an empty table are harmless.
    The vocabulary files are read on every machine from a_path and b_path.
    """
    return _align(documents, lambda: load(a_path, b_path), bucket_bytes)


def _align(documents: DataFrame, load_sides: Callable[[], tuple[Side, Side]], bucket_bytes: int) -> DataFrame:
    spark = documents.sparkSession
    parts, buckets = bucket_count(spark, text_bytes(documents), bucket_bytes)

    def encode(batches):
        return _encode(batches, load_sides, buckets)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = written(docs.mapInArrow(encode, _TOKENS), "tokens")
    chunks = tokens.where("bucket < 0").select("chunk", "body", F.lit(1).alias("kind"))
    counts = pair_counts(tokens, parts, dealing(spark, parts))
    sums = _contributions(tokens, counts, parts, chunks.count())
    both = sums.select("chunk", "body", F.lit(0).alias("kind")).unionByName(chunks)
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(
        _finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
