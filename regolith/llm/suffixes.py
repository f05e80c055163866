"""Repeated byte strings across documents, found by suffix sorting in buckets.

Every string of WIDTH bytes has a minimiser, the smallest hash among the GRAM-byte strings in it; equal strings
share it, so all that start in a document with a smaller doc_id and elsewhere meet in the minimiser's bucket.

1. The minimisers of every chunk of texts go to their buckets as sorted packed runs. Those of one document alone are
   out: their strings repeat nowhere. The others are told to the chunks that hold them.
2. Consecutive strings that share such a minimiser travel as one piece of text. A minimiser of more than HOT
   occurrences sends its strings by their own hashes instead, so a common line fills no bucket; equal pieces of
   a chunk are sent once, for the smallest document.
3. A bucket sorts the suffixes of its distinct pieces in two stages: suffixes that are smaller than their successors
   directly, the rest by scans of the first-byte buckets. Adjacent suffixes with a common prefix of WIDTH are
   equal strings; a string repeats where the smallest document among its equals is smaller than its own.

Sorting is as deep as WIDTH bytes, all that the comparison asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import written
from regolith.llm.runs import LAST, bucket_count, by_chunk, dealing, gathered, join_texts, narrow, opened, pack, text_bytes, unpack, write_chunks
from regolith.llm.wordstream import mix

WIDTH = 50
GRAM = 24
#: Strings of one piece at most.
RUN = 64
#: Occurrences beyond which a minimiser's strings go by their own hashes.
HOT = 20_000
#: Bytes of all texts for each bucket, and of pieces in one suffix sort (a bucket that holds more is sorted in parts).
BUCKET_BYTES = 12 << 20
SORT_BYTES = 8 << 20
_HASH = np.uint64((1 << 48) - 1)
_END = 0xFF  # in no UTF-8 text
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


# --- sorting ---------------------------------------------------------------------------------------------------


def packed_prefixes(codes: np.ndarray, bits: int) -> np.ndarray:
    """For every position the next 64 // bits codes in one number, zeros past the end; it orders as they do."""
    n, width = len(codes), 64 // bits
    out, have = codes.astype(np.uint64), 1
    while have < width:
        step = min(have, width - have)
        ahead = np.zeros(n, np.uint64)
        ahead[: max(n - have, 0)] = out[have:]
        out = (out << np.uint64(bits * step)) | (ahead >> np.uint64(bits * (have - step)))
        have += step
    return out


def _sorted_directly(at: np.ndarray, prefixes: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Positions ordered by their first depth codes; those still equal stay in ascending order of a round."""
    width = 64 // bits
    pad = np.concatenate((prefixes, np.zeros(depth + width, np.uint64)))
    keys = pad[at]
    order = np.argsort(keys)
    at, keys = at[order], keys[order]
    tied = np.zeros(len(at) + 1, bool)
    tied[1:-1] = keys[1:] == keys[:-1]
    live = np.flatnonzero(tied[1:] | tied[:-1])
    group = np.cumsum(~tied[:-1])[live].astype(np.uint64)
    done = width
    while len(live) and done < depth:
        group = np.cumsum(np.concatenate(([False], group[1:] != group[:-1]))).astype(np.uint64)
        room = 64 - max(int(group[-1]).bit_length(), 1)
        take = min(room // bits, width, depth - done)
        part = pad[at[live] + done] >> np.uint64(bits * (width - take))
        key = (group << np.uint64(bits * take)) | part
        order = np.argsort(key)
        at[live] = at[live][order]
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        keep = same[1:] | same[:-1]
        group, live = np.cumsum(~same[:-1])[keep].astype(np.uint64), live[keep]
        done += take
    return at


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes of a byte text in the order of their first depth bytes, packed prefixes of all positions, bits of a code.

    Suffixes smaller than their successors are sorted directly and put at the ends of their first-byte buckets;
    a scan of the buckets in order puts each other suffix behind what its bucket holds so far, when its
    successor is met. The text's end is smaller than any byte.
    """
    n = len(text)
    present = np.zeros(256, bool)
    present[text] = True
    code_of = np.cumsum(present).astype(np.uint8)  # from 1: 0 is the end
    codes = code_of[text]
    bits = max(int(present.sum()).bit_length(), 1)
    prefixes = packed_prefixes(codes, bits)
    if not n:
        return np.zeros(0, np.int64), prefixes, bits

    steps = np.flatnonzero(codes[1:] != codes[:-1])
    first = np.concatenate(([0], steps + 1))
    rises = np.concatenate((codes[steps] < codes[steps + 1], [False]))
    smaller = np.repeat(rises, np.diff(np.append(first, n)))  # than the successor

    sizes = np.bincount(codes, minlength=257)
    ends = np.cumsum(sizes)
    front = ends - sizes
    order = np.empty(n, np.int64)
    direct = _sorted_directly(np.flatnonzero(smaller), prefixes, bits, depth)
    counts = np.bincount(codes[direct], minlength=257)
    behind = np.cumsum(counts) - counts
    order[np.arange(len(direct)) - behind[codes[direct]] + (ends - counts)[codes[direct]]] = direct

    def induce(met: np.ndarray) -> None:
        before = met - 1
        before = before[met > 0]
        before = before[~smaller[before]]
        if not len(before):
            return
        c = codes[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        got = np.bincount(c, minlength=257)
        order[np.arange(len(c)) - (np.cumsum(got) - got)[c] + front[c]] = before
        front[:] += got

    begin = front.copy()
    induce(np.array([n]))
    for c in range(1, int(codes.max()) + 1):
        at = begin[c]
        while at < front[c]:  # what is put here meanwhile is scanned too
            upto = front[c]
            induce(order[at:upto])
            at = upto
        induce(order[ends[c] - counts[c] : ends[c]])
    return order, prefixes, bits


def common_prefixes(order: np.ndarray, prefixes: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Whether each suffix and the one before it in the order have a common prefix of depth bytes."""
    width = 64 // bits
    pad = np.concatenate((prefixes, np.zeros(depth + width, np.uint64)))
    equal = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for done in range(0, depth, width):
        shift = np.uint64(bits * max(width - (depth - done), 0))
        live = live[pad[order[live] + done] >> shift == pad[order[live - 1] + done] >> shift]
    equal[live] = True
    return equal


def smallest_owners(pieces: list[bytes], owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string of width bytes within the pieces the smallest owner of an equal one; where each piece's strings begin."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = bytes([_END])
    text = np.frombuffer(end.join(pieces) + end, np.uint8)
    start = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - width + 1
    place = np.cumsum(windows) - windows
    order, prefixes, bits = suffix_order(text, width)
    piece_of = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = order - start[piece_of[order]]
    whole = offset < windows[piece_of[order]]
    order, offset = order[whole], offset[whole]
    piece = piece_of[order]
    new = ~common_prefixes(order, prefixes, bits, width)
    smallest = np.minimum.reduceat(owners[piece], np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else owners[:0]
    out = np.empty(int(windows.sum()), np.int64)
    out[place[piece] + offset] = smallest
    return out, place


# --- minimisers ------------------------------------------------------------------------------------------------


class Strings:
    """The texts of a chunk in one buffer, and the minimisers of its strings."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.data = b"\xff".join(texts) + bytes([_END]) + bytes(width + 8)
        self.width, self.gram = width, gram
        self.words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,)).copy()

    def _hash(self, at, size: int) -> np.ndarray:
        """Hash of the size bytes (8 or more) at the positions (a slice or an array)."""
        take = (lambda o: self.words[at.start + o : at.stop + o]) if isinstance(at, slice) else (lambda o: self.words[at + o])
        out = None
        for k, o in enumerate([*range(0, size - 8, 8), size - 8]):
            part = (take(o) ^ np.uint64(k * 0x51ED27)) * _MULTIPLIERS[k % 7]
            part ^= part >> np.uint64(31)
            out = part if out is None else (out * np.uint64(0xBF58476D1CE4E5B9)) ^ part
        return mix(out)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of at most RUN strings of a text that share a minimiser: text, first position, strings, minimiser."""
        none = np.zeros(0, np.int64)
        n = int(self.begin[-1] + self.sizes[-1]) if len(self.sizes) else 0
        long = np.flatnonzero(self.sizes >= self.width)
        if not len(long):
            return none, none, none, none.view(np.uint64)
        least = self._hash(slice(0, n - self.gram + 1), self.gram) & _HASH
        have, span = 1, self.width - self.gram + 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        windows = self.sizes[long] - self.width + 1
        at = np.repeat(self.begin[long] - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        owner = np.repeat(long, windows)
        low = least[at]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])))
        first = np.flatnonzero(new)
        new[first[np.cumsum(new) - 1] + (np.arange(len(at)) - first[np.cumsum(new) - 1]) // RUN * RUN] = True
        first = np.flatnonzero(new)
        return owner[first], at[first], np.diff(np.append(first, len(at))), low[first]


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of the keys of each bucket."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    for name, part in zip(names.tolist(), np.split(order, at[1:]), strict=True):
        yield name, part


_ROWS = "dealt int, bucket int, chunk long, body binary"
_REPLY = "chunk long, body binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    d, b, c, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(body, pa.binary())], names=["dealt", "bucket", "chunk", "body"])


def _replies(rows: list[tuple]) -> pa.RecordBatch:
    c, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(body, pa.binary())], names=["chunk", "body"])


def _buckets(batches) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows (chunk, body) of each bucket; those of bucket -1 come in small lots."""
    bucket, held = None, []
    for batch in batches:
        for b, c, body in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            if held and (b != bucket or (b < 0 and len(held) >= 256)):
                yield bucket, held
                held = []
            bucket = b
            held.append((c, body))
    if held:
        yield bucket, held


def _shared_minimisers(chunks: DataFrame, parts: int, buckets: int, deal: np.ndarray, width: int, gram: int, hot: int) -> DataFrame:
    """(chunk, body): minimisers of the chunk that more than one document has, those of over hot occurrences marked."""

    def ask(batches):
        for batch in batches:
            for number, head, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, _, texts = opened(head, texts)
                owner, _, _, low = Strings(texts, width, gram).runs()
                if not len(low):
                    continue
                order = np.argsort(low)
                low, owner = low[order], ids[owner[order]]
                first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
                count = np.diff(np.append(first, len(low)))
                several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                low = low[first]
                rows = []
                for bucket, of in _by_bucket(low, buckets):
                    body = pack((low[of] // np.uint64(buckets)).astype(np.int64), narrow(np.where(several[of], -count[of], count[of])))
                    rows.append((int(deal[bucket % parts]), bucket, number, body))
                yield _batch(rows)

    def answer(batches):
        for bucket, held in _buckets(batches):
            runs = [unpack(body) for _, body in held]
            keys, counts = np.concatenate([r[0] for r in runs]), np.concatenate([r[1].astype(np.int64) for r in runs])
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
            total = np.add.reduceat(np.abs(counts[order]), first)
            shared = (np.diff(np.append(first, len(keys))) > 1) | (np.minimum.reduceat(counts[order], first) < 0)
            known, often = keys[order][first][shared], total[shared] > hot
            rows = []
            for (number, _), run in zip(held, runs, strict=True):
                at = np.searchsorted(known, run[0])
                at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == run[0])] if len(known) else at[:0]
                if len(at):
                    rows.append((number, pack(known[at] * buckets + bucket, often[at].astype(np.uint8))))
                if len(rows) >= 64:
                    yield _replies(rows)
                    rows = []
            if rows:
                yield _replies(rows)

    asked = chunks.mapInArrow(ask, _ROWS).repartition(parts, "dealt").sortWithinPartitions("bucket")
    return asked.mapInArrow(answer, _REPLY)


def _equal_pieces(data: bytes, at: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, list[bytes]]:
    """For each piece the index of the first that is equal, by its bytes; and the pieces."""
    pieces = [data[s:e] for s, e in zip(at.tolist(), (at + count + width - 1).tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(p, i) for i, p in enumerate(pieces)), np.int64, len(pieces)), pieces


def _send(number: int, bodies: list[bytes], head: bytes, texts: bytes, parts: int, buckets: int, deal: np.ndarray, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a chunk for the buckets, and (bucket -1) the spans that repeat within it."""
    if not bodies:
        return
    ids, _, texts = opened(head, texts)
    strings = Strings(texts, width, gram)
    owner, at, count, low = strings.runs()
    known, often = (np.concatenate(x) for x in zip(*map(unpack, bodies), strict=True))
    order = np.argsort(known)
    known, often = known[order].view(np.uint64), often[order].astype(bool)
    found = np.minimum(np.searchsorted(known, low), len(known) - 1)
    shared = known[found] == low
    owner, at, count, low, often = owner[shared], at[shared], count[shared], low[shared], often[found[shared]]

    # of equal pieces that of the smallest document goes, in the others all is repeated
    same, pieces = _equal_pieces(strings.data, at, count, width)
    smallest = np.full(len(at), LAST)
    np.minimum.at(smallest, same, ids[owner])
    repeated = ids[owner] > smallest[same]
    if repeated.any():
        body = pack(owner[repeated], at[repeated] - strings.begin[owner[repeated]], count[repeated] + width - 1)
        yield _batch([(int(deal[number % parts]), -1, number, body)])
    keep = ~repeated
    owner, at, count, low, often = (x[keep] for x in (owner, at, count, low, often))
    pieces = [p for p, k in zip(pieces, keep.tolist(), strict=True) if k]

    if often.any():  # their strings one by one, each under its own hash
        n = count[often]
        lone = np.repeat(at[often] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        lone_owner = np.repeat(owner[often], n)
        pieces = [p for p, o in zip(pieces, often.tolist(), strict=True) if not o]
        same, singles = _equal_pieces(strings.data, lone, np.ones(len(lone), np.int64), width)
        smallest = np.full(len(lone), LAST)
        np.minimum.at(smallest, same, ids[lone_owner])
        again = ids[lone_owner] > smallest[same]
        if again.any():
            body = pack(lone_owner[again], lone[again] - strings.begin[lone_owner[again]], np.full(int(again.sum()), width))
            yield _batch([(int(deal[number % parts]), -1, number, body)])
        lone, lone_owner = lone[~again], lone_owner[~again]
        pieces += [p for p, a in zip(singles, again.tolist(), strict=True) if not a]
        low = np.concatenate((low[~often], strings._hash(lone, width) & _HASH))
        owner, at, count = (np.concatenate(x) for x in ((owner[~often], lone_owner), (at[~often], lone), (count[~often], np.ones(len(lone), np.int64))))

    rows = []
    for bucket, of in _by_bucket(low, buckets):
        of = of[np.lexsort((at[of], low[of] // np.uint64(buckets) % np.uint64(256)))]
        fine = (low[of] // np.uint64(buckets) % np.uint64(256)).astype(np.uint8)
        parts_of = [pieces[i] for i in of.tolist()]
        lists = pack(fine, ids[owner[of]], narrow(owner[of]), narrow(at[of] - strings.begin[owner[of]]), narrow(count[of]))
        rows.append((int(deal[bucket % parts]), bucket, number, len(lists).to_bytes(8, "little") + lists + join_texts(parts_of)))
        if len(rows) >= 64:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _receive(batches, width: int, sort_bytes: int) -> Iterator[pa.RecordBatch]:
    """(chunk, body): spans of repeated strings, from each bucket's suffix sorts."""
    for bucket, held in _buckets(batches):
        if bucket < 0:
            yield _replies(held)
            continue
        lists, raws = [], []
        for _, body in held:
            cut = 8 + int.from_bytes(body[:8], "little")
            fine, ids, owner, at, count = unpack(body[8:cut])
            lists.append((fine, ids, owner.astype(np.int64), at.astype(np.int64), count.astype(np.int64)))
            raws.append(zstandard.ZstdDecompressor().decompress(body[cut:]))
        fine, ids, owner, at, count = (np.concatenate(x) for x in zip(*lists, strict=True))
        source = np.repeat(np.arange(len(held)), [len(x[0]) for x in lists])
        size = count + width - 1
        ends = np.concatenate([np.cumsum(x[4] + width - 1) for x in lists])
        weight = np.cumsum(np.bincount(fine, size, 256))
        lot = (weight // sort_bytes).astype(np.int64)  # equal strings have one value of fine
        for part in np.unique(lot[fine]).tolist():
            of = np.flatnonzero(lot[fine] == part)
            seen: dict[bytes, int] = {}
            distinct = np.fromiter((seen.setdefault(raws[s][e - z : e], len(seen)) for s, e, z in zip(source[of].tolist(), ends[of].tolist(), size[of].tolist(), strict=True)), np.int64, len(of))
            smallest = np.full(len(seen), LAST)
            np.minimum.at(smallest, distinct, ids[of])
            best, place = smallest_owners(list(seen), smallest, width)
            n = count[of]
            index = np.repeat(place[distinct] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            piece = np.repeat(np.arange(len(of)), n)
            step = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(best[index] < ids[of][piece])
            if not len(hit):
                continue
            fresh = np.concatenate(([True], (np.diff(hit) != 1) | (piece[hit][1:] != piece[hit][:-1])))
            first = np.flatnonzero(fresh)
            length = np.diff(np.append(first, len(hit))) + width - 1
            p = piece[hit[first]]
            row, begin, chunk = owner[of][p], at[of][p] + step[hit[first]], source[of][p]
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order])) + 1
            rows = [(held[int(chunk[o[0]])][0], pack(row[o], begin[o], length[o])) for o in np.split(order, cuts)]
            for k in range(0, len(rows), 256):
                yield _replies(rows[k : k + 256])


def _finish(batches) -> Iterator[pa.RecordBatch]:
    for _, bodies, head, texts in gathered(batches):
        ids, null, texts = opened(head, texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        cover = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
        for row, at, length in map(unpack, bodies):
            np.add.at(cover, begin[row] + at, 1)
            np.add.at(cover, begin[row] + at + length, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed, spans, kept = [], [], []
        for t, b in zip(texts, begin.tolist(), strict=True):
            g = gone[b : b + len(t)]
            n = int(g.sum())
            removed.append(n)
            spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0)
            kept.append(np.frombuffer(t, np.uint8)[~g].tobytes() if n else t)
        for k in range(0, len(texts), 4096):
            part = slice(k, k + 4096)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[part], pa.int64(), mask=null[part]), pa.array(sizes[part], pa.int64()),
                    pa.array(removed[part], pa.int64()), pa.array(spans[part], pa.int64()), pa.array(kept[part], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining UTF-8 bytes, binary).

    Removed is each byte covered by a string of width bytes that also starts in a row of a smaller doc_id; strings
    are judged on the input. Of rows that share a doc_id none repeats the other. A null doc_id counts as larger
    than any other and stays null; null texts count as empty; texts shorter than width lose nothing. Matches do
    not cross documents. Repeated rows, further columns and an empty table are harmless.
    """
    spark = documents.sparkSession
    parts, buckets = bucket_count(spark, text_bytes(documents), bucket_bytes)
    deal = dealing(spark, parts)
    chunks = write_chunks(documents, written, "chunks")
    shared = _shared_minimisers(chunks, parts, buckets, deal, width, gram, hot)

    def send(batches):
        for found in gathered(batches):
            yield from _send(*found, parts, buckets, deal, width, gram)

    def receive(batches):
        return _receive(batches, width, sort_bytes)

    sent = by_chunk(shared, chunks).mapInArrow(send, _ROWS)
    spans = sent.repartition(parts, "dealt").sortWithinPartitions("bucket").mapInArrow(receive, _REPLY)
    return by_chunk(spans, chunks).mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
