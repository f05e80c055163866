"""Vectorised words of UTF-8 texts: boundaries, hashes and bounded chunks of rows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _geometric(name: str, ratio: np.uint64, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        steps = np.full(max(size, 1 << 16), ratio, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[name] = have
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def boundaries(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte buffer."""
    space = np.ones(len(buf) + 2, dtype=np.int8)
    space[1:-1] = _SPACE[buf]
    edges = np.flatnonzero(np.diff(space))
    return edges[0::2], edges[1::2]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for every span, mixed."""
    size = len(values)
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _geometric("up", _BASE, size), out=total[1:])
    down = _geometric("down", _INVERSE, size + 1)
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + length * np.uint64(0xC2B2AE3D27D4EB4F))


def chunks(batches, size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows of Arrow batches, in lists of about size bytes of the last (binary) column."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = (*row[:-1], row[-1] or b"")
            rows.append(row)
            held += len(row[-1])
            if held >= size:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


class Words:
    """The words of a list of texts, laid out in one buffer."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        self.buf = np.frombuffer(self.data, dtype=np.uint8)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if texts else np.zeros(0, np.int64)
        self.starts, self.ends = boundaries(self.buf) if len(self.buf) else (np.zeros(0, np.int64),) * 2
        first = np.searchsorted(self.starts, self.text_starts)
        self.first = np.concatenate((first, [len(self.starts)]))  # of text i: words first[i]:first[i + 1]
        self.counts = np.diff(self.first)

    def hashes(self, step: int = 1 << 16) -> np.ndarray:
        """Word hashes, made over slices of the buffer to keep the work space small."""
        out = np.zeros(len(self.starts), dtype=np.uint64)
        for at in range(0, len(out), step):
            s, e = self.starts[at : at + step], self.ends[at : at + step]
            out[at : at + step] = span_hashes(self.buf[s[0] : e[-1]], s - s[0], e - s[0])
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)
