"""Cases of the findings of round 4: large shards of fingerprints and large sets that share a shingle."""

import numpy as np
import pytest

from regolith.llm import hamming, near_copies
from regolith.llm.components import connected_components


def planted(rng, n: int) -> np.ndarray:
    """Fingerprints of which a third lie a few bits from others."""
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = base[: n // 3].copy()
    for _ in range(6):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    return np.unique(np.concatenate((base, near)))


@pytest.mark.parametrize("points", [0, 1 << 17])
def test_shards_cut_by_their_task(spark, monkeypatch, points):
    """a shard over tree_nodes is cut where it lies, or by the shuffle, with the same components."""
    monkeypatch.setattr(hamming, "SHARD_POINTS", points)
    fp = planted(np.random.default_rng(4), 1500)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {(r["node"], r["root"]) for r in connected_components(hamming.hamming_links(df, 7, 4)).collect()}
    apart = np.bitwise_count(fp[:, None] ^ fp[None, :])
    a, b = np.nonzero((apart <= 7) & (apart > 0))
    want = connected_components(spark.createDataFrame(list(zip(fp[a].view(np.int64).tolist(), fp[b].view(np.int64).tolist(), strict=True)), "a long, b long"))
    assert got == {(r["node"], r["root"]) for r in want.collect()} and got


def test_cut_writes_no_shards(spark, monkeypatch):
    tags = []
    monkeypatch.setattr(hamming, "written", lambda df, tag, f=hamming.written: (tags.append(tag), f(df, tag))[1])
    fp = planted(np.random.default_rng(5), 600)
    assert hamming.hamming_links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), 7, 4).count() > 0
    assert "shards" not in tags


def test_wide_sketches():
    """sketches of large sets never differ in more cells than the sets in members, and tell unlike sets apart."""
    rng = np.random.default_rng(6)
    for n in (600, 1100, 5000, 19000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for m in (0, n // 20, n // 9):
            b = np.unique(np.concatenate((a[m:], rng.integers(0, 2**64, m // 2, dtype=np.uint64))))
            assert near_copies._wide_differ(near_copies._wide(a), near_copies._wide(b)) <= len(np.setxor1d(a, b))
        other = rng.integers(0, 2**64, int(n * 0.9), dtype=np.uint64)
        assert 9 * near_copies._wide_differ(near_copies._wide(a), near_copies._wide(other)) > len(a) + len(other)
    assert near_copies._wide(np.arange(512, dtype=np.uint64)) == b"" and near_copies._wide_differ(b"", near_copies._wide(a)) == 0


def test_unlike_texts_are_not_moved(spark):
    """two long texts that share a passage alone are ruled out before they are read again."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64)) for _ in range(2)]
    sets.append(np.unique(np.concatenate((sets[0][:-100], rng.integers(0, 2**64, 100, dtype=np.uint64)))))
    classes = spark.createDataFrame([(i, len(h), bytearray(near_copies._wide(h))) for i, h in enumerate(sets)] + [(9, 40, bytearray())], "cls long, n int, wide binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 9)], "a long, b long")
    assert {tuple(r) for r in near_copies._alike(pairs, classes, (4, 5)).collect()} == {(0, 2), (0, 9)}
