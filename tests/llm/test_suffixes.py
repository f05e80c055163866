"""Suffix sorting and the substring operator built on it, against brute force."""

import random

import numpy as np
import pytest

from regolith.llm import suffixes

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_order(seed):
    rng = random.Random(seed)
    alphabet, depth = rng.choice([1, 2, 3, 30, 250]), rng.choice([1, 5, 50])
    text = np.array([rng.randrange(alphabet) for _ in range(rng.randint(0, 300))], np.uint8)
    if seed % 3 == 0 and len(text):
        text = np.tile(text[: rng.randint(1, 7)], 60)
    order, prefixes, bits = suffixes.suffix_order(text, depth)
    assert sorted(order.tolist()) == list(range(len(text)))
    starts = [text.tobytes()[i : i + depth] for i in order]
    assert starts == sorted(starts)
    equal = suffixes.common_prefixes(order, prefixes, bits, depth)
    assert [bool(x) for x in equal[1:]] == [a == b for a, b in zip(starts[1:], starts[:-1], strict=True)]


def brute(rows, width):
    first = {}
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - width + 1):
            s = t[k : k + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, _), (key, t) in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < key:
                gone[k : k + width] = b"\1" * width
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def rows_of(seed=3):
    rng = random.Random(seed)
    words = ["été", "the", "rain", "of", "Straße", "q", "naïve", "light", "x" * 30, "\n", "\x00"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passage, line = say(30), say(12)
    rows = [(i * 7 % 61, say(rng.randint(0, 40)) + (passage if i % 3 == 0 else line if i % 2 else "") + say(rng.randint(0, 20))) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(5)] + [(110, rows[5][1][:-9] + "changed!"), (111, "ab" * 300), (112, "ab" * 200), (113, "a" * 999), (114, "a" * 500)]
    return rows + [(120, None), (121, ""), (122, "short"), (None, passage), (None, passage), rows[0], (rows[1][0], rows[3][1]), (123, say(2000) + passage)]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_removed_bytes(spark, hot):
    rows = rows_of()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for c in ("chunk", "body", "head", "bucket", "kept", "data"):
        df = df.selectExpr("*", f"'x' AS {c}")
    got = [tuple(r) for r in suffixes.remove_repeats(df, hot=hot, bucket_bytes=2000).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], bytes(r[4]))
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=key) == sorted(brute(rows, 50), key=key)


def test_lots_of_a_bucket(spark):
    rows = rows_of(9)
    best = {}
    texts = [t.encode() for _, t in rows if t and len(t) > 60]
    owners = np.arange(len(texts), dtype=np.int64)
    got, place = suffixes.smallest_owners(texts, owners, 50)
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            best.setdefault(t[k : k + 50], i)
    for i, t in enumerate(texts):
        assert got[place[i] : place[i] + len(t) - 49].tolist() == [best[t[k : k + 50]] for k in range(len(t) - 49)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(r["n_removed"] for r in suffixes.remove_repeats(df, sort_bytes=500).collect()) == sorted(r[2] for r in brute(rows, 50))


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
