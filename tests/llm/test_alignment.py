"""Alignment of two vocabularies against brute force over token lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from regolith.llm import alignment

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def texts(seed=1, n=80):
    rng = random.Random(seed)
    words = ["the", "rain", "été", "Straße", "naïve", "don't", "2024", "…", "\n\n", "  ", "\t", "日本語", "🙂🙃", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "ﬁ", " ", " ", "\x85", "\x1c", "　x", "é", "!!!", "https://a.b/c?d=e", "🏽", "\x00"]
    out = ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return out + ["", None, " ", "a", "a▁b", "x" * 3000, out[0], "the rain " * 4000]


def test_byte_level_ids_are_those_of_the_file(coders):
    a, _ = alignment.load(A, B)
    for t in texts(7, 300):
        if t:
            assert a.encode(t).tolist() == coders[0].encode(" " + t, add_special_tokens=False).ids


def brute(rows, coders):
    a, b = coders
    letters = alignment._byte_letters()
    per = []
    for i, t in rows:
        links, groups, ids = [], [], ([], [])
        if t:
            data = b" " + t.encode()
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            raw = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]]
            if b"".join(raw[0]) != data or b"".join(raw[1]) != data:
                ids = ([], [])
            else:
                spans = []
                for side in raw:
                    at, out = 0, []
                    for x in side:
                        out.append((at, at + len(x)))
                        at += len(x)
                    spans.append(out)
                j = 0
                for k, (s, e) in enumerate(spans[0]):
                    while spans[1][j][1] <= s:
                        j += 1
                    m = j
                    while m < len(spans[1]) and spans[1][m][0] < e:
                        links.append((ids[0][k], ids[1][m]))
                        m += 1
                both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                groups, last = [], 0
                ends = [[e for _, e in s] for s in spans]
                at = [0, 0]
                for cut in both:
                    upto = [np.searchsorted(x, cut) + 1 for x in ends]
                    groups.append("|".join(",".join(map(str, ids[q][at[q] : upto[q]])) for q in (0, 1)))
                    at, last = upto, cut
        per.append((i, ids, groups, links))
    counts = Counter(p for *_, links in per for p in set(links))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    return [
        (i, len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, ids, groups, links in per
    ]


def test_alignment(spark, coders):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts())] + [(3, "again 3"), (3, "again 3")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for c in ("chunk", "body", "head", "bucket", "n_a", "part"):
        df = df.selectExpr("*", f"'x' AS {c}")
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    want = sorted(brute(rows, coders), key=key)
    for bucket_bytes in (alignment.BUCKET_BYTES, 1000):
        assert sorted((tuple(r) for r in alignment.align(df, A, B, bucket_bytes).collect()), key=key) == want


@pytest.mark.parametrize("seed", range(10))
def test_merge(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    runs, want = [], Counter()
    for _ in range(rng.integers(0, 30)):
        keys = np.unique(rng.integers(0, 9, rng.integers(0, 40)) << 32 | rng.integers(0, 6, 1))
        counts = rng.integers(1, 5, len(keys))
        runs.append((keys, counts))
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    got = [pair for k, c in alignment.merge_runs(runs, 3) for pair in zip(k.tolist(), c.tolist(), strict=True)]
    assert got == sorted(want.items())
    monkeypatch.setattr(alignment, "FAN", 4)
    merger = alignment.Merger()
    for r in runs:
        merger.add(r)
    keys, counts, best = merger.counts()
    top = {}
    for k, c in want.items():
        top[k >> 32] = max(top.get(k >> 32, 0), c)
    assert list(zip(keys.tolist(), counts.tolist(), best.tolist(), strict=True)) == [(k, c, int(top[k >> 32] == c)) for k, c in sorted(want.items())]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).count() == 0
