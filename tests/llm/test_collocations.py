"""Collocations against brute force counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.llm import collocations as c

DOCS = "doc_id long, lang string, text string"


def brute(rows, least, longest, first):
    counts, totals = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        totals[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = totals[lang]
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        beaten = set()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 100 * f[p[i : i + k]]:
                        beaten.add(p[i : i + k])
        found = []
        for p, a in frequent.items():
            if p not in beaten:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def rows_of(seed=2):
    rng = random.Random(seed)
    words = ["The", "rain", "ÉTÉ", "of", "q\x01", "über", "x-y", *(f"w{i}" for i in range(30))]
    phrases = ["new york city hall", "in the middle of nowhere", "a a a a a a", "des Öfteren", "sui generis"]
    say = lambda: " ".join(rng.choice(phrases) if rng.random() < 0.4 else words[min(int(rng.expovariate(0.2)), 36)] for _ in range(rng.randint(0, 30)))
    rows = [(i, rng.choice(["en", "de", None, "zz"]), rng.choice([" ", "\t ", ".", ",\n", " ; "]).join(say() for _ in range(3))) for i in range(200)]
    return rows + [(300, "en", None), (301, "en", ""), (302, "xx", None), (303, "en", "..!"), (None, "de", rows[0][2]), rows[1], (304, "en", "a " * 3000)]


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 500, "bucket_bytes": 300, "runs_per_task": 3}])
def test_collocations(spark, settings):
    rows = rows_of()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("bucket", "chunk", "n", "phrase", "body", "id", "word"):
        df = df.selectExpr("*", f"'x' AS {name}")
    got = c.collocations(df, least=6, first=40, **settings).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 6, 5, 40)


def test_nothing_frequent(spark):
    assert c.collocations(spark.createDataFrame(rows_of()[:3], DOCS), least=10_000).count() == 0
    assert c.collocations(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_tiles(seed, monkeypatch):
    monkeypatch.setattr(c, "TILE_BITS", 3)
    monkeypatch.setattr(c, "DENSE", 12)
    rng = np.random.default_rng(seed)
    a, b = rng.geometric(0.1, 800), rng.geometric(0.1, 800)
    keys = (a.astype(np.int64) << 32) | b
    weight = rng.integers(1, 9, 800)
    want, weighed = Counter(keys.tolist()), Counter()
    for k, w in zip(keys.tolist(), weight.tolist(), strict=True):
        weighed[k] += w
    assert list(zip(*(x.tolist() for x in c.tile_counts(keys)), strict=True)) == sorted(want.items())
    assert list(zip(*(x.tolist() for x in c.tile_counts(keys, weight)), strict=True)) == sorted(weighed.items())


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 9_876_543_210_123, 98_765_432_109_876, 9_876_543_210_127, 12_345_678_901_234
    df = spark.createDataFrame([(a, n, [l, a], [r, a])], "a long, n long, pre array<long>, suf array<long>")
    got = df.select(c.best_cut(F.col("a"), F.col("n"), F.col("pre"), F.col("suf"), 2).alias("s")).first()["s"]
    assert tuple(got) == (1000 * a * n // (l * r), 1, l, r)
