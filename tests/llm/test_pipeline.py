"""Each stage of the corpus pipeline on its own input, and the whole run, against brute force."""

import os
import random
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from regolith.llm import near_copies, registry, toxicity
from regolith.llm.common import table
from tests.llm.test_text_operators import brute_leaks, brute_spans

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    grammar = toxicity.learn(docs, table(spark, SF, "labels"))
    before = rows_of(docs)

    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == columns
    after = rows_of(kept)
    assert sorted(d for d, *_ in after) == sorted(d for d, t, _ in before if toxicity.score(grammar, t) < 0.5)

    one = rows_of(stages["simhash near-dedup"](spark, kept, SF))
    assert sorted(d for d, *_ in one) == brute_near_copies([r[:2] for r in after])  # the stage's own contract: five words, 0.8

    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = stages["benchmark decontamination"](spark, kept, SF)
    assert clean.columns == columns
    dirty = {d for d, *_ in brute_leaks(after, items)}
    assert sorted(d for d, *_ in rows_of(clean)) == sorted(d for d, *_ in after if d not in dirty)

    redacted = stages["secret scans"](spark, kept, SF)
    assert redacted.columns == columns and redacted.count() == kept.count()
    texts = {d: t for d, t, _ in after}
    for d, t, _ in rows_of(redacted):
        if t != texts[d]:
            assert brute_spans(texts[d]) and "[secret]" in t

    mixed = stages["mixing sources"](spark, kept, SF)
    assert {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()} == set(texts)


def brute_near_copies(rows):
    """Smallest doc_id of each component of five-word Jaccard similarity 0.8 or more, over all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_near_copies_by_jaccard(spark):
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in stage(spark, docs, SF).collect()) == brute_near_copies(rows)

    words = [f"w{i}" for i in range(104)]  # 100 shingles
    at = lambda *changed: " ".join("x" if i in changed else w for i, w in enumerate(words))
    rows = [
        (1, at()), (2, at(10, 50)), (3, at(10, 50, 90)), (4, at(10, 30, 50, 70)), (5, at().upper()), (6, None), (7, " \n"), (8, "one two"), (9, "ONE  two"), (10, "one"),
        (11, " ".join(words[:84])), (12, " ".join(words[:83])), *((100 + i, f"{' '.join('boiler plate of many texts goes here again'.split() * 2)} own {i} {i * 7} {i * i}") for i in range(30)),
    ]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r["doc_id"] for r in got) == brute_near_copies(rows)
    assert {r["doc_id"] for r in got} >= {1, 6, 8, 10} and not {r["doc_id"] for r in got} & {2, 5, 7, 9}


def crowd(n=120, seed=5):
    """Copies of one text with up to 25 changed words, a chain of ever further copies, and texts around one common passage."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows, chain = [], list(base)
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(145)
            words[at : at + rng.randint(1, 5)] = [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 5))]
        rows.append((i * 37 % 1009, " ".join(words)))
    for i in range(20):
        chain[rng.randrange(150)] = f"c{i}"
        rows.append((2000 + i, " ".join(chain)))
    passage = " ".join(f"p{i}" for i in range(12))
    rows += [(3000 + i, f"own{i} {passage} tail{i % 7} and{i % 3} more{i % 2}") for i in range(60)]
    return rows


def test_large_groups_without_all_pairs(spark, monkeypatch):
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS id", "'y' AS row_key", "0 AS cls")
    monkeypatch.setattr(near_copies, "FREQUENT", 2)
    for short in (4, 24):
        monkeypatch.setattr(near_copies, "SHORT", short)
        got = near_copies.keep_one(docs)
        assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == brute_near_copies(rows)
    classes = near_copies.prefixes(docs)
    pairs, long_lists = near_copies.meetings(classes, short=4)
    n = long_lists.groupBy("hash").count().agg(F.sum("count"), F.sum(F.expr("count * (count - 1)")) / 2).first()
    assert pairs.count() < (near_copies.LEADERS + 4) * classes.count() and n[1] > 10 * n[0]


def test_simhash_links_then_the_rest(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        words = [f"d{i}w{j}" for j in range(200)]
        for k, changes in enumerate((0, 1, 4, 5, 6)):
            copy = list(words)
            for at in rng.sample(range(200), changes):
                copy[at] = f"x{rng.random()}"
            rows.append((10 * i + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = near_copies.written(near_copies.prefixes(docs), "classes")
    of = {r["id"]: r for r in classes.collect()}

    def bits(text):
        (h,) = near_copies._hash_sets([text.encode()], 5)
        return sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))

    fps = {d: bits(t) for d, t in rows}
    assert {d: of[d]["fp"] % 2**64 for d in of} == fps
    found = {(r["a"], r["b"]) for r in near_copies.simhash_pairs(classes).collect()}

    def components(linked):
        parent = {d: d for d, _ in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in combinations(sorted(parent), 2):
            if linked(x, y):
                parent[max(find(x), find(y))] = min(find(x), find(y))
        return {x: find(x) for x in parent}

    def similar(x, y):
        p, q = (near_copies.shingle_set(dict(rows)[d]) for d in (x, y))
        return 5 * len(p & q) >= 4 * len(p | q)

    def pair(x, y):
        return tuple(sorted((of[x]["cls"], of[y]["cls"]))) in found

    near = lambda x, y: (fps[x] ^ fps[y]).bit_count() <= near_copies.RADIUS
    both = [(x, y) for x, y in combinations(sorted(of), 2) if x // 10 == y // 10]
    assert components(pair) == components(near)
    assert any(pair(*p) and not similar(*p) for p in both) and any(similar(*p) and not near(*p) for p in both)

    stage, meetings = dict(corpus_pipeline.STAGES)["simhash near-dedup"], near_copies.meetings
    monkeypatch.setattr(near_copies, "meetings", lambda *args: tuple(df.limit(0) for df in meetings(*args)))
    linked = sorted(r["doc_id"] for r in stage(spark, docs, SF).collect())  # the SimHash step by itself, verified
    assert linked == sorted(set(components(lambda x, y: pair(x, y) and similar(x, y)).values())) and len(linked) < len(rows)
    monkeypatch.setattr(near_copies, "meetings", meetings)
    assert sorted(r["doc_id"] for r in stage(spark, docs, SF).collect()) == brute_near_copies(rows) != linked


def test_lists_over_several_chunks():
    postings = sorted([(7, i, 100 + i, i) for i in range(50)] + [(8, 0, 100, 1), (8, 1, 100, 2), (9, 0, 50, 3)] + [(12, i, 100, 60 + i) for i in range(9)])

    def run(rows, size):
        batches = [near_copies.pa.RecordBatch.from_pydict({k: [p[i] for p in postings[at : at + size]] for i, k in enumerate("hijc")}) for at in range(0, len(postings), size)]
        out = [r for b in near_copies._meet(batches, (4, 5), 4, 3, rows) for r in b.to_pylist()]
        return sorted({(r["a"], r["b"]) for r in out if r["hash"] is None}), sorted((r["hash"], r["a"], r["n"], r["at"]) for r in out if r["hash"] is not None)

    whole = run(10**6, 10**6)
    assert (1, 2) in whole[0] and len(whole[1]) == 59
    assert run(5, 3) == whole and run(6, 1) == whole and run(20, 7) == whole


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    n = out.agg(F.count_distinct("doc_id")).first()[0]
    assert 0 < n < table(spark, SF, "documents").count() and corpus_pipeline.ORACLE_SQL is None


def test_accuracy_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    if not os.path.isdir(sf):
        return
    labels = table(spark, sf, "labels")
    for name, label in (("op1_toxicity", "toxic"), ("op9_quality", "quality")):
        got = registry.QUERIES[name](spark, sf).where("held_out").join(labels, "doc_id")
        right, n = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
        assert n > 500 and right > 0.97, (name, right)
