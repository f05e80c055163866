"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

Items fall into partitions by their number of distinct five-word shingles (powers of two). Of an item
with n shingles and a containment threshold t, any document that contains the item misses at most
n - ceil(t n) shingles, so it holds one of the item's n - ceil(t n) + 1 smallest shingle hashes: its
MinHash sketch. Each partition's largest sketch hash bounds the hashes that a document offers to it, and
its smallest size tells how many words a document must have to be asked at all. Documents meet the
items of a partition on a sketch hash; the candidates are then verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import bound, free_names, row_key, sized, written

WORDS = 5
CONTAINMENT = 0.8


def word_array(text: str) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _runs(words: Column, width, made) -> Column:
    """made(run) of all runs of width consecutive words."""
    last = F.size(words) - F.lit(width) + 1
    return F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: made(F.slice(words, i, F.lit(width))))


def shingle_array(words: Column, width) -> Column:
    """Distinct shingles of the width, as strings; none for fewer words."""
    return F.array_distinct(_runs(words, width, lambda run: F.array_join(run, " ")))


def _hash_array(words: Column, width) -> Column:
    return _runs(words, width, F.xxhash64)


def _offers_of_width(words: Column, width: int, bounds: list) -> Column:
    parts = F.array(*(F.struct(F.lit(b["part"]).alias("part"), F.lit(b["top"]).alias("top"), F.lit(b["least"]).alias("least")) for b in bounds))
    top, shingles = max(b["top"] for b in bounds), F.size(words) - width + 1

    def to_partitions(h):
        asked = F.filter(parts, lambda p: (h <= p["top"]) & (p["least"] <= shingles))
        return F.transform(asked, lambda p: F.struct(F.lit(width).alias("width"), p["part"].alias("part"), h.alias("hash")))

    low = F.array_distinct(F.filter(_hash_array(words, width), lambda h: h <= F.lit(top)))
    return F.flatten(F.transform(low, to_partitions))


def _offers(words: Column, bounds: list) -> Column:
    """(width, part, hash) of what the document offers to each partition: hashes that a sketch in it could hold."""
    widths = sorted({b["width"] for b in bounds})
    return F.concat(*(_offers_of_width(words, w, [b for b in bounds if b["width"] == w]) for w in widths))


def item_sketches(benchmark: DataFrame, containment: float = CONTAINMENT, words: int = WORDS) -> DataFrame:
    """item_id, width, n, part and the sorted sketch of every item that has a word.

    width is words, or the item's number of words if it has fewer: it is one shingle then.
    """
    base = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_array("text").alias("words")).where(F.size("words") > 0)
    base = written(base.withColumn("width", F.least(F.size("words"), F.lit(words))), "itemwords")
    base = base.select(
        "item_id", "width", F.array_sort(F.array_distinct(_hash_array(F.col("words"), F.col("width")))).alias("hashes"),
        shingle_array(F.col("words"), F.col("width")).alias("shingles")
    )
    base = written(base, "shingles").withColumn("n", F.size("shingles"))
    # hashes of different shingles may be equal; then the sketch takes all of them
    keep = F.col("n") - F.ceil(F.lit(containment) * F.col("n") - 1e-9).cast("int") + 1
    return base.select(
        "item_id", "width", "n", "shingles", F.floor(F.log2("n")).cast("int").alias("part"),
        F.slice("hashes", 1, F.when(F.size("hashes") < F.col("n"), F.size("hashes")).otherwise(keep)).alias("sketch"),
    ).distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, words: int = WORDS) -> DataFrame:
    """Pairs doc_id, row_key, item_id, n_shared, n_item, containment of at least the threshold.

    Whole texts are compared, lower-cased, as runs of letters and digits. Null and empty texts and items
    match nothing; an item of fewer than five words is one shingle of that many words. Repeated rows give
    one pair; items with equal texts give one each; a null doc_id or item_id stays null in its pairs.
    """
    items = written(item_sketches(benchmark, containment, words), "items")
    n_items = items.count()
    entries = written(items.select("width", "part", "n", F.explode("sketch").alias("hash")), "sketches")
    # a document holds as many shingles as ceil(t n) itself; a handful of partitions for each of five widths
    bounds = entries.groupBy("width", "part").agg(F.max("hash").alias("top"), F.min(F.ceil(F.lit(containment) * F.col("n") - 1e-9)).alias("least"), F.count("*").alias("rows"))
    bounds = bounds.orderBy("width", "part").collect()
    schema = "doc_id long, row_key long, item_id long, n_shared int, n_item int, containment double"
    if not bounds:
        return documents.sparkSession.createDataFrame([], schema)
    n_entries = sum(b["rows"] for b in bounds)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text"))
    # the text must not be carried along with each hash, so the array is made a step before it is spread
    made = docs.select("doc_id", "row_key", bound(word_array("text"), lambda words: _offers(words, bounds)).alias("offers"))
    offered = made.select("doc_id", "row_key", F.explode_outer("offers").alias("o"))  # outer: no filter that makes the array again
    offered = offered.select("doc_id", "row_key", "o.width", "o.part", "o.hash")
    by_hash = items.select("item_id", "width", "part", F.explode("sketch").alias("hash"))
    candidates = offered.join(sized(by_hash, n_entries), ["width", "part", "hash"]).select("doc_id", "row_key", "item_id", "width").distinct()
    candidates = written(candidates, "candidates")
    n_candidates = candidates.count()

    facts = items.select("item_id", "width", "shingles", F.col("n").alias("n_item")).withColumnRenamed("item_id", "_item").withColumnRenamed("width", "_width")
    pairs = docs.withColumnRenamed("doc_id", "_doc").withColumnRenamed("row_key", "_key").join(
        sized(candidates, n_candidates), F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("row_key"))
    )
    pairs = pairs.join(sized(facts, n_items, 20_000), F.col("_item").eqNullSafe(F.col("item_id")) & (F.col("_width") == F.col("width")))
    mine = bound(word_array("text"), lambda x: shingle_array(x, F.col("width")))
    shared = pairs.select("doc_id", "row_key", "item_id", "n_item", F.size(F.array_intersect(mine, F.col("shingles"))).alias("n_shared"))
    return (
        shared.select("doc_id", "row_key", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
        .where(F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("n_item") - 1e-9))
        .distinct()
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, words: int = WORDS) -> DataFrame:
    """The documents that contain no benchmark item, with the columns they came with; null and empty texts stay."""
    doc, key = free_names(documents.columns, "doc", "key")
    hits = written(contaminated(documents, benchmark, containment, words).select(F.col("doc_id").alias(doc), F.col("row_key").alias(key)).distinct(), "leaks")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (row_key() == F.col(key))
    return documents.join(sized(hits, hits.count()), match, "left_anti")
