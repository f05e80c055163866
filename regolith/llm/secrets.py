"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Every candidate value is hashed and counted over the corpus by distinct repositories and owners. A value
of several owners of whom none holds nearly all of its repositories is a widely copied example; any other
value is specific to one owner, and a live credential where its characters look random. A repository is a
document, its owner the document's source; other columns can be named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.common import bound, free_names, row_key, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Credentials known by a prefix; the method's own spans.
VENDOR = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
KINDS = ("assign", "access", "hex", "vendor")
#: An example has at least this many owners, and the largest of them at most this share of its repositories.
EXAMPLE_OWNERS, EXAMPLE_SHARE = 3, 0.9
#: Distinct characters that a live-looking value has at least.
LIVE_CHARACTERS = 8

#: Matches that are laid out one after the other; longer lists are cut in blocks of as many.
BLOCK = 128
#: Code points of a block of text where parts are cut out.
TEXT_BLOCK = 2048

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points: gaps from split, lengths from the matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    none = F.array().cast(_SPAN)

    def length(x):
        return F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def step(state, x):
        at = state["at"] + F.length(x["gap"])
        end = at + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), end.alias("end"), x["value"].alias("value"))
        more = F.concat(state["found"], F.array(span).cast(_SPAN))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & (F.length(x["value"]) >= least), more).otherwise(state["found"]).alias("found"))

    # growing an array copies it, so it grows within blocks only; the blocks' starts come first
    def blocks(pieces):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)))

    def starts(cut):
        sizes = F.transform(cut, lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + length(x)))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))

    def laid(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step, lambda s: s["found"])

    found = bound(bound(pieces, blocks), lambda cut: F.flatten(F.zip_with(cut, F.slice(starts(cut), F.lit(1), F.size(cut)), laid)))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(documents: DataFrame, owner: str = "source") -> DataFrame:
    """Per row: doc_id, row_key, owner, spans (array by start, then kind), of the whole text.

    Null texts are empty. assign spans cover the whole match, from key word to value.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    all_spans = F.concat(_spans(text, ASSIGN, 0, 2, 8), _spans(text, ACCESS, 1), _spans(text, HEX, 2), _spans(text, VENDOR, 3))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.array_sort(all_spans).alias("found"),
    )


def ownership(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_share: float = EXAMPLE_SHARE) -> DataFrame:
    """Per candidate value hash: n_repositories, n_owners, top_share (of its repositories, its largest owner's) and whether it is an example.

    Values are first combined to distinct (value, repository, owner), so a hot value costs one row per task.
    """
    # sums of firsts instead of sets: distinct owners and repositories are counted after two plain group-bys
    values = scanned.select("doc_id", "owner", F.explode("found").alias("s")).select("doc_id", "owner", F.sha2("s.value", 256).alias("digest"))
    per_owner = values.distinct().groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    per_value = per_owner.groupBy("digest").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("repositories").alias("most"))
    per_value = per_value.withColumn("top_share", F.col("most") / F.col("n_repositories")).drop("most")
    return per_value.withColumn("example", (F.col("n_owners") >= example_owners) & (F.col("top_share") <= example_share))


def classify(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_share: float = EXAMPLE_SHARE, live_characters: int = LIVE_CHARACTERS) -> DataFrame:
    """Per distinct span: doc_id, row_key, s, example and live, told apart by ownership over the corpus."""
    flat = scanned.where(F.size("found") > 0).select("doc_id", "row_key", F.explode("found").alias("s")).distinct()
    flat = flat.withColumn("digest", F.sha2("s.value", 256))
    varied = F.size(F.array_distinct(F.split("s.value", ""))) >= live_characters
    of_value = written(ownership(scanned, example_owners, example_share).select("digest", "example"), "ownership")
    told = flat.join(of_value, "digest").select("doc_id", "row_key", "s", "example", (~F.col("example") & varied).alias("live"))
    return written(told, "told")


def told_apart(scanned: DataFrame) -> DataFrame:
    """Per distinct (doc_id, row_key) with spans: how many are live and how many examples."""
    return classify(scanned).groupBy("doc_id", "row_key").agg(F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"))


def secrets(documents: DataFrame, owner: str = "source") -> DataFrame:
    """Per row: doc_id, counts by kind, base_sha256, spans, n_live, n_example (longs).

    A null text has no spans; base_sha256 is then that of the empty string. Repeated rows are kept, a
    null doc_id stays null, null owners count as one owner, and further columns are ignored.
    """
    scanned = written(scan(documents, owner), "scanned")
    told = told_apart(scanned).select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), "n_live", "n_example")
    base = F.filter("found", lambda s: s["rank"] < 3)
    counts = [F.size(F.filter(F.col("found")["rank"], lambda rank: rank == F.lit(r))).cast("long").alias(f"n_{KINDS[r]}") for r in range(3)]  # noqa: B023
    rows = scanned.select("doc_id", "row_key", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
    match = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_key") == F.col("_key"))
    out = rows.join(told, match, "left")
    return out.select(
        "doc_id", *(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example")),
    )


def _between(blocks: Column, first: Column, last: Column) -> Column:
    """The code points first..last (exclusive) of a text that comes in blocks of TEXT_BLOCK; counts within two of them at most."""
    i, j = (F.floor(x / TEXT_BLOCK).cast("int") for x in (first, last))
    head, tail = F.get(blocks, i), F.coalesce(F.get(blocks, j), F.lit(""))
    at = (first - i * TEXT_BLOCK + 1).cast("int")
    middle = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(i == j, tail.substr(at, (last - first).cast("int"))).otherwise(
        F.concat(head.substr(at, F.lit(TEXT_BLOCK)), middle, tail.substr(F.lit(1), (last - j * TEXT_BLOCK).cast("int")))
    )


def redact(documents: DataFrame, owner: str = "source", mark: str = "[secret]") -> DataFrame:
    """The documents with the spans of live-looking, owner-specific credentials replaced by the mark.

    Widely copied examples stay. Spans that overlap share one mark. Every row and column stays; n_chars, where present, follows the text. The work is in
    proportion to the text and its secrets: a window carries the running end, and the text is cut in blocks once.
    """
    doc, key, gaps, last, fresh = free_names(documents.columns, "doc", "key", "gaps", "last", "fresh")
    scanned = written(scan(documents, owner), "scanned")
    spans = classify(scanned).where("live").select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    earlier = Window.partitionBy(doc, key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    told = written(spans.groupBy(doc, key).agg(
        F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("before"), F.struct("before", "start")))).alias(gaps), F.max("end").alias(last)
    ), "live")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (row_key() == F.col(key))
    joined = documents.join(told, match, "left")

    def cleaned(blocks):
        kept = F.transform(F.col(gaps), lambda g: F.concat(_between(blocks, g["before"], g["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), _between(blocks, F.col(last), F.lit(TEXT_BLOCK) * F.size(blocks)))

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    fixed = F.when(F.col(gaps).isNotNull(), bound(blocks, cleaned)).otherwise(F.col("text"))
    # a generator works the text out once, for itself and its length
    once = joined.select("*", F.inline(F.array(F.struct(fixed.alias(fresh)))))
    out = {"text": F.col(fresh)}
    if "n_chars" in documents.columns:
        n = F.length(fresh).cast(documents.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col(gaps).isNotNull(), n).otherwise(F.col("n_chars"))
    return once.select(*(out.get(c, F.col(c)).alias(c) for c in documents.columns))
