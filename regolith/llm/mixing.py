"""Temperature mixing of sources to target weights (DataFrame functions only).

Source token shares p are raised to an exponent and normalised: q ~ p ** exponent. The exponent is
bisected in [0, 1] for a target entropy or a repetition limit. The budget gives each source q times the
budget in tokens, realised as whole epochs over the source plus a part of one. Documents lie in blocks; in
every epoch the blocks of all sources are permuted, and the documents within each block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regolith.llm.common import free_names, sized, written

MAX_REPEATS = 2.0
SEED = 7
#: Probes of the exponent in one pass over the sources: each pass narrows the interval this often.
PROBES = 32


def tokens():
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_totals(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def bisect_exponent(totals: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, passes: int = 7) -> float:
    """The smallest exponent in [0, 1] that keeps the repetition limit, or the largest that reaches the entropy (nats).

    Both are monotone in the exponent. A pass evaluates PROBES exponents at once over the source table, of
    which only the aggregates come back. Where even 1 (or 0) misses the target, that end is returned.
    """
    p = F.col("tokens") / F.lit(float(totals.agg(F.sum("tokens")).first()[0]))
    lo, hi = 0.0, 1.0
    for _ in range(passes):
        grid = [lo + (hi - lo) * i / (PROBES - 1) for i in range(PROBES)]
        rows = (
            totals.select(p.alias("p"), F.explode(F.array(*map(F.lit, grid))).alias("x"))
            .groupBy("x").agg(
                F.sum(F.pow("p", "x")).alias("z"), F.sum(F.pow("p", "x") * F.col("x") * F.ln("p")).alias("s"),
                F.max("p").alias("top"), F.min("p").alias("low"),
            ).orderBy("x").collect()
        )
        ok = []
        for r in rows:
            if entropy is not None:
                ok.append(math.log(r["z"]) - r["s"] / r["z"] >= entropy)  # falls with the exponent
            else:
                ok.append((r["top"] / r["low"]) ** (1 - r["x"]) <= max_repeats * (1 + 1e-12))  # holds from some exponent on
        good = [r["x"] for r, k in zip(rows, ok, strict=True) if k]
        if entropy is not None:
            if not good:
                return 0.0
            lo = max(good)
            hi = min([x for x in grid if x > lo], default=lo)
        else:
            hi = min(good, default=1.0)
            lo = max([x for x in grid if x < hi], default=hi)
        if hi - lo < 1e-12:
            break
    return lo if entropy is not None else hi


def mixture(totals: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """Per source: weight, budget tokens, whole epochs and the tokens of the part epoch.

    Without a budget the smallest one that uses every document at least once is taken.
    """
    top, all_tokens = totals.agg(F.max("tokens"), F.sum("tokens")).first()
    share = F.col("tokens") / F.lit(float(all_tokens))
    z = totals.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0]
    weighed = totals.withColumn("weight", F.pow(share, F.lit(exponent)) / F.lit(z))
    if budget is None:
        budget = top / ((top / all_tokens) ** exponent / z)
    weighed = weighed.withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    return weighed.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _weight(df: DataFrame, more=None) -> int:
    """Rows of a table in narrow rows of some 32 bytes: names and arrays count by their size."""
    size = 1 + F.coalesce(F.octet_length("source"), F.lit(0)) / 32 + (more / 4 if more is not None else 0)
    return math.ceil(df.agg(F.sum(size)).first()[0] or 0)


def ranks(spread: DataFrame, order) -> DataFrame:
    """spread(source, block, epoch, ...) with slot, the rank (from 1) of a block in its epoch by order, a hash, then source and block.

    Blocks are ranked in 65,536 ranges of the hash, and each range starts after those before it: an epoch is never one task.
    """
    dealt = spread.withColumn("order", order).withColumn("range", F.shiftright("order", 48))
    counts = dealt.groupBy("epoch", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("epoch", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("epoch", "range").orderBy("order", "source", "block")
    placed = dealt.withColumn("own", F.row_number().over(within)).join(starts, ["epoch", "range"])
    return placed.withColumn("slot", (F.col("start") + F.col("own")).cast("long")).drop("order", "range", "start", "own")


def mix(documents: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """Every realised occurrence of a document: its columns, weight, epoch (from 0), block, slot and place.

    Occurrences ordered by (epoch, slot, place) are the mixed stream: block numbers name the source's blocks,
    slot is the block's rank (from 1) in the epoch's permutation of all blocks of all sources, place a keyed
    order of the block's documents that differs from epoch to epoch. A source gets its budget up to less than
    one document. A null source is a source of its own; a document without words has 0 tokens and comes once
    for each epoch its block is in; repeated rows are rows of their own. Sources without tokens come once.
    Columns named like the added ones are replaced; all others stay, whatever their names.
    """
    docs = documents.drop("weight", "epoch", "block", "slot", "place")

    def key():
        return F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed))

    # one pass over the texts; all that is summed and cut below is in these narrow rows
    lean = written(docs.select("source", tokens().alias("n_tokens"), key().alias("h")), "lean")
    totals = written(source_totals(lean), "totals")
    real = totals.where(F.col("tokens") > 0)
    if real.isEmpty():
        plan = totals.select("source", "docs", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("long").alias("epochs"), F.lit(None).cast("long").alias("rest"))
    else:
        exponent = bisect_exponent(real, entropy, max_repeats if entropy is None else None)
        shares = mixture(real, exponent, budget).select(F.col("source").alias("s"), "weight", "epochs", "rest")
        plan = totals.join(shares, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # about as many blocks as documents in a block, so that neither grows with the whole source
    plan = written(plan.withColumn("blocks", F.ceil(F.sqrt("docs")).cast("long")), "plan")
    n_sources = _weight(plan)
    facts = plan.select(F.col("source").alias("s"), "weight", "epochs", "rest", "blocks")
    placed = lean.join(sized(facts, n_sources), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod("h", "blocks"))

    # running tokens: over a source's blocks, then within the one block where the part epoch ends
    part = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    order = F.xxhash64("block", F.lit(seed), F.lit(-1))
    upto = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("upto", F.sum("n").over(upto)).withColumn("room", F.col("rest") - (F.col("upto") - F.col("n")))
    # of the part epoch: a block is in as a whole, or the documents with hashes up to a cut are, or nothing is
    part = written(part.select("source", "block", "epochs", F.coalesce(F.col("upto") <= F.col("rest"), F.lit(False)).alias("whole"), "room"), "blocks")
    edge = part.where(~F.col("whole") & (F.col("room") > 0)).select(F.col("source").alias("es"), F.col("block").alias("eb"), F.col("room").alias("left"))
    inside = placed.select("source", "block", "h", "n_tokens").join(sized(edge, n_sources), F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("eb")))
    within = Window.partitionBy("source", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = inside.withColumn("run", F.sum("n_tokens").over(within)).where(F.col("run") <= F.col("left")).groupBy("source", "block").agg(F.max("h").alias("cut"))
    cut = cut.select(F.col("source").alias("cs"), F.col("block").alias("cb"), "cut")

    # the permutation of each epoch, over blocks: about the root of the number of documents
    turns = part.join(sized(cut, n_sources), F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")), "left").drop("cs", "cb")
    more = (F.col("whole") | F.col("cut").isNotNull()).cast("long")
    turns = turns.withColumn("turns", F.coalesce(F.col("epochs") + more, F.lit(1)).cast("int")).where(F.col("turns") > 0)
    spread = turns.select("source", "block", "cut", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("epoch"))
    ranked = ranks(written(spread, "spread"), F.xxhash64("source", "block", "epoch", F.lit(seed)))
    slots = ranked.groupBy("source", "block", "cut").agg(F.array_sort(F.collect_list(F.struct("epoch", "slot"))).alias("slots"))
    slots = written(slots.select("source", "block", "cut", F.col("slots.slot").alias("slots")), "slots")
    n_slots = _weight(slots, F.size("slots"))

    s, b, w, h, c, at, o = free_names(docs.columns, "s", "b", "w", "h", "c", "at", "o")
    out = docs.withColumn(h, key()).join(sized(plan.select(F.col("source").alias(s), F.col("weight").alias(w), F.col("blocks").alias(b)), n_sources), F.col("source").eqNullSafe(F.col(s)))
    out = out.withColumn(b, F.pmod(F.col(h), F.col(b))).drop(s)
    mine = slots.select(F.col("source").alias(s), F.col("block").alias(o), F.col("cut").alias(c), F.col("slots").alias(at))
    out = out.join(sized(mine, n_slots), F.col("source").eqNullSafe(F.col(s)) & (F.col(b) == F.col(o))).drop(s, o)
    beyond = F.coalesce(F.col(h) > F.col(c), F.lit(False)).cast("int")  # not in the last, part epoch of its block
    out = out.withColumn(at, F.slice(at, F.lit(1), F.size(at) - beyond))
    out = out.select(*docs.columns, F.col(w).alias("weight"), F.col(b).alias("block"), F.col(h), F.posexplode(at).alias("epoch", "slot"))
    place = F.xxhash64(h, "epoch", F.lit(seed))
    return out.select(*docs.columns, "weight", "epoch", "block", "slot", place.alias("place"))
