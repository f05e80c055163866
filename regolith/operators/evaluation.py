"""Evaluation of methods, runs and catalogues: ladders, profiles, verdicts and splits over relations of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.config import DEFAULT, DOF, Config
from regolith.functions.tables import written
from regolith.operators.documents import json_objects
from regolith.operators.fitting import fit
from regolith.operators.match_metrics import summarise


def pooled(sets: dict[str, DataFrame]) -> DataFrame:
    """Match sets in one, each match with the origin it came from; (pair_id, origin, match_id) stays a key."""
    out = None
    for origin, matches in sets.items():
        own = matches.withColumn("origin", F.lit(origin))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def scale_ladder(windows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per ratio k of windows(k, n, inlier_ratio, rmse, coverage, dx, dy, noise_n): means, spread of the offsets and noise ratio.

    Means and spread are over windows with an offset and a fit, of which a ratio has two at least; real and
    noise matches are summed over all of its windows.
    """
    usable = F.col("dx").isNotNull() & F.col("dy").isNotNull() & F.col("rmse").isNotNull()
    of = lambda c: F.when(usable, F.col(c))
    ladder = windows.groupBy("k").agg(
        F.count_if(usable).alias("windows"), *(F.avg(of(c)).alias(f"mean_{c}") for c in ("n", "inlier_ratio", "rmse", "coverage")),
        F.hypot(F.stddev_pop(of("dx")), F.stddev_pop(of("dy"))).alias("spread"), (F.sum("n") / F.greatest(F.sum("noise_n"), F.lit(1))).alias("noise_ratio"),
    )
    return ladder.where(F.col("windows") >= 2).withColumn("passed", F.col("noise_ratio") >= cfg.noise_reject_ratio)


def variant_table(results: DataFrame) -> DataFrame:
    """Per variant of results(variant, rmse, coverage, entropy): means (NaN is no value) and whether the RMSE is below a pixel."""
    rmse = F.avg(F.when(~F.isnan("rmse"), F.col("rmse")))
    table = results.groupBy("variant").agg(F.count("*").alias("runs"), rmse.alias("rmse"), F.avg("coverage").alias("coverage"), F.avg("entropy").alias("entropy"))
    return table.withColumn("sub_pixel", F.coalesce(F.col("rmse") < 1.0, F.lit(False)))


def complexity_control(choices: DataFrame, kind: str = "homography") -> DataFrame:
    """Of choices(pair_id, best): pairs, those that chose the kind, and whether these are at most half."""
    g = choices.agg(F.count("*").alias("pairs"), F.count_if(F.col("best") == kind).alias("chosen"))
    return g.withColumn("passed", F.col("chosen") <= F.floor(F.col("pairs") / 2))


def adoption(baseline: DataFrame, candidate: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Per case the first rule that a candidate breaks: no result, RMSE over 1 px, matches halved, gate lost; or adopt.

    gates(case, before, after) tells whether the control gate passed; a gate that failed before cannot be lost, nor can any
    where gates are not given.
    """
    b = baseline.select("case", F.col("matches").alias("b_matches"))
    both = b.join(candidate.select("case", "matches", "rmse_px"), "case", "left")
    over, lost = F.col("rmse_px").isNull() | (F.col("rmse_px") > 1.0), F.lit(False)
    if gates is not None:
        both = both.join(gates, "case", "left")
        lost = F.coalesce("before", F.lit(False)) & ~F.coalesce("after", F.lit(False))
    rule = F.when(F.col("matches").isNull(), "no result").when(over, "rmse over one pixel").when(F.col("matches") < 0.5 * F.col("b_matches"), "matches halved").when(lost, "gate lost")
    return both.select("case", "b_matches", "matches", rule.otherwise("adopt").alias("verdict"))


def fit_scores(matches: DataFrame, size: float, kind: str = "affine", least_inliers: int = 0, cfg: Config = DEFAULT) -> DataFrame:
    """The figures that every method is compared by: matches, and those of a robust fit of the pair, to four decimals.

    Pairs with fewer than cfg.min_matches matches, without a model or with fewer inliers than asked for keep their
    count; ratio and RMSE are NULL, coverage and entropy 0.
    """
    # written once: what makes the matches (a sort of all of them, say) is not done again for each figure
    matches = written(matches.select("pair_id", "match_id", "xa", "ya", "xb", "yb"), "points")
    counts = matches.groupBy("pair_id").agg(F.count("*").alias("matches"))
    enough = matches.join(counts.where(F.col("matches") >= cfg.min_matches).select("pair_id"), "pair_id", "left_semi")
    figures = summarise(fit(enough, kind, cfg, kept=True), size, DOF[kind]).where(F.col("inlier_count") >= least_inliers)
    four = lambda c: F.round(c, 4).alias(c)
    got = figures.select("pair_id", "inlier_count", *map(four, ("inlier_ratio", "rmse_px", "coverage", "entropy")))
    return counts.join(got, "pair_id", "left").fillna(0.0, ["coverage", "entropy"])


def scene_of(stem: Column) -> Column:
    """The scene in a name of the form scene_row_col_number."""
    return F.regexp_replace(stem, r"(_[^_]*){3}$", "")


def hold_out_scene(files: DataFrame, prefer: str = "nac") -> DataFrame:
    """files(stem) with scene and validation: the last scene of the preferred kind, or of all, is held out as a whole."""
    placed = files.withColumn("scene", scene_of(F.col("stem")))
    last = placed.agg(F.coalesce(F.max(F.when(F.col("scene").startswith(prefer), F.col("scene"))), F.max("scene")).alias("held"))
    return placed.join(F.broadcast(last)).withColumn("validation", F.col("scene") == F.col("held")).drop("held")  # one row


def filter_bites(products: DataFrame, by: str, condition: Column) -> DataFrame:
    """Per group: products, those within the condition, and whether it made them fewer; a group without any fails."""
    g = products.groupBy(by).agg(F.count("*").alias("unfiltered"), F.count_if(condition).alias("filtered"))
    return g.withColumn("bites", (F.col("unfiltered") > 0) & (F.col("filtered") < F.col("unfiltered")))


def coverage_verdict(counts: DataFrame, by: str, kinds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Per box the number of products of each kind in counts(by, kind): complete if all are equal, partial, or none."""
    n = [F.count_if(F.col("kind") == k) for k in kinds]
    g = counts.groupBy(by).agg(F.least(*n).alias("least"), F.greatest(*n).alias("most"))
    return g.withColumn("verdict", F.when(F.col("least") == 0, "none").when(F.col("least") == F.col("most"), "complete").otherwise("partial"))


def first_with_hits(ranked: DataFrame, limit: int) -> DataFrame:
    """The first products in the order of order_key (ties by id) that have hits, as many as are shown."""
    return ranked.where(F.col("hits") > 0).orderBy("order_key", "product_id").limit(limit)


def product_types(catalogues: DataFrame) -> DataFrame:
    """Records with PT and IID at any depth of the JSON documents catalogues(json): iid, pt, products, footprints, incidence.

    A document that is not JSON has no records; documents.json_objects() tells its error. A number of products
    that is none counts as 0.
    """
    field = lambda name: F.get_json_object("body", f"$.{name}")
    number = F.trim(field("NumberProducts"))
    flag = lambda name: F.coalesce(field(name) == "T", F.lit(False)).alias({"ValidFootprints": "footprints", "ValidIncidenceAngles": "incidence"}[name])
    found = json_objects(catalogues.select("json"), "json", "PT", "IID").where(F.col("body").isNotNull())
    return found.select(
        field("IID").alias("iid"), field("PT").alias("pt"), F.when(number.rlike("^-?[0-9]+$"), number.try_cast("long")).otherwise(0).alias("products"), flag("ValidFootprints"), flag("ValidIncidenceAngles")
    ).fillna(0, ["products"])


def type_tally(types: DataFrame) -> DataFrame:
    """Per instrument: product types, products, and the types that can be searched by geometry (footprints and incidence)."""
    return types.groupBy("iid").agg(F.count("*").alias("types"), F.sum("products").alias("products"), F.count_if(F.col("footprints") & F.col("incidence")).alias("searchable"))
