"""Registration of image pairs and the control gate, as plans over DataFrames keyed by pair_id.

No result is reported without its gate row, and a gate never passes by default.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.config import DEFAULT, DOF, Config
from regolith.functions.tables import written
from regolith.operators import fitting, geometry, match_metrics, matching, raster
from regolith.sources import sinks

#: Two rasters to matches: whatever normalisation a method needs is inside.
MatchFunction = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Registration:
    matches: DataFrame
    models: DataFrame
    metrics: DataFrame
    kind: str
    scale_ratio: float


def default_match(matcher: matching.Matcher = matching.correlation_matcher, cfg: Config = DEFAULT) -> MatchFunction:
    """Local contrast on both rasters, then tiled matching."""

    def run(source: DataFrame, reference: DataFrame) -> DataFrame:
        a, b = (raster.local_contrast(x, cfg.contrast_kernel).select("image_id", "r", "c", "u") for x in (source, reference))
        return matching.match_tiles(a, b, matcher, cfg)

    return run


def match_aligned(source: DataFrame, reference: DataFrame, match: MatchFunction, cfg: Config = DEFAULT) -> DataFrame:
    """Coarse offset from a first match, the reference rolled by it, a second match, and the shift undone on the points."""
    off = written(match_metrics.coarse_offset(match(source, reference), cfg).select(F.col("pair_id").alias("image_id"), "dx", "dy"), "offsets")
    size = raster.extent(reference)
    rolled = reference.join(off, "image_id", "left").join(size, "image_id").select(
        "image_id", F.pmod(F.col("r") - F.coalesce("dy", F.lit(0)), "height").alias("r"), F.pmod(F.col("c") - F.coalesce("dx", F.lit(0)), "width").alias("c"), "v"
    )
    back = off.withColumnRenamed("image_id", "pair_id")
    found = match(source, rolled).join(back, "pair_id", "left")
    return found.withColumn("xb", F.col("xb") + F.coalesce("dx", F.lit(0))).withColumn("yb", F.col("yb") + F.coalesce("dy", F.lit(0))).drop("dx", "dy")


def register(
    source: DataFrame, reference: DataFrame, size: float, source_gsd: float | None = None, reference_gsd: float | None = None, native_gsd: float | None = None,
    match: MatchFunction | None = None, kinds: tuple[str, ...] = ("similarity", "affine", "homography"), coarse: bool = True, cfg: Config = DEFAULT,
) -> Registration:
    """Common ground sample distance, contrast, coarse and tiled matching, model choice, fit and metrics of each pair.

    The common grid is the coarser one, so residuals are in its pixels. Pairs of too few matches to choose get a
    similarity; those without a fit are absent from metrics.
    """
    match = match or default_match(cfg=cfg)
    source, reference, ratio = raster.to_common_gsd(source, reference, source_gsd, reference_gsd)
    found = written(match_aligned(source, reference, match, cfg) if coarse else match(source, reference), "matches")
    choice = written(fitting.select_model(found, kinds, cfg).select("pair_id", "best"), "choice")
    chosen = found.select("pair_id").distinct().join(choice, "pair_id", "left").select("pair_id", F.coalesce("best", F.lit("similarity")).alias("kind"))
    taken = {r["kind"] for r in chosen.select("kind").distinct().collect()}  # a kind that no pair takes is not fitted
    models = None
    for kind in (k for k in kinds if k in taken or k == kinds[0]):
        own = found.join(chosen.where(F.col("kind") == kind), "pair_id", "left_semi")
        m = fitting.ransac(own, kind, cfg).withColumn("kind", F.lit(kind))
        models = m if models is None else models.unionByName(m)
    models = written(models, "models")
    fitted = match_metrics.residuals(found, models).withColumn("inlier", F.col("residual") <= cfg.ransac_px)
    common = max(source_gsd, reference_gsd) if source_gsd and reference_gsd else None
    freedom = F.create_map(*(F.lit(x) for k in kinds for x in (k, DOF[k])))[F.col("kind")]
    fitted_of_kind = fitted.join(models.select("pair_id", "kind"), "pair_id").withColumn("dof", freedom).drop("kind")
    metrics = match_metrics.summarise(fitted_of_kind, size, "dof", common, native_gsd or source_gsd)
    return Registration(fitted, models, metrics.join(chosen, "pair_id"), "/".join(kinds), ratio)


def control_gate(source: DataFrame, reference: DataFrame, match: MatchFunction, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, name, passed, matches, real_matches, dx, dy of the four controls, for each pair.

    Real pair, raw source rolled, noise and constant become one relation tagged by control, matched by one plan:
    the input is perturbed, never the normalised image. dx and dy are offsets, of the rolled source less the
    real one's. Where the real pair fails, only its row is reported.
    """
    roll = f"roll +{cfg.control_roll_px} raw"
    source, reference = source.select("image_id", "r", "c", "v"), reference.select("image_id", "r", "c", "v")
    variants = {
        "real pair": source, roll: raster.roll(source, columns=cfg.control_roll_px), "noise": raster.substitute(source, "noise"), "constant": raster.substitute(source, "constant"),
    }
    tag = lambda df, k: df.withColumn("image_id", F.concat_ws("|", "image_id", F.lit(k)))
    src = ref = None
    for k, df in variants.items():
        src = tag(df, k) if src is None else src.unionByName(tag(df, k))
        ref = tag(reference, k) if ref is None else ref.unionByName(tag(reference, k))
    found = written(match(src, ref), "controls")
    names = F.explode(F.array(*map(F.lit, variants))).alias("name")
    wanted = source.select(F.col("image_id").alias("pair_id")).distinct().select("pair_id", names)
    off = match_metrics.offset_mad(found, cfg).select(F.substring_index("pair_id", "|", 1).alias("pair_id"), F.substring_index("pair_id", "|", -1).alias("name"), F.col("n").alias("matches"), "dx", "dy")
    rows = wanted.join(off, ["pair_id", "name"], "left").fillna(0, ["matches"])
    # every control is told by its own figures and the real pair's
    real = off.where(F.col("name") == "real pair").select("pair_id", F.col("matches").alias("real_matches"), F.col("dx").alias("real_dx"), F.col("dy").alias("real_dy"))
    rows = rows.join(real, "pair_id", "left").fillna(0, ["real_matches"])
    rolled = F.col("name") == roll
    for c in ("dx", "dy"):
        rows = rows.withColumn(c, F.when(rolled, F.col(c) - F.col(f"real_{c}")).otherwise(F.col(c)))
    follows = F.coalesce(F.abs(F.col("dx") + cfg.control_roll_px) < cfg.control_roll_tolerance_px, F.lit(False))
    beaten = (F.col("matches") < cfg.min_matches) | (F.col("real_matches") / F.greatest("matches", F.lit(1)) >= cfg.noise_reject_ratio)
    sound = F.col("real_dx").isNotNull()
    passed = F.when(F.col("name") == "real pair", sound).when(rolled, follows).otherwise(beaten)
    return rows.where(sound | (F.col("name") == "real pair")).select("pair_id", "name", passed.alias("passed"), "matches", "real_matches", "dx", "dy")


def deliver(result: Registration, source: DataFrame, height: int, width: int, path: str, extra: dict[str, str] | None = None) -> dict[str, str]:
    """Writes the registered source raster, the match points and the metrics; returns where each is.

    source is on the common grid; each image is warped by its pair's model onto height x width cells.
    """
    paths = {k: f"{path}/{k}" for k in ("raster", "points", "metrics")}
    models = result.models.select(F.col("pair_id").alias("image_id"), "m")
    sinks.write_raster(geometry.warp(source, models, height, width), paths["raster"])
    sinks.write_match_points(result.matches, paths["points"])
    sinks.write_metrics(result.metrics, paths["metrics"], extra)
    return paths


def verdict(gate: DataFrame) -> DataFrame:
    """pair_id, passed: every control, none missing."""
    return gate.groupBy("pair_id").agg((F.bool_and("passed") & (F.count("*") == 4)).alias("passed"))


def report(gate: DataFrame) -> DataFrame:
    """One line of text for each control."""
    shift = F.coalesce(F.format_string(", shifted by (%.1f, %.1f)", "dx", "dy"), F.lit(""))
    word = F.when(F.col("passed"), "holds").otherwise("does not hold")
    return gate.select("pair_id", F.concat(F.col("name"), F.lit(": "), word, F.lit(" with "), F.col("matches").cast("string"), F.lit(" matches"), shift).alias("line"))


def locate_overlap(scores: DataFrame) -> DataFrame:
    """Search profile of each pair from scores(pair_id, row0, matches): best row, most, least and median, most over median, found (at least 3)."""
    g = scores.groupBy("pair_id").agg(
        F.max_by("row0", F.struct("matches", -F.col("row0"))).alias("row0"), F.max("matches").alias("best"), F.min("matches").alias("least"), F.median("matches").alias("middle")
    )
    ratio = F.col("best") / F.greatest("middle", F.lit(1.0))
    return g.select("pair_id", "row0", "best", "least", "middle", ratio.alias("peak"), (ratio >= 3).alias("found"))


def evaluate(matches: DataFrame, gates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per method: windows, mean matches and cross-window spread, of methods whose gate passed.

    matches has method and window beside its columns; gates(method, passed).
    """
    off = match_metrics.offset_mad(matches, cfg, by=("method", "window"))
    ok = gates.where("passed").select("method")
    spread = F.when(F.count("dx") >= 2, F.hypot(F.stddev_pop("dx"), F.stddev_pop("dy")))
    return off.join(ok, "method", "left_semi").groupBy("method").agg(F.count("*").alias("windows"), F.avg("n").alias("mean_matches"), spread.alias("spread"))
