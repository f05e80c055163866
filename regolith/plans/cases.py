"""Methods over cases: every method matches every case, is scored by the same fit and judged by the same controls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.config import DEFAULT, Config
from regolith.functions.tables import written
from regolith.operators import blocks, evaluation, features, fitting, matching, raster
from regolith.plans import registration

#: Makes a method from the constants. A method takes raw rasters: whatever normalisation it needs is inside, so the controls perturb its input.
METHODS: dict[str, Callable[[Config], registration.MatchFunction]] = {}


def method(name: str):
    """Registers a maker of a MatchFunction under a name."""

    def add(make):
        METHODS[name] = make
        return make

    return add


@method("contrast")
def by_contrast(cfg: Config) -> registration.MatchFunction:
    return registration.default_match(cfg=cfg)


@method("stretch")
def by_stretch(cfg: Config) -> registration.MatchFunction:
    """The same tiles and matcher on stretched values, without local contrast."""
    return lambda *pair: matching.match_tiles(*(raster.stretch8(x).select("image_id", "r", "c", F.col("u").cast("double").alias("u")) for x in pair), cfg=cfg)


@method("aligned")
def by_alignment(cfg: Config) -> registration.MatchFunction:
    """Local contrast, a coarse offset first."""
    return lambda source, reference: registration.match_aligned(source, reference, registration.default_match(cfg=cfg), cfg)


def _by_features(of: Callable[[DataFrame], DataFrame]) -> registration.MatchFunction:
    """Both rasters go through one plan, their images told apart by a letter."""
    tagged = lambda x, side: x.select(F.concat(F.lit(side), F.col("image_id").cast("string")).alias("image_id"), "r", "c", "v")
    own = lambda x, side: x.where(F.col("image_id").startswith(side)).withColumn("image_id", F.expr("substr(image_id, 2)"))

    def run(source: DataFrame, reference: DataFrame) -> DataFrame:
        found = of(blocks.to_blocks(raster.stretch8(tagged(source, "a").unionByName(tagged(reference, "b"))), "u"))
        return features.match(own(found, "a"), own(found, "b"))

    return run


@method("features")
def by_features(cfg: Config) -> registration.MatchFunction:
    """Scale-space features of stretched values, nearest descriptors with a ratio test."""
    return _by_features(features.of_blocks)


@method("tilted features")
def by_tilted_features(cfg: Config) -> registration.MatchFunction:
    """The same over simulated tilts of both images."""
    return _by_features(features.of_views)


def match_and_select(source: DataFrame, reference: DataFrame, match: registration.MatchFunction, kinds: tuple[str, ...] = ("similarity", "affine", "homography"), cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The matches of each pair, and the model class that its held-out half asks for; no terrain, no metrics."""
    found = written(match(source, reference), "matches")
    return found, fitting.select_model(found, kinds, cfg)


def run(source: DataFrame, reference: DataFrame, size: float, methods: dict[str, registration.MatchFunction], gated: bool = True, kind: str = "affine", least_inliers: int = 0, cfg: Config = DEFAULT) -> DataFrame:
    """case, method, matches, the figures of the fit, gate and error for each method and each image_id that both rasters have.

    The matches of all methods are one relation, so one plan fits and scores them. A case that a method finds nothing
    in has 0 matches. A method that fails has its error in every case, and the others go on: it is NULL elsewhere, as
    are a failed one's figures. Without the gate the figures are not reportable and the column gate is absent.
    """
    spark = source.sparkSession
    keys = list(methods)  # a handful, each a plan of its own
    found, gates, errors = None, None, {}
    for i, name in enumerate(keys):
        tag = F.concat(F.lit(f"{i}:"), F.col("pair_id").cast("string")).alias("tagged")
        try:
            own = written(methods[name](source, reference).select(tag, "match_id", "xa", "ya", "xb", "yb"), "matches")
            gate = written(registration.verdict(registration.control_gate(source, reference, methods[name], cfg)).select(tag, F.col("passed").alias("gate")), "gate") if gated else None
        except (PySparkException, ValueError, ArithmeticError) as e:
            errors[i] = f"{type(e).__name__}: {e}".splitlines()[0]
            continue
        found = own if found is None else found.unionByName(own)
        if gate is not None:
            gates = gate if gates is None else gates.unionByName(gate)
    both = source.select("image_id").distinct().join(reference.select("image_id").distinct(), "image_id", "left_semi")
    told = spark.createDataFrame([(i, name, errors.get(i)) for i, name in enumerate(keys)], "i int, method string, error string")
    rows = both.join(F.broadcast(told)).select(F.col("image_id").alias("case"), "method", "error", F.concat(F.col("i").cast("string"), F.lit(":"), F.col("image_id").cast("string")).alias("pair_id"))
    if found is not None:
        scores = evaluation.fit_scores(found.withColumnRenamed("tagged", "pair_id"), size, kind, least_inliers, cfg)
    else:
        scores = rows.select("pair_id", F.lit(0).cast("long").alias("matches"), F.lit(None).cast("long").alias("inlier_count"), *(F.lit(None).cast("double").alias(c) for c in ("inlier_ratio", "rmse_px", "coverage", "entropy"))).limit(0)
    rows = rows.join(scores, "pair_id", "left")
    sound = F.col("error").isNull()
    rows = rows.withColumns({c: F.when(sound, F.coalesce(c, F.lit(0))) for c in ("matches", "coverage", "entropy")})
    if gated:
        rows = rows.join(gates.withColumnRenamed("tagged", "pair_id"), "pair_id", "left") if gates is not None else rows.withColumn("gate", F.lit(False))
        rows = rows.fillna(False, ["gate"])
    shown = ["matches", "inlier_count", "inlier_ratio", "rmse_px", "coverage", "entropy"]
    return rows.select("case", "method", *shown, *(["gate"] if gated else []), "error")
