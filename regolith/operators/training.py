"""Windows that a matcher may be trained on, the figures a training run is judged by, and simulated views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regolith.functions.tables import written
from regolith.operators import blocks, features

#: The additive constants of a low-discrepancy sequence in the plane.
STEPS = (0.7548776662466927, 0.5698402909980532)


def drawn_places(images: DataFrame, per_image: int, size: int) -> DataFrame:
    """image_id, row, col of windows spread over images(image_id, height, width) by a low-discrepancy sequence.

    Images smaller than the window have none. The same images always give the same windows.
    """
    k = F.explode(F.sequence(F.lit(1), F.lit(per_image))).alias("k")
    rows = images.where((F.col("height") >= size) & (F.col("width") >= size)).select("image_id", "height", "width", k)
    at = lambda side, step: F.floor(F.pmod(F.col("k") * F.lit(step), F.lit(1.0)) * (F.col(side) - size + 1)).cast("int")
    return rows.select("image_id", at("height", STEPS[0]).alias("row"), at("width", STEPS[1]).alias("col"))


def swath_places(strips: DataFrame, blocks: int, block: int, size: int) -> DataFrame:
    """image_id, row, col of the windows of blocks spaced evenly down strips(image_id, height, width, slope, intercept).

    A block is centred on the imaged swath at its middle row and cut into windows side by side.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k")
    top = F.floor(F.greatest(F.lit(0), F.col("height") - block) * F.col("k") / max(blocks - 1, 1))
    at = strips.select("*", k).withColumn("top", top)
    centre = F.col("slope") * (F.col("top") + block / 2) + F.col("intercept")
    left = F.greatest(F.lit(0), F.least(F.col("width") - block, F.floor(centre - block / 2)))
    steps = lambda name: F.explode(F.array(*(F.lit(i) for i in range(0, block - size + 1, size)))).alias(name)
    at = at.select("image_id", "top", left.alias("left"), steps("dy")).select("*", steps("dx"))
    return at.select("image_id", (F.col("top") + F.col("dy")).cast("int").alias("row"), (F.col("left") + F.col("dx")).cast("int").alias("col"))


def usable_windows(pixels: DataFrame, places: DataFrame, size: int, least_deviation: float = 1.0, most_padding: float = 0.02) -> DataFrame:
    """places whose window is whole, finite, not blank and hardly padded (v <= 0), with its deviation and padding.

    Pixels and windows meet in the blocks that a window touches, four at most, so no window is compared with a whole image.
    """
    touched = lambda axis: F.explode(F.sequence(F.floor(F.col(axis) / size), F.floor((F.col(axis) + size - 1) / size)))
    spread = places.distinct().withColumn("br", touched("row")).withColumn("bc", touched("col"))
    cells = pixels.select("image_id", "r", "c", "v", F.floor(F.col("r") / size).alias("br"), F.floor(F.col("c") / size).alias("bc"))
    inside = F.col("r").between(F.col("row"), F.col("row") + size - 1) & F.col("c").between(F.col("col"), F.col("col") + size - 1)
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    g = spread.join(cells, ["image_id", "br", "bc"]).where(inside).groupBy("image_id", "row", "col").agg(
        F.count_if(finite).alias("cells"), F.stddev_pop(F.when(finite, F.col("v"))).alias("deviation"), F.avg(F.when(finite, (F.col("v") <= 0).cast("int"))).alias("padding")
    )
    return g.where((F.col("cells") == size * size) & (F.col("deviation") >= least_deviation) & (F.col("padding") <= most_padding)).drop("cells")


def without_evaluation(places: DataFrame, held: DataFrame) -> DataFrame:
    """places on images that no evaluation in held(image_id) uses."""
    return places.join(held.select("image_id").distinct(), "image_id", "left_anti")


def after_first(files: DataFrame, by: str, skip: int) -> DataFrame:
    """files without the first `skip` names of each group, which an evaluation uses."""
    order = Window.partitionBy(by).orderBy("name")
    return files.withColumn("_k", F.dense_rank().over(order)).where(F.col("_k") > skip).drop("_k")


def coarse_figures(confidence: DataFrame, truth: DataFrame, alpha: float = 0.25, gamma: float = 2.0, least: float = 1e-6) -> DataFrame:
    """Per pair_id of confidence(pair_id, i, j, conf): precision and focal loss against the true cells truth(pair_id, i, j).

    precision is the share of true cells that are their source cell's most confident one (ties go to the smaller j);
    the loss is the focal cross entropy averaged over true cells plus that averaged over all others. Confidences
    that are null are no cells; either figure is NULL where it has nothing to average.
    """
    keys = ["pair_id", "i", "j"]
    known = truth.select(*keys).distinct().withColumn("_true", F.lit(True))
    p = F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col("conf")))
    marked = confidence.where(F.col("conf").isNotNull()).select(*keys, "conf", p.alias("p")).join(known, keys, "left").withColumn("t", F.col("_true").isNotNull())
    near = -alpha * F.pow(1 - F.col("p"), F.lit(gamma)) * F.ln("p")
    far = -(1 - alpha) * F.pow("p", F.lit(gamma)) * F.ln(1 - F.col("p"))
    rows = marked.groupBy("pair_id", "i").agg(
        F.max_by("t", F.struct("conf", -F.col("j"))).alias("hit"), F.count_if("t").alias("n"), F.count_if(~F.col("t")).alias("rest"),
        F.sum(F.when(F.col("t"), near)).alias("near"), F.sum(F.when(~F.col("t"), far)).alias("far"),
    )
    n = F.sum("n")
    return rows.groupBy("pair_id").agg(
        n.alias("true_cells"), F.try_divide(F.count_if("hit"), n).alias("precision"), (F.try_divide(F.sum("near"), n) + F.try_divide(F.sum("far"), F.sum("rest"))).alias("loss")
    )


def confident(matches: DataFrame, least: float = 0.5) -> DataFrame:
    """Per pair the matches of at least that confidence, pairs without any included."""
    return matches.groupBy("pair_id").agg(F.count_if(F.col("conf") >= least).alias("confident"))


def provenance(weights: DataFrame, reports: DataFrame) -> DataFrame:
    """Per file of weights(file): what its training report reports(file, json) leaves in doubt, and whether it is sound.

    unsaved: the run kept no checkpoint; no_baseline, no_guard: it knew no matches of a real pair, before or by epoch.
    A report that is missing or is no JSON leaves these NULL, and is not sound.
    """
    doc = F.try_parse_json("json")
    get = lambda path, kind="variant": F.try_variant_get(doc, path, kind)
    told = reports.select(
        "file", F.lit(True).alias("found"), doc.isNotNull().alias("readable"), F.coalesce(~get("$.checkpoint_saved", "boolean"), F.lit(False)).alias("unsaved"),
        get("$.baseline_real_matches").isNull().alias("no_baseline"), get("$.history[0].real_matches").isNull().alias("no_guard"),
    )
    doubts = ("unsaved", "no_baseline", "no_guard")
    out = weights.select("file").join(told, "file", "left")
    ok = F.coalesce(F.col("readable"), F.lit(False))
    clean = ok & ~(F.coalesce(F.col("unsaved"), F.lit(True)) | F.coalesce(F.col("no_baseline"), F.lit(True)) | F.coalesce(F.col("no_guard"), F.lit(True)))
    return out.select("file", F.coalesce("found", F.lit(False)).alias("found"), ok.alias("readable"), *(F.when(ok, F.col(c)).alias(c) for c in doubts), clean.alias("sound"))


def tile_code(product: Column, stems: tuple[str, ...]) -> Column:
    """The bare code of a tile: the product id without the stem it begins with, in upper case; NULL without a known stem."""
    upper = F.upper(product)
    return F.coalesce(*(F.when(upper.startswith(s.upper()), F.substr(upper, F.lit(len(s) + 1))) for s in stems))


def skew_view(pixels: DataFrame, tilt: float, phi_deg: float) -> DataFrame:
    """Each image as seen under a tilt: turned by phi about its origin into its bounding box, blurred along rows by
    0.8 sqrt(tilt^2 - 1) (mirrored borders), and squashed to a tilt-th of its width by nearest columns.

    The turn samples bilinearly, 0 outside of the image. The bounding box of a long strip is nearly empty, and grows with the square
    of its length: blocks of the view that see the image are worked out from their boxes of it, the cells of all others are but
    counted up.
    """
    tiled = written(blocks.to_blocks(pixels), "blocks")
    sizes = tiled.groupBy("image_id").agg(F.max(F.col("r0") + F.col("h")).alias("h"), F.max(F.col("c0") + F.col("w")).alias("w"))
    placed = written(features.placed_views(sizes, [(0, tilt, phi_deg)]), "views")
    seen = written(features.view_blocks(tiled, placed, 0.0), "view_blocks").withColumn("image_id", F.expr("substr(image_id, 3)"))  # without "0:"
    side, zero = blocks.SIDE, F.lit(0)
    steps = lambda n: F.explode(F.sequence(zero, F.floor((n - 1) / side).cast("int")))
    every = placed.select("image_id", "h2", F.greatest(F.lit(1), F.rint(F.col("w2") / F.col("tilt")).cast("int")).alias("out")).withColumn("ty", steps(F.col("h2"))).withColumn("tx", steps(F.col("out")))
    # dealt out by number, as the row of a block becomes thousands
    parts = max(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    empty = every.join(seen.select("image_id", "ty", "tx"), ["image_id", "ty", "tx"], "left_anti").repartition(parts, "image_id", "ty", "tx")
    cells = lambda at, n: F.explode(F.sequence(F.col(at) * side, F.least(F.col(n), (F.col(at) + 1) * side) - 1))
    rest = empty.withColumn("r", cells("ty", "h2")).withColumn("c", cells("tx", "out")).select("image_id", "r", "c", F.lit(0.0).alias("v"))
    return blocks.to_cells(seen).select("image_id", "r", "c", "v").unionByName(rest)


def blur_weights(sigma: float) -> list[float]:
    """A normalised Gaussian over three deviations to each side."""
    half = max(1, round(3 * sigma))
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    return [k / sum(raw) for k in raw]
