"""Bands of two swaths compared on one grid, over the ground that they share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.config import DEFAULT, Config
from regolith.functions.tables import written
from regolith.operators import geometry as ge
from regolith.plans import registration

#: What marks no data in reflectance, pixels within which a sample is that of a point, and samples across a degree of fit.
IGNORE = -999.0
NEAR_PX = 0.75


@dataclass(frozen=True)
class Swath:
    """An image of one id: cube(image_id, band, r, c, v), bands(image_id, band, wavelength_nm), geoloc(image_id, r, c, lon, lat)."""

    cube: DataFrame
    bands: DataFrame
    geoloc: DataFrame
    ignore: float | None = None


@dataclass(frozen=True)
class Ground:
    """What two swaths share, and their ground sample distances in metres."""

    west: float
    south: float
    east: float
    north: float
    gsd_a: float
    gsd_b: float

    @property
    def gsd(self) -> float:
        return max(self.gsd_a, self.gsd_b)


def shared_ground(a: DataFrame, b: DataFrame) -> DataFrame:
    """west, south, east, north, gsd_a, gsd_b, shares of two swaths' geolocations: one grid for both, at the coarser distance.

    Each swath on the grid of its own bounds would have its own origin, and the two would never lie upon each other.
    One row; shares is false where they meet in no area (or one has no samples).
    """
    def told(g: DataFrame, tag: str) -> DataFrame:
        edges = g.agg(F.min("lon").alias(f"w{tag}"), F.max("lon").alias(f"e{tag}"), F.min("lat").alias(f"s{tag}"), F.max("lat").alias(f"n{tag}"))
        return edges.join(ge.ground_gsd(g).agg(F.avg("gsd_m").alias(f"gsd_{tag}")))  # one row each

    both = told(a, "a").join(told(b, "b")).select(
        F.when(F.col("wa") > F.col("wb"), F.col("wa")).otherwise(F.col("wb")).alias("west"), F.when(F.col("sa") > F.col("sb"), F.col("sa")).otherwise(F.col("sb")).alias("south"),
        F.when(F.col("ea") < F.col("eb"), F.col("ea")).otherwise(F.col("eb")).alias("east"), F.when(F.col("na") < F.col("nb"), F.col("na")).otherwise(F.col("nb")).alias("north"),
        "gsd_a", "gsd_b", (F.col("wa").isNotNull() & F.col("wb").isNotNull() & F.col("gsd_a").isNotNull() & F.col("gsd_b").isNotNull()).alias("known"),
    )
    return both.withColumn("shares", F.coalesce(F.col("known") & (F.col("east") > F.col("west")) & (F.col("north") > F.col("south")), F.lit(False))).drop("known")


def ground_of(a: DataFrame, b: DataFrame) -> Ground | None:
    """shared_ground() for the driver's plan; None where nothing is shared."""
    row = shared_ground(a, b).first()
    return Ground(*(row[k] for k in ("west", "south", "east", "north", "gsd_a", "gsd_b"))) if row["shares"] else None


def on_grid(pixels: DataFrame, geoloc: DataFrame, grid: DataFrame, ignore: float | None = None, degree: int = 3) -> DataFrame:
    """image_id, r, c, v, valid of all images of one swath's geometry on the grid: a cell of the ignored value is 0 and not valid."""
    samples = geoloc.withColumn("pixel", F.col("c").cast("double")).withColumn("scan", F.col("r").cast("double"))
    model = ge.fit_inverse(samples, degree)
    px, py = ge.apply_inverse(model)
    at = grid.select(F.col("r").alias("gr"), F.col("c").alias("gc"), F.rint(py).cast("int").alias("r"), F.rint(px).cast("int").alias("c"))
    images = pixels.select("image_id").distinct()  # bands and turns of one swath
    met = at.join(images).join(pixels.select("image_id", "r", "c", "v"), ["image_id", "r", "c"], "left")
    good = F.col("v").isNotNull() if ignore is None else F.coalesce(F.col("v") != ignore, F.lit(False))
    return met.select("image_id", F.col("gr").alias("r"), F.col("gc").alias("c"), F.when(good, F.col("v")).otherwise(0.0).alias("v"), good.alias("valid"))


def nearest_on_ground(points: DataFrame, samples: DataFrame, gsd_m: float, lat: float, within_px: float = NEAR_PX, radius_m: float = DEFAULT.moon_radius_m) -> DataFrame:
    """id, sid, d of the nearest sample(sid, lon, lat) within pixels of each point(id, lon, lat), d in pixels.

    Longitudes are scaled by cos(lat) of the middle latitude, so distances are those on the ground.
    """
    px = F.lit(radius_m / gsd_m)
    flat = lambda df, key, x, y: df.select(key, (F.radians("lon") * F.cos(F.radians(F.lit(lat))) * px).alias(x), (F.radians("lat") * px).alias(y))
    return ge.nearest_sample(flat(points, "id", "x", "y"), flat(samples, "sid", "sx", "sy"), within_px)


def tagged_bands(swath: Swath, wavelengths: tuple[float, ...], mirrored: tuple[bool, ...], turn: bool) -> DataFrame:
    """image_id (wavelength:mirrored), r, c, v: the band nearest to each wavelength, its columns turned round where asked and this swath is the one to turn."""
    name = lambda nm: F.lit(f"{nm:g}:")
    width = swath.cube.agg((F.max("c") + 1).alias("width"))
    out = None
    for nm in wavelengths:
        own = swath.cube.join(ge.nearest_band(swath.bands, nm).select("image_id", "band"), ["image_id", "band"])
        flips = F.explode(F.array(*map(F.lit, mirrored))).alias("mirrored")
        own = own.select("r", "c", "v", flips).withColumn("image_id", F.concat(name(nm), F.col("mirrored").cast("string")))
        out = own if out is None else out.unionByName(own)
    c = F.when(F.col("mirrored"), F.col("width") - 1 - F.col("c")).otherwise(F.col("c")) if turn else F.col("c")
    return out.join(F.broadcast(width)).select("image_id", "r", c.cast("int").alias("c"), "v")  # one row


def compare(
    a: Swath, b: Swath, wavelengths: tuple[float, ...], mirrored: tuple[bool, ...] = (False, True), match: registration.MatchFunction | None = None, gated: bool = True, cfg: Config = DEFAULT
) -> DataFrame:
    """wavelength_nm, mirrored, registered, reason, overlap, gsd_a, gsd_b, scale_ratio, the metrics and gate of a's bands against b's.

    All wavelengths, b's columns as they are and turned round (some products are stored so), are images of one
    relation: matched, fitted and gated by one plan. overlap is the share of the grid that is valid in both.
    """
    spark, ground = a.cube.sparkSession, ground_of(a.geoloc, b.geoloc)
    cases = spark.createDataFrame([(f"{nm:g}:{str(m).lower()}", float(nm), m) for nm in wavelengths for m in mirrored], "pair_id string, wavelength_nm double, mirrored boolean")
    if ground is None:
        return cases.select("wavelength_nm", "mirrored", F.lit(False).alias("registered"), F.lit("no shared ground").alias("reason"))
    grid = ge.target_grid(spark, ground.west, ground.south, ground.east, ground.north, ground.gsd, cfg.moon_radius_m)
    src = written(on_grid(tagged_bands(a, wavelengths, mirrored, False), a.geoloc, grid, a.ignore), "swath_a")
    ref = written(on_grid(tagged_bands(b, wavelengths, mirrored, True), b.geoloc, grid, b.ignore), "swath_b")
    valid = src.join(ref.select("image_id", "r", "c", F.col("valid").alias("also")), ["image_id", "r", "c"])
    overlap = valid.groupBy(F.col("image_id").alias("pair_id")).agg(F.avg((F.col("valid") & F.col("also")).cast("int")).alias("overlap"))
    size = float(max(grid.agg(F.max("r"), F.max("c")).first()) + 1)
    match = match or registration.default_match(cfg=cfg)
    pixels = [x.select("image_id", "r", "c", "v") for x in (src, ref)]
    metrics = registration.register(*pixels, size, ground.gsd, ground.gsd, match=match, cfg=cfg).metrics
    rows = cases.join(overlap, "pair_id", "left").join(metrics, "pair_id", "left").withColumn("registered", F.col("kind").isNotNull() & F.col("match_count").isNotNull())
    rows = rows.withColumn("reason", F.when(~F.col("registered"), "no fit"))
    if gated:
        rows = rows.join(registration.verdict(registration.control_gate(*pixels, match, cfg)).withColumnRenamed("passed", "gate"), "pair_id", "left").fillna(False, ["gate"])
    rows = rows.withColumns({"gsd_a": F.lit(ground.gsd_a), "gsd_b": F.lit(ground.gsd_b), "scale_ratio": F.lit(ground.gsd_b / ground.gsd_a)})
    shown = ["match_count", "inlier_ratio", "rmse_px", "coverage", "entropy"]
    return rows.select("wavelength_nm", "mirrored", "registered", "reason", "overlap", "gsd_a", "gsd_b", "scale_ratio", *shown, F.col("kind").alias("model"), *(["gate"] if gated else []))
