"""Product catalogues: footprints, tile overlaps, complete triples, labels, file lists and result audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regolith.functions.tables import written

CORNERS = ("UL", "UR", "BL", "BR")
#: Incidence bins in degrees, half open but for the last.
INCIDENCE_BINS = ((0, 30), (30, 50), (50, 70), (70, 90))


def bbox(records: DataFrame) -> DataFrame:
    """records with west, east, south, north from four corner pairs, which may be text.

    Corners that do not parse are left out; NULL below two corners, for latitudes beyond 90 and spans over 180.
    """
    take = lambda axis: F.filter(F.transform(F.array(*(F.col(f"{c}_{axis}").cast("string") for c in CORNERS)), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    lat, lon = take("LAT"), F.transform(take("LON"), lambda x: F.pmod(x, F.lit(360.0)))
    s, n, w, e = F.array_min(lat), F.array_max(lat), F.array_min(lon), F.array_max(lon)
    ok = (F.size(lat) >= 2) & (F.size(lon) >= 2) & (s >= -90) & (n <= 90) & (e - w <= 180)
    return records.select("*", *(F.when(ok, v).alias(k) for k, v in (("west", w), ("east", e), ("south", s), ("north", n))))


def probe_box(footprints: DataFrame, at_lat: float, degrees: float = 1.0) -> DataFrame:
    """A box of a degree where a strip crosses a latitude, no wider than the strip; strips that do not cross it have none."""
    lon, h = (F.col("west") + F.col("east")) / 2, degrees / 2
    return footprints.where(F.lit(at_lat).between(F.col("south"), F.col("north"))).select(
        "product_id", F.greatest("west", lon - h).alias("west"), F.least("east", lon + h).alias("east"), F.lit(at_lat - h).alias("south"), F.lit(at_lat + h).alias("north")
    )


def area_deg2() -> Column:
    return F.greatest(F.col("east") - F.col("west"), F.lit(1e-9)) * F.greatest(F.col("north") - F.col("south"), F.lit(1e-9))


_SIDES = ("west", "east", "south", "north")
#: Tiles of one box that are kept as one list.
LIST = 4096


def _cells(df: DataFrame, cell: float, west: str, east: str) -> DataFrame:
    """One row for each grid column that a box touches."""
    return df.withColumn("kx", F.explode(F.sequence(F.floor(F.col(west) / cell), F.floor(F.col(east) / cell))))


def _boxes(tiles: DataFrame, *figures: Column) -> DataFrame:
    """The distinct boxes of tiles as t_west, t_east, t_south, t_north with figures of the tiles that have each.

    Catalogues repeat boxes (a grid's cells, a product's versions): what is asked of a tile's box alone is worked out
    once for a box. The table is written, so that joins know its size.
    """
    return written(tiles.groupBy(*(F.col(c).alias(f"t_{c}") for c in _SIDES)).agg(*figures), "boxes")


def _met(footprints: DataFrame, boxes: DataFrame, cell: float = 6.0) -> DataFrame:
    """footprints and boxes that overlap with positive area, and the area.

    They meet in grid cells by an equi-join; a pair is taken in the one cell of its overlap's lower corner.
    """
    rows = lambda df, south, north: df.withColumn("ky", F.explode(F.sequence(F.floor(F.col(south) / cell), F.floor(F.col(north) / cell))))
    both = rows(_cells(footprints, cell, "west", "east"), "south", "north").join(rows(_cells(boxes, cell, "t_west", "t_east"), "t_south", "t_north"), ["kx", "ky"])
    w, s = F.greatest("west", "t_west"), F.greatest("south", "t_south")
    ow, oh = F.least("east", "t_east") - w, F.least("north", "t_north") - s
    first = (F.floor(w / cell) == F.col("kx")) & (F.floor(s / cell) == F.col("ky"))
    return both.where((ow > 0) & (oh > 0) & first).withColumn("area", ow * oh).drop("kx", "ky")


def overlap(footprints: DataFrame, tiles: DataFrame, cell: float = 6.0, digits: int | None = None) -> DataFrame:
    """product_id, instrument, tile_id, area (rounded to the digits) of every footprint and tile whose boxes overlap with positive area.

    Footprints meet the distinct boxes; each pair then takes the tiles of its box, which lie in lists of about LIST.
    """
    sides = [f"t_{c}" for c in _SIDES]
    boxes = _boxes(tiles, F.ceil(F.count("*") / LIST).cast("int").alias("lots"))
    own = tiles.select("tile_id", *(F.col(c).alias(f"t_{c}") for c in _SIDES)).join(boxes, sides)
    lists = own.groupBy(*sides, F.pmod(F.xxhash64("tile_id"), "lots").cast("int").alias("lot")).agg(F.collect_list(F.struct("tile_id")).alias("of_box"))
    area = F.col("area") if digits is None else F.round("area", digits) + 0.0
    pairs = _met(footprints, boxes, cell).select("product_id", "instrument", *sides, area.alias("area"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    # a pair is a short row and becomes thousands, so pairs are dealt out by number, not by bytes
    parts = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = pairs.repartition(parts, "product_id", "lot").join(written(lists, "lists"), [*sides, "lot"])
    return met.select("product_id", "instrument", F.explode("of_box").alias("t"), "area").select("product_id", "instrument", "t.tile_id", "area")


def containing_tile(strips: DataFrame, tiles: DataFrame, check_north: bool = True, cell: float = 6.0) -> DataFrame:
    """The first tile that contains each strip; without check_north the northern edge is not looked at."""
    t = _cells(_boxes(tiles, F.min("tile_id").alias("tile_id")), cell, "t_west", "t_east")
    at, keys = strips.withColumn("kx", F.floor(F.col("west") / cell)), ["kx"]
    inside = (F.col("t_west") <= F.col("west")) & (F.col("t_east") >= F.col("east")) & (F.col("t_south") <= F.col("south"))
    if check_north:
        t = t.withColumn("ky", F.explode(F.sequence(F.floor(F.col("t_south") / cell), F.floor(F.col("t_north") / cell))))
        at, keys = at.withColumn("ky", F.floor(F.col("south") / cell)), ["kx", "ky"]
        inside = inside & (F.col("t_north") >= F.col("north"))
    return at.join(t, keys).where(inside).groupBy("product_id").agg(F.min("tile_id").alias("tile_id"))


def rank_products(footprints: DataFrame, tiles: DataFrame, at_lat: float | None = None) -> DataFrame:
    """Products by how much reference they cover: hits, area, density; smallest strips first at a latitude, else nearest the equator."""
    base = footprints if at_lat is None else probe_box(footprints, at_lat).join(footprints.select("product_id", "instrument"), "product_id")
    met = _met(base, _boxes(tiles, F.count("*").alias("tiles")))
    hits = met.groupBy("product_id").agg(F.sum("tiles").alias("hits"), F.sum(F.col("tiles") * F.col("area")).alias("covered"))
    out = footprints.join(hits, "product_id").withColumn("density", F.col("hits") / area_deg2())
    order = area_deg2() if at_lat is not None else F.abs((F.col("south") + F.col("north")) / 2)
    return out.select("product_id", "hits", "covered", "density", order.alias("order_key"))


def pick_products(footprints: DataFrame, references: DataFrame, at_lat: float | None = None, max_lat: float = 90.0, bins=INCIDENCE_BINS) -> DataFrame:
    """Products worth fetching: the references(tile_id, box, incidence) that each meets, by number, density and incidence.

    Without at_lat the whole box of a product within max_lat is scored, and those nearest the equator come first; with
    it a probe box where a strip crosses that latitude, and the smallest strips come first. illuminations counts the
    incidence bins that hold two references or more. Products that meet none are left out.
    """
    if at_lat is None:
        near = footprints.where(F.abs((F.col("south") + F.col("north")) / 2) <= max_lat)
        scored, order = near, F.abs((F.col("south") + F.col("north")) / 2)
    else:
        near = footprints.where(F.lit(at_lat).between(F.col("south"), F.col("north")) & F.lit(abs(at_lat) <= max_lat))
        scored, order = probe_box(near, at_lat).join(near.select("product_id", "instrument"), "product_id"), area_deg2()
    last = len(bins) - 1
    counts = [F.count_if((F.col("incidence") >= lo) & ((F.col("incidence") <= hi) if i == last else (F.col("incidence") < hi))).alias(f"lit_{i}") for i, (lo, hi) in enumerate(bins)]
    met = _met(scored, _boxes(references, F.count("*").alias("tiles"), *counts))
    hits = met.groupBy("product_id").agg(F.sum("tiles").alias("hits"), sum((F.sum(f"lit_{i}") >= 2).cast("int") for i in range(len(bins))).alias("illuminations"))
    area = scored.select("product_id", area_deg2().alias("_area"))
    out = near.join(hits, "product_id").join(area, "product_id")
    return out.select("product_id", "hits", (F.col("hits") / F.col("_area")).alias("density"), "illuminations", (F.col("illuminations") >= 2).alias("multi"), order.alias("order_key"))


def latitude_band(lat: Column) -> Column:
    return F.when(lat < -60, "south polar").when(lat < -20, "south mid").when(lat <= 20, "equatorial").when(lat <= 60, "north mid").otherwise("north polar")


def band_histogram(footprints: DataFrame) -> DataFrame:
    return footprints.groupBy("instrument", latitude_band((F.col("south") + F.col("north")) / 2).alias("band")).agg(F.count("*").alias("products"))


def incidence_histogram(products: DataFrame, angle: str, bins=INCIDENCE_BINS) -> DataFrame:
    """lo, hi, n and whether at least two bins hold two products or more."""
    bin_ = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(bins))):
        last = i == len(bins) - 1
        bin_ = F.when((F.col(angle) >= lo) & ((F.col(angle) <= hi) if last else (F.col(angle) < hi)), F.lit(i)).otherwise(bin_)
    counts = products.select(bin_.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"))
    multi = counts.agg((F.count_if(F.col("n") >= 2) >= 2).alias("multi"))
    edges = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in bins))
    return counts.crossJoin(F.broadcast(multi)).select("bin", F.element_at(edges, F.col("bin") + 1)["lo"].alias("lo"), F.element_at(edges, F.col("bin") + 1)["hi"].alias("hi"), "n", "multi")


def complete_tiles(files: DataFrame, kinds: int = 3) -> DataFrame:
    """Tiles that have files of all kinds, with their size."""
    return files.groupBy("tile").agg(F.count_distinct("kind").alias("kinds"), F.sum("kbytes").alias("kbytes")).where(F.col("kinds") == kinds).select("tile", "kbytes")


def completeness(files: DataFrame, kinds: int = 3) -> DataFrame:
    """Per tile: its kinds and the verdict complete or partial."""
    return files.groupBy("tile").agg(F.count_distinct("kind").alias("kinds")).withColumn("verdict", F.when(F.col("kinds") == kinds, "complete").otherwise("partial"))


def largest_file(files: DataFrame, suffix: str, excluded: str = "browse") -> DataFrame:
    """Per tile the largest file of the suffix whose path does not name the excluded kind; ties go to the smaller path."""
    fit = files.where(F.col("path").endswith(suffix) & ~F.lower("path").contains(excluded))
    return fit.groupBy("tile").agg(F.min(F.struct((-F.col("kbytes")).alias("k"), "path")).alias("b")).select("tile", F.col("b.path").alias("path"), (-F.col("b.k")).alias("kbytes"))


def grid_mismatches(scenes: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Fields of which a key has more than one value: key, field, distinct values."""
    flat = scenes.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select(key, "x.*")
    return flat.groupBy(key, "field").agg(F.count_distinct("value").alias("values")).where(F.col("values") > 1)


def parse_label(text: Column) -> Column:
    """Array of (key, value) of KEY = value lines; the first of a key wins, quotes and blanks around are taken off."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^=]*=", "")), '^"|"$', "").alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    return F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)


def number_list(text: Column, key: str) -> Column:
    """Numbers of a `key = { a, b, ... }` header entry."""
    inside = F.regexp_extract(text, rf"(?is)\b{key}\s*=\s*\{{([^}}]*)\}}", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def nearest_band(bands: DataFrame, target_nm: float) -> DataFrame:
    """image_id, band, wavelength_nm of the band nearest to a wavelength; the first of equals."""
    d = F.abs(F.col("wavelength_nm") - target_nm)
    return bands.groupBy("image_id").agg(F.min(F.struct(d.alias("d"), "band", "wavelength_nm")).alias("b")).select("image_id", "b.band", "b.wavelength_nm")


def product_files(products: DataFrame, json: str = "json") -> DataFrame:
    """product_id and a row for each file of a product's JSON, whether it holds one file or a list of them."""
    one = "struct<FileName:string,URL:string,KBytes:string>"
    node = F.get_json_object(json, "$.Product_files.Product_file")
    files = F.when(F.ltrim(node).startswith("["), F.from_json(node, f"array<{one}>")).when(node.isNotNull(), F.array(F.from_json(node, one)))
    return products.select("product_id", F.explode(files).alias("f")).select("product_id", "f.FileName", "f.URL", F.col("f.KBytes").try_cast("double").alias("kbytes"))


def gate_audit(reports: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Verdict of each file from reports(file, name, passed): a failed real pair stands alone, all else needs every check.

    No report ever passes by default: files without checks are missing.
    """
    g = reports.groupBy("file").agg(F.bool_and("passed").alias("all_passed"), F.collect_set("name").alias("names"), F.bool_or((F.col("name") == "real pair") & ~F.col("passed")).alias("no_pair"))
    lacking = F.size(F.array_except(F.array(*map(F.lit, required)), F.col("names")))
    verdict = F.when(F.col("no_pair"), "failed").when(lacking > 0, "malformed").when(F.col("all_passed"), "passed").otherwise("failed")
    return g.select("file", verdict.alias("verdict"), F.size("names").cast("long").alias("checks"))


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required keys that are not there."""
    return required.join(present, key, "left_anti")


def accepted_epochs(history: DataFrame, baseline: float, real: float, keep: float = 0.8) -> DataFrame:
    """Epochs at which validation precision passes all before (and the baseline), with enough real matches kept."""
    before = F.max(F.when(F.col("real_matches") >= keep * real, F.col("val_prec"))).over(Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    ok = (F.col("val_prec") > F.greatest(F.coalesce(before, F.lit(baseline)), F.lit(baseline))) & (F.col("real_matches") >= keep * real)
    return history.withColumn("accepted", ok)


def search(records: DataFrame, needle: str) -> DataFrame:
    """Records whose serialised form holds the text, in any case."""
    return records.where(F.lower(F.to_json(F.struct("*"))).contains(needle.lower()))


def repaired_name(name: Column, suffix: str = "_srd") -> Column:
    """The served name: the suffix stands once, at the end of the stem."""
    return F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))
