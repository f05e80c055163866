"""Image files, flat strips and written tiles against arrays; pushed windows read only their bytes."""

import struct
import tempfile
import zlib

import numpy as np
import pytest
from pyarrow import fs as files
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from regolith.sources import images


def cells_of(df):
    return {(r["image_id"], r["band"], r["r"], r["c"]): r["v"] for r in df.collect()}


def want(image, grid, band=1, rows=slice(None), cols=slice(None)):
    r, c = np.mgrid[: grid.shape[0], : grid.shape[1]]
    return {(image, band, int(i), int(j)): float(grid[i, j]) for i, j in zip(r[rows, cols].ravel(), c[rows, cols].ravel(), strict=True)}


def png(grid, kinds):
    """Rows filtered by the given kinds in turn."""
    grid = grid.reshape(grid.shape[0], grid.shape[1], -1)
    depth, channels = grid.dtype.itemsize * 8, grid.shape[2]
    step, raw = channels * depth // 8, b""
    data = grid.astype(">u2" if depth == 16 else np.uint8).reshape(len(grid), -1).view(np.uint8).astype(int)
    before = np.zeros(data.shape[1], int)
    for k, line in enumerate(data):
        left, corner = (np.concatenate((np.zeros(step, int), x[:-step])) for x in (line, before))
        p = left + before - corner
        near = np.stack([abs(p - left), abs(p - before), abs(p - corner)]).argmin(0)
        guess = [0, left, before, (left + before) // 2, np.choose(near, [left, before, corner])][kinds[k % len(kinds)]]
        raw += bytes([kinds[k % len(kinds)]]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    z = zlib.compress(raw)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], depth, colour, 0, 0, 0)) + chunk(b"IDAT", z[: len(z) // 2]) + chunk(b"IDAT", z[len(z) // 2 :]) + chunk(b"IEND", b"")


def tiff(grid, order, tile=None, rows=3, deflate=False, predictor=False, planar=False, big=False):
    """A TIFF of strips or tiles, pixel or plane interleaved."""
    grid = grid.reshape(grid.shape[0], grid.shape[1], -1)
    h, w, n = grid.shape
    th, tw = tile or (rows, w)
    parts = []
    for plane in range(n if planar else 1):
        g = grid[:, :, plane : plane + 1] if planar else grid
        for r in range(0, h, th):
            for c in range(0, w, tw):
                part = g[r : r + th, c : c + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                parts.append(zlib.compress(raw) if deflate else raw)
    o, long = order, ("Q" if big else "I")
    kind = 16 if big else 4
    fields = {256: (4, [w]), 257: (4, [h]), 258: (3, [grid.dtype.itemsize * 8] * n), 259: (3, [8 if deflate else 1]), 277: (3, [n]), 284: (3, [2 if planar else 1]), 339: (3, [{"u": 1, "i": 2, "f": 3}[grid.dtype.kind]] * n), 33550: (12, [2.0, 3.0, 0.0]), 33922: (12, [0, 0, 0, 100.0, 50.0, 0])}
    if predictor:
        fields[317] = (3, [2])
    fields |= {322: (4, [tw]), 323: (4, [th])} if tile else {278: (4, [rows])}
    at, sizes = (324, 325) if tile else (273, 279)
    fields[at], fields[sizes] = (kind, [0] * len(parts)), (kind, [len(p) for p in parts])
    codes = {3: "H", 4: "I", 12: "d", 16: "Q"}
    entry, head = (20, 16) if big else (12, 8)
    body = head + (8 if big else 2) + entry * len(fields) + (8 if big else 4)
    length = sum(struct.calcsize(codes[k]) * len(v) for k, v in fields.values() if struct.calcsize(codes[k]) * len(v) > (8 if big else 4))
    place = body + length
    fields[at] = (kind, [place + sum(len(p) for p in parts[:i]) for i in range(len(parts))])
    table = extra = b""
    for tag in sorted(fields):
        k, v = fields[tag]
        value = struct.pack(f"{o}{len(v)}{codes[k]}", *v)
        table += struct.pack(o + "HH" + long, tag, k, len(v))
        if len(value) > (8 if big else 4):
            table += struct.pack(o + long, body + len(extra))
            extra += value
        else:
            table += value.ljust(8 if big else 4, b"\0")
    mark = b"II" if o == "<" else b"MM"
    start = mark + (struct.pack(o + "HHHQ", 43, 8, 0, 16) if big else struct.pack(o + "HI", 42, 8))
    return start + struct.pack(o + ("Q" if big else "H"), len(fields)) + table + b"\0" * (8 if big else 4) + extra + b"".join(parts)


@pytest.fixture(scope="module")
def folder():
    rng = np.random.default_rng(3)
    path, grids = tempfile.mkdtemp(prefix="images-"), {}

    def put(name, data, grid):
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
        grids[name.rsplit(".", 1)[0]] = grid

    for kind in range(5):
        g = rng.integers(0, 256, (9, 7), dtype=np.uint8)
        put(f"png{kind}.png", png(g, [kind]), g)
    g = rng.integers(0, 65536, (600, 5, 3)).astype(np.uint16)
    put("colour.png", png(g, [4, 1, 3, 2, 0]), g)
    g = rng.integers(0, 256, (11, 10, 2)).astype(np.uint8)
    put("strips.tif", tiff(g, "<", rows=4, deflate=True, predictor=True), g)
    g = rng.normal(0, 9, (37, 50)).astype(np.float32)
    put("tiles.tif", tiff(g, ">", tile=(16, 16)), g)
    g = rng.integers(-99, 99, (20, 33, 3)).astype(np.int16)
    put("planes.tiff", tiff(g, "<", tile=(16, 16), deflate=True, planar=True, big=True), g)
    with open(f"{path}/notes.txt", "w") as f:
        f.write("no image")
    return path, grids


def test_image_files(spark, folder):
    path, grids = folder
    expected = {}
    for name, g in grids.items():
        g = g.reshape(*g.shape[:2], -1)
        for b in range(g.shape[2]):
            expected |= want(name, g[:, :, b], b + 1)
    assert cells_of(images.read_images(spark, path)) == expected
    small = images.read_images(spark, path).sparkSession.read.format("raster_files").option("partitionbytes", 500).load(path)
    assert small.rdd.getNumPartitions() > 5 and cells_of(small) == expected


def test_windows_of_image_files(spark, folder):
    path, grids = folder
    df = images.read_images(spark, path)
    for name, band in (("tiles", 1), ("planes", 2), ("colour", 3), ("strips", 1)):
        g = grids[name].reshape(*grids[name].shape[:2], -1)[:, :, band - 1]
        got = df.where((F.col("image_id") == name) & (F.col("band") == band) & F.col("r").between(3, 7) & (F.col("c") >= 2) & (F.col("c") < 6))
        assert cells_of(got) == want(name, g, band, slice(3, 8), slice(2, 6)), name


class Counting:
    """A file that tells what was read of it."""

    def __init__(self, f):
        self.f, self.bytes = f, 0

    def read_at(self, n, at):
        self.bytes += n
        return self.f.read_at(n, at)


def test_a_window_reads_its_tiles_only(folder):
    path, grids = folder
    bounds = images.Bounds()
    for f in (GreaterThanOrEqual(("r",), 17), LessThan(("r",), 20), EqualTo(("c",), 40)):
        bounds.add(f)
    f = Counting(files.LocalFileSystem().open_input_file(f"{path}/tiles.tif"))
    got = sum(b.num_rows for b in images.read_tiff(f, "tiles", bounds))
    whole = Counting(f.f)
    list(images.read_tiff(whole, "tiles", images.Bounds()))
    assert got == 4 and whole.bytes - f.bytes == 11 * 16 * 16 * 4  # r up to 20: the bound is taken as inclusive


def test_flat_strip(spark):
    rng = np.random.default_rng(4)
    grid = rng.normal(0, 9, (2, 300, 64)).astype(">f4")
    path = tempfile.mkdtemp(prefix="strip-") + "/band.img"
    grid.tofile(path)
    df = images.read_strip(spark, path, 64, ">f4", 2)
    assert cells_of(df) == want("band", grid[0]) | want("band", grid[1], 2)
    some = df.where((F.col("band") == 2) & F.col("r").between(100, 104) & F.col("c").between(10, 12))
    assert cells_of(some) == want("band", grid[1], 2, slice(100, 105), slice(10, 13))
    reader = images.FlatStripReader({"path": path, "width": "64", "dtype": ">f4", "bands": "2"})
    list(reader.pushFilters([EqualTo(("band",), 2), GreaterThanOrEqual(("r",), 100), LessThan(("r",), 104), GreaterThanOrEqual(("c",), 10), LessThan(("c",), 12)]))
    assert sum(size for p in reader.partitions() for *_, size in reader.ranges(p)) == 5 * 3 * 4
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="whole rows"):
        images.read_strip(spark, path, 64, ">f4", 2).count()


def test_written_tiles(spark):
    rng = np.random.default_rng(5)
    grids = {k: rng.normal(0, 9, (150, 270)) for k in ("a", "b")}
    rows = [(k, i, j, float(g[i, j])) for k, g in grids.items() for i in range(150) for j in range(270)]
    path = tempfile.mkdtemp(prefix="tiles-") + "/out"
    df = spark.createDataFrame(rows, "image_id string, r int, c int, v double")
    images.write_images(df.where("image_id = 'a'"), path, 30100, (2.0, 0.0, 1000.0, 0.0, -3.0, 500.0))
    images.write_images(df, path, 30100, (2.0, 0.0, 1000.0, 0.0, -3.0, 500.0))
    assert cells_of(images.read_images(spark, path)) == want("a", grids["a"]) | want("b", grids["b"])
    index = {r["image_id"]: r for r in images.image_index(spark, path).collect()}
    assert set(index) == {"a", "b"} and index["a"]["height"] == 150 and index["a"]["pixel_x"] == 2.0 and index["a"]["pixel_y"] == 3.0 and index["a"]["crs"] == 30100
    system = files.LocalFileSystem()
    with system.open_input_file(f"{path}/b/1_2.tif") as f:
        _, tags = images.tiff_tags(f)
    assert images.transform_of(tags) == (2.0, 0.0, 1000.0 + 2 * 256, 0.0, -3.0, 500.0 - 3 * 128) and tags[images.GEO_KEYS][7] == 30100
    assert not [x for x in system.get_file_info(files.FileSelector(path)) if x.base_name.startswith("_write")]
    writer = images.RasterTilesWriter({"path": path}, True)
    writer.write(iter([{"image_id": "c", "ty": 0, "tx": 0, "r0": 0, "c0": 0, "h": 1, "w": 1, "cells": np.ones(1).tobytes()}]))
    writer.abort([])
    assert {r["image_id"] for r in images.image_index(spark, path).collect()} == {"a", "b"} and cells_of(images.read_images(spark, path).where("image_id = 'c'")) == {}
