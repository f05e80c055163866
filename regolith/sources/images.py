"""Image files and flat strips as Spark data sources, and a sink of georeferenced tiles.

format("raster_files")  PNG and TIFF (strips or tiles, classic or big, plain or deflated) as image_id, band, r, c, v
format("flat_strip")    bands of flat numbers, row by row, one after the other, as the same columns
format("raster_tiles")  writes block rasters (operators.blocks) as TIFF tiles that carry their place, transform and CRS

Comparisons with image_id, band, r and c reach the readers: files, strips, tiles and byte ranges that cannot hold a
wanted cell are not read. Paths are anything pyarrow.fs can open; files are listed when the scan is planned, and read,
headers included, by the tasks. A large TIFF or strip is several partitions; a PNG is one stream, so one task.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

CELLS = "image_id string, band int, r int, c int, v double"
#: Bytes of files for each partition.
PARTITION_BYTES = 64 << 20
#: TIFF field types' bytes, sample formats, and the tags that are used.
_FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SAMPLES = {1: "u", 2: "i", 3: "f"}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIP_AT, CHANNELS, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES, SAMPLE = 256, 257, 258, 259, 270, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, GEO_TEXT = 33550, 33922, 34264, 34735, 34737


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


@dataclass
class Bounds:
    """What the pushed comparisons leave: least and most of band, r and c, and the image ids."""

    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)
    ids: set[str] | None = None

    def add(self, f: Filter) -> None:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if name == "image_id" and isinstance(f, EqualTo | In):
            ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.ids = ids if self.ids is None else self.ids & ids
        elif name in ("band", "r", "c") and not isinstance(f, In):
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.least[name] = max(self.least.get(name, -np.inf), f.value)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.most[name] = min(self.most.get(name, np.inf), f.value)

    def keeps(self, name: str, first: int, last: int) -> bool:
        """Whether any of first..last (inclusive) may be wanted."""
        return first <= self.most.get(name, np.inf) and last >= self.least.get(name, -np.inf)

    def clipped(self, name: str, size: int) -> tuple[int, int]:
        """First and last + 1 of 0..size that may be wanted."""
        lo, hi = self.least.get(name, 0), self.most.get(name, size - 1)
        return int(np.clip(np.ceil(lo), 0, size)), int(np.clip(np.floor(hi) + 1, 0, size))


class _PushingReader(DataSourceReader):
    bounds: Bounds

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            self.bounds.add(f)
            yield f  # Spark applies it to the cells again


def _cells(image: str, band: int, r0: int, c0: int, grid: np.ndarray, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """The wanted cells of a grid, some rows at a time."""
    (r_low, r_high), (c_low, c_high) = ((int(np.clip(a - first, 0, n)), int(np.clip(b - first, 0, n))) for (a, b), first, n in ((bounds.clipped("r", 1 << 31), r0, grid.shape[0]), (bounds.clipped("c", 1 << 31), c0, grid.shape[1])))
    step = max(1, 65_536 // max(c_high - c_low, 1))
    for s in range(r_low, r_high, step):
        part = grid[s : min(s + step, r_high), c_low:c_high].astype(float)
        if part.size:
            r, c = (v.ravel().astype(np.int32) for v in np.mgrid[s : s + part.shape[0], c_low:c_high])
            v = part.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([image] * len(v)), pa.array(np.full(len(v), band, np.int32)), pa.array(r + r0), pa.array(c + c0), pa.array(v, mask=np.isnan(v))], names=["image_id", "band", "r", "c", "v"])


# --- TIFF ------------------------------------------------------------------------------------------------------


def tiff_tags(f: pa.NativeFile) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of a TIFF's first image; only the directory is read, and what it points to."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    n = struct.unpack(order + ("Q" if big else "H"), f.read_at(8 if big else 2, at))[0]
    at, size = at + (8 if big else 2), 20 if big else 12
    table, tags = f.read_at(n * size, at), {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), table[k * size : k * size + size - (8 if big else 4)])
        value = table[k * size + size - (8 if big else 4) : (k + 1) * size]
        length = _FIELD_BYTES.get(kind, 1) * count
        if length > len(value):
            value = f.read_at(length, struct.unpack(order + ("Q" if big else "I"), value)[0])
        value = value[:length]
        tags[tag] = (value.split(b"\0")[0].decode("utf-8", "replace"),) if kind == 2 else struct.unpack(f"{order}{count}{_FIELD_CODES[kind]}", value) if kind in _FIELD_CODES else (value,)
    return order, tags


def transform_of(tags: dict[int, tuple]) -> tuple[float, ...] | None:
    """a, b, c, d, e, f of x = a col + b row + c and y = d col + e row + f; None without georeference."""
    if MATRIX in tags:
        m = tags[MATRIX]
        return (m[0], m[1], m[3], m[4], m[5], m[7])
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIE_POINT]
        return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    return None


def _segments(tags: dict[int, tuple]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """Strips or tiles: plane, first row and column, rows and columns held, offset and bytes."""
    width, height, planes = tags[WIDTH][0], tags[HEIGHT][0], tags.get(CHANNELS, (1,))[0] if tags.get(PLANAR, (1,))[0] == 2 else 1
    tiled = TILE_AT in tags
    h, w = (tags[TILE_H][0], tags[TILE_W][0]) if tiled else (min(tags.get(STRIP_ROWS, (height,))[0], height), width)
    down, across = -(-height // h), -(-width // w)
    offsets, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    for k in range(planes * down * across):
        plane, place = divmod(k, down * across)
        r, c = place // across * h, place % across * w
        yield plane, r, c, h if tiled else min(h, height - r), w, offsets[k], sizes[k]


def read_tiff(f: pa.NativeFile, image: str, bounds: Bounds, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """Wanted cells of every parts-th segment; each is read by its own byte range."""
    order, tags = tiff_tags(f)
    if tags.get(COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise ValueError(f"{image}: TIFF compression {tags[COMPRESSION][0]} is not read")
    told = json.loads(tags[DESCRIPTION][0]) if tags.get(DESCRIPTION, ("",))[0].startswith("{") else {}
    image, r_at, c_at = str(told.get("image_id", image)), int(told.get("r0", 0)), int(told.get("c0", 0))
    if bounds.ids is not None and image not in bounds.ids:
        return
    channels, planar = tags.get(CHANNELS, (1,))[0], tags.get(PLANAR, (1,))[0] == 2
    dtype = np.dtype(f"{order}{_SAMPLES[tags.get(SAMPLE, (1,))[0]]}{tags.get(BITS, (8,))[0] // 8}")
    for k, (plane, r, c, h, w, offset, size) in enumerate(_segments(tags)):
        if k % parts != part or not size or not bounds.keeps("r", r + r_at, r + r_at + h - 1) or not bounds.keeps("c", c + c_at, c + c_at + w - 1):
            continue
        if planar and not bounds.keeps("band", plane + 1, plane + 1):
            continue
        data = f.read_at(size, offset)
        if tags.get(COMPRESSION, (1,))[0] != 1:
            data = zlib.decompress(data)
        grid = np.frombuffer(data, dtype, h * w * (1 if planar else channels)).reshape(h, w, -1)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            grid = np.cumsum(grid, axis=1, dtype=grid.dtype)
        grid = grid[: tags[HEIGHT][0] - r, : tags[WIDTH][0] - c]
        for b in range(grid.shape[2]):
            band = plane + 1 if planar else b + 1
            if bounds.keeps("band", band, band):
                yield from _cells(image, band, r + r_at, c + c_at, grid[:, :, b], bounds)


def tiff_bytes(grid: np.ndarray, told: dict, transform: tuple[float, ...] | None, crs: int | None) -> bytes:
    """A deflated one-strip TIFF of float64 cells with its description, transform and EPSG code."""
    data = zlib.compress(np.ascontiguousarray(grid, "<f8").tobytes())
    text = json.dumps(told).encode() + b"\0"
    fields: list[tuple[int, int, int, bytes]] = [
        (WIDTH, 4, 1, struct.pack("<I", grid.shape[1])), (HEIGHT, 4, 1, struct.pack("<I", grid.shape[0])), (BITS, 3, 1, struct.pack("<H", 64)), (COMPRESSION, 3, 1, struct.pack("<H", 8)),
        (262, 3, 1, struct.pack("<H", 1)), (DESCRIPTION, 2, len(text), text), (STRIP_AT, 4, 1, b""), (CHANNELS, 3, 1, struct.pack("<H", 1)), (STRIP_ROWS, 4, 1, struct.pack("<I", grid.shape[0])),
        (STRIP_BYTES, 4, 1, struct.pack("<I", len(data))), (SAMPLE, 3, 1, struct.pack("<H", 3)),
    ]
    if transform is not None:
        a, b, c, d, e, f = transform
        fields.append((MATRIX, 12, 16, struct.pack("<16d", a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1)))
    if crs is not None:
        fields.append((GEO_KEYS, 3, 8, struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, crs)))
    fields.sort()
    at = 8 + 2 + 12 * len(fields) + 4
    table, extra = b"", b""
    for tag, kind, count, value in fields:
        if len(value) > 4:
            table += struct.pack("<HHII", tag, kind, count, at + len(extra))
            extra += value + b"\0" * (len(value) % 2)
        else:
            table += struct.pack("<HHI", tag, kind, count) + (b"STRP" if tag == STRIP_AT else value.ljust(4, b"\0"))
    table = table.replace(b"STRP", struct.pack("<I", at + len(extra)), 1)
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + table + b"\0\0\0\0" + extra + data


# --- PNG -------------------------------------------------------------------------------------------------------


def read_png(f: pa.NativeFile, image: str, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Wanted cells of a PNG of 8 or 16 bits without interlace; rows past the last wanted one are not decoded."""
    if bounds.ids is not None and image not in bounds.ids:
        return
    f.seek(8)
    inflate, held, width, step, depth, channels, row, before, height = zlib.decompressobj(), bytearray(), 0, 1, 8, 1, 0, None, 0
    last = bounds.most.get("r", np.inf)
    lines: list[np.ndarray] = []
    while row <= last:
        head = f.read(8)
        if len(head) < 8:
            break
        size, kind = struct.unpack(">I4s", head)
        data = f.read(size)
        f.read(4)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data)
            if depth not in (8, 16) or colour == 3 or interlaced:
                raise ValueError(f"{image}: only plain PNGs of 8 or 16 bits without palette are read")
            channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
            step = channels * depth // 8
            before = np.zeros(width * step, np.uint8)
        elif kind == b"IDAT":
            held += inflate.decompress(data)
            n = width * step + 1
            while len(held) >= n and row < height:
                before = _unfiltered(held[0], np.frombuffer(bytes(held[1:n]), np.uint8), before, step)
                del held[:n]
                if bounds.keeps("r", row, row):
                    lines.append(before.view(">u2" if depth == 16 else np.uint8).reshape(width, channels))
                row += 1
                if len(lines) >= 256:
                    yield from _png_lines(image, row - len(lines), lines, bounds)
                    lines = []
        elif kind == b"IEND":
            break
    if lines:
        yield from _png_lines(image, int(max(bounds.least.get("r", 0), 0)) if row > last else row - len(lines), lines, bounds)


def _png_lines(image: str, r0: int, lines: list[np.ndarray], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    grid = np.stack(lines)
    for b in range(grid.shape[2]):
        if bounds.keeps("band", b + 1, b + 1):
            yield from _cells(image, b + 1, r0, 0, grid[:, :, b], bounds)


def _unfiltered(kind: int, line: np.ndarray, before: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from its filtered form and the row before; step bytes make a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + before
    out = np.zeros(len(line) + step, np.int64)
    above = np.concatenate((np.zeros(step, np.int64), before)).tolist()
    values, got = line.tolist(), out.tolist()
    for i, x in enumerate(values):
        a, b = got[i], above[i + step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = above[i]
            near = ((abs(b - c), a), (abs(a - c), b), (abs(a + b - 2 * c), c))
            guess = min(near, key=lambda t: t[0])[1]  # the first of equals
        got[i + step] = (x + guess) & 255
    return np.array(got[step:], np.uint8)


# --- sources ---------------------------------------------------------------------------------------------------


@dataclass
class _Files(InputPartition):
    paths: list[str]
    part: int = 0
    parts: int = 1


class RasterFiles(DataSource):
    """Reads option path: a file, or the .png, .tif and .tiff files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _RasterFilesReader(self.options)


class _RasterFilesReader(_PushingReader):
    def __init__(self, options):
        self.path, self.each, self.bounds = options["path"], int(options.get("partitionbytes", PARTITION_BYTES)), Bounds()

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(files.FileSelector(path, recursive=True))
        out, held, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and f.extension.lower() in ("png", "tif", "tiff") and "/_" not in f.path.removeprefix(path)), key=lambda f: f.path):
            if self.bounds.ids is not None and f.extension.lower() == "png" and f.base_name.rsplit(".", 1)[0] not in self.bounds.ids:
                continue
            if f.size > self.each and f.extension.lower() != "png":
                n = -(-f.size // self.each)
                out += [_Files([f.path], k, n) for k in range(n)]
                continue
            held.append(f.path)
            size += f.size
            if size >= self.each:
                out.append(_Files(held))
                held, size = [], 0
        return out + ([_Files(held)] if held or not out else [])

    def read(self, partition: _Files):
        system, _ = opened(self.path)
        for path in partition.paths:
            image = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            with system.open_input_file(path) as f:
                if path.lower().endswith(".png"):
                    yield from read_png(f, image, self.bounds)
                else:
                    yield from read_tiff(f, image, self.bounds, partition.part, partition.parts)


@dataclass
class _Rows(InputPartition):
    """Rows first..last (exclusive) of a band that begins at byte base."""

    band: int = 0
    first: int = 0
    last: int = 0
    base: int = 0


class FlatStrip(DataSource):
    """Reads option path as bands of rows of numbers; options width, dtype (numpy's, such as <f4), bands and image_id."""

    @classmethod
    def name(cls) -> str:
        return "flat_strip"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return FlatStripReader(self.options)


class FlatStripReader(_PushingReader):
    def __init__(self, options):
        self.path, self.width, self.dtype, self.bands = options["path"], int(options["width"]), np.dtype(options.get("dtype", "<f4")), int(options.get("bands", 1))
        self.image, self.each, self.bounds = options.get("image_id", options["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]), int(options.get("partitionbytes", PARTITION_BYTES)), Bounds()

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.path)
        line = self.width * self.dtype.itemsize
        height, rest = divmod(system.get_file_info(path).size, line * self.bands)
        if rest:
            raise ValueError(f"{path} does not hold {self.bands} bands of whole rows of {line} bytes")
        if self.bounds.ids is not None and self.image not in self.bounds.ids:
            return [_Rows()]
        first, last = self.bounds.clipped("r", height)
        step = max(1, self.each // line)
        out = [_Rows(b, r, min(r + step, last), b * height * line) for b in range(self.bands) if self.bounds.keeps("band", b + 1, b + 1) for r in range(first, last, step)]
        return out or [_Rows()]

    def ranges(self, p: _Rows) -> Iterator[tuple[int, int, int, int]]:
        """Rows and the byte ranges to read for them: row, number of rows, offset, bytes. Wide lines are read by the wanted columns."""
        item, line = self.dtype.itemsize, self.width * self.dtype.itemsize
        first, last = self.bounds.clipped("c", self.width)
        if first >= last:
            return
        if (last - first) * 4 > self.width:
            for r in range(p.first, p.last, 256):
                n = min(256, p.last - r)
                yield r, n, p.base + r * line, n * line
        else:
            for r in range(p.first, p.last):
                yield r, 1, p.base + r * line + first * item, (last - first) * item

    def read(self, partition: _Rows):
        system, path = opened(self.path)
        first, _ = self.bounds.clipped("c", self.width)
        with system.open_input_file(path) as f:
            for r, n, offset, size in self.ranges(partition):
                grid = np.frombuffer(f.read_at(size, offset), self.dtype).reshape(n, -1)
                yield from _cells(self.image, partition.band + 1, r, 0 if grid.shape[1] == self.width else first, grid, self.bounds)


# --- sink ------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]
    images: dict[str, tuple[int, int]]


class RasterTiles(DataSource):
    """Writes block rasters to option path: a TIFF for each block, and image.json for each image; options crs and transform (six numbers)."""

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        from regolith.operators import blocks

        return blocks.SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RasterTilesWriter(self.options, overwrite)


class RasterTilesWriter(DataSourceWriter):
    """Tiles are written under a name of this write alone; commit moves them in place and writes what is known of each image."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.stage = options["path"].rstrip("/"), overwrite, f"_write-{uuid.uuid4().hex}"
        self.crs = int(options["crs"]) if "crs" in options else None
        self.transform = tuple(float(x) for x in options["transform"].split(",")) if "transform" in options else None

    def write(self, rows) -> WriterCommitMessage:
        system, path = opened(self.path)
        names, images = [], {}
        attempt = uuid.uuid4().hex
        for row in rows:
            image = row["image_id"]
            grid = np.frombuffer(row["cells"]).reshape(row["h"], row["w"])
            place = self.transform
            if place is not None:
                a, b, c, d, e, f = place
                place = (a, b, c + a * row["c0"] + b * row["r0"], d, e, f + d * row["c0"] + e * row["r0"])
            name = f"{self.stage}/{attempt}/{len(names)}.tif"
            system.create_dir(f"{path}/{self.stage}/{attempt}", recursive=True)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(tiff_bytes(grid, {"image_id": image, "r0": row["r0"], "c0": row["c0"]}, place, self.crs))
            names.append(f"{name}|{image}/{row['ty']}_{row['tx']}.tif")
            h, w = images.get(image, (0, 0))
            images[image] = (max(h, row["r0"] + row["h"]), max(w, row["c0"] + row["w"]))
        return _Written(names, images)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = opened(self.path)
        told: dict[str, tuple[int, int]] = {}
        for m in filter(None, messages):
            for image, (h, w) in m.images.items():
                told[image] = tuple(map(max, told.get(image, (0, 0)), (h, w)))
        if self.overwrite:
            for old in system.get_file_info(files.FileSelector(path, allow_not_found=True)):
                if not old.base_name.startswith("_write-") and old.type == files.FileType.Directory:
                    system.delete_dir(old.path)
        for m in filter(None, messages):
            for name in m.names:
                staged, final = name.split("|", 1)
                system.create_dir(f"{path}/{final.rsplit('/', 1)[0]}", recursive=True)
                system.move(f"{path}/{staged}", f"{path}/{final}")
        for image, (h, w) in told.items():
            with system.open_output_stream(f"{path}/{image}/image.json") as out:
                out.write(json.dumps({"image_id": image, "height": h, "width": w, "crs": self.crs, "transform": self.transform}).encode())
        self._clear(system, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: files.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.stage}").type == files.FileType.Directory:
            system.delete_dir(f"{path}/{self.stage}")


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RasterFiles, FlatStrip, RasterTiles):
        spark.dataSource.register(source)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Cells image_id, band (from 1), r, c, v of image files; NaN is no data."""
    _ready(spark)
    return spark.read.format("raster_files").load(path)


def read_strip(spark: SparkSession, path: str, width: int, dtype: str = "<f4", bands: int = 1, image_id: str | None = None) -> DataFrame:
    """Cells of a flat strip, as read_images() gives them."""
    _ready(spark)
    reader = spark.read.format("flat_strip").option("width", width).option("dtype", dtype).option("bands", bands)
    return (reader if image_id is None else reader.option("image_id", image_id)).load(path)


def write_images(cells: DataFrame, path: str, crs: int | None = None, transform: tuple[float, ...] | None = None) -> None:
    """cells(image_id, r, c, v) as georeferenced TIFF tiles and an image.json for each image; read_images() reads them."""
    from regolith.operators import blocks

    _ready(cells.sparkSession)
    writer = blocks.to_blocks(cells).write.format("raster_tiles").mode("overwrite")
    if crs is not None:
        writer = writer.option("crs", crs)
    if transform is not None:
        writer = writer.option("transform", ",".join(map(repr, transform)))
    writer.save(path)


def image_index(spark: SparkSession, path: str) -> DataFrame:
    """image_id, height, width, crs, transform, pixel_x and pixel_y (None without georeference) of written images."""
    told = spark.read.schema("image_id string, height int, width int, crs int, transform array<double>").json(f"{path.rstrip('/')}/*/image.json")
    size = lambda i, j: F.hypot(F.get("transform", F.lit(i)), F.get("transform", F.lit(j)))
    return told.withColumn("pixel_x", size(0, 3)).withColumn("pixel_y", size(1, 4))
