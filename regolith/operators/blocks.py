"""Rasters as rows of square blocks of cells, for kernels that look at a neighbourhood.

blocks(image_id, ty, tx, r0, c0, h, w, cells): the block's place, its first row and column, its size at the
image's border, and its cells as float64 bytes, row by row; NaN is no data. A kernel names the boxes it needs of
which images; each box is put together from the parts of the few blocks it covers, found by arithmetic. So no
image, no line and no cell row meets a join, and a task works through many boxes of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 128
#: Boxes, or bytes of them, that a kernel is given at once.
LOT, LOT_BYTES = 256, 32 << 20
#: Boxes of a block that are cut from one copy of it.
BOXES_PER_ROW = 512

SCHEMA = "image_id string, ty int, tx int, r0 int, c0 int, h int, w int, cells binary"
_NAMES = ["image_id", "ty", "tx", "r0", "c0", "h", "w", "cells"]


def to_blocks(cells: DataFrame, value: str = "v", side: int = SIDE) -> DataFrame:
    """Blocks of cells(image_id, r, c, value); of repeated cells the last met stays."""
    placed = cells.select(
        F.col("image_id").cast("string").alias("image_id"), F.floor(F.col("r") / side).cast("int").alias("ty"), F.floor(F.col("c") / side).cast("int").alias("tx"),
        F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("x"),
    )

    def one(key, parts):
        image, ty, tx, r, c, x = key[0], key[1], key[2], *(np.concatenate(p) for p in zip(*parts, strict=True))
        r, c = r - ty * side, c - tx * side
        grid = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan)
        grid[r, c] = x
        return image, ty, tx, ty * side, tx * side, *grid.shape, grid.tobytes()

    def run(batches):
        held, parts, out = None, [], []
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            ty, tx, r, c, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)], strict=True):
                if s == e:
                    continue
                key = (names[s], int(ty[s]), int(tx[s]))
                if held is not None and key != held:
                    out.append(one(held, parts))
                    parts = []
                held = key
                parts.append((r[s:e], c[s:e], x[s:e]))
            if len(out) >= 64:
                yield _rows(out)
                out = []
        if held is not None:
            out.append(one(held, parts))
        if out:
            yield _rows(out)

    return placed.repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx").mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), *(pa.int32(),) * 6, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def to_cells(blocks: DataFrame, value: str = "v") -> DataFrame:
    """image_id, r, c, value of the cells that have data."""

    def run(batches):
        for batch in batches:
            for image, r0, c0, h, w, cells in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6, 7)), strict=True):
                grid = np.frombuffer(cells).reshape(h, w)
                r, c = np.nonzero(~np.isnan(grid))
                yield cell_batch([image] * len(r), r + r0, c + c0, grid[r, c], value)

    return blocks.select(*_NAMES).mapInArrow(run, f"image_id string, r int, c int, {value} double")


def cell_batch(images: list, r: np.ndarray, c: np.ndarray, x: np.ndarray, value: str = "v") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(images, pa.string()), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(x.astype(float))], names=["image_id", "r", "c", value])


#: What a box is: the group it belongs to and its part in it, its image, place and size, and anything its kernel wants to know.
BOX = "group string, side int, image_id string, r0 int, c0 int, h int, w int, note binary"
_PIECE = "group string, side int, r0 int, c0 int, h int, w int, note binary, pr int, pc int, ph int, pw int, cells binary"


def met_blocks(boxes: DataFrame, side: int = SIDE) -> DataFrame:
    """boxes with ty, tx: a row for each place of a block that a box covers."""
    upto = lambda first, size: F.floor((F.col(first) + F.col(size) - 1) / side).cast("int")
    start = lambda first: F.greatest(F.floor(F.col(first) / side).cast("int"), F.lit(0))
    real = boxes.where("h > 0 and w > 0 and r0 + h > 0 and c0 + w > 0")
    return real.withColumn("ty", F.explode(F.sequence(start("r0"), upto("r0", "h")))).withColumn("tx", F.explode(F.sequence(start("c0"), upto("c0", "w"))))


def pieces(blocks: DataFrame, boxes: DataFrame, side: int = SIDE) -> DataFrame:
    """The parts of boxes(BOX) that each block covers; a box that meets no block of its image has none."""
    met = met_blocks(boxes, side)
    wanted = met.select("image_id", "ty", "tx", F.struct("group", "side", "r0", "c0", "h", "w", "note").alias("box"), F.pmod(F.xxhash64("group", "side"), F.lit(1 << 20)).alias("deal"))
    # a block that many boxes want goes to several rows, so that none grows with their number
    per = wanted.groupBy("image_id", "ty", "tx").agg(F.ceil(F.count("*") / BOXES_PER_ROW).cast("int").alias("lots"))
    lots = wanted.join(per, ["image_id", "ty", "tx"]).groupBy("image_id", "ty", "tx", (F.col("deal") % F.col("lots")).alias("lot")).agg(F.collect_list("box").alias("boxes"))
    both = blocks.select(*_NAMES).join(lots, ["image_id", "ty", "tx"]).select("r0", "c0", "h", "w", "cells", "boxes")

    def run(batches):
        for batch in batches:
            for br, bc, bh, bw, cells, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grid, out, size = np.frombuffer(cells).reshape(bh, bw), [], 0
                for b in wanted:
                    r, c = max(b["r0"], br), max(b["c0"], bc)
                    h, w = min(b["r0"] + b["h"], br + bh) - r, min(b["c0"] + b["w"], bc + bw) - c
                    if h > 0 and w > 0:
                        out.append((*b.values(), r, c, h, w, grid[r - br : r - br + h, c - bc : c - bc + w].tobytes()))
                        size += 8 * h * w
                    else:  # a block that ends early: the box is there, though without cells of it
                        out.append((*b.values(), b["r0"], b["c0"], 0, 0, b""))
                    if size > LOT_BYTES:
                        yield _piece_batch(out)
                        out, size = [], 0
                if out:
                    yield _piece_batch(out)

    return both.mapInArrow(run, _PIECE)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), *(pa.int32(),) * 5, pa.binary(), *(pa.int32(),) * 4, pa.binary())
    names = [x.split()[0] for x in _PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


#: A group for a kernel: its name, and by side the box's first row and column, its cells and its note.
Group = tuple[str, dict[int, tuple[int, int, np.ndarray, bytes]]]


def over_boxes(parts: DataFrame, kernel: Callable[[list[Group]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """kernel over lots of groups of boxes, each put together from its pieces; cells that no block has are NaN."""

    def run(batches):
        lot: list[Group] = []
        held, sides, size = None, {}, 0
        for batch in batches:
            for group, side, r0, c0, h, w, note, pr, pc, ph, pw, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and group != held:
                    lot.append((held, sides))
                    sides = {}
                    if len(lot) >= LOT or size > LOT_BYTES:
                        yield from kernel(lot)
                        lot, size = [], 0
                held = group
                if side not in sides:
                    sides[side] = (r0, c0, np.full((h, w), np.nan), note)
                    size += 8 * h * w
                if cells:
                    sides[side][2][pr - r0 : pr - r0 + ph, pc - c0 : pc - c0 + pw] = np.frombuffer(cells).reshape(ph, pw)
        if held is not None:
            lot.append((held, sides))
            yield from kernel(lot)

    return parts.repartition("group").sortWithinPartitions("group", "side").mapInArrow(run, schema)
