"""Rasters as tables of blocks: sums into cells, correlations with a kernel, nearest overviews, and samples.

A raster is rows (row, col, v). For a correlation each cell goes to its own block and to those whose rim, as wide as the
kernel reaches, it lies in, which is one or two copies a cell whatever the kernel's area; within a block the kernel is
applied to an array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a block's side.
SIDE = 64


def rasterise(points: DataFrame, x0: float, y0: float, step: float, value: Column | None = None) -> DataFrame:
    """(row, col, v): the number of points (x, y), or the sum of `value`, in each cell of side `step`; row 0 is below y0 (the north edge), col 0 right of x0."""
    row, col = F.floor((F.lit(y0) - F.col("y")) / step).cast("int"), F.floor((F.col("x") - x0) / step).cast("int")
    return points.groupBy(row.alias("row"), col.alias("col")).agg((F.sum(value) if value is not None else F.count(F.lit(1)).cast("double")).alias("v"))


def spread(cells: DataFrame, reach_row: int, reach_col: int, side: int = SIDE) -> DataFrame:
    """cells with _br, _bc (the block) and _own: a cell's own block and every block in whose rim it lies."""
    blocks = lambda c, reach: F.sequence(F.floor((F.col(c) - reach) / side).cast("int"), F.floor((F.col(c) + reach) / side).cast("int"))
    out = cells.withColumn("_br", F.explode(blocks("row", reach_row))).withColumn("_bc", F.explode(blocks("col", reach_col)))
    return out.withColumn("_own", (F.floor(F.col("row") / side) == F.col("_br")) & (F.floor(F.col("col") / side) == F.col("_bc")))


def correlate(cells: DataFrame, offsets: Sequence[tuple[int, int, Sequence[int]]], kernels: int, side: int = SIDE) -> DataFrame:
    """cells (row, col, v, ...) with sums: for each kernel the sum of v over the cells at its offsets.

    offsets: (rows down, columns right, the kernels that have this offset). Cells that are not there, and null values, count 0.
    """
    reach_row, reach_col = max((abs(o[0]) for o in offsets), default=0), max((abs(o[1]) for o in offsets), default=0)
    rest = [c for c in cells.columns if c not in ("row", "col", "v")]
    packed = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("v").cast("double").alias("v"), F.struct("row", "col", "v", *rest).alias("_cell"))
    masks = [(r, c, np.array(sorted(k), np.int64)) for r, c, k in offsets if len(k)]

    def block(table: pa.Table) -> pa.Table:
        top, left = table.column("_br")[0].as_py() * side - reach_row, table.column("_bc")[0].as_py() * side - reach_col
        own = table.column("_own").combine_chunks()
        row, col = table.column("row").to_numpy() - top, table.column("col").to_numpy() - left
        values = np.zeros((side + 2 * reach_row, side + 2 * reach_col))
        np.add.at(values, (row, col), np.nan_to_num(table.column("v").to_numpy(zero_copy_only=False)))
        sums = np.zeros((kernels, side, side))
        for dr, dc, own_kernels in masks:
            sums[own_kernels] += values[reach_row + dr : reach_row + dr + side, reach_col + dc : reach_col + dc + side]
        here = own.to_numpy(zero_copy_only=False)
        found = np.ascontiguousarray(sums[:, row[here] - reach_row, col[here] - reach_col].T)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * kernels), pa.array(found.reshape(-1)))
        cell = table.column("_cell").combine_chunks().filter(own)
        cell = pa.StructArray.from_arrays([cell.field(i) for i in range(cell.type.num_fields)], fields=[pa.field(f.name, f.type) for f in cell.type])  # all nullable, as declared
        return pa.table([cell, lists], ["_cell", "sums"])

    shape = f"_cell {packed.schema['_cell'].dataType.simpleString()}, sums array<double>"
    return spread(packed, reach_row, reach_col, side).groupBy("_br", "_bc").applyInArrow(block, shape).select("_cell.*", "sums")


def overview(cells: DataFrame, factor: int) -> DataFrame:
    """(row, col, v): every block of factor x factor cells by the one in its middle (nearest), where that cell is there."""
    middle = factor // 2
    return cells.filter((F.pmod("row", F.lit(factor)) == middle) & (F.pmod("col", F.lit(factor)) == middle)).select(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), "v")


def mosaic(tiles: DataFrame, rows: int, cols: int, factor: int = 1) -> DataFrame:
    """(row, col, v) of tiles (tile_row, tile_col, row, col, v) of rows x cols cells, laid side by side and thinned by factor. A tile that is not there leaves no cells."""
    whole = tiles.select((F.col("tile_row") * rows + F.col("row")).alias("row"), (F.col("tile_col") * cols + F.col("col")).alias("col"), "v")
    return overview(whole, factor) if factor > 1 else whole
