"""Local minima and maxima of Chebyshev boxes, block by block.

Blocks get one layer of their neighbours' cells, and a sliding minimum over boxes of range 1 leaves the cells that
nothing beside them beats. That is the answer at range 1. At a wider range those cells, few on smooth grids, are sent
to the blocks that their box reaches; each block says what it holds against them, and the answers are put
together. So no cell travels further than one layer, whatever the range.
"""

from __future__ import annotations

from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.functions.index import index_of, zero_sign
from corrie.meta import Grid, check_ranges
from corrie.operators.tiles import Blocks, blocks, by_tile, grouped, sliding, sliding_sum, with_borders

KINDS = ("min", "max")
#: Cells of an array around a block up to which all boxes of the block are compared at once.
WIDE = 1 << 25


def least_of(e: np.ndarray, kind: str) -> np.ndarray:
    """Energies so that the wanted extremum is the least, masked cells above all."""
    return np.where(np.isnan(e), np.inf, e if kind == "min" else -e)


def unbeaten(made: Blocks, kinds: tuple[str, ...], alone: bool) -> DataFrame:
    """``(kind, lin, e)`` of cells that no cell of their box of range 1 beats; ``alone``: also those without neighbours."""
    tiling = made.tiling

    def work(tile, arrays):
        e = arrays["e"]
        own = e[(slice(1, -1),) * e.ndim]
        valid = ~np.isnan(own)
        if not alone:
            valid &= sliding_sum((~np.isnan(e)).astype(np.uint16), 1) > 1
        lin = None
        for k, kind in enumerate(KINDS):
            if kind in kinds:
                low = least_of(e, kind)
                hit = valid & (sliding(low, 1, np.minimum) == low[(slice(1, -1),) * e.ndim])
                if hit.any():
                    lin = tiling.lin(tile) if lin is None else lin
                    found = lin[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(found), pa.array(own[hit].astype(np.float64))], ["kind", "lin", "e"])

    return with_borders(made.df, tiling, made.dtype, ["e"], [], work, "kind int, lin long, e double")


def against(made: Blocks, found: DataFrame, r: int, wide: int) -> DataFrame:
    """The cells of ``found`` that no cell within ``wide`` beats and that have another one within ``r``."""
    tiling = made.tiling
    ndim, dtype = len(tiling.shape), made.dtype
    strides = [prod(tiling.shape[k + 1 :]) for k in range(ndim)]

    def ask(batches):
        """Each cell to the blocks its wide box reaches: from axis to axis, copies for the blocks before and behind."""
        for batch in batches:
            kind, lin, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            row, tile = np.arange(len(lin)), np.zeros(len(lin), np.int64)
            for n, s, side, count in zip(tiling.shape, strides, tiling.sides, tiling.counts, strict=True):
                at = lin[row] // s % n
                low, high = np.maximum(at - wide, 0) // side, np.minimum(at + wide, n - 1) // side
                rows, tiles = [], []
                for k in range(-(-wide // side) * 2 + 1):
                    reach = low + k <= high
                    rows.append(row[reach])
                    tiles.append(tile[reach] * count + (low + k)[reach])
                row, tile = np.concatenate(rows), np.concatenate(tiles)
            order = np.argsort(tile, kind="stable")
            row, tile = row[order], tile[order]
            starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(0, int)
            ends = np.append(starts[1:], len(tile)) if len(tile) else starts
            cut = lambda v: pa.array([v[row[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(tile[starts]), pa.nulls(len(starts), pa.binary()), cut(kind.astype(np.int32)), cut(lin.astype(np.int64)), cut(e.astype(np.float64))], ["tile", "block", "kind", "lin", "e"])

    def answer(batches):
        for tile, rows in grouped(batches):
            corner, extent = np.array(tiling.corner(tile)), tiling.extent(tile)
            block = next(r[1] for r in rows if r[1] is not None)
            values = np.frombuffer(block, dtype).reshape(extent).astype(np.float64)
            asked = [r for r in rows if r[1] is None]
            if not asked:
                continue
            kind, lin, e = (np.concatenate([np.frombuffer(r[c], t) for r in asked]) for c, t in ((2, np.int32), (3, np.int64), (4, np.float64)))
            at = np.stack([lin // s % n for s, n in zip(strides, tiling.shape, strict=True)], 1) - corner
            beaten, beside = np.zeros(len(lin), bool), np.zeros(len(lin), bool)
            size = prod(n + 2 * wide for n in extent)
            if size <= WIDE and len(lin) * (2 * wide + 1) ** ndim > 4 * size:
                around = lambda x, v, w: np.pad(x, [(2 * w, 2 * w)] * ndim, constant_values=v)
                for k, name in enumerate(KINDS):
                    mine = kind == k
                    if mine.any():
                        low = sliding(around(least_of(values, name), np.inf, wide), wide, np.minimum)
                        beaten[mine] = low[tuple((at[mine] + wide).T)] < least_of(e[mine], name)
                near = sliding_sum(around((~np.isnan(values)).astype(np.int32), 0, r), r)
                close = ((at >= -r) & (at < np.array(extent) + r)).all(1)
                beside[close] = near[tuple((at[close] + r).T)] > ((at[close] >= 0) & (at[close] < extent)).all(1)
            else:
                for i, (k, p, x) in enumerate(zip(kind, at, e, strict=True)):
                    box = values[tuple(slice(max(0, c - wide), max(0, c + wide + 1)) for c in p)]
                    beaten[i] = (box < x).any() if k == 0 else (box > x).any()
                    near = values[tuple(slice(max(0, c - r), max(0, c + r + 1)) for c in p)]
                    beside[i] = (~np.isnan(near)).sum() > all(0 <= c < n for c, n in zip(p, extent, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kind, lin, e, beaten, beside)], ["kind", "lin", "e", "beaten", "beside"])

    asked = found.mapInArrow(ask, "tile long, block binary, kind binary, lin binary, e binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("kind", "lin", "e")]
    both = asked.unionByName(made.df.select("tile", F.col("e").alias("block"), *none))
    told = by_tile(both, tiling).mapInArrow(answer, "kind int, lin long, e double, beaten boolean, beside boolean")
    return told.groupBy("kind", "lin").agg(F.any_value("e").alias("e"), F.bool_or("beaten").alias("beaten"), F.bool_or("beside").alias("beside")).where("beside and not beaten")


def extrema(grid: Grid, kinds: tuple[str, ...], neighborhood_range: int = 1, confirm_range: int | None = None) -> DataFrame:
    """``(kind, lin, i0.., e)`` of cells that no cell of their box beats and that have one beside them at all.

    With ``confirm_range`` nothing in that wider box may beat them either.
    """
    grid.check()
    r, wide = check_ranges(neighborhood_range, confirm_range)
    made = blocks(grid)
    found = unbeaten(made, kinds, wide > 1)
    found = against(made, found, r, wide) if wide > 1 else found
    named = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return found.select(named.alias("kind"), "lin", *index_of(grid.meta), "e")


def listed(found: DataFrame, kind: str, ndim: int) -> list[tuple[tuple[int, ...], float]]:
    order = [F.col("e"), zero_sign()] if kind == "min" else [F.desc("e"), F.desc(zero_sign())]
    return [(tuple(r[f"i{k}"] for k in range(ndim)), r.e) for r in found.where(F.col("kind") == kind).orderBy(*order, "lin").collect()]


def find_minima_grid(grid: Grid, *, neighborhood_range: int = 1, confirm_range: int | None = None) -> list:
    """``[(index, energy)]``, ascending; ties by linear index."""
    return listed(extrema(grid, ("min",), neighborhood_range, confirm_range), "min", grid.meta.ndim)


def find_maxima_grid(grid: Grid, *, neighborhood_range: int = 1, confirm_range: int | None = None) -> list:
    """``[(index, energy)]``, descending; ties by linear index, ascending."""
    return listed(extrema(grid, ("max",), neighborhood_range, confirm_range), "max", grid.meta.ndim)


def find_extrema_grid(grid: Grid, *, neighborhood_range: int = 1, confirm_range: int | None = None) -> tuple[list, list]:
    """Minima and maxima from the same blocks."""
    found = extrema(grid, ("min", "max"), neighborhood_range, confirm_range)
    return listed(found, "min", grid.meta.ndim), listed(found, "max", grid.meta.ndim)
