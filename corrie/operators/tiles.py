"""Grids as blocks: boxes of cells held as arrays, one row each, with the borders of their neighbours.

A grid's cells are dealt into boxes once (``blocks``) and stay there. What an operator needs from around a box is the
outermost layer of the boxes beside it, so only those slabs are copied (``with_borders``), and a box is then
worked on as an array. Boxes are split along the longest axes first, down to ``TILE`` cells.

Masked cells are NaN in a block. Energies are compared by ``order_key``, under which -0.0 is before 0.0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.meta import Grid, GridMeta
from corrie.store import ship, stored

#: Cells of a box at most.
TILE = 1 << 20
#: Cells a packing task holds before it sends them.
HELD = 1 << 20
#: Places in a box, which has fewer than 2 ** 31 cells.
PLACE = np.int32
#: Key of masked cells, after every other.
MASKED = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Tiling:
    shape: tuple[int, ...]
    sides: tuple[int, ...]

    @classmethod
    def of(cls, shape: tuple[int, ...], cells: int | None = None) -> Tiling:
        sides = list(shape)
        while prod(sides) > (cells or TILE):
            k = max(range(len(sides)), key=lambda k: (sides[k], -k))
            sides[k] = -(-sides[k] // 2)
        return cls(tuple(shape), tuple(sides))

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // s) for n, s in zip(self.shape, self.sides, strict=True))

    @property
    def tiles(self) -> int:
        return prod(self.counts)

    def place(self, tile: int) -> tuple[int, ...]:
        out = []
        for n in reversed(self.counts):
            out.append(tile % n)
            tile //= n
        return tuple(reversed(out))

    def number(self, place) -> int:
        tile = 0
        for i, n in zip(place, self.counts, strict=True):
            tile = tile * n + i
        return tile

    def corner(self, tile: int) -> tuple[int, ...]:
        return tuple(i * s for i, s in zip(self.place(tile), self.sides, strict=True))

    def extent(self, tile: int) -> tuple[int, ...]:
        return tuple(min(s, n - c) for s, n, c in zip(self.sides, self.shape, self.corner(tile), strict=True))

    def lin(self, tile: int) -> np.ndarray:
        """Linear indices of a box's cells."""
        out, strides = np.zeros((1,) * len(self.shape), np.int64), GridMeta(("",) * len(self.shape), self.shape).strides
        for k, (c, n, s) in enumerate(zip(self.corner(tile), self.extent(tile), strides, strict=True)):
            out = out + ((c + np.arange(n)) * s).reshape(tuple(n if j == k else 1 for j in range(len(self.shape))))
        return out

    def locate(self, lin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tile of each cell, and its place in an array of the full ``sides``."""
        tile, local, rest = np.zeros(len(lin), np.int64), np.zeros(len(lin), np.int64), lin
        split = [k for k, n in enumerate(self.counts) if n > 1]
        strides = GridMeta(("",) * len(self.shape), self.shape).strides
        last = split[-1] + 1 if split else 0
        for k in range(last):
            i = rest // strides[k]
            rest = rest - i * strides[k]
            if self.counts[k] > 1:
                t = i // self.sides[k]
                tile, i = tile * self.counts[k] + t, i - t * self.sides[k]
            local = local * self.sides[k] + i
        return tile, local * prod(self.sides[last:]) + rest


def order_key(e: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the energies; NaN last."""
    bits = e.astype(np.float64).view(np.int64)
    key = np.where(bits < 0, bits ^ np.int64(MASKED), bits)
    key[np.isnan(e)] = MASKED
    return key


def grouped(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of batches sorted by their first column, value by value."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held


def partitions(df: DataFrame, tiling: Tiling) -> int:
    return max(1, min(tiling.tiles, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiling.tiles // 4)))


def by_tile(df: DataFrame, tiling: Tiling, *order: str) -> DataFrame:
    return df.repartition(partitions(df, tiling), "tile").sortWithinPartitions("tile", *order)


@dataclass
class Blocks:
    """``df``: ``tile, e`` with the energies of a box as bytes, in row-major order."""

    df: DataFrame
    tiling: Tiling
    dtype: str


def blocks(grid: Grid) -> Blocks:
    """The grid's boxes, made once for each grid. Each cell must be there exactly once."""
    if (done := grid.__dict__.get("_blocks")) is not None and done[0] is grid.cells:
        return done[1]
    made = packed(grid)
    grid.__dict__["_blocks"] = (grid.cells, made)
    return made


def packed(grid: Grid) -> Blocks:
    """Cells to boxes by one shuffle of arrays: tasks cut what they read into pieces by box, and boxes are put together."""
    ship(grid.cells.sparkSession)
    tiling, dtype, size = Tiling.of(grid.meta.shape), grid.dtype, grid.meta.size

    def send(batches):
        def sent():
            lin, e = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            tile, local = tiling.locate(lin)
            tile = np.where((lin < 0) | (lin >= size), -1, tile)
            if np.any(tile[1:] < tile[:-1]):
                order = np.argsort(tile.astype(np.int16) if tiling.tiles < 2**15 else tile, kind="stable")
                tile, local, e = tile[order], local[order], e[order]
            local = local.astype(PLACE)
            starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            ends = np.append(starts[1:], len(tile))
            return pa.RecordBatch.from_arrays([pa.array(tile[starts]), *(pa.array([v[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for v in (local, e))], ["tile", "at", "e"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lin = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            held.append((lin.astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(dtype)))
            n += len(lin)
            if n >= HELD:
                yield sent()
                held, n = [], 0
        if held:
            yield sent()

    def put(batches):
        for tile, rows in grouped(batches):
            whole = tile >= 0
            out, seen = np.full(tiling.sides, np.nan, dtype).ravel(), np.zeros(prod(tiling.sides), bool)
            n = 0
            if whole:
                for _, at, e in rows:
                    at = np.frombuffer(at, PLACE)
                    out[at], seen[at] = np.frombuffer(e, dtype), True
                    n += len(at)
                inner = tuple(slice(0, m) for m in tiling.extent(tile))
                out, seen = out.reshape(tiling.sides)[inner], seen.reshape(tiling.sides)[inner]
                whole = bool(seen.all()) and n == out.size
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([np.ascontiguousarray(out).tobytes()], pa.binary()), pa.array([whole])], ["tile", "e", "whole"])

    pieces = grid.cells.select("lin", "e").mapInArrow(send, "tile long, at binary, e binary")
    table = stored(by_tile(pieces, tiling).mapInArrow(put, "tile long, e binary, whole boolean"))
    n, whole = table.agg(F.count("*"), F.bool_and("whole")).first()
    if n != (tiling.tiles if size else 0) or n and not whole:
        raise ValueError("cells must be C-contiguous: each of the grid's cells once")
    return Blocks(table.select("tile", "e"), tiling, dtype)


#: Fields of a block besides its energies, with their types and what stands outside the grid.
FIELDS = {"code": (np.uint16, 65535), "root": (np.int64, -1), "dist": (np.int32, 0)}


def field_type(name: str, dtype: str) -> tuple[np.dtype, float]:
    kind, fill = (dtype, np.nan) if name == "e" else FIELDS[name]
    return np.dtype(kind), fill


def with_borders(table: DataFrame, tiling: Tiling, dtype: str, fields: list[str], inner: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(tile, arrays)``, an iterator of record batches, over every box.

    ``fields`` come with one layer of cells around the box, ``inner`` ones without.
    """
    ship(table.sparkSession)
    names = [*fields, *inner]
    axes = [(-1, 0, 1) if n > 1 else (0,) for n in tiling.counts]

    def send(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tile, place, extent = row[0], tiling.place(row[0]), tiling.extent(row[0])
                arrays = [np.frombuffer(v, field_type(name, dtype)[0]).reshape(extent) for name, v in zip(fields, row[1:], strict=False)]
                for step in product(*axes):
                    to = [i + d for i, d in zip(place, step, strict=True)]
                    if not all(0 <= i < n for i, n in zip(to, tiling.counts, strict=True)):
                        continue
                    own = not any(step)
                    cut = tuple(slice(None) if d == 0 else slice(0, 1) if d < 0 else slice(-1, None) for d in step)
                    values = list(row[1:]) if own else [np.ascontiguousarray(a[cut]).tobytes() for a in arrays] + [None] * len(inner)
                    yield pa.RecordBatch.from_arrays([pa.array([tiling.number(to)], pa.int64()), pa.array([tile], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], ["tile", "source", *names])

    def run(batches):
        for tile, rows in grouped(batches):
            corner, extent = tiling.corner(tile), tiling.extent(tile)
            out = {}
            for name in fields:
                kind, fill = field_type(name, dtype)
                out[name] = np.full(tuple(n + 2 for n in extent), fill, kind)
            for _, source, *values in rows:
                at, size = tiling.corner(source), tiling.extent(source)
                low = [max(a, c - 1) for a, c in zip(at, corner, strict=True)]
                high = [min(a + n, c + m + 1) for a, n, c, m in zip(at, size, corner, extent, strict=True)]
                to = tuple(slice(a - c + 1, b - c + 1) for a, b, c in zip(low, high, corner, strict=True))
                for name, value in zip(names, values, strict=True):
                    kind = field_type(name, dtype)[0]
                    if name in fields:
                        out[name][to] = np.frombuffer(value, kind).reshape([b - a for a, b in zip(low, high, strict=True)])
                    elif value is not None:
                        out[name] = np.frombuffer(value, kind).reshape(extent)
            yield from work(tile, out)

    sent = table.select("tile", *names).mapInArrow(send, "tile long, source long, " + ", ".join(f"{n} binary" for n in names))
    return by_tile(sent, tiling).mapInArrow(run, schema)


def sliding(a: np.ndarray, r: int, what) -> np.ndarray:
    """``what`` (an operation on two arrays) over boxes of range r; the result is smaller by r on every side.

    Along each axis, windows of doubled length are put together, and the last two overlap; only for ``minimum`` and ``maximum``.
    """
    for axis in range(a.ndim):
        width, size = 2 * r + 1, 1
        part = lambda x, low, high: x[(slice(None),) * axis + (slice(low, high),)]  # noqa: B023, E731
        while size * 2 <= width:
            n = a.shape[axis]
            a, size = what(part(a, 0, n - size), part(a, size, n)), size * 2
        if size < width:
            n = a.shape[axis]
            a = what(part(a, 0, n - (width - size)), part(a, width - size, n))
    return a


def sliding_sum(a: np.ndarray, r: int) -> np.ndarray:
    for axis in range(a.ndim):
        n = a.shape[axis] - 2 * r
        part = lambda k: a[(slice(None),) * axis + (slice(k, k + n),)]  # noqa: B023, E731
        total = part(0).copy()
        for k in range(1, 2 * r + 1):
            total += part(k)
        a = total
    return a


def shifted(a: np.ndarray, step) -> np.ndarray:
    """The neighbours one step away of all cells inside an array that has one layer around them."""
    return a[tuple(slice(1 + d, n - 1 + d) for d, n in zip(step, a.shape, strict=True))]


def steps_inside(step, extent) -> tuple[slice, ...]:
    """The cells of a box from which a step stays in it."""
    return tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(step, extent, strict=True))

