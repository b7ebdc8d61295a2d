"""Shape of a grid and the checks on arguments that need nothing but the shape."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CELLS = 2**32 - 1
NEIGHBOURHOODS = ("von_neumann", "moore")


@dataclass(frozen=True)
class GridMeta:
    names: tuple[str, ...]
    shape: tuple[int, ...]

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(prod(self.shape[k + 1 :]) for k in range(self.ndim))

    @property
    def indices(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    def linear(self, index) -> int:
        return sum(int(i) * s for i, s in zip(index, self.strides, strict=True))

    def index(self, lin: int) -> tuple[int, ...]:
        return tuple(lin // s % n for s, n in zip(self.strides, self.shape, strict=True))


@dataclass
class Grid:
    """``cells``: ``lin``, ``i0`` ..., ``e`` (null: masked), one row for every cell of the shape."""

    cells: DataFrame
    meta: GridMeta

    def __post_init__(self):
        kind = self.cells.schema["e"].dataType
        if not isinstance(kind, T.FloatType | T.DoubleType):
            raise ValueError("energies dtype must be float32 or float64")
        self.cells = self.cells.withColumn("e", F.nanvl("e", F.lit(None).cast(kind)))

    @property
    def dtype(self) -> str:
        return "float32" if isinstance(self.cells.schema["e"].dataType, T.FloatType) else "float64"

    def check(self) -> None:
        if not 2 <= self.meta.ndim <= 7:
            raise ValueError(f"ndim must be in [2, 7], got {self.meta.ndim}")
        if self.meta.size > MAX_CELLS:
            raise ValueError(f"the grid has {self.meta.size} cells; at most {MAX_CELLS} are handled")

    def check_complete(self) -> None:
        """The counterpart of a C-contiguous array: every cell once.

        One pass: cells are marked in bitmaps by ranges of 32,768 linear indices, and a bitmap is short of a bit wherever
        a cell is missing or was met twice. Operators that make blocks of a grid see the same there and need not call this.
        """
        lin = F.col("lin")
        inside = lin.between(0, self.meta.size - 1)
        marks = self.cells.where(inside).groupBy(F.bitmap_bucket_number(lin).alias("part")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(lin))).alias("kinds"), F.count("*").alias("n"))
        n, kinds = marks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
        if (n, kinds) != (self.meta.size,) * 2 or self.cells.where(~inside | lin.isNull()).limit(1).count():
            raise ValueError("cells must be C-contiguous: each of the grid's cells once")


def check_range(name: str, value, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer")
    if value < 0:
        raise OverflowError(f"{name} can't be negative")
    if not 1 <= value <= 5:
        raise ValueError(f"{name} must be in [1, 5], got {value}")
    return value


def check_ranges(neighborhood_range, confirm_range) -> tuple[int, int]:
    r = check_range("neighborhood_range", neighborhood_range)
    if confirm_range is None:
        return r, r
    wide = check_range("confirm_range", confirm_range)
    if wide < r:
        raise ValueError(f"confirm_range ({wide}) must be >= neighborhood_range ({r})")
    return r, wide


def check_neighbourhood(name: str) -> str:
    if name not in NEIGHBOURHOODS:
        raise ValueError(f"neighborhood must be one of {', '.join(NEIGHBOURHOODS)}, got {name!r}")
    return name


def check_points(meta: GridMeta, **points) -> list[int]:
    """Linear indices of end points: length, then sign, then bounds."""
    for name, p in points.items():
        if len(p) != meta.ndim:
            raise ValueError(f"{name} has length {len(p)}, but the grid has {meta.ndim} axes")
    for name, p in points.items():
        if any(i < 0 for i in p):
            raise IndexError(f"{name} has a negative index: {tuple(p)}")
    for name, p in points.items():
        if any(i >= n for i, n in zip(p, meta.shape, strict=True)):
            raise IndexError(f"{name} {tuple(p)} is out of bounds for shape {meta.shape}")
    return [meta.linear(p) for p in points.values()]
