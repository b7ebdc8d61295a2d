"""Column expressions for indices, sort keys and direction codes."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrie.meta import GridMeta

NO_PARENT = 65535


def lin_of(meta: GridMeta, columns: list[str] | None = None) -> Column:
    parts = [F.col(c).cast("long") * s for c, s in zip(columns or meta.indices, meta.strides, strict=True)]
    return reduce(lambda a, b: a + b, parts)


def index_of(meta: GridMeta, lin: str = "lin") -> list[Column]:
    return [F.expr(f"cast(({lin} div {s}) % {n} as int)").alias(c) for s, n, c in zip(meta.strides, meta.shape, meta.indices, strict=True)]


def zero_sign(e: str = "e") -> Column:
    """0 for negative zero, else 1: after the energy it makes the order total, -0.0 before 0.0."""
    return F.when((F.col(e) == 0) & (F.col(e).cast("string") == "-0.0"), 0).otherwise(1)


def key(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}") for c in ("e", "nz", "lin")))


def offsets(meta: GridMeta, neighbourhood: str) -> list[tuple[int, int, tuple[int, ...]]]:
    """``(position, code, step)`` of a stencil of range 1, by position.

    The code is the step in base 3, each digit one more than the step. In the box that is also the position;
    along the axes, a position is twice the axis, plus one for a step ahead.
    """
    n = meta.ndim
    code = lambda step: sum((d + 1) * 3 ** (n - 1 - k) for k, d in enumerate(step))
    if neighbourhood == "moore":
        return [(code(s), code(s), s) for s in product((-1, 0, 1), repeat=n) if any(s)]
    steps = [tuple(d * (k == axis) for k in range(n)) for axis in range(n) for d in (-1, 1)]
    return [(p, code(s), s) for p, s in enumerate(steps)]


def inside(meta: GridMeta, step: str, columns: list[str] | None = None) -> Column:
    """Whether the step (an array column) from a cell stays in the grid."""
    parts = [(F.col(c) + F.col(step)[k]).between(0, n - 1) for k, (c, n) in enumerate(zip(columns or meta.indices, meta.shape, strict=True))]
    return reduce(lambda a, b: a & b, parts)


def step_code(code: int, ndim: int) -> tuple[int, ...]:
    return tuple(code // 3 ** (ndim - 1 - k) % 3 - 1 for k in range(ndim))


def applied(meta: GridMeta, index, code: int) -> tuple[int, ...] | None:
    """The cell that a direction code leads to, or None off the grid."""
    to = tuple(i + d for i, d in zip(index, step_code(code, meta.ndim), strict=True))
    return to if all(0 <= i < n for i, n in zip(to, meta.shape, strict=True)) else None
