"""Rows to dense grids, and grids from and to numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrie.functions.index import index_of, lin_of
from corrie.meta import Grid, GridMeta
from corrie.sources.arrays import array_of, cells_of
from corrie.store import numbered, stored


def axis_values(rows: DataFrame, axis: str) -> DataFrame:
    """``(pos, value)``: the sorted distinct coordinates of an axis."""
    return numbered(rows.select(F.col(axis).alias("value")).distinct(), ["value"], "pos").select(F.col("pos").cast("int").alias("pos"), "value")


def build_dense(rows: DataFrame, axes: list[str], value: str, order: list[str] | None = None, dtype: str | None = None, domain: DataFrame | None = None) -> tuple[Grid, dict[str, DataFrame]]:
    """Scatter rows into the grid of their distinct coordinates; missing cells are masked.

    Of rows with equal coordinates the last by ``order`` wins; without an order, the largest value, since
    rows of a DataFrame have none. Axes keep the given order, also those with one value. Float and double
    values keep their type, others become double; ``dtype`` overrides. ``domain`` gives the rows from which
    axes are taken, if not ``rows``.
    """
    if not axes:
        raise ValueError("at least one axis is needed")
    kind = dtype or ("float" if isinstance(rows.schema[value].dataType, T.FloatType) else "double")
    values = {a: stored(axis_values(domain if domain is not None else rows, a)) for a in axes}
    meta = GridMeta(tuple(axes), tuple(v.count() for v in values.values()))
    found = rows.select(*(F.col(a).alias(f"c{k}") for k, a in enumerate(axes)), F.col(value).cast(kind).alias("e"), F.struct(*(order or [value])).alias("o"))
    found = found.groupBy(*(f"c{k}" for k in range(len(axes)))).agg(F.max_by("e", "o").alias("e"))
    for k, v in enumerate(values.values()):
        found = found.join(v.select(F.col("value").alias(f"c{k}"), F.col("pos").alias(f"i{k}")), f"c{k}")
    found = found.select(lin_of(meta).alias("lin"), "e")
    scaffold = rows.sparkSession.range(meta.size).select(F.col("id").alias("lin"), *index_of(meta, "id"))
    return Grid(scaffold.join(found, "lin", "left"), meta), values


def from_rows(spark: SparkSession, coords: dict, values, *, dtype: str | None = None) -> tuple[Grid, dict[str, DataFrame]]:
    """The same from arrays: an ordered dict of coordinates and values; the last of equal coordinates wins."""
    if not coords:
        raise ValueError("coords must have at least one axis")
    values = np.asarray(values)
    columns = {a: np.asarray(c) for a, c in coords.items()}
    for a, c in columns.items():
        if c.shape != values.shape:
            raise ValueError(f"axis {a!r} has length {len(c)}, but values has length {len(values)}")
    kind = dtype or ("float" if values.dtype == np.float32 else "double")
    schema = T.StructType([T.StructField(f"x{k}", spark.createDataFrame([(c[0].item(),)], ["v"]).schema[0].dataType) for k, c in enumerate(columns.values())] + [T.StructField("v", T.DoubleType()), T.StructField("o", T.LongType())])
    rows = spark.createDataFrame([(*(c[i].item() for c in columns.values()), float(values[i]), i) for i in range(len(values))], schema)
    grid, axes = build_dense(rows, [f"x{k}" for k in range(len(columns))], "v", ["o"], kind)
    grid.meta = GridMeta(tuple(columns), grid.meta.shape)
    return grid, dict(zip(columns, axes.values(), strict=True))


def from_array(spark: SparkSession, energies: np.ndarray) -> Grid:
    """A grid of a float32 or float64 array; NaN is masked."""
    if energies.dtype not in (np.float32, np.float64):
        raise ValueError("energies dtype must be float32 or float64")
    if not energies.flags.c_contiguous:
        raise ValueError("energies must be C-contiguous")
    meta = GridMeta(tuple(f"a{k}" for k in range(energies.ndim)), energies.shape)
    return Grid(cells_of(spark, energies).select("lin", *index_of(meta), "e"), meta)


def to_array(grid: Grid) -> np.ndarray:
    """The grid on the driver, NaN where masked; for small grids."""
    return array_of(grid)


def read_masked(spark: SparkSession, path: str, axes: list[str], value: str, valid: str | F.Column) -> tuple[Grid, dict[str, DataFrame]]:
    """A grid of a parquet table whose axes come from all rows and whose energies only from valid ones."""
    rows = spark.read.parquet(path)
    return build_dense(rows.where(valid), axes, value, domain=rows)
