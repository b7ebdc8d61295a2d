"""Array files (``.npy``, members of ``.npz``) as a Spark source and sink.

A file is read in runs of cells, each by its offset in a task of its own, so no array passes through the driver. Files are
opened through Arrow's file systems (local and shared folders, HDFS, S3). Compressed members have no offsets and are read in one task, front to back.
"""

from __future__ import annotations

import ast
import struct
import zipfile
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corrie.functions.index import index_of
from corrie.meta import Grid, GridMeta
from corrie.operators.tiles import Tiling, blocks
from corrie.store import ship

FORMAT = "array"
#: Cells of a task, and of a batch in it.
RUN = 1 << 22
BATCH = 1 << 18


def opened(path: str):
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


@dataclass
class Member:
    """Where an array's cells are: shape, element type, offset of the first one in the file (None: compressed)."""

    shape: tuple[int, ...]
    dtype: str
    offset: int | None
    name: str | None


def header_of(file) -> tuple[tuple[int, ...], str, int]:
    """Shape, type and length of a ``.npy`` header, with the file at its start."""
    magic = file.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    width = 2 if magic[6] == 1 else 4
    (size,) = struct.unpack("<H" if width == 2 else "<I", file.read(width))
    told = ast.literal_eval(bytes(file.read(size)).decode("latin1"))
    if told["fortran_order"] and len(told["shape"]) > 1:
        raise ValueError("energies must be C-contiguous")
    if told["descr"] not in ("<f4", "<f8"):
        raise ValueError("energies dtype must be float32 or float64")
    return tuple(told["shape"]), told["descr"], 8 + width + size


def member_of(path: str, name: str | None) -> Member:
    with opened(path) as file:
        if not path.endswith(".npz"):
            shape, dtype, length = header_of(file)
            return Member(shape, dtype, length, None)
        with zipfile.ZipFile(file) as box:
            names = box.namelist()
            if name is None and len(names) != 1:
                raise ValueError(f"member must be one of {', '.join(x.removesuffix('.npy') for x in names)}")
            info = box.getinfo(names[0] if name is None else f"{name}.npy")
            with box.open(info) as inner:
                shape, dtype, length = header_of(inner)
        if info.compress_type != zipfile.ZIP_STORED:
            return Member(shape, dtype, None, info.filename)
        file.seek(info.header_offset + 26)
        names_, extra = struct.unpack("<HH", file.read(4))
        return Member(shape, dtype, info.header_offset + 30 + names_ + extra + length, info.filename)


@dataclass
class Run(InputPartition):
    first: int
    cells: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, member: Member):
        self.path, self.member = path, member

    def partitions(self):
        size = prod(self.member.shape)
        if self.member.offset is None:
            return [Run(0, size)]
        return [Run(k, min(RUN, size - k)) for k in range(0, size, RUN)] or [Run(0, 0)]

    def read(self, partition: Run):
        width = np.dtype(self.member.dtype).itemsize

        def batches(file):
            for at in range(partition.first, partition.first + partition.cells, BATCH):
                n = min(BATCH, partition.first + partition.cells - at)
                e = np.frombuffer(file.read(n * width), self.member.dtype)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.array(e)], ["lin", "e"])

        with opened(self.path) as file:
            if self.member.offset is not None:
                file.seek(self.member.offset + partition.first * width)
                yield from batches(file)
            else:
                with zipfile.ZipFile(file) as box, box.open(self.member.name) as inner:
                    header_of(inner)
                    yield from batches(inner)


class ArraySource(DataSource):
    """``spark.read.format("array").option("member", name).load(path)``: ``lin, e``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def member(self) -> Member:
        return member_of(self.options["path"], self.options.get("member"))

    def schema(self) -> str:
        return f"lin long, e {'float' if self.member().dtype == '<f4' else 'double'}"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], self.member())


def read_array(spark: SparkSession, path: str, member: str | None = None) -> Grid:
    """The grid of an array file; NaN is masked."""
    shape = member_of(path, member).shape
    ship(spark)
    spark.dataSource.register(ArraySource)
    reader = spark.read.format(FORMAT)
    cells = (reader.option("member", member) if member else reader).load(path)
    meta = GridMeta(tuple(f"a{k}" for k in range(len(shape))), shape)
    return Grid(cells.select("lin", *index_of(meta), "e"), meta)


def write_array(grid: Grid, path: str) -> None:
    """The grid as a ``.npy`` file in a folder that driver and executors share, NaN where masked.

    The driver writes the header; tasks write rows of their boxes in place. Doing so twice changes nothing, so a lost task can run again.
    """
    made, dtype = blocks(grid), np.dtype(grid.dtype)
    tiling, shape = made.tiling, grid.meta.shape
    with open(path, "wb") as file:
        np.lib.format.write_array_header_1_0(file, {"descr": dtype.str, "fortran_order": False, "shape": shape})
        start = file.tell()
        file.truncate(start + grid.meta.size * dtype.itemsize)

    def put(batches):
        with open(path, "r+b") as file:
            for batch in batches:
                for tile, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows = np.frombuffer(e, dtype).reshape(-1, tiling.extent(tile)[-1])
                    for lin, row in zip(tiling.lin(tile).reshape(rows.shape)[:, 0], rows, strict=True):
                        file.seek(start + int(lin) * dtype.itemsize)
                        file.write(row.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    made.df.mapInArrow(put, "n long").agg({"n": "sum"}).collect()


def cells_of(spark: SparkSession, energies: np.ndarray) -> DataFrame:
    """``lin, e`` of an array in the driver's memory."""
    flat = energies.ravel()
    return spark.createDataFrame(pa.table({"lin": np.arange(flat.size), "e": flat}))


def array_of(grid: Grid) -> np.ndarray:
    """The grid in the driver's memory, box by box, NaN where masked."""
    made = blocks(grid)
    tiling: Tiling = made.tiling
    out = np.full(grid.meta.shape, np.nan, grid.dtype)
    for r in made.df.toLocalIterator():
        place = tuple(slice(c, c + n) for c, n in zip(tiling.corner(r.tile), tiling.extent(r.tile), strict=True))
        out[place] = np.frombuffer(bytes(r.e), grid.dtype).reshape(tiling.extent(r.tile))
    return out
