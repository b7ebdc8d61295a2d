"""Flood states from elsewhere: labels, parents and merges as tables, checked, and used in place of a new flood.

What is wrong with a state is a ``ValueError``, whatever it is: types, cells that are missing, labels and merges that name
no basin, codes that mean nothing or lead off the grid, chains that run in circles, merges that contradict each other.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrie.functions.index import NO_PARENT
from corrie.meta import Grid
from corrie.operators.flood import SEED, Merge, Watershed, ends_of, resolved, stencil_of
from corrie.operators.paths import find_minimum_energy_path
from corrie.operators.tiles import blocks, steps_inside
from corrie.store import ship, stored

MERGE_COLUMNS = ("saddle", "other", "deeper", "shallower", "saddle_side")


class FloodState(Watershed):
    """A flood that was not made here.

    ``labels`` has ``lin, label`` (int, -1 where masked), ``parents`` ``lin, parent`` (int; direction codes, 65535 at seeds and where masked), ``merges`` the columns of
    ``MERGE_COLUMNS`` in the order of ``merge_id``. Basins are numbered as their seeds are labelled.
    """

    def __init__(self, grid: Grid, labels: DataFrame, parents: DataFrame, merges: DataFrame, n_basins: int, neighborhood: str = "von_neumann"):
        super().__init__(grid, neighborhood, True)
        self.given, self.n_basins, self.codes = labels, n_basins, parents
        if not isinstance(labels.schema["label"].dataType, T.IntegerType) or not isinstance(parents.schema["parent"].dataType, T.IntegerType):
            raise ValueError("labels must be int32 and parents int32 with codes below 65536")
        if {c for c in merges.columns if c != "merge_id"} != set(MERGE_COLUMNS) or "merge_id" not in merges.columns:
            raise ValueError(f"merges must be of shape (M, 5): {', '.join(MERGE_COLUMNS)}, beside merge_id")
        self.given_merges = merges
        wrong = labels.where(F.col("label").isNull() | (F.col("label") >= n_basins)).limit(1).collect()
        if wrong:
            raise ValueError(f"label {wrong[0].label} at cell {wrong[0].lin} is out of range for {n_basins} basins")
        self.check_merges()

    def check_merges(self) -> None:
        m, n, size = self.given_merges, self.n_basins, self.grid.meta.size
        rules = {
            f"refers to a basin id >= {n}": ~F.least(*(F.coalesce(F.col(c).between(0, n - 1), F.lit(False)).cast("int") for c in MERGE_COLUMNS[2:])).cast("boolean"),
            "has a saddle_side that is neither deeper nor shallower": ~F.col("saddle_side").isin(F.col("deeper"), F.col("shallower")),
            "refers to a cell outside the grid": ~(F.col("saddle").between(0, size - 1) & F.col("other").between(0, size - 1)),
        }
        for text, rule in rules.items():
            if wrong := m.where(rule).limit(1).collect():
                raise ValueError(f"merge {wrong[0].merge_id} {text}")
        # A basin goes once, and takes in nothing after that.
        gone = m.groupBy(F.col("shallower").alias("basin")).agg(F.min("merge_id").alias("at"), F.count("*").alias("n"))
        used = m.select("merge_id", F.explode(F.array("deeper", "shallower")).alias("basin"))
        late = used.join(gone, "basin").where((F.col("merge_id") > F.col("at")) | (F.col("n") > 1))
        if wrong := late.unionByName(m.where("deeper = shallower").select(F.col("deeper").alias("basin"), "merge_id", F.col("merge_id").alias("at"), F.lit(1).cast("long").alias("n"))).limit(1).collect():
            raise ValueError(f"merge {wrong[0].merge_id} is inconsistent with earlier merges")

    @cached_property
    def tiles(self) -> DataFrame:
        """Blocks with the given parents; roots and steps follow from those."""
        made, tiling = self.blocks, self.tiling
        ship(self.spark)
        try:
            codes = blocks(Grid(self.codes.select("lin", F.col("parent").cast("double").alias("e")), self.grid.meta))
        except ValueError as error:
            raise ValueError(f"parents do not match the shape {self.grid.meta.shape} of the grid") from error
        by_code = {c: (s, j) for _, c, s, j in stencil_of(tiling.shape, self.neighborhood)}
        dtype, ndim, shape = made.dtype, self.grid.meta.ndim, tiling.shape

        def work(tile, e, raw):
            extent, lin = tiling.extent(tile), tiling.lin(tile)
            masked = np.isnan(e)
            raw = np.where(np.isnan(raw), NO_PARENT, raw).astype(np.int64).reshape(extent)
            place = np.arange(raw.size).reshape(extent)
            to = place.copy()
            for c in np.unique(raw[raw != NO_PARENT]).tolist():
                at = raw == c
                first = int(lin[at][0])
                if c not in by_code:
                    return None, f"invalid direction code {c} at cell {first}" if not 0 <= c < 3**ndim else f"direction code {c} at cell {first} is no step of the neighborhood"
                step, _ = by_code[c]
                for k, d in enumerate(step):
                    index = lin[at] // int(np.prod(shape[k + 1 :])) % shape[k] + d
                    if ((index < 0) | (index >= shape[k])).any():
                        return None, f"direction code {c} at cell {int(lin[at][(index < 0) | (index >= shape[k])][0])} leaves the grid"
                here = steps_inside(step, extent)
                local = sum(d * int(np.prod(extent[k + 1 :])) for k, d in enumerate(step))
                inner = np.zeros(extent, bool)
                inner[here] = at[here]
                to[inner] = place[inner] + local
            try:
                end, steps = ends_of(to.ravel())
            except ValueError as error:
                return None, str(error)
            flat, lin = raw.ravel(), lin.ravel()
            root = lin[end] * 2 + (flat[end] != NO_PARENT)
            root[masked] = -1
            return [e, flat.astype(np.uint16), root, steps.astype(np.int32)], None

        def run(batches):
            for batch in batches:
                for tile, e, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    values, error = work(tile, np.frombuffer(e, dtype), np.frombuffer(raw, np.float64))
                    out = [v.tobytes() for v in values] if values else [None] * 4
                    yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), *(pa.array([v], pa.binary()) for v in out), pa.array([error], pa.string())], ["tile", "e", "code", "root", "dist", "error"])

        both = made.df.join(codes.df.withColumnRenamed("e", "raw"), "tile").select("tile", "e", "raw")
        table = self.kept(both.mapInArrow(run, "tile long, e binary, code binary, root binary, dist binary, error string"))
        if wrong := table.where("error is not null").select("error").limit(1).collect():
            raise ValueError(wrong[0].error)
        return table.drop("error")

    @cached_property
    def ends(self) -> DataFrame:
        # Chains through blocks are no longer than the exits, so doubling ends within 64 rounds unless they run in circles.
        return resolved(self.told.where("kind = 'exit'"), self.kept)

    @cached_property
    def basins(self) -> DataFrame:
        seeds = self.told.where(F.col("kind") == SEED).select("lin", F.col("e").cast(self.grid.cells.schema["e"].dataType).alias("e"), "nz")
        found = seeds.join(self.given, "lin")
        if wrong := found.where("label < 0").limit(1).collect():
            raise ValueError(f"flood-parent chain ends at unlabelled cell {wrong[0].lin}")
        return stored(found.select(F.col("label").alias("basin_id"), "lin", "e", "nz"))

    @cached_property
    def merge_list(self) -> list[Merge]:
        cells = self.valid.select("lin", "e", "nz")
        leaf = self.leaf
        told = self.given_merges.join(cells.withColumnRenamed("lin", "saddle"), "saddle").join(leaf.select(F.col("lin").alias("saddle"), F.col("leaf").alias("leaf_saddle")), "saddle").join(leaf.select(F.col("lin").alias("other"), F.col("leaf").alias("leaf_other")), "other")
        rows = told.orderBy("merge_id").collect()
        if len(rows) != self.given_merges.count():
            raise ValueError("a merge refers to a masked cell")
        return [Merge(r.saddle, r.other, float(r.e), r.deeper, r.shallower, r.saddle_side, r.leaf_saddle, r.leaf_other, r.nz) for r in rows]

    @cached_property
    def labels_table(self) -> DataFrame:
        return self.given.join(self.codes, "lin").select("lin", "label", "parent")


def reconstruct_mep(grid: Grid, labels: DataFrame, parents: DataFrame, merges: DataFrame, n_basins: int, start, end, neighborhood: str = "von_neumann"):
    """``([index], [energy])`` of the minimum-energy path from a stored flood state, or None if no path joins the cells.

    Cells that the flood had not reached (label -1) are joined to nothing.
    """
    state = FloodState(grid, labels, parents, merges, n_basins, neighborhood)
    found = find_minimum_energy_path(grid, start, end, tree=state)
    return found
