"""Watershed of a grid: floods of blocks, joined at their borders.

A flood that takes cells in ascending order has the same result as: the first lower neighbour of each cell
by stencil position (its parent), the seed at the end of the parent chain (its leaf), the least edge between any
two leaves, the minimum spanning forest of those edges, and for each cell the basin that is alive in its
leaf's component when the cell is reached. "Lower" is by the total order (energy, sign of zero, linear index).

Blocks with one layer of their neighbours' cells (``corrie.operators.tiles``) do this as arrays:

* Each finds parents, and follows them to a root: a seed, or a cell whose parent is in another block (an exit).
* With the roots of the layer around it, each knows where its exits lead, and the least edge between any two
  roots; edges that close a circle inside the block are left out, as they are in no spanning forest.
* Only exits and edges are rows of tables. Exits are joined with each other until all end at seeds, and edges
  are then edges between seeds.
* Blocks give their cells labels: the basin of the root, and from there up the chain of absorptions.

Only the spanning forest, one edge for each basin at most, is replayed on the driver; where there are more edges than
``DRIVER_EDGES``, rounds of Boruvka's algorithm thin them out in Spark first.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cached_property
from itertools import count
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.functions.index import NO_PARENT, inside, offsets, zero_sign
from corrie.meta import Grid, GridMeta, check_neighbourhood
from corrie.operators.tiles import MASKED, Blocks, Tiling, blocks, order_key, shifted, steps_inside, with_borders
from corrie.store import Kept, numbered, stored

DRIVER_EDGES = 500_000
#: Basins up to which the chains of absorptions are sent to all executors, some 40 bytes for each.
CHAINS = 1_500_000
ENDLESS = "flood-parent chain does not terminate"
#: Pairs of neighbours in different basins that a block holds before it reduces them.
PAIRS = 1 << 22


@dataclass(frozen=True)
class Merge:
    """Basin ``shallower`` joins ``deeper`` at cell ``saddle``, beside cell ``other``; ``leaf_*`` are their seeds' basins."""

    saddle: int
    other: int
    e: float
    deeper: int
    shallower: int
    saddle_side: int
    leaf_saddle: int
    leaf_other: int
    nz: int


def stencil_of(shape, neighbourhood: str) -> list[tuple[int, int, tuple[int, ...], int]]:
    """``(position, code, step, jump)``: the stencil with the steps' differences in linear index."""
    meta = GridMeta(("",) * len(shape), tuple(shape))
    return [(p, c, s, sum(d * t for d, t in zip(s, meta.strides, strict=True))) for p, c, s in offsets(meta, neighbourhood)]


def first_lower(key: np.ndarray, stencil) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the parents of a block's cells, and where in the block those are (cells without parent in it: themselves).

    ``key`` has one layer around the block. A neighbour with an equal key is lower if it comes before.
    """
    own = key[(slice(1, -1),) * key.ndim]
    code = np.full(own.shape, NO_PARENT, np.uint16)
    place = np.arange(own.size, dtype=np.int64).reshape(own.shape)
    to = place.copy()
    open_ = own != MASKED
    for _, c, step, jump in stencil:
        near = shifted(key, step)
        lower = ((near <= own) if jump < 0 else (near < own)) & open_
        if lower.any():
            code[lower] = c
            here = steps_inside(step, own.shape)
            local = sum(d * prod(own.shape[k + 1 :]) for k, d in enumerate(step))
            to[here][lower[here]] = place[here][lower[here]] + local
            open_ &= ~lower
            if not open_.any():
                break
    return code, to.ravel()


def ends_of(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chain of a forest of pointers ends, and how many steps that takes."""
    steps = (to != np.arange(len(to))).astype(np.int32)
    for _ in range(len(to).bit_length() + 1):
        further = to[to]
        if np.array_equal(further, to):
            return to, steps
        steps = steps + steps[to]
        to = further
    raise ValueError(ENDLESS)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges in ascending order, which ones a minimum spanning forest takes; nodes are small integers."""
    top = list(range(int(max(a.max(), b.max())) + 1))
    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x != y:
            top[x] = y
            keep[k] = True
    return keep


#: Rows of what blocks tell about their roots. A root is twice the linear index, plus one for an exit.
#: ``exit``: exit ``a`` leads to ``n``, whose root ``b`` is ``steps`` from it; ``edge``: cell ``lin`` of root ``a`` beside ``n`` of root ``b``.
TOLD = "kind string, a long, b long, e double, nz int, lin long, pos int, n long, steps int"
SEED, EXIT, EDGE = "seed", "exit", "edge"


def told(kind: str, count: int, /, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    names = [x.split() for x in TOLD.split(", ")]
    columns["kind"] = [kind] * count
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(count, kinds[t]) for c, t in names], [c for c, _ in names])


def parents_and_roots(made: Blocks, neighbourhood: str) -> DataFrame:
    """``(tile, e, code, root, dist)``: blocks with their cells' parents, roots in the block and steps to those."""
    tiling, stencil = made.tiling, stencil_of(made.tiling.shape, neighbourhood)

    def work(tile, arrays):
        e = arrays["e"]
        own = np.ascontiguousarray(e[(slice(1, -1),) * e.ndim])
        code, to = first_lower(order_key(e), stencil)
        end, steps = ends_of(to)
        lin = tiling.lin(tile).ravel()
        root = lin[end] * 2 + (code.ravel()[end] != NO_PARENT)
        root[np.isnan(own.ravel())] = -1
        values = [own, code, root.astype(np.int64), steps.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["tile", "e", "code", "root", "dist"])

    return with_borders(made.df, tiling, made.dtype, ["e"], [], work, "tile long, e binary, code binary, root binary, dist binary")


def borders(table: DataFrame, made: Blocks, neighbourhood: str) -> DataFrame:
    """What blocks tell about their roots (``TOLD``)."""
    tiling, stencil = made.tiling, stencil_of(made.tiling.shape, neighbourhood)
    by_code = {c: (s, j) for _, c, s, j in stencil}

    def work(tile, arrays):
        e, roots, dist, code = (arrays[c] for c in ("e", "root", "dist", "code"))
        core = (slice(1, -1),) * e.ndim
        key, own, lin = order_key(e), roots[core], tiling.lin(tile)
        seeds = (own == lin * 2) & (key[core] != MASKED)
        if seeds.any():
            k = key[core][seeds]
            yield told(SEED, len(k), a=own[seeds], e=e[core][seeds].astype(np.float64), nz=np.where(k == -1, 0, 1), lin=lin[seeds])
        exits = own == lin * 2 + 1
        for c in np.unique(code[exits]):
            step, jump = by_code[int(c)]
            at = exits & (code == c)
            yield told(EXIT, int(at.sum()), a=own[at], b=shifted(roots, step)[at], n=lin[at] + jump, steps=shifted(dist, step)[at])
        flat = key[core].ravel()
        rank = np.empty(flat.size, np.int64)
        rank[np.argsort(flat, kind="stable")] = np.arange(flat.size)
        names, inverse = np.unique(roots, return_inverse=True)
        inverse = inverse.reshape(roots.shape)
        mine, rank = inverse[core], rank.reshape(own.shape)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def least():
            pair, order, cell, near = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.lexsort((order, pair))
            first = first[np.append(True, np.diff(pair[first]) != 0)]
            return pair[first], order[first], cell[first], near[first]

        place = np.arange(flat.size).reshape(own.shape)
        for pos, _, step, jump in stencil:
            near = shifted(key, step)
            lower = ((near <= key[core]) if jump < 0 else (near < key[core])) & (shifted(inverse, step) != mine) & (key[core] != MASKED)
            if lower.any():
                a, b = mine[lower], shifted(inverse, step)[lower]
                held.append((np.minimum(a, b) * len(names) + np.maximum(a, b), rank[lower] * 4096 + pos, place[lower], b))
                if sum(len(x[0]) for x in held) > PAIRS:
                    held[:] = [least()]
        if held:
            pair, order, cell, near = least()
            sort = np.argsort(order)
            order, cell, near = order[sort], cell[sort], near[sort]
            keep = spanning(mine.ravel()[cell], near)
            order, cell, near = order[keep], cell[keep], near[keep]
            jumps = np.zeros(4096, np.int64)
            for pos, _, _, jump in stencil:
                jumps[pos] = jump
            at, pos = lin.ravel()[cell], order % 4096
            yield told(EDGE, len(at), a=own.ravel()[cell], b=names[near], e=e[core].ravel()[cell].astype(np.float64), nz=np.where(flat[cell] == -1, 0, 1), lin=at, pos=pos, n=at + jumps[pos])

    return with_borders(table, tiling, made.dtype, ["e", "root", "dist"], ["code"], work, TOLD)


def resolved(exits: DataFrame, kept: Kept) -> DataFrame:
    """``(a, seed)``: the seed at which each exit ends, by doubling; those that have ended take no part any more."""
    now = kept(exits.select("a", "b"))
    for rounds in count():
        if not now.where("b % 2 = 1").limit(1).count():
            break
        if rounds > 40:
            raise ValueError(ENDLESS)
        onward = now.select(F.col("a").alias("b"), F.col("b").alias("to"))
        now = kept(now.where("b % 2 = 1").join(onward, "b").select("a", F.col("to").alias("b")).unionByName(now.where("b % 2 = 0")))
    return now.select("a", F.col("b").alias("seed"))


@dataclass
class Climb:
    """Chains of absorptions, from a basin to the one that takes it in, as arrays by basin.

    Besides the next basin each has a jump further up (skew-binary, so a chain of any length takes a
    logarithm of its length in steps), and both have the key of the last absorption on the way.
    """

    up: np.ndarray
    jump: np.ndarray
    up_key: np.ndarray
    up_lin: np.ndarray
    jump_key: np.ndarray
    jump_lin: np.ndarray

    @classmethod
    def of(cls, n: int, merges: list[Merge]) -> Climb:
        up, jump, depth = list(range(n)), list(range(n)), [0] * n
        keys = order_key(np.array([m.e for m in merges], np.float64)).tolist()
        never = (MASKED, MASKED)
        up_at, jump_at = [never] * n, [never] * n
        into = {m.shallower: (m.deeper, (k, m.saddle)) for m, k in zip(merges, keys, strict=True)}
        # -0.0 and 0.0 differ in their keys, and e of a merge has its sign.
        for b in range(n):
            if b in into:
                p, at = into[b]
                up[b], up_at[b], depth[b] = p, at, depth[p] + 1
                q = jump[p]
                if depth[p] - depth[q] == depth[q] - depth[jump[q]] and depth[p] > depth[q]:
                    jump[b], jump_at[b] = jump[q], jump_at[q] if depth[q] > depth[jump[q]] else jump_at[p]
                else:
                    jump[b], jump_at[b] = p, at
        split = lambda pairs, i: np.array([x[i] for x in pairs], np.int64)
        return cls(np.array(up, np.int64), np.array(jump, np.int64), split(up_at, 0), split(up_at, 1), split(jump_at, 0), split(jump_at, 1))

    def live(self, basin: np.ndarray, key: np.ndarray, lin: np.ndarray) -> np.ndarray:
        """The basin that holds ``basin`` just before the cell of the key is taken."""
        now, at = basin.copy(), np.arange(len(basin))
        while len(at):
            b, k, x = now[at], key[at], lin[at]
            before = lambda keys, lins: (keys[b] < k) | ((keys[b] == k) & (lins[b] < x))  # noqa: B023, E731
            moves = before(self.up_key, self.up_lin)
            far = before(self.jump_key, self.jump_lin)
            at, b, far = at[moves], b[moves], far[moves]
            now[at] = np.where(far, self.jump[b], self.up[b])
        return now

    def table(self, spark) -> DataFrame:
        """The same as rows: ``basin, up, jump`` and the keys."""
        return spark.createDataFrame(pa.table({"basin": np.arange(len(self.up)), **{c: getattr(self, c) for c in ("up", "jump", "up_key", "up_lin", "jump_key", "jump_lin")}}))


def climbed(rows: DataFrame, chains: DataFrame, kept: Kept) -> DataFrame:
    """``(lin, key, basin)`` rows with the live basin, by joins: as many rounds as the longest way has steps."""
    done, open_ = [], rows
    while True:
        joined = kept(open_.join(chains, "basin"))
        before = lambda c: (F.col(f"{c}_key") < F.col("key")) | ((F.col(f"{c}_key") == F.col("key")) & (F.col(f"{c}_lin") < F.col("lin")))
        done.append(joined.where(~before("up")).select("lin", "basin"))
        moving = joined.where(before("up"))
        if not moving.limit(1).count():
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out
        open_ = moving.select("lin", "key", F.when(before("jump"), F.col("jump")).otherwise(F.col("up")).alias("basin"))


def thinned(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of edges ``(a, b, rank)`` by Boruvka rounds; ranks are unique."""
    e, chosen = stored(edges.select("a", "b", "rank")), None
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank"))
        least = stored(both.groupBy("a").agg(F.min_by("b", "rank").alias("b"), F.min("rank").alias("rank")))
        ranks = least.select("rank").distinct()
        chosen = ranks if chosen is None else chosen.unionByName(ranks)
        back = least.select(F.col("a").alias("b"), F.col("b").alias("a2"))
        point = least.join(back, "b").select("a", F.when((F.col("a2") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("to"))
        point = stored(point)
        while True:
            jump = point.alias("x").join(point.alias("y"), F.col("x.to") == F.col("y.a")).select("x.a", F.col("y.to").alias("to"))
            jump, before = stored(jump), point
            point = jump
            if not jump.join(before, ["a", "to"], "left_anti").limit(1).count():
                break
        moved = e.join(point, "a").select(F.col("to").alias("a"), "b", "rank").join(point.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b").select("a", F.col("tb").alias("b"), "rank")
        e = stored(moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("rank").alias("rank")))
    return edges if chosen is None else edges.join(stored(chosen.distinct()), "rank", "left_semi")


@dataclass
class Watershed:
    """Flood of a grid. Tables are made when first asked for and kept in the shared folder."""

    grid: Grid
    neighborhood: str = "von_neumann"
    keep_parents: bool = True
    dropped: bool = field(default=False, init=False)

    def __post_init__(self):
        self.grid.check()
        check_neighbourhood(self.neighborhood)
        self.kept = Kept()

    @property
    def has_labels(self) -> bool:
        return not self.dropped

    def drop_labels(self) -> None:
        """Release labels and parents, their files included; basins, merges and what follows from them stay."""
        self.basins, self.merge_list  # noqa: B018  made before their sources go
        self.dropped = True
        for name in ("tiles", "told", "ends", "roots", "leaf", "parents_table", "edges", "labels_table"):
            self.__dict__.pop(name, None)
        self.kept.drop()

    def need_labels(self) -> None:
        if self.dropped:
            raise RuntimeError("labels were dropped")

    @property
    def spark(self):
        return self.grid.cells.sparkSession

    @property
    def blocks(self) -> Blocks:
        return blocks(self.grid)

    @property
    def tiling(self) -> Tiling:
        return self.blocks.tiling

    @property
    def valid(self) -> DataFrame:
        return self.grid.cells.where("e is not null").withColumn("nz", zero_sign())

    @cached_property
    def tiles(self) -> DataFrame:
        return self.kept(parents_and_roots(self.blocks, self.neighborhood))

    @cached_property
    def told(self) -> DataFrame:
        return self.kept(borders(self.tiles, self.blocks, self.neighborhood))

    @cached_property
    def ends(self) -> DataFrame:
        """``(a, seed)`` of every exit."""
        return resolved(self.told.where(F.col("kind") == EXIT), self.kept)

    def cellwise(self, columns: list[str], work, schema: str, beside: DataFrame | None = None) -> DataFrame:
        """``work(lin, arrays by name, row of beside)`` over blocks; ``beside`` has one row for a block, with ``tile``."""
        tiling, dtype, names = self.tiling, self.blocks.dtype, schema_names(schema)
        kinds = {"e": dtype, "code": np.uint16, "root": np.int64, "dist": np.int32}
        table = self.tiles.select("tile", *columns)
        table = table if beside is None else table.join(beside, "tile", "left")

        def run(batches):
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    arrays = {c: np.frombuffer(v, kinds[c]) for c, v in zip(columns, row[1:], strict=False)}
                    out = work(tiling.lin(row[0]).ravel(), arrays, row[1 + len(columns) :])
                    for at in range(0, len(out[0]), 1 << 18):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 18)]) for c in out], names)

        return table.mapInArrow(run, schema)

    @cached_property
    def parents_table(self) -> DataFrame:
        """``(lin, parent, code)`` of every cell that is no seed."""
        jumps = np.zeros(NO_PARENT + 1, np.int64)
        for _, c, _, jump in stencil_of(self.grid.meta.shape, self.neighborhood):
            jumps[c] = jump

        def work(lin, arrays, _):
            led = arrays["code"] != NO_PARENT
            code = arrays["code"][led]
            return lin[led], lin[led] + jumps[code], code.astype(np.int32)

        return self.cellwise(["code"], work, "lin long, parent long, code int")

    @cached_property
    def basins(self) -> DataFrame:
        """``(basin_id, lin, e)`` of the seeds, in flood order."""
        kind = self.grid.cells.schema["e"].dataType
        seeds = self.told.where(F.col("kind") == SEED).select("lin", F.col("e").cast(kind).alias("e"), "nz")
        return stored(numbered(seeds, ["e", "nz", "lin"], "basin_id").select(F.col("basin_id").cast("int").alias("basin_id"), "lin", "e", "nz"))

    def with_leaf(self, rows: DataFrame, root: str, name: str) -> DataFrame:
        """Add the basin of a column of roots."""
        leaf = self.basins.select((F.col("lin") * 2).alias("seed"), F.col("basin_id").alias(name))
        through = rows.where(F.col(root) % 2 == 1).join(self.ends.withColumnRenamed("a", root), root)
        return rows.where(F.col(root) % 2 == 0).withColumn("seed", F.col(root)).unionByName(through).join(leaf, "seed").drop("seed")

    @cached_property
    def roots(self) -> DataFrame:
        """``(tile, roots, leaves)``: the basins of a block's roots."""

        def distinct(batches):
            for batch in batches:
                for tile, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = np.unique(np.frombuffer(root, np.int64))
                    found = found[found >= 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), tile, np.int64)), pa.array(found)], ["tile", "root"])

        each = self.with_leaf(self.tiles.select("tile", "root").mapInArrow(distinct, "tile long, root long"), "root", "leaf")
        return each.groupBy("tile").agg(F.collect_list(F.struct("root", "leaf")).alias("leaves"))

    @cached_property
    def leaf(self) -> DataFrame:
        """``(lin, leaf)``: the basin of the seed that ends the cell's parent chain."""

        def work(lin, arrays, beside):
            root = arrays["root"]
            led = root >= 0
            return lin[led], leaves_of(root[led], beside[0])

        return self.cellwise(["root"], work, "lin long, leaf int", self.roots)

    @cached_property
    def edges(self) -> DataFrame:
        """Edges between leaves, the least of each two among them, numbered in flood order (``rank``)."""
        found = self.told.where(F.col("kind") == EDGE).select("a", "b", "e", "nz", "lin", "pos", "n")
        pairs = self.with_leaf(self.with_leaf(found, "a", "leaf_saddle"), "b", "leaf_other").where("leaf_saddle <> leaf_other")
        least = F.min(F.struct("e", "nz", "lin", "pos", "n", "leaf_saddle", "leaf_other")).alias("s")
        once = pairs.groupBy(F.least("leaf_saddle", "leaf_other").alias("a"), F.greatest("leaf_saddle", "leaf_other").alias("b")).agg(least)
        return self.kept(numbered(once.select("a", "b", "s.*"), ["e", "nz", "lin", "pos"], "rank"))

    @cached_property
    def merge_list(self) -> list[Merge]:
        edges = self.edges
        if edges.count() > DRIVER_EDGES:
            edges = thinned(edges)
        top: dict[int, int] = {}

        def live(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x

        found = []
        for r in edges.orderBy("rank").toLocalIterator():
            a, b = live(r.leaf_saddle), live(r.leaf_other)
            if a != b:
                top[max(a, b)] = min(a, b)
                found.append(Merge(r.lin, r.n, float(r.e), min(a, b), max(a, b), a, r.leaf_saddle, r.leaf_other, r.nz))
        return found

    @cached_property
    def merges(self) -> DataFrame:
        """``(merge_id, saddle, other, e, deeper, shallower, saddle_side)`` in flood order."""
        rows = [(i, m.saddle, m.other, m.e, m.deeper, m.shallower, m.saddle_side) for i, m in enumerate(self.merge_list)]
        return self.spark.createDataFrame(rows, "merge_id int, saddle long, other long, e double, deeper int, shallower int, saddle_side int")

    @cached_property
    def labels_table(self) -> DataFrame:
        """``(lin, label, parent)`` of every cell; -1 and 65535 where masked, 65535 at seeds."""
        n = self.basins.count()
        climb = Climb.of(n, self.merge_list)
        small = n <= CHAINS
        chains = self.spark.sparkContext.broadcast(climb) if small else None

        def work(lin, arrays, beside):
            root, key = arrays["root"], order_key(arrays["e"])
            led, label = root >= 0, np.full(len(root), -1, np.int32)
            if led.any():
                leaf = leaves_of(root[led], beside[0])
                label[led] = chains.value.live(leaf.astype(np.int64), key[led], lin[led]) if small else leaf
            return lin, label, arrays["code"].astype(np.int32), key

        table = self.cellwise(["e", "code", "root"], work, "lin long, label int, parent int, key long", self.roots)
        if small:
            return self.kept(table.drop("key"))
        table = self.kept(table)
        live = climbed(table.where("label >= 0").select("lin", "key", F.col("label").cast("long").alias("basin")), self.kept(climb.table(self.spark)), self.kept)
        masked = table.where("label < 0").select("lin", "label", "parent")
        return self.kept(table.where("label >= 0").select("lin", "parent").join(live, "lin").select("lin", F.col("basin").cast("int").alias("label"), "parent").unionByName(masked))

    @property
    def labels(self) -> DataFrame:
        self.need_labels()
        return self.labels_table.select("lin", "label")

    @property
    def parents(self) -> DataFrame:
        self.need_labels()
        if not self.keep_parents:
            raise ValueError("the flood was run without parents=True")
        return self.labels_table.select("lin", "parent")

    @cached_property
    def fingerprint(self) -> bytes:
        return energy_fingerprint(self.grid)


def schema_names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def leaves_of(root: np.ndarray, told: list[dict]) -> np.ndarray:
    known = np.array([(r["root"], r["leaf"]) for r in told], np.int64).reshape(-1, 2)
    known = known[np.argsort(known[:, 0])]
    return known[np.searchsorted(known[:, 0], root), 1].astype(np.int32)


def find_watershed_segmentation(grid: Grid, neighborhood: str = "von_neumann", *, parents: bool = False) -> Watershed:
    return Watershed(grid, neighborhood, parents)


def fingerprint_sample(grid: Grid) -> DataFrame:
    """Every k-th cell by linear index, k such that at most about two million are taken."""
    return grid.cells.where(F.col("lin") % sample_step(grid.meta) == 0).select("lin", "e")


def sample_step(meta: GridMeta) -> int:
    return max(1, meta.size >> 20)


def energy_fingerprint(grid: Grid) -> bytes:
    """16 bytes that differ where shape, type or a sampled energy does.

    Blocks digest the samples they hold; the driver gets one digest a block and digests those, by block.
    """
    made, step = blocks(grid), sample_step(grid.meta)
    tiling, dtype = made.tiling, made.dtype

    def digests(batches):
        for batch in batches:
            for tile, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                taken = np.frombuffer(e, dtype)[tiling.lin(tile).ravel() % step == 0].copy()
                taken[np.isnan(taken)] = np.nan
                yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([hashlib.blake2b(taken.tobytes(), digest_size=16).digest()], pa.binary())], ["tile", "digest"])

    digest = hashlib.blake2b(f"{grid.meta.shape}{grid.dtype}".encode(), digest_size=16)
    for _, one in sorted((r.tile, bytes(r.digest)) for r in made.df.mapInArrow(digests, "tile long, digest binary").collect()):
        digest.update(one)
    return digest.digest()
def flood_order(grid: Grid) -> DataFrame:
    """``(rank, lin)`` of the cells that are not masked, in the order in which they are flooded."""
    valid = grid.cells.where("e is not null").withColumn("nz", zero_sign())
    return numbered(valid.select("lin", "e", "nz"), ["e", "nz", "lin"], "rank").select("rank", "lin")


def flood_violations(grid: Grid, labels: DataFrame, basins: DataFrame, merges: DataFrame) -> DataFrame:
    """``(rule, id)`` of each row of a flood state that contradicts it; a sound state has none.

    ``labels`` has ``lin, label, parent``; codes must lead to a lower cell that is not masked, labels must
    name basins exactly where the grid is not masked, and merges must name each basin at most once as the
    shallower one, with existing cells and an own side that is one of the two.
    """
    n = basins.count()
    cells = grid.cells.where("e is not null").withColumn("nz", zero_sign())
    checked = labels.join(cells.select("lin", *grid.meta.indices, "e", "nz"), "lin", "left")
    wrong = [
        checked.where((F.col("e").isNull() & (F.col("label") != -1)) | (F.col("e").isNotNull() & ~F.col("label").between(0, n - 1))).select(F.lit("label").alias("rule"), F.col("lin").alias("id")),
    ]
    d = grid.meta.ndim
    coded = checked.where(F.col("parent") != NO_PARENT).withColumn("step", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: ((F.col("parent") / F.pow(F.lit(3), F.lit(d - 1) - k)).cast("long") % 3 - 1).cast("int")))
    jump = sum((F.col("step")[k] * s for k, s in enumerate(grid.meta.strides)), F.lit(0))
    led = coded.withColumn("to", F.when(inside(grid.meta, "step") & (F.col("parent") < 3**d), F.col("lin") + jump))
    target = cells.select(F.col("lin").alias("to"), F.col("e").alias("te"), F.col("nz").alias("tz"))
    led = led.join(target, "to", "left")
    wrong.append(led.where(F.col("te").isNull() | (F.struct("te", "tz", "to") >= F.struct("e", "nz", "lin"))).select(F.lit("parent").alias("rule"), F.col("lin").alias("id")))
    sound = F.col("deeper").between(0, n - 1) & F.col("shallower").between(0, n - 1) & (F.col("deeper") < F.col("shallower")) & F.col("saddle_side").isin(F.col("deeper"), F.col("shallower")) & F.col("saddle").between(0, grid.meta.size - 1) & F.col("other").between(0, grid.meta.size - 1)
    wrong.append(merges.where(~sound).select(F.lit("merge").alias("rule"), F.col("merge_id").cast("long").alias("id")))
    wrong.append(merges.groupBy("shallower").count().where("count > 1").select(F.lit("twice").alias("rule"), F.col("shallower").cast("long").alias("id")))
    out = wrong[0]
    for w in wrong[1:]:
        out = out.unionByName(w)
    return out
