"""Saddles and minimum-energy paths from a flood."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.functions.index import NO_PARENT, index_of
from corrie.meta import Grid, check_neighbourhood, check_points
from corrie.operators.flood import EXIT, Watershed, stencil_of


class Line:
    """Basins in a row in which everything a merge has joined stands together.

    A merge puts the row of the shallower basin behind that of the deeper one, and the gap between the two
    holds the merge. The first merge that connects two basins is then the latest in the gaps between them, and
    which side of it a basin is on shows in its place. Gaps that no merge closed hold ``NEVER``.
    """

    NEVER = 2**62

    def __init__(self, n_basins: int, merges: list):
        self.merges = merges
        after, gap = np.full(n_basins, -1), np.full(n_basins, self.NEVER)
        last, heads = np.arange(n_basins), np.ones(n_basins, bool)
        for k, m in enumerate(merges):
            end = last[m.deeper]
            after[end], gap[end], heads[m.shallower] = m.shallower, k, False
            last[m.deeper] = last[m.shallower]
        self.place, self.gaps = np.zeros(n_basins, int), np.full(n_basins, self.NEVER)
        at = 0
        for head in np.flatnonzero(heads):
            while head >= 0:
                self.place[head], self.gaps[at] = at, gap[head]
                head, at = after[head], at + 1

    def widest(self, a: int, b: int) -> int:
        """The place of the gap with the latest merge between two different basins."""
        low, high = sorted((self.place[a], self.place[b]))
        return low + int(np.argmax(self.gaps[low:high]))

    def joining(self, a: int, b: int):
        """The merge that first connects two different basins, or None."""
        k = self.gaps[self.widest(a, b)]
        return None if k == self.NEVER else self.merges[k]

    def legs(self, a: int, leaf_a: int, b: int, leaf_b: int) -> list[tuple[int, int, int]] | None:
        """``(from, to, leaf)``: pieces of the way from cell a to cell b inside one basin each, in order.

        In rounds, every piece between two basins is cut at the merge that connects them.
        """
        pieces = [(a, leaf_a, b, leaf_b)]
        while any(la != lb for _, la, _, lb in pieces):
            cut = []
            for x, lx, y, ly in pieces:
                if lx == ly:
                    cut.append((x, lx, y, ly))
                    continue
                at = self.widest(lx, ly)
                if self.gaps[at] == self.NEVER:
                    return None
                m = self.merges[self.gaps[at]]
                banks = {bool(self.place[leaf] <= at): (cell, leaf) for cell, leaf in ((m.saddle, m.leaf_saddle), (m.other, m.leaf_other))}
                here = bool(self.place[lx] <= at)
                cut += [(x, lx, *banks[here]), (*banks[not here], y, ly)]
            pieces = cut
        return [(x, y, leaf) for x, leaf, y, _ in pieces]


def end_points(tree: Watershed, start, end) -> tuple[list[int], dict[int, tuple[float, int, int]]]:
    """Linear indices of the two cells, and their keys; masked ones are an error."""
    cells = check_points(tree.grid.meta, start=start, end=end)
    found = {r.lin: (float(r.e), r.nz, r.lin) for r in tree.valid.where(F.col("lin").isin(cells)).select("lin", "e", "nz").collect()}
    for name, lin in zip(("start", "end"), cells, strict=True):
        if lin not in found:
            raise ValueError(f"{name} is a masked (NaN) cell")
    return cells, found


def leaves(tree: Watershed, cells: list[int]) -> dict[int, int]:
    return {r.lin: r.leaf for r in tree.leaf.where(F.col("lin").isin(cells)).collect()}


def find_iwf_grid(grid: Grid, start, end, neighborhood: str = "von_neumann", *, tree: Watershed | None = None):
    """``(index, energy)`` of the minimax saddle between two cells, or None if no path joins them.

    It is the first cell of the flood that connects them; one of the cells itself if it lies above the pass.
    """
    grid.check()
    check_neighbourhood(neighborhood)
    tree = tree or Watershed(grid, neighborhood)
    (a, b), keys = end_points(tree, start, end)
    best = max(keys.values())
    if a != b:
        leaf = leaves(tree, [a, b])
        if leaf[a] != leaf[b]:
            m = Line(tree.basins.count(), tree.merge_list).joining(leaf[a], leaf[b])
            if m is None:
                return None
            best = max(best, (m.e, m.nz, m.saddle))
    return grid.meta.index(best[2]), best[0]


def saddles(tree: Watershed, pairs: DataFrame) -> DataFrame:
    """``(pair_id, lin, e)``: the minimax saddle of every pair ``(pair_id, start, end)`` of linear indices.

    Pairs that no path joins and those with a masked cell have no row. The latest gap between two places in the
    row of basins is the later of two from a table of the latest among the next 1, 2, 4, ... gaps, so a pair
    takes two joins and no pair is looked at alone.
    """
    spark, kept, line = tree.spark, tree.kept, Line(tree.basins.count(), tree.merge_list)
    n = len(line.place)
    places = spark.createDataFrame(pa.table({"leaf": np.arange(n), "place": line.place.astype(np.int64)}))
    now = kept(spark.createDataFrame(pa.table({"place": np.arange(n), "top": line.gaps.astype(np.int64)})).withColumn("level", F.lit(0)))
    latest = now
    for level in range(1, max(n - 1, 1).bit_length()):
        ahead = now.select((F.col("place") - 2 ** (level - 1)).alias("place"), F.col("top").alias("other"))
        now = kept(now.join(ahead, "place").select("place", F.greatest("top", "other").alias("top"), F.lit(level).alias("level")))
        latest = latest.unionByName(now)
    passes = spark.createDataFrame([(k, m.e, m.nz, m.saddle) for k, m in enumerate(tree.merge_list)], "top long, e double, nz int, lin long").select("top", F.struct("e", "nz", "lin").alias("pass"))
    cells = tree.valid.select("lin", F.struct(F.col("e").cast("double").alias("e"), "nz", "lin").alias("own")).join(tree.leaf, "lin").join(places, "leaf")
    side = lambda name: cells.select(F.col("lin").alias(name), F.col("own").alias(f"{name}_own"), F.col("place").alias(f"{name}_place"))
    both = pairs.select("pair_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).join(side("start"), "start").join(side("end"), "end")
    both = both.withColumns({"low": F.least("start_place", "end_place"), "high": F.greatest("start_place", "end_place"), "here": F.greatest("start_own", "end_own")})
    same = both.where("low = high").select("pair_id", F.col("here").alias("s"))
    apart = both.where("low < high").withColumn("level", (F.length(F.bin(F.col("high") - F.col("low"))) - 1).cast("int"))
    one = latest.select("level", F.col("place").alias("low"), F.col("top").alias("first"))
    two = latest.select("level", F.col("place").alias("back"), F.col("top").alias("second"))
    apart = apart.join(one, ["level", "low"]).withColumn("back", (F.col("high") - F.pow(F.lit(2), F.col("level"))).cast("long")).join(two, ["level", "back"])
    crossed = apart.select("pair_id", "here", F.greatest("first", "second").alias("top")).join(passes, "top")
    return same.unionByName(crossed.select("pair_id", F.greatest("here", "pass").alias("s"))).select("pair_id", "s.lin", "s.e")


def check_tree(grid: Grid, tree: Watershed, neighborhood: str | None) -> None:
    """A flood may stand in for a new one only if it is of the same grid, whole, and with parents."""
    if tree.dropped:
        raise ValueError("the tree's labels were dropped")
    if not tree.keep_parents:
        raise ValueError("the tree needs parents=True")
    if neighborhood is not None and neighborhood != tree.neighborhood:
        raise ValueError(f"the tree's neighborhood is {tree.neighborhood}")
    if tree.grid.meta.shape != grid.meta.shape:
        raise ValueError(f"the tree's shape is {tree.grid.meta.shape}, the grid's {grid.meta.shape}")
    if tree.grid is not grid and Watershed(grid, tree.neighborhood).fingerprint != tree.fingerprint:
        raise ValueError("the tree is of a different energy grid")


def crossings(tree: Watershed, cells: list[int]) -> DataFrame:
    """``(origin, at, distance)``: the cells at which the parent chains of the given cells enter a block, with the origins themselves.

    Exits are linked to the exits after them; links of doubled length are made and kept as far as the longest
    chain goes, and then followed from the longest to the shortest, each round from what was written before. So plans stay
    small, and what is joined are borders, not cells.
    """
    spark, kept = tree.spark, tree.kept
    origins = sorted(set(cells))
    place = spark.createDataFrame([(c,) for c in origins], "origin long")
    first = tree.cellwise(["root", "dist"], _rows_of(origins), "origin long, root long, distance long")
    start = kept(first)
    links = kept(tree.told.where(F.col("kind") == EXIT).select("a", "b", F.col("n").alias("enters"), (F.col("steps") + 1).cast("long").alias("steps")))
    levels = [links.select("a", "b", "steps")]
    while True:
        now = levels[-1].where("b % 2 = 1")
        if not now.limit(1).count():
            break
        onward = levels[-1].select(F.col("a").alias("b"), F.col("b").alias("to"), F.col("steps").alias("more"))
        levels.append(kept(now.join(onward, "b").select("a", F.col("to").alias("b"), (F.col("steps") + F.col("more")).alias("steps"))))
    # Roots on the way that are exits: each stands for a crossing into the next block.
    found = kept(start.where("root % 2 = 1").select("origin", F.col("root").alias("a"), "distance"))
    for level in reversed(levels):
        hop = found.join(level, "a").where("b % 2 = 1").select("origin", F.col("b").alias("a"), (F.col("distance") + F.col("steps")).alias("distance"))
        found = kept(found.unionByName(hop).distinct())
    into = found.join(links.select("a", "enters"), "a").select("origin", F.col("enters").alias("at"), (F.col("distance") + 1).alias("distance"))
    return kept(into.unionByName(place.select("origin", F.col("origin").alias("at"), F.lit(0).cast("long").alias("distance"))))


def _rows_of(cells: list[int]):
    def work(lin, arrays, _):
        at = np.flatnonzero(np.isin(lin, cells))
        return lin[at], arrays["root"][at], arrays["dist"][at].astype(np.int64)

    return work


def chains(tree: Watershed, cells: list[int]) -> DataFrame:
    """``(origin, at, distance)``: every cell on the parent chains of the given cells.

    Blocks walk the parts of the chains that lie in them.
    """
    tiling = tree.tiling
    jumps = {c: j for _, c, _, j in stencil_of(tiling.shape, tree.neighborhood)}

    def located(batches):
        for batch in batches:
            tile, _ = tiling.locate(batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], ["origin", "at", "distance", "tile"])

    def walk(batches):
        for batch in batches:
            for tile, code, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code, lin = np.frombuffer(code, np.uint16), tiling.lin(tile).ravel()
                out: list[tuple[int, int, int]] = []
                for s in starts:
                    at, steps = s["at"], s["distance"]
                    while True:
                        k = int(np.searchsorted(lin, at))
                        if k == len(lin) or lin[k] != at:
                            break
                        out.append((s["origin"], at, steps))
                        if code[k] == NO_PARENT:
                            break
                        at, steps = at + jumps[int(code[k])], steps + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["origin", "at", "distance"])

    starts = crossings(tree, cells).mapInArrow(located, "origin long, at long, distance long, tile long")
    by_block = starts.groupBy("tile").agg(F.collect_list(F.struct("origin", "at", "distance")).alias("starts"))
    return tree.tiles.select("tile", "code").join(by_block, "tile").mapInArrow(walk, "origin long, at long, distance long")


def path_table(tree: Watershed, start, end) -> DataFrame | None:
    """``(step, lin, i0.., e)`` of the path, or None if the cells are not connected.

    From each cell the path goes down its parents to a seed and up to the next saddle. It is a walk: cells
    may come twice.
    """
    (a, b), _ = end_points(tree, start, end)
    meta, spark = tree.grid.meta, tree.grid.cells.sparkSession
    if a == b:
        parts = spark.createDataFrame([(0, a)], "step long, lin long")
    else:
        leaf = leaves(tree, [a, b])
        found = Line(tree.basins.count(), tree.merge_list).legs(a, leaf[a], b, leaf[b])
        if found is None:
            return None
        walked = tree.kept(chains(tree, [c for x, y, _ in found for c in (x, y)]))
        depth = {r.origin: r.depth for r in walked.groupBy("origin").agg(F.max("distance").alias("depth")).collect()}
        rows, at = [], 0
        for x, y, _ in found:
            rows.append((x, at, 1, 0))
            at += depth[x]
            rows.append((y, at + depth[y], -1, depth[y]))  # its seed is the end of the first part
            at += depth[y] + 1
        legs = spark.createDataFrame(rows, "origin long, base long, sign int, last long")
        joined = walked.join(legs, "origin").where("sign = 1 or distance < last")
        parts = joined.select((F.col("base") + F.col("sign") * F.col("distance")).alias("step"), F.col("at").alias("lin"))
    cells = tree.grid.cells.select("lin", F.col("e").cast("double").alias("e"))
    return parts.join(cells, "lin").select("step", "lin", *index_of(meta), "e")


def find_minimum_energy_path(grid: Grid, start, end, neighborhood: str | None = None, *, tree: Watershed | None = None):
    """``([index], [energy])`` along the path, or None."""
    grid.check()
    start, end = [int(i) for i in start], [int(i) for i in end]
    if neighborhood is not None:
        check_neighbourhood(neighborhood)
    if tree is not None:
        check_tree(grid, tree, neighborhood)
    tree = tree or Watershed(grid, neighborhood or "von_neumann")
    table = path_table(tree, start, end)
    if table is None:
        return None
    rows = table.orderBy("step").collect()
    return [tuple(r[c] for c in grid.meta.indices) for r in rows], [r.e for r in rows]
