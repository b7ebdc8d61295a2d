"""Critical points of energies along a path."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrie.store import Kept, ship


@dataclass(frozen=True)
class PathProfile:
    minima: list[tuple[int, float]]
    saddles: list[tuple[int, float]]


def profile_extrema(path: DataFrame) -> DataFrame:
    """``(path_id, kind, path_index, e)`` of each path ``(path_id, step, e)``: minima and saddles in turn.

    Ends count. A plateau is reported at its last cell, except at the start, which is always step 0, and
    the end, which is always the last; a path without any change is one minimum at step 0.
    """
    along = Window.partitionBy("path_id").orderBy("step")
    whole = Window.partitionBy("path_id")
    slope = path.select("path_id", "step", "e", F.signum(F.lead("e").over(along) - F.col("e")).alias("slope"), F.max(F.struct("step", "e")).over(whole).alias("end"), F.min(F.struct("step", "e")).over(whole).alias("start"))
    moves = slope.where("slope <> 0").withColumn("before", F.lag("slope").over(along)).withColumn("after", F.lead("slope").over(along))
    down = lambda up: F.when(F.col("slope") < 0, "min" if up else "saddle").otherwise("saddle" if up else "min")
    point = lambda kind, step, e: F.struct(kind.alias("kind"), step.alias("path_index"), e.alias("e"))
    turn = F.when(F.col("before") != F.col("slope"), point(down(False), F.col("step"), F.col("e")))
    first = F.when(F.col("before").isNull(), point(down(False), F.lit(0).cast("long"), F.col("start.e")))
    last = F.when(F.col("after").isNull(), point(down(True), F.col("end.step"), F.col("end.e")))
    found = moves.select("path_id", F.explode(F.array_compact(F.array(turn, first, last))).alias("p"))
    flat = slope.groupBy("path_id").agg(F.max(F.abs("slope")).alias("m"), F.any_value("start.e").alias("e")).where("m is null or m = 0")
    return found.select("path_id", "p.kind", "p.path_index", "p.e").unionByName(flat.select("path_id", F.lit("min").alias("kind"), F.lit(0).cast("long").alias("path_index"), "e"))


def turning_points(energies: list[float]) -> list[tuple[str, int, float]]:
    """The same for one path on the driver, in order."""
    found: list[tuple[str, int, float]] = []
    going = 0
    for i, (a, b) in enumerate(zip(energies, energies[1:])):
        now = (b > a) - (b < a)
        if now and now != going:
            found.append(("min" if now > 0 else "saddle", i if going else 0, a))
            going = now
    end = len(energies) - 1
    return [*found, ("saddle" if going > 0 else "min", end, energies[end])] if going else [("min", 0, energies[0])]


def cancelled(points: list[tuple[str, int, float]], least: float) -> list[tuple[str, int, float]]:
    """Drop neighbours in pairs, the closest in energy first, until none is closer than ``least``.

    The lowest minimum (the first of equal ones) is never dropped, and two points always stay. Gaps wait in a
    heap, and points know their neighbours, so a drop costs the logarithm of the path's length.
    """
    n = len(points)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    keep = min((p[2], i) for i, p in enumerate(points) if p[0] == "min")[1] if any(p[0] == "min" for p in points) else -1
    stays, left = [True] * n, n
    gap = lambda i, j: (abs(points[j][2] - points[i][2]), i, j)
    waiting = [gap(i, i + 1) for i in range(n - 1) if keep not in (i, i + 1)]
    heapq.heapify(waiting)
    while left > 2 and waiting:
        size, i, j = heapq.heappop(waiting)
        if size >= least:
            break
        if not (stays[i] and stays[j] and after[i] == j):
            continue
        stays[i] = stays[j] = False
        left -= 2
        low, high = before[i], after[j]
        if low >= 0:
            after[low] = high
        if high < n:
            before[high] = low
            if low >= 0 and keep not in (low, high):
                heapq.heappush(waiting, gap(low, high))
    return [p for p, stay in zip(points, stays, strict=True) if stay]


def analyze_path_profile(path_energies, min_persistence: float = 0.0) -> PathProfile:
    energies = [float(e) for e in path_energies]
    if not energies:
        raise ValueError("path_energies is empty")
    if any(math.isnan(e) for e in energies):
        raise ValueError("path_energies has NaN")
    points = cancelled(turning_points(energies), min_persistence)
    pick = lambda kind: [(i, e) for k, i, e in points if k == kind]
    return PathProfile(pick("min"), pick("saddle"))


def settled(e: list[float], wall: list[bool], least: float, open_left: bool, open_right: bool) -> tuple[list[bool], list[bool], list[bool], list[bool]]:
    """What can be said of the points of one part of a path: which stay, which are still open, and walls after them.

    ``wall[i]``: the gap behind point i is never closed, since it is ``least`` or more, or has the point that is never dropped
    beside it, or has points between that are settled. A gap that is smaller than those beside it is closed
    sooner or later, whatever happens elsewhere, since other closings only widen its neighbours. So
    gaps are closed in order, but for those at an open end and those with a smaller one beside them that waits.
    """
    n = len(e)
    before, after, stays, wall = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n, list(wall)
    waits = [False] * n
    gap = lambda i, j: (abs(e[j] - e[i]), i, j)
    heap = [gap(i, i + 1) for i in range(n - 1) if not wall[i] and abs(e[i + 1] - e[i]) < least]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        if not (stays[i] and stays[j] and after[i] == j) or wall[i]:
            continue
        low, high = before[i], after[j]
        if (open_left if low < 0 else waits[low]) or (open_right if high >= n else waits[j]):
            waits[i] = True
            continue
        stays[i] = stays[j] = False
        if low >= 0:
            after[low], wall[low] = high, wall[low] or wall[j]
        if high < n:
            before[high] = low
            if low >= 0 and not wall[low] and abs(e[high] - e[low]) < least:
                heapq.heappush(heap, gap(low, high))
    left = [i for i in range(n) if stays[i]]
    pending = [False] * n
    if left and open_left:
        for i in left:
            pending[i] = True
            if not waits[i]:
                wall[i] = wall[i] or i != left[-1]
                break
    if left and open_right:
        pending[left[-1]] = True
        for i, j in zip(left[-2::-1], left[:0:-1]):
            if not waits[i]:
                break
            pending[i] = True
    return stays, pending, wall, waits


#: Steps of a path whose points are settled together at first.
WIDTH = 1 << 16


def pruned_profiles(path: DataFrame, min_persistence: float) -> DataFrame:
    """``(path_id, kind, path_index, e)`` after cancellation, as ``cancelled`` has it.

    Paths are settled in parts of ``WIDTH`` steps. What hangs on points beyond a part's ends stays open, and
    two parts' open points make a part of the next round, until a part is the whole path. So a path of any length is no more than one group
    of its open points, which lie at the ends of parts.
    """
    points, kept = profile_extrema(path), Kept()
    kind = path.schema["path_id"].dataType.simpleString()
    lowest = F.min(F.when(F.col("kind") == "min", F.struct("e", "path_index")))
    told = points.groupBy("path_id").agg(lowest["path_index"].alias("keep"), F.expr(f"min(path_index) div {WIDTH}").alias("first"), F.expr(f"max(path_index) div {WIDTH}").alias("last"))
    now = points.join(told, "path_id").withColumns({"part": F.expr(f"path_index div {WIDTH}"), "wall": F.lit(False), "open": F.lit(True)})
    schema = f"path_id {kind}, kind string, path_index long, e double, keep long, first long, last long, part long, wall boolean, open boolean"

    def one(pdf):
        pdf = pdf.sort_values("path_index")
        first, last, part, keep = (pdf[c].iloc[0] for c in ("first", "last", "part", "keep"))
        index, e = pdf["path_index"].tolist(), pdf["e"].tolist()
        wall = [w or keep in (i, j) for w, i, j in zip(pdf["wall"], index, [*index[1:], None])]
        stays, pending, wall, _ = settled(e, wall, min_persistence, part > first, part < last)
        pdf = pdf.assign(wall=wall, open=pending)[stays]
        return pdf.assign(first=pdf["first"] // 2, last=pdf["last"] // 2, part=pdf["part"] // 2)

    ship(path.sparkSession)
    done = []
    names = [x.split()[0] for x in schema.split(", ")]
    while True:
        table = kept(now.select(*names).groupBy("path_id", "part").applyInPandas(one, schema))
        done.append(table.where("not open").select("path_id", "kind", "path_index", "e"))
        now = table.where("open")
        if not now.limit(1).count():
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out
