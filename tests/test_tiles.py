"""Blocks: the same answers whatever their size, completeness, foreign states, long paths, array files."""

import time

import numpy as np
import pytest

from corrie.functions.index import NO_PARENT
from corrie.meta import Grid
from corrie.operators import extrema, flood, paths, state, tiles
from corrie.operators.flood import Climb, Merge, Watershed
from corrie.operators.tiles import Tiling
from corrie.sources.arrays import read_array, write_array
from corrie.sources.dense import from_array, to_array
from tests.model import Flood, minimax
from tests.test_flood import seeded
from tests.test_grid import plain


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 12)


def test_tilings_deal_every_cell_once():
    for shape in ((7, 6, 5), (1, 9), (4, 4), (3, 1, 2, 5)):
        tiling = Tiling.of(shape, 8)
        lins = np.concatenate([tiling.lin(t).ravel() for t in range(tiling.tiles)])
        assert sorted(lins) == list(range(int(np.prod(shape))))
        tile, local = tiling.locate(np.arange(lins.size))
        for t in range(tiling.tiles):
            full = np.full(tiling.sides, -1)
            full[tuple(slice(0, n) for n in tiling.extent(t))] = tiling.lin(t)
            assert (full.ravel()[local[tile == t]] == np.flatnonzero(tile == t)).all()


@pytest.mark.parametrize("ranges", [{}, {"confirm_range": 2}, {"neighborhood_range": 3}, {"neighborhood_range": 2, "confirm_range": 4}])
def test_extrema_of_small_blocks(spark, small, ranges):
    values = seeded((7, 6, 5), 0.5, 3)
    values[np.arange(7) % 2 == 0] = np.nan
    r, wide = ranges.get("neighborhood_range", 1), ranges.get("confirm_range", ranges.get("neighborhood_range", 1))
    low, high = extrema.find_extrema_grid(from_array(spark, values), **ranges)
    for kind, found in (("min", low), ("max", high)):
        both = set(plain(values, r, kind)) & {x for x in plain(values, wide, kind)}
        assert set(found) == both


def test_many_candidates_are_compared_at_once(spark, small):
    flat = np.zeros((9, 8))
    flat[4, 4] = np.nan
    assert extrema.find_minima_grid(from_array(spark, flat), neighborhood_range=2) == plain(flat, 2, "min")


@pytest.mark.parametrize("stencil", ["von_neumann", "moore"])
@pytest.mark.parametrize("shape", [(9, 8), (4, 5, 4)])
def test_floods_of_small_blocks(spark, small, monkeypatch, stencil, shape):
    values = seeded(shape, 0.1, 5, 9)
    model, shed = Flood(values, stencil), Watershed(from_array(spark, values), stencil)
    assert shed.tiling.tiles > 3
    assert [(r.lin, r.e) for r in shed.basins.orderBy("basin_id").collect()] == model.basins
    assert [(m.saddle, m.other, m.e, m.deeper, m.shallower, m.saddle_side) for m in shed.merge_list] == model.merges
    rows = shed.labels_table.orderBy("lin").collect()
    assert [r.label for r in rows] == model.label and [r.parent for r in rows] == model.parent
    assert sorted((r.lin, r.code) for r in shed.parents_table.collect()) == [(i, p) for i, p in enumerate(model.parent) if p != NO_PARENT]
    monkeypatch.setattr(flood, "CHAINS", 0)
    again = Watershed(shed.grid, stencil)
    assert [r.label for r in again.labels_table.orderBy("lin").collect()] == model.label


def test_chains_of_absorptions_take_a_logarithm_of_steps():
    n = 100_000
    merges = [Merge(k, k, float(k), n - 2 - k, n - 1 - k, 0, 0, 0, 1) for k in range(n - 1)]
    began = time.time()
    climb = Climb.of(n, merges)
    basin, at = np.array([n - 1, n - 1, n - 1, 5, 0]), np.array([0.5, 70_000.5, 1e9, 0.0, 9.0])
    key = tiles.order_key(at)
    assert climb.live(basin, key, np.full(5, 2**40)).tolist() == [n - 2, n - 1 - 70_001, 0, 5, 0]
    assert time.time() - began < 20


def test_long_descents(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 1 << 13)
    n = 100_000
    values = np.full((2, n), np.nan)
    values[0] = np.arange(n, 0, -1)
    began = time.time()
    index, e = paths.find_minimum_energy_path(from_array(spark, values), (0, 0), (0, n - 1))
    assert index == [(0, i) for i in range(n)] and e[0] == n
    assert time.time() - began < 150


def test_grids_with_holes_and_doubles_are_refused(spark):
    whole = from_array(spark, np.arange(12.0).reshape(3, 4))
    for cells in (whole.cells.where("lin <> 5"), whole.cells.union(whole.cells.where("lin = 5"))):
        grid = Grid(cells, whole.meta)
        for use in (lambda g: extrema.extrema(g, ("min",)), lambda g: Watershed(g).merge_list, lambda g: paths.find_iwf_grid(g, (0, 0), (2, 3)), lambda g: g.check_complete()):
            with pytest.raises(ValueError, match="C-contiguous"):
                use(grid)
    whole.check_complete()


def test_saddles_of_many_pairs(spark, small):
    values = seeded((6, 7), 0.15, 8, 9)
    grid = from_array(spark, values)
    cells = [i for i in range(values.size) if not np.isnan(values.ravel()[i])]
    pairs = [(k, cells[(7 * k) % len(cells)], cells[(11 * k + 3) % len(cells)]) for k in range(60)] + [(60, cells[0], cells[0])]
    found = {r.pair_id: r.e for r in paths.saddles(Watershed(grid), spark.createDataFrame(pairs, "pair_id int, start long, end long")).collect()}
    for k, a, b in pairs:
        assert found.get(k) == minimax(values, "von_neumann", a, b)


CHAIN = np.array([[0, 3, 5, 4, 1, 3, 6, 4, 2.0]])


def state_of(spark, values, **changes):
    shed = Watershed(from_array(spark, values))
    labels = [[r.lin, r.label] for r in shed.labels.orderBy("lin").collect()]
    codes = [[r.lin, r.parent] for r in shed.parents.orderBy("lin").collect()]
    merges = [[k, m.saddle, m.other, m.deeper, m.shallower, m.saddle_side] for k, m in enumerate(shed.merge_list)]
    for at, to in changes.get("label", {}).items():
        labels[at][1] = to
    for at, to in changes.get("code", {}).items():
        codes[at][1] = to
    for (k, column), to in changes.get("merge", {}).items():
        merges[k][column] = to
    frame = spark.createDataFrame
    tables = frame(labels, "lin long, label int"), frame(codes[: changes.get("cells", len(codes))], "lin long, parent int"), frame(merges, "merge_id int, saddle long, other long, deeper int, shallower int, saddle_side int")
    return shed.grid, *tables, shed.basins.count()


def test_states_from_elsewhere_give_the_same_path(spark):
    values = seeded((5, 6), 0.1, 9, 9)
    cells = [tuple(map(int, i)) for i in np.argwhere(~np.isnan(values))]
    grid, *tables = state_of(spark, values)
    assert state.reconstruct_mep(grid, *tables, cells[0], cells[-1]) == paths.find_minimum_energy_path(grid, cells[0], cells[-1])


@pytest.mark.parametrize(
    ("changes", "text"),
    [
        ({"label": {3: 99}}, "label 99 at cell 3 is out of range"),
        ({"merge": {(0, 3): 42}}, "basin id"),
        ({"merge": {(0, 5): 2}}, "saddle_side"),
        ({"merge": {(0, 1): 99}}, "outside the grid"),
        ({"merge": {(1, 3): 1, (1, 4): 0, (1, 5): 0}}, None),
        ({"merge": {(1, 4): 1, (1, 3): 0, (1, 5): 0}}, "inconsistent"),
        ({"code": {1: 500}}, "invalid direction code 500"),
        ({"code": {1: 1}}, "leaves the grid"),
        ({"code": {0: 5, 1: 3}}, "does not terminate"),
        ({"cells": 5}, "shape"),
    ],
)
def test_corrupt_states_are_refused(spark, changes, text):
    with pytest.raises(ValueError, match=text):
        state.reconstruct_mep(*state_of(spark, CHAIN, **changes), (0, 1), (0, 8))


def test_states_have_a_schema(spark):
    grid, labels, codes, merges, n = state_of(spark, CHAIN)
    with pytest.raises(ValueError, match="int32"):
        state.reconstruct_mep(grid, labels.selectExpr("lin", "cast(label as long) as label"), codes, merges, n, (0, 1), (0, 8))
    with pytest.raises(ValueError, match=r"\(M, 5\)"):
        state.reconstruct_mep(grid, labels, codes, merges.drop("other"), n, (0, 1), (0, 8))


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_array_files(spark, small, tmp_path, kind):
    values = seeded((7, 6, 5), 0.2, 4).astype(kind)
    np.save(tmp_path / "a.npy", values)
    np.savez(tmp_path / "b.npz", grid=values, start=np.array([0, 0, 0]))
    np.savez_compressed(tmp_path / "c.npz", grid=values)
    for name, member in (("a.npy", None), ("b.npz", "grid"), ("c.npz", None)):
        grid = read_array(spark, str(tmp_path / name), member)
        assert grid.meta.shape == values.shape and grid.dtype == np.dtype(kind).name
        assert np.array_equal(to_array(grid), values, equal_nan=True)
    write_array(grid, str(tmp_path / "d.npy"))
    assert np.array_equal(np.load(tmp_path / "d.npy"), values, equal_nan=True)
    np.save(tmp_path / "e.npy", np.zeros((2, 3), int))
    np.save(tmp_path / "f.npy", np.asfortranarray(values))
    for name, text in (("e.npy", "float32 or float64"), ("f.npy", "C-contiguous")):
        with pytest.raises(ValueError, match=text):
            read_array(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="grid, start"):
        read_array(spark, str(tmp_path / "b.npz"))


def test_fingerprints(spark, small, monkeypatch):
    values = seeded((7, 6), 0.2, 4)
    one = flood.energy_fingerprint(from_array(spark, values))
    assert one == flood.energy_fingerprint(from_array(spark, values)) and len(one) == 16
    assert one != flood.energy_fingerprint(from_array(spark, values.astype(np.float32)))
    monkeypatch.setattr(flood, "sample_step", lambda meta: 3)
    other = values.copy()
    other[0, 1], sampled = 77.0, flood.energy_fingerprint(from_array(spark, values))
    assert sampled == flood.energy_fingerprint(from_array(spark, other))
    other[0, 3] = 77.0
    assert sampled != flood.energy_fingerprint(from_array(spark, other))


def test_dropped_labels_leave_no_files(spark):
    import os

    shed = Watershed(from_array(spark, CHAIN))
    shed.labels_table.count()
    files = [f.removeprefix("file://") for t in shed.kept for f in t.inputFiles()]
    shed.drop_labels()
    assert files and not any(map(os.path.exists, files))
