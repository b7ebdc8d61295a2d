"""Watershed, saddles, paths and the merge tree: against a sequential model and hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrie.operators import flood, paths, tree
from corrie.operators.flood import Watershed, find_watershed_segmentation
from corrie.sources.dense import from_array
from tests.model import Flood, minimax, neighbours

CHAIN = np.array([[0, 3, 5, 4, 1, 3, 6, 4, 2.0]])
RIDGE = np.full((5, 5), 10.0)
RIDGE[:2, :2] = [[0, 1], [1, 2]]
RIDGE[2] = [3, 3, 4, 3, 3]
RIDGE[3:, 3:] = [[2, 1], [1, 0]]
DIAGONAL = np.array([[0, 9, 9], [9, 1, 9], [9, 9, 0.0]])


def seeded(shape, holes, seed, levels=5):
    rng = np.random.default_rng(seed)
    out = rng.integers(-1, levels, shape).astype(float) * rng.choice([1.0, -1.0, -0.0], shape)
    out[rng.random(shape) < holes] = np.nan
    return out


GRIDS = {"chain": CHAIN, "ridge": RIDGE, "diagonal": DIAGONAL, "plateau": np.ones((2, 3)), "masked": np.full((3, 3), np.nan), "seeded": seeded((6, 7), 0.2, 1), "cube": seeded((3, 4, 3), 0.1, 2)}


@pytest.mark.parametrize("name", GRIDS)
@pytest.mark.parametrize("stencil", ["von_neumann", "moore"])
def test_flood_equals_the_sequential_model(spark, name, stencil):
    values = GRIDS[name]
    model, shed = Flood(values, stencil), Watershed(from_array(spark, values), stencil)
    assert [(r.lin, r.e) for r in shed.basins.orderBy("basin_id").collect()] == model.basins
    assert [(m.saddle, m.other, m.e, m.deeper, m.shallower, m.saddle_side) for m in shed.merge_list] == model.merges
    rows = shed.labels_table.orderBy("lin").collect()
    assert [r.label for r in rows] == model.label and [r.parent for r in rows] == model.parent
    assert flood.flood_violations(shed.grid, shed.labels_table, shed.basins, shed.merges).count() == 0


def test_published_example(spark):
    (m,) = Watershed(from_array(spark, RIDGE)).merge_list
    assert (m.saddle, m.other, m.deeper, m.shallower, m.saddle_side) == (12, 13, 0, 1, 0)


def test_many_edges_are_thinned_first(spark, monkeypatch):
    values = seeded((7, 7), 0.1, 4, 30)
    whole = Watershed(from_array(spark, values)).merge_list
    monkeypatch.setattr(flood, "DRIVER_EDGES", 0)
    assert Watershed(from_array(spark, values)).merge_list == whole


@pytest.mark.parametrize("stencil", ["von_neumann", "moore"])
def test_saddles_and_paths(spark, stencil):
    values = seeded((6, 6), 0.15, 7, 9)
    grid = from_array(spark, values)
    shed = find_watershed_segmentation(grid, stencil, parents=True)
    valid = [tuple(i) for i in np.argwhere(~np.isnan(values))]
    for start, end in ((valid[0], valid[-1]), (valid[3], valid[9]), (valid[5], valid[5])):
        want = minimax(values, stencil, shed.grid.meta.linear(start), shed.grid.meta.linear(end))
        found = paths.find_iwf_grid(grid, start, end, stencil, tree=shed)
        walk = paths.find_minimum_energy_path(grid, start, end, tree=shed)
        if want is None:
            assert found is None and walk is None
            continue
        index, e = walk
        assert found[1] == want == max(e) and (index[0], index[-1]) == (start, end)
        for a, b in zip(index, index[1:]):
            assert shed.grid.meta.linear(b) in [n for _, _, n in neighbours(shed.grid.meta, shed.grid.meta.linear(a), stencil)]


def test_paths_of_known_grids(spark):
    chain = from_array(spark, CHAIN)
    assert paths.find_minimum_energy_path(chain, (0, 0), (0, 8))[0] == [(0, i) for i in range(9)]
    assert paths.find_iwf_grid(from_array(spark, RIDGE), (0, 0), (4, 4)) == ((2, 2), 4.0)
    assert paths.find_minimum_energy_path(from_array(spark, DIAGONAL), (0, 0), (2, 2), "moore")[0] == [(0, 0), (1, 1), (2, 2)]
    wall = np.ones((3, 5))
    wall[:, 2] = np.nan
    assert paths.find_iwf_grid(from_array(spark, wall), (0, 0), (0, 4)) is None
    assert paths.find_minimum_energy_path(from_array(spark, wall), (0, 0), (0, 4)) is None
    with pytest.raises(ValueError, match="end"):
        paths.find_iwf_grid(from_array(spark, wall), (0, 0), (0, 2))
    with pytest.raises(ValueError, match="neighborhood"):
        paths.find_iwf_grid(from_array(spark, wall), (0, 0), (0, 1), "Moore")


def test_tree(spark):
    shed = find_watershed_segmentation(from_array(spark, np.array([[0, 3, 8, 4, 1, 3, 5, 4, 2.0]])), parents=True)
    t = tree.MergeTree(shed)
    assert t.root == 0 and t.node(0).children == (1,) and t.node(2).saddle_to_parent == ((0, 6), 5.0)
    assert t.persistence(1) == 7 and t.persistence(0) == math.inf
    assert t.path(1, 2) == [1, 2] and t.path(0, 2) == [0, 1, 2] and t.neighbors(1) == [2, 0]
    assert list(t.bfs(0)) == [(0, 0), (1, 1), (2, 2)] and list(t.bfs(0, advance=lambda a, b: b != 2)) == [(0, 0), (1, 1)]
    assert t.basin_of_point((0, 4)) == 1 and t.basin_of_point((0, -1)) == 2
    assert t.basins_containing([(0, 8), (0, 0), (0, 1)]) == {2: [(0, 8)], 0: [(0, 0), (0, 1)]}
    assert t.basin_mask(1).where("inside").count() == sum(r.label == 1 for r in shed.labels.collect())
    assert t.touches_edge(2, 1) and not t.touches_edge(0, 1) and t.touches_edge(0, 1, "both")
    with pytest.raises(ValueError, match="side must be"):
        t.touches_edge(0, 1, "left")
    kept, merges = tree.prune(shed.basins, shed.merges, 4.0)
    assert sorted(r.basin_id for r in kept.collect()) == [0, 1] and [r.shallower for r in merges.collect()] == [1]
    t.drop_labels()
    assert not t.has_labels and t.path(0, 2) == [0, 1, 2]
    with pytest.raises(RuntimeError, match="labels were dropped"):
        t.basin_of_point((0, 0))


def test_walks_in_tables_equal_those_of_the_driver(spark):
    shed = Watershed(from_array(spark, seeded((7, 8), 0.1, 6, 20)))
    t = tree.MergeTree(shed)
    last = max(t.nodes)
    pairs = [(k, k, (k * 5 + 3) % (last + 1)) for k in range(last + 1)]
    found = tree.tree_paths(shed.merges, spark.createDataFrame(pairs, "pair_id int, a int, b int")).collect()
    for k, a, b in pairs:
        got = [r.basin_id for r in sorted((r for r in found if r.pair_id == k), key=lambda r: r.ordinal)]
        try:
            assert got == t.path(a, b)
        except KeyError:
            assert got == []
    walk = lambda rows: [(r.basin_id, r.depth) for r in sorted(rows.collect(), key=lambda r: r.ordinal)]
    assert walk(tree.tree_bfs(shed.merges, 0)) == list(t.bfs(0))
    assert walk(tree.tree_bfs(shed.merges, 1, F.col("neighbor") % 3 != 2)) == list(t.bfs(1, advance=lambda a, b: b % 3 != 2))


def test_tree_does_not_need_sorted_merges(spark):
    basins = spark.createDataFrame([(0, 0, 0.0), (1, 1, 1.0), (2, 2, 2.0)], "basin_id int, lin long, e double")
    merges = spark.createDataFrame([(0, 5, 6, 5.0, 0, 1, 0), (1, 7, 8, 4.0, 1, 2, 1)], "merge_id int, saddle long, other long, e double, deeper int, shallower int, saddle_side int")
    assert {r.basin_id: r.persistence for r in tree.persistence(basins, merges).collect()} == {0: math.inf, 1: 4.0, 2: 2.0}


def test_tree_of_two_components(spark):
    wall = np.ones((3, 5))
    wall[:, 2] = np.nan
    t = tree.MergeTree(Watershed(from_array(spark, wall)))
    assert [t.persistence(b) for b in t.nodes] == [math.inf] * 2
    with pytest.raises(KeyError):
        t.path(0, 1)


def test_tree_guards(spark):
    grid = from_array(spark, RIDGE)
    shed = find_watershed_segmentation(grid, parents=True)
    walk = lambda g, t, name=None: paths.find_minimum_energy_path(g, (0, 0), (4, 4), name, tree=t)
    assert walk(grid, shed) == walk(from_array(spark, RIDGE), shed) == paths.find_minimum_energy_path(grid, (0, 0), (4, 4))
    with pytest.raises(ValueError, match="parents=True"):
        walk(grid, find_watershed_segmentation(grid))
    with pytest.raises(ValueError, match="different energy grid"):
        walk(from_array(spark, RIDGE + 1), shed)
    with pytest.raises(ValueError, match="shape"):
        paths.find_minimum_energy_path(from_array(spark, CHAIN), (0, 0), (0, 1), tree=shed)
    with pytest.raises(ValueError, match="neighborhood"):
        walk(grid, shed, "moore")
    shed.drop_labels()
    with pytest.raises(ValueError, match="dropped"):
        walk(grid, shed)


def test_corrupt_states_are_reported(spark):
    shed = Watershed(from_array(spark, RIDGE))
    labels = [(r.lin, r.label, r.parent) for r in shed.labels_table.collect()]
    bad = [(lin, 9 if lin == 3 else label, 1 if lin == 0 else 4 if lin == 6 else parent) for lin, label, parent in labels]
    merges = [(0, 12, 13, 4.0, 1, 0, 5), (1, 99, 13, 4.0, 0, 1, 0), (2, 12, 13, 4.0, 0, 1, 0)]
    found = flood.flood_violations(shed.grid, spark.createDataFrame(bad, "lin long, label int, parent int"), shed.basins, spark.createDataFrame(merges, "merge_id int, saddle long, other long, e double, deeper int, shallower int, saddle_side int"))
    assert sorted((r.rule, r.id) for r in found.collect()) == [("label", 3), ("merge", 0), ("merge", 1), ("parent", 0), ("parent", 6), ("twice", 1)]
