"""Grids, extrema and the error contract."""

from itertools import product

import numpy as np
import pytest

from corrie.functions.index import applied, offsets, step_code
from corrie.meta import GridMeta, check_points
from corrie.operators import extrema
from corrie.sources.dense import from_array, from_rows, to_array


def test_build_dense(spark):
    grid, axes = from_rows(spark, {"y": [1.0, 0.0, 1.0, 1.0], "x": [5, 5, 7, 7]}, [1.0, 2.0, 3.0, 99.0])
    assert grid.meta.names == ("y", "x") and grid.meta.shape == (2, 2)
    assert np.array_equal(to_array(grid), [[2.0, np.nan], [1.0, 99.0]], equal_nan=True)
    assert [r.value for r in axes["x"].orderBy("pos").collect()] == [5, 7]
    one, _ = from_rows(spark, {"a": [3, 1, 2], "b": [0, 0, 0]}, np.array([1, 2, 3]))
    assert one.meta.shape == (3, 1) and one.dtype == "float64" and to_array(one).ravel().tolist() == [2.0, 3.0, 1.0]
    single, _ = from_rows(spark, {"a": [1, 0]}, np.array([1.5, 2.5], np.float32))
    assert single.dtype == "float32" and single.meta.shape == (2,)
    with pytest.raises(ValueError, match="at least one axis"):
        from_rows(spark, {}, [1.0])
    with pytest.raises(ValueError, match="length 3.*length 2"):
        from_rows(spark, {"a": [1, 2, 3]}, [1.0, 2.0])


def plain(values, r, kind):
    found = []
    for index in np.ndindex(values.shape):
        box = values[tuple(slice(max(0, i - r), i + r + 1) for i in index)]
        e = values[index]
        others = int((~np.isnan(box)).sum()) - 1
        if not np.isnan(e) and others > 0 and not (box < e if kind == "min" else box > e).any():
            found.append((index, float(e)))
    return sorted(found, key=lambda x: (x[1] if kind == "min" else -x[1], x[0]))


def strip(*cells, shape=(5, 5), fill=5.0):
    out = np.full(shape, fill)
    for index, e in cells:
        out[index] = e
    return out


def seeded(shape, holes, seed):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 6, shape).astype(float)
    out[rng.random(shape) < holes] = np.nan
    return out


CASES = {
    "bowl": strip(((1, 1), 0.0), shape=(3, 3), fill=1.0),
    "peak": strip(((1, 1), 1.0), shape=(3, 3), fill=0.0),
    "diagonal": np.array([[0, 10, 10], [10, 5, 10], [10, 10, 10.0]]),
    "ties": strip(((1, 1), 0.0), ((1, 2), 0.0), shape=(3, 4), fill=1.0),
    "isolated": strip(((1, 1), 0.0), shape=(3, 3), fill=np.nan),
    "far": strip(((2, 2), 3.0), ((4, 4), 1.0)),
    "cull": strip(((2, 2), 3.0), ((4, 4), 1.0), ((0, 0), 2.0)),
    "strip": strip(((1, 1), 3.0), ((1, 3), 1.0), *(((i, 2), np.nan) for i in (1, 2, 3))),
    "rim": np.array([[1, 2, 1], [2, 0, 2], [1, 2, 1.0]]),
    "holes": seeded((6, 5, 4), 0.4, 1),
}


@pytest.mark.parametrize("name", CASES)
def test_extrema_equal_a_plain_scan(spark, name):
    values = CASES[name]
    grid = from_array(spark, values)
    low, high = extrema.find_extrema_grid(grid)
    assert low == plain(values, 1, "min") and high == plain(values, 1, "max")
    if name in ("cull", "strip", "holes"):
        assert extrema.find_minima_grid(grid, confirm_range=2) == plain(values, 2, "min") == extrema.find_minima_grid(grid, neighborhood_range=2)
        assert extrema.find_maxima_grid(grid, neighborhood_range=1, confirm_range=3) == plain(values, 3, "max")


def test_float32(spark):
    bowl = np.array([[(i - 2) ** 2 + (j - 2) ** 2 for j in range(5)] for i in range(5)], np.float32)
    assert extrema.find_minima_grid(from_array(spark, bowl)) == [((2, 2), 0.0)]


def test_errors(spark):
    grid = from_array(spark, np.zeros((2, 2)))
    for ranges, error, text in (
        ({"neighborhood_range": 0}, ValueError, r"neighborhood_range must be in \[1, 5\]"),
        ({"neighborhood_range": 6}, ValueError, r"\[1, 5\]"),
        ({"neighborhood_range": -1}, OverflowError, "negative"),
        ({"neighborhood_range": 2, "confirm_range": 1}, ValueError, r"confirm_range \(1\) must be >= neighborhood_range \(2\)"),
    ):
        with pytest.raises(error, match=text):
            extrema.find_minima_grid(grid, **ranges)
    with pytest.raises(TypeError):
        extrema.find_minima_grid(grid, 2)
    for shape in ((4,), (1,) * 8):
        with pytest.raises(ValueError, match=r"ndim must be in \[2, 7\]"):
            extrema.find_minima_grid(from_array(spark, np.zeros(shape)))
    with pytest.raises(ValueError, match="float32 or float64"):
        from_array(spark, np.zeros((2, 2), int))
    with pytest.raises(ValueError, match="C-contiguous"):
        from_array(spark, np.zeros((2, 3)).T)
    grid.check_complete()
    grid.cells = grid.cells.where("lin > 0")
    with pytest.raises(ValueError, match="C-contiguous"):
        grid.check_complete()
    meta = GridMeta(("a", "b"), (2, 3))
    assert check_points(meta, start=(1, 2)) == [5]
    for point, error, text in (((1,), ValueError, "length"), ((-1, 0), IndexError, "negative"), ((2, 0), IndexError, "bounds")):
        with pytest.raises(error, match=text):
            check_points(meta, start=point)


@pytest.mark.parametrize("n", range(2, 8))
def test_stencils(n):
    meta = GridMeta(tuple("abcdefg"[:n]), (3,) * n)
    box, axes = offsets(meta, "moore"), offsets(meta, "von_neumann")
    assert len(box) == 3**n - 1 and len(axes) == 2 * n
    assert [s for _, _, s in box] == [s for s in product((-1, 0, 1), repeat=n) if any(s)]
    assert all(step_code(c, n) == s for _, c, s in box + axes)
    assert [p for p, _, _ in axes] == list(range(2 * n))
    assert applied(meta, (0,) * n, axes[0][1]) is None and applied(meta, (0,) * n, axes[1][1]) == (1, *(0,) * (n - 1))
    assert meta.index(meta.linear((2,) * n)) == (2,) * n
