import random

import pytest

from corrie.operators import profile

CASES = [
    ([0, 2, 1, 3, -1], 0.0, [(0, 0), (2, 1), (4, -1)], [(1, 2), (3, 3)]),
    ([0, 2, 1, 3, -1], 1.5, [(0, 0), (4, -1)], [(3, 3)]),
    ([1, 1, 1], 0.0, [(0, 1)], []),
    ([5], 0.0, [(0, 5)], []),
    ([0, 1, 2, 3], 0.0, [(0, 0)], [(3, 3)]),
]


@pytest.mark.parametrize("energies, least, minima, saddles", CASES)
def test_known_profiles(energies, least, minima, saddles):
    found = profile.analyze_path_profile(energies, least)
    assert found == profile.PathProfile([(i, float(e)) for i, e in minima], [(i, float(e)) for i, e in saddles])


def test_plateau_and_lowest_minimum():
    assert profile.analyze_path_profile([0, 2, 2, 1, 3]).saddles[0] == (2, 2.0)
    assert profile.analyze_path_profile([0, 0.2, -5, 0.1, 0.05], 10).minima == [(2, -5.0)]
    for bad in ([], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            profile.analyze_path_profile(bad)


def plain(points, least):
    """Cancellation from its definition, looking at all gaps each time."""
    points = list(points)
    lowest = min((p for p in points if p[0] == "min"), key=lambda p: (p[2], p[1]), default=None)
    while len(points) > 2:
        pairs = [(abs(a[2] - b[2]), i) for i, (a, b) in enumerate(zip(points, points[1:])) if lowest not in (a, b)]
        if not pairs or min(pairs)[0] >= least:
            return points
        at = min(pairs)[1]
        points = points[:at] + points[at + 2 :]
    return points


def test_cancellation_equals_its_definition():
    rng = random.Random(1)
    for _ in range(400):
        points = profile.turning_points([float(rng.randint(0, 6)) for _ in range(rng.randint(1, 40))])
        for least in (0.5, 1.5, 3.5, 10.0):
            assert profile.cancelled(points, least) == plain(points, least)


def test_tables_equal_the_driver(spark):
    rng = random.Random(0)
    made = {k: [float(rng.randint(0, 4)) for _ in range(rng.randint(1, 12))] for k in range(60)} | {100 + i: list(map(float, c[0])) for i, c in enumerate(CASES)}
    table = spark.createDataFrame([(k, i, e) for k, v in made.items() for i, e in enumerate(v)], "path_id long, step long, e double")
    for least, found in ((0.0, profile.profile_extrema(table)), (1.5, profile.pruned_profiles(table, 1.5))):
        rows = sorted(map(tuple, found.select("path_id", "path_index", "kind", "e").collect()))
        want = sorted((k, i, kind, e) for k, v in made.items() for kind, i, e in profile.cancelled(profile.turning_points(v), least))
        assert rows == want


def in_parts(energies, least, width):
    """The same path settled part by part, as ``pruned_profiles`` does."""
    points = profile.turning_points(energies)
    keep = min((e, i) for k, i, e in points if k == "min")[1]
    first, last = points[0][1] // width, points[-1][1] // width
    open_, out = [[*p, p[1] // width, False] for p in points], []
    while open_:
        onward = []
        for part in sorted({p[3] for p in open_}):
            own = [p for p in open_ if p[3] == part]
            index = [p[1] for p in own]
            wall = [p[4] or keep in (i, j) for p, i, j in zip(own, index, [*index[1:], None])]
            stays, pending, wall, _ = profile.settled([p[2] for p in own], wall, least, part > first, part < last)
            for p, stay, more, w in zip(own, stays, pending, wall):
                if stay and more:
                    onward.append([*p[:3], part // 2, w])
                elif stay:
                    out.append(tuple(p[:3]))
        open_, first, last = onward, first // 2, last // 2
    return sorted(out, key=lambda p: p[1])


def test_parts_of_any_width_give_the_whole():
    rng = random.Random(1)
    for _ in range(3000):
        high = rng.choice([3, 8, 50, 1000])
        energies = [float(rng.randrange(high)) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.2:
            energies = [x * (1 if k % 2 else -1) * k for k, x in enumerate(energies)]
        least = rng.choice([0, 1, 2, high / 4, high / 2, high, 2 * high])
        assert in_parts(energies, least, rng.choice([1, 2, 3, 5, 8, 100])) == profile.cancelled(profile.turning_points(energies), least)


def test_long_paths_in_parts(spark, monkeypatch):
    monkeypatch.setattr(profile, "WIDTH", 16)
    rng = random.Random(2)
    paths = {name: [float(rng.randrange(30)) for _ in range(n)] for name, n in (("a", 300), ("b", 1), ("c", 33), ("d", 16))}
    rows = [(name, i, e) for name, energies in paths.items() for i, e in enumerate(energies)]
    found = profile.pruned_profiles(spark.createDataFrame(rows, "path_id string, step long, e double"), 12.0).collect()
    for name, energies in paths.items():
        got = sorted(((r.kind, r.path_index, r.e) for r in found if r.path_id == name), key=lambda p: p[1])
        assert got == profile.cancelled(profile.turning_points(energies), 12.0)
