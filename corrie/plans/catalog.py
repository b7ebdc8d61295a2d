"""Named queries over the test tables, and the same in SQL.

Grids are taken from ``lineitem``: the energy of a cell is the least extended price, which is exact in any
order of evaluation. The SQL is written from the definitions, not from the plans: extrema by comparing all
cells of a box, merges and labels by bottleneck keys between all pairs of basins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrie.functions.index import offsets
from corrie.meta import Grid, GridMeta
from corrie.operators import extrema, flood, paths, profile, tree
from corrie.sources.dense import axis_values, build_dense, read_masked

G2 = ["l_quantity", "l_discount"]
G3 = ["l_quantity", "l_discount", "l_tax"]
G5 = ["l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
#: Axis lengths, the same at every scale; the SQL needs them for strides and codes.
SHAPES = {2: (50, 11), 3: (50, 11, 9), 5: (7, 11, 9, 3, 2), "parts": (0, 50)}
#: ``parts`` grows with the scale: its first axis has as many values as there are parts.
AXES = {2: G2, 3: G3, 5: G5, "parts": ["l_partkey", "l_quantity"]}
VALID = "l_returnflag = 'R' and l_linestatus = 'F'"
START, END, THRESHOLD = (0, 0), (49, 10), 5.0
#: A cell on the same side of the wall of `walled` as START.
NEAR = (20, 9)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def priced(spark: SparkSession, sf_dir: str, axes: list[str], where: str = "true") -> Grid:
    rows = lineitem(spark, sf_dir)
    least = rows.where(where).groupBy(*axes).agg(F.min("l_extendedprice").alias("e"))
    return build_dense(least, axes, "e", domain=rows)[0]


def grid(n: int | str) -> Callable[[SparkSession, str], Grid]:
    return lambda spark, sf_dir: priced(spark, sf_dir, AXES[n])


def masked(spark: SparkSession, sf_dir: str) -> Grid:
    return priced(spark, sf_dir, G3, VALID)


def walled(spark: SparkSession, sf_dir: str) -> Grid:
    """G2 without the rows of one quantity: a wall between its two sides."""
    return priced(spark, sf_dir, G2, "l_quantity <> 25")


ODD = "(l_quantity % 2 = 1 and cast(round(l_discount * 100) as int) % 2 = 1 and l_quantity < 48 or l_quantity = 50)"


def mostly_isolated(spark: SparkSession, sf_dir: str) -> Grid:
    """G2 with every second cell along each axis, which have no neighbour, and one full row."""
    return priced(spark, sf_dir, G2, ODD)


def dup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = build_dense(lineitem(spark, sf_dir), ["l_linenumber", "l_discount"], "l_quantity", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"])
    return g.cells.select("lin", "i0", "i1", "e")


def shed(spark: SparkSession, sf_dir: str, name: str = "von_neumann") -> flood.Watershed:
    return flood.Watershed(grid(2)(spark, sf_dir), name)


def saddle(spark: SparkSession, sf_dir: str, name: str, make=grid(2), end=None) -> DataFrame:
    g = make(spark, sf_dir)
    found = paths.find_iwf_grid(g, START, end or END, name)
    return spark.createDataFrame([] if found is None else [(g.meta.linear(found[0]), found[1])], "lin long, e double")


def walled_saddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a pair of cells across the wall, which has no saddle, and of one on this side."""
    return saddle(spark, sf_dir, "von_neumann", walled).unionByName(saddle(spark, sf_dir, "von_neumann", walled, NEAR))


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.path_table(shed(spark, sf_dir), START, END)


def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = path(spark, sf_dir).withColumn("before", F.lag(F.struct("i0", "i1")).over(Window.orderBy("step")))
    far = F.coalesce(F.abs(F.col("i0") - F.col("before.i0")) + F.abs(F.col("i1") - F.col("before.i1")), F.lit(1)) != 1
    return p.agg(F.max("e").alias("top"), F.min_by("lin", "step").alias("first_lin"), F.max_by("lin", "step").alias("last_lin"), F.sum(far.cast("long")).alias("jumps"))


def order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier, its line prices by order, line and price: a path of energies."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    return lineitem(spark, sf_dir).select(F.col("l_suppkey").alias("path_id"), (F.row_number().over(order) - 1).cast("long").alias("step"), F.col("l_extendedprice").alias("e"))


def named_points(spark: SparkSession) -> DataFrame:
    meta = GridMeta(tuple(G2), SHAPES[2])
    return spark.createDataFrame([(i, meta.linear(p)) for i, p in enumerate(POINTS)], "ordinal long, lin long")


POINTS = [(3, 3), (0, 0), (49, 10), (25, 5), (3, 4), (10, 2), (10, 3), (40, 9)]


def bfs_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_bfs(shed(spark, sf_dir).merges, 0)


def tree_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the last basin and the one in the middle."""
    w = shed(spark, sf_dir)
    ends = w.basins.agg(F.max("basin_id").alias("a")).select(F.lit(0).alias("pair_id"), "a", F.expr("cast(a div 2 as int)").alias("b"))
    return tree.tree_paths(w.merges, ends).drop("pair_id")


def tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every basin the way to the one with half its number."""
    w = shed(spark, sf_dir)
    return tree.tree_paths(w.merges, w.basins.select(F.col("basin_id").alias("pair_id"), F.col("basin_id").alias("a"), F.expr("cast(basin_id div 2 as int)").alias("b")))


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = shed(spark, sf_dir)
    return tree.merge_forest(w.basins, w.merges)


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state with wrong labels, parents and merges and a merge told twice: these are found and nothing else is."""
    w = shed(spark, sf_dir)
    label = F.when(F.col("lin") % 7 == 0, F.lit(1_000_000)).otherwise(F.col("label"))
    parent = F.when((F.col("parent") != flood.NO_PARENT) & (F.col("lin") % 11 == 0), F.lit(40_000)).otherwise(F.col("parent"))
    bad = w.merges.withColumn("deeper", F.when(F.col("merge_id") % 5 == 0, F.col("shallower")).otherwise(F.col("deeper")))
    return flood.flood_violations(w.grid, w.labels_table.withColumns({"label": label, "parent": parent}), w.basins, bad.unionByName(bad.where("merge_id = 2")))


def found(make, kinds: tuple[str, ...], **ranges) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: extrema.extrema(make(spark, sf_dir), kinds, **ranges)


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, start, end)``: of each order the cells of its first two lines."""
    rows = lineitem(spark, sf_dir)
    for k, a in enumerate(G2):
        rows = rows.join(axis_values(rows, a).select(F.col("value").alias(a), F.col("pos").alias(f"i{k}")), a)
    ends = rows.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("pair_id")).agg(*(F.max(F.when(F.col("l_linenumber") == n, F.col("i0").cast("long") * SHAPES[2][1] + F.col("i1"))).alias(c) for n, c in ((1, "start"), (2, "end"))))
    return ends.where("start is not null and end is not null")


def merges_of(name: str):
    return lambda s, d: shed(s, d, name).merges


def with_tree(f):
    return lambda s, d: (lambda w: f(w.basins.drop("nz"), w.merges))(shed(s, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "build_dense": lambda s, d: grid(3)(s, d).cells.select("lin", "i0", "i1", "i2", "e"),
    "build_dense_dups": dup_rows,
    "grid_axes": lambda s, d: axis_values(lineitem(s, d), "l_quantity"),
    "grid_fingerprint_sample": lambda s, d: flood.fingerprint_sample(grid(3)(s, d)),
    "masked_grid": lambda s, d: read_masked(s, f"{d}/lineitem.parquet", G3, "l_extendedprice", VALID)[0].cells.select("lin", "e"),
    "minima_r1": found(grid(3), ("min",)),
    "minima_r2": found(grid(3), ("min",), neighborhood_range=2),
    "maxima_r1": found(grid(3), ("max",)),
    "extrema_r1": found(masked, ("min", "max")),
    "extrema_5d": found(grid(5), ("min", "max")),
    "minima_confirm_r2": found(masked, ("min",), confirm_range=2),
    "extrema_isolated": found(mostly_isolated, ("min", "max")),
    "flood_order": lambda s, d: flood.flood_order(masked(s, d)),
    **{f"flood_parents_{n}": (lambda m: lambda s, d: flood.Watershed(masked(s, d), m).parents_table)(m) for n, m in (("vn", "von_neumann"), ("moore", "moore"))},
    **{f"watershed_basins_{n}": (lambda m: lambda s, d: flood.Watershed(masked(s, d), m).basins.drop("nz"))(m) for n, m in (("vn", "von_neumann"), ("moore", "moore"))},
    "flood_leaf": lambda s, d: flood.Watershed(masked(s, d), "moore").leaf,
    **{f"watershed_merges_{n}": merges_of(m) for n, m in (("vn", "von_neumann"), ("moore", "moore"))},
    **{f"watershed_labels_{n}": (lambda m: lambda s, d: shed(s, d, m).labels_table)(m) for n, m in (("vn", "von_neumann"), ("moore", "moore"))},
    "watershed_labels_walled": lambda s, d: flood.Watershed(walled(s, d)).labels_table,
    "merge_forest": forest,
    "flood_state_violations": violations,
    "iwf_saddle_vn": lambda s, d: saddle(s, d, "von_neumann"),
    "iwf_saddle_moore": lambda s, d: saddle(s, d, "moore"),
    "iwf_disconnected": walled_saddles,
    "saddle_pairs": lambda s, d: paths.saddles(shed(s, d), order_pairs(s, d)),
    "minima_parts": found(grid("parts"), ("min",)),
    "minima_parts_r3": found(grid("parts"), ("min",), neighborhood_range=3),
    "flood_parents_parts": lambda s, d: flood.Watershed(grid("parts")(s, d), "moore").parents_table,
    "flood_leaf_parts": lambda s, d: flood.Watershed(grid("parts")(s, d), "moore").leaf,
    "mep_path": path,
    "mep_summary": path_summary,
    "persistence": with_tree(tree.persistence),
    "prune_basins": with_tree(lambda b, m: tree.prune(b, m, THRESHOLD)[0]),
    "prune_merges": with_tree(lambda b, m: tree.prune(b, m, THRESHOLD)[1]),
    "merge_tree_nodes": with_tree(lambda b, m: tree.tree_nodes(b, m).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))),
    "tree_neighbors": with_tree(lambda b, m: tree.tree_edges(m)),
    "tree_path": tree_path,
    "tree_pairs": tree_pairs,
    "tree_bfs": bfs_rows,
    "basin_of_point": lambda s, d: shed(s, d).labels.join(named_points(s), "lin"),
    "basins_containing": lambda s, d: tree.basins_containing(shed(s, d).labels, named_points(s)).withColumn("points", F.array_join(F.col("points").cast("array<string>"), ",")),
    "basin_mask": lambda s, d: tree.basin_mask(shed(s, d).labels, 0),
    "touches_edge": lambda s, d: tree.touching(shed(s, d), 0, "both"),
    "profile_extrema": lambda s, d: profile.profile_extrema(order_profiles(s, d)),
    "profile_pruned": lambda s, d: profile.pruned_profiles(order_profiles(s, d), 20000.0),
}


# SQL ---------------------------------------------------------------------------------------------------


def sql_cells(n: int | str, where: str = "true", value: str = "min(l_extendedprice)") -> str:
    """CTEs ``x0`` ..., ``cells(lin, i0.., e)``."""
    axes, meta = AXES[n], GridMeta(tuple(AXES[n]), SHAPES[n])
    dims = ", ".join(f"x{k} as (select v, cast(row_number() over (order by v) - 1 as int) as i from (select distinct {a} as v from lineitem))" for k, a in enumerate(axes))
    lin = " + ".join(f"cast(x{k}.i as bigint) * {s}" for k, s in enumerate(meta.strides))
    keys = ", ".join(axes)
    on = " and ".join(f"p.{a} = x{k}.v" for k, a in enumerate(axes))
    index = ", ".join(f"x{k}.i as i{k}" for k in range(len(axes)))
    cross = ", ".join(f"x{k}" for k in range(len(axes)))
    return f"{dims}, priced as (select {keys}, {value} as p from lineitem where {where} group by {keys}), cells as (select {lin} as lin, {index}, p.p as e from {cross} left join priced p on {on})"


def sql_extrema(n: int, kinds: tuple[str, ...], r: int, where: str = "true") -> str:
    near = " and ".join(f"o.i{k} between c.i{k} - {r} and c.i{k} + {r}" for k in range(n))
    index = ", ".join(f"i{k}" for k in range(n))
    parts = [f"select '{k}' as kind, lin, {index}, cast(e as double) as e from near where e = {k}e" for k in kinds]
    box = f"select c.lin, {', '.join(f'c.i{k}' for k in range(n))}, c.e, min(o.e) as mine, max(o.e) as maxe, count(o.e) as n from cells c join cells o on {near} where c.e is not null group by all"
    return f"with {sql_cells(n, where)}, near as (select * from ({box}) where n > 1) {' union all '.join(parts)}"


def sql_flood(n: int | str, name: str, where: str = "true") -> str:
    """CTEs ``v, lower, parents, basins``."""
    meta = GridMeta(tuple(AXES[n]), SHAPES[n])
    axes = range(meta.ndim)
    steps = ", ".join(f"({p}, {c}, {', '.join(map(str, s))})" for p, c, s in offsets(meta, name))
    moved = " and ".join(f"o.i{k} = c.i{k} + s.d{k}" for k in axes)
    return (
        f"{sql_cells(n, where)}, steps(pos, code, {', '.join(f'd{k}' for k in axes)}) as (values {steps}), v as (select * from cells where e is not null), "
        f"lower as (select c.lin, c.e, s.pos, s.code, o.lin as n from v c, steps s join v o on {moved} where o.e < c.e or (o.e = c.e and o.lin < c.lin)), "
        "parents as (select lin, arg_min(n, pos) as parent, cast(arg_min(code, pos) as int) as code from lower group by lin), "
        "basins as (select cast(row_number() over (order by e, lin) - 1 as int) as basin_id, lin, e from v where lin not in (select lin from parents)), "
        "leafs as (select lin, basin_id as leaf from basins union all select p.lin, l.leaf from leafs l join parents p on p.parent = l.lin)"
    )


def sql_merges(name: str, where: str = "true") -> str:
    """CTEs up to ``merges`` over G2: basin b ends at the least bottleneck towards an older one."""
    return (
        f"with recursive {sql_flood(2, name, where)}, "
        "pairs as (select l.e, l.lin, l.pos, l.n, a.leaf as la, b.leaf as lb from lower l join leafs a on a.lin = l.lin join leafs b on b.lin = l.n where a.leaf <> b.leaf), "
        "first as (select row_number() over (order by e, lin, pos) as k, * from (select arg_min((e, lin, pos, n, la, lb), (e, lin, pos)) as s from pairs group by least(la, lb), greatest(la, lb)) t, lateral (select s[1] as e, s[2] as lin, s[3] as pos, s[4] as n, s[5] as la, s[6] as lb)), "
        "edge as (select la as x, lb as y, k from first union all select lb, la, k from first), "
        "bott(x, y, k) using key (x, y) as (select x, y, k from edge union select b.x, g.y, min(greatest(b.k, g.k)) from bott b join edge g on g.x = b.y left join recurring.bott o on o.x = b.x and o.y = g.y where b.x <> g.y and (o.k is null or greatest(b.k, g.k) < o.k) group by b.x, g.y), "
        "ends as (select x as b, min(k) as k from bott where y < x group by x), "
        "joined as (select d.b, d.k, f.lin, f.n, f.e, f.la, (select min(y) from bott where x = d.b and bott.k <= d.k) as deeper, least(f.la, coalesce((select min(y) from bott where x = f.la and bott.k < d.k), f.la)) as side from ends d join first f on f.k = d.k), "
        "merges as (select cast(row_number() over (order by k) - 1 as int) as merge_id, lin as saddle, n as other, cast(e as double) as e, cast(deeper as int) as deeper, cast(b as int) as shallower, cast(side as int) as saddle_side from joined), "
        "labels as (select c.lin, cast(coalesce(least(l.leaf, coalesce((select min(o.y) from bott o join first f on f.k = o.k where o.x = l.leaf and (f.e < c.e or (f.e = c.e and f.lin < c.lin))), l.leaf)), -1) as int) as label, coalesce(p.code, 65535) as parent from cells c left join leafs l on l.lin = c.lin left join parents p on p.lin = c.lin)"
    )


def sql_saddle(name: str, where: str = "true", end=None) -> str:
    meta = GridMeta(tuple(G2), SHAPES[2])
    a, b = meta.linear(START), meta.linear(end or END)
    return (
        f"{sql_merges(name, where)}, ends2 as (select a.leaf as la, b.leaf as lb from leafs a, leafs b where a.lin = {a} and b.lin = {b}), "
        "pass as (select f.lin, f.e from ends2 t join bott o on o.x = t.la and o.y = t.lb join first f on f.k = o.k), "
        f"tops as (select lin, e from v where lin in ({a}, {b}) union all select lin, e from pass) "
        "select lin, cast(e as double) as e from tops where exists (select 1 from ends2 where la = lb or exists (select 1 from pass)) order by e desc, lin desc limit 1"
    )


def sql_minima_passes(n: int | str, r: int) -> str:
    """The same minima by windows, axis by axis, where comparing all cells of a box would take long."""
    axes = range(len(AXES[n]))
    steps, last = [], "cells"
    for k in axes:
        others = ", ".join(f"i{j}" for j in axes if j != k)
        window = f"over (partition by {others} order by i{k} range between {r} preceding and {r} following)"
        low, many = ("e", "e") if k == 0 else ("low", "many")
        steps.append(f"s{k} as (select lin, {', '.join(f'i{j}' for j in axes)}, e, min({low}) {window} as low, {'count' if k == 0 else 'sum'}({many}) {window} as many from {last})")
        last = f"s{k}"
    return f"with {sql_cells(n)}, {', '.join(steps)} select 'min' as kind, lin, {', '.join(f'i{j}' for j in axes)}, cast(e as double) as e from {last} where e = low and many > 1"


def sql_pairs(name: str) -> str:
    lin = f"(select (row_number() over (order by v) - 1) * {SHAPES[2][1]} as i, v from (select distinct l_quantity as v from lineitem))"
    low = "(select row_number() over (order by v) - 1 as i, v from (select distinct l_discount as v from lineitem))"
    return (
        f"{sql_merges(name)}, spot as (select l_orderkey as pair_id, l_linenumber as nr, max(q.i + d.i) as lin from lineitem l join {lin} q on q.v = l_quantity join {low} d on d.v = l_discount where l_linenumber <= 2 group by all), "
        "two as (select pair_id, max(lin) filter (where nr = 1) as a, max(lin) filter (where nr = 2) as b from spot group by pair_id having count(*) = 2), "
        "ways as (select t.pair_id, t.a, t.b, x.leaf as la, y.leaf as lb, o.k from two t join leafs x on x.lin = t.a join leafs y on y.lin = t.b left join bott o on o.x = x.leaf and o.y = y.leaf), "
        "tops as (select pair_id, unnest([a, b]) as lin from ways where la = lb or k is not null union all select w.pair_id, f.lin from ways w join first f on f.k = w.k where w.la <> w.lb) "
        "select pair_id, arg_max(t.lin, (v.e, t.lin)) as lin, cast(max(v.e) as double) as e from tops t join v on v.lin = t.lin group by pair_id"
    )


def sql_path(name: str, start=START, end=END) -> str:
    """The path: pieces between two cells are cut at the first edge that joins their leaves, until both are in one leaf."""
    meta = GridMeta(tuple(G2), SHAPES[2])
    return (
        f"{sql_merges(name)}, pieces(ord, x, lx, y, ly) as (select '', a.lin, a.leaf, b.lin, b.leaf from leafs a, leafs b where a.lin = {meta.linear(start)} and b.lin = {meta.linear(end)} "
        "union all select p.ord || s.bit, case when s.bit = '0' then p.x when h.here then f.n else f.lin end, case when s.bit = '0' then p.lx when h.here then f.lb else f.la end, "
        "case when s.bit = '1' then p.y when h.here then f.lin else f.n end, case when s.bit = '1' then p.ly when h.here then f.la else f.lb end "
        "from pieces p join bott o on o.x = p.lx and o.y = p.ly join first f on f.k = o.k left join bott q on q.x = p.lx and q.y = f.la and q.k < o.k, lateral (select p.lx = f.la or q.x is not null as here) h, (values ('0'), ('1')) s(bit) where p.lx <> p.ly), "
        "legs as (select row_number() over (order by ord) as leg, x, y from pieces where lx = ly), tips as (select x as c from legs union select y from legs), "
        "chain(c, cell, d) as (select c, c, 0 from tips union all select h.c, p.parent, h.d + 1 from chain h join parents p on p.lin = h.cell), "
        "deep as (select c, max(d) as m from chain group by c), "
        "based as (select l.leg, l.x, l.y, a.m as dx, b.m as dy, coalesce(sum(a.m + b.m + 1) over (order by l.leg rows between unbounded preceding and 1 preceding), 0) as base from legs l join deep a on a.c = l.x join deep b on b.c = l.y), "
        "walked as (select base + h.d as step, h.cell as lin from based join chain h on h.c = x union all select base + dx + dy - h.d, h.cell from based join chain h on h.c = y and h.d < dy) "
        "select step::bigint as step, w.lin, c.i0, c.i1, cast(c.e as double) as e from walked w join cells c on c.lin = w.lin"
    )


M, MM, MW = sql_merges("von_neumann"), sql_merges("moore"), sql_merges("von_neumann", "l_quantity <> 25")
LIVES = "died as (select b.basin_id, b.lin, b.e, m.deeper, m.saddle, m.e as se, coalesce(m.e - b.e, cast('inf' as double)) as p from basins b left join merges m on m.shallower = b.basin_id)"
MASKED = {n: f"with recursive {sql_flood(3, m, VALID)}" for n, m in (("vn", "von_neumann"), ("moore", "moore"))}
POINT_ROWS = ", ".join(f"({i}, {GridMeta(tuple(G2), SHAPES[2]).linear(p)})" for i, p in enumerate(POINTS))
TURNS = (
    "with p as materialized (select l_suppkey as path_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_extendedprice) - 1 as step, l_extendedprice as e from lineitem), "
    "q as materialized (select *, sign(lead(e) over (partition by path_id order by step) - e) as g, max(step) over (partition by path_id) as last, first_value(e) over (partition by path_id order by step) as e0, max_by(e, step) over (partition by path_id) as e9 from p), "
    "m as materialized (select *, lag(g) over w as b, lead(g) over w as a from q where g <> 0 window w as (partition by path_id order by step)) "
    "select path_id, case when g < 0 then 'saddle' else 'min' end as kind, step as path_index, e from m where b <> g "
    "union all select path_id, case when g < 0 then 'saddle' else 'min' end, 0, e0 from m where b is null "
    "union all select path_id, case when g > 0 then 'saddle' else 'min' end, last, e9 from m where a is null "
    "union all select path_id, 'min', 0, any_value(e0) from q group by path_id having coalesce(max(abs(g)), 0) = 0"
)

#: The least gap between neighbouring points other than the one that always stays, and where it is.
GAP = "list_sort(list_transform(list_filter(range(1, len(pts)), lambda p: pts[p].i is distinct from keep and pts[p + 1].i is distinct from keep), lambda p: struct_pack(size := abs(pts[p + 1].e - pts[p].e), p := p)))[1]"

ORACLES: dict[str, str] = {
    "build_dense": f"with {sql_cells(3)} select * from cells",
    "build_dense_dups": "with x0 as (select v, cast(row_number() over (order by v) - 1 as int) as i0 from (select distinct l_linenumber as v from lineitem)), x1 as (select v, cast(row_number() over (order by v) - 1 as int) as i1 from (select distinct l_discount as v from lineitem)), "
    "p as (select l_linenumber, l_discount, arg_max(l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) as e from lineitem group by all) select cast(i0 as bigint) * 11 + i1 as lin, i0, i1, e from x0 cross join x1 left join p on p.l_linenumber = x0.v and p.l_discount = x1.v",
    "grid_axes": "select cast(row_number() over (order by v) - 1 as int) as pos, v as value from (select distinct l_quantity as v from lineitem)",
    "grid_fingerprint_sample": f"with {sql_cells(3)} select lin, e from cells",
    "masked_grid": f"with {sql_cells(3, VALID, 'max(l_extendedprice)')} select lin, e from cells",
    "minima_r1": sql_extrema(3, ("min",), 1),
    "minima_r2": sql_extrema(3, ("min",), 2),
    "maxima_r1": sql_extrema(3, ("max",), 1),
    "extrema_r1": sql_extrema(3, ("min", "max"), 1, VALID),
    "extrema_5d": sql_extrema(5, ("min", "max"), 1),
    "minima_confirm_r2": sql_extrema(3, ("min",), 2, VALID),
    "extrema_isolated": sql_extrema(2, ("min", "max"), 1, ODD),
    "flood_order": f"with {sql_cells(3, VALID)} select row_number() over (order by e, lin) - 1 as rank, lin from cells where e is not null",
    **{f"flood_parents_{n}": f"{q} select * from parents" for n, q in MASKED.items()},
    **{f"watershed_basins_{n}": f"{q} select * from basins" for n, q in MASKED.items()},
    "flood_leaf": f"{MASKED['moore']} select lin, leaf from leafs",
    "watershed_merges_vn": f"{M} select * from merges",
    "watershed_merges_moore": f"{MM} select * from merges",
    "watershed_labels_vn": f"{M} select * from labels",
    "watershed_labels_moore": f"{MM} select * from labels",
    "watershed_labels_walled": f"{MW} select * from labels",
    "merge_forest": f"{M}, nb as (select count(*) as n from basins), used as (select m.merge_id, unnest([deeper, shallower]) as b from merges m), last as (select u.merge_id, u.b, max(q.merge_id) as before from used u left join merges q on q.deeper = u.b and q.merge_id < u.merge_id group by 1, 2) select coalesce(before + n, b) as node, merge_id + n as parent from last, nb",
    "flood_state_violations": f"{M} select 'label' as rule, lin as id from labels where lin % 7 = 0 union all select 'parent', lin from labels where parent <> 65535 and lin % 11 = 0 "
    "union all select 'merge', merge_id from merges where merge_id % 5 = 0 union all select 'twice', shallower from merges where merge_id = 2",
    "iwf_saddle_vn": sql_saddle("von_neumann"),
    "iwf_saddle_moore": sql_saddle("moore"),
    "iwf_disconnected": f"select * from ({sql_saddle('von_neumann', 'l_quantity <> 25')}) union all select * from ({sql_saddle('von_neumann', 'l_quantity <> 25', NEAR)})",
    "saddle_pairs": sql_pairs("von_neumann"),
    "minima_parts": sql_minima_passes("parts", 1),
    "minima_parts_r3": sql_minima_passes("parts", 3),
    "flood_parents_parts": f"with recursive {sql_flood('parts', 'moore')} select * from parents",
    "flood_leaf_parts": f"with recursive {sql_flood('parts', 'moore')} select lin, leaf from leafs",
    "mep_path": sql_path("von_neumann"),
    "mep_summary": f"select e as top, {GridMeta(tuple(G2), SHAPES[2]).linear(START)}::bigint as first_lin, {GridMeta(tuple(G2), SHAPES[2]).linear(END)}::bigint as last_lin, 0::bigint as jumps from ({sql_saddle('von_neumann')})",
    "persistence": f"{M}, {LIVES} select basin_id, p as persistence from died",
    "prune_basins": f"{M}, {LIVES} select basin_id, lin, e from died where p >= {THRESHOLD}",
    "prune_merges": f"{M}, {LIVES} select m.* from merges m join died d on d.basin_id = m.shallower where d.p >= {THRESHOLD}",
    "merge_tree_nodes": f"{M}, {LIVES}, kids as (select deeper, string_agg(shallower::varchar, ',' order by merge_id) as children from merges group by deeper) select d.basin_id, d.lin, d.e, d.deeper as parent, d.saddle, d.se as saddle_e, d.p as persistence, coalesce(k.children, '') as children from died d left join kids k on k.deeper = d.basin_id",
    "tree_neighbors": f"{M} select deeper as basin_id, merge_id as ordinal, shallower as neighbor from merges union all select shallower, 2147483647, deeper from merges",
    "tree_path": f"{M}, ends3 as (select max(basin_id) as a, max(basin_id) // 2 as b from basins), up(side, basin_id, d) as (select 0, a, 0 from ends3 union all select 1, b, 0 from ends3 union all select u.side, m.deeper, u.d + 1 from up u join merges m on m.shallower = u.basin_id), "
    "turn as (select min(x.d) as da, min(y.d) as db from up x join up y on x.basin_id = y.basin_id where x.side = 0 and y.side = 1) select cast(case when side = 0 then d else da + db - d end as bigint) as ordinal, basin_id::int as basin_id from up, turn where (side = 0 and d <= da) or (side = 1 and d < db)",
    "tree_pairs": f"{M}, up(start, basin, d) as (select basin_id, basin_id, 0 from basins union all select u.start, m.deeper, u.d + 1 from up u join merges m on m.shallower = u.basin), "
    "turn as (select x.start as pair_id, min(x.d) as da, min(y.d) as db from up x join up y on y.start = x.start // 2 and y.basin = x.basin group by 1) "
    "select t.pair_id::int as pair_id, x.d::bigint as ordinal, x.basin::int as basin_id from turn t join up x on x.start = t.pair_id and x.d <= t.da union all select t.pair_id::int, (t.da + t.db - y.d)::bigint, y.basin::int from turn t join up y on y.start = t.pair_id // 2 and y.d < t.db",
    "basin_of_point": f"{M}, pt(ordinal, lin) as (values {POINT_ROWS}) select l.lin, l.label, pt.ordinal::bigint as ordinal from labels l join pt on pt.lin = l.lin",
    "basins_containing": f"{M}, pt(ordinal, lin) as (values {POINT_ROWS}) select l.label as basin_id, string_agg(pt.lin::varchar, ',' order by pt.ordinal) as points from labels l join pt on pt.lin = l.lin where l.label >= 0 group by 1",
    "basin_mask": f"{M} select lin, label = 0 as inside from labels",
    "touches_edge": f"{M} select distinct l.label as basin_id from labels l join cells c on c.lin = l.lin where c.i0 in (0, 49) and l.label >= 0",
    "tree_bfs": f"{M}, nb as (select deeper as b, merge_id as o, shallower as n from merges union all select shallower, 2147483647, deeper from merges), "
    "walk(b, came, depth, way) as (select 0, -1, 0, cast([] as int[]) union all select nb.n, w.b, w.depth + 1, list_append(w.way, nb.o) from walk w join nb on nb.b = w.b where nb.n <> w.came) "
    "select row_number() over (order by depth, way) - 1 as ordinal, b as basin_id, depth from walk",
    "profile_extrema": TURNS,
    "profile_pruned": f"with recursive turns as ({TURNS}), lists as (select path_id, list(struct_pack(i := path_index, kind := kind, e := e) order by path_index) as pts from turns group by path_id), "
    "kept as (select path_id, pts, list_sort(list_transform(list_filter(pts, lambda x: x.kind = 'min'), lambda x: struct_pack(e := x.e, i := x.i)))[1].i as keep from lists), "
    f"walk(path_id, pts, keep, gap) as (select path_id, pts, keep, {GAP} from kept union all select path_id, cut, keep, {GAP.replace('pts', 'cut')} from (select path_id, keep, list_concat(pts[1:gap.p - 1], pts[gap.p + 2:]) as cut from walk where gap.size < 20000 and len(pts) > 2)) "
    "select path_id, kind, i as path_index, e from (select path_id, unnest(pts, recursive := true) from walk where not coalesce(gap.size < 20000 and len(pts) > 2, false))",
}
