"""Near-duplicate vectors by NN-descent.

Equal vectors are merged first. A neighbour graph starts from random projections: vectors are sorted by the
signs of random planes, and each is compared with those beside it. Then it is refined: every vector is a
meeting place where its neighbours and those that have it as a neighbour are compared with one another, and
each keeps its ``WIDTH`` best. Rounds go on until few lists change or ``ROUNDS`` have run. A list whose worst
entry still reaches the threshold is saturated: it is enlarged to its whole connected group, whose members
are compared block by block, so that crowds of close vectors lose no link. Recall is audited for a set of
vectors against all others, and if it is short of ``TARGET``, more projections and rounds are added; if it
still is after ``TRIES``, all vectors are compared block by block.

Meeting places with many members are split into parts of bounded size, so no task holds an unbounded group.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrie.llm.common import Stored, components

THRESHOLD = 0.95
#: Entries of a list, projections, rounds, and vectors compared together.
WIDTH, TREES, ROUNDS, PART = 8, 8, 4, 64
PLANES, BLOCK = 32, 512
#: The audit: vectors that are checked against all, the recall to reach, and tries.
AUDIT, TARGET, TRIES = 256, 0.995, 3


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; all of one batch part have the same length."""
    rows = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()) if len(column) else column.values
    x = rows.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def runs(batches, keys: list[str], most: int | None):
    """Rows in runs of equal keys, as record batches; runs are cut at ``most`` rows."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if last is not None and tuple(values[a]) != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            last = tuple(values[a])
            while most and size + b - a >= most:
                held.append(batch.slice(a, most - size))
                a += most - size
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                last = last if a < b else None
                if a == b:
                    break
            if a < b:
                held.append(batch.slice(a, b - a))
                size += b - a
                last = tuple(values[b - 1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def best(nodes: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector, its best ``width`` others: source, target, cosine."""
    near = x @ x.T
    np.fill_diagonal(near, -2)
    k = min(width, len(x) - 1)
    at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(x), 0), int)
    source = np.repeat(np.arange(len(x)), k)
    return nodes[source], nodes[at.ravel()], near[source, at.ravel()]


EDGES = "source long, target long, cosine double"


def edges(source, target, cosine) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(target, pa.int64()), pa.array(cosine, pa.float64())], ["source", "target", "cosine"])


def compared(dealt: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Best pairs within each run of equal keys (rows ``node``, ``vec``; sorted by the keys already)."""

    def run(batches):
        for part in runs(batches, keys, PART):
            if part.num_rows > 1:
                yield edges(*best(part.column(part.schema.get_field_index("node")).to_numpy(), matrix(part.column(part.schema.get_field_index("vec"))), width))

    return dealt.mapInArrow(run, EDGES)


def projected(nodes: DataFrame, first: int, trees: int, width: int) -> DataFrame:
    """Pairs of vectors that stand side by side in one of the orders by random planes."""

    def run(batches):
        for batch in batches:
            for part in runs([batch], ["dim"], None):
                x = matrix(part.column(part.schema.get_field_index("vec")))
                for tree in range(first, first + trees):
                    planes = np.random.default_rng(tree).standard_normal((x.shape[1], PLANES))
                    code = (x @ planes > 0) @ (1 << np.arange(PLANES, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree)), part.column(0), pa.array(code), part.column(1), part.column(2)], ["tree", "dim", "code", "node", "vec"])

    kind = nodes.schema["vec"].dataType.simpleString()
    coded = nodes.select("dim", "node", "vec").mapInArrow(run, f"tree long, dim long, code long, node long, vec {kind}")
    order = ["tree", "dim", "code", "node"]
    return compared(coded.repartitionByRange(*order).sortWithinPartitions(*order), ["tree", "dim"], width)


def merged(found: DataFrame, width: int) -> DataFrame:
    """The best ``width`` different targets of each source."""
    once = found.groupBy("source", "target").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("cosine"), "target"))
    return once.withColumn("place", place).where(F.col("place") <= width)


def refined(graph: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Pairs among the neighbours, either way, of each vector."""
    one = graph.select(F.col("source").alias("place"), F.col("target").alias("node"))
    other = graph.select(F.col("target").alias("place"), F.col("source").alias("node"))
    met = one.unionByName(other).distinct().join(nodes.select("node", "vec"), "node")
    return compared(met.repartition("place").sortWithinPartitions("place", F.xxhash64("node", "place")).select("place", "node", "vec"), ["place"], width)


def counted(nodes: DataFrame, links: DataFrame, crowded: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(node, linked)``: copies of other vectors linked with each, and links that connect the same groups.

    ``links`` holds both directions. Groups with a saturated list (``crowded``: node, group) are compared
    whole, block against block; the rest are counted from their lists.
    """
    sizes = crowded.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = crowded.join(sizes, "group").join(nodes.select("node", "vec", "mult"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("group", F.col("own").alias("i"), other.alias("j"), F.lit(0).alias("side"), "node", "vec", "mult")
    right = placed.select("group", other.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node", "vec", "mult")

    def run(batches):
        for part in runs(batches, ["group", "i", "j"], None):
            get = lambda n: part.column(part.schema.get_field_index(n)).to_numpy()  # noqa: B023, E731
            side, node, mult, x = get("side"), get("node"), get("mult"), matrix(part.column(part.schema.get_field_index("vec")))
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(a) and len(b):
                linked = (x[a] @ x[b].T >= threshold) & (node[a][:, None] != node[b][None, :])
                some = linked.any(1)
                most, label, before = np.iinfo(np.int64).max, node[a], None
                while before is None or (label != before).any():
                    before = label
                    other = np.minimum(node[b], np.where(linked, label[:, None], most).min(0))
                    label = np.minimum(label, np.where(linked, other, most).min(1))
                yield pa.RecordBatch.from_arrays([pa.array(node[a][some]), pa.array((linked @ mult[b])[some]), pa.array(label[some])], ["node", "linked", "label"])

    dealt = left.unionByName(right).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side")
    whole = Stored(dealt.mapInArrow(run, "node long, linked long, label long"), "crowds").df
    loose = links.join(crowded.select(F.col("node").alias("source")), "source", "left_anti").join(nodes.select(F.col("node").alias("target"), "mult"), "target")
    totals = whole.select("node", "linked").unionByName(loose.select(F.col("source").alias("node"), F.col("mult").alias("linked"))).groupBy("node").agg(F.sum("linked").alias("linked"))
    more = whole.select(F.col("node").alias("source"), F.col("label").alias("target"))
    return totals, links.select("source", "target").unionByName(more)


def audited(nodes: DataFrame, totals: DataFrame, threshold: float) -> float:
    """Share of true links found, by comparing at most ``AUDIT`` vectors (smallest hashes) with all.

    Shares are averaged over vectors that have links, apart for those with more than ``WIDTH`` links; the
    lower average counts, so crowds cannot hide what small groups miss.
    """
    asked = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(AUDIT).select("dim", "node", "vec").collect()
    by_dim = {d: ([r.node for r in asked if r.dim == d], np.array([r.vec for r in asked if r.dim == d], float)) for d in {r.dim for r in asked}}
    by_dim = {d: (np.array(n), x / np.linalg.norm(x, axis=1, keepdims=True)) for d, (n, x) in by_dim.items()}

    def run(batches):
        for batch in batches:
            for part in runs([batch], ["dim"], None):
                d = part.column(0)[0].as_py()
                if d in by_dim:
                    names, asked_x = by_dim[d]
                    node, mult = part.column(1).to_numpy(), part.column(3).to_numpy()
                    linked = (asked_x @ matrix(part.column(2)).T >= threshold) & (names[:, None] != node[None, :])
                    n = linked @ mult
                    yield pa.RecordBatch.from_arrays([pa.array(names[n > 0]), pa.array(n[n > 0])], ["node", "true"])

    true = nodes.select("dim", "node", "vec", "mult").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    share = F.least(F.coalesce("linked", F.lit(0)) / F.col("true"), F.lit(1.0))
    rows = true.join(totals, "node", "left").groupBy((F.col("true") > WIDTH).alias("crowd")).agg(F.avg(share).alias("share")).collect()
    return min((r.share for r in rows), default=1.0)


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row per input row: the id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other rows whose vectors have cosine of ``threshold`` or more, in double
    precision; ``component_id`` is the smallest id reachable by links. Vectors that are null, empty or zero
    or hold null or non-finite components link with nothing and are their own component, and vectors of
    different lengths do not link. Rows of equal vectors link with one another; repeated ids count for each
    row; other columns are not carried.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("vec"), sound.alias("sound"))
    distinct = rows.where("sound").groupBy("vec").agg(F.count("*").alias("mult"), F.min("id").alias("least"))
    nodes = Stored(distinct.select(F.size("vec").cast("long").alias("dim"), F.monotonically_increasing_id().alias("node"), "vec", "mult", "least"), "vectors").df

    graph = None
    for attempt in range(TRIES):
        found = projected(nodes, attempt * TREES, TREES, width)
        after = Stored(merged(found if graph is None else found.unionByName(graph.df.select("source", "target", "cosine")), width), "graph")
        for _ in range(ROUNDS):
            before = after
            after = Stored(merged(refined(before.df, nodes, width).unionByName(before.df.select("source", "target", "cosine")), width), "graph")
            fresh = after.df.join(before.df.select("source", "target"), ["source", "target"], "left_anti").count()
            total = after.df.count()
            before.drop()
            if fresh <= 0.01 * total:
                break
        if graph is not None:
            graph.drop()
        graph = after
        close = graph.df.where(F.col("cosine") >= threshold)
        pairs = close.select("source", "target")
        links = Stored(pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "near").df
        full = close.where(F.col("place") == width).select(F.col("source").alias("node"))
        groups = Stored(components(links, "source", "target"), "groups").df
        crowded = groups.join(groups.join(full, "node").select("component").distinct(), "component").select("node", F.col("component").alias("group"))
        totals, connecting = counted(nodes, links, Stored(crowded, "crowded").df, threshold)
        totals = Stored(totals, "totals").df
        if audited(nodes, totals, threshold) >= TARGET:
            break
    else:
        totals, connecting = counted(nodes, links, nodes.select("node", F.col("dim").alias("group")), threshold)
        totals = Stored(totals, "totals").df
    reached = components(connecting, "source", "target")
    named = nodes.join(reached, "node", "left").join(totals, "node", "left").select("vec", "least", (F.coalesce("linked", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = Stored(named, "named").df
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(smallest, "component").select("vec", "n_links", "component_id")
    linked = rows.where("sound").join(answer, "vec").select("id", "n_links", "component_id")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
