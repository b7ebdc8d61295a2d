"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrie.store import shared_dir, ship

#: Texts handled together inside one Arrow batch. Long texts make a batch large, so it is small.
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 2 * ROWS) -> None:
    """Ship the library to Python workers, and keep Arrow batches to few rows: long texts make them large."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_arrow(df: DataFrame, columns: list[str], function, schema: str, rows: int = ROWS) -> DataFrame:
    """Apply ``function(RecordBatch) -> RecordBatch`` to the named columns, a few rows at a time.

    Rows are mapped in place: no shuffle, and a lost task is simply run again.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield function(batch.slice(start, rows))

    return df.select(*columns).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


class Stored:
    """A table written once to the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def add(self, df: DataFrame) -> None:
        """Write more rows of the same columns."""
        df.select(*self.schema.names).write.mode("append").option("compression", "zstd").parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Edges up to which the minima of all nodes are broadcast.
BROADCAST_EDGES = 200_000
#: Rows of a table up to which it is shuffled at once, and shares at most into which a larger one is dealt.
SHARE, SHARES = 8_000_000, 16
#: Rows of a step from which on its shuffle files are deleted at its end.
FREED = 500_000


def freed(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are over.

    It does so when the driver collects garbage: once for what Python held, once more for what that had held in the JVM.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def in_shares(df: DataFrame, rows: int, column: str, step, label: str, most: int = SHARE) -> Stored:
    """What ``step`` makes of the table, whose rows are dealt by a column; one share at a time, so that shuffle files of one share only are held.

    ``step`` must not need rows with different values of the column together.
    """
    shares, out = min(SHARES, max(1, -(-rows // most))), None
    for share in range(shares):
        # The seed keeps shares from following the hash by which shuffles deal rows.
        now = step(df if shares == 1 else df.where(F.pmod(F.xxhash64(F.lit(shares), column), F.lit(shares)) == share))
        if out is None:
            out = Stored(now, label)
        else:
            out.add(now)
        if rows > FREED:
            freed(df.sparkSession)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each step re-links every node to
    the smallest node it sees, and edges only ever move towards smaller nodes, so the list never grows
    beyond its first size. All steps are joins and partial minima; nothing is gathered by node or sent
    to the driver. Minima of heavy nodes, those with over a ten-thousandth of the list (so fewer than 20,000
    nodes, whatever its size), are broadcast, so no task gets such a node's edges; lists of up to ``BROADCAST_EDGES`` have
    all minima broadcast, which spares most shuffles. Each round is written to
    the shared folder and the previous one is deleted. No edges: no rows.
    """
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = Stored(first, "links")
    mark = None
    for _ in range(max_rounds):
        e = now.df
        count, digest = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (count, digest) == mark or not count:
            break
        mark = (count, digest)
        bound = max(1000, count // 10_000) if count > BROADCAST_EDGES else None
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, bound, "v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large, bound, "true")
        after = Stored(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "links")
        now.drop()
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    e = now.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_least(edges: DataFrame, bound: int | None, where: str) -> DataFrame:
    """The edges that meet the condition, with ``m``: the least ``v`` of all edges of their ``u``. Without a bound all minima are broadcast."""
    if bound is None:
        return edges.where(where).join(F.broadcast(edges.groupBy("u").agg(F.min("v").alias("m"))), "u")
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    heavy = F.broadcast(low.where(F.col("n") > bound).select("u", "m"))
    told = edges.where(where).join(heavy, "u", "left")
    light = told.where("m is null").drop("m").join(low.where(F.col("n") <= bound).select("u", "m"), "u")
    return told.where("m is not null").unionByName(light)


def met(entries: DataFrame, key: str = "key", node: str = "n", place: str | None = None) -> DataFrame:
    """``(key, n, first, members)``: entries whose key has several nodes, with the least node and how many there are.

    With a ``place`` of each entry, this and that of the least node as ``first_place``. Entries are shuffled once, for the counts and
    for the join with them.
    """
    entries = entries.repartition(key)
    least = [F.min_by(place, node).alias("first_place")] if place else []
    keys = entries.groupBy(key).agg(F.min(node).alias("first"), F.count("*").alias("members"), *least).where("members > 1")
    more = [F.col(place).alias("place"), "first_place"] if place else []
    return entries.join(keys, key).select(F.col(key).alias("key"), F.col(node).alias("n"), "first", "members", *more)


#: Members of a key that meet in one task when all pairs of its parts are formed.
PART = 512


def across(shared: DataFrame, fits) -> DataFrame:
    """``(a, b)``, a < b: all pairs under one key that are in different groups (column ``group``) and fit.

    Keys of more than ``PART`` members are split into parts of that size by hash; parts meet in pairs, each in a task's share of
    its own, so a key of any size is spread over tasks. ``fits(a, b)`` is evaluated inside the join.
    """
    own = [c for c in shared.columns if c not in ("key", "first", "first_place", "members")]
    parts = F.ceil(F.col("members") / PART).cast("int")
    part = F.pmod(F.xxhash64("n"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = shared.where(F.col("members") > PART).withColumn("parts", parts).withColumn("part", part).withColumn("other", other)
    left = placed.select("key", F.col("part").alias("i"), F.col("other").alias("j"), *own)
    right = placed.select("key", F.col("other").alias("i"), F.col("part").alias("j"), *own)
    small = shared.where(F.col("members") <= PART).select("key", *own)

    def paired(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        x, y = ({c: F.col(f"{side}.{c}") for c in own} for side in ("l", "r"))
        equal = reduce(lambda p, q: p & q, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on])
        return left.alias("l").join(right.alias("r"), equal & (x["n"] < y["n"]) & (x["group"] != y["group"]) & fits(x, y)).select(x["n"].alias("a"), y["n"].alias("b"))

    return paired(small, small, "key").unionByName(paired(left, right, "key", "i", "j")).distinct()


def joined_groups(shared: Stored, nodes: DataFrame | None, fits, verify, stars: int = 2, beside: DataFrame | None = None, near=None) -> DataFrame:
    """``(node, component)``: groups linked by all verified pairs of nodes that share a key; single nodes are left out.

    ``shared`` holds ``met`` entries with the columns of ``nodes``, each entry once, and is deleted in the end;
    ``nodes`` holds ``n`` and what ``fits(a, b)``, a cheap condition, needs. Without ``nodes``, ``fits(a, b)`` looks at the ``place`` of two
    entries of one key. ``near(a, b)`` is a dearer condition on columns of ``beside``, a table of all ``n``; it is asked share by share, so
    that pairs it turns down are never written. ``verify`` takes a table of pairs ``(a, b)`` and returns those that are
    links. First, each node meets one node of each of its keys, the least; in the next star round, one that
    is in another group by then. Those pairs grow with the entries only, and they join the crowds of copies.
    Then all other pairs under a key whose nodes are in different groups are verified; ``fits`` and ``near`` must not depend on the order of
    two nodes, as those of the least node are not formed again. Pairs inside a group are
    not, since a link would change nothing: the groups are those of all links, whatever the sizes. No pair is
    verified twice. Large tables are gone through in shares of keys or pairs.
    """
    known: list[Stored] = []
    groups: Stored | None = None
    rows = shared.df.count()

    def screened(pairs: DataFrame) -> DataFrame:
        if beside is None:
            return pairs
        for side in ("a", "b"):
            pairs = pairs.join(beside.select(F.col("n").alias(side), F.struct(*beside.columns).alias(f"of_{side}")), side)
        return pairs.where(near(F.col("of_a"), F.col("of_b"))).select("a", "b")

    def star(open_: DataFrame) -> DataFrame:
        if nodes is None:
            met_ = open_.where("n <> centre").where(fits({"place": F.col("place")}, {"place": F.col("centre_place")}))
            return screened(met_.select(F.least("n", "centre").alias("a"), F.greatest("n", "centre").alias("b")).distinct())
        wanted = open_.where("n <> centre").select(F.struct(*nodes.columns).alias("x"), "centre").distinct()
        side = nodes.select(F.struct(*nodes.columns).alias("y"), F.col("n").alias("centre"))
        return screened(wanted.join(side, "centre").where(fits(F.col("x"), F.col("y"))).select(F.least("x.n", "y.n").alias("a"), F.greatest("x.n", "y.n").alias("b")).distinct())

    def opened(share: DataFrame, last: bool) -> DataFrame:
        # All pairs of a key's least node were tried in the first round, which leaves none of a key of two.
        share = share.where("members > 2 and n <> first") if last else share
        named = share.drop("first", "first_place").join(groups.df.withColumnRenamed("node", "n"), "n", "left").withColumn("group", F.coalesce("component", "n")).drop("component")
        top = {} if last else {"centre": F.max_by("n", "group")} | ({"centre_place": F.max_by("place", "group")} if nodes is None else {})
        named = named.repartition("key")
        spread = named.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), *(c.alias(n) for n, c in top.items())).where("low <> high")
        return named.join(spread.select("key", *top), "key")

    for round_ in range(stars + 1):
        now, last = None, round_ == stars
        if groups is None:
            open_ = shared.df.withColumn("group", F.col("n")).withColumn("centre", F.col("first"))
            open_ = open_.withColumn("centre_place", F.col("first_place")) if nodes is None else open_
            open_ = open_.drop("first", "first_place", *(("centre", "centre_place") if last else ()))
            met_ = rows
        else:
            now = in_shares(shared.df, rows, "key", lambda share: opened(share, last), "open")  # noqa: B023
            open_ = now.df
            met_ = open_.count()
        if last and now:
            shared.drop()
        if last and beside is not None:
            # Pairs, not entries, are what the shares bound.
            met_ = max(met_, (open_.agg(F.sum(F.col("members") - 1)).first()[0] or 0) // 2)
        found = in_shares(open_, met_, "key", (lambda share: screened(across(share, fits))) if last else star, "found")
        # A pair can share keys of several shares.
        pairs = found.df.distinct() if met_ > SHARE else found.df
        for earlier in known:
            pairs = pairs.join(earlier.df, ["a", "b"], "left_anti")
        tried = Stored(pairs, "pairs")
        found.drop()
        if now:
            now.drop()
        known.append(tried)
        linked = in_shares(tried.df, tried.df.count(), "a", verify, "linked", SHARE // 4)
        edges = linked.df
        if groups:
            edges = edges.unionByName(groups.df.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        before, groups = groups, Stored(components(edges), "groups")
        linked.drop()
        if before:
            before.drop()
        if rows > FREED:
            freed(shared.spark)
    for table_ in (shared, *known):
        table_.drop()
    return groups.df


class Memo(dict):
    """A bounded cache that fills itself by ``make(key)``; of two generations, the older is dropped when full.

    Keys of more than ``LONGEST`` characters are made anew each time, so both generations together hold at
    most ``2 * size`` keys of that length.
    """

    LONGEST = 64

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
