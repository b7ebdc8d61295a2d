"""How filters of a corpus act on each other: every order of applying them, part by part.

Each document gets a mask with one bit for each filter that it fails. All that an order of filters can do to a
part of the corpus follows from how many documents of the part have which mask, so texts are read once, and
the orders are walked over at most ``2 ** filters`` cells. The walk visits all orders by swaps of neighbours
(Steinhaus, Johnson and Trotter): one swap changes what its two steps remove and nothing else.

A null text is empty. A null ``source`` is the part ``''``, together with sources that are empty. Rows with one ``doc_id`` are all counted;
no text is a copy of one with an equal or a null ``doc_id``, and a document is good or toxic if any of its label
rows says so. A very long text is read whole, one at a time. An empty table has no parts. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.llm.common import map_arrow, texts_of

#: Failure conditions that look at one text: its UTF-8 bytes, its words, and its number of code points.
Condition = Callable[[bytes, list[bytes], int], bool]
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
CONDITIONS: dict[str, Condition] = {
    "A": lambda raw, words, n: len(words) < 200,
    "B": lambda raw, words, n: 100 * len(set(words)) < 50 * len(words),
    "C": lambda raw, words, n: 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * n,
    "D": lambda raw, words, n: len(raw) != len(raw.translate(None, MARKS)),
}
COPY = "E"
#: Counts kept for each cell.
SUMS = ("n", "good", "toxic")


def masked(docs: DataFrame, conditions: dict[str, Condition]) -> DataFrame:
    """``(doc_id, part, mask, digest)`` of every document, without the bit for copies."""
    tests = list(conditions.values())

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks, digests = [], []
        for text in texts_of(batch):
            raw = text.encode("utf-8", "replace")
            words = raw.split()  # of bytes: at the six ASCII spaces only
            masks.append(sum(bool(test(raw, words, len(text))) << k for k, test in enumerate(tests)))
            digests.append(hashlib.sha256(raw).digest())
        parts = pa.array([x or "" for x in batch.column(2).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), parts, pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")), ["doc_id", "text", "source"], one, f"doc_id {kind}, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame, conditions: dict[str, Condition] | None = None) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of a part that fail just the filters of the mask.

    The bit after those of ``conditions`` is for copies of a text with a smaller ``doc_id``. Digests are summed before they are
    dealt out, and first rows are found again by ``doc_id``, so no task gets a large group of copies.
    """
    conditions = CONDITIONS if conditions is None else conditions
    rows = masked(docs, conditions)
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    found = rows.join(firsts, ["doc_id", "digest"], "left").join(told, "doc_id", "left")
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << len(conditions)).otherwise(0)
    one = lambda name: F.sum(F.coalesce(F.col(name).cast("long"), F.lit(0))).cast("long").alias(name)
    return found.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count("*").alias("n"), one("good"), one("toxic"))


@dataclass
class Step:
    """What one filter does in one place of an order."""

    letter: str
    kept: int
    removed: int
    good_lost: int
    toxic_lost: int


def swaps(n: int) -> Iterator[int]:
    """Places ``k`` such that swapping items k and k + 1, one after the other, visits all orders of n items once."""
    items, ahead = list(range(n)), [False] * n
    while True:
        able = [x for at, x in enumerate(items) if (at + 1 < n and items[at + 1] < x if ahead[x] else at > 0 and items[at - 1] < x)]
        if not able:
            return
        moving = max(able)
        at = items.index(moving)
        k = at if ahead[moving] else at - 1
        items[k], items[k + 1] = items[k + 1], items[k]
        for x in range(moving + 1, n):
            ahead[x] = not ahead[x]
        yield k


def walk(letters: str, counts: dict[int, tuple[int, int, int]]) -> tuple[list[tuple[str, list[Step]]], dict[str, int]]:
    """All orders with their steps, and how much each filter removes over all orders.

    ``counts`` gives documents, good ones and toxic ones by mask, bit k standing for ``letters[k]``.
    """
    bit = {x: 1 << k for k, x in enumerate(letters)}

    def step(before: int, letter: str, alive: int) -> Step:
        gone = [c for mask, c in counts.items() if mask & bit[letter] and not mask & before]
        removed, good, toxic = (sum(c[i] for c in gone) for i in range(3))
        return Step(letter, alive - removed, removed, good, toxic)

    order, steps, before, alive = list(letters), [], 0, sum(c[0] for c in counts.values())
    for letter in order:
        steps.append(step(before, letter, alive))
        before, alive = before | bit[letter], steps[-1].kept
    found, shares = [("".join(order), list(steps))], {s.letter: s.removed for s in steps}
    for k in swaps(len(letters)):
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(bit[x] for x in order[:k])
        steps[k] = step(before, order[k], steps[k].kept + steps[k].removed)
        steps[k + 1] = step(before | bit[order[k]], order[k + 1], steps[k].kept)
        found.append(("".join(order), list(steps)))
        for s in steps:
            shares[s.letter] += s.removed
    return found, shares


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(found: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order and step, from the table of ``cells``.

    A part's cells meet in one row: at most ``2 ** len(letters)`` of them, whatever the size of the corpus.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = {r["mask"]: tuple(r[c] for c in SUMS) for r in rows}
                fails = {x: sum(c[0] for mask, c in counts.items() if mask >> k & 1) for k, x in enumerate(letters)}
                alone = {x: counts.get(1 << k, (0,))[0] for k, x in enumerate(letters)}
                orders, shares = walk(letters, counts)
                out = [(part, name, i + 1, s.kept, s.removed, fails[s.letter] - s.removed, alone[s.letter], s.good_lost, s.toxic_lost, shares[s.letter]) for name, steps in orders for i, s in enumerate(steps)]
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    gathered = found.groupBy("part").agg(F.collect_list(F.struct("mask", *SUMS)).alias("cells"))
    return gathered.mapInArrow(run, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Condition] | None = None) -> DataFrame:
    """The audit of ``conditions`` (``CONDITIONS`` if not given) and of the filter of copies, which comes last."""
    conditions = CONDITIONS if conditions is None else conditions
    return audit(cells(docs, labels, conditions), "".join(conditions) + COPY)
