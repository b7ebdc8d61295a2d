"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles. Equal
fingerprints are merged first, so copies cost one row. Links between different fingerprints are found by
multi-index hashing with two segments of 32 bits: the table holds, for every fingerprint, the members of
the Hamming ball of radius 1 in each segment, that is the fingerprint with one bit of that segment changed
and the rest as it is. Two fingerprints differ in at most 2 bits exactly if they meet at some entry, and at
most 65 different ones can meet there, so no entry grows with a group's size and no bucket needs a cap. What
meets at an entry is linked in order of value, and each link's complete distance is verified. Whole values as
keys, rather than a segment's alone, keep dense segment values from filling one entry; two bits are the most
that this finds, and all that the contract of the query asks.

``drop_near_copies`` has a wider aim: shingle sets of similarity 0.8. Their fingerprints differ in an eighth of
the bits and more, so it takes 224 bits in eight segments, tables by segment, and verifies the sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrie.llm.common import Stored, components, id_type, joined_groups, map_arrow, met, texts_of

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Wide fingerprints: segments, their bits, and differing bits up to which shingle sets are compared.
SEGMENTS, SEGMENT, RADIUS = 8, 28, 56


def hashes(text: str, size: int):
    """The XXH64 hashes of a text's word shingles, in blocks: ASCII lower case, words between ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def bit_counts(found: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit."""
    return np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str, size: int = 3) -> int:
    """Signed 64-bit fingerprint over the shingles, repeats included; 0 without words."""
    counts, n = np.zeros(BITS, np.int64), 0
    for block in hashes(text, size):
        counts += bit_counts(block)
        n += len(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def shingle_set(text: str, size: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes(text, size)]))


def mixed(found: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits for each number (the finaliser of SplitMix64 from its k-th step)."""
    with np.errstate(over="ignore"):
        x = found + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray) -> list[int]:
    """``SEGMENTS`` segments of ``SEGMENT`` bits: majorities over a set of shingles."""
    n, bits = len(shingles), np.zeros(0, bool)
    for k in range(-(-SEGMENTS * SEGMENT // BITS)):
        counts = sum((bit_counts(mixed(shingles[at : at + BLOCK], k)) for at in range(0, n, BLOCK)), np.zeros(BITS, np.int64))
        bits = np.append(bits, 2 * counts > n)
    return (bits[: SEGMENTS * SEGMENT].reshape(SEGMENTS, SEGMENT) @ (1 << np.arange(SEGMENT))).tolist()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """The id and the fingerprint (long) of each row; null, empty and blank texts have fingerprint 0."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([fingerprint(t, size) for t in texts_of(batch, text)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), found], [id_column, "fp"])

    return map_arrow(docs, [id_column, text], make, f"`{id_column}` {id_type(docs, id_column)}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)`` links that join all fingerprints (column ``fp``, distinct) at 2 or fewer differing bits."""
    changes = [0, *(1 << b for b in range(BITS - 1)), -(1 << BITS - 1)]
    entries = distinct.select("fp", F.explode(F.array(*map(F.lit, changes))).alias("change")).select("fp", F.col("fp").bitwiseXOR(F.col("change")).alias("entry"))
    before = F.lag("fp").over(Window.partitionBy("entry").orderBy("fp"))
    met = entries.select("fp", before.alias("other")).where("other is not null")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2).select(F.col("fp").alias("a"), F.col("other").alias("b"))


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable by links, the row's own included; null ids never are the
    smallest unless there are no others. Rows with null or empty texts share fingerprint 0 and are linked
    like any others; repeated rows each get their row; other columns are not carried.
    """
    named = Stored(fingerprints(docs, id_column, text), "fingerprints").df
    least = Stored(named.groupBy("fp").agg(F.min(id_column).alias("least")), "distinct").df
    roots = components(links(least.select("fp"))).select(F.col("node").alias("fp"), "component")
    rooted = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    found = rooted.join(smallest, "component").select("fp", "component_id")
    return named.join(found, "fp").select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes_of(docs: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """``(id, th, set, segments)`` of rows with an id: text hash, digest of the shingle set, wide fingerprint."""
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in texts_of(batch)]
        digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(list(map(wide_fingerprint, sets)), pa.list_(pa.int64()))], ["id", "th", "set", "segments"])

    return map_arrow(rows, ["id", "th", "text"], make, f"id {id_type(rows, 'id')}, th long, set binary, segments array<long>")


def near_groups(classes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(node, component)`` of classes (``n``, ``id``, ``th``, ``segments``) joined by links; single ones are left out.

    Multi-index hashing: each segment's table holds the Hamming ball of radius 1 around every fingerprint's
    segment, so two fingerprints meet there if that segment differs in at most 2 bits. What meets is held
    against the complete distance and then against the shingle sets themselves.
    """
    changes = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(SEGMENT))))
    spread = classes.select("n", F.posexplode("segments").alias("at", "segment")).select("n", (F.col("at").cast("long") * (1 << SEGMENT) + F.col("segment")).alias("value"), changes.alias("change"))
    entries = spread.select("n", F.col("value").bitwiseXOR(F.col("change")).alias("key"))
    nodes = classes.select("n", *(F.col("segments")[k].alias(f"s{k}") for k in range(SEGMENTS)))

    def fits(x, y):
        return sum((F.bit_count(x[f"s{k}"].bitwiseXOR(y[f"s{k}"])) for k in range(SEGMENTS)), F.lit(0)) <= RADIUS

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        sets = [(shingle_set(x or "", size), shingle_set(y or "", size)) for x, y in pairs]
        common = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in sets]
        return batch.select(["a", "b"]).filter(pa.array([c >= similarity * (n - c) for c, n in common], pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        place = classes.select("n", "id", "th")
        for side in ("a", "b"):
            mine = place.select(F.col("n").alias(side), F.col("id").alias(f"id_{side}"), F.col("th").alias(f"th_{side}"))
            asked = pairs.select(side).distinct().join(mine, side)
            told = asked.join(texts, (F.col(f"id_{side}") == texts["id"]) & (F.col(f"th_{side}") == texts["th"])).groupBy(side).agg(F.first("text").alias(f"t{side}"))
            pairs = pairs.join(told, side)
        return map_arrow(pairs, ["a", "b", "ta", "tb"], check, "a long, b long", 32)

    return joined_groups(Stored(met(entries).join(nodes, "n"), "shared"), nodes, fits, verify)


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows with the smallest id of their group; the others are near copies and go.

    Rows whose texts have the same set of ``size``-word shingles (ASCII lower case) are one class, whether
    repeated, null, empty or blank; texts of fewer words have their whole sequence as one shingle. Classes whose sets have a Jaccard
    similarity of at least ``similarity`` are linked where their 224-bit SimHashes meet in a segment; the
    tests measure how many do. Rows of one id and equal texts stay together; rows with a null id are kept, as
    they cannot be told apart. All columns stay, whatever their names; no rows give none.
    """
    rows = Stored(classes_of(docs, id_column, text, size), "rows").df
    least = rows.groupBy("set").agg(F.min(F.struct("id", "th")).alias("at"), F.first("segments").alias("segments"))
    classes = Stored(least.select(F.monotonically_increasing_id().alias("n"), "set", "at.*", "segments"), "classes").df
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    groups = near_groups(classes, texts, size, similarity)
    placed = classes.join(groups, F.col("n") == F.col("node"), "left").select("set", "id", F.coalesce("component", "n").alias("group"))
    stays = placed.groupBy("group").agg(F.min("id").alias("stays"))
    found = placed.join(stays, "group").select("set", "stays")
    gone = Stored(rows.select("id", "th", "set").join(found, "set").where("id <> stays").select("id", "th").distinct(), "gone").df
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_column).alias("_id"), F.xxhash64(text).alias("_th"))
    kept = marked.join(gone, (F.col("_id") == gone["id"]) & (F.col("_th") == gone["th"]), "left_anti")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
