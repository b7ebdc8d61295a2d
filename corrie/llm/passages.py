"""Passages that repeat across documents, found by column-wise construction of the transform of many strings.

A text is too long for one symbol of it a round to be a Spark job, and one transform of a whole corpus is too large
for one task. So texts are cut first, in such a way that equal windows of ``length`` bytes always meet:

* The anchor of a window is the leftmost of its grams with the least hash. Windows in a row with one anchor form a
  string of ``length`` to ``2 * length - GRAM`` bytes, and each window lies in exactly one string. Equal windows
  have equal anchors in equal places, so they meet under the anchor's hash, their strings aligned by it.
* Hashes that only one document has are dropped (``shared_anchors``); the other strings are merged where they are
  equal, keeping the least ``doc_id``, so copies do not pile up.
* The strings of whole hashes form collections of bounded size. A collection takes in one symbol of each
  string a round, from the right end to the left: the order of what has been taken in is sorted stably by the
  new symbols, and the common prefix of two neighbours is one more than the least between them before. As aligned
  strings can only agree in the same round, the transform has one segment a round (as in the positional
  transform of Durbin 2014), and only the last one is held; the symbols wait in, and answers go to, files that are
  written and read front to back.
* Where the common prefix reaches ``length``, the windows of a round that stand together are equal bytes, no
  hash in between, and the least ``doc_id`` among them decides what is removed.

A hash with more strings than a collection holds is compared window by window in Spark instead, so no task
grows with it. Windows never cross documents. A row is known by ``doc_id`` and its text's hash: repeated rows are judged
alike, and other rows of the same id never count as earlier ones. A row without id removes nothing and has
nothing removed. A null or short text has no windows; an empty table gives no rows; very long texts are
taken in pieces of ``FLUSH`` bytes. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.llm.common import Stored, freed, map_arrow

LENGTH = 50
#: Bytes of the grams among which anchors are chosen. Longer ones are shared by chance less often, shorter ones are fewer.
GRAM = 20
#: Bytes of texts handled together; less than 2 ** 24, since places in them take 24 bits.
FLUSH = 1 << 22
#: Bytes hashed at once, few enough for a processor's cache.
CHUNK = 1 << 16
#: Strings of a collection, and strings under one hash from which it goes the other way.
COLLECTION = 1 << 16
#: Keys with over this share of all rows, so fewer than its inverse, are broadcast.
HEAVY = 10_000

PRIME = 0x9E3779B97F4A7C15
#: Stands for a document where a hash is known to be shared.
MARK = -(2**63)
LOW24 = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``width`` bytes from each place, by doubling."""
    power = lambda n: np.uint64(pow(PRIME, n, 1 << 64))
    step, size = raw.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    while True:
        if width & size:
            whole, done = (step, size) if whole is None else (whole[: len(step) - done] * power(size) + step[done:][: len(whole)], done + size)
        if size * 2 > width:
            break
        step, size = step[:-size] * power(size) + step[size:], size * 2
    whole = whole ^ (whole >> np.uint64(31))
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Strings:
    """The strings of some texts: ``piece``, first and last window, place of the anchor (all in ``raw``) and its hash."""

    def __init__(self, pieces: list[bytes], length: int):
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begins = np.cumsum(sizes) - sizes
        self.first = self.last = self.anchor = self.piece = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        n = len(self.raw) - length + 1
        if n <= 0:
            return
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        hashes, anchor = np.empty(len(self.raw), np.uint64), np.empty(n, np.int64)
        for at in range(0, n, CHUNK):
            part = gram_hashes(self.raw[at : at + CHUNK + length - 1], GRAM)
            hashes[at : at + len(part)] = part
            part &= ~LOW24
            part |= np.arange(len(part), dtype=np.uint64)
            anchor[at : at + CHUNK] = (sliding_least(part, length - GRAM + 1) & LOW24).astype(np.int64) + at
        whole = owner[:n] == owner[length - 1 :]
        change = np.ones(n + 1, bool)
        change[1:n] = (anchor[1:] != anchor[:-1]) | (owner[1:n] != owner[: n - 1])
        self.first = np.flatnonzero(change[:n] & whole)
        ends = np.append(np.flatnonzero(change[:n])[1:], n) - 1
        self.last = ends[whole[np.flatnonzero(change[:n])]]
        # The windows at the end of a text reach into the next one; those before them are whole.
        cut = self.begins + sizes - length
        self.anchor, self.piece = anchor[self.first], owner[self.first].astype(np.int64)
        self.last = np.minimum(self.last, cut[self.piece])
        self.key = hashes[self.anchor]


def flushes(batches, columns: list[int], length: int) -> Iterator[tuple[list[bytes], list[int], list[int], list[tuple]]]:
    """Texts in pieces, some ``FLUSH`` bytes at a time: pieces, the row and the place in its text of each, and the rows."""
    pieces, rows, places, told, held = [], [], [], [], 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        others = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for text, other in zip(texts, others, strict=True):
            raw = (text or "").encode("utf-8", "replace")
            told.append(other)
            for at in range(0, max(1, len(raw) - length + 1), FLUSH):
                pieces.append(raw[at : at + FLUSH + length - 1])
                rows.append(len(told) - 1)
                places.append(at)
                held += len(pieces[-1])
                if held >= FLUSH:
                    yield pieces, rows, places, told
                    pieces, rows, places, told, held = [], [], [], [other], 0
        # What stands here is the start of the next flush, or of nothing.
    if pieces:
        yield pieces, rows, places, told


def idents(key: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes cut to 32 bits in each bucket: enough to find candidates, which bytes confirm later."""
    n = np.uint64(buckets)
    return ((key // n) & np.uint64(0xFFFFFFFF)) * n + key % n


def by_doc(docs: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, int)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(docs)).astype(np.int32)), pa.array(found.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(docs[starts]), lists], ["doc_id", "found"])


def sent_anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """``(bucket, doc_id, keys, docs)``: anchor hashes for their buckets, packed, and (bucket -1) those settled already.

    What one flush sees in two documents is settled there, and the bucket only learns that it is shared, so a
    hash that most documents have comes to its bucket once a flush.
    """

    def send(batches):
        for pieces, rows, _, told in flushes(batches, [1], length):
            s = Strings(pieces, length)
            doc = np.array([told[r][0] for r in rows], np.int64)[s.piece]
            ident = idents(s.key, buckets)
            order = np.lexsort((doc, ident))
            ident, doc = ident[order], doc[order]
            fresh = np.ones(len(ident), bool)
            fresh[1:] = (ident[1:] != ident[:-1]) | (doc[1:] != doc[:-1])
            ident, doc = ident[fresh], doc[fresh]
            if not len(ident):
                continue
            starts = np.flatnonzero(np.append(True, ident[1:] != ident[:-1]))
            several = np.diff(np.append(starts, len(ident))) > 1
            of_each = np.repeat(several, np.diff(np.append(starts, len(ident))))
            settled = by_doc(doc[of_each], ident[of_each])
            out = [(-1, d, np.array(v, np.int64).tobytes(), b"") for d, v in zip(settled.column(0).to_pylist(), settled.column(1).to_pylist(), strict=True)]
            for kind, (k, d) in enumerate(((ident[~of_each], doc[~of_each]), (ident[starts[several]], np.zeros(0, np.int64)))):
                if not len(k):
                    continue
                bucket, rest = (k % np.uint64(buckets)).astype(np.int64), (k // np.uint64(buckets)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                bucket, rest, d = bucket[order], rest[order], d[order] if kind == 0 else d
                marks = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                for a, b in zip(marks, np.append(marks[1:], len(bucket)), strict=True):
                    out.append((int(bucket[a]), None, rest[a:b].tobytes(), d[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "doc_id", "keys", "docs"])

    return docs.select("text", "doc_id").mapInArrow(send, "bucket int, doc_id long, keys binary, docs binary")


def shared_anchors(sent: DataFrame, buckets: int) -> DataFrame:
    """``(doc_id, found)``: for each document the (cut) anchor hashes that another document has too."""

    def settle(batches):
        def shared(bucket, keys, ids):
            key = np.concatenate([np.frombuffer(k, np.uint32) for k in keys])
            doc = np.concatenate([np.frombuffer(d, np.int64) if d else np.full(len(k) // 4, MARK) for k, d in zip(keys, ids, strict=True)])
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            # The mark of a hash that a flush has settled sorts first, and differs from every id.
            keep = np.repeat(doc[starts] != doc[np.append(starts[1:], len(key)) - 1], sizes) & (doc != MARK)
            return doc[keep], key[keep].astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)

        now, keys, ids = None, [], []
        for batch in batches:
            for bucket, k, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now and keys:
                    yield by_doc(*shared(now, keys, ids))
                    keys, ids = [], []
                now = bucket
                keys.append(k)
                ids.append(d)
        if keys:
            yield by_doc(*shared(now, keys, ids))

    def unpacked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(k, np.int64) for k in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "found"])

    bucketed = sent.where("bucket >= 0").select("bucket", "keys", "docs").repartition("bucket").sortWithinPartitions("bucket")
    settled = sent.where("bucket < 0").select("doc_id", "keys").mapInArrow(unpacked, "doc_id long, found array<bigint>")
    both = settled.unionByName(bucketed.mapInArrow(settle, "doc_id long, found array<bigint>"))
    return both.groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("found"))


STRINGS = "doc_id long, text_hash long, pos long, key long, string_hash long, low long, high long, n long, off int, string binary"


def strings_of(docs: DataFrame, found: DataFrame, length: int, buckets: int) -> DataFrame:
    """Strings with a shared anchor: where they occur, and, with ``string``, what they are.

    A flush tells each of its different strings once, with the least and the largest ``doc_id`` (``low``, ``high``) and the number of its
    places; ``off`` is the anchor's place in the string. Places have ``doc_id, text_hash, pos`` instead.
    """

    def cut(batches):
        for pieces, rows, places, told in flushes(batches, [1, 2, 3], length):
            s = Strings(pieces, length)
            if not len(s.key):
                continue
            row = np.array(rows, np.int64)[s.piece]
            spread = lambda r, ident: ident ^ (r.astype(np.uint64) * np.uint64(PRIME))
            known = np.concatenate([spread(np.full(len(t[2]), r), np.array(t[2], np.int64).astype(np.uint64)) for r, t in enumerate(told)])
            keep = np.flatnonzero(np.isin(spread(row, idents(s.key, buckets)), known))
            if not len(keep):
                continue
            first, row, key = s.first[keep], row[keep], s.key[keep].view(np.int64)
            pos = first - s.begins[s.piece[keep]] + np.array(places, np.int64)[s.piece[keep]]
            ids, hashes = (np.array([t[k] for t in told], np.int64)[row] for k in (0, 1))
            raw, numbers = s.raw.tobytes(), {}
            number = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(first.tolist(), (s.last[keep] + length).tolist(), strict=True)])
            digest = np.array([xxhash.xxh64_intdigest(x) for x in numbers], np.uint64).view(np.int64)
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(number[order]) > 0))
            one = order[starts]
            low, high = (f.reduceat(ids[order], starts) for f in (np.minimum, np.maximum))
            none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
            k, m = len(numbers), len(number)
            yield pa.RecordBatch.from_arrays([none(k), none(k), none(k), *map(pa.array, (key[one], digest, low, high, np.diff(np.append(starts, m)))), pa.array((s.anchor[keep] - first)[one].astype(np.int32)), pa.array(list(numbers), pa.binary())], NAMES)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (ids, hashes, pos, key, digest[number])), none(m), none(m), none(m), none(m, pa.int32()), none(m, pa.binary())], NAMES)

    wanted = docs.join(found, "doc_id").select("text", "doc_id", "text_hash", "found")
    return wanted.mapInArrow(cut, STRINGS)


NAMES = [x.split()[0] for x in STRINGS.split(", ")]


def range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low..high]``, both included, for many ranges."""
    table = [values]
    size = 1
    while size * 2 <= len(values):
        table.append(np.minimum(table[-1][:-size], table[-1][size:]))
        size *= 2
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << int(k)) + 1])
    return out


def least_by_window(raw: np.ndarray, sizes: np.ndarray, off: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """``(n, length - GRAM + 1)``: the least ``low`` of the strings that hold the window which starts so many bytes
    before the anchor's latest place; the string's own where it has no such window. ``raw`` holds the strings one after the other.

    One symbol of each string is taken in a round. ``order`` sorts the strings by what they have shown so far, and
    ``common`` holds the length of the prefix that each shares with the one before it, up to ``length``.
    """
    n, widest = len(sizes), length - GRAM
    left = widest - off.astype(np.int64)
    right = left + sizes
    columns = widest + length
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as answers:
        begins = np.cumsum(sizes) - sizes
        for c in reversed(range(columns)):
            at = np.where((left <= c) & (c < right), begins + c - left, 0)
            symbols.write(raw[at].tobytes())
        symbols.seek(0)
        order, common = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        by_end = np.argsort(right, kind="stable")
        ends = right[by_end]
        for c in reversed(range(columns)):
            column = np.frombuffer(symbols.read(n), np.uint8)
            new = by_end[np.searchsorted(ends, c + 1) : np.searchsorted(ends, c + 2)]
            if len(new):
                order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.uint8), common])
            held = np.flatnonzero(left[order] <= c)
            shown = column[order[held]]
            place = held[np.argsort(shown, kind="stable")]
            shown = column[order[place]]
            after = np.zeros(len(place), np.uint8)
            same = np.flatnonzero(shown[1:] == shown[:-1]) + 1
            if len(same):
                after[same] = np.minimum(range_least(common, place[same - 1] + 1, place[same]).astype(np.int64) + 1, length)
            order, common = order[place], after
            if c <= widest:
                answer = low.copy()
                if len(order):
                    starts = np.flatnonzero(common < length)
                    answer[order] = np.repeat(np.minimum.reduceat(low[order], starts), np.diff(np.append(starts, len(order))))
                answers.write(answer.tobytes())
        answers.seek(0)
        found = np.frombuffer(answers.read(), np.int64).reshape(widest + 1, n)
    return found[::-1].T


def first_seen(told: DataFrame, length: int) -> DataFrame:
    """``(key, string_hash, n, first, last, least)``: runs of windows of a string that a document before one of its own has.

    ``told`` has ``key, string_hash, low, high, n, off, string``, for each string as often as flushes held it.
    """
    widest = length - GRAM

    def compared(columns: list[np.ndarray], strings: pa.Array) -> pa.RecordBatch:
        """Rows of whole keys, sorted: equal strings are merged, and the others make a collection."""
        key, hashes, n, low, high, off = columns
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])))
        n, low, high = np.add.reduceat(n, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        key, hashes, off, strings = key[starts], hashes[starts], off[starts].astype(np.int64), strings.take(pa.array(starts))
        _, offsets, data = strings.buffers()
        edges = np.frombuffer(offsets, np.int32)[strings.offset :][: len(strings) + 1].astype(np.int64)
        raw, sizes = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], np.diff(edges)
        least = least_by_window(raw, sizes, off, low, length)
        windows = sizes - length + 1
        column, begin = np.arange(widest + 1), widest - off
        there = (column >= begin[:, None]) & (column < (begin + windows)[:, None]) & (least < high[:, None])
        runs = there.copy()
        runs[:, 1:] &= ~there[:, :-1] | (least[:, 1:] != least[:, :-1])
        over = there.copy()
        over[:, :-1] &= ~there[:, 1:] | (least[:, 1:] != least[:, :-1])
        (row, a), (_, b) = np.nonzero(runs), np.nonzero(over)
        found = [key[row], hashes[row], n[row], a - begin[row], b - begin[row], least[row, a]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["key", "string_hash", "n", "first", "last", "least"])

    def collections(batches):
        held: list[pa.RecordBatch] = []

        def joined():
            return [np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(6)], pa.concat_arrays([b.column(6) for b in held])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < COLLECTION:
                continue
            columns, strings = joined()
            ends = np.flatnonzero(columns[0][1:] != columns[0][:-1])
            if len(ends):
                at = int(ends[-1]) + 1
                yield compared([c[:at] for c in columns], strings[:at])
                rest = [pa.array(c[at:]) for c in columns] + [strings[at:]]
                held = [pa.RecordBatch.from_arrays(rest, batch.schema.names)]
        if sum(b.num_rows for b in held):
            yield compared(*joined())

    schema = "key long, string_hash long, n long, first long, last long, least long"
    crowded = Stored(told.groupBy("key").count().where(F.col("count") > COLLECTION).select("key"), "crowded").df
    some = crowded.limit(1).count() > 0
    few = told.join(crowded, "key", "left_anti") if some else told
    found = few.select("key", "string_hash", "n", "low", "high", "off", "string").repartition("key").sortWithinPartitions("key", "string_hash").mapInArrow(collections, schema)
    if not some:
        return found
    # One row a window, equal ones merged before they are dealt out.
    merged = told.join(crowded, "key", "left_semi").groupBy("key", "string_hash").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.first("string").alias("string"))
    each = merged.select("key", "string_hash", "n", "low", "high", "string", F.explode(F.sequence(F.lit(0), F.length("string") - length)).alias("first"))
    window = each.withColumn("window", F.expr(f"substring(string, first + 1, {length})")).drop("string")
    least = window.groupBy("window").agg(F.min("low").alias("least"))
    many = window.join(least, "window").where("least < high")
    return found.unionByName(many.select("key", "string_hash", "n", F.col("first").cast("long").alias("first"), F.col("first").cast("long").alias("last"), "least"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, text_hash, spans)``: byte ranges (not merged) that a document with a smaller id holds, too.

    Rows without any are left out. Windows have ``length`` bytes, more than ``GRAM``.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = Stored(sent_anchors(rows, length, buckets), "anchors")
    found = Stored(shared_anchors(sent.df, buckets), "found")
    sent.drop()
    freed(spark)
    at = Stored(strings_of(rows, found.df, length, buckets), "strings")
    found.drop()
    freed(spark)
    runs = Stored(first_seen(at.df.where("string is not null").drop("doc_id", "text_hash", "pos"), length), "runs")
    freed(spark)
    bound = max(1000, (at.df.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    told = at.df.where("string_hash is not null and doc_id is not null").select("doc_id", "text_hash", "pos", "key", "string_hash")
    # Strings with many occurrences are few: at most HEAVY, each with at most one run a window.
    heavy = told.join(F.broadcast(runs.df.where(F.col("n") > bound)), ["key", "string_hash"])
    light = told.join(runs.df.where(F.col("n") <= bound), ["key", "string_hash"])
    hit = heavy.unionByName(light).where("least < doc_id")
    span = F.struct((F.col("pos") + F.col("first")).alias("a"), (F.col("pos") + F.col("last") + length).alias("b"))
    spans = Stored(hit.groupBy("doc_id", "text_hash").agg(F.collect_list(span).alias("spans")), "spans")
    at.drop()
    runs.drop()
    freed(spark)
    return spans.df


def joined_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def cut_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept)`` of every row.

    ``spans`` are the removed byte ranges, in order and apart from each other; ``kept`` holds the bytes that are left.
    """
    spans = repeated_spans(docs, length)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, ranges = (text or "").encode("utf-8", "replace"), joined_spans(found)
            kept = kept_bytes(raw, ranges)
            out.append((len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in ranges], kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("id", F.col("doc_id").cast("long")).join(spans.withColumnRenamed("doc_id", "id"), ["id", "text_hash"], "left")
    return map_arrow(found, ["doc_id", "text", "spans"], cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: bigint, b: bigint>>, kept binary")
