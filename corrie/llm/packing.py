"""Packing token sequences by non-negative least squares.

Documents become token ids with an end id. Full windows are cut off first; what is left of each document
is one piece shorter than a window. Only the histogram of those lengths (at most window - 1 counts) goes
to the driver, where shallow combinations of two or three lengths that fill a window exactly are listed,
non-negative least squares gives how often to repeat each, and the counts are rounded down. What remains
is packed greedily, longest first, and a piece is cut where nothing fits, so that at most one sequence has
padding. The plan names, for each length, ranges of ranks: its size follows the lengths, not the rows.
Pieces get their rank among equal lengths from partition-wise counts, with no sort of the rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corrie.llm.common import ROWS, Memo, Stored, id_type, texts_of
from corrie.llm.token_counts import byte_symbols

#: The split of byte-level vocabularies before the merges (a fixed, published pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks after a word that are a pre-token of their own.
CLAUSE = frozenset(".,;:!?")
#: Entries of the caches of one Python worker.
MEMO = 400_000
#: Cut pieces up to which they are broadcast to find their tokens; beyond it both sides are shuffled.
BROADCAST_ROWS = 100_000
#: Third lengths tried for each longest length, and sweeps of the solver.
SPREAD, SWEEPS = 8, 40
RANK_BITS = 44


class Encoder:
    """Token ids of a byte-level vocabulary as packed integers.

    A text is cut before each space that no other space precedes or follows. The split pattern begins a
    pre-token at these places whatever stands before, so the parts are encoded alone and remembered.
    """

    def __init__(self, definition: str):
        tokenizer = Tokenizer.from_str(definition)
        self.model = tokenizer.model
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(SPLIT)
        self.symbols = dict(enumerate(byte_symbols()))
        self.pre_tokens = Memo(self.pre_token, MEMO)
        self.parts = Memo(self.part, MEMO)
        self.packed = "<%dH" if self.dtype.itemsize == 2 else "<%dI"

    def pre_token(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))]
        return struct.pack(self.packed % len(ids), *ids)

    def part(self, part: str) -> bytes:
        """A blank and what follows it. Letters alone, or with one mark that ends a clause, need no pattern."""
        if part.isalpha():
            return self.pre_token(" " + part)
        if part[-1:] in CLAUSE and part[:-1].isalpha():
            return self.parts[part[:-1]] + self.pre_tokens[part[-1]]
        return self.plain(" " + part)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.pattern.findall(text)))

    def ordinary(self, text: str) -> bytes:
        if "  " in text:
            return self.plain(text)
        first, *parts = text.split(" ")
        return self.plain(first) + b"".join(map(self.parts.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """The ids, strings of special tokens taken for those tokens, as is the library's default."""
        if not self.special or not any(s in text for s in self.special):
            return self.ordinary(text)
        parts = self.find_special.split(text)
        return b"".join(self.ordinary(p) if i % 2 == 0 else np.array([self.special[p]], self.dtype).tobytes() for i, p in enumerate(parts))


@lru_cache(2)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


@dataclass
class Plan:
    """Where pieces go: entry i places ranks ``low[i]`` to ``high[i]`` of pieces of ``size[i]`` tokens; of each,
    the ``length[i]`` tokens from ``start[i]`` on, at ``offset[i]`` of sequences ``sequence[i]``, +1, and so on."""

    sequences: int
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def cut(self) -> int:
        return int((self.high - self.low)[self.length < self.size].sum())


def combinations(present: np.ndarray, window: int) -> list[dict[int, int]]:
    """Pairs, and for each longest length a few triples, of present lengths that fill the window."""
    has = set(present.tolist())
    found = {(a, window - a) for a in has if window - a in has and a >= window - a}
    for a in has:
        rest = window - a
        fits = [b for b in range(-(-rest // 2), min(a, rest - 1) + 1) if b in has and rest - b in has]
        found |= {(a, b, rest - b) for b in fits[:: max(1, len(fits) // SPREAD)]}
    return [{x: c.count(x) for x in c} for c in sorted(found, reverse=True)]


def solve(columns: list[dict[int, int]], counts: np.ndarray) -> list[float]:
    """Repeats that leave the least squares of the counts, none negative, by coordinate descent."""
    left, repeats = counts.astype(float).tolist(), [0.0] * len(columns)
    entries = [(tuple(c.items()), 1 / sum(k * k for k in c.values())) for c in columns]
    for _ in range(SWEEPS):
        most = 0.0
        for j, (entry, scale) in enumerate(entries):
            change = max(-repeats[j], sum(left[x] * k for x, k in entry) * scale)
            if change:
                repeats[j] += change
                most = max(most, abs(change))
                for x, k in entry:
                    left[x] -= k * change
        if most < 0.5:
            break
    return repeats


def make_plan(counts: np.ndarray, window: int) -> Plan:
    """Pack ``counts[n]`` pieces of each length n."""
    counts = counts.astype(np.int64).tolist()
    lots = {n: deque([(n, 0, c, 0)]) for n, c in enumerate(counts) if c}
    placed: list[tuple[int, ...]] = []
    sequences = 0

    def take(n: int, many: int) -> list[tuple[int, int, int, int]]:
        """The next pieces of a length: origin's length, first rank, number, start within the origin."""
        taken = []
        counts[n] -= many
        while many:
            size, rank, has, start = lots[n].popleft()
            use = min(has, many)
            taken.append((size, rank, use, start))
            if use < has:
                lots[n].appendleft((size, rank + use, has - use, start))
            many -= use
        return taken

    def put(n: int, many: int, offset: int, part: int) -> None:
        """Place ``part`` tokens of the next pieces of length n; what is left of them are pieces again."""
        copy = sequences
        for size, rank, use, start in take(n, many):
            placed.append((size, rank, rank + use, start, part, copy, offset))
            copy += use
            if part < n:
                counts[n - part] += use
                lots.setdefault(n - part, deque()).append((size, rank, use, start + part))

    present = np.flatnonzero(np.array(counts))
    columns = combinations(present, window)
    for column, repeat in sorted(zip(columns, solve(columns, np.array(counts)), strict=True), key=lambda x: -x[1]):
        if many := min(int(repeat + 1e-6), *(counts[n] // k for n, k in column.items())):
            offset = 0
            for n, k in column.items():
                for _ in range(k):
                    put(n, many, offset, n)
                    offset += n
            sequences += many
    while any(counts):
        left = window
        free = sum(1 << n for n, c in enumerate(counts) if c)
        used: dict[int, int] = {}
        chosen: list[tuple[int, int]] = []
        while left and free:
            fitting = free & ((1 << left + 1) - 1)
            n = (fitting or free).bit_length() - 1
            used[n] = used.get(n, 0) + 1
            if used[n] == counts[n]:
                free ^= 1 << n
            chosen.append((n, min(n, left)))
            left -= min(n, left)
        many = min(counts[n] // k for n, k in used.items())
        offset = 0
        for n, part in chosen:
            put(n, many, offset, part)
            offset += part
        sequences += many
    table = np.array(placed, np.int64).reshape(-1, 7)
    return Plan(sequences, *table.T)


class Lookup:
    """The plan's entries for a piece, by binary search over the ranges in which they are the same."""

    def __init__(self, plan: Plan):
        self.plan = plan
        lows, highs = (plan.size << RANK_BITS) + plan.low, (plan.size << RANK_BITS) + plan.high
        self.borders = np.unique(np.concatenate([lows, highs]))
        first, last = np.searchsorted(self.borders, lows), np.searchsorted(self.borders, highs)
        entry = np.repeat(np.arange(len(lows)), last - first)
        interval = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)]) if len(lows) else np.zeros(0, np.int64)
        order = np.lexsort((plan.start[entry], interval))
        self.entry = entry[order]
        self.pointer = np.searchsorted(interval[order], np.arange(len(self.borders) + 1))

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part of each piece: the piece's place in the arguments and the plan's entry."""
        at = np.searchsorted(self.borders, (size << RANK_BITS) + rank, "right") - 1
        parts = self.pointer[at + 1] - self.pointer[at]
        piece = np.repeat(np.arange(len(size)), parts)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)
        return piece, self.entry[self.pointer[at][piece] + inside]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_windows(docs: DataFrame, definition: str, window: int, end_id: int, id_column: str, text: str) -> DataFrame:
    """Tokens of each row: checksums of its full windows, and its last piece with a rank in its partition."""
    names = ["part", "row", id_column, "doc_tokens", "windows", "first_window", "size", "local", "crc", "tail"]

    def run(batches):
        part, row, full = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(window, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                code = encoder(definition)
                out = []
                for t in texts_of(batch, text):
                    ids = np.append(np.frombuffer(code.encode(t), code.dtype), code.dtype.type(end_id))
                    n = len(ids) // window
                    tail = ids[n * window :]
                    out.append((part, row, len(ids), [crc(ids[i * window : (i + 1) * window]) for i in range(n)], full, len(tail), int(seen[len(tail)]), crc(tail), tail.tobytes()))
                    seen[len(tail)] += 1
                    full += n
                    row += 1
                columns = [*zip(*out, strict=True)]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays[:2], batch.column(0), *arrays[2:]], names)

    kind = id_type(docs, id_column)
    return docs.select(id_column, text).mapInArrow(run, f"part int, row long, `{id_column}` {kind}, doc_tokens long, windows array<long>, first_window long, size long, local long, crc long, tail binary")


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts are one end id. Repeated rows are packed each for itself; null ids are kept; other
    columns are not carried. Sequence ids are unique but leave gaps. An empty table has no pieces.
    """
    definition = Path(tokenizer).read_text(encoding="utf-8")
    stored = Stored(cut_windows(docs, definition, window, end_id, id_column, text), "windows").df
    narrow = stored.where("size > 0").select("part", "row", id_column, "doc_tokens", "size", "local", "crc")
    counts = np.zeros(window, np.int64)
    for size, n in narrow.groupBy("size").count().collect():  # at most window - 1 rows
        counts[size] = n
    plan = make_plan(counts, window)
    by_part = narrow.groupBy("size", "part").count()
    before = F.sum("count").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = narrow.join(by_part.select("size", "part", F.coalesce(before, F.lit(0)).alias("base")), ["size", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    names = ["part", "row", id_column, "start", "length", "crc", "doc_tokens", "sequence_id", "offset", "inside", "cut"]

    def place(batches):
        lookup = Lookup(plan)
        for b in batches:
            size, rank, tokens, crcs = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("size", "rank", "doc_tokens", "crc"))
            piece, entry = lookup.find(size, rank)
            p, at = plan, pa.array(piece)
            inside, length = p.start[entry], p.length[entry]
            start = tokens[piece] - size[piece] + inside
            sequence = p.sequence[entry] + rank[piece] - p.low[entry]
            arrays = [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), *map(pa.array, (start, length, crcs[piece], tokens[piece], sequence, p.offset[entry], inside, length < size[piece]))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = id_type(docs, id_column)
    schema = f"part int, row long, `{id_column}` {kind}, start long, length long, crc long, doc_tokens long, sequence_id long, offset long, inside long, cut boolean"
    placed = ranked.select("part", "row", id_column, "size", "rank", "doc_tokens", "crc").mapInArrow(place, schema)
    width = encoder(definition).dtype

    def recount(batches):
        for b in batches:
            columns = b.columns
            values = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("tail", "inside", "length")]
            columns[5] = pa.array([crc(np.frombuffer(t, width)[i : i + n]) for t, i, n in zip(*values, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    cut = placed.where("cut")
    cut = F.broadcast(cut) if plan.cut() <= BROADCAST_ROWS else cut
    tails = stored.select("part", "row", "tail")
    cut = cut.join(tails, ["part", "row"]).select(*names, "tail").mapInArrow(recount, schema)
    out = [F.col(id_column), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    full = stored.select(id_column, "doc_tokens", "part", "first_window", F.posexplode("windows").alias("i", "crc")).select(
        id_column,
        (F.col("i").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.lit(plan.sequences) + F.shiftleft(F.col("part").cast("long"), 36) + F.col("first_window") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return full.unionByName(placed.where("not cut").select(*out)).unionByName(cut.select(*out))
