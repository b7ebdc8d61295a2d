"""Hashed word features and a linear scorer, shared by the trained classifiers.

Features of a text are its distinct lower-case words and, for each, its first four, five and six letters,
so that inflected forms share a feature; all are hashed to ``SIZE`` places. A text's value is the sum of
its features' weights over the square root of a fourth of their number, plus an intercept: the sum runs
over a cache of each word's total weight, so scoring costs one look-up for each word.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.llm.common import Memo, id_type, map_arrow, texts_of

BITS = 18
SIZE = 1 << BITS
PREFIXES = (4, 5, 6)
MEMO = 300_000

WORD = regex.compile(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def places(word: str) -> list[int]:
    """Hashed features of a word."""
    found = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(f.encode()) & SIZE - 1 for f in found]


def features(text: str) -> list[int]:
    """Training features: for each distinct word, its places; all words, as in scoring."""
    return [p for w in sorted(set(words(text))) for p in places(w)]


def length(n: np.ndarray) -> np.ndarray:
    """What a text's sum of weights is divided by, in training and in scoring alike, from its number of features."""
    return np.sqrt(np.maximum(n / (1 + len(PREFIXES)), 1))


def feature_rows(docs: DataFrame, id_column: str, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and ``features`` (32-bit numbers, packed) of each row."""
    fields = ", ".join(f"`{c}` {id_type(docs, c)}" for c in keep)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([np.array(features(t), np.int32).tobytes() for t in texts_of(batch, text)], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), found], [*keep, "features"])

    return map_arrow(docs, [*keep, text], make, f"{fields}, features binary")


def frequency(lists) -> np.ndarray:
    """In how many of the lists each feature is."""
    found = np.zeros(SIZE)
    for x in lists:
        found[np.unique(x)] += 1
    return found


@dataclass
class Rows:
    """Feature rows as one index array, with the values that make each row's length 1 over its features."""

    index: np.ndarray
    row: np.ndarray
    value: np.ndarray
    n: int

    @staticmethod
    def of(lists: list, chosen: np.ndarray | None = None) -> Rows:
        """Rows of feature lists, of which only the chosen features are held; lengths are those of whole lists."""
        value = 1 / length(np.array([len(x) for x in lists], np.int64)).astype(np.float32)
        held = [x if chosen is None else x[chosen[x]] for x in (np.asarray(x, np.int32) for x in lists)]
        row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in held])
        index = np.concatenate(held) if held else np.zeros(0, np.int32)
        return Rows(index, row, value[row], len(lists))

    def frequency(self) -> np.ndarray:
        """In how many rows each feature is."""
        borders = np.searchsorted(self.row, np.arange(self.n + 1))
        return frequency(self.index[a:b] for a, b in zip(borders, borders[1:]))

    def only(self, chosen: np.ndarray) -> Rows:
        """The same rows with the chosen features alone."""
        kept = chosen[self.index]
        return Rows(self.index[kept], self.row[kept], self.value[kept], self.n)

    def score(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index] * self.value, self.n)

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, by_row[self.row] * self.value, SIZE)


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float
    memo: Memo = field(init=False, repr=False)

    def __post_init__(self):
        self.memo = Memo(self.word, MEMO)

    def __getstate__(self):
        return {"weights": self.weights, "intercept": self.intercept}

    def __setstate__(self, state):
        self.__init__(**state)

    def word(self, word: str) -> tuple[float, int]:
        """Total weight and number of a word's features."""
        found = places(word)
        return float(self.weights[found].sum()), len(found)

    def margin(self, text: str) -> float:
        found = set(words(text))
        if not found:
            return self.intercept
        weights, counts = zip(*map(self.memo.__getitem__, found))
        return math.fsum(weights) / float(length(sum(counts))) + self.intercept

    def probability(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(text)))))


def adam(gradient, steps: int, rate: float, size: int = SIZE + 1) -> np.ndarray:
    """Minimise by Adam from zero; ``gradient(parameters)`` gives the full-batch gradient."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def drawn(df: DataFrame, order: F.Column, most: int) -> DataFrame:
    """At most ``most`` rows by the smallest hash: a sample that does not depend on partitions or row order."""
    return df.orderBy(order).limit(most)
