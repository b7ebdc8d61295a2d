"""Quality by a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or abstain on every text. Their votes are counted by pattern over the
whole table (at most 3 to the number of labellers patterns), and expectation-maximisation on those counts
estimates the share of good texts and each labeller's accuracies on good texts and on each kind of bad ones
(Dawid and Skene 1979, with several bad classes), votes taken as independent given the class. The posterior
of each pattern labels the texts that train a linear scorer over the hashed words of the whole text, their
shapes and levels of counts; the scorer then reads every text's features.

No hand label is used. The training sample is bounded by a parameter; votes, EM and scores cover all rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.llm.common import Memo, Stored, id_type, map_arrow, texts_of
from corrie.llm.features import adam, drawn

GOOD, BAD, ABSTAIN = 1, 0, -1
#: Hashed places of the scorer, and bounds of its training sample and of its fit.
SIZE, WORDS = 1 << 14, 1 << 16
SAMPLE, STEPS, RATE, DECAY = 6000, 300, 0.05, 1e-4

MARKS = regex.compile(r"[^\p{L}\p{N}\s]+")
MEMO = 300_000


def word_record(w: str) -> tuple[int, int, int, int, int, int, int, int]:
    """Length, letters, capitals, marks, whether marks stand together, whether it ends a sentence, hashed shape and word."""
    letters = sum(map(str.isalpha, w))
    marks = MARKS.findall(w)
    kind = "U" if w.isupper() else "T" if w[:1].isupper() else "l" if letters == len(w) else "o"
    shape = kind + "".join(c for c in w[-2:] if not c.isalnum())
    return len(w), letters, sum(map(str.isupper, w)), sum(map(len, marks)), any(len(m) > 1 for m in marks), w[-1] in ".!?", zlib.crc32(f"shape:{shape}".encode()) % SIZE, zlib.crc32(f"word:{w.lower()}".encode()) % WORDS


RECORDS = Memo(word_record, MEMO)


class Shape:
    """Counts of one text that labellers and features share."""

    def __init__(self, text: str):
        words = text.split()
        self.n = len(words)
        some, size = max(1, self.n), max(1, len(text))
        counts = Counter(words)
        columns = [*zip(*map(RECORDS.__getitem__, words), strict=True)] or [()] * 8
        chars, letters, capitals, marks, doubled, ends = map(sum, columns[:6])
        self.shapes = Counter(columns[6])
        self.words = sorted(set(columns[7]))
        self.upper = capitals / max(1, letters)
        self.letters = letters / size
        self.marks = marks / size
        self.doubled = doubled / some
        self.bars = counts["|"] / some
        self.repeats = sum(map(eq, words, words[1:])) / some
        self.top = max(counts.values(), default=0) / some
        self.unique = len(counts) / some
        self.sentence = self.n / max(1, ends)
        lines = [x for x in text.split("\n") if x.strip()]
        self.fresh = len(set(lines)) / max(1, len(lines))
        self.mean = chars / some


def vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


#: Name and vote of each labeller. Counts of few words say little, so most abstain on them.
LABELLERS = {
    "case": lambda s: vote(s.upper < 0.2, s.n >= 4 and s.upper > 0.4),
    "marks": lambda s: vote(s.marks < 0.06, s.n >= 8 and s.marks > 0.12),
    "doubled": lambda s: vote(s.doubled < 0.05, s.n >= 4 and s.doubled > 0.15),
    "bars": lambda s: vote(s.bars < 0.03, s.n >= 4 and s.bars > 0.1),
    "repeats": lambda s: vote(s.repeats < 0.05, s.n >= 8 and s.repeats > 0.15),
    "top": lambda s: vote(s.n >= 30 and s.top < 0.15, s.n >= 30 and s.top > 0.25),
    "letters": lambda s: vote(s.letters > 0.72, s.n >= 8 and s.letters < 0.6),
    "sentence": lambda s: vote(s.sentence < 60, s.n > 100 and s.sentence > 120),
    "fresh": lambda s: vote(s.fresh > 0.8, s.fresh < 0.5),
    "length": lambda s: vote(s.n >= 10, s.n == 0),
    "mean": lambda s: vote(2.5 < s.mean < 10, s.n >= 8 and not 1.5 < s.mean < 14),
}


def votes(shape: Shape) -> str:
    """One character for each labeller: good +, bad -, abstain 0."""
    return "".join("-+0"[label(shape)] for label in LABELLERS.values())


#: A feature as stored: hashed place and value.
FEATURE = np.dtype([("place", "<i4"), ("value", "<f4")])


def seen_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, ``votes``, ``found`` and ``words`` (features, packed) of each row, in one reading; null texts count as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shapes = [Shape(t) for t in texts_of(batch, text)]
        found = [np.array(sorted(features(s).items()), FEATURE).tobytes() for s in shapes]
        words = [np.array(s.words, "<u2").tobytes() for s in shapes]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(s) for s in shapes], pa.string()), pa.array(found, pa.binary()), pa.array(words, pa.binary())], [id_column, "votes", "found", "words"])

    return map_arrow(docs, [id_column, text], run, f"`{id_column}` {id_type(docs, id_column)}, votes string, found binary, words binary")


def expectation_maximisation(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good by pattern, the labellers' accuracies by class, and the share of good texts.

    Class 0 is good; texts are bad in ways that different labellers see, so there is a bad class for each
    labeller. ``accuracy[c, j]`` is the chance that labeller j, if it votes, votes right on texts of class c:
    good on class 0, bad on the others; a labeller that is blind to a way of being bad has a low one there.
    It starts with good where nobody votes bad and otherwise with the classes of those that do. Each step
    takes accuracies and shares from the posteriors, smoothed by one vote each way, and posteriors from those;
    votes are independent given the class and an abstention says nothing. No patterns: halves.
    """
    names, n = sorted(patterns), len(LABELLERS)
    if not names:
        return {}, np.full((n + 1, n), 0.5), 0.5
    weight = np.array([patterns[p] for p in names], float)
    cast = np.array([["-+0".index(c) for c in p] for p in names])
    bad, good = (cast == 0).astype(float), (cast == 1).astype(float)
    posterior = np.column_stack([bad.sum(1) == 0, bad]).astype(float)
    posterior /= posterior.sum(1, keepdims=True)
    for _ in range(rounds):
        mass = posterior * weight[:, None]
        share = (mass.sum(0) + 1) / (weight.sum() + n + 1)
        voted_bad, voted_good = mass.T @ bad + 1, mass.T @ good + 1
        accuracy = voted_bad / (voted_bad + voted_good)
        accuracy[0] = 1 - accuracy[0]
        as_bad, as_good = np.log(accuracy), np.log(1 - accuracy)
        as_bad[0], as_good[0] = as_good[0].copy(), as_bad[0].copy()
        log = np.log(share) + bad @ as_bad.T + good @ as_good.T
        after = np.exp(log - log.max(1, keepdims=True))
        after /= after.sum(1, keepdims=True)
        if np.abs(after - posterior).max() < 1e-9:
            break
        posterior = after
    return dict(zip(names, posterior[:, 0].tolist(), strict=True)), accuracy, float(share[0])


def features(s: Shape) -> dict[int, float]:
    """Hashed: the level of each count, and word shapes by their share of the words."""
    found: dict[int, float] = {}

    def add(name: str, value: float) -> None:
        place = zlib.crc32(name.encode()) % SIZE
        found[place] = found.get(place, 0.0) + value

    for name in ("upper", "letters", "marks", "doubled", "bars", "repeats", "top", "unique", "fresh"):
        add(f"{name}:{int(10 * min(1.0, getattr(s, name)))}", 1.0)
    add(f"n:{int(math.log2(s.n + 1))}", 1.0)
    add(f"mean:{int(min(20.0, s.mean))}", 1.0)
    for place, k in s.shapes.items():
        found[place] = found.get(place, 0.0) + k / s.n
    return found


def joined(found: bytes, words: bytes) -> np.ndarray:
    """All features of a row: levels and shapes, then its different words, which together have length 1."""
    own, more = np.frombuffer(found, FEATURE), np.frombuffer(words, "<u2")
    both = np.empty(len(own) + len(more), FEATURE)
    both[: len(own)] = own
    both["place"][len(own) :] = more.astype(np.int32) + SIZE
    both["value"][len(own) :] = 1 / math.sqrt(max(1, len(more)))
    return both


class Scorer:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def probability(self, found: np.ndarray) -> float:
        """Of one text's features."""
        margin = self.intercept + float(self.weights[found["place"]] @ found["value"].astype(float))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def fit(rows: list[np.ndarray], target: np.ndarray) -> Scorer:
    """Logistic regression on soft labels, each class weighted alike, by Adam."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    both = np.concatenate(rows) if rows else np.zeros(0, FEATURE)
    place, value = both["place"].astype(np.int64), both["value"].astype(float)
    share = min(0.99, max(0.01, float(target.mean()))) if len(rows) else 0.5
    weight = (target / share + (1 - target) / (1 - share)) / 2 / max(1, len(rows))

    def gradient(x: np.ndarray) -> np.ndarray:
        margin = np.bincount(row, x[place] * value, len(rows)) + x[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target)
        return np.append(np.bincount(place, error[row] * value, SIZE + WORDS) + DECAY * x[:-1], error.sum())

    found = adam(gradient, STEPS, RATE, SIZE + WORDS + 1)
    return Scorer(found[:-1], float(found[-1]))


def train(seen: DataFrame, id_column: str = "doc_id", sample: int = SAMPLE) -> Scorer:
    """EM on the patterns of all rows' votes, and the scorer from at most ``sample`` rows of ``seen_rows``.

    The sample takes half from each side of posterior 0.5 where there are enough, by smallest hash of id.
    """
    patterns = {r.votes: r.n for r in seen.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, _, _ = expectation_maximisation(patterns)
    good = [p for p, x in posterior.items() if x >= 0.5]
    order = F.xxhash64(id_column, "votes")
    sides = F.col("votes").isin(good), ~F.col("votes").isin(good)
    rows = [r for side in sides for r in drawn(seen.where(side), order, sample // 2).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0], bytes(r.found), bytes(r.words)))
    return fit([joined(bytes(r.found), bytes(r.words)) for r in rows], np.array([posterior[r.votes] for r in rows]))


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: the id, ``quality`` (0 to 1) and ``keep`` (quality >= 0.5).

    Votes and features of all rows are made once and stored; model and scores come from there. Null texts
    are scored as empty ones; texts of any length are read whole; repeated rows each get their row; no rows
    give none; other columns are not carried.
    """
    seen = Stored(seen_rows(docs, id_column, text), "seen").df
    model = train(seen, id_column, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.probability(joined(a, b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([x >= 0.5 for x in found], pa.bool_())], [id_column, "quality", "keep"])

    return map_arrow(seen, [id_column, "found", "words"], run, f"`{id_column}` {id_type(docs, id_column)}, quality double, keep boolean")
