"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over hashed words. It learns from confirmed toxic texts and from unlabelled ones,
a sample of all texts, whose mix of classes is not known: with class prior p, positive risk R+ and
negative risk R-, the estimate is p R+(P) + max(0, R-(U) - p R-(P)) under the logistic loss, and where the
second term is negative the step descends it back to zero (Kiryo et al. 2017). The prior comes from the
labels of the learning folds: the share of toxic rows among labelled ones.

The bounds of the learning sample are parameters; scores are of whole texts, all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrie.llm.common import Stored, id_type, map_arrow, texts_of
from corrie.llm.features import SIZE, Linear, Rows, adam, drawn, feature_rows, frequency

FOLDS = 5
POSITIVES, UNLABELLED = 3000, 6000
STEPS, RATE, DECAY = 300, 0.05, 1e-6
#: Features must tell the samples apart this well, against learning chance words by heart.
LEAST_Z = 3.0


def held_out(id_column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0


def distinctive(has: np.ndarray, positives: int, rest: np.ndarray, unlabelled: int) -> np.ndarray:
    """Which features' log odds differ between the two samples by ``LEAST_Z`` standard errors; only these get weights."""
    has, rest = has + 0.5, rest + 0.5
    odds = np.log(has / (positives - has + 1)) - np.log(rest / (unlabelled - rest + 1))
    return np.abs(odds) / np.sqrt(1 / has + 1 / rest) >= LEAST_Z


def learn(positive: Rows, unlabelled: Rows, prior: float) -> Linear:
    """Fit by the non-negative estimator; without positives every text has the prior."""
    if not positive.n or not unlabelled.n:
        return Linear(np.zeros(SIZE), float(np.log(prior / (1 - prior))))
    telling = distinctive(positive.frequency(), positive.n, unlabelled.frequency(), unlabelled.n)
    positive, unlabelled = positive.only(telling), unlabelled.only(telling)

    def gradient(x: np.ndarray) -> np.ndarray:
        found = risk(positive, unlabelled, prior, x[:-1], x[-1])[1]
        found[:-1] += DECAY * x[:-1]
        return found

    found = adam(gradient, STEPS, RATE)
    return Linear(found[:-1], float(found[-1]))


def risk(positive: Rows, unlabelled: Rows, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the gradient of the step: where the negative part is below zero, of its return to zero."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = positive.score(w) + b, unlabelled.score(w) + b
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up = -prior * sigmoid(-zp) / positive.n
    down_p, down_u = -prior * sigmoid(zp) / positive.n, sigmoid(zu) / unlabelled.n
    by_p, by_u = (up + down_p, down_u) if negative >= 0 else (-down_p, -down_u)
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    return value, np.append(positive.gradient(by_p) + unlabelled.gradient(by_u), by_p.sum() + by_u.sum())


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    """Learn from rows outside the held-out fold: at most ``positives`` labelled 1, ``unlabelled`` of all.

    Both samples take the rows with the smallest hashes of their ids, and of an id that repeats the row with the
    smallest hash of its text, so at most ``positives + unlabelled`` rows are gathered. The unlabelled ones
    stand for all texts in the risk estimate: its error falls with the root of their number, whatever the size
    of the corpus. Rows with null labels are unlabelled, and so are null ids; null texts count as empty. Without
    labels the prior is 0.5; without positives or texts every score is the prior.
    """
    marks = labels.select(F.col(id_column).alias("id"), F.col(label).alias("y")).where(F.col("y").isNotNull() & ~held_out("id"))
    counts = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1)), F.lit(0)).alias("k")).first()
    prior = min(0.99, max(1e-3, counts.k / counts.n)) if counts.n else 0.5
    order = F.xxhash64("id")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(~held_out("id"))
    toxic = drawn(marks.where("y = 1").select("id").distinct(), order, positives)
    chosen = drawn(texts.select("id").distinct(), F.xxhash64("id", F.lit("unlabelled")), unlabelled)
    both = toxic.select("id", F.lit(1).alias("y")).unionByName(chosen.select("id", F.lit(0).alias("y")))
    ids = both.groupBy("id").agg(F.max("y").alias("p"), F.min("y").alias("q"))  # at most positives + unlabelled rows
    joined = texts.join(F.broadcast(Stored(ids, "drawn").df), "id")
    joined = joined.groupBy("id", "p", "q").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = Stored(feature_rows(joined, "id", "text", ["p", "q", "id"]), "features")
    # One part after the other: the driver holds the packed features once, and then only those that tell.
    lists = sorted(((r.id, len(r.features), r.p, r.q, np.frombuffer(r.features, np.int32)) for r in rows.df.toLocalIterator()), key=lambda x: x[:2])
    rows.drop()
    positive, rest = [x[4] for x in lists if x[2] == 1], [x[4] for x in lists if x[3] == 0]
    telling = distinctive(frequency(positive), len(positive), frequency(rest), len(rest))
    return learn(Rows.of(positive, telling), Rows.of(rest, telling), prior)


def score(docs: DataFrame, model: Linear, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Null texts are scored as empty ones, and texts of any length whole; a null id is not held out; repeated rows
    each get their row, equal texts the same score; no rows give none; other columns are not carried.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([model.probability(t) for t in texts_of(batch, text)], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), found], [id_column, "score"])

    scored = map_arrow(docs, [id_column, text], run, f"`{id_column}` {id_type(docs, id_column)}, score double")
    return scored.select(id_column, F.coalesce(held_out(id_column), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Linear, text: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, all columns in place.

    Null and empty texts have the score of no words; a score of just 0.5 goes; repeated rows go or stay
    together; no rows give none.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([model.probability(t) < 0.5 for t in texts_of(batch, text)], pa.bool_()))

    return map_arrow(docs, [f"`{c}`" for c in docs.columns], run, docs.schema)
