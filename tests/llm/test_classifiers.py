"""Toxicity and quality: held-out accuracy on the given labels, and the estimators on known cases."""

from collections import Counter

import numpy as np

from corrie.llm import quality, toxicity
from corrie.llm.common import table
from corrie.llm.features import SIZE, Rows, places

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in found if r.held_out]
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in held if r.toxic == 1) >= 0.5 * sum(r.toxic for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    import zlib

    from pyspark.sql import functions as F

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.intercept == b.intercept
    for r in toxicity.score(docs.limit(20), a).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_non_negative_estimator_separates():
    rng = np.random.default_rng(0)
    common = [f"w{i}" for i in range(50)]

    def text(bad):
        words = [*rng.choice(common, 20)] + (["vile"] if bad else [])
        return [p for w in words for p in places(w)]

    model = toxicity.learn(Rows.of([text(True) for _ in range(100)]), Rows.of([text(i % 10 == 0) for i in range(400)]), 0.1)
    assert model.probability("w1 w2 w3 vile") > 0.5 > model.probability("w1 w2 w3 w4")
    empty = toxicity.learn(Rows.of([]), Rows.of([]), 0.2)
    assert abs(empty.probability("anything") - 0.2) < 1e-9 and empty.weights.shape == (SIZE,)


def test_long_training_texts_are_read_whole_and_as_in_scoring(spark):
    from corrie.llm.features import Linear, feature_rows

    text = " ".join(f"w{i}" for i in range(2000)) + " of a vileness"
    rows = feature_rows(spark.createDataFrame([(1, text), (2, "of a b"), (3, None)], "id long, text string"), "id", "text", ["id"]).orderBy("id").collect()
    weights = np.random.default_rng(0).standard_normal(SIZE)
    read = Rows.of([np.frombuffer(r.features, np.int32) for r in rows])
    assert set(places("vileness")) <= set(np.frombuffer(rows[0].features, np.int32).tolist())
    assert np.allclose(read.score(weights), [Linear(weights, 0.0).margin(t) for t in (text, "of a b", "")], rtol=1e-4, atol=1e-4)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 4
    assert toxicity.train(docs.limit(0), labels.limit(0)).probability("") == 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns


def test_label_model_recovers_known_accuracies():
    rng = np.random.default_rng(1)
    patterns = Counter()
    truth = Counter()
    n = len(quality.LABELLERS)
    for _ in range(20000):
        good = rng.random() < 0.8
        way = rng.integers(0, 3)
        bad = [(rng.random() < (0.01 if good else 0.9 if i == way else 0.02)) for i in range(n)]
        p = "".join("0" if rng.random() < 0.1 else "-" if b else "+" for b in bad)
        patterns[p] += 1
        truth[p, good] += 1
    posterior, accuracy, share = quality.expectation_maximisation(patterns)
    right = sum(k for (p, good), k in truth.items() if (posterior[p] >= 0.5) == good)
    assert right > 0.88 * 20000 and 0.7 < share < 0.9 and accuracy.shape == (n + 1, n)
    assert np.allclose(accuracy[0], 0.99, atol=0.02) and all(accuracy[1 + i, i] > 0.8 for i in range(3))
    assert quality.expectation_maximisation({})[0] == {}


def test_scores_equal_their_definition(spark):
    """Adam on the plain risk, row by row, and scores from word sets, against the operator."""
    import zlib

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["the", "Of", "x!!", "|", "WORD", "end."], 12)) for _ in range(30)]
    rows = quality.seen_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        both = quality.joined(bytes(r.found), bytes(r.words))
        words = {zlib.crc32(f"word:{w.lower()}".encode()) % quality.WORDS for w in t.split()}
        assert set(both["place"][both["place"] >= quality.SIZE] - quality.SIZE) == words
        assert np.allclose(both["value"][both["place"] >= quality.SIZE], len(words) ** -0.5)
    x = [quality.joined(bytes(r.found), bytes(r.words)) for r in rows]
    target = rng.random(30)
    model = quality.fit(x, target)
    share = target.mean()
    dense = np.zeros((30, quality.SIZE + quality.WORDS))
    for row, f in zip(dense, x, strict=True):
        np.add.at(row, f["place"], f["value"].astype(float))
    weight = (target / share + (1 - target) / (1 - share)) / 60

    def risk_gradient(w):
        error = weight * (1 / (1 + np.exp(-(dense @ w[:-1] + w[-1]))) - target)
        return np.append(dense.T @ error + quality.DECAY * w[:-1], error.sum())

    w, m, v = np.zeros(dense.shape[1] + 1), 0.0, 0.0
    for t in range(1, quality.STEPS + 1):
        g = risk_gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - quality.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(model.weights, w[:-1], atol=1e-5) and np.isclose(model.intercept, w[-1], atol=1e-5)
    assert np.allclose([model.probability(f) for f in x], 1 / (1 + np.exp(-(dense @ w[:-1] + w[-1]))), atol=1e-5)


def test_non_negative_risk_equals_its_definition():
    """One gradient of the estimator against finite differences of the written-out risk."""
    rng = np.random.default_rng(6)
    lists = [rng.choice(40, 8, replace=False).tolist() for _ in range(30)]
    positive, unlabelled, prior = Rows.of(lists[:10]), Rows.of(lists[10:]), 0.3
    w, b = rng.standard_normal(SIZE) * 0.1, 0.2
    loss = lambda z: np.logaddexp(0, -z)
    zp, zu = positive.score(w) + b, unlabelled.score(w) + b
    negative = loss(-zu).mean() - prior * loss(-zp).mean()
    value, gradient = toxicity.risk(positive, unlabelled, prior, w, b)
    assert np.isclose(value, prior * loss(zp).mean() + max(0.0, negative))
    assert negative >= 0
    for place in (lists[0][0], lists[20][3]):
        step = np.zeros(SIZE)
        step[place] = 1e-5
        up, down = (toxicity.risk(positive, unlabelled, prior, w + k * step, b)[0] for k in (1, -1))
        assert np.isclose(gradient[place], (up - down) / 2e-5, atol=1e-6)


def test_quality_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").withColumnRenamed("quality", "truth")
    found = quality.score(docs).join(labels, "doc_id").collect()
    assert sum(r.keep == bool(r.truth) for r in found) >= 0.97 * len(found)
    assert sum(not r.keep for r in found if r.truth) <= 0.01 * sum(r.truth for r in found)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z"), (3, "w " * 50_000, "v")], "doc_id long, text string, keep string")
    assert quality.score(docs).count() == 5
    assert quality.score(docs.limit(0)).count() == 0
