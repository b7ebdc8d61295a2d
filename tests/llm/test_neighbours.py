import numpy as np

from corrie.llm import neighbours


def brute(vectors, threshold=0.95):
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].append(j)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    return [len(x) for x in links], label


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 16))
    rows = [v.astype(np.float32).tolist() for v in rng.standard_normal((150, 16))]
    rows += [(c + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist() for c in centres for _ in range(3)]
    rows += [(centres[0] + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist() for _ in range(60)]
    rows += [rows[0]] * 3 + [rows[160]] * 2
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0001], [1.0] * 15]
    docs = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, node string")
    found = neighbours.near_vectors(docs).orderBy("vec_id").collect()
    counts, label = brute(rows)
    assert [r.component_id for r in found] == label
    assert [r.n_links for r in found] == counts
    assert [r.kept for r in found] == [i == x for i, x in enumerate(label)]


def test_runs_cut_and_join_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [0, 1, 2]), ([2, 2, 2], [3, 4, 5]), ([2, 3], [6, 7]))]
    assert [b.column(1).to_pylist() for b in neighbours.runs(batches, ["k"], None)] == [[0, 1], [2, 3, 4, 5, 6], [7]]
    assert [b.column(1).to_pylist() for b in neighbours.runs(batches, ["k"], 2)] == [[0, 1], [2, 3], [4, 5], [6], [7]]


def test_no_vectors(spark):
    docs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.near_vectors(docs).count() == 0


def test_a_missed_audit_leads_to_the_exact_comparison(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TRIES", 1)
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "projected", lambda nodes, *_: nodes.sparkSession.createDataFrame([], neighbours.EDGES))
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8))
    rows = [(c + 0.05 * rng.standard_normal(8)).astype(np.float32).tolist() for c in centres for _ in range(2)]
    found = neighbours.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    counts, label = brute(rows)
    assert [r.component_id for r in found] == label and [r.n_links for r in found] == counts and any(counts)
