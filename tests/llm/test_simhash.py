import random
import re

import pyarrow.parquet as pq
import xxhash

from corrie.llm import simhash

TEXTS = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    """Smallest index reachable by links of at most 2 bits."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_equals_its_definition(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    for t in [*TEXTS[:60], "", " \n", "One", "ÀB two", "a b c", "x y z x y z x y z"]:
        assert simhash.fingerprint(t) % 2**64 == plain(t)


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    for _ in range(260):
        v = rng.choice(values[-60:])
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3, 4])):
            v ^= 1 << b
        values.append(v)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    from corrie.llm.common import components

    distinct = sorted(set(values))
    found = dict(components(simhash.links(spark.createDataFrame([(signed(v),) for v in distinct], "fp long"))).collect())
    mine = [found.get(signed(v), signed(v)) for v in distinct]
    want = groups(distinct)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_rows(spark):
    texts = [None, "", "a b c d", "A B c  d", "a b c d", *TEXTS[:50]]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id string")
    found = simhash.simhash_components(docs).orderBy("doc_id").collect()
    values = [plain(t) for t in texts]
    assert [r.fingerprint for r in found] == [f"{v:016x}" for v in values]
    assert [r.component_id for r in found] == groups(values)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, g in enumerate(groups(values)) if i == g]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "q w e"), (1, "q w e"), (None, "q w e"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.simhash_components(twice).collect()) == [(-1, -1), (-1, 1), (1, 1), (1, 1)]


def test_near_copies_are_found_by_similarity_alone(spark):
    """Recall against the shingle sets, without any fingerprint rule; what is unlike stays."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    texts, alike = [], 0
    for _ in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        edited = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) * rng.randint(2, 20) // 1000)):
            edited[at] = rng.choice(vocabulary)
        x, y = (set(simhash.shingle_set(" ".join(v), 5).tolist()) for v in (w, edited))
        if len(x & y) >= 0.8 * len(x | y):
            alike += 1
            texts += [" ".join(w), " ".join(edited)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(9000 + i, " ".join(rng.sample(t.split(" "), 100)), 0) for i, t in enumerate(texts[::2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    found = sum(i not in ids for i in range(1, len(texts), 2))
    print(f"recall of pairs with shingle similarity 0.8 or more: {found / alike:.3f} of {alike}")
    assert found >= 0.9 * alike and all(i in ids for i in range(0, len(texts), 2)) and all(9000 + i in ids for i in range(alike))


def test_near_copies_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (None, "a b"), (3, "a b"), (4, "A b"), (5, " ")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in simhash.drop_near_copies(docs).collect()) == [0, 0, 1, 3]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0
