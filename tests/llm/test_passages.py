"""Repeated passages: against a scan of all windows."""

import hashlib
import random

import numpy as np
import pytest

from corrie.llm import passages
from corrie.llm.passages import cut_passages, least_by_window, range_least


def brute(rows, length):
    """For each row, the marks of its bytes."""
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        before = {b[i : i + length] for k, t in rows if key is not None and k is not None and k < key for b in [(t or "").encode()] for i in range(len(b) - length + 1)}
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in before:
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(raw, mark) if not m)
        spans = sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        out.append((key, len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(14) for _ in range(4)] + ["x" * 130, "ab" * 80, "é" * 60]
    rows = [(i, text(rng.randrange(0, 40)) + rng.choice(shared) + text(rng.randrange(0, 30)) + rng.choice(shared)) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1][:70]), (52, rows[3][1][5:]), (53, None), (54, ""), (55, "z" * 49), (56, "z" * 50), (57, "z" * 50), (58, "z" * 51)]
    rows += [(3, rows[3][1]), (4, rows[9][1]), (None, rows[2][1]), (None, None), (60, "y" * 9000), (61, "y" * 9000 + shared[0])]
    return rows


@pytest.mark.parametrize("way", ["arrays", "windows", "pieces"])
def test_passages_equal_a_scan(spark, monkeypatch, way):
    if way == "windows":
        monkeypatch.setattr(passages, "COLLECTION", 1)
    if way == "pieces":
        monkeypatch.setattr(passages, "FLUSH", 700)
        monkeypatch.setattr(passages, "CHUNK", 64)
        monkeypatch.setattr(passages, "HEAVY", 10**9)
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1, "k", b"x") for k, t in rows], "doc_id long, text string, low int, key string, string binary").repartition(3)
    found = cut_passages(docs)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=str)
    assert got == brute(rows, 50)
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append((t or "").encode())
    for r in found.where("n_removed > 0").collect():
        assert any(passages.kept_bytes(b, [(s.a, s.b) for s in r.spans]) == bytes(r.kept) for b in texts[r.doc_id])


def test_no_documents(spark):
    assert cut_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.n_removed for r in cut_passages(spark.createDataFrame([(1, "short")], "doc_id int, text string")).collect()] == [0]
    with pytest.raises(ValueError, match="over 20"):
        passages.repeated_spans(spark.createDataFrame([(1, "a")], "doc_id int, text string"), 20)


def test_collections_equal_a_comparison_of_windows():
    rng = random.Random(5)
    length, gram = 50, passages.GRAM
    strings, off, low = [], [], []
    for i in range(300):
        left, right = rng.randrange(0, length - gram + 1), rng.randrange(0, length - gram + 1)
        while left + right + gram < length:
            left, right = left + 1 if left < length - gram else left, right + 1 if right < length - gram else right
        anchor = rng.choice([b"A" * gram, b"B" * gram])
        side = lambda n: bytes(rng.choice(b"ab\0") for _ in range(n)) if rng.random() < 0.3 else b"q" * n
        strings.append(side(left) + anchor + side(right))
        off.append(left)
        low.append(rng.randrange(1000))
    found = least_by_window(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings]), np.array(off), np.array(low, np.int64), length)
    windows = {}
    for s, o, x in zip(strings, off, low):
        for t in range(len(s) - length + 1):
            key = (o - t, s[t : t + length])
            windows[key] = min(x, windows.get(key, 10**9))
    for i, (s, o) in enumerate(zip(strings, off)):
        for c in range(length - gram + 1):
            t = c - (length - gram - o)
            assert found[i, c] == (windows[o - t, s[t : t + length]] if 0 <= t <= len(s) - length else low[i])


def test_least_of_ranges():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 77).astype(np.uint8)
    low = rng.integers(0, 77, 200)
    high = np.minimum(low + rng.integers(0, 40, 200), 76)
    assert range_least(values, low, high).tolist() == [int(values[a : b + 1].min()) for a, b in zip(low, high)]
