import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corrie.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
ODD = [None, "", " ", "a  b", "a   b \n c", "\n\n x\n  y ", "tab\t x", "it's I'LL", "end <|endoftext|> mid<|endoftext|>", "日本語 テキスト", "nb  sp  x", "same", "same"]


def ids(texts):
    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_library():
    rng = random.Random(1)
    made = ["".join(rng.choice("ab'st   \n\t1.,é ") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    code = packing.encoder(open(PATH).read())
    for t, want in zip([t or "" for t in TEXTS + ODD + made], ids(TEXTS + ODD + made), strict=True):
        assert np.frombuffer(code.encode(t), code.dtype).tolist() == want[:-1], t


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_token_once(seed):
    rng = np.random.default_rng(seed)
    window = 64
    counts = np.zeros(window, np.int64)
    counts[1:] = [rng.integers(0, 9, 63), np.zeros(63), rng.integers(0, 2, 63), rng.integers(0, 10**6, 63), np.arange(63) == 44, (np.arange(63) < 3) * 7][seed] * (1 if seed != 4 else 10**9)
    plan = packing.make_plan(counts, window)
    total = int((counts * np.arange(window)).sum())
    assert int(((plan.high - plan.low) * plan.length).sum()) == total
    assert plan.sequences == -(-total // window)
    if counts.sum() > 10**4:
        return
    cells, seen = {}, set()
    for size, low, high, start, length, sequence, offset in zip(plan.size, plan.low, plan.high, plan.start, plan.length, plan.sequence, plan.offset):
        for r in range(low, high):
            cells.setdefault(sequence + r - low, []).append((offset, length))
            for t in range(start, start + length):
                assert (size, r, t) not in seen
                seen.add((size, r, t))
    assert len(seen) == total
    for parts in cells.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    lookup = packing.Lookup(plan)
    size = np.repeat(np.arange(window), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    piece, entry = lookup.find(size, rank)
    assert sum(plan.length[entry]) == total and (plan.low[entry] <= rank[piece]).all() and (rank[piece] < plan.high[entry]).all()


def test_least_squares_finds_an_exact_mix():
    counts = np.zeros(64, np.int64)
    counts[[40, 24]] = 500
    plan = packing.make_plan(counts, 64)
    assert plan.sequences == 500 and plan.cut() == 0


@pytest.mark.parametrize("broadcast_rows", [100_000, -1])
def test_pieces_hold_each_document(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast_rows)
    texts = TEXTS + ODD + [TEXTS[0] * 8]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, offset string").repartition(3)
    found = packing.pack(docs, PATH).collect()
    want = ids(texts)
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(want[r.doc_id])
    assert set(pieces) == set(range(len(texts)))
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[i])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(map(len, want)) // 2048)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_words_with_a_mark_need_no_pattern():
    """Words of letters are encoded once, with or without the mark that ends a clause, and equal the library's."""
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    code, seen = packing.Encoder(definition), []
    pattern = code.pattern

    class Watched:
        def findall(self, text):
            seen.append(text)
            return pattern.findall(text)

    code.pattern = Watched()
    text = "x größer alpha, alpha. alpha größer; it's a1, x.. ², áb. ,"
    got = np.frombuffer(code.encode(text), code.dtype).tolist()
    assert got == Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids
    assert seen == ["x", " it's", " a1,", " x..", " ²,", " áb.", " ,"]
