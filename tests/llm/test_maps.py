"""Token counts, personal data and media: against the library, regular expressions and round trips."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corrie.llm import media, pii
from corrie.llm.token_counts import START, TokenCounter, begins, compose, counter, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
ODD = ["", " ", "\n\n", "'re'll'r'", "it's I'LL we'VE 'd", "<|endoftext|>x<|startoftext|>Y<|ENDOFTEXT|>", "ΑΣ σς Σ", "İstanbul", "ẹ́", "a\x1cb\x85c", "12345", "x" * 5000, "日本語テキスト", "🙂🙂 ok"]


def rows(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library():
    rng = random.Random(5)
    made = ["".join(rng.choice("abeilnrstvdm'' ',.1\n!<|>éΣİ\x1c ") for _ in range(rng.randint(0, 300))) for _ in range(2000)]
    texts = TEXTS + ODD + made
    assert counter(open(WORDS).read()).counts(texts).tolist() == library(texts)


@pytest.mark.parametrize("width", [1, 3, 128])
def test_chunk_width_does_not_change_the_split(width):
    import numpy as np

    codes = np.frombuffer(" ".join(ODD).lower().encode("utf-32-le"), np.uint32)
    assert (begins(codes, width)[0] == begins(codes, 1 << 14)[0]).all()


def test_prefix_scan_composes_in_order():
    import numpy as np

    rng = np.random.default_rng(0)
    maps = rng.integers(0, 7, (37, 7)).astype(np.uint8)
    state, scanned = START, compose(maps)
    for i in range(37):
        state = maps[i, state]
        assert scanned[i, START] == state


def test_memo_and_state_resets_keep_counts(monkeypatch):
    import corrie.llm.token_counts as module

    monkeypatch.setattr(module, "STATES", 50)
    assert TokenCounter(open(WORDS).read()).counts(TEXTS[:40]).tolist() == library(TEXTS[:40])


def test_token_counts_rows(spark):
    found = token_counts(rows(spark, [None, "", *ODD, "same", "same"]), WORDS, limit=5).orderBy("doc_id").collect()
    texts = [None, "", *ODD, "same", "same"]
    assert [r.n_tokens for r in found] == library(texts)
    assert [r.n_bytes for r in found] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in found] == [n > 5 for n in library(texts)]
    assert token_counts(rows(spark, []), WORDS).count() == 0


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in p.finditer(text) if valid(k, m[0])]
    return sorted(found, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    made = ["".join(rng.choice(a) for _ in range(rng.randint(0, 80))) for a in ("12. -+()@a", "0123456789 -+", "a@.b-1%", "1.2.") for _ in range(4000)]
    for t in TEXTS + ODD + made:
        assert [s for s in pii.spans(t) if s[2] in pii.BASE] == brute(t), t


def test_added_spans_and_mask():
    text = "See https://a.example/x?y=1. IBAN: DE44 5001 0517 5407 3249 31, mail a@b.co"
    assert [(text[a:b], k) for a, b, k in pii.spans(text)] == [("https://a.example/x?y=1", "url"), ("DE44 5001 0517 5407 3249 31", "account"), ("a@b.co", "email")]
    assert pii.masked(text, pii.spans(text)) == "See [URL]. IBAN: [ACCOUNT], mail [EMAIL]"


def test_pii_rows(spark):
    texts = [None, "", "a@b.co 1.2.3.4", "a@b.co 1.2.3.4", "+1 (456) 555-2186", "4041894974608795 " * 400]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_chars long")
    found = pii.pii_digest(pii.pii_spans(docs)).orderBy("doc_id").collect()
    for r, t in zip(found, texts):
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in brute(t or ""))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in brute(t or "")) for k in pii.BASE]
    clean = pii.mask_pii(docs).orderBy("doc_id").collect()
    assert clean[0].text is None and clean[2].text == "[EMAIL] [IP]" and clean[2].n_chars == 12 and clean[2].spans == "s"
    assert pii.mask_pii(docs.limit(0)).count() == 0


def test_media_round_trip(spark):
    texts = [None, "", "é" * 288, "x" * 577, *ODD]
    found = media.media_digest(rows(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(found, texts):
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        assert r.media_bytes == len(padded) + 44 and r.feature.startswith("audio/wav;")
    assert media.media_digest(rows(spark, [])).count() == 0


def example_png():
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def test_sniffing_corrects_and_carves(spark):
    import io
    import zipfile

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "hello")
    png, wave, archive = example_png(), media.store(b"abc"), box.getvalue()
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"\x2c" + bytes(8) + b"\0\x02\x02\x44\x01\0\x3b"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(8) + b"\1\0\x18\0" + bytes(28)
    jpeg = b"\xff\xd8\xff\xc0\0\x04ab\xff\xda\0\x02data\xff\xd9"
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    for data, kind in ((png, "image/png"), (wave, "audio/wav"), (archive, "application/zip"), (gif, "image/gif"), (bmp, "image/bmp"), (jpeg, "image/jpeg"), (pdf, "application/pdf")):
        assert media.sniff(data, "image/jpeg")[:2] == (kind, kind != "image/jpeg")
        assert [(f.kind, f.start, f.end) for f in media.carve(b"noise" + data + b"BM RIFF \xff\xd8\xff")] == [(kind, 5, 5 + len(data))]
        assert not media.carve(data[:-1]), kind
    broken = png[:20] + b"!" + png[21:]
    assert media.sniff(broken, "image/png") == (None, True, [])
    table = spark.createDataFrame([(1, b"a" + png + wave, "text/plain"), (2, None, None), (3, png, "image/gif")], "doc_id long, media binary, declared string")
    found = {r.doc_id: r for r in media.sniff_media(table).collect()}
    assert [(e.type, bytes(e.content)) for e in found[1].embedded] == [("image/png", png), ("audio/wav", wave)] and found[1].media_type == "text/plain"
    assert found[2].media_type is None and not found[2].corrected and found[2].embedded == []
    assert found[3].media_type == "image/png" and found[3].corrected
    assert media.store_texts(rows(spark, ["hi"])).first().n_bytes == 2


def test_account_boundaries():
    found = lambda t: [t[a:b] for a, b, k in pii.spans(t) if k == "account"]
    for t, want in (
        ("account number 12345678", ["12345678"]),
        ("account no 1234567", ["1234567"]),
        ("my account has 12345 points", []),
        ("account 2024-05-01", []),
        ("Account Number: 12345678", ["12345678"]),
        ("Customer ID: AB123456", ["AB123456"]),
        ("passport number X1234567 ok", ["X1234567"]),
        ("IBAN GB29 NWBK 6016 1331 9268 19 thanks", ["GB29 NWBK 6016 1331 9268 19"]),
        ("iban DE00 0000 0000 0000 0000 00", []),
        ("iban", []),
        ("account ", []),
        ("account " + "1" * 100_000, []),
    ):
        assert found(t) == want, t
