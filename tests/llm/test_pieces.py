import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as format_

from corrie.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODE = pieces.Pieces(open(PATH, "rb").read())
TEXTS = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
ODD = ["", " ", "   ", "a  b   c", "\n\tx", "日本語 テキスト", "\U0001f642 ok", "\x00\x01", "é x", "Ωmega", "🇩🇪"]


def unigram():
    """The library's own unigram encoder over the same pieces and scores."""
    proto = format_.ModelProto.FromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def total(ids):
    byte = set(CODE.by_number)
    return sum(CODE.scores[i] for i in ids if i not in byte)


def test_words_equal_the_library():
    library = unigram()
    words = sorted({w for t in TEXTS for w in t.split()})[:20000]
    for w, ids in zip(words, library.encode(words), strict=True):
        assert CODE.encode(w).tolist() == ids or total(CODE.encode(w)) > total(ids), w


def test_viterbi_equals_all_segmentations():
    trie = CODE.trie
    rng = random.Random(1)
    known = {n: CODE.scores[i] for i, n in enumerate(CODE.names) if i not in CODE.by_number and i > 2}

    def best(s):
        table = [0.0]
        for end in range(1, len(s) + 1):
            options = [table[a] + known[s[a:end]] for a in range(end) if s[a:end] in known]
            options += [table[end - 1] + CODE.unknown_score] if s[end - 1] not in known else []
            table.append(max(options))
        return table[-1]

    for _ in range(3000):
        s = "".join(rng.choice("theaningor▁▁éຎst") for _ in range(rng.randint(1, 12)))
        ids = CODE.encode(s).tolist()
        s = "▁" + s
        lost = sum(1 for c in s if c not in known)
        assert total(ids) + lost * CODE.unknown_score == best(s), s
    for n, i in [(n, i) for i, n in enumerate(CODE.names) if n in known][::97]:
        assert (len(n.encode()), i) in trie.prefixes(n.encode() + b"x", 0)


def test_decoding_equals_the_library():
    library = unigram()
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([*range(3, 259), *range(259, 32000, 50)]) for _ in range(rng.randint(0, 20))]
        assert CODE.decode(ids) == library.decode(ids)
    for t in TEXTS[:50] + ODD:
        assert CODE.decode(CODE.encode(t)) == t


def test_rows(spark):
    texts = [None, *ODD, "a▁b", *TEXTS[:20]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pieces string")
    found = pieces.piece_digest(docs, PATH).orderBy("doc_id").collect()
    for r, t in zip(found, texts, strict=True):
        ids = CODE.encode(t or "")
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        assert r.round_trip == ("▁" not in (t or ""))
    encoded = pieces.encode_texts(docs, PATH)
    back = pieces.decode_pieces(encoded, PATH).orderBy("doc_id").collect()
    assert [r.text for r in back] == [(t or "").replace("▁", " ") for t in texts]
    assert pieces.piece_digest(docs.limit(0), PATH).count() == 0
    assert np.array_equal(encoded.orderBy("doc_id").collect()[-1].pieces, CODE.encode(texts[-1]))
