"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

The scores decide. A model file that was trained by merging pairs gives its pieces the rank of their merge as
score; Viterbi over those need not give the ids of that model's own merging encoder.

White space is marked by U+2581. The best segmentation is the one with the highest sum of the pieces' log
scores as the model file gives them, in double precision; where two are equal, the one whose last piece is
longer. A character that no piece of its own covers gets the lowest score less 10 and becomes byte pieces.
No piece continues past a marker that follows other text, so each marker run with its word is solved alone
and remembered; a model with such pieces is solved text by text.

The trie lies in two arrays: from state s, byte c leads to ``base[s] + c`` if ``check`` there is s.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as format_

from corrie.llm.common import Memo, id_type, map_arrow, texts_of

MARK = "▁"
#: Added to the lowest score for a character without a piece (the library's fixed penalty).
PENALTY = 10.0
MEMO = 400_000
#: Bytes of a unit from which its Viterbi columns are packed arrays.
LONG_UNIT = 4096
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


class DoubleArray:
    """``base``, ``check`` and ``value`` (piece number or -1) of a byte trie."""

    def __init__(self, keys: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, number in keys.items():
            node = 0
            for c in key:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                    ends.append(-1)
                node = tree[node][c]
            ends[node] = number
        size = 2 * len(tree) + 512
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0], free, hint = 0, 256, 256  # no letter is too large for a place from here on
        queue = [(0, 0)]
        for node, state in queue:
            self.value[state] = ends[node]
            letters = sorted(tree[node])
            if not letters:
                self.base[state] = size  # leads nowhere
                continue
            while self.check[free] >= 0:
                free += 1
            hint = max(hint, free)
            at, tries = (free if len(letters) == 1 else hint) - letters[0], 0
            while any(self.check[at + c] >= 0 for c in letters):
                at += 1
                tries += 1
                if at + 512 > len(self.check):
                    for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        x += [fill] * size
            if tries > 16:  # the places before are too full for several letters; single ones still fill them
                hint = at + letters[0]
            self.base[state] = at
            for c in letters:
                self.check[at + c] = state
                queue.append((tree[node][c], at + c))
        last = max(i for i, c in enumerate(self.check) if c >= 0)
        end = last + 257
        self.base = [b if b <= last else end for b in self.base[: last + 1]] + [end] * 256
        self.check = self.check[: last + 1] + [-1] * (end + 256 - last)
        self.value = self.value[: last + 1] + [-1] * 256

    def prefixes(self, data: bytes, start: int) -> list[tuple[int, int]]:
        """``(end, piece)`` of every piece that begins at ``start``."""
        state, found = 0, []
        base, check, value = self.base, self.check, self.value
        for i in range(start, len(data)):
            to = base[state] + data[i]
            if check[to] != state:
                break
            state = to
            if value[state] >= 0:
                found.append((i + 1, value[state]))
        return found


class Pieces:
    def __init__(self, model: bytes):
        proto = format_.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped white space is handled")
        #: Put before a text that is not empty, and taken off again in decoding.
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.names = [p.piece for p in proto.pieces]
        self.scores = [float(p.score) for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        if USER in kinds:
            raise ValueError("user-defined pieces are not handled")
        usable = {i for i, k in enumerate(kinds) if k == NORMAL}
        self.unknown_score = min(self.scores[i] for i in usable) - PENALTY
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if kinds[i] == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.trie = DoubleArray({self.names[i].encode(): i for i in usable})
        local = all(MARK not in self.names[i].lstrip(MARK) for i in usable)
        self.units = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if local else r"(?s).+")
        self.dtype = np.dtype("<u2" if len(self.names) <= 1 << 16 else "<u4")
        #: What each piece decodes to; byte pieces and the unknown piece are told apart by number.
        self.shown = [n.replace(MARK, " ") for n in self.names]
        for i, k in enumerate(kinds):
            if k == CONTROL:
                self.shown[i] = ""
        self.shown[self.unknown] = proto.trainer_spec.unk_surface
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.by_number = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.zeros(len(self.names), bool)
        self.is_byte[list(self.by_number)] = True
        self.memo = Memo(lambda unit: np.array(self.viterbi(unit), self.dtype).tobytes(), MEMO)

    def viterbi(self, unit: str) -> list[int]:
        data = unit.encode()
        n, low = len(data), float("-inf")
        # packed arrays hold what a long unit needs in 16 bytes a byte; lists are quicker for short ones
        if n > LONG_UNIT:
            best, came, by = array("d", [low]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        else:
            best, came, by = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        at = 0
        while at < n:
            first = data[at]
            following = at + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            here, state, i, alone = best[at], 0, at, False
            while i < n:
                to = base[state] + data[i]
                if check[to] != state:
                    break
                state = to
                i += 1
                piece = value[to]
                if piece >= 0:
                    if i == following:
                        alone = True
                    score = here + scores[piece]
                    if score > best[i]:
                        best[i], came[i], by[i] = score, at, piece
            if not alone and here + self.unknown_score > best[following]:
                best[following], came[following], by[following] = here + self.unknown_score, at, -1
            at = following
        ids, end = [], n
        while end:
            at, piece = came[end], by[end]
            if piece < 0:
                ids += [self.bytes[b] for b in reversed(data[at:end])] if self.bytes else [self.unknown]
            else:
                ids.append(piece)
            end = at
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        units = self.units.findall(self.prefix + text.replace(" ", MARK))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, units)), self.dtype)

    def decode(self, ids) -> str:
        """Text of piece numbers; byte runs are UTF-8, each byte that is not becomes U+FFFD."""
        plain = isinstance(ids, np.ndarray) and not self.is_byte[ids].any()
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        first = next((i for i in ids if i not in self.silent), self.unknown)
        strip = bool(self.prefix) and self.names[first].startswith(MARK)
        if plain or self.by_number.keys().isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))[strip:]
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.by_number:
                run.append(self.by_number[i])
                continue
            out.append(utf8(bytes(run)))
            run.clear()
            if i is not None:
                out.append(self.shown[i])
        return "".join(out)[strip:]


def utf8(data: bytes) -> str:
    """Decode, one U+FFFD for each byte that is no part of a character."""
    return data.decode("utf-8", "surrogateescape").translate({0xDC00 + b: "�" for b in range(128, 256)}) if data else ""


@lru_cache(2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def encode_texts(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and ``pieces`` (array of piece numbers) of each row; null and empty texts have none."""
    data = Path(model).read_bytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([pieces(data).encode(t).astype(np.int32) for t in texts_of(batch, text)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), found], [id_column, "pieces"])

    return map_arrow(docs, [id_column, text], run, f"`{id_column}` {id_type(docs, id_column)}, pieces array<int>")


def decode_pieces(encoded: DataFrame, model: str, id_column: str = "doc_id", column: str = "pieces") -> DataFrame:
    """The id and ``text`` of each row; null lists decode to the empty text."""
    data = Path(model).read_bytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([pieces(data).decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), found], [id_column, "text"])

    return map_arrow(encoded, [id_column, column], run, f"`{id_column}` {id_type(encoded, id_column)}, text string")


def piece_digest(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode it again, and give digests.

    The id, ``n_pieces``, ``n_byte_pieces`` (byte pieces among them), ``ids_crc32`` (unsigned, of little-endian
    32-bit numbers) and ``round_trip``: whether decoding gives the text back, which fails only where the
    text itself has the marker U+2581. Repeated rows each get their row; null texts count as empty.
    """
    data = Path(model).read_bytes()
    names = [id_column, "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = pieces(data)
        rows = []
        for t in texts_of(batch, text):
            ids = code.encode(t)
            rows.append((len(ids), int(np.count_nonzero(code.is_byte[ids])), zlib.crc32(ids.astype("<u4").tobytes()), code.decode(ids) == t))
        columns = [*zip(*rows, strict=True)] or [[]] * 4
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return map_arrow(docs, [id_column, text], run, f"`{id_column}` {id_type(docs, id_column)}, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
