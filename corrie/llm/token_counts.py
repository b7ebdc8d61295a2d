"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers replace the tokenizer library:

* ``Splitter`` reads character classes and marks where pre-tokens begin. Texts are cut into chunks of
  equal width; all chunks of a batch step together through numpy tables, once from every start state.
  That gives a state map for each chunk. The maps are composed by a parallel prefix scan, which yields
  the true start state of each chunk, and a second pass marks the pre-tokens.
* ``WordTransducer`` reads the bytes of one pre-token. Its states are compiled lazily from the merge
  list, and each transition carries the change in the number of tokens. It always starts in the same
  state at a pre-token's begin, so it needs no chunk maps.

Only the layout of ``word_bpe_49k.json`` is compiled: NFC, white space and lower-case normalisers, the
letters/number/other split with English contractions, byte-level symbols and an end-of-word suffix.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corrie.llm.common import id_type, map_arrow, texts_of

#: Character classes of the splitter: white space, number, other, apostrophe, letters that matter in
#: contractions (s t m d, r, v, l, e) and all other letters.
SPACE, NUMBER, OTHER, QUOTE, LETTER, SINGLE, R, V, L, E = range(10)
#: States: boundary, in letters, in others, after a leading apostrophe, and after 'r, 'v, 'l.
START, WORD, MARKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
#: Outputs: a pre-token begins here; one began at the previous character.
HERE, BEFORE = 1, 2
LETTERS = (LETTER, SINGLE, R, V, L, E)

CHUNK = 128
#: Code points of one block of texts that are split together.
BLOCK = 1 << 21
#: Entries of the word memo and states of the word transducer before they are thrown away and rebuilt.
MEMO = 400_000
STATES = 200_000


@lru_cache(1)
def character_classes() -> np.ndarray:
    classes = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            for start, end in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800) + 0x800, m.end() + 0x800)):
                classes[start:end] = kind
    for characters, kind in (("'", QUOTE), ("stmd", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in characters:
            classes[ord(c)] = kind
    return classes


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output, each by state and class."""
    step, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)

    def begin(kind: int) -> int:
        """The state after a pre-token that begins with this class."""
        return START if kind == NUMBER else MARKS if kind == OTHER else QUOTED if kind == QUOTE else WORD

    completes = {QUOTED: (SINGLE,), QUOTED_R: (E,), QUOTED_V: (E,), QUOTED_L: (L,)}
    opens = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}
    for state in range(7):
        held = state in (QUOTED_R, QUOTED_V, QUOTED_L)  # the letter after the apostrophe is not placed yet
        for kind in range(10):
            to, mark = (START, 0) if kind == SPACE else (begin(kind), HERE)
            if state == WORD and kind in LETTERS:
                to, mark = WORD, 0
            elif state in (MARKS, QUOTED) and kind in (OTHER, QUOTE):
                to, mark = MARKS, 0
            elif state in completes and kind in completes[state]:
                to, mark = START, 0
            elif state == QUOTED and kind in opens:
                to, mark = opens[kind], 0
            elif held and kind in LETTERS:
                to, mark = WORD, BEFORE
            elif held:
                mark |= BEFORE
            step[state, kind], out[state, kind] = to, mark
    return step, out


STEP, OUT = splitter_tables()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps, ``(chunk, state)``, under composition."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), 1)
        gap *= 2
    return maps


def begins(codes: np.ndarray, width: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin (boolean for each code point), and the class of each code point."""
    n = len(codes)
    chunks = -(-(n + 1) // width)
    padded = np.full(chunks * width, SPACE, np.uint8)
    padded[:n] = character_classes()[codes]
    kinds = np.ascontiguousarray(padded.reshape(chunks, width).T)
    step, out = STEP.ravel(), OUT.ravel()
    states = np.repeat(np.arange(7, dtype=np.intp)[:, None], chunks, 1)
    for k in range(width):
        states = step.take(states * 10 + kinds[k])
        states = states.astype(np.intp)
    scanned = compose(states.T)
    now = np.zeros(chunks, np.intp)
    now[1:] = scanned[:-1, START]
    marks = np.empty((width, chunks), np.uint8)
    for k in range(width):
        at = now * 10 + kinds[k]
        marks[k] = out.take(at)
        now = step.take(at).astype(np.intp)
    marks = np.ascontiguousarray(marks.T).ravel()
    here = (marks & HERE).astype(bool)
    here[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return here[:n], padded[:n]


def spelled(text: str, codes: np.ndarray, starts: np.ndarray, here: np.ndarray, kinds: np.ndarray) -> list[str]:
    """The pre-tokens as strings."""
    if ((codes >= 0x1C) & (codes <= 0x1F)).any():  # str.split takes these for white space
        stops = np.append(np.flatnonzero(here | (kinds == SPACE)), len(codes))
        ends = stops[np.searchsorted(stops, starts) + 1]
        return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    inside = starts[(starts > 0) & (kinds[starts - 1] != SPACE)]
    return np.insert(codes, inside, 32).tobytes().decode("utf-32-le", "surrogatepass").split()


class WordTransducer:
    """Byte-pair merges as a deterministic transducer over one pre-token's bytes.

    The encoding of a prefix ends with one token only, the one whose neighbours are compatible: a row
    of tokens is what the merges produce exactly if each adjacent pair is. A state holds, for each place
    from which a token may still reach further, the place's trie node, the last token before it and the
    number of tokens before it, relative to now. Transitions carry the change in the number of tokens.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        alphabet = byte_symbols()
        base = {c: i for i, c in enumerate(alphabet)} | {c + suffix: 256 + i for i, c in enumerate(alphabet)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(512)]
        self.pairs: dict[tuple[int, int], int] = {}
        names = dict(base)
        spelled = [(i,) for i in range(512)]
        for left, right in merges:
            token = len(self.parts)
            pair = names[left], names[right]
            names[left + right] = token
            self.parts.append(pair)
            self.pairs[pair] = token
            spelled.append(spelled[pair[0]] + spelled[pair[1]])
        #: Trie: a dict for each node, and the token that ends there.
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, symbols in enumerate(spelled):
            node = 0
            for s in symbols:
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][s]
            self.token[node] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between tokens a and b that stand side by side.

        Undoes merges from the border outwards, latest first; the border falls if, at some time, the two
        tokens beside it had a merge that came before those that consumed them.
        """
        if (known := self.fits.get((a, b))) is not None:
            return known
        if len(self.fits) > 4 * MEMO:
            self.fits.clear()
        key, limit = (a, b), len(self.parts)
        answer = None
        while answer is None:
            merged = self.pairs.get((a, b))
            if merged is not None and merged < limit:
                answer = False
            elif a > b and a >= 512:
                limit, a = a, self.parts[a][1]
            elif b >= 512:
                limit, b = b + 1, self.parts[b][0]
            elif a >= 512:
                limit, a = a, self.parts[a][1]
            else:
                answer = True
        self.fits[key] = answer
        return answer

    def arc(self, state: int, symbol: int) -> tuple[int, int]:
        children, tokens = self.children, self.token
        live, last, total = [], -1, 0
        for node, before, count in self.states[state]:
            node = children[node].get(symbol)
            if node is None:
                continue
            if children[node]:
                live.append((node, before, count))
            token = tokens[node]
            if last < 0 <= token and (before < 0 or self.compatible(before, token)):
                last, total = token, count + 1
        if last < 0:
            raise ValueError("the merges allow no encoding; the vocabulary is not a byte-pair one")
        after = (*[(node, before, count - total) for node, before, count in live], (0, last, 0))
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
        step = self.arcs[state << 9 | symbol] = to, total
        return step

    def final(self, state: int, symbol: int) -> int:
        """The change in the number of tokens by the last symbol, after which nothing can follow."""
        for node, before, count in self.states[state]:
            node = self.children[node].get(symbol)
            if node is not None and (token := self.token[node]) >= 0 and (before < 0 or self.compatible(before, token)):
                return count + 1
        raise ValueError("the merges allow no encoding; the vocabulary is not a byte-pair one")

    def count(self, word: bytes) -> int:
        if len(self.states) > STATES:
            self.reset()
        state = total = 0
        known = self.arcs.get
        for symbol in word[:-1]:
            state, change = known(state << 9 | symbol) or self.arc(state, symbol)
            total += change
        return total + self.final(state, 256 + word[-1])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Words(dict):
    """Token counts by pre-token, filled by the transducer."""

    def __init__(self, transducer: WordTransducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        n = self[word] = self.transducer.count(word.encode())
        return n


class TokenCounter:
    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.words = Words(WordTransducer(model["vocab"], merges, model["end_of_word_suffix"]))

    def normal(self, text: str) -> str:
        """NFC and lower case, one character at a time (no final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.find_special and any(s in text for s in self.special):
                parts = self.find_special.split(text)
                total[i] += len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        pieces = [self.normal(p) for p in pieces]
        start = 0
        while start < len(pieces):
            end, size = start, 0
            while end < len(pieces) and (end == start or size + len(pieces[end]) < BLOCK):
                size += len(pieces[end])
                end += 1
            np.add.at(total, owner[start:end], self.block(pieces[start:end]))
            start = end
        return total

    def block(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece; white space between pieces brings every state to the boundary."""
        joined = " ".join(pieces)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        here, kinds = begins(codes)
        starts = np.flatnonzero(here)
        if not len(starts):
            return np.zeros(len(pieces), np.int64)
        if len(self.words) > MEMO:
            self.words.clear()
        tokens = np.fromiter(map(self.words.__getitem__, spelled(joined, codes, starts, here, kinds)), np.int64, len(starts))
        sums = np.concatenate([[0], np.cumsum(tokens)])
        borders = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        reached = sums[np.searchsorted(starts, borders)]
        return np.diff(reached)


@lru_cache(2)
def counter(definition: str) -> TokenCounter:
    return TokenCounter(definition)


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``tokenizer`` is the path of the tokenizer's definition, read on the driver. A null text counts as
    empty (0 bytes, 0 tokens); repeated rows each get their row; null ids are kept; other columns of the
    input are not carried and cannot clash. Whole texts are read, in blocks. Map-only: no shuffle.
    """
    definition = Path(tokenizer).read_text(encoding="utf-8")
    names = [id_column, "n_bytes", "n_tokens", "over_limit"]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, text)
        n = counter(definition).counts(texts)
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], names)

    return map_arrow(docs, [id_column, text], count, f"`{id_column}` {id_type(docs, id_column)}, n_bytes long, n_tokens long, over_limit boolean")
