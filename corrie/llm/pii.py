"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL schemes and cues that name
an account. From each anchor a small deterministic parser expands to the boundaries and validates. Every
character is expanded a bounded number of times, so texts of any length or make-up take linear time.

Kinds. The base ones are those of these patterns, leftmost and non-overlapping per kind, failing matches
dropped without a retry: ``email`` ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ``ip`` four
dotted numbers, each at most 255; ``card`` 14 to 19 digits with single spaces or hyphens, passing Luhn;
``phone`` a plus sign and 10 to 15 digits. Added ones are ``url`` (scheme to the end of the address) and
``account`` (after a cue: an IBAN that passes mod 97, or an identifier of 6 to 34 letters and digits, at least 4 of
them digits, that is no date).
"""

from __future__ import annotations

import string
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrie.llm.common import id_type, map_arrow, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account number", "account no", "account", "acct", "ssn", "passport", "customer id", "kontonummer")

#: Words that may stand between a cue and its identifier.
FILLERS = ("number", "nummer", "no", "nr", "id", "code")
DATE = regex.compile(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}")
#: ASCII capitals to small letters: cues and schemes are found in any casing, and places stay the same.
LOWER = {ord(c): ord(c.lower()) for c in string.ascii_uppercase}

DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | set("._%+-")
LABEL = ALNUM | {"-"}
PHONE = DIGITS | set(" ().-")
URL = ALNUM | set("-._~:/?#[]@!$&'()*+,;=%")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    for mark, kind in (("@", "at"), ("+", "plus")):
        found.add_word(mark, (kind, 1))
    for words, kind in ((SCHEMES, "scheme"), (CUES, "cue")):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that begins at a place."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around an at-sign, from ``floor`` on."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = label = run(text, at + 1, LABEL)
    if start == at or label == at + 1:
        return None
    while end < len(text) and text[end] == "." and (after := run(text, end + 1, LABEL)) > end + 1:
        end = after
    return (start, end) if end > label else None


def dotted(text: str, start: int, end: int) -> int | None:
    """End of the dotted quad whose first number is ``start:end``."""
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (after := run(text, end + 1, DIGITS)) == end + 1:
            return None
        end = after
    return end


def small(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) < 3 or len(number) == 3 and number <= "255"


def grouped(text: str, start: int) -> int:
    """End of the digits with single spaces or hyphens between them that begin at a digit."""
    end, n = start + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def telephone(text: str, at: int) -> int | None:
    """End of the number that begins with the plus sign at ``at``."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 else None


def address(text: str, start: int, body: int) -> int | None:
    """End of the URL whose scheme ends at ``body``; closing punctuation is left out."""
    end = run(text, body, URL)
    while end > body and text[end - 1] in ".,;:!?'()[]":
        end -= 1
    return end if end > body else None


def past(text: str, at: int) -> int:
    """The place after at most four separators."""
    end = at
    while end < len(text) and end < at + 4 and text[end] in " :#=.-":
        end += 1
    return end


def mod97(account: str) -> bool:
    """The check of an international bank account number: two letters, two digits, up to 30 more of either."""
    account = account.upper()
    if not (15 <= len(account) <= 34 and account[:2].isalpha() and account[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def identifier(text: str, low: str, at: int, cue: str) -> tuple[int, int] | None:
    """The account identifier that a cue ending at ``at`` names: past separators and a word such as "number".

    After an IBAN cue, groups of letters and digits with single spaces, as many as pass mod 97. Otherwise one
    run that has a digit, and digit groups joined to it by single spaces or hyphens; dates are refused.
    """
    start = past(text, at)
    for word in FILLERS:
        if low.startswith(word, start) and text[start + len(word) : start + len(word) + 1] not in ALNUM:
            start = past(text, start + len(word))
            break
    if start == at or start >= len(text) or text[start] not in ALNUM:
        return None
    ends = [run(text, start, ALNUM)]
    while ends[-1] - start < 43 and ends[-1] + 1 < len(text) and text[ends[-1]] in " -" and text[ends[-1] + 1] in ALNUM:
        if cue != "iban" and text[ends[-1] + 1] not in DIGITS:
            break
        ends.append(run(text, ends[-1] + 1, ALNUM))
    body = lambda end: "".join(c for c in text[start:end] if c in ALNUM) if end - start <= 64 else ""
    if cue == "iban":
        return next(((start, end) for end in reversed(ends) if mod97(body(end))), None)
    said = body(ends[-1])
    if DIGITS.isdisjoint(text[start : ends[0]][:64]) or DATE.fullmatch(text, start, ends[-1]):
        return None
    return (start, ends[-1]) if 6 <= len(said) <= 34 and sum(c in DIGITS for c in said) >= 4 else None


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    #: Where the next match of each kind may begin; the digit run that the ip parser has been through.
    mail = ip = card = phone = url = account = runs = 0
    n, low = len(text), text.translate(LOWER)
    for last, (anchor, size) in automaton().iter(low):
        at = last + 1 - size
        if anchor == "digit":
            if at >= card:
                card = grouped(text, at)
                if card > at + 1:
                    digits = [c for c in text[at:card] if c in DIGITS]
                    if 14 <= len(digits) <= 19 and luhn("".join(digits)):
                        found.append((at, card, "card"))
            if at >= runs:
                runs = run(text, at, DIGITS)
                if runs < n and text[runs] == "." and (end := dotted(text, at, runs)):
                    ip = runs = end
                    if all(map(small, text[at:ip].split("."))):
                        found.append((at, ip, "ip"))
        elif anchor == "at":
            if hit := email(text, at, mail):
                mail = hit[1]
                found.append((*hit, "email"))
        elif anchor == "plus":
            if at >= phone and (end := telephone(text, at)):
                phone = end
                if 10 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    found.append((at, end, "phone"))
        elif anchor == "scheme":
            if at >= url and (at == 0 or text[at - 1] not in ALNUM) and (end := address(text, at, at + size)):
                url = end
                found.append((at, end, "url"))
        elif (at == 0 or text[at - 1] not in ALNUM) and (hit := identifier(text, low, at + size, low[at : at + size])) and hit[0] >= account:
            account = hit[1]
            found.append((*hit, "account"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; where spans overlap, their union by the first one's."""
    out, at, i = [], 0, 0
    while i < len(found):
        start, end, kind = found[i]
        while (i := i + 1) < len(found) and found[i][0] < end:
            end = max(end, found[i][1])
        out += (text[at:start], f"[{kind.upper()}]")
        at = end
    return "".join((*out, text[at:]))


def pii_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``kind_spans`` (array of kind, start, end in code points), by start.

    Null and empty texts have no spans; repeated rows each get their row; null ids are kept; other
    columns are not carried. Map-only.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans(t)] for t in texts_of(batch, text)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [id_column, "kind_spans"])

    return map_arrow(docs, [id_column, text], find, f"`{id_column}` {id_type(docs, id_column)}, kind_spans array<struct<kind:string,start:long,end:long>>")


def is_kind(kind: str):
    return lambda k: k == kind


def pii_digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The digest columns of ``pii_spans``: base counts, ``base_sha256`` and ``spans``."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("kind_spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        id_column,
        *(F.size(F.filter(F.col("kind_spans.kind"), is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.concat_ws(",", F.transform(base, said)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("kind_spans", said)).alias("spans"),
    )


def mask_pii(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The input with every span in ``text`` replaced by its kind in brackets; ``length``, if there, recounted.

    All columns and rows stay, in their order and types; a null text stays null.
    """

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        texts = [None if t is None else masked(t, spans(t)) for t in batch.column(at).to_pylist()]
        columns = batch.columns
        columns[at] = pa.array(texts, pa.string())
        if (n := batch.schema.get_field_index(length)) >= 0:
            columns[n] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[n].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return map_arrow(docs, [f"`{c}`" for c in docs.columns], mask, schema)
