"""Media columns: store payloads as media, sniff signatures, correct declared types, carve embedded media.

An Aho-Corasick automaton over all magic numbers finds where media may begin; the format's validator then
walks the structure and gives the length, so a magic number in noise is dropped. The stored form is a
RIFF/WAVE file of unsigned 8-bit mono samples, one sample a byte, which is lossless.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corrie.llm.common import id_type, map_arrow, texts_of

UNIT = 576
RATE = 8000

# The magic numbers of the formats that are recognised.
MAGIC = {
    "image/png": [b"\x89PNG\r\n\x1a\n"],
    "image/gif": [b"GIF87a", b"GIF89a"],
    "image/jpeg": [b"\xff\xd8\xff"],
    "image/bmp": [b"BM"],
    "audio/wav": [b"RIFF"],
    "application/zip": [b"PK\x03\x04"],
    "application/pdf": [b"%PDF-"],
}


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for m in magics:
            found.add_word(m.decode("latin-1"), (kind, len(m)))
    found.make_automaton()
    return found


def png(b: bytes, at: int) -> int | None:
    """Chunks with right checksums, from IHDR to IEND."""
    place, first = at + 8, True
    while place + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, place)
        end = place + 12 + size
        if end > len(b) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(memoryview(b)[place + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        place, first = end, False
    return None


def gif(b: bytes, at: int) -> int | None:
    """Screen, colour tables, extension and image blocks up to the trailer."""
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(place: int) -> int | None:
        while place < len(b):
            if not b[place]:
                return place + 1
            place += 1 + b[place]
        return None

    while place is not None and place < len(b):
        if b[place] == 0x3B:
            return place + 1
        if b[place] == 0x21:
            place = blocks(place + 2)
        elif b[place] == 0x2C and place + 10 < len(b):
            local = b[place + 9]
            place = blocks(place + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
        else:
            return None
    return None


def jpeg(b: bytes, at: int) -> int | None:
    """Marker segments up to the scan, then the end marker."""
    place, frame = at + 2, False
    while place + 4 <= len(b) and b[place] == 0xFF:
        marker = b[place + 1]
        size = int.from_bytes(b[place + 2 : place + 4], "big")
        if size < 2 or marker in (0x00, 0xD8, 0xD9):
            return None
        place += 2 + size
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        if marker == 0xDA:
            end = b.find(b"\xff\xd9", place) if frame else -1
            return end + 2 if end >= 0 else None
    return None


def bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    right = not zero and header in (40, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if right and 14 + header <= offset <= size <= len(b) - at else None


def wav(b: bytes, at: int) -> int | None:
    """A RIFF of type WAVE whose chunks fill its length, with fmt before data."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    place, names = at + 12, []
    while place + 8 <= end <= len(b):
        name, size = struct.unpack_from("<4sI", b, place)
        names.append(name)
        place += 8 + size + size % 2
    fine = place == end and b"fmt " in names and b"data" in names and names.index(b"fmt ") < names.index(b"data")
    return end if fine else None


def archive(b: bytes, at: int) -> int | None:
    """Ends with the end-of-directory record whose directory lies where it says."""
    place = at
    while (place := b.find(b"PK\x05\x06", place + 4)) >= 0 and place + 22 <= len(b):
        size, offset, comment = struct.unpack_from("<IIH", b, place + 12)
        if at + offset + size == place and (not size or b[at + offset : at + offset + 4] == b"PK\x01\x02"):
            end = place + 22 + comment
            return end if end <= len(b) else None
    return None


def document(b: bytes, at: int) -> int | None:
    """A version, a startxref and the last end-of-file mark."""
    if not b[at + 5 : at + 6].isdigit() or (x := b.find(b"startxref", at)) < 0 or (end := b.find(b"%%EOF", x)) < 0:
        return None
    return end + 5


VALIDATORS = {"image/png": png, "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "audio/wav": wav, "application/zip": archive, "application/pdf": document}


def carve(data: bytes) -> list[Found]:
    """Every valid media object, leftmost first; objects inside another one are part of it."""
    found: list[Found] = []
    free = 0
    for last, (kind, size) in automaton().iter(data.decode("latin-1")):
        at = last + 1 - size
        if at >= free and (end := VALIDATORS[kind](data, at)):
            found.append(Found(kind, at, end))
            free = end
    return found


def sniff(data: bytes, declared: str | None) -> tuple[str | None, bool, list[Found]]:
    """The true type (the declared one if nothing speaks against it), whether it was corrected, and what is embedded."""
    found = carve(data)
    if found and not found[0].start:
        return found[0].kind, found[0].kind != declared, found[1:]
    return (None if declared in MAGIC else declared), declared in MAGIC, found


def payload(text: str) -> bytes:
    """UTF-8, filled with bytes 255 to a positive multiple of 576."""
    raw = text.encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(samples: bytes) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples) + len(samples) % 2) + head + samples + b"\0" * (len(samples) % 2)


def load(stored: bytes) -> bytes:
    """The samples of a WAVE file, found by walking its chunks."""
    if wav(stored, 0) is None:
        raise ValueError("not a WAVE file")
    place = 12
    while True:
        name, size = struct.unpack_from("<4sI", stored, place)
        if name == b"data":
            return stored[place + 8 : place + 8 + size]
        place += 8 + size + size % 2


def store_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes`` and ``media`` (the stored form); null counts as empty."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, text)
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([store(payload(t)) for t in texts], pa.binary())], [id_column, "n_bytes", "media"])

    return map_arrow(docs, [id_column, text], make, f"`{id_column}` {id_type(docs, id_column)}, n_bytes long, media binary")


def sniff_media(table: DataFrame, media: str = "media", declared: str = "declared", id_column: str = "doc_id") -> DataFrame:
    """The id, ``media_type`` (corrected), ``corrected`` and ``embedded`` (type, start, end, content) of each row.

    Null media count as empty: no type is found and nothing is embedded.
    """
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.binary())]))

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [x or b"" for x in batch.column(1).to_pylist()]
        seen = [sniff(d, k) for d, k in zip(data, batch.column(2).to_pylist(), strict=True)]
        inside = [[{"type": f.kind, "start": f.start, "end": f.end, "content": d[f.start : f.end]} for f in s[2]] for d, s in zip(data, seen, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in seen], pa.string()), pa.array([s[1] for s in seen]), pa.array(inside, kind)], [id_column, "media_type", "corrected", "embedded"])

    return map_arrow(table, [id_column, media, declared], look, f"`{id_column}` {id_type(table, id_column)}, media_type string, corrected boolean, embedded array<struct<type:string,start:long,end:long,content:binary>>")


def media_digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as media, read it back, sniff and carve it, and give digests of all of it.

    ``feature`` is the stored form's sniffed type, the spread of the samples (sum, least, most) and the
    media carved from them (type:start:end). Null and empty texts give one unit of bytes 255; repeated
    rows each get their row; other columns are not carried. Storing and reading run inside one task, so
    no media cross between JVM and Python.
    """
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    longs, texts_ = pa.int64(), pa.string()

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in texts_of(batch, text):
            media = store(payload(t))
            kind, _, _ = sniff(media, "application/octet-stream")
            back = load(media)
            carved = ",".join(f"{f.kind}:{f.start}:{f.end}" for f in carve(back))
            samples = np.frombuffer(back, np.uint8)
            feature = f"{kind};sum={samples.sum(dtype=np.int64)};min={samples.min()};max={samples.max()};carved={carved}"
            size = len(t) if t.isascii() else len(t.encode())
            rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = [*zip(*rows, strict=True)] or [[]] * 7
        types = [longs, longs, texts_, longs, longs, texts_, texts_]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names)

    return map_arrow(docs, [id_column, text], digest, f"`{id_column}` {id_type(docs, id_column)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
