"""Media columns: signature sniffing, type correction and carving.

One Aho-Corasick pass over a stored value finds the magic bytes of every known
format and the marks that end some; a validator then checks structure and
lengths from that place on. What starts at 0 is the value's true type, whatever
was declared; what is valid further inside is carved, outermost objects only.
End marks are found once and chains of segments are walked once, so repeated
magic bytes don't make a value's work grow with its square.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from .common import column, packed, utf8

UNKNOWN = "application/octet-stream"
_RATE = 8000


#: Marks that validators look for behind a place.
_END_ZIP, _END_PDF, _START_PDF, _END_JPEG = b"PK\x05\x06", b"%%EOF", b"startxref", b"\xff\xd9"
_ZERO = b"\0"
#: Bytes that are inflated at a time.
_STEP = 4096


class Value:
    """A value, the places of its end marks in order, and what is known of its chains of segments."""

    def __init__(self, data: bytes):
        self.data, self.ends, self.known = data, {m: [] for m in (_END_ZIP, _END_PDF, _START_PDF, _END_JPEG)}, {}

    def next(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, or -1."""
        if mark not in self.ends:  # asked for by few values
            self.ends[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        places = self.ends[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def chain(self, kind: str, at: int, step: Callable[[int], tuple[int, int]]) -> int:
        """Where the chain from ``at`` ends (0: it breaks). ``step`` gives (next place, 0) or (0, result); a place is walked once."""
        walked = []
        while (result := self.known.get((kind, at))) is None:
            walked.append(at)
            at, result = step(at)
            if not at:
                break
        self.known.update(((kind, x), result) for x in walked)
        return result


def _riff(form: bytes) -> Callable[[Value, int], int]:
    def check(v: Value, at: int) -> int:
        b = v.data
        if len(b) < at + 12 or b[at + 8 : at + 12] != form:
            return 0
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        if end > len(b):
            return 0

        def step(pos: int) -> tuple[int, int]:
            if pos >= end:
                return 0, pos
            if pos + 8 > end:
                return 0, 0
            n = int.from_bytes(b[pos + 4 : pos + 8], "little")
            return pos + 8 + n + (n & 1), 0

        return end - at if v.chain(f"riff{end}", at + 12, step) == end else 0

    return check


def _png(v: Value, at: int) -> int:
    b = v.data

    def step(pos: int) -> tuple[int, int]:
        if pos + 12 > len(b):
            return 0, 0
        n = int.from_bytes(b[pos : pos + 4], "big")
        if pos + 12 + n > len(b):
            return 0, 0
        return (0, pos + 12 + n) if b[pos + 4 : pos + 8] == b"IEND" else (pos + 12 + n, 0)

    if b[at + 8 : at + 16] != b"\x00\x00\x00\x0dIHDR":
        return 0
    end, pos = v.chain("png", at + 8, step), at + 8
    while end and pos < end:  # lengths first, checksums of what reaches an end
        n = int.from_bytes(b[pos : pos + 4], "big")
        if zlib.crc32(memoryview(b)[pos + 4 : pos + 8 + n]) != int.from_bytes(b[pos + 8 + n : pos + 12 + n], "big"):
            return 0
        pos += 12 + n
    return end - at if end else 0


def _jpeg(v: Value, at: int) -> int:
    b = v.data

    def step(pos: int) -> tuple[int, int]:
        if pos + 4 > len(b) or b[pos] != 0xFF:
            return 0, 0
        n = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if n < 2:
            return 0, 0
        if b[pos + 1] == 0xDA:
            return 0, v.next(_END_JPEG, pos + 2 + n) + 2
        return pos + 2 + n, 0

    end = v.chain("jpeg", at + 2, step)
    return end - at if end > at + 2 else 0


def _gif(v: Value, at: int) -> int:
    b = v.data

    def step(pos: int) -> tuple[int, int]:
        if pos >= len(b):
            return 0, 0
        if b[pos] == 0x3B:
            return 0, pos + 1
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos += 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1
        else:
            return 0, 0
        pos = v.chain("blocks", pos, blocks)
        return (pos, 0) if pos else (0, 0)

    def blocks(pos: int) -> tuple[int, int]:
        if pos >= len(b):
            return 0, 0
        return (pos + 1 + b[pos], 0) if b[pos] else (0, pos + 1)

    if len(b) < at + 14:
        return 0
    flags = b[at + 10]
    end = v.chain("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), step)
    return end - at if end else 0


def _bmp(v: Value, at: int) -> int:
    b = v.data
    if len(b) < at + 26:
        return 0
    size, start, head = int.from_bytes(b[at + 2 : at + 6], "little"), int.from_bytes(b[at + 10 : at + 14], "little"), int.from_bytes(b[at + 14 : at + 18], "little")
    return size if b[at + 6 : at + 10] == bytes(4) and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(b) - at else 0


def _pdf(v: Value, at: int) -> int:
    end, table = (v.ends[_END_PDF] or [-1])[-1], v.next(_START_PDF, at)
    return end + 5 - at if at <= table and table + len(_START_PDF) <= end else 0


def _gzip(v: Value, at: int) -> int:
    b = v.data
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    flags, pos = b[at + 3], at + 10
    if flags & 4:
        pos += 2 + int.from_bytes(b[pos : pos + 2], "little")
    for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):  # a name and a comment, each up to a zero byte
        pos = v.next(_ZERO, pos) + 1
        if not pos:
            return 0
    pos += 2 if flags & 2 else 0
    d, crc, size, view = zlib.decompressobj(-15), 0, 0, memoryview(b)
    try:
        while not d.eof and pos < len(b):
            out = d.decompress(view[pos : pos + _STEP])
            crc, size, pos = zlib.crc32(out, crc), size + len(out), pos + _STEP
    except zlib.error:
        return 0
    end = min(pos, len(b)) - len(d.unused_data)
    return end + 8 - at if d.eof and b[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else 0


def _zip(v: Value, at: int) -> int:
    b, end = v.data, v.next(_END_ZIP, at)
    if end < 0 or len(b) < end + 22:
        return 0
    size, start = struct.unpack_from("<II", b, end + 12)
    return end + 22 + int.from_bytes(b[end + 20 : end + 22], "little") - at if at + start + size == end else 0


#: Magic bytes, media type and validator (length of the valid object at a place, or 0).
FORMATS: tuple[tuple[bytes, str, Callable[[Value, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff(b"WAVE")),
    (b"RIFF", "image/webp", _riff(b"WEBP")),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
)
_machine = None


def _automaton():
    global _machine
    if _machine is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        by: dict[bytes, list[int]] = {}
        for i, (magic, _, _) in enumerate(FORMATS):
            by.setdefault(magic, []).append(i)
        for magic, which in by.items():
            a.add_word(magic.decode("latin-1"), (magic, tuple(which)))
        for mark in Value(b"").ends:
            a.add_word(mark.decode("latin-1"), (mark, ()))
        a.make_automaton()
        _machine = a
    return _machine


def sniff(blob: bytes | None, carve: bool = True) -> tuple[str, list[tuple[int, int, str]]]:
    """True type of a value and (offset, length, type) of media embedded in it.

    A valid object at 0 gives the type; null, empty or unknown bytes are
    application/octet-stream. An object within a carved one isn't carved again.
    """
    if not blob:
        return UNKNOWN, []
    value, starts = Value(blob), []
    for end, (magic, which) in _automaton().iter(blob.decode("latin-1")):
        at = end - len(magic) + 1
        if which:
            starts.append((at, which))
        else:
            value.ends[magic].append(at)
    kind, found, over = UNKNOWN, [], 0
    for at, which in starts:
        if at and not carve:
            break
        if at < over:
            continue
        for i in which:
            if size := FORMATS[i][2](value, at):
                if at == 0:
                    kind = FORMATS[i][1]
                else:
                    found.append((at, size, FORMATS[i][1]))
                    over = at + size
                break
    return kind, found


def store(text: bytes) -> tuple[bytes, int]:
    """A WAV file of 8-bit samples that holds the text, zero-padded to a positive multiple of 64, and that length."""
    n = max(1, -(-len(text) // 64)) * 64
    head = b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, _RATE, _RATE, 1, 8) + b"data" + struct.pack("<I", n)
    return head + text + bytes(n - len(text)), n


def samples(wav: bytes) -> bytes:
    """The samples of a WAV file of 8-bit mono sound."""
    pos, kind = 12, None
    while pos + 8 <= len(wav):
        name, n = wav[pos : pos + 4], int.from_bytes(wav[pos + 4 : pos + 8], "little")
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", wav, pos + 8)
        elif name == b"data":
            if kind is None or kind[:2] != (1, 1) or kind[5] != 8:
                raise ValueError("not 8-bit mono samples")
            return wav[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no samples")


def features(data: bytes) -> str:
    """Figures of a sample sequence, as text with fixed decimals."""
    x = np.frombuffer(data, np.uint8)
    hist = np.bincount(x, minlength=256)
    n, v = len(x), np.arange(256)
    mean = float((hist * v).sum()) / n
    power = float((hist * (v - 128) ** 2).sum()) / n
    p = hist[hist > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    cross = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"n={n};mean={mean:.6f};rms={power**0.5:.6f};entropy={entropy:.6f};crossings={cross};peak={int(hist.nonzero()[0][-1])}"


_COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_carved int"


def _media(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blobs = [], []
            for t in utf8(batch.column(1)):
                wav, n = store(t)
                kind, inside = sniff(wav)
                if kind != "audio/wav":
                    raise ValueError("a stored value is not what was stored")
                back = samples(wav)
                rows.append((len(t), n, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), features(back), kind, len(inside)))
                if keep:
                    blobs.append(wav)
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]] + ([pa.array(blobs, pa.binary())] if keep else [])
            yield pa.RecordBatch.from_arrays(arrays, ["__id", *[c.split()[0] for c in _COLUMNS.split(", ")]] + (["media"] if keep else []))

    return run


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """For each row the id as ``__id`` and what is read back from its stored form; ``media`` holds that form if asked for.

    A null text is stored like an empty one: 64 zero samples. Equal texts and
    repeated rows give equal values; very long texts are stored whole, up to the
    4 GB that a WAV header can tell. An empty table gives an empty result; other
    columns, whatever their names, aren't read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_media(keep_media), f"__id {kind}, {_COLUMNS}" + (", media binary" if keep_media else ""))


_CARVED = D.StructType().add("offset", D.LongType()).add("length", D.LongType()).add("media_type", D.StringType()).add("bytes", D.BinaryType())
_FOUND = D.StructType().add("media_type", D.StringType()).add("mislabelled", D.BooleanType()).add("carved", D.ArrayType(_CARVED))


def correct_types(df: DataFrame, content_col: str = "content", declared_col: str = "declared") -> DataFrame:
    """``df`` plus ``media_type`` (as sniffed; as declared if unknown), ``mislabelled`` and ``carved`` (offset, length, media_type, bytes).

    Null or empty content keeps its declared type. Other columns pass through;
    one that carries an output's name comes back with ``_input`` behind it.
    Repeated rows get equal results; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, wrong, carved = [], [], []
            for b, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kind, inside = sniff(b)
                kinds.append(d if kind == UNKNOWN and d else kind)
                wrong.append(kind != UNKNOWN and kind != d)
                carved.append([{"offset": o, "length": n, "media_type": k, "bytes": b[o : o + n]} for o, n, k in inside])
            shape = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("bytes", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(carved, shape)], ["r", *_FOUND.names])

    rows = df.select(packed(df.columns, _FOUND.names), column(content_col).alias("c"), column(declared_col).alias("d"))
    return rows.mapInArrow(run, D.StructType([rows.schema["r"], *_FOUND.fields])).select("r.*", *_FOUND.names)
