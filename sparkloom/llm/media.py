"""Signature sniffing of binary columns.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass;
a validator for each format then confirms structure and works out the length.
A confirmed object at offset 0 corrects the declared type; confirmed objects
further inside are carved out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick



class Data:
    """Bytes, and the places of marks in them, looked for once however many objects ask."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.places: dict[bytes, list[int]] = {}
        self.archives: dict[int, int] | None = None

    def where(self, mark: bytes) -> list[int]:
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.raw)]
        return self.places[mark]

    def archive_ends(self) -> dict[int, int]:
        """Start of a ZIP archive -> its end, by the first end record that tells that start."""
        if self.archives is None:
            self.archives, d = {}, self.raw
            for e in self.where(b"PK\5\6"):
                if e + 22 <= len(d):
                    size, start, note = struct.unpack_from("<IIH", d, e + 12)
                    at = e - size - start
                    if at >= 0 and e + 22 + note <= len(d) and (size == 0 or d[at + start : at + start + 4] == b"PK\1\2"):
                        self.archives.setdefault(at, e + 22 + note)
        return self.archives


#: Gives the length of the object at a place, if there is one.
Validator = Callable[[Data, int], "int | None"]


def _png(data: Data, at: int) -> int | None:
    d = data.raw
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def _jpeg(data: Data, at: int) -> int | None:
    d = data.raw
    p, frame = at + 2, False
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind = d[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        n = int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2 or kind < 0xC0:
            return None
        frame |= kind in (0xC0, 0xC1, 0xC2)
        p += 2 + n
        if kind == 0xDA:
            if not frame:
                return None
            while p + 1 < len(d):  # entropy-coded data up to a marker that is neither stuffing nor a restart
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return None
                if d[p + 1] == 0xD9:
                    return p + 2 - at
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return None


def _gif(data: Data, at: int) -> int | None:
    d = data.raw
    if at + 13 > len(d):
        return None
    width, height, flags = struct.unpack_from("<HHB", d, at + 6)
    p, seen = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), False
    if not width or not height:
        return None
    while p < len(d):
        mark = d[p]
        if mark == 0x3B:
            return p + 1 - at if seen else None
        if mark == 0x2C and p + 11 <= len(d):
            local = d[p + 9]
            p, seen = p + 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1, True
        elif mark == 0x21:
            p += 2
        else:
            return None
        while p < len(d) and d[p]:
            p += 1 + d[p]
        p += 1
    return None


def _bmp(data: Data, at: int) -> int | None:
    d = data.raw
    if at + 30 > len(d):
        return None
    n, _, offset, header = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    fine = header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= n
    return n if fine and at + n <= len(d) else None


def _riff(kind: bytes, first: tuple[bytes, ...]) -> Validator:
    def check(data: Data, at: int) -> int | None:
        d = data.raw
        if at + 20 > len(d) or d[at + 8 : at + 12] != kind or d[at + 12 : at + 16] not in first:
            return None
        end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
        p = at + 12
        while p + 8 <= end <= len(d):
            n = struct.unpack_from("<I", d, p + 4)[0]
            p += 8 + n + (n & 1)
        return end - at if p in (end, end + 1) and end <= len(d) else None

    return check


def _pdf(data: Data, at: int) -> int | None:
    d = data.raw
    if not d[at + 5 : at + 6].isdigit() or d[at + 6 : at + 7] != b".":
        return None
    ends, heads, tables = data.where(b"%%EOF"), data.where(b"%PDF-"), data.where(b"startxref")
    first = bisect_left(ends, at)
    if first == len(ends):
        return None
    # up to the last end mark before the next document
    after = bisect_left(heads, ends[first])
    end = ends[bisect_left(ends, heads[after]) - 1] if after < len(heads) else ends[-1]
    table = bisect_right(tables, at)
    return end + 5 - at if table < len(tables) and tables[table] + 9 <= end else None


def _gzip(data: Data, at: int) -> int | None:
    d = data.raw
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    unpack, p = zlib.decompressobj(31), at
    try:
        while not unpack.eof and p < len(d):
            part = d[p : p + 65536]
            while part and not unpack.eof:
                unpack.decompress(part, 1 << 20)
                part = unpack.unconsumed_tail
            p += 65536
    except zlib.error:
        return None
    return min(p, len(d)) - len(unpack.unused_data) - at if unpack.eof else None


def _zip(data: Data, at: int) -> int | None:
    end = data.archive_ends().get(at)
    return None if end is None else end - at


def _ogg(data: Data, at: int) -> int | None:
    d = data.raw
    p, last = at, False
    while p + 27 <= len(d) and d[p : p + 5] == b"OggS\0":
        table = d[p + 27 : p + 27 + d[p + 26]]
        q = p + 27 + d[p + 26] + sum(table)
        if len(table) < d[p + 26] or q > len(d):
            break
        last |= bool(d[p + 5] & 4)
        p = q
    return p - at if p > at and last else None


def _mp4(data: Data, at: int) -> int | None:
    d = data.raw
    p, kinds = at, []
    while p + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if n == 1 and p + 16 <= len(d):
            n = struct.unpack_from(">Q", d, p + 8)[0]
        if n < 8 or p + n > len(d) or not all(32 <= c < 127 for c in kind):
            break
        kinds.append(kind)
        p += n
    return p - at if kinds[:1] == [b"ftyp"] and {b"moov", b"mdat", b"moof"} & set(kinds) else None


def _flac(data: Data, at: int) -> int | None:
    d = data.raw
    p, first = at + 4, True
    while p + 4 <= len(d):
        kind, n = d[p], int.from_bytes(d[p + 1 : p + 4], "big")
        if (first and (kind & 127 or n != 34)) or p + 4 + n > len(d):
            return None
        p, first = p + 4 + n, False
        if kind & 128:  # frames have no length, they run to the end of the data
            return len(d) - at if p + 2 <= len(d) and d[p] == 0xFF and d[p + 1] & 0xFC == 0xF8 else None
    return None


#: magic bytes, their offset in the object, type, validator
FORMATS: list[tuple[bytes, int, str, Validator]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"RIFF", 0, "audio/wav", _riff(b"WAVE", (b"fmt ", b"JUNK", b"bext"))),
    (b"RIFF", 0, "image/webp", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"RIFF", 0, "video/avi", _riff(b"AVI ", (b"LIST",))),
    (b"OggS\0", 0, "audio/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\3\4", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for k, (magic, *_) in enumerate(FORMATS):
        found.setdefault(magic.decode("latin-1"), []).append(k)
    a = ahocorasick.Automaton()
    for magic, ks in found.items():
        a.add_word(magic, (len(magic), tuple(ks)))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed object, outermost only, in order."""
    marked, out, free = Data(data), [], 0
    hits = []
    for end, (n, ks) in _automaton().iter(data.decode("latin-1")):
        hits += [(end - n + 1 - FORMATS[k][1], k) for k in ks]
    for at, k in sorted(hits):
        if at >= free and at >= 0 and (length := FORMATS[k][3](marked, at)):
            out.append((at, length, FORMATS[k][2]))
            free = at + length
    return out


def true_type(data: bytes, declared: str | None = None) -> str:
    """The confirmed type of what starts at offset 0, else the declared one unless it names a known format."""
    found = sniff(data)
    if found and found[0][0] == 0:
        return found[0][2]
    return "application/octet-stream" if declared is None or declared in {f[2] for f in FORMATS} else declared


def sniff_media(df: DataFrame, id_col: str, data_col: str, declared_col: str | None = None) -> DataFrame:
    """Correct declared types and carve embedded media.

    One row per input row: ``id``, ``declared``, ``media_type``, ``corrected``, and
    ``objects``, an array of (offset, length, media_type, data) of every confirmed
    object inside.  Null data counts as empty and has no objects; repeated rows
    give a result each; an empty table gives none.  No shuffle.
    """
    plain = pick(df, id=id_col, data=data_col, **({"declared": declared_col} if declared_col else {}))
    shape = f"id {plain.schema['id'].dataType.simpleString()}, declared string, media_type string, corrected boolean, objects array<struct<offset:long,length:long,media_type:string,data:binary>>"
    item = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x or b"" for x in batch.column("data").to_pylist()]
            said = batch.column("declared").to_pylist() if declared_col else [None] * len(data)
            types = [true_type(d, s) for d, s in zip(data, said)]
            objects = [[{"offset": a, "length": n, "media_type": t, "data": d[a : a + n]} for a, n, t in sniff(d)] for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(said, pa.string()), pa.array(types, pa.string()), pa.array([s is not None and s != t for s, t in zip(said, types)], pa.bool_()), pa.array(objects, item)],
                names=["id", "declared", "media_type", "corrected", "objects"],
            )

    return plain.mapInArrow(run, shape)


RATE = 8000


def to_wav(payload: bytes) -> bytes:
    """A mono 8-bit PCM WAV file whose samples are these bytes."""
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(wav: bytes) -> bytes:
    """The samples of the (only) data chunk of a confirmed WAV file."""
    p = 12
    while wav[p : p + 4] != b"data":
        n = struct.unpack_from("<I", wav, p + 4)[0]
        p += 8 + n + (n & 1)
    n = struct.unpack_from("<I", wav, p + 4)[0]
    return wav[p + 8 : p + 8 + n]


def features(media_type: str, samples: bytes, inside: int) -> str:
    """Whole-number features of 8-bit samples: type, count, mean and mean square in thousandths, crossings, spread."""
    x = np.frombuffer(samples, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    square = int(np.dot(c := np.bincount(x, minlength=256).astype(np.int64), np.arange(256, dtype=np.int64) ** 2))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"{media_type};rate={RATE};bits=8;samples={n};mean={total * 1000 // n};square={square * 1000 // n};crossings={crossings};values={int(np.count_nonzero(c))};embedded={inside}"


def store_payloads(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every text stored as 8-bit audio, found again by its signature, read back and described.

    The payload is the UTF-8 text, zero bytes appended up to a positive multiple
    of 64.  One row per input row: ``doc_id``, ``n_bytes``, ``payload_bytes``,
    ``payload_sha256``, ``tail_crc32`` (read back), ``media_bytes``,
    ``media_sha256``, ``feature``.  A null text counts as empty: 64 zero bytes.
    An empty table gives no rows.  No shuffle.
    """
    plain = pick(df, doc_id=id_col, text=text_col)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column("text"):
                raw = (v.as_py() or "").encode()
                wav = to_wav(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
                (at, size, kind), *_ = sniff(wav)
                if at or size != len(wav) or kind != "audio/wav":
                    raise ValueError("a stored payload isn't recognised")
                back = wav_samples(wav)
                inside = len(sniff(back))
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), features(kind, back, inside)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=["doc_id", *names])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
