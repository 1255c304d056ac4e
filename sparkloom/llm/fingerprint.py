"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes picks chunk boundaries: at block size
``b`` a chunk ends where the hash is ``-1`` modulo ``b``.  Every chunk gives one
of 64 letters, and a fingerprint ``b:letters:letters`` holds the letters at block
sizes ``b`` and ``2b``.  An edit changes the letters near it only, so texts are
compared by the edit distance of letters at equal block sizes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, pick

WINDOW, LEAST, LETTERS = 7, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Unrelated signatures share no run of so many letters.
COMMON = 4
_STEP = 1 << 20


def _rolling(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, rolling hash + 1 at each byte), in blocks."""
    for at in range(0, len(data), _STEP):
        b = np.zeros(min(_STEP, len(data) - at) + WINDOW - 1, np.uint32)
        lo = max(0, at - WINDOW + 1)
        b[WINDOW - 1 - (at - lo) :] = data[lo : at + _STEP]
        n = len(b) - WINDOW + 1
        total, mixed = np.ones(n, np.uint32), np.zeros(n, np.uint32)
        for j in range(WINDOW):
            x = b[WINDOW - 1 - j : WINDOW - 1 - j + n]
            total += x * np.uint32(WINDOW + 1 - j)
            mixed ^= x << np.uint32(5 * j)
        yield at, total + mixed


def _ends(data: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks at block size LEAST * 2**power or more, and the hashes there."""
    places, values = [], []
    mask = np.uint32((1 << power) - 1)
    for at, h in _rolling(data):
        k = np.flatnonzero((h & mask) == 0)
        k = k[h[k] % LEAST == 0]
        places.append(k + at + 1)
        values.append(h[k])
    return (np.concatenate(places), np.concatenate(values)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def _letters(raw: bytes, ends: np.ndarray) -> str:
    """A letter for each chunk; the last one stands for all the rest of the text."""
    cuts = ends[: LETTERS - 1].tolist()
    if not cuts or cuts[-1] < len(raw):
        cuts.append(len(raw))
    at, out = 0, []
    for e in cuts:
        out.append(ALPHABET[zlib.crc32(raw[at:e]) & 63])
        at = e
    if at < len(raw):
        out.append(ALPHABET[zlib.crc32(raw[at:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block size:letters:letters at twice the block size``; the empty text has no letters."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return f"{LEAST}::"
    data, power = np.frombuffer(raw, np.uint8), 0
    while LEAST * 2**power * LETTERS < len(raw):
        power += 1
    low = max(0, power - 3)
    while True:
        ends, h = _ends(data, low)
        while power > low and np.count_nonzero(h % np.uint32(LEAST << power) == 0) < LETTERS // 2:
            power -= 1
        if power > low or low == 0:
            break
        low = max(0, low - 4)
    one, two = (ends[h % np.uint32(LEAST << p) == 0] for p in (power, power + 1))
    return f"{LEAST << power}:{_letters(raw, one)}:{_letters(raw, two)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - edit distance (insertions and deletions) over total length; 0 without a common run of letters."""
    if a == b:
        return 1.0
    k = min(COMMON, len(a), len(b))
    if not k or {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; only signatures at equal block sizes are compared."""
    if x == y:
        return 1.0
    (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
    a, b = int(a), int(b)
    if not a1 or not b1:
        return 0.0
    if a == b:
        return max(_alike(a1, b1), _alike(a2, b2))
    return _alike(a2, b1) if b == 2 * a else _alike(a1, b2) if a == 2 * b else 0.0


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; null texts count as empty.  No shuffle."""
    plain = pick(df, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints = [], []
            for v in batch.column("text"):
                t = v.as_py() or ""
                n.append(len(t))
                prints.append(fingerprint(t))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def _edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(doc, text: str, own: str, other: str, others: str) -> tuple:
    edited = _edited(text, other)
    new = fingerprint(edited)
    return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, new, likeness(own, new), likeness(own, others)


def edit_sensitivity(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document's fingerprint against that of an edited text and of the next document.

    The next document is the one below in descending id order (null ids last, rows
    of equal id by text), after the last the first.  The edited text has its last
    ``floor(n/2)`` code points replaced by the first as many, or all, of the next.
    One row per input row with the columns of ``_NAMES``.  Null texts count as
    empty; a single row is its own next; an empty table gives no rows.

    The texts are shuffled once, in ranges of ids.  Inside a range neighbours meet
    in one pass; of each range only the first and last text are kept for the second
    step, which pairs the ranges' ends.
    """
    plain = pick(df, doc_id=id_col, text=text_col)
    plain = plain.withColumn("text", F.coalesce("text", F.lit("")))
    kind = plain.schema["doc_id"].dataType.simpleString()
    down = F.col("doc_id").desc_nulls_last()
    dealt = plain.repartitionByRange(down, F.xxhash64("text")).sortWithinPartitions(down, F.xxhash64("text"), "text")
    shape = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, schema = TaskContext.get().partitionId(), None, None

        def out(rows: list[tuple], role: str, text: str | None = None) -> pa.RecordBatch:
            cols = list(zip(*rows))
            types = [schema, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            made = [pa.array(c, t) for c, t in zip(cols, types)]
            n = len(rows)
            return pa.RecordBatch.from_arrays([*made, pa.array([role] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())], names=[*_NAMES, "role", "part", "text"])

        for batch in batches:
            schema, rows = batch.column("doc_id").type, []
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                now = (doc.as_py(), text.as_py(), fingerprint(text.as_py()))
                if before is None:
                    yield out([(now[0], len(now[1]), None, now[2], None, None, None)], "first", now[1])
                else:
                    rows.append(_row(*before, now[1], now[2]))
                before = now
            if rows:
                yield out(rows, "row")
        if before is not None:
            yield out([(before[0], len(before[1]), None, before[2], None, None, None)], "last", before[1])

    done = cut_lineage(dealt.mapInArrow(inside, shape + ", role string, part int, text string"))
    # two rows for each range, their texts left out, to find the next range that has rows
    order = Window.orderBy("part")
    heads = done.where("role = 'first'").select("part")
    heads = heads.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    ends = done.where("role = 'last'").select("part", "doc_id", "text", "fingerprint").join(heads, "part")
    starts = done.where("role = 'first'").select(F.col("part").alias("to"), F.col("text").alias("other"), F.col("fingerprint").alias("others"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(r["doc_id"], r["text"], r["fingerprint"], r["other"], r["others"]) for r in batch.to_pylist()]
            if rows:
                types = [batch.column("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)

    met = ends.join(starts, "to").select("doc_id", "text", "fingerprint", "other", "others").mapInArrow(across, shape)
    return done.where("role = 'row'").select(*_NAMES).unionByName(met)
