"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Hashes of ``GRAM`` consecutive words are winnowed: of each ``WINDOW`` consecutive
hashes the least is kept, so a common run of ``GRAM + WINDOW - 1`` words shares a
kept hash.  An inverted index leads from hashes to template positions.  Hits of one
template on nearby diagonals make a candidate; its words are aligned within a band
around them, and matched coverage and span are reported; the words beside a match
are aligned again, as a short notice may recur within the band.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import groups, pick

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 12, 0.8
T = TypeVar("T")
_WORD = re.compile(r"[^\W_]+")


def _winnow(grams: dict[int, int], starts: list[int]) -> list[int]:
    """Positions of the kept hashes; a position without hash loses to all others."""
    kept = set()
    for s in starts:
        for at in range(s - WINDOW + 1, s + 1):
            window = [(grams[p], -p) for p in range(at, at + WINDOW) if p in grams]
            kept.add(-min(window)[1])
    return sorted(kept)


@dataclass
class Match:
    """One license in one text: ``start`` and ``end`` are code point offsets, words count in the template."""

    name: str
    start: int
    end: int
    matched: int
    words: int

    @property
    def coverage(self) -> float:
        return self.matched / self.words


@dataclass
class LicenseIndex:
    """Inverted index of the winnowed templates."""

    templates: dict[str, str]
    words: dict[str, list[str]] = field(default_factory=dict)
    known: frozenset[str] = frozenset()
    index: dict[int, list[tuple[str, int]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.words = {n: _WORD.findall(t.lower()) for n, t in self.templates.items()}
        self.known = frozenset(w for ws in self.words.values() for w in ws)
        for name, ws in self.words.items():
            grams = {i: zlib.crc32(" ".join(ws[i : i + GRAM]).encode()) for i in range(len(ws) - GRAM + 1)}
            for p in _winnow(grams, list(grams)):
                self.index.setdefault(grams[p], []).append((name, p))

    def scan(self, text: str) -> list[Match]:
        """Matches of at least ``COVERAGE``, in order; of overlapping ones the one with most matched words."""
        found = list(_WORD.finditer(text))
        known = self.known
        ws = [m.group().lower() for m in found]
        flags = [w in known for w in ws]
        grams = {i: zlib.crc32(" ".join(ws[i : i + GRAM]).encode()) for i in range(len(ws) - GRAM + 1) if flags[i] and flags[i + 1] and flags[i + 2]}
        hits: dict[str, list[int]] = {}
        for p in _winnow(grams, list(grams)) if grams else ():
            for name, q in self.index.get(grams[p], ()):
                hits.setdefault(name, []).append(p - q)
        out = []
        for name, diagonals in hits.items():
            diagonals.sort()
            first = last = diagonals[0]
            for d in [*diagonals[1:], None]:
                if d is None or d > last + BAND:
                    out += self._align(name, ws, first, last, found)
                    first = d
                last = d
        # most matched words first; what overlaps a better match goes
        taken = _apart(sorted(out, key=lambda m: (-m.matched, -m.coverage, m.start, m.name)), lambda m: (m.start, m.end))
        return sorted(taken, key=lambda m: m.start)

    def _align(self, name: str, ws: list[str], first: int, last: int, found: list[re.Match]) -> list[Match]:
        """All matches within the band around the diagonals: the best ones, then those in the words between them."""
        words, out, ranges = len(self.words[name]), [], [(0, len(ws))]
        while ranges:
            begin, end = ranges.pop()
            lo, hi = max(first - BAND, begin - words + 1), min(last + BAND, end - 1)
            if end - begin < COVERAGE * words or lo > hi:
                continue
            for n, a, b in (best := self._best(name, ws, lo, hi, begin, end)):
                out.append(Match(name, found[a].start(), found[b].end(), n, words))
            for _, a, b in best:
                ranges.append((begin, a))
                begin = b + 1
            if best:
                ranges.append((begin, end))
        return out

    def _best(self, name: str, ws: list[str], lo: int, hi: int, begin: int, end: int) -> list[tuple[int, int, int]]:
        """Longest common subsequences of template and ``ws[begin:end]`` on diagonals ``lo`` to ``hi``, in order.

        (matched words, first and last position) of those of the greatest length that don't overlap.
        """
        template, width = self.words[name], hi - lo + 1
        # per diagonal: matched words, first and last matched position of the text; of equal ones the latest start
        best: list[tuple[int, int, int]] = [(0, -1, -1)] * (width + 1)
        for i, t in enumerate(template):
            left = (0, -1, -1)
            for k in range(width):
                j = lo + k + i
                up = best[k + 1]  # the row before, one diagonal further
                here = left if left[:2] >= up[:2] else up
                if begin <= j < end and ws[j] == t:
                    n, a, _ = best[k]
                    if (n + 1, a if n else j) > here[:2]:
                        here = (n + 1, a if n else j, j)
                best[k] = left = here
        most = max(n for n, _, _ in best)
        if most < COVERAGE * len(template):
            return []
        ends = {x for x in best if x[0] == most}
        return sorted(_apart(sorted(ends, key=lambda x: (x[2] - x[1], x[1])), lambda x: (x[1], x[2] + 1)), key=lambda x: x[1])


def _apart(items: Iterable[T], span: Callable[[T], tuple[int, int]]) -> list[T]:
    """Those items, the first ones preferred, whose spans (without the end) don't overlap."""
    spans: list[tuple[int, int]] = []
    kept = []
    for item in items:
        start, end = span(item)
        at = bisect_left(spans, (start, end))
        if (at == 0 or spans[at - 1][1] <= start) and (at == len(spans) or spans[at][0] >= end):
            spans.insert(at, (start, end))
            kept.append(item)
    return kept


def scan_licenses(df: DataFrame, id_col: str, text_col: str, templates: dict[str, str]) -> DataFrame:
    """A row for each license found: ``doc_id``, ``license``, ``coverage``, ``matched_words``, ``template_words``, ``start``, ``end``.

    Offsets are code points of the text.  Null and empty texts have no
    matches; repeated rows give theirs each; an empty table gives no rows.  The
    index of the templates (fixed texts) is broadcast; no shuffle.
    """
    plain = pick(df, doc_id=id_col, text=text_col)
    sent = df.sparkSession.sparkContext.broadcast(LicenseIndex(templates))
    names = ["doc_id", "license", "coverage", "matched_words", "template_words", "start", "end"]
    types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, rows = batch.column("doc_id").to_pylist(), 0, []
            for some in groups(batch.column("text")):
                for text in some:
                    rows += [(ids[at], m.name, round(m.coverage, 6), m.matched, m.words, m.start, m.end) for m in sent.value.scan(text)]
                    at += 1
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column("doc_id").type), *[pa.array(c, t) for c, t in zip(cols[1:], types)]], names=names)

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, license string, coverage double, matched_words long, template_words long, start long, end long")
