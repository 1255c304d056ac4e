"""Byte-level BPE by prefix dynamic programming.

For a byte string ``s`` the encoding of every prefix ``s[:i]`` ends in one
definite token.  ``last[i]`` stores that token, and the whole encoding of any
prefix is read off by walking back ``i -> i - len(last[i])``.  A token ``t`` that
ends at ``i`` is the last token of the prefix exactly if it follows
``last[i - len(t)]`` without a merge across their seam, and just one ``t`` does.
So appending bytes only extends the table, and after an edit the table is
recomputed only until it falls back into step with the old one.

The seam test unwinds the merges of the two neighbours, latest first, and asks
at each point whether the pair in contact would have merged earlier.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import groups, pick

#: Distinct pieces (not documents) that one Python worker remembers.
PIECE_CACHE = 800_000
#: Seam results that one worker remembers.
SEAM_CACHE = 1_000_000


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """``base64 rank`` lines to a dict."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


class PrefixEncoder:
    """Encodes byte strings by the prefix table; exact for rank-ordered byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._beyond = max(self.bytes_of, default=0) + 1
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._seam: dict[tuple[int, int], bool] = {}
        #: last bytes, four at most -> lengths of the tokens that may end so, longest first
        self._lengths: dict[bytes, tuple[int, ...]] = {}
        found: dict[bytes, set[int]] = {}
        for t in ranks:
            for k in range(2, min(4, len(t)) + 1):
                found.setdefault(t[-k:], set()).add(len(t))
        for end, n in found.items():
            n = {x for x in n if x >= 4 or x == len(end)} if len(end) < 4 else n
            n |= {k for k in range(2, len(end)) if end[-k:] in ranks}
            self._lengths[end] = tuple(sorted((x for x in n if x <= len(end) or len(end) == 4), reverse=True))
        self.longest = max(map(len, ranks), default=1)

    def merge(self, s: bytes) -> list[int]:
        """Plain BPE: merge the leftmost pair of least rank until none is left.  For short strings."""
        parts = [s[i : i + 1] for i in range(len(s))]
        while len(parts) > 1:
            best = min(((self.rank.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def parts(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``; None for single bytes and unreachable tokens."""
        if t not in self._parts:
            s, found = self.bytes_of[t], None
            if len(s) > 1:
                p = [s[i : i + 1] for i in range(len(s))]
                while len(p) > 2:
                    best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(p, p[1:])) if a + b in self.rank), default=None)
                    if best is None:
                        break
                    p[best[1] : best[1] + 2] = [p[best[1]] + p[best[1] + 1]]
                found = (self.rank[p[0]], self.rank[p[1]]) if len(p) == 2 else None
            self._parts[t] = found
        return self._parts[t]

    def reachable(self, t: int) -> bool:
        return len(self.bytes_of[t]) == 1 or self.parts(t) is not None

    def follows(self, a: int, b: int) -> bool:
        """Does the encoding of bytes(a) + bytes(b) keep the two tokens apart?"""
        key = (a, b)
        known = self._seam.get(key)
        if known is None:
            if len(self._seam) >= SEAM_CACHE:
                self._seam.clear()
            known = self._seam[key] = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        text, rank = self.bytes_of, self.rank
        if not (self.reachable(a) and self.reachable(b)):
            return False
        before = self._beyond  # a merge across the seam below this rank comes first
        while True:
            made = rank.get(text[a] + text[b])
            if made is not None and made < before:
                return False
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and a > b):
                before, a = a, pa_[1]
            else:
                before, b = b + 1, pb[0]  # at equal rank the pair further left merges first

    def extend(self, s: bytes, last: list[int], upto: int | None = None) -> None:
        """Extend the prefix table of ``s`` (``last[0]`` is a placeholder) to ``upto`` bytes."""
        get, lengths, seams, follows = self.rank.get, self._lengths, self._seam, self.follows
        for i in range(len(last), (len(s) if upto is None else upto) + 1):
            for n in lengths.get(s[i - 4 : i] if i > 3 else s[:i]) or lengths.get(s[i - 3 : i] if i > 2 else s[:i]) or lengths.get(s[i - 2 : i] if i > 1 else b"", ()):
                if n < i:
                    t = get(s[i - n : i])
                    if t is not None:
                        fits = seams.get((last[i - n], t))
                        if follows(last[i - n], t) if fits is None else fits:
                            last.append(t)
                            break
                elif n == i and (t := get(s[:i])) is not None and self.reachable(t):
                    last.append(t)
                    break
            else:
                last.append(get(s[i - 1 : i]))

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """Token ids of the prefix of length ``end``."""
        out, i = [], len(last) - 1 if end is None else end
        while i > 0:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def encode(self, s: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token stays whole."""
        if (t := self.rank.get(s)) is not None:
            return [t]
        last = [-1]
        self.extend(s, last)
        return self.read(last)

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each piece of a sorted list; neighbours share the table of their common prefix."""
        before, last = b"", [-1]
        for s in pieces:
            k, end = 0, min(len(before), len(s))
            while k < end and before[k] == s[k]:
                k += 1
            del last[k + 1 :]
            self.extend(s, last)
            before = s
            yield [self.rank[s]] if s in self.rank else self.read(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class GrowingBytes:
    """A byte string with its prefix table: exact appends, and edits that recompute only near the change."""

    def __init__(self, encoder: PrefixEncoder, s: bytes = b""):
        self.encoder, self.s, self.last = encoder, s, [-1]
        encoder.extend(s, self.last)
        self.recomputed = len(s)

    def append(self, more: bytes) -> None:
        self.s += more
        self.encoder.extend(self.s, self.last)
        self.recomputed = len(more)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace ``s[start:end]``."""
        old, moved = self.last, start + len(new) - end
        self.s = self.s[:start] + new + self.s[end:]
        last, same, i = old[: start + 1], 0, start
        while i < len(self.s):
            i += 1
            self.encoder.extend(self.s, last, i)
            beyond = i - (start + len(new))  # bytes of the unchanged tail so far
            same = same + 1 if beyond > 0 and last[i] == old[i - moved] else 0
            # every later entry looks back at most `longest` entries and bytes
            if same >= self.encoder.longest and beyond >= self.encoder.longest:
                last += old[i - moved + 1 :]
                break
        self.recomputed, self.last = i - start, last

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the whole string, or of any prefix."""
        return self.encoder.read(self.last, end)


class EncodedText:
    """A text as pre-split pieces with ids; ``edit`` re-splits and re-encodes only near the change."""

    def __init__(self, encoder: PrefixEncoder, pattern: str, text: str = ""):
        self.encoder, self.split, self.text = encoder, regex.compile(pattern), text
        found = list(self.split.finditer(text))
        self.starts = [m.start() for m in found]
        self.pieces = [encoder.encode(m.group().encode()) for m in found]
        self.recomputed = len(self.pieces)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        ends = self.starts[1:] + [len(self.text)]
        # a match looks at most one character past its end + 1, so earlier pieces can't change
        keep = bisect_left(ends, start - 1) if self.starts else 0
        at = self.starts[keep] if keep < len(self.starts) else (ends[keep - 1] if keep else 0)
        moved = start + len(new) - end
        self.text = self.text[:start] + new + self.text[end:]
        old = {s + moved: k for k, s in enumerate(self.starts) if s >= end}
        starts, pieces, tail = self.starts[:keep], self.pieces[:keep], len(self.starts)
        for m in self.split.finditer(self.text, at):
            if m.start() >= start + len(new) and m.start() in old:
                tail = old[m.start()]  # matching only looks ahead: from here all is as before
                break
            starts.append(m.start())
            pieces.append(self.encoder.encode(m.group().encode()))
        self.recomputed = len(starts) - keep
        self.starts = starts + [s + moved for s in self.starts[tail:]]
        self.pieces = pieces + self.pieces[tail:]

    def ids(self) -> list[int]:
        return [t for p in self.pieces for t in p]


_WORKER: dict[str, PrefixEncoder] = {}


def worker_encoder(blob: bytes) -> PrefixEncoder:
    """One encoder for each vocabulary and Python process."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _WORKER:
        _WORKER[key] = PrefixEncoder(parse_ranks(blob))
    return _WORKER[key]


class _Pieces(dict):
    """piece -> (ids as decimal text, decoded bytes)."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder, self.before = encoder, {}

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        made = self[piece] = self.before[piece]
        return made

    def learn(self, pieces: set[str]) -> None:
        """Make all these pieces known; what wasn't used since the last turnover is forgotten when full."""
        if len(self) + len(pieces) > PIECE_CACHE // 2:
            self.before = dict(self)
            self.clear()
        known = self.before
        new = sorted((p.encode(), p) for p in pieces if p not in self and p not in known)
        for (_, p), ids in zip(new, self.encoder.encode_sorted([b for b, _ in new])):
            self[p] = (" ".join(map(str, ids)), self.encoder.decode(ids))


_PIECES: dict[int, _Pieces] = {}


def encode_documents(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """Ids, and the text decoded from them, of every document, as digests.

    Returns one row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by one space) and ``decoded_sha256``.  A null or empty text
    has no ids; both digests are then those of the empty string.  Texts of any
    length, repeated rows and extra columns are fine; an empty table gives no rows.

    The vocabulary (under 1 MB, fixed) is read once by the driver and broadcast;
    no shuffle is needed.
    """
    spark = df.sparkSession
    with open(ranks_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary.value)
        pieces = _PIECES.setdefault(id(encoder), _Pieces(encoder))
        split = regex.compile(pattern).findall
        for batch in batches:
            counts, ids, back = [], [], []
            for some in groups(batch.column("text")):
                cut = [split(t) for t in some]
                pieces.learn(set().union(*cut))
                for made in cut:
                    found = [pieces[p] for p in made]
                    joined = " ".join([m[0] for m in found])
                    counts.append(joined.count(" ") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join([m[1] for m in found])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = pick(df, doc_id=id_col).schema[0].dataType.simpleString()
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


_FAST: dict[str, object] = {}


def fast_encoder(blob: bytes, pattern: str):
    """The compiled encoder over the same ranks (equal ids; see tests), for work that only needs ids."""
    import tiktoken

    key = hashlib.sha256(blob).hexdigest() + pattern
    if key not in _FAST:
        _FAST[key] = tiktoken.Encoding(f"ranks-{key[:12]}", pat_str=pattern, mergeable_ranks=parse_ranks(blob), special_tokens={})
    return _FAST[key]


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON with their ids."""
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that match by context are not supported")
    return {t["content"]: t["id"] for t in found}


def with_added(encode: Callable[[str], list[int]], added: Mapping[str, int]) -> Callable[[str], list[int]]:
    """``encode`` for the text between the added tokens, whose own ids come in between."""
    if not added:
        return encode
    split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")").split

    def run(text: str) -> list[int]:
        if not any(t in text for t in added):
            return encode(text)
        return [i for part in split(text) for i in ([added[part]] if part in added else encode(part))]

    return run


__all__ = ["EncodedText", "GrowingBytes", "PrefixEncoder", "added_tokens", "encode_documents", "fast_encoder", "parse_ranks", "with_added"]
