"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import fast_encoder, with_added
from .common import groups, pick

#: (document key, start in the document, ids, document length)
Piece = tuple[object, int, np.ndarray, int]
#: (window, offset, piece)
Placed = tuple[int, int, Piece]


class SumOfSquares:
    """Windows of ``size`` tokens, filled online.

    ``counts[h]`` is the number of open windows filled to level ``h``.  A piece of
    ``s`` tokens goes to the level (0: a new window) for which the sum of the
    squared counts after the placement is least; ties go to the fuller window.
    Documents longer than a window give full windows and a remainder.

    At most ``max_open`` windows stay open: beyond that, the fullest one is topped
    up with the head of the document at hand, so memory is bounded and no space is
    lost.  ``finish`` takes the emptiest open window apart, again and again, and places
    its pieces by the same rule in the others, cut where a window is full.  The last
    window is split into sequences whose lengths are powers of two.
    """

    def __init__(self, size: int = 2048, max_open: int = 1024):
        self.size, self.max_open = size, max_open
        self.counts = np.zeros(size + 1, np.int64)
        self.level: dict[int, list[int]] = {}  # level -> open windows
        self.held: dict[int, list[Piece]] = {}  # open window -> its pieces
        self.next = 0

    def _best(self, s: int, cut: bool = False) -> int:
        """The level for a piece of ``s`` tokens; ``cut``: in an open window if there is one, topped up if the piece is longer."""
        c, size = self.counts, self.size
        h = np.flatnonzero(c[1 : size if cut else size - s + 1]) + 1
        if not h.size:
            return 0
        top = np.minimum(h + s, size)
        after = np.where(top == size, 1 - 2 * c[h], 2 * (c[top] - c[h]) + 2)
        k = h.size - 1 - int(np.argmin(after[::-1]))
        return int(h[k]) if cut or after[k] <= 2 * int(c[s]) + 1 else 0

    def _put(self, h: int, piece: Piece) -> Iterator[Placed]:
        s = len(piece[2])
        if h:
            self.counts[h] -= 1
            window = self.level[h].pop()
        else:
            window, self.next = self.next, self.next + 1
            self.held[window] = []
        self.held[window].append(piece)
        if h + s == self.size:
            yield from self._close(window)
        else:
            self.counts[h + s] += 1
            self.level.setdefault(h + s, []).append(window)

    def _close(self, window: int) -> Iterator[Placed]:
        at = 0
        for piece in self.held.pop(window):
            yield window, at, piece
            at += len(piece[2])

    def add(self, key: object, ids: np.ndarray) -> Iterator[Placed]:
        """Place a document; yields the pieces of the windows that this fills."""
        n, start = len(ids), 0
        while n - start >= self.size:
            yield self.next, 0, (key, start, ids[start : start + self.size], n)
            self.next, start = self.next + 1, start + self.size
        while start < n:
            rest = ids[start:]
            h = self._best(len(rest))
            if h == 0 and len(self.held) >= self.max_open:
                h = int(np.flatnonzero(self.counts)[-1])
                rest = rest[: self.size - h]
            yield from self._put(h, (key, start, rest, n))
            start += len(rest)

    def finish(self) -> Iterator[Placed]:
        """Close the windows that are still open, without padding."""
        while len(self.held) > 1:
            h = int(np.flatnonzero(self.counts)[0])
            self.counts[h] -= 1
            for key, start, ids, n in self.held.pop(self.level[h].pop()):
                while len(ids):
                    to = self._best(len(ids), cut=True)
                    take = self.size - to
                    yield from self._put(to, (key, start, ids[:take], n))
                    start, ids = start + take, ids[take:]
        pieces = [p for held in self.held.values() for p in held]
        self.held, self.level = {}, {}
        self.counts[:] = 0
        total, at, room = sum(len(p[2]) for p in pieces), 0, 0
        for key, start, ids, n in pieces:
            while len(ids):
                if at == room:
                    at, room, self.next = 0, 1 << total.bit_length() - 1, self.next + 1
                    total -= room
                take = min(len(ids), room - at)
                yield self.next - 1, at, (key, start, ids[:take], n)
                at, start, ids = at + take, start + take, ids[take:]


def pack_documents(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, end_id: int = 1, size: int = 2048, max_open: int = 1024, added: Mapping[str, int] | None = None) -> DataFrame:
    """Pack the token ids of all documents, each followed by ``end_id``, into sequences of ``size``.

    One row for each piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32`` (of its ids as little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset``.  Every id lies in one piece; a
    sequence is full or its length is a power of two.  A null or empty text is
    the single id ``end_id``; repeated rows are packed each; an empty table gives
    no rows.  Strings of ``added`` tokens become their ids.

    Each input split is packed online by its own task: no shuffle, and a task that
    is run again places everything as before, as the order of a split is fixed.
    Sequence ids are unique across tasks (split number, then counter).
    """
    with open(ranks_path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())
    plain = pick(df, doc_id=id_col, text=text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = with_added(fast_encoder(vocabulary.value, pattern).encode_ordinary, added or {})
        packer, base = SumOfSquares(size, max_open), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        id_type, number = None, 0

        def note(placed: Iterator[Placed]) -> None:
            for window, at, (key, start, ids, n) in placed:
                rows.append((key[1], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, base + window, at))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type, at = batch.column("doc_id").type, 0
            keys = batch.column("doc_id").to_pylist()
            for some in groups(batch.column("text")):
                for t in some:
                    ids = np.array([*encode(t), end_id], np.uint32)
                    note(packer.add((number, keys[at]), ids))
                    number, at = number + 1, at + 1
                if len(rows) >= 20_000:
                    yield out()
        if id_type is not None:
            note(packer.finish())
            yield out()

    return plain.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
