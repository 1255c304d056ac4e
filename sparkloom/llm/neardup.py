"""Near-duplicate documents by similarity sketches, banding and exact verification.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.  A
document's set holds its distinct shingles of five words (of all its words if
fewer), as 64-bit hashes.  Documents with equal sets form one node.

* Sketch: rounds of hashed bin placement.  In round i every element is thrown
  into one of ``BINS`` bins with the value (i, hash); bins keep their least value.
  From round ``BINS`` on, round i throws everything into bin i - BINS, so after
  2 * BINS rounds no bin is empty.  Equal coordinates estimate the Jaccard
  similarity with the concentration of independent samples.
* Banding: ``BANDS`` bands of ``ROWS`` coordinates.  At similarity 0.75 a pair
  shares no band with probability (1 - 0.75**4)**32 = 5e-6, at 0.8 5e-8.
* A bucket first compares its least node with the others, and confirmed links are
  merged to components.  A bucket whose members then are all in one component is
  done.  Of the others, those of up to ``SMALL`` members pair what is still in
  different components.
* Nodes of larger ones meet again in an inverted index of rare shingles.  Shingles
  are ordered by a table of counts of fixed size; a linked pair shares one that is
  among the rarest quarter (and one more) of the larger set and the rarest seventh
  (and one more) of the smaller.  A shingle that no set has in its rarest seventh,
  such as those of a common template, makes no pairs.  The others are treated
  like buckets, where only pairs with a set of the second kind count.
* Where over ``SMALL`` sets of that kind share a shingle and are still in different
  components, the groups are joined to clusters, cut into blocks of about ``BLOCK``
  nodes, and pairs of blocks are compared as matrices inside a task that emits no
  more than a spanning set of links.
* What a key or a component aggregates to is materialised before it is joined
  back to its rows.  Then both sides of the join come from plain shuffles, and Spark's
  adaptive execution may deal the rows of one hot key to several tasks.
* Pairs of buckets and of the index whose sketches agree in under ``agree``
  coordinates (``AGREE`` is five standard deviations under 0.75) are not looked at
  again.  All others, and all pairs of blocks, are confirmed on full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, groups, pick, tasks_of, tidy_shuffles

SHINGLE = 5
BINS, BANDS, ROWS = 128, 32, 4
AGREE = 70
#: Most members that are paired with all of a bucket, and nodes of a block of a cluster.
SMALL, BLOCK = 24, 256
#: Slots of the table that counts shingles; it only decides their order, so collisions lose nothing.
SLOTS = 1 << 18

_U = np.uint64
_M, _BLOCK = 0x9E3779B97F4A7C15 | 1, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    out = []
    for base in (_M, pow(_M, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = at + _BLOCK
        if end < len(raw):  # cut at white space; a longer word makes a longer block
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
        b = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        size = 1 << max(20, int(len(b)).bit_length())
        up, down = _powers(size)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + _U(1)) * up[: len(b)], out=total[1:])
        hashes.append(_mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        starts.append(s + at)
        at += len(b)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


_FACTORS = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(some: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in some]  # bytes.lower: A-Z only
    starts, w = _word_hashes(b"\n".join(raws))
    first = np.searchsorted(starts, np.cumsum([0, *[len(r) + 1 for r in raws]]))
    n = max(0, len(w) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k, f in enumerate(_FACTORS):
        s += w[k : k + n] * f
    s = _mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(s[a : b - SHINGLE + 1]))
        elif b > a:
            few = sum((w[a + k : a + k + 1] * _FACTORS[k] for k in range(b - a)), np.full(1, b - a, np.uint64))
            out.append(_mix(few))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` coordinates for each (non-empty) set; ``bins`` is a power of two, at most 128."""
    none = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * bins, none, np.uint64)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shift, low = _U(64 - bins.bit_length() + 1), _U((1 << 56) - 1)
    for i in range(2 * bins):
        if not len(x):
            break
        h = _mix(x * _U((_M + 2 * i * 0x632BE59BD9B4E019) % 2**64 | 1) + _U(i * 0xD1342543DE82EF95 % 2**64))
        at = doc * bins + ((h >> shift).astype(np.int64) if i < bins else i - bins)
        np.minimum.at(out, at, (h & low) | _U(i << 56))
        left = (out.reshape(-1, bins) == none).any(axis=1)
        keep = left[doc]
        x, doc = x[keep], doc[keep]
    return out.reshape(-1, bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """``BANDS`` 64-bit keys for each sketch."""
    s = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _U(0x2545F4914F6CDD1D)
    for k in range(ROWS):
        key = _mix((key + s[:, :, k]) * _FACTORS[k])
    return key


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _base(plain: DataFrame, kind: str) -> DataFrame:
    """(doc_id, n_shingles, node, keys, sketch): keys and the 16 low bits of each coordinate, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[np.ndarray] = []
            keys: list[list[int]] = []
            sketch: list[bytes] = []
            for some in groups(batch.column("text"), 1_000_000):
                part = shingle_sets(some)
                full = [k for k, s in enumerate(part) if len(s)]
                drawn = sketches([part[k] for k in full])
                found = band_keys(drawn).view(np.int64) if full else []
                short = drawn.astype("<u2")
                ks, sk = [None] * len(part), [None] * len(part)
                for j, k in enumerate(full):
                    ks[k], sk[k] = found[j], short[j].tobytes()
                keys, sketch = keys + ks, sketch + sk
                sets += part
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "node", "keys", "sketch"],
            )

    return plain.mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, keys array<long>, sketch binary")


def _sets(plain: DataFrame) -> DataFrame:
    """(node, shingles) of rows of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in groups(batch.column("text"), 1_000_000):
                sets = shingle_sets(some)
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return plain.select("text").mapInArrow(run, "node binary, shingles binary")


def _agree_udf(least: int):
    """A filter over pairs of sketches, a batch as one matrix."""

    @F.pandas_udf("boolean")
    def passes(a, b):  # noqa: ANN001
        import pandas as pd

        x, y = (np.frombuffer(b"".join(c), "<u2").reshape(-1, BINS) for c in (a, b))
        return pd.Series(np.count_nonzero(x == y, axis=1) >= least, dtype=bool)

    return passes("sa", "sb")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets of at least 0.75, in whole numbers."""
    a, b = len(x), len(y)
    if 100 * min(a, b) < 75 * max(a, b):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= 75 * (a + b - common)


def _confirm_udf():
    """A filter over pairs of full sets."""

    @F.pandas_udf("boolean")
    def passes(a, b):  # noqa: ANN001
        import pandas as pd

        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=bool)

    return passes("sa", "sb")


def _slots(x: np.ndarray) -> np.ndarray:
    return (_mix(x * _FACTORS[0]) >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _counts(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each slot occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("shingles"):
                np.add.at(total, _slots(np.frombuffer(x.as_py(), np.uint64)), 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], names=["slot", "n"])

    found = sets.select("shingles").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint32)
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    return out


def rare_shingles(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles by which a set meets those of its size or less, the first so many of them those of its size or more.

    Of two sets of similarity 0.75 or more the larger shares three quarters of its own
    shingles and the smaller six sevenths.  The first shared shingle in the order has
    all other shared ones behind it, so it is among these in either set.
    """
    n = len(x)
    order = np.lexsort((x, counts[_slots(x)]))
    return x[order[: n - -(-3 * n // 4) + 1]], n - -(-6 * n // 7) + 1


def _rare(sets: DataFrame) -> DataFrame:
    """(key, node, low): a row for each shingle by which a node may meet others; ``low`` for sets of its size or more."""
    counts = _counts(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, x in zip(batch.column("node"), batch.column("shingles")):
                rare, low = rare_shingles(np.frombuffer(x.as_py(), np.uint64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(rare.view(np.int64)), pa.array([node.as_py()] * len(rare), pa.binary()), pa.array(np.arange(len(rare)) < low)], names=["key", "node", "low"])

    return sets.select("node", "shingles").mapInArrow(run, "key long, node binary, low boolean")


def _block_links(block: pa.Table) -> pa.Table:
    """Links between the nodes of one block, or of two, that join different components: a spanning set."""
    i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
    own, nodes, roots = block.column("own").to_pylist(), block.column("node").to_pylist(), block.column("root").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    keep = count[at] > 1
    row, at = row[keep], np.unique(at[keep], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common, step = np.zeros((len(sets), len(sets)), np.float32), 4096
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        a, b = np.searchsorted(at, (lo, lo + step))
        x = np.zeros((len(sets), step), np.float32)
        x[row[a:b], at[a:b] - lo] = 1
        common += x @ x.T
    linked = 100 * common >= 75 * (size[:, None] + size[None, :] - common)
    parent: dict[bytes, bytes] = {}

    def top(r: bytes) -> bytes:
        while (up := parent.get(r, r)) != r:
            r = up
        return r

    found = []
    for p, q in zip(*np.nonzero(np.triu(linked, 1))):
        if i == j or own[p] != own[q]:
            a, b = top(roots[p]), top(roots[q])
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((nodes[p], nodes[q]))
    return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})


def _cluster_links(many: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components among the nodes of large groups, found in blocks of the clusters that the groups form."""
    cluster = components(many.select(F.col("leader").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "cluster")
    inside = many.select("node", "root").distinct().join(cluster, "node", "left").select("node", "root", F.coalesce("cluster", "node").alias("cluster"))
    size = inside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = inside.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "root", "shingles")
    return cut_lineage(dealt.groupBy("cluster", "i", "j").applyInArrow(_block_links, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that isn't its root, from links (a, b), by alternating stars.

    Each step aggregates with partial sums; joining back, the links of one node (two
    hashes each, no sets) meet in one task.
    """
    both = F.col("a") != F.col("b")
    e = cut_lineage(links.where(both).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        before = e  # neither star makes more links than there were
        # large star: everything above a node goes to the least of its neighbourhood
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = sym.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: everything below goes there as well
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where(both).distinct()
        e = cut_lineage(e, tasks=tasks_of(before))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(df: DataFrame, id_col: str, text_col: str, agree: int = AGREE) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.75 or more on word shingles.

    One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the least id
    reachable by links) and ``kept`` (``doc_id = component_id``).  Null texts and
    texts without words have the empty set and are linked with nothing.  Rows of
    equal text are in one component, also if they repeat an id; a component
    without any id has a null ``component_id``.  An empty table gives no rows.
    ``agree=0`` confirms every pair that shares a band.
    """
    with tidy_shuffles(df.sparkSession):
        base, nodes, roots = _grouped(pick(df, doc_id=id_col, text=text_col), agree)
        labelled = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        smallest = cut_lineage(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    filled = base.where("n_shingles > 0")
    named = labelled.join(smallest, "root").select("node", "component_id")
    out = filled.select("doc_id", "n_shingles", "node").join(named, "node").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(plain: DataFrame, agree: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, node), (node, least) and (node, root) of rows (doc_id, text)."""
    kind = plain.schema["doc_id"].dataType.simpleString()
    base = cut_lineage(_base(plain, kind))
    filled = base.where("n_shingles > 0")
    # copies are merged before anything else; equal sets have equal sketches and keys
    nodes = cut_lineage(filled.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("keys").alias("keys"), F.max("sketch").alias("sketch")))
    sketch = nodes.select("node", "sketch")

    def met(spread: DataFrame, tasks: int) -> DataFrame:
        """(key, node, low, leader) of rows (key, node, low) whose key has a low node and another; ``tasks`` by the bytes of the rows."""
        shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("low"), F.col("node"))).alias("leader")).where("n > 1 and leader is not null")
        return cut_lineage(spread.join(cut_lineage(shared.select("key", "leader"), tasks=tasks), "key").select("key", "node", "low", "leader"), tasks=tasks)

    def sets_of(needed: DataFrame) -> DataFrame:
        """(node, shingles) of these nodes, from their texts."""
        ids = nodes.join(needed, "node", "left_semi").select(F.col("least").alias("want")).distinct()
        rows = plain.join(ids, plain["doc_id"].eqNullSafe(ids["want"]), "left_semi")
        return cut_lineage(_sets(rows).join(needed, "node", "left_semi").groupBy("node").agg(F.max("shingles").alias("shingles")))

    def confirmed(pairs: DataFrame, sets: DataFrame | None) -> DataFrame:
        """Those of the distinct pairs (a, b) that are links; the sets are made from the texts if not given."""
        left, right = (sketch.select(F.col("node").alias(x), F.col("sketch").alias("s" + x)) for x in "ab")
        likely = cut_lineage(pairs.join(left, "a").join(right, "b").where(_agree_udf(agree)).select("a", "b"))
        if sets is None:
            sets = sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())
        left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias("s" + x)) for x in "ab")
        return cut_lineage(likely.join(left, "a").join(right, "b").where(_confirm_udf()).select("a", "b"))

    def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
        return components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    def mixed(of: DataFrame, roots: DataFrame) -> DataFrame:
        """(key, node, low, leader, lows, root) of those keys among ``of`` whose members, ``lows`` of them low, aren't all in one component."""
        labelled = of.join(roots, "node", "left").select("key", "node", "low", "leader", F.coalesce("root", "node").alias("root"))
        found = labelled.groupBy("key").agg(F.count_if("low").alias("lows"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key", "lows")
        tasks = 2 * tasks_of(of)  # no more rows, a root longer
        return cut_lineage(labelled.join(cut_lineage(found, tasks=tasks), "key"), tasks=tasks)

    def paired(members: DataFrame, roots: DataFrame | None, sets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Components after the comparisons of these keys, and what is left of keys with many low members."""
        star = members.where("node != leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
        roots = merged(roots, confirmed(star, sets))
        rest = mixed(members, roots)
        few = rest.where((F.col("lows") <= SMALL) & (F.col("node") != F.col("leader"))).select("key", "node", "low", "root")
        other = few.where("low").select("key", F.col("node").alias("other"), F.col("root").alias("other_root"))
        pairs = few.join(other, "key").where("root != other_root").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        roots = merged(roots, confirmed(pairs, sets))
        return roots, mixed(rest.where(F.col("lows") > SMALL).select("key", "node", "low", "leader"), roots)

    # keys are hashes of the band: a bucket of one node is of no interest
    roots, many = paired(met(nodes.select("node", F.explode("keys").alias("key"), F.lit(True).alias("low")), 4 * tasks_of(nodes)), None, None)
    if not many.isEmpty():
        sets = sets_of(many.select("node").distinct())
        roots, many = paired(mixed(met(_rare(sets), 4 * tasks_of(sets)), roots).drop("lows", "root"), roots, sets)
        if not many.isEmpty():
            roots = merged(roots, _cluster_links(many, sets))
    return base.select("doc_id", "n_shingles", "node"), nodes.select("node", "least"), roots


def drop_near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for each group, all columns as they were; rows without words stay.

    It is that of the least id (null last), of the least text hash among these, and
    any one of the rows that are equal in both.
    """
    key, id_, text = fresh(df, "_near_key"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # an id of its own for each text, so no two texts share what decides
    keyed = df.withColumn(key, F.struct(id_.isNull().alias("none"), id_.alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text")))
    found = near_duplicates(keyed, key, text_col).where("kept")
    many = (F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)
    kept = cut_lineage(found.groupBy("doc_id").agg(many.alias("many")).withColumnRenamed("doc_id", "_kept_id"))
    some, repeated = kept.where("not many"), kept.where("many")
    out = keyed.join(some, keyed[key] == some["_kept_id"], "left_semi")
    if not repeated.isEmpty():
        out = out.union(keyed.join(repeated, keyed[key] == repeated["_kept_id"], "left_semi").dropDuplicates([key]))
    return out.drop(key)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL by the definition, over all pairs that share a shingle; ids must be unique."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM {table} UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.doc_id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM {table} d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) g ON g.doc_id = d.doc_id
"""
