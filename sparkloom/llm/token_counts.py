"""Exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import fast_encoder, with_added
from .common import cut_lineage, groups, pick


def encoded_lengths(df: DataFrame, text_col: str, ranks_path: str, pattern: str, added: Mapping[str, int] | None = None) -> DataFrame:
    """(n_tokens, n_docs) with one row for each length and batch; null texts have length 0.  Strings of ``added`` tokens count as one."""
    with open(ranks_path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = with_added(fast_encoder(vocabulary.value, pattern).encode_ordinary, added or {})
        for batch in batches:
            counts: dict[int, int] = {}
            for some in groups(batch.column("text")):
                for t in some:
                    n = len(encode(t))
                    counts[n] = counts.get(n, 0) + 1
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(counts), pa.int64()), "n_docs": pa.array(list(counts.values()), pa.int64())})

    return pick(df, text=text_col).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(lengths: DataFrame, bucket: int = 256) -> DataFrame:
    """Suffix sums over a (n_tokens, n_docs) frame, partial rows allowed.

    One row for each length ``n_tokens`` that occurs: ``n_docs`` and ``tokens`` of that
    length, ``docs_ge`` and ``tokens_ge`` of that length or more, and
    ``tokens_truncated``, the total if every document were cut to ``n_tokens``.
    An empty input gives no rows.

    The documents are aggregated before anything else, so only distinct lengths
    are summed; that is done in buckets of lengths with one offset for each bucket.
    """
    # used twice below: the documents are encoded once
    hist = cut_lineage(lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))
    hist = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("_b", F.floor(F.col("n_tokens") / bucket))
    # suffix sums over the buckets: as many rows as the longest document has `bucket`s of tokens
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = hist.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    tops = tops.select("_b", F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_d"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_t"), F.sum("_t").over(total).alias("_all"))
    inside = Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(tops, "_b").select("n_tokens", "n_docs", "tokens", (F.sum("n_docs").over(inside) + F.col("_d")).alias("docs_ge"), (F.sum("tokens").over(inside) + F.col("_t")).alias("tokens_ge"), "_all")
    return out.select("n_tokens", "n_docs", "tokens", "docs_ge", "tokens_ge", (F.col("_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("tokens_truncated"))


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row: ``docs_over`` the limit, ``tokens_kept`` if every document is cut to it, ``tokens_lost``."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    return hist.agg(
        F.coalesce(F.sum(F.when(n > limit, d)), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * d), F.lit(0)).alias("tokens_kept"),
        F.coalesce(F.sum(F.greatest(n - limit, F.lit(0)) * d), F.lit(0)).alias("tokens_lost"),
    )


def length_quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row, ``n_tokens``: the least length that at least a share ``q`` of the documents doesn't exceed (null if none)."""
    total = hist.agg(F.max("docs_ge").alias("_n"))
    # documents of at most this length = all - docs_ge + n_docs
    reached = (F.col("_n") - F.col("docs_ge") + F.col("n_docs")) >= F.ceil(F.lit(q) * F.col("_n"))
    return hist.join(F.broadcast(total)).where(reached).agg(F.min("n_tokens").alias("n_tokens"))
