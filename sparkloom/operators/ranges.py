"""Coalescing of neighbouring keys into ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_ranges(rows: DataFrame, group: Sequence[str], key: str, gap: int = 100, block: int = 1 << 16) -> DataFrame:
    """Per group, runs of whole-number keys whose neighbours lie at most ``gap`` apart: ``lo``, ``hi``, ``n_keys``.

    Keys are sorted in blocks of ``block`` values, so a group of very many keys is spread
    over tasks; only a row for each block is sorted by group, to carry runs over the
    blocks' edges.
    """
    inside = Window.partitionBy(*group, "_block").orderBy(key)
    across = Window.partitionBy(*group).orderBy("_block")
    keys = rows.select(*group, key).distinct().withColumn("_block", F.floor(F.col(key) / block))
    marked = keys.withColumn("_gap", F.col(key) - F.lag(key).over(inside))
    # a row for each block: its ends, and the last run that begins in it but not at its first key
    edges = marked.groupBy(*group, "_block").agg(F.min(key).alias("_first"), F.max(key).alias("_last"), F.max(F.when(F.col("_gap") > gap, F.col(key))).alias("_start"))
    edges = edges.withColumn("_new", F.coalesce(F.col("_first") - F.lag("_last").over(across) > gap, F.lit(True)))
    begins = F.last(F.coalesce("_start", F.when(F.col("_new"), F.col("_first"))), ignorenulls=True).over(across)
    edges = edges.withColumn("_begin", begins)
    carried = edges.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_b"), F.when(F.col("_new"), F.col("_first")).otherwise(F.lag("_begin").over(across)).alias("_carry"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    condition = F.col("_block") == F.col("_b")
    for s in same:
        condition = condition & s
    starts = marked.join(carried, condition).withColumn("_run", F.coalesce(F.max(F.when(F.col("_gap") > gap, F.col(key))).over(inside), F.col("_carry")))
    return starts.groupBy(*group, "_run").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n_keys")).drop("_run")
