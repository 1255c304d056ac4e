"""Pages: with a look at the next row, by offset, and by cursor."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.predicate import literal
from ..plans.scan import Order, ordering


def page_with_more(rows: DataFrame, order: Order, n: int) -> DataFrame:
    """The first ``n`` rows, with ``has_more``: is there another one?  Reads ``n + 1``."""
    cut = rows.orderBy(*ordering(order)).limit(n + 1)
    place = Window.orderBy(*ordering(order))
    numbered = cut.withColumn("_n", F.row_number().over(place)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > n)
    return numbered.where(F.col("_n") <= n).drop("_n")


def page_by_offset(rows: DataFrame, order: Order, offset: int, n: int) -> DataFrame:
    """``n`` rows after ``offset``; the order should end in a unique column."""
    return rows.orderBy(*ordering(order)).offset(offset).limit(n)


def page_after(rows: DataFrame, order: Order, cursor: Mapping[str, Any] | None, n: int) -> DataFrame:
    """``n`` rows after the cursor (the last row's order values; None: the first page)."""
    if cursor is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for c, d in order:
            v = literal(cursor[c])
            beyond = beyond | (equal & ((F.col(c) < v) if d == "desc" else (F.col(c) > v)))
            equal = equal & (F.col(c) == v)
        rows = rows.where(beyond)
    return rows.orderBy(*ordering(order)).limit(n)
