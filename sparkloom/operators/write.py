"""Inserts, updates and deletes as transforms that give the new state of a family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WriteError
from ..functions import keys


def invalid_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a separator in one of these text columns."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(keys.has_separator(F.col(c).cast("string")), F.lit(False))
    return rows.where(bad)


def check_names(columns: Sequence[str]) -> None:
    for c in columns:
        if any(s in c for s in (keys.FIELD, keys.VALUE, keys.CHOICE, keys.ORDER_END, keys.INDEX_MARK)):
            raise WriteError(f"{c} holds a separator")


def insert(base: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, missing columns as nulls; nothing is deduplicated."""
    return base.unionByName(new, allowMissingColumns=True)


def latest(changes: DataFrame, pk: str, order: Sequence[str]) -> DataFrame:
    """The last change of each key, by the order columns; nulls come first.  Partial aggregates, so a key of very many changes is no hot spot."""
    others = [c for c in changes.columns if c != pk]
    last = changes.groupBy(pk).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return last.select(*[F.col(c) if c == pk else F.col(f"_last.{c}") for c in changes.columns])


def update(base: DataFrame, changes: DataFrame, pk: str, order: Sequence[str]) -> DataFrame:
    """``base`` with the last change of each known key applied.

    A change holds any of the columns but the key; null means no change.  Changes of
    unknown keys are left out.  The key itself can't change.
    """
    columns = [c for c in changes.columns if c != pk and c in base.columns]
    last = latest(changes, pk, order).select(F.col(pk).alias("_pk"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(last, base[pk] == last["_pk"], "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def unknown_keys(base: DataFrame, changes: DataFrame, pk: str) -> DataFrame:
    """Changes whose key ``base`` doesn't have; they must not leave a row behind."""
    return changes.join(base.select(pk), pk, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, pk: str, order: Sequence[str]) -> DataFrame:
    """Whole rows: the last change of a key replaces its row or adds one."""
    last = latest(changes, pk, order).select(*base.columns)
    return base.join(last.select(pk), pk, "left_anti").unionByName(last)


def delete(base: DataFrame, ids: DataFrame, pk: str) -> DataFrame:
    return base.join(ids.select(pk), pk, "left_anti")
