"""Secondary indexes as derived, sorted projections, and as (column, value) entries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CatalogError
from ..plans.predicate import Where
from ..plans.scan import ordering
from ..sources.catalog import Catalog, FamilySpec, IndexDef


def index_rows(rows: DataFrame, index: IndexDef, pk: str) -> DataFrame:
    """The index: its columns and the primary key, only of rows that have all its columns."""
    cols = list(dict.fromkeys([c for c, _ in index.order_by] + list(index.columns)))
    return rows.dropna(subset=cols).select(*cols, *([pk] if pk not in cols else []))


def write_index(rows: DataFrame, index: IndexDef, pk: str, path: str) -> None:
    """Store an index in files sorted by its leading columns, so that their statistics prune scans."""
    lead = list(index.order_by) or [(c, "asc") for c in index.columns]
    found = index_rows(rows, index, pk)
    found.repartitionByRange(*ordering(lead)).sortWithinPartitions(*ordering(lead)).write.mode("overwrite").parquet(path)


def build_index(catalog: Catalog, table: str, family: str, index: IndexDef, path: str) -> DataFrame:
    """Register and store an index; the family is locked meanwhile.  Returns the number of rows indexed."""
    spec = catalog.table(table).family(family)
    catalog.lock(table, family)
    try:
        catalog.add_index(table, family, index)
        rows = catalog.family_rows(table, family)
        write_index(rows, index, spec.pk, path)
        return rows.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_indexed"))
    finally:
        catalog.unlock(table, family)


def drop_index(catalog: Catalog, table: str, family: str, name: str, stored: DataFrame) -> DataFrame:
    """Forget an index; returns the number of its rows."""
    catalog.check_unlocked(table, family)
    catalog.drop_index(table, family, name)
    return stored.agg(F.count(F.lit(1)).alias("rows_dropped"))


def entries(rows: DataFrame, family: FamilySpec, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, idx_value, family_name, row_id) of every value present in the indexed columns."""
    columns = list(columns or family.indexed)
    wide = rows.select(F.col(family.pk).cast("string").alias("row_id"), *[F.col(c).cast("string").alias(c) for c in columns])
    out = wide.unpivot(["row_id"], columns, "column_name", "idx_value").where("idx_value is not null")
    return out.select("column_name", "idx_value", F.lit(family.name).alias("family_name"), "row_id")


def drop_entries(index: DataFrame, family: str, column: str) -> DataFrame:
    """The entries without those of one family's column."""
    return index.where(~((F.col("family_name") == family) & (F.col("column_name") == column)))


def repair(index: DataFrame, rows: DataFrame, family: FamilySpec, where: Where | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The entries plus those that rows under the condition should have and haven't."""
    condition = where.to_column() if where else None
    due = entries(rows if condition is None else rows.where(condition), family, columns)
    missing = due.join(index, ["column_name", "idx_value", "family_name", "row_id"], "left_anti")
    return index.unionByName(missing)


def emit_range(index: DataFrame, column: str, lo: str, hi: str) -> DataFrame:
    """Entries of one column with ``lo <= value < hi``, as text."""
    return index.where((F.col("column_name") == column) & (F.col("idx_value") >= lo) & (F.col("idx_value") < hi))


def choose_layout(key_columns: Iterable[str], indexes: Sequence[IndexDef], where: Where, order: Sequence[tuple[str, str]] = ()) -> str | None:
    """Which layout serves a request: None for the rows themselves, else an index's name.

    1. Key columns that cover the conditions, with no order asked: no index.
    2. An index that covers all conditions and has the order as a run; the smallest name wins.
    3. With two or more conditions, one that covers those beyond the key columns; the
       rest is checked on the rows.  Alternatives that straddle both can't be split.
    4. Otherwise an error.
    """
    wanted, keys, order = where.columns(), set(key_columns), tuple(order)
    if wanted <= keys and not order:
        return None
    fits = sorted(i.name for i in indexes if i.covers(wanted) and i.orders(order))
    if fits:
        return fits[0]
    beyond = wanted - keys
    straddles = any(set(m) & keys and set(m) - keys for m in where.any_of)
    if len(wanted) > 1 and beyond and not straddles:
        fits = sorted(i.name for i in indexes if i.covers(beyond) and i.orders(order))
        if fits:
            return fits[0]
    raise CatalogError(f"no index serves {sorted(wanted)} ordered by {list(order)}")
