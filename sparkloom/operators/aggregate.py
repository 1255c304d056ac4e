"""Global and grouped aggregates.

Sums and averages are exact: decimals and whole numbers are added as they are, doubles
as decimals of ``SCALE`` places (their shortest spelling), so the order of rows changes
nothing.  A value or sum beyond 26 digits before the point is an error.  Averages are
rounded half up to two places.  Decimals give decimals, whole numbers give decimals
without places, other numbers doubles.  Nulls are skipped; with ``strict`` a null in the
aggregated column is an error.  Catalyst aggregates partially before the one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, IntegralType

from ..errors import AggregateError

#: Places of the decimals that doubles are added as.
SCALE = 12


def _exact(c: Column, kind: DataType, scale: int) -> Column:
    if isinstance(kind, DecimalType):
        return c
    return c.cast("decimal(38,0)" if isinstance(kind, IntegralType) else f"decimal(38,{scale})")


def _sum(c: Column, kind: DataType, scale: int = SCALE) -> Column:
    out = F.sum(_exact(c, kind, scale))
    return out if isinstance(kind, (DecimalType, IntegralType)) else out.cast("double")


def _avg(c: Column, kind: DataType, scale: int = SCALE) -> Column:
    out = F.round(F.avg(_exact(c, kind, scale)), 2)
    return out if isinstance(kind, DecimalType) else out.cast("double")


#: From the column, its type and the scale for doubles.
AGGREGATES: dict[str, Callable[[Column, DataType, int], Column]] = {
    "sum": _sum,
    "min": lambda c, kind=None, scale=SCALE: F.min(c),
    "max": lambda c, kind=None, scale=SCALE: F.max(c),
    "count": lambda c, kind=None, scale=SCALE: F.count(F.lit(1)),
    "avg": _avg,
    "std": lambda c, kind=None, scale=SCALE: F.stddev_pop(c.cast("double")),
    "median": lambda c, kind=None, scale=SCALE: F.median(c.cast("double")),
}


def _one(rows: DataFrame, kind: str, column: str | None, as_type: str | None, strict: bool, scale: int) -> Column:
    if kind not in AGGREGATES:
        raise AggregateError(f"unknown aggregate {kind}")
    if kind == "count":
        return AGGREGATES[kind](F.lit(1), DoubleType(), scale)
    if column is None or column not in rows.columns:
        raise AggregateError(f"no such column: {column}")
    c = F.col(column)
    if strict:
        c = F.when(c.isNull(), F.raise_error(F.lit(f"{column} is missing"))).otherwise(c)
    c = c.cast(as_type) if as_type else c
    return AGGREGATES[kind](c, rows.select(c.alias("_")).schema[0].dataType, scale)


def aggregate(rows: DataFrame, kind: str, column: str | None = None, as_type: str | None = None, strict: bool = False, name: str | None = None, scale: int = SCALE) -> DataFrame:
    """One row with the aggregate; ``as_type`` reads text as double, date and so on."""
    return rows.agg(_one(rows, kind, column, as_type, strict, scale).alias(name or f"{kind}_{column or 'rows'}"))


def group_aggregate(rows: DataFrame, by: Sequence[str], kind: str, column: str | None = None, as_type: str | None = None, strict: bool = False, name: str | None = None, scale: int = SCALE) -> DataFrame:
    """A row for each group, with its key columns."""
    unknown = sorted(set(by) - set(rows.columns))
    if not by or unknown:
        raise AggregateError(f"no such group column: {unknown}")
    return rows.groupBy(*by).agg(_one(rows, kind, column, as_type, strict, scale).alias(name or f"{kind}_{column or 'rows'}"))


def group_label(by: Sequence[str], name: str = "group_key") -> Column:
    """The group as one text, values joined by ``,`` and missing ones left out; for display only."""
    return F.concat_ws(",", *[F.col(c).cast("string") for c in by]).alias(name)


def in_ranges(rows: DataFrame, key: str, prefixes: Sequence) -> DataFrame:
    """Rows whose key is one of these, for aggregates over explicit ranges."""
    return rows.where(F.col(key).isin(*prefixes)) if prefixes else rows.where(F.lit(False))
