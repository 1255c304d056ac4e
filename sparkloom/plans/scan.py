"""Scan requests: predicates, key range, projection, order and page in one object."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PredicateError
from .predicate import Pred, Where, literal

Order = Sequence[tuple[str, str]]


def ordering(order: Order) -> list:
    """Columns for ``orderBy``; nulls come last either way."""
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in order]


@dataclass(frozen=True)
class Scan:
    """Everything a scan may ask for; ``run`` declares it and leaves the rest to Catalyst.

    ``key`` with ``start`` (inclusive) and ``stop`` (exclusive) is the key range.
    ``parent`` holds (foreign key, ids) of which rows are wanted.
    """

    where: Where = field(default_factory=Where)
    columns: Sequence[str] = ()
    key: str | None = None
    start: Any = None
    stop: Any = None
    parent: tuple[str, Sequence[Any]] | None = None
    order: Order = ()
    reverse: bool = False
    limit: int | None = None
    offset: int = 0

    def run(self, rows: DataFrame) -> DataFrame:
        if self.columns is not None and any(c not in rows.columns for c in self.columns):
            raise PredicateError(f"no such column: {sorted(set(self.columns) - set(rows.columns))}")
        if self.key and self.start is not None:
            rows = rows.where(F.col(self.key) >= literal(self.start))
        if self.key and self.stop is not None:
            rows = rows.where(F.col(self.key) < literal(self.stop))
        if self.parent:
            rows = rows.where(F.col(self.parent[0]).isin(*self.parent[1]))
        condition = self.where.to_column()
        if condition is not None:
            rows = rows.where(condition)
        order = list(self.order) or ([(self.key, "asc")] if self.key and (self.reverse or self.limit is not None) else [])
        if self.reverse:
            order = [(c, "asc" if d == "desc" else "desc") for c, d in order]
        if order:
            rows = rows.orderBy(*ordering(order))
        if self.offset:
            rows = rows.offset(self.offset)
        if self.limit is not None:
            rows = rows.limit(self.limit)
        return rows.select(*self.columns) if self.columns else rows


def project(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns; an empty list is an error."""
    if not columns:
        raise PredicateError("a projection needs columns")
    return rows.select(*columns)


__all__ = ["Order", "Pred", "Scan", "Where", "ordering", "project"]
