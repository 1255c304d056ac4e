"""Hierarchies: nested reads, and writes and deletes that follow the hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.predicate import Where
from ..sources.catalog import Catalog


@dataclass
class Cascade:
    """What to read below a family: child family -> (condition, deeper request)."""

    family: str
    where: Where = field(default_factory=Where)
    columns: Sequence[str] = ()
    children: Sequence[Cascade] = ()


def read_nested(catalog: Catalog, table: str, request: Cascade) -> DataFrame:
    """Rows of the family, each with an array of structs for every requested child family.

    Children are aggregated by their parent key before the join, from the bottom up,
    so two child families never multiply.  Rows without children have empty arrays.
    Arrays are sorted by the children's primary keys.
    """
    spec = catalog.table(table)

    def level(r: Cascade) -> DataFrame:
        family = spec.family(r.family)
        rows = catalog.family_rows(table, r.family)
        condition = r.where.to_column()
        rows = rows if condition is None else rows.where(condition)
        if r.columns:
            keep = [family.pk, *([family.parent_key] if family.parent_key else []), *r.columns]
            rows = rows.select(*dict.fromkeys(keep))
        for child in r.children:
            below, key = level(child), spec.family(child.family).parent_key
            pk = spec.family(child.family).pk
            fields = [pk, *[c for c in below.columns if c not in (pk, key)]]
            packed = below.groupBy(F.col(key).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(child.family))
            joined = rows.join(packed, rows[family.pk] == packed["_parent"], "left").drop("_parent")
            rows = joined.withColumn(child.family, F.coalesce(child.family, F.array().cast(packed.schema[child.family].dataType)))
        return rows

    return level(request)


def split_nested(nested: DataFrame, pk: str, families: Mapping[str, str]) -> dict[str, DataFrame]:
    """The write side: flat rows of the root and of each child family (name -> parent key column)."""
    out = {"": nested.drop(*families)}
    for name, parent_key in families.items():
        out[name] = nested.select(F.col(pk).alias(parent_key), F.explode(name).alias("_row")).select(parent_key, "_row.*")
    return out


def delete_cascade(catalog: Catalog, table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """What remains of every family once these root ids (first column) and all below them are gone."""
    spec = catalog.table(table)
    out: dict[str, DataFrame] = {}

    def drop(name: str, gone: DataFrame, column: str) -> None:
        rows = catalog.family_rows(table, name)
        out[name] = rows.join(gone, rows[column] == gone["_gone"], "left_anti")
        children = spec.children(name)
        if children:
            pk = spec.family(name).pk
            below = gone if column == pk else rows.join(gone, rows[column] == gone["_gone"], "left_semi").select(F.col(pk).alias("_gone"))
            for child in children:
                drop(child.name, below, child.parent_key)

    drop(spec.main, ids.select(F.col(ids.columns[0]).alias("_gone")), spec.family(spec.main).pk)
    return out
