"""Tables, their families, keys, hierarchy and indexes.

A table is a set of families; each family is one DataFrame source with a primary
key and, below the main family, a foreign key to its parent.  The catalog holds
metadata only and lives in the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError, LockedError

ASC, DESC = "asc", "desc"


@dataclass(frozen=True)
class IndexDef:
    """A secondary index: covered columns and ordered columns with their direction."""

    name: str
    columns: tuple[str, ...]
    order_by: tuple[tuple[str, str], ...] = ()

    def covers(self, wanted: set[str]) -> bool:
        return wanted <= set(self.columns) | {c for c, _ in self.order_by}

    def orders(self, wanted: tuple[tuple[str, str], ...]) -> bool:
        """Do the wanted columns occur in the index's order as one run?"""
        n = len(wanted)
        return any(self.order_by[i : i + n] == tuple(wanted) for i in range(len(self.order_by) - n + 1))


@dataclass(frozen=True)
class FamilySpec:
    """One family: its source, primary key, key columns and place in the hierarchy."""

    name: str
    source: str
    pk: str
    key_columns: tuple[str, ...] = ()
    indexed: tuple[str, ...] = ()
    parent: str | None = None
    parent_key: str | None = None
    pk_width: int = 12


@dataclass(frozen=True)
class TableSpec:
    """A table with one main family and, below it, child families."""

    name: str
    main: str
    families: dict[str, FamilySpec]

    def family(self, name: str) -> FamilySpec:
        if name not in self.families:
            raise CatalogError(f"{self.name} has no family {name}")
        return self.families[name]

    def children(self, name: str) -> list[FamilySpec]:
        return [f for f in self.families.values() if f.parent == name]

    def path_to_root(self, name: str) -> list[FamilySpec]:
        out = [self.family(name)]
        while out[-1].parent:
            out.append(self.family(out[-1].parent))
        return out


@dataclass
class Catalog:
    """Known tables, their indexes and locks, and where their rows come from."""

    read: Callable[[str], DataFrame]
    tables: dict[str, TableSpec] = field(default_factory=dict)
    indexes: dict[tuple[str, str], dict[str, IndexDef]] = field(default_factory=dict)
    locked: set[tuple[str, str]] = field(default_factory=set)

    def table(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise CatalogError(f"no table {name}")
        return self.tables[name]

    def create_table(self, spec: TableSpec) -> TableSpec:
        """Add a table; doing so again changes nothing."""
        if spec.main not in spec.families:
            raise CatalogError(f"{spec.name}: main family {spec.main} is missing")
        return self.tables.setdefault(spec.name, spec)

    def drop_table(self, name: str) -> None:
        self.table(name)
        del self.tables[name]
        self.indexes = {k: v for k, v in self.indexes.items() if k[0] != name}

    def truncate_table(self, name: str) -> None:
        raise CatalogError(f"{name} is managed: truncation isn't allowed")

    def add_family(self, table: str, family: FamilySpec) -> None:
        spec = self.table(table)
        if family.name in spec.families:
            raise CatalogError(f"{table} has a family {family.name}")
        self.tables[table] = replace(spec, families={**spec.families, family.name: family})

    def drop_family(self, table: str, family: str) -> None:
        spec = self.table(table)
        spec.family(family)
        if family == spec.main or spec.children(family):
            raise CatalogError(f"{table}.{family} is the main family or has children")
        self.tables[table] = replace(spec, families={k: v for k, v in spec.families.items() if k != family})
        self.indexes.pop((table, family), None)

    def family_rows(self, table: str, family: str) -> DataFrame:
        return self.read(self.table(table).family(family).source)

    # indexes

    def add_index(self, table: str, family: str, index: IndexDef) -> None:
        self.table(table).family(family)
        known = self.indexes.setdefault((table, family), {})
        if index.name in known:
            raise CatalogError(f"{table}.{family} has an index {index.name}")
        known[index.name] = index

    def drop_index(self, table: str, family: str, name: str) -> None:
        if name not in self.indexes.get((table, family), {}):
            raise CatalogError(f"{table}.{family} has no index {name}")
        del self.indexes[table, family][name]

    def indexes_of(self, table: str, family: str) -> list[IndexDef]:
        return sorted(self.indexes.get((table, family), {}).values(), key=lambda i: i.name)

    def lock(self, table: str, family: str) -> None:
        if (table, family) in self.locked:
            raise LockedError(f"{table}.{family} is locked")
        self.locked.add((table, family))

    def unlock(self, table: str, family: str) -> None:
        self.locked.discard((table, family))

    def check_unlocked(self, table: str, family: str) -> None:
        if (table, family) in self.locked:
            raise LockedError(f"{table}.{family} is locked")

    # descriptions

    def describe(self, spark: SparkSession, name: str) -> DataFrame:
        """A row for each family of a table."""
        spec = self.table(name)
        rows = [(name, f.name, f.name == spec.main, f.pk, f.pk_width, f.parent, ",".join(f.key_columns), ",".join(f.indexed)) for f in spec.families.values()]
        return spark.createDataFrame(rows, "table_name string, family string, is_main boolean, pk string, pk_width int, parent string, key_columns string, indexed string")

    def list_tables(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.main, len(t.families)) for t in self.tables.values()]
        return spark.createDataFrame(rows, "table_name string, main_family string, families int")

    def list_indexes(self, spark: SparkSession, table: str, family: str) -> DataFrame:
        rows = [(i.name, ",".join(i.columns), ",".join(f"{c} {d}" for c, d in i.order_by)) for i in self.indexes_of(table, family)]
        return spark.createDataFrame(rows, "index_name string, columns string, order_by string")


def parquet_reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """Sources are names of Parquet tables in a folder."""
    return lambda source: spark.read.parquet(f"{folder}/{source}.parquet")


def column_summary(df: DataFrame) -> DataFrame:
    """Column names and types of a frame, as rows."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "position int, column_name string, column_type string").orderBy(F.col("position"))
