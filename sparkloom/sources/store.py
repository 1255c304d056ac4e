"""Tables kept in a folder: rows, indexes, locks and descriptions outlive the session.

Every change writes new files and then one small description file with the next number;
readers open the last one, so they see a change whole or not at all.  One writer at a
time: a description that another writer has numbered alike is refused.  The files that
a change replaces are deleted with the change after it, so running reads can end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError
from ..operators import cascade, index, join, write
from ..plans.predicate import Where
from ..plans.scan import Scan
from .catalog import Catalog, FamilySpec, IndexDef, TableSpec
from .shared import Files


def _spec(d: dict) -> TableSpec:
    families = {n: FamilySpec(**{**f, "key_columns": tuple(f["key_columns"]), "indexed": tuple(f["indexed"])}) for n, f in d["families"].items()}
    return TableSpec(d["name"], d["main"], families)


def _index(d: dict) -> IndexDef:
    return IndexDef(d["name"], tuple(d["columns"]), tuple((c, way) for c, way in d["order_by"]))


def _part(where: Where, known: set[str]) -> Where:
    """The conditions on these columns alone; the others are checked on the rows."""
    maps = {n: {c: v for c, v in getattr(where, n).items() if c in known} for n in ("in_list", "between", "contains", "starts", "matches")}
    alternatives = where.any_of if all(set(m) <= known for m in where.any_of) else []
    return replace(where, all_of=[p for p in where.all_of if p.column in known], any_of=alternatives, **maps)


class Store:
    """A catalog whose tables, indexes and locks are files under ``folder``, which all executors must reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        self.refresh()

    # descriptions

    def refresh(self) -> None:
        """Read the last description again: what other writers have done since."""
        numbers = [int(n[:12]) for n in self.files.names(f"{self.folder}/meta") if n.endswith(".json")]
        self.number = max(numbers, default=0)
        told = json.loads(self.files.read(self._meta(self.number))) if numbers else {}
        self.paths: dict[str, str] = told.get("paths", {})
        self.replaced: list[str] = told.get("replaced", [])
        self.catalog = Catalog(lambda source: self.spark.read.parquet(self.paths[source]))
        for t in told.get("tables", []):
            self.catalog.create_table(_spec(t))
        for t, f, i in told.get("indexes", []):
            self.catalog.add_index(t, f, _index(i))
        self.catalog.locked = {(t, f) for t, f in told.get("locked", [])}

    def _meta(self, number: int) -> str:
        return f"{self.folder}/meta/{number:012d}.json"

    def _commit(self, replaced: Sequence[str] = ()) -> None:
        if self.files.exists(self._meta(self.number + 1)):
            raise CatalogError("another writer was faster; refresh and try again")
        old, c = self.replaced, self.catalog
        own = [p for p in replaced if p.startswith(self.folder)]
        self.files.write(self._meta(self.number + 1), json.dumps({
            "tables": [asdict(t) for t in c.tables.values()], "indexes": [[t, f, asdict(i)] for (t, f), known in c.indexes.items() for i in known.values()],
            "locked": sorted(c.locked), "paths": self.paths, "replaced": own,
        }))
        self.number, self.replaced = self.number + 1, own
        for path in old:
            self.files.delete(path)

    def _new_path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts, str(uuid.uuid4())])

    # tables

    def create_table(self, spec: TableSpec, rows: Mapping[str, DataFrame | str]) -> None:
        """Add a table; doing so again changes nothing.  A family's rows are a frame, which is stored, or a path, which is read where it is."""
        if spec.name in self.catalog.tables:
            return
        families = {n: replace(f, source=f"{spec.name}/{n}") for n, f in spec.families.items()}
        for n in families:
            given = rows[n]
            self.paths[f"{spec.name}/{n}"] = path = given if isinstance(given, str) else self._new_path("rows", spec.name, n)
            if not isinstance(given, str):
                given.write.parquet(path)
        self.catalog.create_table(replace(spec, families=families))
        self._commit()

    def drop_table(self, name: str) -> None:
        """Forget a table and its indexes; what the store has written of them is deleted."""
        for family in self.catalog.table(name).families:
            self.catalog.check_unlocked(name, family)
        self.catalog.drop_table(name)
        gone = [k for k in self.paths if k.split("/")[0] == name]
        self._commit([self.paths.pop(k) for k in gone])

    def add_family(self, table: str, family: FamilySpec, rows: DataFrame | str) -> None:
        source = f"{table}/{family.name}"
        self.catalog.add_family(table, replace(family, source=source))
        self.paths[source] = path = rows if isinstance(rows, str) else self._new_path("rows", table, family.name)
        if not isinstance(rows, str):
            rows.write.parquet(path)
        self._commit()

    def drop_family(self, table: str, family: str) -> None:
        self.catalog.check_unlocked(table, family)
        self.catalog.drop_family(table, family)
        gone = [k for k in self.paths if k == f"{table}/{family}" or k.startswith(f"{table}/{family}/")]
        self._commit([self.paths.pop(k) for k in gone])

    def rows(self, table: str, family: str) -> DataFrame:
        return self.catalog.family_rows(table, family)

    # locks and indexes

    def lock(self, table: str, family: str) -> None:
        """No write and no change of indexes until ``unlock``, by any user of the folder."""
        self.catalog.lock(table, family)
        self._commit()

    def unlock(self, table: str, family: str) -> None:
        self.catalog.unlock(table, family)
        self._commit()

    def create_index(self, table: str, family: str, wanted: IndexDef) -> DataFrame:
        """Build an index; the family is locked meanwhile.  Returns the number of rows indexed."""
        self.lock(table, family)
        path = self._new_path("index", table, family, wanted.name)
        try:
            self.catalog.add_index(table, family, wanted)
            index.write_index(self.rows(table, family), wanted, self.catalog.table(table).family(family).pk, path)
            self.paths[f"{table}/{family}/{wanted.name}"] = path
        finally:
            self.unlock(table, family)
        return self.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_indexed"))

    def drop_index(self, table: str, family: str, name: str) -> int:
        """Forget an index and delete its files with the next change; returns the number of its rows."""
        self.catalog.check_unlocked(table, family)
        self.catalog.drop_index(table, family, name)
        path = self.paths.pop(f"{table}/{family}/{name}")
        n = self.spark.read.parquet(path).count()
        self._commit([path])
        return n

    # reads

    def layout(self, table: str, family: str, request: Scan) -> str | None:
        """The index that a scan goes through, None for the rows themselves.

        Rows with a missing value aren't in an index, so only indexes all of whose
        columns the conditions name are asked (a missing value satisfies none).
        """
        wanted = request.where.columns()
        known = [i for i in self.catalog.indexes_of(table, family) if {*i.columns, *(c for c, _ in i.order_by)} <= wanted]
        try:
            return index.choose_layout(self.catalog.table(table).family(family).key_columns, known, request.where, request.order)
        except CatalogError:
            return None

    def scan(self, table: str, family: str, request: Scan) -> DataFrame:
        """The rows of a request, through an index if one serves it.

        Conditions are pushed to the index's files, which are sorted by its leading
        columns.  An index that has all columns asked for is read alone; otherwise its
        keys restrict the rows, on which all conditions are checked again.
        """
        rows, name = self.rows(table, family), self.layout(table, family, request)
        if name is None:
            return request.run(rows)
        stored, pk = self.spark.read.parquet(self.paths[f"{table}/{family}/{name}"]), self.catalog.table(table).family(family).pk
        also = [c for c, _ in request.order] + ([request.key] if request.key else []) + ([request.parent[0]] if request.parent else [])
        if {*(request.columns or rows.columns), *request.where.columns(), *also} <= set(stored.columns):
            return request.run(stored)
        condition = _part(request.where, set(stored.columns)).to_column()
        return request.run(join.restrict_to(rows, stored.where(condition).select(pk), pk))

    # writes

    def _put(self, table: str, states: Mapping[str, DataFrame]) -> None:
        """New rows of some families, and of all their indexes, in one change."""
        for family in states:
            self.catalog.check_unlocked(table, family)
        replaced, paths = [], dict(self.paths)
        for family, state in states.items():
            paths[f"{table}/{family}"] = path = self._new_path("rows", table, family)
            state.write.parquet(path)
            replaced.append(self.paths[f"{table}/{family}"])
            for i in self.catalog.indexes_of(table, family):
                key = f"{table}/{family}/{i.name}"
                paths[key] = self._new_path("index", table, family, i.name)
                index.write_index(self.spark.read.parquet(path), i, self.catalog.table(table).family(family).pk, paths[key])
                replaced.append(self.paths[key])
        self.paths = paths
        self._commit(replaced)

    def _key(self, table: str, family: str) -> str:
        self.catalog.check_unlocked(table, family)
        return self.catalog.table(table).family(family).pk

    def insert(self, table: str, family: str, new: DataFrame) -> None:
        self._key(table, family)
        self._put(table, {family: write.insert(self.rows(table, family), new)})

    def update(self, table: str, family: str, changes: DataFrame, order: Sequence[str]) -> None:
        self._put(table, {family: write.update(self.rows(table, family), changes, self._key(table, family), order)})

    def upsert(self, table: str, family: str, changes: DataFrame, order: Sequence[str]) -> None:
        self._put(table, {family: write.upsert(self.rows(table, family), changes, self._key(table, family), order)})

    def delete(self, table: str, family: str, ids: DataFrame) -> None:
        self._put(table, {family: write.delete(self.rows(table, family), ids, self._key(table, family))})

    def put_nested(self, table: str, nested: DataFrame, order: Sequence[str] = ()) -> None:
        """Upsert whole rows of the main family and, from their arrays of structs, of its children; one change.

        Without ``order`` columns among the rows, ids must be unique within the frame.
        """
        spec = self.catalog.table(table)
        pk = spec.family(spec.main).pk
        children = {f.name: f.parent_key for f in spec.children(spec.main) if f.name in nested.columns}
        states = {}
        for name, part in cascade.split_nested(nested, pk, children).items():
            family = spec.family(name or spec.main)
            states[family.name] = write.upsert(self.rows(table, family.name), part, family.pk, order or [family.pk])
        self._put(table, states)

    def delete_cascade(self, table: str, ids: DataFrame) -> None:
        """Delete these rows of the main family and everything below them; one change."""
        self._put(table, cascade.delete_cascade(self.catalog, table, ids))
