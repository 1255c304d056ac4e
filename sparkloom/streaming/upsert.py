"""An index kept current from a stream of changes.

State holds the last change of every document id, deletes included as tombstones,
so late and repeated changes can't undo later ones.  It is kept in buckets by the hash
of the id; a micro-batch rewrites the buckets that it touches, and a small manifest then
tells which version of each bucket counts.  Readers see the last complete version.
Running a batch again gives the same version, so a restart is harmless.  Files that
neither of the last two versions needs are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import CatalogError
from ..operators.write import latest
from ..sources.catalog import Catalog, FamilySpec, TableSpec
from ..sources.shared import Files

DELETE = "Delete"


def apply_changes(state: DataFrame | None, batch: DataFrame, pk: str, order: Sequence[str]) -> DataFrame:
    """The last change of each id of state and batch."""
    return latest(batch if state is None else state.unionByName(batch), pk, order)


def visible(state: DataFrame, op: str = "op") -> DataFrame:
    """The rows of a state that aren't deleted."""
    return state.where(F.col(op) != DELETE)


@dataclass
class VersionedIndex:
    """Versions of a state in a folder that all executors share."""

    spark: SparkSession
    folder: str
    pk: str
    order: Sequence[str]
    buckets: int = 64

    def __post_init__(self) -> None:
        self.files = Files(self.spark)

    def _data(self, version: int) -> str:
        return f"{self.folder}/data/v={version:012d}"

    def _told(self, version: int) -> str:
        return f"{self.folder}/manifest/{version:012d}.json"

    def _done(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(f"{self.folder}/manifest") if n.endswith(".json")]

    def manifest(self, version: int) -> dict[str, int]:
        """Bucket -> the version that wrote it last."""
        return json.loads(self.files.read(self._told(version)))

    def _read(self, held: dict[str, int]) -> DataFrame | None:
        parts = [f"{self._data(v)}/_bucket={b}" for b, v in held.items()]
        return self.spark.read.parquet(*parts) if parts else None

    def state(self, before: int | None = None) -> DataFrame | None:
        done = [v for v in self._done() if before is None or v < before]
        return self._read(self.manifest(done[-1])) if done else None

    def write_batch(self, batch: DataFrame, version: int) -> None:
        """Fold a batch into the state; it is read twice, so it must be one that gives the same rows again."""
        done = [v for v in self._done() if v < version]
        held = self.manifest(done[-1]) if done else {}
        keyed = batch.withColumn("_bucket", F.pmod(F.xxhash64(self.pk), F.lit(self.buckets)))
        touched = [str(r[0]) for r in keyed.select("_bucket").distinct().collect()]  # at most ``buckets`` rows
        old = self._read({b: held[b] for b in touched if b in held})
        if touched:
            new = apply_changes(old, batch, self.pk, self.order).withColumn("_bucket", F.pmod(F.xxhash64(self.pk), F.lit(self.buckets)))
            new.write.mode("overwrite").partitionBy("_bucket").parquet(self._data(version))
        now = held | {b: version for b in touched}
        self.files.write(self._told(version), json.dumps(now))
        needed = {*now.values(), *held.values()}
        for name in self.files.names(f"{self.folder}/data"):
            if int(name[2:]) not in needed and int(name[2:]) < version:
                self.files.delete(f"{self.folder}/data/{name}")
        for v in done[:-1]:
            self.files.delete(self._told(v))

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process what is there and stop."""
        return changes.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over Parquet files; the number of files bounds a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_metadata(catalog: Catalog, events: Sequence[dict]) -> Catalog:
    """Apply DDL events in order: ADDTB, DROPTB, ADDCF, DROPCF, ADDIDX, DROPIDX, LOCK, RELEASE."""
    actions = {
        "ADDTB": lambda e: catalog.create_table(e["spec"] if isinstance(e["spec"], TableSpec) else TableSpec(**e["spec"])),
        "DROPTB": lambda e: catalog.drop_table(e["table"]),
        "ADDCF": lambda e: catalog.add_family(e["table"], e["spec"] if isinstance(e["spec"], FamilySpec) else FamilySpec(**e["spec"])),
        "DROPCF": lambda e: catalog.drop_family(e["table"], e["family"]),
        "ADDIDX": lambda e: catalog.add_index(e["table"], e["family"], e["index"]),
        "DROPIDX": lambda e: catalog.drop_index(e["table"], e["family"], e["name"]),
        "LOCK": lambda e: catalog.lock(e["table"], e["family"]),
        "RELEASE": lambda e: catalog.unlock(e["table"], e["family"]),
    }
    for e in events:
        if e.get("op") not in actions:
            raise CatalogError(f"unknown event {e.get('op')}")
        actions[e["op"]](e)
    return catalog
