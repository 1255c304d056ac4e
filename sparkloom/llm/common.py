"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark (the path may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under new names: ``pick(df, doc_id="id", text="body")``."""
    return df.select(*[F.col(f"`{c}`").alias(new) for new, c in cols.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset on one machine (tests) a folder of our own is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sparkloom-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_folder(spark: SparkSession, path: str) -> None:
    store, p = _store(spark, path)
    store.delete(p, True)


def tasks_of(df: DataFrame) -> int:
    """By how many tasks a frame of ``cut_lineage`` is read."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def cut_lineage(df: DataFrame, bytes_per_task: int = 8 << 20, tasks: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder, so lost executors cost no recomputation.

    It is read back by as many tasks as its bytes ask for, so a small frame doesn't
    make a shuffle file in each of many tasks, and long rows don't meet in one.
    Each task of the last stage writes a file.  With ``tasks``, where the caller can bound
    the bytes, there are at most so many, or two for each core if that is more.
    Spark deletes the files when nothing refers to them, if the cluster sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if tasks is not None:
        df = df.coalesce(max(tasks, 2 * spark.sparkContext.defaultParallelism))
    out = df.checkpoint(eager=True)
    store, p = _store(spark, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out.coalesce(max(1, -(-store.getContentSummary(p).getLength() // bytes_per_task)))


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this block Spark deletes the shuffle files of each finished query.

    For steps that are materialised by ``cut_lineage``: nothing reads their shuffles
    again.  Should something do so all the same, Spark runs the stage once more.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def groups(column, chars: int = 4_000_000) -> Iterator[list[str]]:
    """The strings of an Arrow column in lists of about so many characters, null as the empty text."""
    some, size = [], 0
    for value in column:
        some.append(value.as_py() or "")
        size += len(some[-1])
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some
