"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset on a local master (tests), a temporary one.

    Every driver process uses a sub-folder of its own, which goes when the process ends. A cluster's
    executors see no folder of the driver, so there the setting must be made.
    """
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local = _local or "file://" + tempfile.mkdtemp(prefix="spark-docloom-", dir="/tmp")
    folder = f"{root.rstrip('/')}/docloom-{_RUN}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_folders: set[str] = set()
_local: str | None = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder or table that nothing reads any more."""
    if spark.sparkContext._jsc is None:  # the session has been stopped
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Shuffle files of what is run within go with its end; else they stay until the driver's memory is cleaned.

    For tables of these functions: what reads them needs no shuffle of those that made them.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder, in folders by its column ``by``, and reads it back.

    Unlike a cached or locally checkpointed frame it outlives the executors that made it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def materialise_sorted(df: DataFrame, name: str, buckets: int, keys: list[str], dealt: bool = False) -> DataFrame:
    """Writes ``df`` as a table dealt into ``buckets`` by ``keys``, each a file in their order, and reads it back.

    Spark knows how such a table is dealt: tables of equal numbers of buckets are joined on ``keys`` and
    grouped by them where they lie. ``dealt`` says that ``df`` is the result of just that.
    """
    spark, table = df.sparkSession, f"docloom_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    (df if dealt else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    _paths[out], _names[out] = path, table
    atexit.register(_forget, spark, table)
    return out


def _forget(spark: SparkSession, table: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


_names: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop(table: DataFrame) -> None:
    """Deletes a table of these functions that no later step reads."""
    if table in _names:
        _forget(table.sparkSession, _names.pop(table))
    _remove(table.sparkSession, _paths.pop(table))
