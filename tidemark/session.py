"""Session defaults and the one place where intermediate tables are staged."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def build(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


_own_dirs: dict[str, str] = {}


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir``.

    Only a ``local`` master may fall back to a folder of its own, because executors on other
    machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if own := _own_dirs.get(spark.sparkContext.applicationId):
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can read")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _own_dirs[spark.sparkContext.applicationId] = folder
    return folder


def run_dir(spark: SparkSession) -> str:
    """Folder of everything this application stages."""
    return f"{stage_dir(spark)}/run-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def end_run(spark: SparkSession) -> None:
    """Delete what this application has staged. Call it when no result of the run is read any more."""
    spark.catalog.clearCache()
    for table in _bucketed.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    _delete(spark, run_dir(spark))


_scopes: list[str] = []


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """What is staged inside goes to a folder of that name, for ``end_scope`` to delete on its own."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def end_scope(spark: SparkSession, name: str) -> None:
    _delete(spark, f"{run_dir(spark)}/{name}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: dict[int, tuple[int, str | None]] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go with its end: nothing reads them again. Otherwise they stay until the driver happens to
    collect its garbage, and those of all tables of a run add up. The session's own setting comes back after the last such write."""
    own = id(spark)
    with _lock:
        count, before = _writing.get(own) or (0, spark.conf.get(_CLEANUP, None))
        _writing[own] = count + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            count, before = _writing.pop(own)
            if count > 1:
                _writing[own] = count - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def write_stage(df: DataFrame, name: str, by: list[str] | None = None) -> str:
    """Write ``df`` under the shared folder and return its path. ``by`` partitions the table, for
    readers that want few of the values; rows are range-partitioned over ``by`` and the next
    column, so a hot value spans many tasks."""
    path = "/".join([run_dir(df.sparkSession), *_scopes[-1:], f"{name}-{uuid.uuid4().hex}"])
    with shuffles_end(df.sparkSession):
        if by:
            rest = [c for c in df.columns if c not in by][:1]
            df.repartitionByRange(*by, *rest).write.partitionBy(*by).parquet(path)
        else:
            df.write.parquet(path)
    return path


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a result feeds several branches of a plan: the table is computed once, a lost
    executor does not lose it, and the reader sees real file sizes when it picks join strategies.
    """
    path = write_stage(df, name, by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


_bucketed: dict[str, list[str]] = {}


def stage_bucketed(df: DataFrame, name: str, key: str, order: list[str], buckets: int,
                   dealt: bool = False) -> DataFrame:
    """Stage ``df`` dealt over ``buckets`` by a hash of ``key``, each sorted by ``order`` and written by one task.

    Windows, groups and joins by ``key`` read such a table without a shuffle. ``buckets`` is a statement about size: a
    bucket is one task's input, so take as many as cores at least and more where a bucket would not fit. A key's
    rows must fit one task, as they must for a window over them. ``dealt`` says that ``df`` comes from a repartition into
    ``buckets`` by ``key``, and spares another one.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table = f"tidemark_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, key)
    with shuffles_end(spark):
        (rows.sortWithinPartitions(*order).write.format("parquet").option("path", path)
         .bucketBy(buckets, key).sortBy(*order).saveAsTable(table))
    _bucketed.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table).select(df.columns)


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for work that multiplies rows. Small inputs arrive in one or two files and
    would be expanded by as many tasks; large ones already come in many and are left alone. ``df``
    is a scan (of a staged table, say): asking a shuffled plan for its partitions would run it."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


TRAIN_PARTITIONS = 8


def training_layout(df: DataFrame, key: list[str], partitions: int = TRAIN_PARTITIONS) -> DataFrame:
    """Rows dealt by a hash of ``key`` into a stated number of partitions and sorted inside. Learners
    that draw samples per partition then give the same model for any layout of the input; raise
    ``partitions`` for training sets of many millions of rows."""
    return df.repartition(partitions, *key).sortWithinPartitions(*key)
