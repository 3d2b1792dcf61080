"""Session set-up, intermediate tables and input spreading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A table is broadcast only when its measured size stays under this bound.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(
    app_name: str = "termloom", master: str | None = None, **settings: str
) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # hash instead of sort-merge joins where every partition is measured to be small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "128MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # rows that hold long vectors go to Python in batches of bounded bytes
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables (``spark.checkpoint.dir``).

    A temporary folder is made only for a local session that names none.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="termloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Paths that the open scopes have written, innermost scope last.
_SCOPES: list[list[str]] = []

# Where materialize() put the tables that it returned.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the intermediate tables that were written inside it.

    Results must be written or collected before the scope ends, or be materialized with
    ``keep``.
    """
    written: list[str] = []
    _SCOPES.append(written)
    try:
        yield
    finally:
        _SCOPES.remove(written)
        for name in written:
            _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that :func:`materialize` returned, once nothing will read them again.

    Other tables are left alone.
    """
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            _delete(table.sparkSession, path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; inside a :func:`run_scope` it is removed with its tables."""
    path = f"{shared_folder(spark).rstrip('/')}/termloom-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(
    df: DataFrame,
    keep: bool = False,
    schema: StructType | None = None,
    rows_per_file: int | None = None,
) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage for good: a lost executor only re-reads files, and sampled
    or position-dependent columns keep the values they had.  Inside a
    :func:`run_scope` the table is removed when the scope ends; with ``keep`` when the scope
    around that one ends.  ``schema`` reads the columns as other types that are stored alike.
    ``rows_per_file`` is for rows of megabytes: a writer buffers, and a reader decodes at once,
    up to 4,096 rows of one file.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/termloom-{uuid.uuid4().hex}"
    owners = _SCOPES[:-1] if keep else _SCOPES
    if owners:
        owners[-1].append(path)
    # nothing reads the shuffles of a finished write again: free their disk at once
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_per_file or 0).parquet(path, compression="zstd")
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    table = spark.read.schema(schema or df.schema).parquet(path)
    _PATHS[table] = path
    return table


def sized(table: DataFrame, text: str) -> DataFrame:
    """A written table, marked for broadcast where its measured size allows.

    ``text`` is its only column of variable length.  Without the mark a join learns that the
    table is small only after the other side has been shuffled.
    """
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    small = int(size["b"] or 0) + 64 * size["n"] <= BROADCAST_LIMIT_BYTES
    return F.broadcast(table) if small else table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that has fewer splits than the session has cores.

    For CPU-heavy work on few or unsplittable files.  A scan with many splits is
    returned as it is, so nothing large is ever shuffled.  Call it right on a
    scan, before any join.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, *keys)
