"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tallyworth", **settings: str) -> SparkSession:
    """A session with the adaptive settings this library counts on.

    Master, memory and shuffle partitions come from spark-submit or `settings`.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the functions that run in Python there."""
    context = spark.sparkContext
    if getattr(context, "_tallyworth_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tallyworth-code-')}/tallyworth", "zip", package.parent, package.name)
    context.addPyFile(archive)  # Spark's own file server hands it out
    context._tallyworth_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where the session names none, a local master gets a temporary folder of its own; on a cluster that
    would not be visible to other machines, so it is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    existing = context.getCheckpointDir()
    if existing:
        return existing
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tallyworth-")
    context.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, grouped by application."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark).rstrip('/')}/tallyworth/{app}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of this table, not a new scan of the
    transactions. Parquet rather than a checkpoint, so that later steps still prune columns.
    """
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As `materialise`, with the path, for a caller that drops the table once it is used up."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for paths in _recorders:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)  # written and read once or twice: small files count more than speed
    return spark.read.schema(df.schema).parquet(path), path


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the intermediate tables written inside, for a job that drops them once its result is stored."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [held for held in _recorders if held is not paths]


def discard(spark: SparkSession, path: str) -> bool:
    """Delete an intermediate table that nothing reads any more."""
    target, files = _files(spark, path)
    return files.delete(target, True)


def hold(df: DataFrame) -> DataFrame:
    """Persist a table for the rounds of one computation, which unpersists it at its end."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def written_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`; it is built and written only if no complete one is there.

    The caller names the input in the path: a table of the same path is taken for the same table.
    """
    marker, files = _files(spark, f"{path.rstrip('/')}/_SUCCESS")
    if not files.exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete the intermediate tables this application wrote under the shared folder."""
    app = spark.sparkContext.applicationId
    target, files = _files(spark, f"{scratch_root(spark).rstrip('/')}/tallyworth/{app}")
    return files.delete(target, True)
