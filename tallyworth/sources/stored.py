"""Tables that are built once and notice when they are out of date.

A stored table is a folder of Parquet files and, beside it, a manifest: the fingerprint of the plan and of the files that
it reads, and the names and sizes of the files written. The manifest is written last, so a table without one, or whose
files are not as it says, was torn and is built again; so is one whose plan or input has changed.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "manifest.json"
_FIELDS = "spark.sql.debug.maxToStringFields"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """Size and time of change of every file of a folder, by its path."""
    target, files = _file_system(spark, folder)
    if not files.exists(target):
        return {}
    return {f.getPath().toString(): (f.getLen(), f.getModificationTime()) for f in files.listStatus(target) if f.isFile()}


def _input_files(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, size and time of change of the files that `df` reads: one listing for each of their folders."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(name) for name in df.inputFiles()]
    wanted = {path.toString() for path in paths}
    found: dict[str, tuple[int, int]] = {}
    for folder in {path.getParent().toString() for path in paths}:
        found.update(_listed(spark, folder))
    return sorted((name, *found.get(name, (-1, -1))) for name in wanted)


def fingerprint(df: DataFrame) -> str:
    """A digest of the plan, without the numbers that Spark gives its columns, and of the files that it reads.

    Data of other kinds than files is known by its plan only. A function of the user's own counts by its name.
    """
    spark = df.sparkSession
    before = spark.conf.get(_FIELDS, None)
    spark.conf.set(_FIELDS, str(1 << 20))  # else wide plans are cut short
    try:
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        if before is None:
            spark.conf.unset(_FIELDS)
        else:
            spark.conf.set(_FIELDS, before)
    about = [plan, df.schema.json(), _input_files(df)]
    return hashlib.sha256(json.dumps(about).encode()).hexdigest()


def _manifest(spark: SparkSession, path: str) -> dict | None:
    target, files = _file_system(spark, f"{path}/{_MANIFEST}")
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    except (ValueError, Py4JJavaError):  # half a manifest, or one that does not fit its checksum
        return None
    finally:
        stream.close()


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    names = {name.rsplit("/", 1)[-1]: size for name, (size, _) in _listed(spark, folder).items()}
    return {name: size for name, size in names.items() if not name.startswith(("_", "."))}


def _commit(spark: SparkSession, path: str, about: dict) -> None:
    """Put a manifest in the place of the last one; a job that dies in between leaves none."""
    new, files = _file_system(spark, f"{path}/.{_MANIFEST}-{uuid.uuid4().hex}")
    out = files.create(new, True)
    out.write(bytearray(json.dumps(about).encode()))
    out.close()
    target, _ = _file_system(spark, f"{path}/{_MANIFEST}")
    files.delete(target, False)
    files.rename(new, target)


def stored(df: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """The rows of `df` as the table at `path`, and whether it had to be built now.

    It is built if there is none, if it was torn, or if plan or input files are not those it was built from. Every build
    goes into a folder of its own; the one before it is deleted once the new manifest stands.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    now, about = fingerprint(df), _manifest(spark, path)
    if about and about["fingerprint"] == now and _sizes(spark, f"{path}/{about['folder']}") == about["files"]:
        return spark.read.schema(df.schema).parquet(f"{path}/{about['folder']}"), False
    folder = f"build-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _commit(spark, path, {"fingerprint": now, "folder": folder, "files": _sizes(spark, f"{path}/{folder}")})
    if about:
        old, files = _file_system(spark, f"{path}/{about['folder']}")
        files.delete(old, True)
    return spark.read.schema(df.schema).parquet(f"{path}/{folder}"), True
