"""The folder all executors share, and small texts in it, by Spark's own file systems."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        found = f"file://{tempfile.mkdtemp(prefix='pointloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def storage(spark: SparkSession):
    """Writes a table to the shared folder and reads it back: lineage ends there, and lost executors do no harm."""
    folder(spark)

    def store(df: DataFrame) -> DataFrame:
        path = fresh(spark, "nodes")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, where = _file(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _file(spark, path)
    lines = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(lines, "UTF-8")
    finally:
        lines.close()


def move_named(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """Moves these files from one folder to another, which is made, and removes the first with what else is in it."""
    files, where = _file(spark, source)
    to = _file(spark, target)[1]
    files.mkdirs(to)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in names:
        if not files.rename(path(where, name), path(to, name)):
            raise OSError(f"{name} could not be moved to {target}")
    files.delete(where, True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path, if it is there."""
    try:
        files, where = _file(spark, path)
        files.delete(where, True)
    except Exception:  # the session may be gone; the folder is temporary then
        return
