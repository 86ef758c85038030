"""Helpers shared by the operators: shared-folder tables, word splitting, fold assignment."""

from __future__ import annotations

import gc

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pointloom.llm
from pointloom.sources.shared import fresh, remove

# Worker functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(pointloom.llm)

#: Java / RE2 class of the white space that separates words.
WS = r"[\x20\x09-\x0D]"
#: The same class as a plain string of characters.
WS_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Remove a table of :func:`stored` that nothing reads any more, and let Spark drop shuffle files of finished steps."""
    spark = df.sparkSession
    remove(spark, df._stored_at)
    release(spark)


def release(spark: SparkSession) -> None:
    """Spark deletes a finished step's shuffle files when the driver collects its garbage: collect it now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run):
    """The worker function ``run``, which at its end gives back the memory that allocators keep: workers live on for the next task."""

    def done(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            return

    return done


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def unit_hash(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) drawn from the id, the same in every run."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and nothing else, so further columns of the input cannot clash with those made here."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Send at most so many rows and bytes at a time to Python workers: their memory then follows the longest text, not a batch of them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            now = int(spark.conf.get(key).rstrip("b"))
        except ValueError:  # a size with a unit
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


#: Up to so many ids (some 40 MB as a hash table) a list of ids is sent to every executor; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame, label: str, most: int = BROADCAST_IDS) -> DataFrame:
    """A stored list of ids, marked for broadcast if its counted size allows: texts then stay where they are read."""
    ids = stored(ids, label)
    return F.broadcast(ids) if ids.count() <= most else ids
