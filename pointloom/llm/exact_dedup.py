"""Operator 8, exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level counts its groups with a partial aggregation and only members of groups of two or more go
on to the next, wider key; the digest of the full content is compared for those survivors alone.
Texts are equal when identical after every run of white space becomes one space. Groups are never
gathered: a group is a row of (smallest id, size), joined back to its members where they are: the list of
groups is sent to every task behind a count, and beyond it joined by a sort-merge join whose large partitions
AQE may split, so a group holding a third of the table is no obstacle.

Defined results: null counts as the empty text; rows with a null id never stay unless all ids of
their group are null; rows with the same id and the same text are all reported, and each is counted.
Further columns of the input are ignored here and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import WS, documents, only, sized, stored

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256


def normal(text_col: str) -> Column:
    """The text with one space for every run of white space."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{WS}+", " ")


def profile(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One scan: normalised length, hash of the prefix, SHA-256 of the whole normalised text."""
    df = only(df, id_col, text_col).select(F.col(id_col).alias("id"), normal(text_col).alias("_n"))
    return df.select(
        "id",
        F.octet_length("_n").alias("n"),
        F.xxhash64(F.substring("_n", 1, PREFIX_CHARS)).alias("prefix"),
        F.sha2(F.col("_n").cast("binary"), 256).alias("digest"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: (n, prefix, digest, keep_id, size), by progressive refinement."""

    def shared(over: DataFrame, *keys: str) -> DataFrame:
        return over.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*keys)

    # Lengths are few and sent to every task, so rows of one length do not meet in a task.
    by_length = rows.join(sized(shared(rows.select("n"), "n"), "exact-lengths"), "n", "left_semi")
    by_prefix = by_length.join(sized(shared(by_length.select("n", "prefix"), "n", "prefix"), "exact-prefixes"), ["n", "prefix"], "left_semi")
    whole = by_prefix.groupBy("n", "prefix", "digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    return whole.filter("size > 1")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    rows = stored(profile(df, id_col, text_col), "exact-profile")
    found = sized(groups(rows), "exact-groups")
    return rows.join(found, ["n", "prefix", "digest"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("id") == F.coalesce("keep_id", "id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every text, with all its columns: a row with the smallest id, a null id only where no other has the text.

    Every row is judged by its own digest, so repeated ids and null ids are no obstacle. Of rows equal in id and
    text the first in order of their JSON stays. Only groups of copies are listed, not copies.
    """
    rows = stored(profile(df, id_col, text_col), "exact-profile")
    copies = rows.join(sized(groups(rows).select("n", "prefix", "digest"), "exact-groups"), ["n", "prefix", "digest"], "left_semi")
    copies = copies.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("size"))
    best = copies.groupBy(F.unhex("digest").alias("_exact_key")).agg(F.min(F.struct(F.col("id").isNull(), "id", "size")).alias("_exact_best"))
    best = sized(best.select("_exact_key", F.col("_exact_best.id").alias("_exact_id"), F.col("_exact_best.size").alias("_exact_size")), "exact-copies")
    key = F.unhex(F.sha2(normal(text_col).cast("binary"), 256))
    judged = df.withColumn("_exact_own", key).join(best, F.col("_exact_own") == F.col("_exact_key"), "left")
    judged = judged.filter(F.col("_exact_key").isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col("_exact_id")))
    once = judged.filter("coalesce(_exact_size, 1) = 1").select(*df.columns)
    if best.filter("_exact_size > 1").isEmpty():
        return once
    whole = F.struct(*df.columns)
    again = judged.filter("_exact_size > 1").groupBy("_exact_key").agg(F.min_by(whole, F.to_json(whole)).alias("_exact_row"))
    return once.unionByName(again.select("_exact_row.*"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) keep_id, count(*) OVER (PARTITION BY h)::BIGINT group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) kept, h text_sha256 FROM d
"""
