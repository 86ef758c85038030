"""Operator 6, mixing sources to target weights by hash-threshold histograms.

Every document has a 40-bit hash of its id and text. Word counts are summed by source and hash bucket (10 bits a
level, map-side first); within a source the bucket where the running sum passes the budget is the
boundary, and only that bucket is refined with the next 10 bits. After four levels a source has one
threshold: documents hashed below it are taken once more than the others. Nothing is sorted but the
buckets (at most 1024 a source), and rerunning gives the same mix; a larger budget takes a superset.

Defined results: null text has size 0; a null source is a source of its own, last; rows equal in
id and text share a hash and are taken or left together, so a source of such rows only may miss its target; a source without words has target 0.
Further columns are ignored by :func:`mix` and kept by :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import documents, only, stored, words_of

LEVELS, BITS = 4, 10
WEIGHTS = (3, 1, 2)
#: Up to so many sources the table of sources is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def targets(sizes: DataFrame, share: float, most: float, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, filled up to ``most`` times a source's size.

    Sources whose share would pass their limit get the limit and the rest is shared anew among the
    others; sorted by limit per weight, that is one pass over the sources (a row each).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    rank = (F.row_number().over(order) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("limit", F.col("source_size") * most)
    by = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    rows = (
        rows.withColumn("limits_before", F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(every) * share)
        .withColumn("level", (F.col("budget") - F.col("limits_before")) / F.col("weight_left"))
    )
    # The first source, in this order, whose share at the level of those left stays below its limit sets the level.
    rows = rows.withColumn("open", F.col("w") * F.col("level") <= F.col("limit"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("limit") / F.col("w")).alias("r"), "limits_before", "weight_left"))).over(every)
    rows = rows.withColumn("f", first)
    shared = F.col("w") * (F.col("budget") - F.col("f.limits_before")) / F.col("f.weight_left")
    return rows.select("source", "source_size", F.when(F.col("f").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), shared)).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, times, threshold): documents are taken ``times`` times, and once more if hash < threshold."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = plan.withColumn("times", copies.cast("long"))
    state = state.withColumn("left", F.col("target") - F.col("times") * F.col("source_size")).withColumn("low", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows if level == 0 else rows.join(state.select("source_key", "low"), "source_key").filter(F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS))
        sums = inside.groupBy("source_key", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"))
        upto = Window.partitionBy("source_key").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = sums.withColumn("c", F.sum("s").over(upto)).join(state.select("source_key", "left"), "source_key")
        # Boundary: the first bucket whose running sum passes what is left; none if all of them fit.
        edge = cum.filter(F.col("c") > F.col("left")).groupBy("source_key").agg(F.min(F.struct("b", "c", "s")).alias("e"))
        state = state.join(edge, "source_key", "left")
        if level == LEVELS - 1:  # take the last bucket too if that comes nearer
            nearer = (F.col("e.c") - F.col("left")) < (F.col("left") - (F.col("e.c") - F.col("e.s")))
            low = F.col("e.b") + F.when(nearer, 1).otherwise(0)
        else:
            low = F.shiftleft(F.col("e.b"), shift)
        fits = F.lit(1 << (BITS * LEVELS)).cast("long")
        state = state.withColumn("left", F.when(F.col("e").isNull(), F.col("left")).otherwise(F.col("left") - (F.col("e.c") - F.col("e.s"))))
        state = state.withColumn("low", F.when(F.col("e").isNull(), F.greatest(F.col("low"), fits)).otherwise(low)).drop("e")
        state = stored(state, "mix-level")
    return state


def source_key(source):
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("source_key")


def keys(source, key, text) -> list:
    """Expressions for the source's key and the hash of id and text."""
    own = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return [source_key(source), F.conv(F.substring(F.md5(own), 1, 10), 16, 10).cast("long").alias("h")]


def cuts(df: DataFrame, id_col: str, text_col: str, source_col: str, share: float, most: float, weights) -> tuple[DataFrame, DataFrame]:
    """(rows with size and hash, one row a source with its target and threshold)."""
    rows = only(df, id_col, text_col, source_col).select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), *keys(F.col(source_col), F.col(id_col), F.col(text_col))
    )
    rows = stored(rows, "mix-sizes")
    sizes = stored(rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "mix-sources")
    plan = targets(sizes.select("source", "source_size"), share, most, weights)
    plan = plan.withColumn("source_key", source_key(F.col("source")))
    state = thresholds(rows, stored(plan, "mix-targets")).select("source_key", "source_size", "target", "times", "low")
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows, F.broadcast(state) if few else state


def copies(most: float):
    return F.least(F.col("times") + F.when(F.col("h") < F.col("low"), 1).otherwise(0), F.lit(int(most)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target``, ``taken``, ``copies``."""
    rows, state = cuts(df, id_col, text_col, source_col, share, most, weights)
    done = rows.join(state, "source_key").withColumn("copies", copies(most))
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """The documents of the mix with all their columns; one taken twice comes as two rows.

    The verdict follows from a row's own hash and its source's threshold, so texts are filtered where they
    are read, not shuffled.
    """
    _, state = cuts(df, id_col, text_col, source_col, share, most, weights)
    rows = df.select(F.struct("*").alias("row"), *keys(F.col(source_col), F.col(id_col), F.col(text_col))).join(state, "source_key")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies(most).cast("int")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def oracle(table: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 10))::BIGINT h FROM {table}),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] w, source_size * 2.0::DOUBLE lim FROM s),
c AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE lb,
  (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY lim / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE wl,
  (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE budget FROM w),
f AS (SELECT lb, wl FROM c WHERE w * ((budget - lb) / wl) <= lim ORDER BY lim / w LIMIT 1),
t AS (SELECT c.source, source_size, least(lim, w * (budget - f.lb) / f.wl) target FROM c, f),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END times FROM t),
g AS (SELECT source, h, sum(size)::BIGINT s FROM d GROUP BY source, h),
r AS (SELECT g.source, g.h, g.s, sum(g.s) OVER (PARTITION BY g.source ORDER BY g.h) cum, target - times * source_size AS rest, times, source_size, target
  FROM g JOIN k ON g.source IS NOT DISTINCT FROM k.source),
e AS (SELECT *, cum <= rest OR (cum - s <= rest AND cum - rest < rest - (cum - s)) extra FROM r)
SELECT d.doc_id, d.size, e.source_size, e.target, (d.size * least(2, e.times + CASE WHEN extra THEN 1 ELSE 0 END))::BIGINT taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""


ORACLE = oracle()
