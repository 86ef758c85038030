"""Operator 7, chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; system turns stay system turns. The mask is the list of spans
(start, length in code points) of what the assistant says, end mark included: the part to learn from.

A perspective is one row, part 0, for every conversation of up to ``PART_ROWS`` distinct turns; a longer one goes on in
parts 1, 2 and so on, each of so many turns in the order below, so that no row holds an unbounded dialogue; texts
joined in order of the part are the dialogue. A conversation's turns are gathered once, repeats falling
together before they are sent, and then rotated in place for each of its speakers; only longer conversations are
sorted over all tasks and numbered by range, and meet their speakers in a join.

Defined results: a row repeated in every field counts once; turns with the same number are ordered by role,
then text; a null role is ``unknown``, a null text empty, a null turn comes first, and rows without a
conversation id make one conversation of their own; a conversation of system turns only has no participant
and gives no row; marks of the template inside a text or a role are broken by a space, and line ends in a role become
one, so neither can forge a turn (``perspective`` is the role as it is); further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import only, sized, stored

#: Turns of a part; speakers of long conversations that are sent to every executor.
PART_ROWS, BROADCAST_SPEAKERS = 1024, 100_000
ORDER = ["turn", "role", "body"]


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask)."""
    rows = only(df, conv_col, turn_col, role_col, text_col).select(
        F.col(conv_col).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        unmarked(F.coalesce(F.col(text_col), F.lit(""))).alias("body"),
    )
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    long = sized(sizes.filter(F.col("size") > part_rows).select(F.col("conv").alias("_c")), "chat-long")
    within = rows["conv"].eqNullSafe(F.col("_c"))
    # At most so many rows each, and equal ones fall together on the way.
    turns = rows.join(long, within, "left_anti").groupBy("conv").agg(F.sort_array(F.collect_set(F.struct(*ORDER))).alias("turns"))
    speakers = F.array_distinct(F.expr("filter(turns, t -> t.role <> 'system')")["role"])
    seen = turns.select("conv", F.lit(0).cast("long").alias("part"), "turns", F.explode(speakers).alias("perspective"))
    if not long.isEmpty():
        seen = seen.unionByName(parts(rows.join(long, within, "left_semi"), part_rows))
    return rendered(seen)


def unmarked(text):
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def parts(rows: DataFrame, part_rows: int) -> DataFrame:
    """(conv, part, turns, perspective) of long conversations."""
    rows = numbered(rows.distinct(), part_rows)
    turns = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct(*ORDER))).alias("turns"))
    speakers = rows.filter("role <> 'system'").select(F.col("conv").alias("_c"), F.col("role").alias("perspective")).distinct()
    speakers = sized(speakers, "chat-speakers", BROADCAST_SPEAKERS)
    return turns.join(speakers, F.col("conv").eqNullSafe(F.col("_c"))).select("conv", "part", "turns", "perspective")


def numbered(rows: DataFrame, part_rows: int) -> DataFrame:
    """Rows with ``part``, their place in the conversation by (turn, role, body) over ``part_rows``; no task holds a whole conversation.

    Sorted ranges are stored, so they are the same when counted and when numbered; a row's place is its place in
    the range after the counts of the ranges before.
    """
    ranges = stored(rows.repartitionByRange("conv", *ORDER).withColumn("range", F.spark_partition_id()), "chat-ranges")
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("size"))
    counts = counts.select(F.col("conv").alias("_c"), F.col("range").alias("_r"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    ranges = ranges.withColumn("place", F.row_number().over(Window.partitionBy("conv", "range").orderBy(*ORDER)))
    ranges = ranges.join(counts, ranges["conv"].eqNullSafe(F.col("_c")) & (ranges["range"] == F.col("_r")))
    return ranges.select("conv", *ORDER, F.floor((F.col("before") + F.col("place") - 1) / part_rows).cast("long").alias("part"))


def rendered(seen: DataFrame) -> DataFrame:
    """The text and mask of every (conv, part, turns, perspective)."""
    made = F.transform(
        "turns",
        lambda t: F.struct(
            F.when(t["role"] == "system", F.lit("<|start|>system\n"))
            .when(t["role"] == F.col("perspective"), F.lit("<|start|>assistant\n"))
            .otherwise(F.concat(F.lit("<|start|>user name="), unmarked(F.regexp_replace(t["role"], "[\\r\\n]+", " ")), F.lit("\n")))
            .alias("head"),
            F.concat(t["body"], F.lit("<|end|>\n")).alias("said"),
            (t["role"] == F.col("perspective")).alias("own"),
        ),
    )
    return seen.withColumn("turns", made).select(
        F.col("conv").alias("conv_id"),
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(turns, t -> concat(t.head, t.said)), '')").alias("text"),
        F.expr(
            "aggregate(turns, named_struct('at', 0L, 'spans', cast(array() as array<string>)), (a, t) -> named_struct("
            "'at', a.at + length(t.head) + length(t.said), 'spans', if(t.own, array_append(a.spans, concat(a.at + length(t.head), ':', length(t.said))), a.spans)), "
            "a -> array_join(a.spans, ','))"
        ).alias("mask"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = rf"""
WITH r AS (SELECT DISTINCT conv_id, coalesce(turn, -1) turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') body FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) - 1) // {PART_ROWS} part FROM r),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
s AS (SELECT n.conv_id, perspective, part, turn, n.role, body, n.role = perspective own, body || '<|end|>' || chr(10) said,
  CASE WHEN n.role = 'system' THEN '<|start|>system' WHEN n.role = perspective THEN '<|start|>assistant'
  ELSE '<|start|>user name=' || replace(regexp_replace(n.role, '[\r\n]+', ' ', 'g'), '<|', '< |') END || chr(10) head
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, (sum(length(head) + length(said)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, body) - length(said))::BIGINT fro FROM s)
SELECT conv_id, perspective, part, count(*)::BIGINT n_turns, string_agg(head || said, '' ORDER BY turn, role, body) AS text,
  coalesce(string_agg(CASE WHEN own THEN fro || ':' || length(said) END, ',' ORDER BY turn, role, body), '') mask FROM o GROUP BY conv_id, perspective, part
"""
