"""Operator 1, quality rules: a threshold table compiled into built-in expressions of one scan.

Every statistic is a built-in SQL expression on the text (no user functions, no shuffle), and the
threshold table becomes one boolean expression. Defined results: a null or empty text has all counts
0 and fails the base rule (fewer than 50 words); ids may be null or repeated and are passed through;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import WS, documents, only, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "als auf aus das dem den der des die ein eine einen er es für im ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al como con del el en es la las lo los no para por que se su un una y"
).split()

#: (statistic, lowest, highest); None leaves a side open. Ratios are null where they are undefined.
THRESHOLDS = [
    ("mean_word_chars", 1.5, 40.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
]


#: Hash of the window that begins at word ``i``.
WINDOW_HASH = "xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))"


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per input row: id, counts, ratios, ``base_failed`` and ``kept``."""
    stop = ",".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    df = only(df, id_col, text_col).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words_of(F.col("_t"))).withColumn("_l", F.split("_t", "\n", -1))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    # A window's key: high bits of its hash, low bits its place, so one sort of longs brings equal windows together.
    df = df.withColumn("_m", F.expr("shiftleft(1L, cast(ceil(log2(n_words + 2)) as int))"))
    df = df.withColumn(
        "_s",
        F.expr(
            "sort_array(case when n_words >= 3 then transform(sequence(0, cast(n_words as int) - 3), i -> "
            f"({WINDOW_HASH} & -_m) | cast(i as bigint)) "
            "else cast(array() as array<bigint>) end)"
        ),
    )
    # Equal windows lie in one run of equal high bits. In a run of one window a neighbour tells; where two that differ
    # share these bits (rare), the whole list is searched. Beyond the ends there is null, which is not true.
    near, place = "(x & -_m) = ({y} & -_m)", "cast({y} & (_m - 1) as int)"
    words = " and ".join(f"get(_w, cast(x & (_m - 1) as int) + {j}) = get(_w, {place} + {j})" for j in range(3))
    above, below = ({"y": f"get(_s, k {sign} 1)"} for sign in "-+")
    again = f"exists(_s, z -> z <> x and {near} and {words})".format(y="z")
    found = f"({words.format(**above)}) or ({words.format(**below)}) or {again}"
    df = df.withColumn("_p", F.expr(f"filter(_s, (x, k) -> if({near.format(**above)} or {near.format(**below)}, {found}, false))"))
    df = df.select(
        F.col(id_col),
        "n_words",
        F.expr("aggregate(_w, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr(f"aggregate(_l, 0L, (a, x) -> a + if(x rlike '[^\\\\x20\\\\x09-\\\\x0D]', 1L, 0L)) - size(array_distinct(filter(_l, x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')))").alias("n_dup_lines"),
        F.expr(
            "aggregate(sort_array(transform(_p, x -> x & (_m - 1))), named_struct('t', 0L, 'p', -3L), "
            "(a, q) -> named_struct('t', a.t + least(3L, q - a.p), 'p', q), a -> a.t)"
        ).alias("n_repeat_words"),
        F.expr(f"cast(size(filter(_w, w -> lower(w) in ({stop}))) as bigint)").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    n = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    df = df.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.col("n_lines").cast("double")).alias("dup_line_ratio"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )
    passed = F.lit(True)
    for name, low, high in thresholds:
        passed = passed & (F.col(name) >= low if low is not None else F.lit(True))
        passed = passed & (F.col(name) <= high if high is not None else F.lit(True))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(passed, F.lit(False)))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(*COLUMNS)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, string_split(t, chr(10)) ls FROM d),
u AS (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) p FROM w),
x AS (SELECT doc_id, p, w, lead(w, 1) OVER a w2, lead(w, 2) OVER a w3 FROM u WINDOW a AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) n FROM x WHERE w3 IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) n FROM r, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) n FROM u WHERE lower(w) IN ({_STOP}) GROUP BY doc_id),
g AS (SELECT w.doc_id, len(ws)::BIGINT n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
  (len(list_filter(ls, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))))::BIGINT n_dup_lines,
  coalesce(c.n, 0)::BIGINT n_repeat_words, coalesce(s.n, 0)::BIGINT n_stop, len(ls)::BIGINT n_lines
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars::DOUBLE / n_words >= 1.5 AND word_chars::DOUBLE / n_words <= 40.0
  AND n_symbols::DOUBLE / n_words <= 0.25 AND n_stop::DOUBLE / n_words >= 0.01 AND n_dup_lines::DOUBLE / n_lines <= 0.5 AS kept
FROM b
"""
