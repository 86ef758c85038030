"""Operator 10, WARC: resolving not-modified revisits.

A revisit (a 304 answer) has no body: it stands for the latest earlier full response of its canonical URL.
The as-of join first reduces both sides to distinct (URL, time) pairs, then runs a window inside blocks of
``BLOCK`` time units, with one row a (URL, block) carrying what came before, so no window holds more
than ``BLOCK`` rows however often a URL was fetched. The validators of the revisit (entity tag, else
last-modified) must agree with the response found; then headers a 304 may update replace the stored ones.

Defined results: outcomes are ``resolved``, ``validator_mismatch`` and ``no_earlier_response``; a revisit
without validators is resolved by URL alone; of responses at the same time the largest id counts; a response
at the revisit's own time is not earlier; null URLs or times never match; repeated revisits are each
answered; header names compare in lower case, a header given several times (in different cases) has its values joined
by a comma and a space in order of the names as given, and one without a value is left out; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import only, stored

BLOCK = 1 << 14
#: Headers that describe the body or the connection, which a 304 answer must not replace.
KEPT_HEADERS = "connection content-encoding content-length content-range content-type keep-alive proxy-connection te trailer transfer-encoding upgrade".split()


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, the scheme's own port, fragment, tracking parameters and a path's trailing slash do not tell pages apart."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^(?i)(https?)://", 1))
    u = F.regexp_replace(u, "^(?i)https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www[.]", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(u, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/$", "")
    asked = F.regexp_replace(F.regexp_replace(rest, "^[^?]*", ""), "([?&])utm_[a-z]+=[^&]*", "$1")
    asked = F.regexp_replace(F.regexp_replace(asked, "[?]&+", "?"), "&&+", "&")
    return F.concat(host, path, F.regexp_replace(asked, "[?&]+$", ""))


def lower_keys(headers: Column) -> Column:
    """A map by lower-cased names; the values of names that differ only in case are joined."""
    known = F.array_sort(F.map_entries(F.map_filter(headers, lambda k, v: v.isNotNull())))
    names = F.array_distinct(F.transform(known, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.array_join(F.transform(F.filter(known, lambda e: F.lower(e["key"]) == k), lambda e: e["value"]), ", ")))


def resolve(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """Answers every revisit of ``records`` (record_id, kind, url, at, headers; kind is response or revisit).

    (record_id, canonical_url, at, response_id, outcome, headers): merged headers where it is resolved.
    """
    rows = only(records, "record_id", "kind", "url", "at", "headers").select("record_id", "kind", canonical_url(F.col("url")).alias("u"), F.col("at").cast("long").alias("at"), "headers")
    rows = stored(rows, "warc-records")  # read for responses, for revisits and for both: their URLs are worked out once
    full = rows.filter("kind = 'response' and u is not null and at is not null")
    asked = rows.filter("kind = 'revisit'")
    moments = full.select("u", "at", "record_id").unionByName(asked.filter("u is not null and at is not null").select("u", "at", F.lit(None).cast(full.schema["record_id"].dataType).alias("record_id")))
    moments = moments.groupBy("u", "at").agg(F.max("record_id").alias("r")).withColumn("b", F.floor(F.col("at") / block))
    # Latest response inside the block, before this moment; else the latest of earlier blocks.
    inside = Window.partitionBy("u", "b").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = moments.groupBy("u", "b").agg(F.max(F.when(F.col("r").isNotNull(), F.struct("at", "r"))).alias("last"))
    before = Window.partitionBy("u").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("u", "b", F.last("last", ignorenulls=True).over(before).getField("r").alias("carried"))
    found = moments.withColumn("near", F.last("r", ignorenulls=True).over(inside)).join(blocks, ["u", "b"])
    found = found.select("u", "at", F.coalesce("near", "carried").alias("response_id")).filter("response_id is not null")
    bodies = full.select(F.col("record_id").alias("response_id"), F.col("u").alias("_u"), F.col("headers").alias("old")).dropDuplicates(["response_id", "_u"])
    answered = asked.join(found, ["u", "at"], "left")
    answered = answered.join(bodies, (answered["response_id"] == bodies["response_id"]) & (answered["u"] == bodies["_u"]), "left").drop(bodies["response_id"])
    empty = F.create_map().cast("map<string,string>")
    new, old = lower_keys(F.coalesce("headers", empty)), lower_keys(F.coalesce("old", empty))
    answered = answered.select("record_id", "u", "at", "response_id", new.alias("new"), old.alias("old"))

    def tag(headers: str) -> Column:
        return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")

    same = F.when(tag("new").isNotNull(), tag("new").eqNullSafe(tag("old")))
    same = same.when(F.try_element_at("new", F.lit("last-modified")).isNotNull(), F.try_element_at("new", F.lit("last-modified")).eqNullSafe(F.try_element_at("old", F.lit("last-modified")))).otherwise(True)
    outcome = F.when(F.col("response_id").isNull(), "no_earlier_response").when(same, "resolved").otherwise("validator_mismatch")
    update = F.map_filter("new", lambda k, v: ~k.isin(KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(update, k)), update)
    return answered.select("record_id", F.col("u").alias("canonical_url"), "at", "response_id", outcome.alias("outcome"), F.when(outcome == "resolved", merged).alias("headers"))


#: The derived crawl: a page's first answer is at its id times STRIDE modulo SPAN, its second GAP later.
STRIDE, SPAN, GAP = 7919, 100_003, 40
#: When a page is asked again, from its first answer: before it, between, at the second's own time, and after both.
ASKED = (-5, 20, GAP, 3 * GAP)


def crawls(pages: DataFrame) -> DataFrame:
    """WARC records derived from ``pages``: two full responses of every page, and four 304 answers before, between, at and after them.

    Pages of one URL interleave. The 304 answers name an entity tag (at every third page that of another version), only a
    date, or nothing.
    """
    page, html = F.col("page_id"), F.coalesce("html", F.lit("")).cast("binary")
    base = only(pages, "page_id", "url", "html").select(
        "page_id", "url", F.pmod(page * STRIDE, F.lit(SPAN)).cast("long").alias("at"), F.substring(F.md5(html), 1, 16).alias("print"), F.octet_length(html).cast("string").alias("size")
    )

    def tag(version: int) -> Column:
        return F.concat(F.lit('"'), F.col("print"), F.lit(f'-{version}"'))

    def record(number: int, kind: str, later: int, *headers) -> Column:
        made = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in headers]) if headers else F.lit(None).cast("map<string,string>")
        return F.struct((page * 8 + number).alias("record_id"), F.lit(kind).alias("kind"), (F.col("at") + later).alias("at"), made.alias("headers"))

    def day(later: int) -> Column:
        return (F.col("at") + later).cast("string")

    def answer(version: int) -> Column:
        return record(version, "response", version * GAP, "ETag", tag(version), "Content-Type", "text/html", "Content-Length", F.col("size"), "Last-Modified", day(version * GAP), "Cache-Control", "max-age=60")

    records = [
        answer(0),
        answer(1),
        record(4, "revisit", ASKED[0], "etag", tag(0)),
        record(5, "revisit", ASKED[1], "etag", F.concat(F.lit("W/"), F.when(page % 3 == 0, tag(1)).otherwise(tag(0))), "content-length", "0", "expires", "0"),
        record(6, "revisit", ASKED[2], "last-modified", day(0), "date", day(GAP)),
        record(7, "revisit", ASKED[3]),
    ]
    return base.select("url", F.explode(F.array(*records)).alias("r")).select("r.record_id", "r.kind", "url", "r.at", "r.headers")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the revisits of the derived crawl; ``response_id`` is -1 where there is no earlier response."""
    out = resolve(crawls(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    text = F.expr("array_join(transform(array_sort(map_entries(headers)), e -> concat(e.key, '=', e.value)), ';')")
    return out.select("record_id", "canonical_url", F.col("at").alias("moment"), F.coalesce("response_id", F.lit(-1)).alias("response_id"), "outcome", text.alias("headers"))


ORACLE = rf"""
WITH u AS (SELECT page_id, coalesce(html, '') html, (page_id * {STRIDE}) % {SPAN} AS moment, regexp_replace(trim(url), '#.*$', '') u FROM pages),
v AS (SELECT page_id, html, moment, lower(regexp_extract(u, '^(?i)(https?)://', 1)) scheme, regexp_replace(u, '^(?i)https?://', '') u FROM u),
w AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[.]', '') host, regexp_replace(u, '^[^/?]*', '') rest FROM v),
p AS (SELECT page_id, moment, strlen(html)::VARCHAR size, substr(md5(html), 1, 16) print,
  CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END || regexp_replace(regexp_extract(rest, '^[^?]*'), '/$', '') ||
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '^[^?]*', ''), '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '[?]&+', '?', 'g'), '&&+', '&', 'g'), '[?&]+$', '') c FROM w),
r AS (SELECT page_id * 8 + k id, c, moment + k * {GAP} AS moment, size, '"' || print || '-' || k || '"' tag FROM p, (VALUES (0), (1)) t(k)),
q AS (SELECT page_id * 8 + k id, c, moment + CASE k WHEN 4 THEN {ASKED[0]} WHEN 5 THEN {ASKED[1]} WHEN 6 THEN {ASKED[2]} ELSE {ASKED[3]} END AS moment, k,
  CASE k WHEN 4 THEN '"' || print || '-0"' WHEN 5 THEN '"' || print || CASE WHEN page_id % 3 = 0 THEN '-1"' ELSE '-0"' END END tag, CASE WHEN k = 6 THEN moment::VARCHAR END AS told
  FROM p, (VALUES (4), (5), (6), (7)) t(k)),
l AS (SELECT c, moment, max(id) id FROM r GROUP BY c, moment),
f AS (SELECT q.*, l.id rid FROM q ASOF LEFT JOIN l ON q.c = l.c AND q.moment > l.moment),
o AS (SELECT f.id, f.c, f.moment, f.k, f.tag, f.told, f.rid, r.size, r.tag AS old, r.moment::VARCHAR AS dated,
  CASE WHEN f.rid IS NULL THEN 'no_earlier_response' WHEN f.tag IS NOT NULL THEN CASE WHEN f.tag = r.tag THEN 'resolved' ELSE 'validator_mismatch' END
  WHEN f.told IS NULL OR f.told = r.moment::VARCHAR THEN 'resolved' ELSE 'validator_mismatch' END outcome FROM f LEFT JOIN r ON r.id = f.rid)
SELECT id record_id, c canonical_url, moment, coalesce(rid, -1) response_id, outcome, CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html' ||
  CASE WHEN k = 6 THEN ';date=' || moment ELSE '' END || ';etag=' || CASE WHEN k = 5 THEN 'W/' ELSE '' END || old || CASE WHEN k = 5 THEN ';expires=0' ELSE '' END || ';last-modified=' || dated END headers FROM o
"""
