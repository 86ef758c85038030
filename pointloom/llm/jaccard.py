"""Operator 2, n-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Sets are first collapsed to classes of identical sets. Shingles have one global order, rare before
frequent, by exact counts over the whole corpus: a shingle in fewer than ``RARE`` texts is rare, and rare ones
are in order of their hashes; the others follow in order of their counts, which reach the sets in an equi-join. Two sets
that reach the threshold share at least l of the first (size - least overlap + l) shingles of either, for any l up to
their overlap:

* light sets (size below the boundary) enumerate all subsets of fixed size l = 2 of that prefix and meet in
  an equal subset;
* heavy sets, and the light ones large enough to reach a heavy set or so small that one common shingle may do, post
  their prefix for l = 1 to inverted lists, which are scanned for partners;
* the boundary is the size at which the summed cost of the corpus - subsets written against entries
  written plus list partners scanned, by the counts - is least.

A list or subset group is scanned in two steps, so a group of near copies never becomes all its pairs.
First every member meets the group's hub, the set with fewest rarer shingles of its own (of a group of
copies, the one nearest their origin); the pairs that pass the size and position
bounds are verified on whole sets, and linked sets get a component. Then only groups that still span
several components yield pairs across them, under the same bounds. Every link lies in some group, hence
either inside one component or among the pairs verified in the second step: the components are exact.

Defined results: a text without words, or null, has an empty set and is linked with nothing; fewer words
than a shingle make one shingle of them all; every row is a document of its own, also where ids are null, repeated or
no integers (rows are numbered then); a component is named by its smallest id that is not null, and has a null name only
where all its ids are null; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import documents, forget, only, release, sized, small_batches, stored, tidy

#: A shingle in fewer texts than this is rare: its list is shorter than this, so rare ones need no order by count.
RARE = 16
#: Bytes of text whose shingles are counted together by one task; shingles a task gathers before it sends their counts.
BUCKET_BYTES, CHUNK = 8 << 20, 1 << 20
#: Words of 64 bits of the filter that tells most rare shingles; where it is full, it tells none, and all are looked up.
FILTER_WORDS = 1 << 20
#: Cost of scanning one partner of a list (to test it on whole sets) relative to writing one entry of a list or subset.
SCAN_COST = 8.0
#: Pairs of one set that one task tests; the set is sent as often as it has so many pairs.
HOT_PAIRS = 10_000
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x = x ^ (x >> np.uint64(29))
    x = x * FACTOR
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.full(n, FACTOR | np.uint64(1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8, A-Z lower-cased."""
    data = LOWER[data]
    space = SPACES[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    first, after = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64)
    # A polynomial over the bytes of each word: place in the word decides the power.
    inside = ~space
    length = after - first
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    table = powers(int(length.max()))
    terms = mixed(data[inside].astype(np.uint64) + np.uint64(1)) * table[place]
    sums = np.add.reduceat(terms, np.cumsum(length) - length)
    return mixed(sums + length.astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(words):
        return words
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = mixed(out * FACTOR + words[k : len(words) - n + 1 + k])
    return np.unique(out)


def least_overlap(n, percent: int):
    """Smallest intersection of a set of size n with any set it can link to."""
    return -(-n * percent // 100)


def planes(hashes: np.ndarray) -> bytes:
    """Sorted hashes, all first bytes before all second ones: the first are nearly alike, so the shuffle compresses them."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def hashes_of(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def frequent(df: DataFrame, text_col: str, width: int, rare: int = RARE) -> tuple[DataFrame, float]:
    """(h, c): shingles in at least ``rare`` texts and their exact number of texts; and the mean number of partners of a rarer one.

    Tasks count what they have gathered and send it by ranges of the hash; a range holds the shingles of some
    ``BUCKET_BYTES`` of text at any size of the corpus, so summing one takes bounded memory.
    """
    size = only(df, text_col).agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = min(1 << 24, max(1, -(-size // BUCKET_BYTES)))
    chunk = min(8 * CHUNK, max(CHUNK, 64 * buckets))
    names = ["bucket", "once", "more", "times"]

    def counted(held):
        found, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = ((found >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(found)]))
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part, often = found[a:b], n[a:b]
            many = often > 1
            rows.append((int(bucket[a]), planes(part[~many]), planes(part[many]), often[many].astype(np.uint32).tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for at in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 1000]), kinds)], names)

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), width))
                n += len(held[-1])
                if n >= chunk:
                    yield from counted(held)
                    held, n = [], 0
        if n:
            yield from counted(held)

    def summed(held):
        once, more, times = (list(x) for x in zip(*held))
        h = np.concatenate([*once, *more])
        c = np.concatenate([np.ones(sum(map(len, once)), np.int64), *times])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        h, c = h[first], np.add.reduceat(c, first)
        few = c[c < rare]
        keep = c >= rare
        columns = [np.append(h[keep].view(np.int64), 0), np.append(c[keep], 0), np.append(np.zeros(keep.sum(), np.int64), few.sum()), np.append(np.zeros(keep.sum(), np.int64), (few * (few - 1)).sum())]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h", "c", "rare", "partners"])

    def add(batches):
        held, at = [], None
        for batch in batches:
            for bucket, once, more, times in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3))):
                if held and bucket != at:
                    yield summed(held)
                    held = []
                at = bucket
                held.append((hashes_of(once.as_buffer()), hashes_of(more.as_buffer()), np.frombuffer(times.as_buffer(), np.uint32).astype(np.int64)))
        if held:
            yield summed(held)

    partial = only(df, text_col).mapInArrow(tidy(count), "bucket bigint, once binary, more binary, times binary")
    whole = partial.repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(add), "h bigint, c bigint, rare bigint, partners bigint")
    whole = stored(whole, "shingle-counts")
    seen, partners = whole.agg(F.sum("rare"), F.sum("partners")).first()
    return whole.filter("c > 0").select("h", "c"), partners / seen if seen else 0.0


def overlap_of(percent: int):
    """:func:`least_overlap` of the column ``n``."""
    return F.expr(f"(n * {percent} + 99) div 100")


def filter_bits(h: np.ndarray) -> np.ndarray:
    """The two bits of a shingle in its word of the filter."""
    return (np.uint64(1) << ((h >> np.uint64(20)) & np.uint64(63))) | (np.uint64(1) << ((h >> np.uint64(26)) & np.uint64(63)))


def filter_of(often: DataFrame) -> np.ndarray:
    """A filter of fixed size that passes every frequent shingle and, while they are not too many, few others."""
    h = F.col("h")
    place = lambda by: F.expr(f"shiftleft(1L, cast(shiftright(h, {by}) & 63L as int))")
    words = often.groupBy(h.bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("w")).agg(F.bit_or(place(20).bitwiseOR(place(26))).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def signed(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, passes: np.ndarray) -> DataFrame:
    """(id, n, fp1, fp2, some, ask): set size, 128-bit print of the set, its first shingles by hash, one and a half
    prefixes for l = 2, and those of them that the filter passes."""
    schema = "id bigint, n bigint, fp1 bigint, fp2 bigint, some array<bigint>, ask array<bigint>"
    shared = df.sparkSession.sparkContext.broadcast(passes)

    def run(batches):
        table = shared.value
        for batch in batches:
            size, one, two, some, ask = [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width)
                n = len(s)
                size.append(n)
                one.append(int(np.bitwise_xor.reduce(mixed(s + np.uint64(n)), initial=np.uint64(0)).astype(np.int64)))
                two.append(int(np.add.reduce(mixed(s ^ FACTOR), dtype=np.uint64).astype(np.int64)))
                s = s[: (n - least_overlap(n, percent) + 2) * 3 // 2 + 4]
                some.append(s.view(np.int64))
                bits = filter_bits(s)
                ask.append(s[table[(s & np.uint64(FILTER_WORDS - 1)).astype(np.int64)] & bits == bits].view(np.int64))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip((size, one, two, some, ask), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], ["id", "n", "fp1", "fp2", "some", "ask"])

    return only(df, id_col, text_col).mapInArrow(tidy(run), schema)


def ranked(sets: DataFrame, often: DataFrame, partners: float, percent: int) -> DataFrame:
    """(cid, n, prefix, scanned, known) of sets (cid, n, some, ask): prefix for l = 2 in the global order, list partners expected.

    A frequent shingle counts as one partner, the hub of its list, which stands for the others.
    ``known`` is false where too many of the given shingles are frequent for the prefix to follow from them.
    """
    hits = sets.select("cid", F.explode("ask").alias("h")).join(often, "h").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("often"))
    rows = sets.join(hits, "cid", "left").withColumn("often", F.coalesce("often", F.expr("cast(array() as array<struct<c:bigint,h:bigint>>)")))
    rows = rows.withColumn("rare", F.array_except("some", F.col("often.h"))).withColumn("keep", F.least("n", F.col("n") - overlap_of(percent) + 2).cast("int"))
    rows = rows.withColumn("few", F.least(F.size("rare"), F.col("keep")))
    return rows.select(
        "cid",
        "n",
        F.slice(F.concat("rare", F.col("often.h")), F.lit(1), F.col("keep")).alias("prefix"),
        (F.col("few") * F.lit(partners) + (F.col("keep") - F.col("few"))).alias("scanned"),
        ((F.size("rare") >= F.col("keep")) | (F.size("some") == F.col("n"))).alias("known"),
    )


def boundary(classes: DataFrame, percent: int) -> int:
    """The size below which enumerating pairs of the prefix costs the corpus less than scanning lists."""
    p = F.size("prefix").cast("double")
    light = p * (p - 1) / 2
    heavy = (p - 1) + F.col("scanned") * SCAN_COST
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)  # sizes in steps of a twelfth, so few rows at any scale
    rows = classes.filter("n > 0").groupBy(step.alias("step")).agg(F.max("n").alias("n"), F.sum(light).alias("light"), F.sum(heavy).alias("heavy")).orderBy("step").collect()
    best, least, total = 0, 0.0, 0.0
    for r in rows:
        total += r["light"] - r["heavy"]
        if total < least:
            best, least = r["n"] + 1, total
    return best


def entry_key(*parts):
    """48 bits: two keys that fall together only bring sets to the test that need not have met."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 48) - 1)).alias("key")


def entries(classes: DataFrame, bound: int, percent: int) -> DataFrame:
    """(key, cid, n, pos): subsets of two of light sets' prefixes, list entries of the others. pos: so many
    shingles come before the entry that cannot be common if this is the first the two sets share."""
    light = classes.filter(F.col("n") < bound)
    lists = classes.filter((F.col("n") >= bound) | (100 * F.col("n") >= percent * F.lit(bound).cast("long")) | (overlap_of(percent) < 2))
    two = light.select("cid", "n", "prefix", F.posexplode("prefix").alias("pos", "b")).filter("pos > 0")
    two = two.select("cid", "n", "pos", "b", F.explode(F.expr("slice(prefix, 1, pos)")).alias("a"))
    two = two.select(entry_key(F.lit(2), F.col("a"), F.col("b")), "cid", F.col("n").cast("int"), (F.col("pos") - 1).alias("pos"))
    one = lists.select("cid", "n", F.posexplode(F.slice("prefix", F.lit(1), F.size("prefix") - (overlap_of(percent) > 1).cast("int"))).alias("pos", "b"))
    one = one.select(entry_key(F.lit(1), F.col("b")), "cid", F.col("n").cast("int"), "pos")
    return two.unionByName(one)


def bounds(n1, n2, p1, p2, percent: int):
    """Can two sets of these sizes, whose first common entry is at these places, still reach the threshold?

    Both orders are the same, so nothing before the first common entry is common. A linked pair meets, with
    these bounds kept, in the group of its first entry; other groups may turn it down.
    """
    overlap = F.ceil((n1 + n2) * percent / (100.0 + percent) - 1e-9)
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(n1 - p1, n2 - p2) >= overlap)


def whole_sets(df: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(cid, n, some): all shingles of the named documents."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cid", "n", "some"])

    return only(df, id_col, text_col).join(members.withColumnRenamed("cid", id_col), id_col, "left_semi").mapInArrow(tidy(run), "cid bigint, n bigint, some array<bigint>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. A set of very many pairs is sent to several tasks."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.asarray(v.values) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = sets.select(F.col("cid").alias("a"), F.col("some").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("some").alias("sb"))
    hot = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HOT_PAIRS).alias("shares")).filter("shares > 1")
    hot = sized(hot, "hot-sets")
    pairs = pairs.join(hot, "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))))
    first = first.join(hot, "a", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1)))
    joined = pairs.drop("shares").join(first.drop("shares"), ["a", "share"]).join(second, "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a bigint, b bigint")


def verified(df: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int, percent: int, label: str) -> DataFrame:
    """The pairs that reach the threshold, as a stored table; whole sets are made for members of pairs only."""
    if pairs.isEmpty():
        return pairs
    members = sized(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "pair-members")
    sets = stored(whole_sets(df, members, id_col, text_col, width), "whole-sets")
    release(df.sparkSession)
    links = stored(verify(pairs, sets, percent), label)
    forget(sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(cid, comp): smallest id reachable over the links (a, b), for every id that has a link.

    Rounds of label exchange with pointer jumping over tables in the shared folder; neither links nor
    labels reach the driver, only the number of changes does.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("comp")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("cid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # Roots hear of the smallest label any of their members has seen.
        root = step.groupBy(F.col("old").alias("r")).agg(F.min("comp").alias("best"))
        step = step.join(root, step["old"] == root["r"], "left").select("cid", "old", F.least("comp", F.coalesce("best", "comp")).alias("comp"))
        jump = step.select(F.col("cid").alias("j"), F.col("comp").alias("up"))
        step = step.join(jump, step["comp"] == jump["j"], "left").select("cid", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        step = stored(step, "labels")
        forget(last)
        last, labels = step, step.select("cid", "comp")
        if step.filter("old <> comp").isEmpty():
            forget(both)
            return labels


def linked(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n, cid, comp): set size, smallest id with the same set, smallest id of the component. Ids are integers, none null or repeated."""
    small_batches(df.sparkSession)
    often, partners = frequent(df, text_col, width)
    release(df.sparkSession)
    rows = stored(signed(df, id_col, text_col, width, percent, filter_of(often)), "shingle-sets")
    prints = stored(rows.select("id", "n", "fp1", "fp2"), "set-prints")
    named = rows.filter("n > 0")
    same = stored(named.groupBy("fp1", "fp2", "n").agg(F.min("id").alias("cid")), "set-classes")
    sets = named.join(same.select(F.col("cid").alias("id")), "id", "left_semi").select(F.col("id").alias("cid"), "n", "some", "ask")
    found = stored(ranked(sets, often, partners, percent), "class-prefixes")
    forget(rows)
    classes = found.filter("known")
    unknown = sized(found.filter("not known").select("cid"), "unknown-prefixes")
    if not unknown.isEmpty():
        rest = stored(ranked(whole_sets(df, unknown, id_col, text_col, width).withColumn("ask", F.col("some")), often, partners, percent), "rest-prefixes")
        classes = classes.unionByName(rest)
    posted = entries(classes, boundary(classes, percent), percent)
    # A class posts a key once, so a count tells which keys are shared; the few that are get their entries and a hub.
    keys = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    shared = stored(posted.join(keys, "key", "left_semi"), "shared-entries")
    forget(found)
    hubs = shared.groupBy("key").agg(F.min(F.struct("pos", "n", "cid")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.n").alias("hn"), F.col("hub.cid").alias("hub"), F.col("hub.pos").alias("hp"))
    stars = shared.join(hubs, "key").filter("cid <> hub").filter(bounds(F.col("n"), F.col("hn"), F.col("pos"), F.col("hp"), percent))
    stars = stored(stars.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct(), "star-pairs")
    links = verified(df, stars, id_col, text_col, width, percent, "star-links")
    first = components(links)
    at = shared.select("key", "cid", "n", "pos").join(first, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    open_lists = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    at = stored(at.join(open_lists, "key", "left_semi"), "open-lists")
    forget(shared)
    x = at.select("key", *[F.col(c).alias(c + "1") for c in ("cid", "n", "pos", "comp")])
    y = at.select("key", *[F.col(c).alias(c + "2") for c in ("cid", "n", "pos", "comp")])
    cross = x.join(y, (x["key"] == y["key"]) & (F.col("comp1") != F.col("comp2")) & (F.col("cid1") < F.col("cid2")) & bounds(F.col("n1"), F.col("n2"), F.col("pos1"), F.col("pos2"), percent))
    cross = cross.select(F.col("cid1").alias("a"), F.col("cid2").alias("b")).distinct()
    cross = stored(cross.join(stars, ["a", "b"], "left_anti"), "cross-pairs")
    forget(at)
    more = verified(df, cross, id_col, text_col, width, percent, "cross-links")
    comps = stored(components(links.union(more)), "components")
    # Members of a class take its component; classes without a link are their own.
    done = same.join(comps, "cid", "left").select("fp1", "fp2", "n", "cid", F.coalesce("comp", "cid").alias("comp"))
    out = prints.join(done, ["fp1", "fp2", "n"], "left")
    return out.select("id", "n", F.coalesce("cid", "id").alias("cid"), F.coalesce("comp", "id").alias("comp"))


def plain_ids(df: DataFrame, id_col: str) -> bool:
    """Are the ids integers, none of them null or repeated?"""
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    return only(df, id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("_c")).filter(F.col(id_col).isNull() | (F.col("_c") > 1)).isEmpty()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``class_id`` (smallest id with the same set)."""
    if plain_ids(df, id_col):
        found = linked(df, id_col, text_col, width, percent)
        return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("cid").alias("class_id"))
    rows = stored(only(df, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "near-numbered")
    found = linked(rows, "_row", text_col, width, percent)
    found = stored(found.join(only(rows, "_row", id_col).select(F.col("_row").alias("id"), F.col(id_col).alias("_id")), "id"), "near-named")
    comps = found.groupBy("comp").agg(F.min("_id").alias("component_id"))
    classes = found.groupBy("cid").agg(F.min("_id").alias("class_id"))
    return found.join(comps, "comp").join(classes, "cid").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "class_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row of every component, with all columns: a row with the smallest id, a null id only where there is no other.

    Null or repeated ids do not name a row; where there are any, rows are numbered and the numbers are joined.
    Texts without words are linked with nothing, but of rows equal in id and text one stays.
    """
    if plain_ids(df, id_col):
        found = linked(df, id_col, text_col, width, percent)
        gone = sized(found.filter("id <> comp").select(F.col("id").alias(id_col)), "near-copies")
        return df.join(gone, id_col, "left_anti").select(*df.columns)
    numbered = stored(df.withColumn("_row", F.monotonically_increasing_id()), "near-numbered")
    found = linked(numbered, "_row", text_col, width, percent).withColumnRenamed("id", "_row")
    named = only(numbered, "_row", id_col, text_col).select("_row", F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("_text"))
    bare = F.col("n") == 0
    named = named.join(found, "_row").select("_row", "_id", F.when(~bare, F.col("comp")).alias("_a"), F.when(bare, F.struct("_id", "_text")).alias("_b"))
    stay = named.groupBy("_a", "_b").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_best")).select("_best._row")
    gone = sized(named.select("_row").join(stay, "_row", "left_anti"), "near-copies")
    return numbered.join(gone, "_row", "left_anti").select(*df.columns)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")


def oracle(table: str = "documents", width: int = 4, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM {table}),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END)) g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) n, list(g ORDER BY g) gs FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) class_id FROM n),
o AS MATERIALIZED (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id v, doc_id m FROM w UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.v WHERE e.y > r.m)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, (SELECT min(m) FROM r WHERE r.v = w.doc_id) component_id, coalesce(class_id, w.doc_id) class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


ORACLE = oracle()
