"""Operator 9, best-fit packing with exact-complement hashing.

Documents become token ids (byte-level BPE, end id 2), cut into pieces only where longer than a
sequence; a cut document's first piece takes the remainder. Packing needs only how many pieces there are
of each length (at most 1024 numbers), so the plan is made on the driver from that histogram, whatever
the size of the corpus: for the longest length left, the gap is looked up among the single lengths, then
among sums of two and of three that are still available, else the largest length that fits is put in
and the rest of the gap looked up again. Every pattern found is repeated as often as the counts allow.
Pieces then get a rank within their length (salted, so a hot length is spread) and fall into the slots
the plan has reserved for a range of ranks.

Defined results: null text is the empty text (one piece, id 2 only); repeated rows and repeated or null
ids are packed as rows of their own; an empty table gives no piece. Further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import documents, only, small_batches, stored, tidy

CAPACITY, END = 1024, 2
#: Rows of a length that are ranked by one task.
RANKED_ROWS = 20_000
#: Characters on which the two tokenizer libraries cannot differ; other texts go to ``tokenizers``.
PLAIN = "[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2026\\u20ac]|<\\|endoftext\\|>"


def encoder(folder: str | None = None):
    """text -> ids of byte_bpe_50k.json, end id excluded.

    The same vocabulary as ranks is read by ``tiktoken``, which is several times as fast and gives the
    same ids; texts with characters whose classes depend on the library's Unicode tables, and texts
    that spell a special token, are encoded by ``tokenizers`` itself.
    """
    import base64
    import os
    import re

    import public_tokenizers
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def path(name):
        return os.path.join(folder, name) if folder else public_tokenizers.path(name)

    with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other, slow = re.compile(PLAIN), []

    def encode(text: str) -> np.ndarray:
        if other.search(text) is None:
            return np.asarray(fast.encode_ordinary(text), dtype="<u4")
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path("byte_bpe_50k.json")))
        return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(at, capacity) for at in range(head, n, capacity)]


def tokenized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces: (id, piece, start, length, ids_crc32[, ids])."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def run(batches):
        encode = encoder(folder)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    for column, value in zip(rows, (key, k, start, length, zlib.crc32(part.tobytes()))):
                        column.append(value)
                    if with_ids:
                        rows[5].append(part.astype(np.int64))
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names[: len(rows)])

    return only(df, id_col, text_col).mapInArrow(tidy(run), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence, how many such sequences) that use up ``counts``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            now = left.copy()
            now[longest] -= 1
            pattern, gap = [longest], capacity - longest
            while gap:
                more = exact(now, gap) or largest(now, gap)
                if not more:
                    break
                for x in more:
                    now[x] -= 1
                    gap -= x
                pattern += more
            lengths, uses = np.unique(pattern, return_counts=True)
            times = int((left[lengths] // uses).min())
            left[lengths] -= uses * times
            out.append((tuple(pattern), times))
    return out


def pair(left: np.ndarray, total: int) -> tuple[int, int] | None:
    """The two available lengths with this sum whose scarcer one is most frequent."""
    if total < 2:
        return None
    low = np.arange(1, total // 2 + 1)
    ready = np.minimum(left[low], left[total - low])
    if total % 2 == 0:
        ready[-1] = left[total // 2] // 2
    best = int(ready.argmax())
    return (total - int(low[best]), int(low[best])) if ready[best] > 0 else None


def exact(left: np.ndarray, gap: int) -> list[int]:
    """One, two or three available lengths that fill the gap exactly."""
    if left[gap] > 0:
        return [gap]
    if two := pair(left, gap):
        return list(two)
    for first in np.flatnonzero(left[: gap - 1] > 0)[::-1]:
        rest = left.copy()
        rest[first] -= 1
        if two := pair(rest, gap - int(first)):
            return [int(first), *two]
    return []


def largest(left: np.ndarray, gap: int) -> list[int]:
    fits = np.flatnonzero(left[: gap + 1] > 0)
    return [int(fits[-1])] if len(fits) else []


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first rank, offset) of every place in the plan."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            used[length] = at + times
            out.append((length, at, at + times, sequence, offset))
            offset += length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (id, piece, start, length, ids_crc32, ...)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = spark.createDataFrame([(k, -(-n // RANKED_ROWS)) for k, n in counts.items()], "length bigint, _salts bigint")
    rows = pieces.join(F.broadcast(shares), "length").withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("_salts")))
    before = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_salt", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("_k", F.row_number().over(within)).join(before, ["length", "_salt"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_k") - 1)
    places = spark.createDataFrame(slots(plan(counts, capacity)), "_length bigint, _from bigint, _to bigint, _sequence bigint, offset bigint")
    # The plan has at most a few places for each of the lengths, whatever the number of rows.
    found = rows.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return found.select(*pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    small_batches(df.sparkSession)
    pieces = stored(tokenized(df, id_col, text_col, capacity, folder, with_ids), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
