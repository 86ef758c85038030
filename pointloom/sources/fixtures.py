"""Deterministic test points by the minimal-standard generator, made in parallel.

The k-th state is seed * 16807^k mod (2^31 - 1); the power is put together from the bits of k, so every
row finds its own draws without those before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The generator's factor and modulus, and the seed of the test points.
FACTOR, MODULUS, SEED = 16807, 2147483647, 42
#: Bits of a draw's number that are looked at; the generator's period is shorter.
BITS = 31


def draw(k: Column, seed: int = SEED) -> Column:
    """The ``k``-th number (from 1) in (0, 1)."""
    powers = [pow(FACTOR, 1 << b, MODULUS) for b in range(BITS)]
    k = F.pmod(k, F.lit(MODULUS - 1))
    state = F.lit(seed).cast("long")
    for b, power in enumerate(powers):
        state = state * F.when(F.shiftright(k, b).bitwiseAND(F.lit(1)) == 1, F.lit(power).cast("long")).otherwise(F.lit(1).cast("long")) % MODULUS
    return state / float(MODULUS)


def uniform_points(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """(row_idx, lng, lat): ``n`` points over the whole world up to 85 degrees."""
    rows = spark.range(n).select(F.col("id").alias("row_idx"))
    return rows.select("row_idx", (draw(2 * F.col("row_idx") + 1, seed) * 360 - 180).alias("lng"), (draw(2 * F.col("row_idx") + 2, seed) * 170 - 85).alias("lat"))


def clustered_points(spark: SparkSession, n: int, centres: Sequence[tuple[float, float, str]], spread: float = 1.5, seed: int = SEED) -> DataFrame:
    """(row_idx, lng, lat, name): normally distributed around centres (lng, lat, name) drawn evenly."""
    rows = spark.range(n).select(F.col("id").alias("row_idx"))
    first, second, third = (draw(3 * F.col("row_idx") + k, seed) for k in (1, 2, 3))
    rows = rows.select("row_idx", F.floor(first * len(centres)).cast("int").alias("c"), F.sqrt(-2.0 * F.ln(second)).alias("r"), (third * (2 * math.pi)).alias("a"))
    at = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(name).alias("name")) for x, y, name in centres])
    rows = rows.withColumn("at", F.get(at, F.col("c")))
    lat = F.greatest(F.lit(-85.0), F.least(F.lit(85.0), F.col("at.y") + F.col("r") * F.sin("a") * spread))
    return rows.select("row_idx", (F.col("at.x") + F.col("r") * F.cos("a") * spread).alias("lng"), lat.alias("lat"), F.col("at.name").alias("name"))
