"""Cluster ids: origin's place on the finer level, that level's zoom, and the number of input rows, in one number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(seq: Column, zoom: int, num_rows: int) -> Column:
    return F.shiftleft(seq.cast("long"), 5) + F.lit(zoom + 1).cast("long") + F.lit(num_rows).cast("long")


def origin_zoom(cluster_id: Column, num_rows: int) -> Column:
    return (cluster_id - F.lit(num_rows)) % 32


def origin_seq(cluster_id: Column, num_rows: int) -> Column:
    return F.shiftright((cluster_id - F.lit(num_rows)).cast("long"), 5)
