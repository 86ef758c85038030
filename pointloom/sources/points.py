"""Points from any table: geometry as array, struct or two columns, a dense row index, an optional mask."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.sources.shared import storage


def with_row_index(df: DataFrame, order_by: str | None = None, name: str = "row_idx") -> DataFrame:
    """Adds a dense 0-based index: input order, or the order of a column (sorted by range, not in one task).

    The rows are stored with their place in their partition, so they are the same when counted and when numbered.
    """
    rows = df.orderBy(order_by) if order_by else df
    rows = storage(df.sparkSession)(rows.withColumn("_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # A row a partition.
    before = storage(df.sparkSession)(sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("_p", F.shiftright("_at", 33)).join(before, "_p").withColumn(name, F.col("_before") + inside)
    return rows.drop("_at", "_p", "_before")


def coordinates(df: DataFrame, geometry: str | tuple[str, str]) -> tuple[Column, Column]:
    """(lng, lat) of a geometry column: array of two, struct of two doubles, or two columns."""
    if not isinstance(geometry, str):
        return F.col(geometry[0]).cast("double"), F.col(geometry[1]).cast("double")
    if geometry not in df.columns:
        raise ValueError(f'Geometry column "{geometry}" not found in table')
    kind = df.schema[geometry].dataType
    if isinstance(kind, T.ArrayType):
        pair = F.size(geometry) == 2
        return F.when(pair, F.col(geometry)[0].cast("double")), F.when(pair, F.col(geometry)[1].cast("double"))
    if isinstance(kind, T.StructType) and len(kind.names) >= 2:
        return (F.col(f"{geometry}.{kind.names[k]}").cast("double") for k in (0, 1))
    raise ValueError(f"{geometry}: {kind.simpleString()} is not a geometry")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def points(df: DataFrame, geometry: str | tuple[str, str] = "geometry", row_index: str | None = None, mask: Column | None = None) -> DataFrame:
    """(row_idx, lng, lat) of the rows to index: masked ones and those without finite coordinates are left out."""
    lng, lat = coordinates(df, geometry)
    rows = df if row_index else with_row_index(df)
    rows = masked(rows, mask)
    return rows.select(F.col(row_index or "row_idx").cast("long").alias("row_idx"), lng.alias("lng"), lat.alias("lat")).where(finite(F.col("lng")) & finite(F.col("lat")))


def masked(df: DataFrame, mask: Column | None) -> DataFrame:
    """The rows a mask keeps; all without one, none where it is null."""
    return df if mask is None else df.where(mask)


def chosen(column: str, wanted: Collection, known: Collection | None = None) -> Column | None:
    """Mask of the rows whose category is wanted (a null one is not); no mask at all where every known category is."""
    if known is not None and set(known) <= set(wanted):
        return None
    return F.coalesce(F.col(column).isin(*wanted), F.lit(False)) if len(wanted) else F.lit(False)


def categories(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in order, without null."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def counted(df: DataFrame, mask: Column | None = None) -> DataFrame:
    """(n): the rows a mask keeps."""
    return df.agg((F.count(F.lit(1)) if mask is None else F.count_if(mask)).alias("n"))


def bounds(df: DataFrame, geometry="geometry") -> DataFrame:
    """(west, south, east, north) of the rows with finite coordinates; nulls without any."""
    lng, lat = coordinates(df, geometry)
    good = df.select(lng.alias("lng"), lat.alias("lat")).where(finite(F.col("lng")) & finite(F.col("lat")))
    return good.agg(F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))
