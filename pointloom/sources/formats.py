"""Exchange forms of point tables: GeoParquet, GeoJSON features and Arrow IPC streams.

All three are made where the rows are; nothing but a bounding box reaches the driver.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.sources.points import bounds, coordinates
from pointloom.sources.shared import move_named

#: Bytes a point takes in memory (two doubles), an id takes, and a table takes besides.
POINT_BYTES, ID_BYTES, TABLE_BYTES = 16, 4, 1024


def geo_metadata(df: DataFrame, geometry="geometry") -> dict:
    """GeoParquet 1.1 description of a point column; the box is widened to millionths of a degree, absent without points."""
    west, south, east, north = bounds(df, geometry).first()
    column = {"encoding": "point", "geometry_types": ["Point"]}
    if west is not None:
        down, up = (lambda v: math.floor(v * 1e6) / 1e6), (lambda v: math.ceil(v * 1e6) / 1e6)
        column["bbox"] = [down(west), down(south), up(east), up(north)]
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}


def write_geoparquet(df: DataFrame, path: str, geometry="geometry") -> dict:
    """Writes ``df`` as GeoParquet files, ZSTD, its points as one column struct<x, y>, and returns the description.

    The description belongs into every file's footer, where Spark's writer puts no entries: tasks write their files
    themselves, each under a name of its own, and the driver moves those that finished tasks name, so what lost or
    repeated tasks left is not seen. ``path`` must be new and open to pyarrow (local or shared folder, HDFS, S3, GCS).
    """
    lng, lat = coordinates(df, geometry)
    taken = {geometry} if isinstance(geometry, str) else set(geometry)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    known = geo_metadata(df, geometry)
    entry = {b"geo": json.dumps(known).encode()}
    parts = f"{path}/_parts"

    def run(batches):
        import uuid

        from pyarrow import fs, parquet

        files, folder = fs.FileSystem.from_uri(parts)
        writer, name, n = None, f"part-{uuid.uuid4().hex}.parquet", 0
        for batch in batches:
            if writer is None:
                files.create_dir(folder, recursive=True)
                schema = batch.schema.with_metadata({**(batch.schema.metadata or {}), **entry})
                writer = parquet.ParquetWriter(f"{folder}/{name}", schema, filesystem=files, compression="zstd")
            writer.write_batch(batch.replace_schema_metadata(schema.metadata))
            n += batch.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    rows = df.select(F.struct(lng.alias("x"), lat.alias("y")).alias("geometry"), *rest)
    # A row a file; a table without rows is one empty file.
    names = [r["name"] for r in rows.mapInArrow(run, "name string, n bigint").collect()]
    names = names or [r.column("name")[0].as_py() for r in run([pa.RecordBatch.from_pylist([], to_arrow_schema(rows.schema))])]
    move_named(df.sparkSession, parts, path, names)
    return known


def read_geoparquet(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows of GeoParquet files, of this writer or another, and the description in the footer of one of them; empty where there is none."""
    rows = spark.read.parquet(path)
    name = rows.select(F.input_file_name()).first()
    known = {}
    if name is not None:
        from pyarrow import fs, parquet

        files, where = fs.FileSystem.from_uri(name[0])
        known = json.loads((parquet.read_metadata(where, filesystem=files).metadata or {}).get(b"geo", b"{}"))
    return rows, known


def geojson(lng: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text; null where the point is."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"))
    return F.when(lng.isNotNull() & lat.isNotNull(), F.to_json(feature))


def to_ipc(df: DataFrame) -> DataFrame:
    """(stream, n_rows): the table as Arrow IPC streams, one a batch of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows."""

    def run(batches):
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["stream", "n_rows"])

    return df.mapInArrow(run, "stream binary, n_rows bigint")


def from_ipc(streams: DataFrame, schema) -> DataFrame:
    """The rows of the streams of :func:`to_ipc`, whose column types are ``schema``."""

    def run(batches):
        for batch in batches:
            for stream in batch.column("stream"):
                yield from pa.ipc.open_stream(stream.as_buffer())

    return streams.select("stream").mapInArrow(run, schema)


def ipc_bytes(streams: DataFrame) -> DataFrame:
    """(n_rows, bytes) of Arrow IPC streams as measured."""
    return streams.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.octet_length("stream")), F.lit(0)).alias("bytes"))


def estimated_bytes(rows: Column) -> Column:
    """Memory that so many points with ids take as columns."""
    return rows * (POINT_BYTES + ID_BYTES) + TABLE_BYTES
