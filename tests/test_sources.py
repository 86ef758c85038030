"""Exchange forms, fixtures and the shared folder."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pointloom.plans.index import ClusterIndex, Options
from pointloom.sources import fixtures, formats, shared
from pointloom.sources.points import with_row_index

SCHEMA = "row_idx bigint, geometry array<double>, city string"
ROWS = [(0, [10.1234567, 20.0], "a"), (1, None, "b"), (2, [float("nan"), 1.0], None), (3, [-170.5, -84.7654321], "a")]


def test_draws_are_those_of_the_sequential_generator(spark):
    seed, want = fixtures.SEED, []
    for _ in range(3000):
        seed = seed * 16807 % 2147483647
        want.append(seed / 2147483647)
    got = [r[0] for r in spark.range(1, 3001).orderBy("id").select(fixtures.draw(F.col("id"))).collect()]
    assert got == want
    points = fixtures.uniform_points(spark, 5).orderBy("row_idx").collect()
    assert [(r["lng"], r["lat"]) for r in points] == [(want[2 * k] * 360 - 180, want[2 * k + 1] * 170 - 85) for k in range(5)]
    assert fixtures.uniform_points(spark, 0).count() == 0


def test_clustered_points_lie_around_their_centres(spark):
    got = fixtures.clustered_points(spark, 4000, [(0, 0, "a"), (50, 84, "b")]).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("lng").alias("lng"), F.stddev("lng").alias("s"), F.max("lat").alias("top"))
    got = {r["name"]: r for r in got.collect()}
    assert abs(got["a"]["n"] - 2000) < 150 and abs(got["a"]["lng"]) < 0.2 and abs(got["b"]["lng"] - 50) < 0.2
    assert abs(got["a"]["s"] - 1.5) < 0.1 and got["b"]["top"] == 85


def test_geoparquet_keeps_rows_and_box(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = f"file://{tmp_path}/points"
    known = formats.write_geoparquet(df, path)
    rows, again = formats.read_geoparquet(spark, path)
    assert again == known and known["columns"]["geometry"]["bbox"] == [-170.5, -84.765433, 10.123457, 20.0]
    assert rows.columns == ["geometry", "row_idx", "city"] and rows.count() == 4
    assert rows.where("row_idx = 3").first()["geometry"]["y"] == -84.7654321
    assert "bbox" not in formats.geo_metadata(df.limit(0))["columns"]["geometry"]


def test_geoparquet_is_read_by_and_from_other_libraries(spark, tmp_path):
    df = spark.createDataFrame([(i, [i * 1.0, 5.0], "a") for i in range(50)], SCHEMA).repartition(3)
    path = f"file://{tmp_path}/geo"
    known = formats.write_geoparquet(df, path)
    files = sorted((tmp_path / "geo").glob("*.parquet"))
    assert 1 <= len(files) <= 3 and not (tmp_path / "geo" / "_parts").exists()
    for f in files:
        assert json.loads(pq.read_schema(f).metadata[b"geo"]) == known
    table = pa.table({"geometry": pa.array([{"x": 1.0, "y": 2.0}]), "id": [7]}).replace_schema_metadata({"geo": json.dumps(known)})
    (tmp_path / "other").mkdir()
    pq.write_table(table, tmp_path / "other" / "x.parquet")
    rows, found = formats.read_geoparquet(spark, f"file://{tmp_path}/other")
    assert found == known and [tuple(r["geometry"]) for r in rows.collect()] == [(1.0, 2.0)]
    assert ClusterIndex.build(rows, options=Options(max_zoom=1)).world(5).count() == 1
    pq.write_table(table.replace_schema_metadata(None), tmp_path / "other" / "x.parquet")
    assert formats.read_geoparquet(spark, f"file://{tmp_path}/other")[1] == {}
    formats.write_geoparquet(df.limit(0), f"file://{tmp_path}/none")
    rows, found = formats.read_geoparquet(spark, f"file://{tmp_path}/none")
    assert rows.count() == 0 and rows.columns == ["geometry", "row_idx", "city"] and found == {}


def test_row_index_is_that_of_the_input_however_it_is_cut(spark):
    whole = spark.range(1000).select((F.col("id") * 3).alias("v"))
    for df in (whole.coalesce(1), whole.repartitionByRange(7, "v").sortWithinPartitions("v"), whole.orderBy("v")):
        assert all(r["v"] == 3 * r["row_idx"] for r in with_row_index(df).collect())
    mixed = whole.repartition(5)
    got = with_row_index(mixed).collect()
    assert sorted(r["row_idx"] for r in got) == list(range(1000))
    assert with_row_index(whole.limit(0)).count() == 0


def test_geojson(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = df.orderBy("row_idx").select(formats.geojson(F.col("geometry")[0], F.col("geometry")[1], city=F.col("city"))).collect()
    assert json.loads(got[0][0]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [10.1234567, 20.0]}, "properties": {"city": "a"}}
    assert got[1][0] is None


def test_arrow_streams_are_read_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    streams = formats.to_ipc(df)
    assert streams.agg(F.sum("n_rows")).first()[0] == 4
    assert sum(pa.ipc.open_stream(r["stream"]).read_all().num_rows for r in streams.collect()) == 4
    back = formats.from_ipc(streams, df.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert formats.from_ipc(formats.to_ipc(df.limit(0)), df.schema).count() == 0


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="shared"):
        shared.folder(Session)
