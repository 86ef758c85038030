"""The index against a sequential pass written from the definition, and the edge cases of its views."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions import style
from pointloom.operators import levels, local
from pointloom.plans import queries
from pointloom.plans.index import ClusterIndex, Options


def uniform(n, seed=42):
    out = []
    for i in range(n):
        seed = seed * 16807 % 2147483647
        a = seed / 2147483647
        seed = seed * 16807 % 2147483647
        out.append((i, [a * 360 - 180, seed / 2147483647 * 170 - 85]))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "row_idx bigint, geometry array<double>")


def frame(spark, coords):
    return table(spark, [(i, [float(v) for v in c]) for i, c in enumerate(coords)])


def build(spark, rows, local_nodes=1_000_000, mask=None, **options):
    return ClusterIndex.build(table(spark, rows), row_index="row_idx", mask=mask, options=Options(**options), local_nodes=local_nodes)


def greedy(rows, o):
    """Level -> [(id, x, y, n)], node by node."""
    f32 = lambda v: float(np.float32(v))
    level = []
    for i, (lng, lat) in rows:
        s = math.sin(lat * math.pi / 180)
        y = min(1.0, max(0.0, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi))
        level.append((i, f32(lng / 360 + 0.5), f32(y), 1))
    out, total = {o.max_zoom + 1: level}, len(rows)
    for z in range(o.max_zoom, o.min_zoom - 1, -1):
        r, done, now = o.radius / (o.extent * 2**z), [False] * len(level), []
        tx, ty = np.array([f32(v[1]) for v in level]), np.array([f32(v[2]) for v in level])
        for i, (key, x, y, n) in enumerate(level):
            if done[i]:
                continue
            done[i] = True
            near = [k for k in np.flatnonzero((tx - x) ** 2 + (ty - y) ** 2 <= r * r) if not done[k]]
            m = n + sum(level[k][3] for k in near)
            if m > n and m >= o.min_points:
                sx, sy = x * n, y * n
                for k in near:
                    sx, sy = sx + level[k][1] * level[k][3], sy + level[k][2] * level[k][3]
                now.append(((i << 5) + z + 1 + total, sx / m, sy / m, m))
            else:
                now.append((key, x, y, n))
                now += [level[k] for k in near]
            for k in near:
                done[k] = True
        out[z] = level = now
    return out


@pytest.mark.parametrize("min_points", [2, 4])
def test_levels_equal_the_sequential_pass(spark, min_points):
    rows, o = uniform(500), Options(radius=75, max_zoom=6, min_points=min_points)
    want = greedy(rows, o)
    nodes = ClusterIndex.build(table(spark, rows).repartition(5), row_index="row_idx", options=o).nodes.toPandas().sort_values(["level", "seq"])
    for z, level in want.items():
        got = nodes[nodes.level == z]
        assert got.node_id.tolist() == [v[0] for v in level]
        assert got.num_points.tolist() == [v[3] for v in level]
        assert np.allclose(got[["x", "y"]], [v[1:3] for v in level], atol=1e-12)


def test_joins_and_local_levels_agree(spark):
    rows = uniform(120) + [(120 + k, [10.0, 20.0]) for k in range(6)]
    a, b = (build(spark, rows, local_nodes=n, radius=75, max_zoom=2).nodes.toPandas().sort_values(["level", "seq"]).reset_index(drop=True) for n in (10**6, 0))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_rounds_by_joins_alone(spark):
    """No node is left to a single task: rounds over cells to the end."""
    rows = [(i, [i % 10 * 0.9, i // 10 * 0.9]) for i in range(60)]
    o = Options(radius=75, max_zoom=5, min_zoom=5)
    a, b = (ClusterIndex.build(table(spark, rows), row_index="row_idx", options=o, local_nodes=n, local_open=0).nodes.toPandas().sort_values(["level", "seq"]).reset_index(drop=True) for n in (10**6, 0))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_long_chain_of_dependencies(spark):
    rows = [(i, [i * 0.01, 0.0]) for i in range(400)]
    o = Options(radius=60, max_zoom=8, min_zoom=7)
    nodes = ClusterIndex.build(table(spark, rows), row_index="row_idx", options=o).nodes
    for z, level in greedy(rows, o).items():
        assert sorted(r[0] for r in nodes.where(F.col("level") == z).select("node_id").collect()) == sorted(v[0] for v in level)


def test_joins_finish_long_chains(spark):
    """A chain of 400 by joins: a round over tables, then the few nodes left in order."""
    rows = [(i, [i * 0.01, 0.0]) for i in range(400)]
    a, b = (build(spark, rows, local_nodes=n, radius=60, max_zoom=8, min_zoom=8).nodes.toPandas().sort_values(["level", "seq"]).reset_index(drop=True) for n in (10**6, 0))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_dense_levels_are_not_shuffled(spark):
    """A level whose nodes lie near few origins is built by scans: its nodes are sorted once, and no join deals them."""
    rows = spark.range(20_000).select(F.col("id").alias("row_idx"), (F.col("id") * 7919 % 3571 / 10.0 - 178).alias("lng"), (F.col("id") * 104729 % 1601 / 10.0 - 80).alias("lat"))
    before = shuffled_rows(spark)
    nodes = ClusterIndex.build(rows, ("lng", "lat"), "row_idx", options=Options(radius=75, max_zoom=1), local_nodes=5000).nodes
    assert nodes.where("level = 1").agg(F.sum("num_points")).first()[0] == 20_000
    assert shuffled_rows(spark) - before < 2 * 20_000


@pytest.mark.parametrize("min_points", [2, 4])
@pytest.mark.parametrize("first", [7, 60])
def test_first_nodes_by_rounds(spark, monkeypatch, min_points, first):
    """Levels of which the first nodes are decided apart equal those of one task, whether rounds end or hand on."""
    monkeypatch.setattr(levels, "FIRST", first)
    rows = uniform(400) + [(400 + k, [10.0, 20.0]) for k in range(6)]
    for zoom in (1, 3):
        o = Options(radius=75, max_zoom=zoom, min_zoom=max(0, zoom - 1), min_points=min_points)
        a, b = (ClusterIndex.build(table(spark, rows), row_index="row_idx", options=o, local_nodes=n, local_open=100).nodes.toPandas().sort_values(["level", "seq"]).reset_index(drop=True) for n in (10**6, 0))
        pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_dense_row_indexes_are_not_sorted(spark):
    """Rows whose indexes are 0 to n - 1 in any order are numbered already; others are sorted."""
    order = np.random.default_rng(3).permutation(20_000).tolist()
    rows = table(spark, [(i, [i * 7919 % 3571 / 10.0 - 178, i * 104729 % 1601 / 10.0 - 80]) for i in order])
    before = shuffled_rows(spark)
    ClusterIndex.build(rows, row_index="row_idx", options=Options(radius=75, max_zoom=1), local_nodes=5000).nodes.count()
    assert shuffled_rows(spark) - before < 10_000
    for ids in ([3, 1, 1, 0], [0, 2, 3, 9], [0, 0, 3, 3], [2, 0, 3, 1]):
        both_ways(spark, [(k, [10.0 * k, 1.0]) for k in ids], Options(max_zoom=2))


def both_ways(spark, rows, o, **more):
    a, b = (ClusterIndex.build(table(spark, rows), row_index="row_idx", options=o, local_nodes=n, **more).nodes.toPandas().sort_values(["level", "seq"]).reset_index(drop=True) for n in (10**6, 0))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


@pytest.mark.parametrize("min_points", [2, 4])
def test_tiles(spark, monkeypatch, min_points):
    """Tiles equal one task, with groups and copies across their borders."""
    used = []
    by_tiles = levels.by_tiles
    monkeypatch.setattr(levels, "by_tiles", lambda *a: used.append(by_tiles(*a)) or used[-1])
    monkeypatch.setattr(levels, "FIRST", 20)
    monkeypatch.setattr(levels, "TILE", 10)
    rows = uniform(1500) + [(1500 + k, [k % 3 * 45.0 - 0.001 * (k % 2), 0.0]) for k in range(30)]
    both_ways(spark, rows, Options(radius=60, max_zoom=6, min_zoom=4, min_points=min_points))
    assert [v is not None for v in used] == [True] * 3


def test_tiles_chain(spark, monkeypatch):
    """What waits for nodes beyond a tile's surroundings is decided with the rest of the chain."""
    monkeypatch.setattr(levels, "FIRST", 20)
    monkeypatch.setattr(levels, "TILE", 10)
    both_ways(spark, [(i, [i * 0.05 - 40, 0.0]) for i in range(1600)], Options(radius=60, max_zoom=9, min_zoom=8))


def test_tiles_too_dense(spark, monkeypatch):
    """Nodes of which no tile takes all that are near are left to the rounds by joins."""
    monkeypatch.setattr(levels, "FIRST", 5)
    monkeypatch.setattr(levels, "MOST_TILE", 50)
    both_ways(spark, [(i, [i % 20 * 0.5, i // 20 * 0.5]) for i in range(200)], Options(radius=60, max_zoom=6, min_zoom=6))


def test_sparse_levels_are_dealt_once(spark, monkeypatch):
    """Sixteen sparse levels: a deal by place and counts for every few zooms, a sort where something merges."""
    monkeypatch.setattr(levels, "FIRST", 500)
    rows = spark.range(20_000).select(F.col("id").alias("row_idx"), (F.col("id") * 7919 % 20011 / 57.0 - 175).alias("lng"), (F.col("id") * 104729 % 19997 / 125.0 - 80).alias("lat"))
    before = shuffled_rows(spark)
    idx = ClusterIndex.build(rows, ("lng", "lat"), "row_idx", options=Options(max_zoom=24, min_zoom=9), local_nodes=5000)
    assert idx.nodes.groupBy("level").agg(F.sum("num_points").alias("n")).where("n = 20000").count() == 17
    assert shuffled_rows(spark) - before < 17 * 2 * 20_000


def test_dense_nodes_are_not_paired(monkeypatch):
    """Rounds over cells give the origins that all pairs give."""
    rng = np.random.default_rng(2)
    x, y = (rng.random(3000) * 0.02 + 0.4 for _ in range(2))
    tx, ty = (v.astype(np.float32).astype(float) for v in (x, y))
    for r in (0.0, 0.0003, 0.002, 0.05):
        want = local.owners(x, y, tx, ty, r)
        monkeypatch.setattr(local, "MOST_PAIRS", 100)
        assert (local.owners(x, y, tx, ty, r) == want).all()
        monkeypatch.setattr(local, "MOST_PAIRS", 40_000_000)


def test_many_points_at_one_place(spark):
    df = spark.range(300_000).select(F.col("id").alias("row_idx"), (F.col("id") % 3 * 1.0).alias("lng"), F.lit(2.0).alias("lat"))
    nodes = ClusterIndex.build(df, ("lng", "lat"), "row_idx", options=Options(max_zoom=9, min_zoom=9), local_nodes=0).nodes
    assert [tuple(r) for r in nodes.where("level = 9").orderBy("seq").select("node_id", "num_points").collect()] == [(k * 32 + 10 + 300_000, 100_000) for k in range(3)]


def test_hierarchy(spark):
    idx = build(spark, uniform(200), radius=75, max_zoom=4)
    c = idx.world(0).where("is_cluster").orderBy(F.desc("point_count"), "id").first()
    assert idx.children(c["id"]).agg(F.sum("point_count")).first()[0] == c["point_count"]
    leaves = [r[0] for r in idx.leaves(c["id"]).collect()]
    assert len(leaves) == len(set(leaves)) == c["point_count"] and set(leaves) <= set(range(200))
    assert [r[0] for r in idx.leaves(c["id"], limit=5, offset=3).collect()] == leaves[3:8]
    assert idx.leaves(c["id"], limit=0).count() == 0
    below = {r[0] for r in idx.descendants(c["id"]).collect()}
    assert set(leaves) <= below and idx.children(c["id"]).count() <= len(below)
    assert 1 <= idx.expansion_zoom(c["id"]) <= 5 and idx.origin_id(c["id"]) >= 0
    assert idx.children(10**9).count() == 0 and idx.expansion_zoom(3) is None
    source = table(spark, uniform(200))
    assert idx.pick(c["id"], source, "row_idx").count() == c["point_count"]
    assert idx.pick(7, source, "row_idx").first()["row_idx"] == 7 and idx.pick(None, source, "row_idx").count() == 0
    v = idx.styled(0, focused_id=c["id"], selected_id=c["id"])
    assert v.where(F.col("id") == c["id"]).first()["fill_color"] == [255, 140, 0, 230]


def rows_read(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).inputRecords() for k in range(stages.size()))


def test_leaves_read_each_level_once(spark):
    """Under a cluster a step reads the levels it needs, not all of them, and is not worked out a second time for the result."""
    rows = spark.range(20_000).select(F.col("id").alias("row_idx"), (F.col("id") * 7919 % 3571 / 10.0 - 178).alias("lng"), (F.col("id") * 104729 % 1601 / 10.0 - 80).alias("lat"))
    a, b = (ClusterIndex.build(rows, ("lng", "lat"), "row_idx", options=Options(radius=75, max_zoom=3), local_nodes=n) for n in (10**6, 1000))
    best = b.nodes.where("level = 0").orderBy(F.desc("num_points"), "node_id").first()
    before = rows_read(spark)
    found = [r[0] for r in b.leaves(best["node_id"]).collect()]
    assert rows_read(spark) - before < 4 * 20_000
    assert len(found) == best["num_points"] and found == [r[0] for r in a.leaves(best["node_id"]).collect()]


def test_mask_keeps_ids_of_rows(spark):
    idx = build(spark, uniform(200), mask=F.col("row_idx") >= 50, radius=75, max_zoom=3)
    assert idx.indexed_point_count() == 150 and idx.num_rows == 200
    assert idx.world(9).agg(F.min("id")).first()[0] >= 50
    assert build(spark, uniform(20), mask=F.lit(False), max_zoom=2).indexed_point_count() == 0


def test_edge_cases(spark):
    assert build(spark, [], max_zoom=2).world(0).count() == 0
    one = build(spark, [(0, [0.0, 0.0])], max_zoom=2).world(0).collect()
    assert len(one) == 1 and not one[0]["is_cluster"]
    pair = ClusterIndex.build(frame(spark, [(10, 20), (10, 20)]), row_index="row_idx", options=Options(max_zoom=2)).world(0).collect()
    assert [(r["is_cluster"], r["point_count"]) for r in pair] == [(True, 2)]
    with pytest.raises(ValueError, match="not found"):
        ClusterIndex.build(spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(ValueError):
        Options(max_zoom=31)
    bad = build(spark, [(0, None), (1, [float("nan"), 1.0]), (2, [1.0, 90.0]), (3, [1.0]), (4, [2.0, -90.0])], max_zoom=1)
    assert bad.indexed_point_count() == 2


def test_boxes(spark):
    rows = [(0, [175.0, 0.0]), (1, [-175.0, 0.0]), (2, [0.0, 0.0]), (3, [100.0, 40.0]), (4, [-100.0, 40.0])]
    idx = build(spark, rows, max_zoom=10)
    ids = lambda box, z=11: sorted(r["id"] for r in idx.clusters(box, z).collect())
    assert ids((170, -85, -170, 85)) == [0, 1]
    assert ids((-180, -85, 0, 85)) == [1, 2, 4]
    assert ids((-500, -85, 500, 85), 99) == [0, 1, 2, 3, 4]
    assert ids((-10, 50, 10, -50)) == []
    assert idx.limit_zoom(3.7) == 3 and idx.limit_zoom(-4) == 0


def test_geometry_forms_and_row_index(spark):
    base = spark.createDataFrame([(10.0, 20.0), (30.0, 40.0)], "a double, b double")
    forms = [base.select(F.struct("a", "b").alias("geometry")), base.select(F.array("a", "b").alias("geometry"))]
    for df in forms:
        got = ClusterIndex.build(df, options=Options(max_zoom=1)).world(5).orderBy("id").collect()
        assert [(r["id"], r["lng"], r["lat"]) for r in got] == [(0, 10.0, 20.0), (1, 30.0, 40.0)]


def test_styles(spark):
    df = spark.createDataFrame([(1, 0), (50, 100), (1337, 200)], "n bigint, id bigint")
    got = df.select(style.radius(F.col("n"), 200), style.label(F.col("n") > 1, F.col("n")), style.text_color(style.rgba((26, 26, 64, 200)), 230), style.text_color(style.rgba((255, 255, 200, 200)))).collect()
    assert got[1][0] == pytest.approx(4 + math.log(51) / math.log(201) * 50, abs=1e-5)
    assert [r[1] for r in got] == [None, "50", "1337"]
    assert got[0][2] == [255, 255, 255, 230] and got[0][3] == [0, 0, 0, 255]
    with pytest.raises(ValueError):
        style.text_color(style.rgba((0, 0, 0, 0)), 300)
    assert style.text_angle(5, globe=True) == 180 and style.text_angle(13, globe=True) == 0


def test_saved_levels_are_read_back(spark, tmp_path):
    idx = build(spark, uniform(60), max_zoom=2)
    idx.save(f"file://{tmp_path}/nodes")
    again = ClusterIndex.load(spark, f"file://{tmp_path}/nodes")
    assert again.num_rows == 60 and again.options == idx.options
    assert again.world(1).count() == idx.world(1).count()


#: Queries whose index is that of all points, zooms 0 to 4.
INDEX_QUERIES = [
    "geometry_struct",
    "pick_point",
    "unknown_children",
    "zoom_extremes",
    "cluster_hierarchy_counts",
    "empty_view",
    "layer_fly_to",
    "pick_none",
    "styled_view",
    "zoom_clamp",
    "bbox_latitude_clamp",
    "cluster_level",
    "bbox_antimeridian",
    "bbox_points_raw",
    "leaves_limit_zero",
    "leaves_page",
]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('orders')}"
    rows = spark.range(30_000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7919 % 3001).alias("o_custkey"), F.concat(F.lit("p"), F.col("id") % 5).alias("o_orderpriority"))
    rows.write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", INDEX_QUERIES)
def test_index_queries_deal_no_points(spark, monkeypatch, orders, name):
    """A query over an index too large for one task deals its points by no join, and returns what one task gives."""
    query, build = queries.queries()[name], ClusterIndex.build
    want = sorted(map(str, query(spark, orders).collect()))
    monkeypatch.setattr(ClusterIndex, "build", lambda *a, **more: build(*a, **more, local_nodes=20_000))
    before = shuffled_rows(spark)
    assert sorted(map(str, query(spark, orders).collect())) == want
    assert shuffled_rows(spark) - before < 2 * 30_000
