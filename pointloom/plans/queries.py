"""Queries over points derived from ``orders`` by integer arithmetic, each with its DuckDB text where SQL can follow.

Row index = o_orderkey (dense from 0); o_orderpriority plays the part of a category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import ids, mercator, style
from pointloom.operators import levels
from pointloom.plans.index import ClusterIndex, Options
from pointloom.plans.layer import FLY_LIMIT, ClusterLayer
from pointloom.sources import fixtures, formats, points
from pointloom.sources.shared import fresh, storage

OPTIONS = Options(radius=40, max_zoom=4)
SPARSE = Options(radius=75, max_zoom=4, min_points=4)
PRIMARY, SECONDARY, SELECTED = (26, 26, 64, 200), (100, 100, 200, 200), (255, 140, 0, 230)


def source(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    lng = ((F.col("o_orderkey") * 48271) % 36000) / F.lit(100.0) - 180.0
    lat = ((F.col("o_custkey") * 16807 + F.col("o_orderkey") * 7) % 17000) / F.lit(100.0) - 85.0
    return o.select(F.col("o_orderkey").alias("row_idx"), lng.alias("lng"), lat.alias("lat"), F.col("o_orderpriority").alias("category"))


def index(spark, sf, options=OPTIONS, mask=None) -> ClusterIndex:
    return ClusterIndex.build(source(spark, sf), geometry=("lng", "lat"), row_index="row_idx", mask=mask, options=options)


def shown(view: DataFrame) -> DataFrame:
    return view.select(F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "point_count", "id", "is_cluster")


def top(idx: ClusterIndex) -> int:
    """The largest cluster of the coarsest level, the smaller id first."""
    return idx.nodes.where(F.col("level") == idx.options.min_zoom).orderBy(F.desc("num_points"), "node_id").select("node_id").first()[0]


def project(spark, sf):
    return source(spark, sf).select("row_idx", F.round(mercator.lng_x(F.col("lng")), 9).alias("x"), F.round(mercator.lat_y(F.col("lat")), 9).alias("y"))


def unproject(spark, sf):
    p = source(spark, sf).select("row_idx", mercator.lng_x(F.col("lng")).alias("x"), mercator.lat_y(F.col("lat")).alias("y"))
    return p.select("row_idx", F.round(mercator.x_lng(F.col("x")), 6).alias("lng"), F.round(mercator.y_lat(F.col("y")), 6).alias("lat"))


def boxed(bbox, options=OPTIONS):
    return lambda spark, sf: shown(index(spark, sf, options).clusters(bbox, options.max_zoom + 1))


def neighbours(spark, sf):
    store = storage(spark)
    p = source(spark, sf).select(F.col("row_idx").alias("seq"), mercator.fround(mercator.lng_x(F.col("lng"))).alias("x"), mercator.fround(mercator.lat_y(F.col("lat"))).alias("y"))
    return levels.neighbours(store(p.withColumn("tx", F.col("x")).withColumn("ty", F.col("y"))), OPTIONS.radius / (OPTIONS.extent * 2.0**OPTIONS.max_zoom))


def origins(spark, sf):
    store = storage(spark)
    p = source(spark, sf).select(F.col("row_idx").alias("seq"), mercator.fround(mercator.lng_x(F.col("lng"))).alias("x"), mercator.fround(mercator.lat_y(F.col("lat"))).alias("y"))
    p = store(p.withColumn("tx", F.col("x")).withColumn("ty", F.col("y")))
    return levels.owners(p, OPTIONS.radius / (OPTIONS.extent * 2.0**OPTIONS.max_zoom), store, local_open=1500)


def hierarchy(spark, sf):
    return levels_of(index(spark, sf))


def codec(spark, sf):
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    z = F.col("row_idx") % 17
    p = source(spark, sf).select("row_idx", (F.shiftleft(F.col("row_idx"), 5) + z + 1 + n).alias("id"))
    return p.select("row_idx", "id", ids.origin_zoom(F.col("id"), n).alias("zoom"), ids.origin_seq(F.col("id"), n).alias("origin"))


def of_top(get, options=OPTIONS):
    def run(spark, sf):
        idx = index(spark, sf, options)
        return get(idx, top(idx), source(spark, sf))

    return run


def fill(spark, sf):
    p = source(spark, sf)
    color = style.fill_color(F.col("row_idx"), PRIMARY, SECONDARY, SELECTED, 7, 11, F.col("row_idx") % 10 == 3)
    return p.select("row_idx", F.array_join(color.cast("array<string>"), ",").alias("fill"))


def styled(spark, sf):
    v = index(spark, sf).styled(2)
    return v.select("id", "point_count", F.array_join(F.col("fill_color").cast("array<string>"), ",").alias("fill"), F.round(F.col("radius").cast("double"), 3).alias("radius"), F.array_join(F.col("text_color").cast("array<string>"), ",").alias("text_color"), "text", "text_angle")


def saved_view(spark, sf):
    path = fresh(spark, "index")
    index(spark, sf).save(path)
    return shown(ClusterIndex.load(spark, path).world(3))


def geojson(spark, sf):
    p = source(spark, sf).select("row_idx", F.round("lng", 2).alias("lng"), F.round("lat", 2).alias("lat"))
    return p.select("row_idx", formats.geojson(F.col("lng"), F.col("lat"), row_idx=F.col("row_idx")).alias("feature"))


def geoparquet(spark, sf):
    path = fresh(spark, "geoparquet")
    formats.write_geoparquet(source(spark, sf), path, ("lng", "lat"))
    rows, known = formats.read_geoparquet(spark, path)
    box = known["columns"]["geometry"]["bbox"]
    return rows.select("row_idx", F.col("geometry.x").alias("lng"), F.col("geometry.y").alias("lat"), *[F.lit(v).alias(k) for k, v in zip(("west", "south", "east", "north"), box)])


def arrow(spark, sf):
    p = source(spark, sf)
    return formats.from_ipc(formats.to_ipc(p), p.schema)


def uniform(spark, sf):
    p = fixtures.uniform_points(spark, spark.read.parquet(f"{sf}/orders.parquet").count())
    return p.select("row_idx", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


CENTRES = [(-60.0, -20.0, "west"), (10.5, 45.25, "north"), (120.0, 83.0, "far")]


def clustered(spark, sf):
    p = fixtures.clustered_points(spark, spark.read.parquet(f"{sf}/orders.parquet").count(), CENTRES)
    return p.select("row_idx", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "name")


CATEGORIES = ("1-URGENT", "2-HIGH")


def chosen():
    return points.chosen("category", CATEGORIES)


def shaped(form):
    """The points with their geometry in one column."""
    return lambda spark, sf: source(spark, sf).select("row_idx", form("lng", "lat").alias("geometry"))


def form_view(form, zoom):
    def run(spark, sf):
        idx = ClusterIndex.build(shaped(form)(spark, sf), row_index="row_idx", options=OPTIONS)
        return shown(idx.world(zoom))

    return run


def numbered(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").repartition(7, "o_orderkey")
    return points.with_row_index(o, order_by="o_orderkey")


def chunked(spark, sf):
    """Ids are the places of rows in the input, however it is cut."""
    rows = source(spark, sf).repartitionByRange(6, "row_idx").sortWithinPartitions("row_idx").drop("row_idx")
    return shown(ClusterIndex.build(rows, geometry=("lng", "lat"), options=OPTIONS).world(3))


def flawed(spark, sf):
    """Every seventh latitude is no number, every eleventh longitude is missing, every thirteenth infinite."""
    k = F.col("row_idx")
    lng = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit(float("inf"))).otherwise(F.col("lng"))
    rows = source(spark, sf).select("row_idx", lng.alias("lng"), F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("lat")).alias("lat"))
    return points.points(rows, ("lng", "lat"), "row_idx")


ZOOMS = (-3.5, 0.0, 2.7, 4.0, 4.99, 5.0, 99.0)


def clamped(spark, sf):
    idx = index(spark, sf)
    return spark.createDataFrame([(z, idx.limit_zoom(z)) for z in ZOOMS], "zoom double, shown int")


def extremes(spark, sf):
    idx, out = index(spark, sf), None
    for name, zoom in (("below", -2.0), ("between", 3.9), ("above", 99.0), ("none", float("nan"))):
        one = idx.world(zoom).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("shown"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"))
        out = one if out is None else out.unionByName(one)
    return out


def angles(spark, sf):
    return spark.createDataFrame([(z, globe, style.text_angle(z, globe)) for z in (0.0, 11.9, 12.0, 12.1, 20.0) for globe in (True, False)], "zoom double, globe boolean, angle int")


def distributed(get, local_nodes=0):
    """The index by joins alone, or down to so many nodes; so few open nodes that rounds are run are left to the task that ends a level."""
    return lambda spark, sf: get(ClusterIndex.build(source(spark, sf), geometry=("lng", "lat"), row_index="row_idx", options=OPTIONS, local_nodes=local_nodes, local_open=1500))


def levels_of(idx):
    return idx.nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("num_points") > 1).cast("long")).alias("clusters"), F.sum("num_points").alias("points"))


def layered(spark, sf):
    """What a kept view makes anew over a series of requests, and how many nodes it shows then."""
    rows, two, layer, out = source(spark, sf), Options(radius=75, max_zoom=4, min_points=4), ClusterLayer(), []
    best = top(index(spark, sf))
    mask, again = F.col("row_idx") % 2 == 0, F.col("row_idx") % 2 == 0
    series = [
        ("first", rows, 2.0, None, OPTIONS, None), ("same", rows, 2.0, None, OPTIONS, None), ("moved", rows, 2.9, None, OPTIONS, None), ("zoomed", rows, 3.1, None, OPTIONS, None),
        ("focused", rows, 3.1, None, OPTIONS, best), ("options", rows, 3.1, None, two, None), ("masked", rows, 1.0, mask, two, None), ("same mask", rows, 1.0, again, two, None),
        ("all", rows, 4.0, points.chosen("category", ("a", "b"), ("b",)), OPTIONS, None), ("gone", None, 4.0, None, OPTIONS, None), ("no rows", rows.limit(0), 4.0, None, OPTIONS, None),
    ]
    for name, data, zoom, keep, options, focus in series:
        done = layer.update(data, zoom, ("lng", "lat"), "row_idx", keep, options, focus)
        out.append((name, ",".join(done), layer.view.count() if layer.view is not None else -1))
    return spark.createDataFrame(out, "step string, made string, shown bigint")


def flown(spark, sf):
    layer = ClusterLayer()
    before = layer.fly_to(1)
    layer.update(source(spark, sf), 0, ("lng", "lat"), "row_idx", options=OPTIONS)
    best = top(layer.index)
    return spark.createDataFrame([("no index", before), ("cluster", layer.fly_to(best)), ("point", layer.fly_to(3)), ("limit", min(25, FLY_LIMIT))], "name string, zoom int")


def picked(spark, sf):
    layer, rows = ClusterLayer(), source(spark, sf)
    layer.update(rows, 0, ("lng", "lat"), "row_idx", options=OPTIONS)
    out = []
    for node in (top(layer.index), 12, None, -5):
        info, found = layer.picked(node, rows, "row_idx")
        out.append((info["is_cluster"], info["cluster_id"], info["point_count"], found.count()))
    return spark.createDataFrame(out, "is_cluster boolean, cluster_id bigint, point_count bigint, n_rows bigint").distinct()


def wire(spark, sf):
    """Arrow IPC streams against GeoJSON features: rows, and whether the streams take less than half the bytes."""
    p = source(spark, sf)
    text = geojson(spark, sf).agg(F.sum(F.octet_length("feature")).alias("json"))
    return formats.ipc_bytes(formats.to_ipc(p.select("row_idx", "lng", "lat"))).crossJoin(text).select("n_rows", (F.col("bytes") * 2 < F.col("json")).alias("less"))


def focused(spark, sf):
    idx = index(spark, sf)
    v = idx.styled(2, focused_id=top(idx), selected_id=None)
    return v.select("id", F.array_join(F.col("fill_color").cast("array<string>"), ",").alias("fill"))


WHOLE = Options()


def queries():
    return {
        "project_mercator": project,
        "unproject_mercator": unproject,
        "masked_points": lambda s, d: points.points(source(s, d), ("lng", "lat"), "row_idx", F.col("row_idx") % 3 != 0),
        "indexed_point_count": lambda s, d: s.createDataFrame([(index(s, d, mask=F.col("row_idx") % 3 != 0).indexed_point_count(),)], "n bigint"),
        "category_mask": lambda s, d: source(s, d).select("row_idx", chosen().alias("keep")),
        "distinct_categories": lambda s, d: points.categories(source(s, d), "category"),
        "filtered_count": lambda s, d: points.counted(source(s, d), chosen()),
        "bounds": lambda s, d: points.bounds(source(s, d), ("lng", "lat")),
        "bbox_points_raw": boxed((-30.5, -20.25, 40.5, 50.75)),
        "bbox_antimeridian": boxed((170.2, -85, -160.7, 85)),
        "bbox_world_wrap": boxed((-200, -85, 200, 85)),
        "bbox_latitude_clamp": boxed((-10.3, -200, 20.7, 95)),
        "empty_view": boxed((-10, 50, 10, -50)),
        "radius_neighbors": neighbours,
        "origin_selection": origins,
        "cluster_level": lambda s, d: shown(index(s, d).world(4)),
        "cluster_level_minpoints": lambda s, d: shown(index(s, d, SPARSE).world(4)),
        "cluster_world_coarse": lambda s, d: shown(index(s, d).world(1)),
        "cluster_hierarchy_counts": hierarchy,
        "id_codec": codec,
        "cluster_children": of_top(lambda i, c, p: shown(i.children(c))),
        "cluster_leaves": of_top(lambda i, c, p: i.leaves(c)),
        "leaves_page": of_top(lambda i, c, p: i.leaves(c, limit=50, offset=20)),
        "cluster_descendants": of_top(lambda i, c, p: i.descendants(c)),
        "expansion_zoom": lambda s, d: index(s, d).expansion_zooms(),
        "all_selected": lambda s, d: points.counted(source(s, d), points.chosen("category", ("x", "y"), ("y",))),
        "geometry_array": form_view(F.array, 4),
        "geometry_struct": form_view(F.struct, 2),
        "row_index_builtin": numbered,
        "row_index_chunks": chunked,
        "finite_points": flawed,
        "zoom_clamp": clamped,
        "zoom_extremes": extremes,
        "text_angle": angles,
        "unknown_children": lambda s, d: shown(index(s, d).children(10**12)),
        "leaves_limit_zero": of_top(lambda i, c, p: i.leaves(c, limit=0)),
        "distributed_level": distributed(lambda i: shown(i.world(4))),
        "distributed_hierarchy": distributed(levels_of),
        "distributed_then_local": distributed(lambda i: shown(i.world(0)), 5000),
        "default_index_view": lambda s, d: shown(index(s, d, WHOLE).world(3)),
        "layer_updates": layered,
        "layer_fly_to": flown,
        "layer_picks": picked,
        "wire_size": wire,
        "styled_focus": focused,
        "saved_index_view": saved_view,
        "geojson_features": geojson,
        "geoparquet_roundtrip": geoparquet,
        "arrow_roundtrip": arrow,
        "size_estimate": lambda s, d: source(s, d).agg(formats.estimated_bytes(F.count(F.lit(1))).alias("bytes")),
        "uniform_points": uniform,
        "clustered_points": clustered,
        "style_fill": fill,
        "style_radius": lambda s, d: source(s, d).select("row_idx", F.round(style.radius(F.col("row_idx") + 1, 1_000_000).cast("double"), 4).alias("radius")),
        "style_text_color": lambda s, d: source(s, d).select("row_idx", F.array_join(style.text_color(F.array(*[(F.col("row_idx") * k % 256).cast("int") for k in (1, 7, 13)]), 230).cast("array<string>"), ",").alias("color")),
        "style_label": lambda s, d: source(s, d).select("row_idx", style.label(F.col("row_idx") % 4 > 0, F.col("row_idx") % 4 + 1).alias("text")),
        "styled_view": styled,
        "pick_cluster": of_top(lambda i, c, p: i.pick(c, p, "row_idx").select("row_idx", "category")),
        "pick_point": lambda s, d: index(s, d).pick(12, source(s, d), "row_idx").select("row_idx", "category"),
        "pick_none": lambda s, d: index(s, d).pick(None, source(s, d), "row_idx").select("row_idx", "category"),
    }


P = "p AS (SELECT o_orderkey row_idx, ((o_orderkey * 48271) % 36000) / 100.0::DOUBLE - 180.0::DOUBLE lng, ((o_custkey * 16807 + o_orderkey * 7) % 17000) / 100.0::DOUBLE - 85.0::DOUBLE lat, o_orderpriority category FROM orders)"
X = "(lng / 360.0::DOUBLE + 0.5::DOUBLE)"
Y = "least(greatest(0.5::DOUBLE - 0.25::DOUBLE * ln((1.0::DOUBLE + sin(lat * pi() / 180.0::DOUBLE)) / (1.0::DOUBLE - sin(lat * pi() / 180.0::DOUBLE))) / pi(), 0.0::DOUBLE), 1.0::DOUBLE)"
LAT = "(360.0::DOUBLE * atan(exp((180.0::DOUBLE - y * 360.0::DOUBLE) * pi() / 180.0::DOUBLE)) / pi() - 90.0::DOUBLE)"


def edges_sql(name: str, of: str, r: float) -> str:
    """Theta join on cells as wide as the radius."""
    s = r * (1 + 1e-6)
    return f"""{name} AS MATERIALIZED (SELECT a.seq src, b.seq dst FROM (SELECT *, unnest([-1, 0, 1]) i FROM (SELECT *, unnest([-1, 0, 1]) j FROM {of})) a
  JOIN {of} b ON floor(a.x / {s!r}::DOUBLE) + i = floor(b.x::FLOAT::DOUBLE / {s!r}::DOUBLE) AND floor(a.y / {s!r}::DOUBLE) + j = floor(b.y::FLOAT::DOUBLE / {s!r}::DOUBLE)
  WHERE a.seq < b.seq AND (b.x::FLOAT::DOUBLE - a.x) * (b.x::FLOAT::DOUBLE - a.x) + (b.y::FLOAT::DOUBLE - a.y) * (b.y::FLOAT::DOUBLE - a.y) <= {r * r!r}::DOUBLE)"""


def chain(options: Options) -> str:
    """Every level by a fold over the nodes in order, as CTEs; ``nodes`` holds them all."""
    top_level = options.max_zoom + 1
    out = [P, f"l{top_level} AS MATERIALIZED (SELECT row_idx seq, row_idx id, 1::BIGINT n, {X}::FLOAT::DOUBLE x, {Y}::FLOAT::DOUBLE y, lng, lat FROM p)"]
    for z in range(options.max_zoom, options.min_zoom - 1, -1):
        at, r = f"l{z + 1}", options.radius / (options.extent * 2.0**z)
        out.append(edges_sql(f"e{z}", at, r))
        # Covered nodes are gathered in order: a node none of whose earlier neighbours is an origin becomes one.
        out.append(f"""q{z} AS MATERIALIZED (SELECT list(struct_pack(k := dst, p := ps) ORDER BY dst) ps FROM (SELECT dst, list(src) ps FROM e{z} GROUP BY dst))""")
        out.append(f"""c{z} AS MATERIALIZED (SELECT unnest(list_reduce(range(0, len(ps)), lambda acc, k: CASE WHEN len(list_filter(ps[k + 1].p, lambda s: NOT list_contains(acc, s))) = 0 THEN acc ELSE list_append(acc, ps[k + 1].k) END, []::BIGINT[])) seq FROM q{z})""")
        out.append(f"""o{z} AS MATERIALIZED (SELECT l.*, CASE WHEN c.seq IS NULL THEN l.seq ELSE m.o END own FROM {at} l LEFT JOIN c{z} c ON c.seq = l.seq
  LEFT JOIN (SELECT e.dst, min(e.src) o FROM e{z} e WHERE e.src NOT IN (SELECT seq FROM c{z}) GROUP BY e.dst) m ON m.dst = l.seq)""")
        out.append(f"""a{z} AS MATERIALIZED (SELECT own, count(*) m, sum(n)::BIGINT n, sum(x * n) / sum(n) x, sum(y * n) / sum(n) y FROM o{z} GROUP BY own HAVING count(*) > 1 AND sum(n) >= {options.min_points})""")
        out.append(f"""l{z} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY own, ms) - 1 seq, id, n, x, y, lng, lat FROM (
  SELECT own, own ms, own * 32 + {z + 1} + (SELECT count(*) FROM p) id, n, x, y, NULL::DOUBLE lng, NULL::DOUBLE lat FROM a{z}
  UNION ALL SELECT own, seq, id, n, x, y, lng, lat FROM o{z} WHERE own NOT IN (SELECT own FROM a{z})))""")
        out.append(f"n{z + 1} AS (SELECT {z + 1} AS level, o.seq, id, o.n, o.x, o.y, lng, lat, CASE WHEN a.own IS NOT NULL THEN a.own * 32 + {z + 1} + (SELECT count(*) FROM p) END parent FROM o{z} o LEFT JOIN a{z} a ON a.own = o.own)")
    low = options.min_zoom
    out.append(f"nodes AS MATERIALIZED (SELECT {low} AS level, seq, id, n, x, y, lng, lat, NULL::BIGINT parent FROM l{low} " + " ".join(f"UNION ALL SELECT * FROM n{z}" for z in range(low + 1, top_level + 1)) + ")")
    out.append(f"best AS MATERIALIZED (SELECT id FROM nodes WHERE level = {low} ORDER BY n DESC, id LIMIT 1)")
    out.append(
        f"under AS (SELECT id, n, [seq] path FROM nodes WHERE parent = (SELECT id FROM best) UNION ALL SELECT nodes.id, nodes.n, list_append(under.path, nodes.seq) FROM under JOIN nodes ON nodes.parent = under.id WHERE under.n > 1)"
    )
    return "WITH RECURSIVE " + ",\n".join(out) + "\n"


SHOW = f"round(CASE WHEN n > 1 THEN (x - 0.5) * 360.0::DOUBLE ELSE lng END, 6) lng, round(CASE WHEN n > 1 THEN {LAT} ELSE lat END, 6) lat, n point_count, id, n > 1 is_cluster"


def box_sql(where: str) -> str:
    return f"WITH {P}, b AS (SELECT row_idx, lng, lat, {X}::FLOAT::DOUBLE x, {Y}::FLOAT::DOUBLE y FROM p) SELECT round(lng, 6) lng, round(lat, 6) lat, 1::BIGINT point_count, row_idx id, false is_cluster FROM b WHERE {where}"


def x_of(v: float) -> str:
    return f"{mercator.lng_x_of(v)!r}::DOUBLE"


def y_of(v: float) -> str:
    return f"{mercator.lat_y_of(v)!r}::DOUBLE"


def draws_sql(each: int) -> str:
    """``each`` draws of the generator for every order: (i, u), i from 1; the state is multiplied up bit by bit."""
    powers = [pow(fixtures.FACTOR, 1 << b, fixtures.MODULUS) for b in range(fixtures.BITS)]
    state = f"{fixtures.SEED}::BIGINT"
    for b, power in enumerate(powers):
        state = f"({state} * CASE WHEN (i >> {b}) & 1 = 1 THEN {power} ELSE 1 END % {fixtures.MODULUS})"
    return f"u AS MATERIALIZED (SELECT i, {state} / {fixtures.MODULUS}.0::DOUBLE u FROM (SELECT unnest(range(1, {each} * (SELECT count(*) FROM orders) + 1)) i))"


def layer_sql(one: str, sparse: str, world: str) -> str:
    """The series of requests: what is made anew follows from the rules, the numbers of nodes from both indexes and a masked one."""
    half = chain(Options(radius=75, max_zoom=4, min_points=4)).replace("seq, row_idx id, 1::BIGINT n", "seq, row_idx id, 1::BIGINT n", 1).replace("lng, lat FROM p)", "lng, lat FROM p WHERE row_idx % 2 = 0)", 1)
    count = lambda with_, level: f"({with_} SELECT count(*) FROM nodes WHERE level = {level} AND {world})"
    steps = [
        ("first", "index,view", count(one, 2)), ("same", "", count(one, 2)), ("moved", "", count(one, 2)), ("zoomed", "view", count(one, 3)), ("focused", "focus", count(one, 3)),
        ("options", "index,view,focus", count(sparse, 3)), ("masked", "index,view", count(half, 1)), ("same mask", "", count(half, 1)), ("all", "index,view", count(one, 4)),
        ("gone", "index,view", "-1"), ("no rows", "index,view", "-1"),
    ]
    return " UNION ALL ".join(f"SELECT '{name}' step, '{made}' made, {shown}::BIGINT shown" for name, made, shown in steps)


def oracle_sql():
    r = OPTIONS.radius / (OPTIONS.extent * 2.0**OPTIONS.max_zoom)
    one, sparse = chain(OPTIONS), chain(SPARSE)
    rows85 = f"y BETWEEN {y_of(85)} AND {y_of(-85)}"
    world = f"x BETWEEN {x_of(-180)} AND {x_of(180)} AND {rows85}"
    tone = "CASE WHEN 0.2126::DOUBLE * f(row_idx % 256) + 0.7152::DOUBLE * f(row_idx * 7 % 256) + 0.0722::DOUBLE * f(row_idx * 13 % 256) > 0.5 THEN '0' ELSE '255' END"
    for k in ("row_idx % 256", "row_idx * 7 % 256", "row_idx * 13 % 256"):
        tone = tone.replace(f"f({k})", f"(CASE WHEN ({k}) / 255.0::DOUBLE <= 0.03928 THEN ({k}) / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((({k}) / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)")
    return {
        "project_mercator": f"WITH {P} SELECT row_idx, round({X}, 9) x, round({Y}, 9) y FROM p",
        "unproject_mercator": f"WITH {P}, q AS (SELECT row_idx, {X} x, {Y} y FROM p) SELECT row_idx, round((x - 0.5) * 360.0::DOUBLE, 6) lng, round({LAT}, 6) lat FROM q",
        "masked_points": f"WITH {P} SELECT row_idx, lng, lat FROM p WHERE row_idx % 3 <> 0",
        "indexed_point_count": f"WITH {P} SELECT count(*)::BIGINT n FROM p WHERE row_idx % 3 <> 0",
        "category_mask": f"WITH {P} SELECT row_idx, category IN ('1-URGENT', '2-HIGH') keep FROM p",
        "distinct_categories": f"WITH {P} SELECT DISTINCT category FROM p ORDER BY category",
        "filtered_count": f"WITH {P} SELECT count(*)::BIGINT n FROM p WHERE category IN ('1-URGENT', '2-HIGH')",
        "bounds": f"WITH {P} SELECT min(lng) west, min(lat) south, max(lng) east, max(lat) north FROM p",
        "bbox_points_raw": box_sql(f"x BETWEEN {x_of(-30.5)} AND {x_of(40.5)} AND y BETWEEN {y_of(50.75)} AND {y_of(-20.25)}"),
        "bbox_antimeridian": box_sql(f"(x BETWEEN {x_of(170.2)} AND 1.0 OR x BETWEEN 0.0 AND {x_of(-160.7)}) AND {rows85}"),
        "bbox_world_wrap": box_sql(world),
        "bbox_latitude_clamp": box_sql(f"x BETWEEN {x_of(-10.3)} AND {x_of(20.7)}"),
        "empty_view": box_sql("false"),
        "radius_neighbors": f"WITH {P}, l AS (SELECT row_idx seq, {X}::FLOAT::DOUBLE x, {Y}::FLOAT::DOUBLE y FROM p), {edges_sql('e', 'l', r)} SELECT src, dst FROM e",
        "origin_selection": one + f"SELECT seq, own AS owner FROM o{OPTIONS.max_zoom}",
        "cluster_level": one + f"SELECT {SHOW} FROM nodes WHERE level = 4 AND {world}",
        "cluster_level_minpoints": sparse + f"SELECT {SHOW} FROM nodes WHERE level = 4 AND {world}",
        "cluster_world_coarse": one + f"SELECT {SHOW} FROM nodes WHERE level = 1 AND {world}",
        "cluster_hierarchy_counts": one + "SELECT level, count(*)::BIGINT AS nodes, count(*) FILTER (n > 1)::BIGINT clusters, sum(n)::BIGINT points FROM nodes GROUP BY level",
        "id_codec": f"WITH {P}, c AS (SELECT row_idx, row_idx * 32 + row_idx % 17 + 1 + (SELECT count(*) FROM p) id FROM p) SELECT row_idx, id, (id - (SELECT count(*) FROM p)) % 32 AS zoom, (id - (SELECT count(*) FROM p)) // 32 origin FROM c",
        "cluster_children": one + f"SELECT {SHOW} FROM nodes WHERE parent = (SELECT id FROM best)",
        "cluster_leaves": one + "SELECT id row_idx FROM under WHERE n = 1",
        "leaves_page": one + "SELECT id row_idx FROM under WHERE n = 1 ORDER BY path LIMIT 50 OFFSET 20",
        "cluster_descendants": one + "SELECT id FROM under",
        "expansion_zoom": one + "SELECT parent id, min(level)::BIGINT AS zoom FROM nodes WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > 1",
        "all_selected": f"WITH {P} SELECT count(*)::BIGINT n FROM p",
        "geometry_array": one + f"SELECT {SHOW} FROM nodes WHERE level = 4 AND {world}",
        "geometry_struct": one + f"SELECT {SHOW} FROM nodes WHERE level = 2 AND {world}",
        "row_index_builtin": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 row_idx FROM orders",
        "row_index_chunks": one + f"SELECT {SHOW} FROM nodes WHERE level = 3 AND {world}",
        "finite_points": f"WITH {P} SELECT row_idx, lng, lat FROM p WHERE row_idx % 7 <> 0 AND row_idx % 11 <> 0 AND row_idx % 13 <> 0",
        "zoom_clamp": f"SELECT z AS zoom, greatest(0, least(floor(z), 5))::INT shown FROM (VALUES {', '.join(f'({z}::DOUBLE)' for z in ZOOMS)}) t(z)",
        "zoom_extremes": one + f"SELECT name, count(n)::BIGINT shown, coalesce(sum(n), 0)::BIGINT points FROM (VALUES ('below', 0), ('between', 3), ('above', 5), ('none', -1)) t(name, z) LEFT JOIN (SELECT * FROM nodes WHERE {world}) w ON w.level = z GROUP BY name",
        "text_angle": "SELECT z AS zoom, globe, CASE WHEN globe AND z <= 12 THEN 180 ELSE 0 END::INT angle FROM (VALUES (0::DOUBLE), (11.9::DOUBLE), (12::DOUBLE), (12.1::DOUBLE), (20::DOUBLE)) t(z), (VALUES (true), (false)) u(globe)",
        "unknown_children": one + f"SELECT {SHOW} FROM nodes WHERE parent = 1000000000000",
        "leaves_limit_zero": one + "SELECT id row_idx FROM under WHERE n = 1 LIMIT 0",
        "distributed_level": one + f"SELECT {SHOW} FROM nodes WHERE level = 4 AND {world}",
        "distributed_hierarchy": one + "SELECT level, count(*)::BIGINT AS nodes, count(*) FILTER (n > 1)::BIGINT clusters, sum(n)::BIGINT points FROM nodes GROUP BY level",
        "distributed_then_local": one + f"SELECT {SHOW} FROM nodes WHERE level = 0 AND {world}",
        "default_index_view": chain(WHOLE) + f"SELECT {SHOW} FROM nodes WHERE level = 3 AND {world}",
        "layer_updates": layer_sql(one, sparse, world),
        "layer_fly_to": one + "SELECT 'no index' AS name, 0 AS zoom UNION ALL SELECT 'cluster', least(20, (SELECT min(level) FROM nodes WHERE parent = (SELECT id FROM best)))::INT UNION ALL SELECT 'point', 0 UNION ALL SELECT 'limit', 20",
        "layer_picks": one + "SELECT true is_cluster, id cluster_id, (SELECT max(n) FROM nodes WHERE nodes.id = best.id)::BIGINT point_count, (SELECT count(*) FROM under WHERE n = 1)::BIGINT n_rows FROM best UNION ALL SELECT false, 12, 1, 1 UNION ALL SELECT false, -1, 0, 0",
        "wire_size": f"WITH {P} SELECT count(*)::BIGINT n_rows, true less FROM p",
        "styled_focus": one + f"SELECT id, CASE WHEN id IN (SELECT id FROM best UNION ALL SELECT id FROM under) THEN '100,100,200,200' ELSE '26,26,64,200' END fill FROM nodes WHERE level = 2 AND {world}",
        "saved_index_view": one + f"SELECT {SHOW} FROM nodes WHERE level = 3 AND {world}",
        "geojson_features": f"""WITH {P} SELECT row_idx, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || round(lng, 2) || ',' || round(lat, 2) || ']}},"properties":{{"row_idx":' || row_idx || '}}}}' feature FROM p""",
        "geoparquet_roundtrip": f"WITH {P}, b AS (SELECT floor(min(lng) * 1e6) / 1e6 west, floor(min(lat) * 1e6) / 1e6 south, ceil(max(lng) * 1e6) / 1e6 east, ceil(max(lat) * 1e6) / 1e6 north FROM p) SELECT row_idx, lng, lat, west, south, east, north FROM p, b",
        "arrow_roundtrip": f"WITH {P} SELECT row_idx, lng, lat, category FROM p",
        "size_estimate": f"WITH {P} SELECT (count(*) * 20 + 1024)::BIGINT bytes FROM p",
        "uniform_points": f"WITH {draws_sql(2)} SELECT a.i // 2 row_idx, round(a.u * 360 - 180, 6) lng, round(b.u * 170 - 85, 6) lat FROM u a JOIN u b ON b.i = a.i + 1 WHERE a.i % 2 = 1",
        "clustered_points": f"WITH {draws_sql(3)}, c(k, x, y, name) AS (VALUES {', '.join(f"({k}, {x}::DOUBLE, {y}::DOUBLE, '{name}')" for k, (x, y, name) in enumerate(CENTRES))}) SELECT a.i // 3 row_idx, round(x + sqrt(-2.0::DOUBLE * ln(b.u)) * cos(d.u * 2 * pi()) * 1.5::DOUBLE, 6) lng, round(greatest(-85.0::DOUBLE, least(85.0::DOUBLE, y + sqrt(-2.0::DOUBLE * ln(b.u)) * sin(d.u * 2 * pi()) * 1.5::DOUBLE)), 6) lat, name FROM u a JOIN u b ON b.i = a.i + 1 JOIN u d ON d.i = a.i + 2 JOIN c ON c.k = floor(a.u * {len(CENTRES)})::INT WHERE a.i % 3 = 1",
        "style_fill": f"WITH {P} SELECT row_idx, CASE WHEN row_idx = 11 THEN '255,140,0,230' WHEN row_idx = 7 OR row_idx % 10 = 3 THEN '100,100,200,200' ELSE '26,26,64,200' END fill FROM p",
        "style_radius": f"WITH {P} SELECT row_idx, round((4.0::DOUBLE + ln(row_idx + 2.0::DOUBLE) / ln(1000001.0::DOUBLE) * 50.0::DOUBLE)::FLOAT::DOUBLE, 4) radius FROM p",
        "style_text_color": f"WITH {P}, t AS (SELECT row_idx, {tone} t FROM p) SELECT row_idx, t || ',' || t || ',' || t || ',230' color FROM t",
        "style_label": f"WITH {P} SELECT row_idx, CASE WHEN row_idx % 4 > 0 THEN (row_idx % 4 + 1)::VARCHAR END AS text FROM p",
        "styled_view": one + f"SELECT id, n point_count, '26,26,64,200' fill, round(least(greatest((4.0::DOUBLE + ln(n + 1.0::DOUBLE) / ln((SELECT count(*) FROM p) + 1.0::DOUBLE) * 50.0::DOUBLE)::FLOAT, 10::FLOAT), 100::FLOAT)::DOUBLE, 3) radius, '255,255,255,255' text_color, CASE WHEN n > 1 THEN n::VARCHAR END AS text, 0 text_angle FROM nodes WHERE level = 2 AND {world}",
        "pick_cluster": one + "SELECT p.row_idx, p.category FROM p JOIN under ON under.id = p.row_idx AND under.n = 1",
        "pick_point": f"WITH {P} SELECT row_idx, category FROM p WHERE row_idx = 12",
        "pick_none": f"WITH {P} SELECT row_idx, category FROM p WHERE false",
    }
