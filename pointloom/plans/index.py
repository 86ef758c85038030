"""The cluster index: build once, then ask for views, children, leaves, styles and picks."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import ids, mercator, style
from pointloom.operators import levels, local
from pointloom.sources.points import points
from pointloom.sources.shared import read_text, storage, write_text

cloudpickle.register_pickle_by_value(local)
cloudpickle.register_pickle_by_value(levels)

#: Up to so many nodes the levels are built in one task; a larger level is built by joins.
LOCAL_NODES = 1_000_000
NODE = "level int, seq bigint, node_id bigint, x double, y double, tx double, ty double, num_points bigint, parent_id bigint, lng double, lat double"
#: Spark's reader passes over names that begin with an underscore.
INDEX_FILE = "_index.json"
VIEW = ["lng", "lat", "point_count", "id", "is_cluster"]


@dataclass(frozen=True)
class Options:
    radius: float = 40
    extent: float = 512
    min_zoom: int = 0
    max_zoom: int = 16
    min_points: int = 2

    def __post_init__(self):
        if not 0 <= self.min_zoom <= self.max_zoom <= 30:
            raise ValueError("zooms must satisfy 0 <= min_zoom <= max_zoom <= 30")


#: Defaults of the styled view.
STYLED = Options(radius=75, min_zoom=2, max_zoom=20)


def wrap(lng: float) -> float:
    return math.fmod(math.fmod(lng + 180, 360) + 360, 360) - 180


class ClusterIndex:
    """``nodes`` holds every level, one row a node; ``num_rows`` counts the input before masking."""

    def __init__(self, nodes: DataFrame, num_rows: int, options: Options):
        self.nodes, self.num_rows, self.options = nodes, num_rows, options

    # building

    @classmethod
    def build(cls, df: DataFrame, geometry="geometry", row_index: str | None = None, mask: Column | None = None, options: Options = Options(), local_nodes: int = LOCAL_NODES, local_open: int = levels.LOCAL_OPEN) -> ClusterIndex:
        spark = df.sparkSession
        num_rows = df.count()
        store = storage(spark)
        base = points(df, geometry, row_index, mask)
        base = base.select("row_idx", "lng", "lat", mercator.fround(mercator.lng_x(F.col("lng"))).alias("x"), mercator.fround(mercator.lat_y(F.col("lat"))).alias("y"))
        # Places are 32-bit numbers here, so they are stored as such.
        base = store(base.select(F.col("row_idx").alias("node_id"), F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), "lng", "lat"))
        n = base.count()
        done: list[DataFrame] = []
        zoom = options.max_zoom
        level = as_nodes(base)
        if n > local_nodes:
            level = as_nodes(in_order(base, n)).select(*levels.COLUMNS)
            sparse = False
            while zoom >= options.min_zoom and n > local_nodes:
                level, finer, same, sparse = levels.coarser(level, n, zoom, options.radius, options.extent, options.min_points, num_rows, store, local_open, sparse)
                for z in range(zoom, max(zoom - same, options.min_zoom) - 1, -1):
                    done.append(finer.select(F.lit(z + 1).alias("level"), *NODE_ORDER))
                zoom, n = z - 1, level.count()
        if n > local_nodes:
            done.append(level.select(F.lit(zoom + 1).alias("level"), *[F.lit(None).cast("long").alias(c) if c == "parent_id" else c for c in NODE_ORDER]))
        else:
            done.append(store(local_levels(level, zoom, options, num_rows)))
        nodes = done[0]
        for more in done[1:]:
            nodes = nodes.unionByName(more)
        return cls(nodes, num_rows, options)

    def save(self, path: str) -> None:
        """Nodes as Parquet, a folder a level, sorted by place so that rectangles skip row groups; options beside them."""
        self.nodes.repartitionByRange("level", "tx").sortWithinPartitions("level", "tx").write.partitionBy("level").parquet(path)
        write_text(self.nodes.sparkSession, f"{path}/{INDEX_FILE}", json.dumps({"num_rows": self.num_rows, "options": asdict(self.options)}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusterIndex:
        known = json.loads(read_text(spark, f"{path}/{INDEX_FILE}"))
        return cls(spark.read.schema(NODE).parquet(path), known["num_rows"], Options(**known["options"]))

    # scalars

    def indexed_point_count(self) -> int:
        return self.nodes.where(F.col("level") == self.options.max_zoom + 1).count()

    def limit_zoom(self, zoom: float) -> int | None:
        """The level a zoom shows; None, a level that is not there, for no number."""
        if math.isnan(zoom):
            return None
        return int(max(self.options.min_zoom, min(zoom, self.options.max_zoom + 1) // 1))

    def origin_zoom(self, cluster_id: int) -> int:
        return int(math.fmod(cluster_id - self.num_rows, 32))

    def origin_id(self, cluster_id: int) -> int:
        return (cluster_id - self.num_rows) >> 5

    def expansion_zoom(self, cluster_id: int) -> int | None:
        """The zoom at which a cluster falls apart, by walking down while there is one child; None where there is no such cluster."""
        zoom = None
        while cluster_id is not None and cluster_id >= self.num_rows and (zoom is None or zoom <= self.options.max_zoom):
            found = self.children(cluster_id).select("id").limit(2).collect()
            if not found:
                break
            zoom = self.origin_zoom(cluster_id)
            cluster_id = found[0]["id"] if len(found) == 1 else None
        return zoom

    def expansion_zooms(self) -> DataFrame:
        """(id, zoom) of every cluster: the level of its children, of which a merged node has at least two."""
        inside = self.nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id"))
        return inside.agg(F.min("level").cast("long").alias("zoom"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "zoom")

    def picked(self, node_id: int | None) -> dict | None:
        """(is_cluster, cluster_id, point_count) of a node; None where there is none."""
        if node_id is None or node_id < 0:
            return None
        found = self.nodes.where(F.col("node_id") == node_id).select("num_points").first()
        return None if found is None else {"is_cluster": found[0] > 1, "cluster_id": node_id, "point_count": found[0]}

    # views

    def view(self, nodes: DataFrame) -> DataFrame:
        many = F.col("num_points") > 1
        return nodes.select(
            F.when(many, mercator.x_lng(F.col("x"))).otherwise(F.col("lng")).alias("lng"),
            F.when(many, mercator.y_lat(F.col("y"))).otherwise(F.col("lat")).alias("lat"),
            F.col("num_points").alias("point_count"),
            F.col("node_id").alias("id"),
            many.alias("is_cluster"),
        )

    def inside(self, bbox) -> Column:
        west, south, east, north = bbox
        min_lat, max_lat = max(-90.0, min(90.0, south)), max(-90.0, min(90.0, north))
        min_lng, max_lng = wrap(west), 180.0 if east == 180 else wrap(east)
        if east - west >= 360:
            min_lng, max_lng = -180.0, 180.0
        rows = F.col("ty").between(mercator.lat_y_of(max_lat), mercator.lat_y_of(min_lat))
        if min_lng > max_lng:
            return rows & ((F.col("tx").between(mercator.lng_x_of(min_lng), 1.0)) | F.col("tx").between(0.0, mercator.lng_x_of(max_lng)))
        return rows & F.col("tx").between(mercator.lng_x_of(min_lng), mercator.lng_x_of(max_lng))

    def clusters(self, bbox, zoom: float) -> DataFrame:
        """Nodes of a zoom inside (west, south, east, north); a box across the antimeridian is both its halves."""
        level = self.limit_zoom(zoom)
        return self.view(self.nodes.where((F.col("level") == level) & self.inside(bbox)) if level is not None else self.nodes.limit(0))

    def world(self, zoom: float) -> DataFrame:
        return self.clusters((-180, -85, 180, 85), zoom)

    # hierarchy

    def children(self, cluster_id: int) -> DataFrame:
        return self.view(self.nodes.where((F.col("level") == self.origin_zoom(cluster_id)) & (F.col("parent_id") == cluster_id)))

    def below(self, cluster_id: int) -> DataFrame:
        """Every node under a cluster: (id, num_points, path), path being the places from the top down.

        Only the levels at which clusters of the last step fell apart are read for the next one, and every step is read as stored.
        """
        links = self.nodes.where("parent_id is not null").select("level", "parent_id", F.col("node_id").alias("id"), "seq", "num_points")
        front = links.where((F.col("level") == self.origin_zoom(cluster_id)) & (F.col("parent_id") == cluster_id)).select("id", "num_points", F.array("seq").alias("path"))
        out, store = [], storage(self.nodes.sparkSession)
        for _ in range(self.options.max_zoom + 1 - self.options.min_zoom):
            front = store(front)
            out.append(front)
            inner = front.where("num_points > 1").select(F.col("id").alias("parent_id"), "path")
            parts = [r[0] for r in inner.select(ids.origin_zoom(F.col("parent_id"), self.num_rows)).distinct().collect()]
            if not parts:
                break
            front = links.where(F.col("level").isin(parts)).join(inner, "parent_id").select("id", "num_points", F.array_append("path", F.col("seq")).alias("path"))
        return reduce(DataFrame.unionByName, out)

    def descendants(self, cluster_id: int) -> DataFrame:
        return self.below(cluster_id).select("id")

    def leaves(self, cluster_id: int, limit: int | None = None, offset: int = 0) -> DataFrame:
        """(row_idx) of the rows in a cluster, depth first; limit 0 is none."""
        rows = self.below(cluster_id).where("num_points = 1").orderBy("path").select(F.col("id").alias("row_idx"))
        rows = rows.offset(offset) if offset > 0 else rows
        return rows if limit is None else rows.limit(max(0, limit))

    # presentation

    def styled(self, zoom: float, bbox=(-180, -85, 180, 85), primary=(26, 26, 64, 200), secondary=(100, 100, 200, 200), selected=(255, 140, 0, 230), focused_id=None, selected_id=None, opacity=255, threshold=0.5, pixels=(10, 100), globe=False) -> DataFrame:
        """A view with fill, radius, text colour, label and text angle."""
        view = self.clusters(bbox, zoom)
        in_focus = None
        if focused_id is not None:
            focus = self.descendants(focused_id).select(F.col("id").alias("_f")).distinct()
            view = view.join(focus, view["id"] == focus["_f"], "left")
            in_focus = F.col("_f").isNotNull()
        fill = style.fill_color(F.col("id"), primary, secondary, selected, focused_id, selected_id, in_focus)
        view = view.withColumn("fill_color", fill).withColumn("radius", style.radius(F.col("point_count"), self.indexed_point_count(), *pixels))
        view = view.withColumn("text_color", style.text_color(F.col("fill_color"), opacity, threshold))
        return view.select(*VIEW, "fill_color", "radius", "text_color", style.label(F.col("is_cluster"), F.col("point_count")).alias("text"), F.lit(style.text_angle(zoom, globe)).alias("text_angle"))

    def pick(self, node_id: int | None, source: DataFrame, row_index: str) -> DataFrame:
        """Rows of ``source`` under a node: a cluster's leaves, a point's own row, none for None."""
        if node_id is None or node_id < 0:
            return source.limit(0)
        if node_id < self.num_rows:
            return source.where(F.col(row_index) == node_id)
        return source.join(self.leaves(node_id).withColumnRenamed("row_idx", row_index), row_index, "left_semi")


def as_nodes(base: DataFrame) -> DataFrame:
    """Rows of the input as nodes of the finest level."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return base.select("*", x.alias("tx"), y.alias("ty"), F.lit(1).cast("long").alias("num_points")).withColumns({"x": x, "y": y})


def in_order(base: DataFrame, n: int) -> DataFrame:
    """Rows with ``seq``, their rank by node_id: that itself where it is found to be each of 0 to n - 1 once, else by sorting."""
    ends = base.agg(F.min("node_id"), F.max("node_id")).first()
    if tuple(ends) == (0, n - 1):
        seen = base.groupBy(F.bitmap_bucket_number("node_id").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("node_id")).alias("b"))
        if seen.agg(F.sum(F.bitmap_count("b"))).first()[0] == n:
            return base.withColumn("seq", F.col("node_id"))
    return levels.dense(base, ["node_id"])


NODE_ORDER = ["seq", "node_id", "x", "y", "tx", "ty", "num_points", "parent_id", "lng", "lat"]


def local_levels(level: DataFrame, zoom: int, options: Options, num_rows: int) -> DataFrame:
    """All levels from ``zoom`` + 1 down, in one task; the caller has checked that the level is small."""

    least, radius, extent, min_points, coarser = options.min_zoom, options.radius, options.extent, options.min_points, local.coarser

    def run(batches):
        names = ["node_id", "x", "y", "tx", "ty", "num_points", "lng", "lat"]
        parts = [{k: np.asarray(b.column(k)) for k in [*names, *(["seq"] if "seq" in b.schema.names else [])]} for b in batches if b.num_rows]
        if not parts:
            return
        now = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        order = np.argsort(now.get("seq", now["node_id"]), kind="stable")
        now = {k: v[order] for k, v in now.items()}
        now["seq"] = np.arange(len(order))
        for z in range(zoom, least - 2, -1):
            if z >= least:
                coarse, parent = coarser(now, z, radius, extent, min_points, num_rows)
            else:
                coarse, parent = None, np.full(len(now["x"]), -1, np.int64)
            table = {"level": np.full(len(parent), z + 1, np.int32), **{k: now[k] for k in ("seq", "node_id", "x", "y", "tx", "ty", "num_points")}}
            arrays = [pa.array(v) for v in table.values()] + [pa.array(parent, mask=parent < 0), pa.array(now["lng"]), pa.array(now["lat"])]
            yield pa.RecordBatch.from_arrays(arrays, [*table, "parent_id", "lng", "lat"])
            now = coarse

    return level.coalesce(1).mapInArrow(run, NODE)
