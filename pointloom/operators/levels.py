"""One level of the hierarchy from the next finer one, as DataFrame operations.

The greedy pass over nodes in order is relational: origins are the lexicographically first maximal
independent set of the radius graph, every other node joins its earliest origin, groups are merged.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import ids
from pointloom.functions.mercator import fround
from pointloom.operators import local

COLUMNS = ["seq", "node_id", "x", "y", "tx", "ty", "num_points", "lng", "lat"]


def neighbours(nodes: DataFrame, r: float) -> DataFrame:
    """Edges (src, dst), src before dst, where dst's rounded place is within r of src's exact one.

    An equi-join on grid cells a little wider than r; src probes the nine cells around it.
    """
    if r <= 0:
        a, b = nodes.select(F.col("seq").alias("src"), "x", "y"), nodes.select(F.col("seq").alias("dst"), "tx", "ty")
        return a.join(b, (a["x"] == b["tx"]) & (a["y"] == b["ty"]) & (a["src"] < b["dst"])).select("src", "dst")
    side = r * (1 + 1e-6)
    offsets = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    probe = nodes.select(F.col("seq").alias("src"), "x", "y", F.explode(offsets).alias("i"))
    probe = probe.select("src", "x", "y", (F.floor(F.col("x") / side) + F.col("i")).alias("cx"), F.explode(offsets).alias("j"))
    probe = probe.select("src", "x", "y", "cx", (F.floor(F.col("y") / side) + F.col("j")).alias("cy"))
    held = nodes.select(F.col("seq").alias("dst"), "tx", "ty", F.floor(F.col("tx") / side).alias("cx"), F.floor(F.col("ty") / side).alias("cy"))
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    return probe.join(held, ["cx", "cy"]).where((F.col("src") < F.col("dst")) & (dx * dx + dy * dy <= r * r)).select("src", "dst")


#: Once no more nodes than this are open (counted after every round), they are decided in order inside one task.
LOCAL_OPEN = 1_000_000


def owners(nodes: DataFrame, r: float, store, local_open: int = LOCAL_OPEN) -> DataFrame:
    """(seq, owner) of nodes (seq, x, y, tx, ty), by rounds in which only the first open node of every grid cell is looked at.

    Such a candidate is an origin if no open node before it reaches it; what an origin reaches is covered. A node meets
    at most nine candidates and the origins near it, never all nodes near it, so dense cells cost no more than their nodes.
    """
    side = max(r, 1e-12) * (1 + 1e-6)

    def cell(c: str):
        return F.floor(F.col(c) / side).cast("long")

    open_ = store(nodes.select("seq", "x", "y", "tx", "ty", cell("x").alias("sx"), cell("y").alias("sy"), cell("tx").alias("dx"), cell("ty").alias("dy")))
    every, decided = open_, None
    while True:
        first = open_.groupBy("dx", "dy").agg(F.min(F.struct("seq", "x", "y", "tx", "ty", "sx", "sy")).alias("c"))
        first = store(first.select("c.*", "dx", "dy"))
        asked = first.select(F.col("seq").alias("c"), F.col("tx").alias("cx"), F.col("ty").alias("cy"), *around("dx", "dy"))
        before = open_.select(F.col("seq").alias("u"), "x", "y", F.col("sx").alias("kx"), F.col("sy").alias("ky"))
        blocked = spread(asked).join(before, ["kx", "ky"]).where((F.col("u") < F.col("c")) & close("x", "y", "cx", "cy", r)).select(F.col("c").alias("seq")).distinct()
        origins = store(first.join(blocked, "seq", "left_anti").select("seq", "x", "y", "sx", "sy"))
        decided = origins if decided is None else decided.unionByName(origins)
        gone = reached(open_, origins, r).select("seq").distinct().unionByName(origins.select("seq"))
        open_ = store(open_.join(gone, "seq", "left_anti"))
        left = open_.count()
        if not left:
            break
        if left <= local_open:
            decided = decided.unionByName(store(in_order(open_, r)))
            break
    first = reached(every, decided, r).groupBy("seq").agg(F.min("o").alias("o"))
    return every.select("seq").join(first, "seq", "left").select("seq", F.coalesce("o", "seq").alias("owner"))


def around(x: str, y: str) -> list:
    near = lambda c: F.array(*[F.col(c) + F.lit(k).cast("long") for k in (-1, 0, 1)])
    return [near(x).alias("kxs"), near(y).alias("kys")]


def spread(rows: DataFrame) -> DataFrame:
    """A row for each of the nine cells around."""
    rows = rows.withColumn("kx", F.explode("kxs")).withColumn("ky", F.explode("kys"))
    return rows.drop("kxs", "kys")


def close(x1: str, y1: str, x2: str, y2: str, r: float):
    dx, dy = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    return dx * dx + dy * dy <= r * r


def reached(nodes: DataFrame, origins: DataFrame, r: float) -> DataFrame:
    """(seq, o): nodes after an origin o whose rounded place is within r of its exact one."""
    probe = spread(origins.select(F.col("seq").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), *around("sx", "sy")))
    held = nodes.select("seq", "tx", "ty", F.col("dx").alias("kx"), F.col("dy").alias("ky"))
    return probe.join(held, ["kx", "ky"]).where((F.col("o") < F.col("seq")) & close("ox", "oy", "tx", "ty", r)).select("seq", "o")


def in_order(open_: DataFrame, r: float) -> DataFrame:
    """The origins among open nodes, whose number the caller has checked, in one task."""
    origins = local.origins

    def run(batches):
        parts = [{k: np.asarray(b.column(k)) for k in ("seq", "x", "y", "tx", "ty", "sx", "sy")} for b in batches if b.num_rows]
        if not parts:
            return
        now = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        order = np.argsort(now["seq"], kind="stable")
        now = {k: v[order] for k, v in now.items()}
        kept = origins(now["x"], now["y"], now["tx"], now["ty"], r)
        yield pa.RecordBatch.from_arrays([pa.array(now[k][kept]) for k in ("seq", "x", "y", "sx", "sy")], ["seq", "x", "y", "sx", "sy"])

    return open_.coalesce(1).mapInArrow(run, "seq bigint, x double, y double, sx bigint, sy bigint")


#: First open nodes that are decided at once in one task, before a scan finds all nodes near their origins.
FIRST = 250_000
#: Ranges of ``seq`` whose open nodes are counted to find the first ones.
RANGES = 4096
#: A table of merged nodes is sent to every task up to so many.
MOST_SENT = 1_000_000
KEPT = ["seq", "node_id", "x", "y", "num_points", "lng", "lat"]
OWNED = "seq bigint, node_id bigint, x double, y double, num_points bigint, lng double, lat double, owner bigint"


def gathered(batches, rows: int = 200_000):
    """Batches joined to larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def placed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("tx", fround(F.col("x"))).withColumn("ty", fround(F.col("y")))


def owned(nodes: DataFrame, origins: tuple, r: float) -> DataFrame:
    """Nodes with ``owner``, the first of these origins (seq, x, y, in order) that reaches them; null for none."""
    known, grid_of, join = nodes.sparkSession.sparkContext.broadcast(origins), local.Grid, gathered

    def run(batches):
        at, x, y = known.value
        grid, none = grid_of(x, y, r), len(at)
        for batch in join(batches):
            seq = np.asarray(batch.column("seq"))
            tx, ty = (np.asarray(batch.column(k)).astype(np.float32).astype(np.float64) for k in ("x", "y"))
            best = np.full(len(seq), none, np.int64)
            for who, origin in grid.near(tx, ty):
                after = at[origin] < seq[who]
                np.minimum.at(best, who[after], origin[after])
            own = np.minimum(np.searchsorted(at, seq), none - 1)
            best = np.where(at[own] == seq, own, best)
            found = pa.array(at[np.minimum(best, none - 1)], mask=best == none)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "owner"])

    return nodes.select(*KEPT).mapInArrow(run, OWNED)


def by_first(nodes: DataFrame, n: int, r: float, store, local_open: int = LOCAL_OPEN) -> tuple[list[DataFrame], DataFrame | None, int, int]:
    """(tables of nodes with their owner, nodes still open or None, their number, number of origins), by rounds over the first open nodes.

    These are decided in order in one task. A scan without a shuffle then gives every node near their origins its owner,
    and for good: the origins of later rounds come after all of these. Where most of the first nodes are origins, or
    a round leaves more than half open, the rest is left to the caller; no open node is near an origin found here.
    """
    done, open_, left, limit, found = [], nodes, n, min(FIRST, local_open), 0
    first = min(limit, n)
    most = first
    while left:
        if not most:
            return done, open_, left, found
        origins = in_order(placed(open_.where(F.col("seq") < limit)).withColumn("sx", F.lit(0).cast("long")).withColumn("sy", F.lit(0).cast("long")), r)
        origins = origins.select("seq", "x", "y").toArrow().sort_by("seq")
        at = tuple(np.asarray(origins.column(k).to_numpy()) for k in ("seq", "x", "y"))
        if first < left and 2 * len(at[0]) > first:
            return done, open_, left, found
        found += len(at[0])
        rows = store(owned(open_, at, r))
        done.append(rows.where("owner is not null"))
        open_ = rows.where("owner is null").drop("owner")
        counts = sorted(open_.groupBy(F.floor(F.col("seq") * F.lit(RANGES) / F.lit(n)).cast("long").alias("k")).count().collect())
        before, left, first = left, sum(c for _, c in counts), 0
        for k, c in counts:
            if first and first + c > most:
                break
            first, limit = first + c, -(-(k + 1) * n // RANGES)
        if 2 * left > before:
            return done, open_, left, found
    return done, None, 0, found


#: Nodes of a tile: so many are aimed at, and no more than so many are put into one task.
TILE, MOST_TILE = 50_000, 500_000
#: Cells a side by which nodes are counted; tiles consist of whole ones.
CELLS = 512
#: More than places move when they are rounded to 32 bits.
SLACK = 1e-6
#: Where halos are cheap, it is seen as well whether no two nodes are so many times the radius apart or less.
WIDE = 3
TILED = OWNED + ", kind int, alone boolean, near boolean, wide boolean"


def tiles_a_side(nodes: DataFrame, n: int, r: float, most: int) -> int | None:
    """Tiles of equal side, at least 16 radii, none with more than ``most`` nodes; None where there are no such."""
    cell = lambda c: F.least(F.greatest(F.floor(F.col(c) * F.lit(float(CELLS))), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    found = placed(nodes).groupBy(cell("tx").alias("i"), cell("ty").alias("j")).count().toArrow()
    counts = np.zeros((CELLS, CELLS), np.int64)
    counts[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("count").to_numpy()
    k, best = 1, None
    while k <= CELLS and 16 * (r + SLACK) * k <= 1:
        if counts.reshape(k, CELLS // k, k, CELLS // k).sum((1, 3)).max() <= most:
            best = k
            if n <= TILE * k * k:
                break
        k *= 2
    return best


def by_tiles(nodes: DataFrame, n: int, r: float, store, local_open: int = LOCAL_OPEN) -> tuple[DataFrame, DataFrame, int, int] | None:
    """(nodes with their owner, origins no other node belongs to, number of the former, for how many doublings of the radius
    all nodes stay alone); None where the nodes are too dense.

    Every tile is decided in one task that also sees the nodes up to three radii around. What depends on nodes further away
    is left open there; these nodes are few, and are decided in order together with the origins beside the tiles' borders.
    """
    k = tiles_a_side(nodes, n, r, min(MOST_TILE, local_open))
    if k is None:
        return None
    widely = 64 * (r + SLACK) * k <= 1
    margin, reach = (2**WIDE + 1 if widely else 3) * (r + SLACK), 2**WIDE * r
    certain, distinct, any_near = local.certain, local.distinct_places, local.any_near
    at = lambda c, by: F.least(F.greatest(F.floor((F.col(c) + F.lit(by)) * F.lit(float(k))), F.lit(0)), F.lit(k - 1)).cast("long")
    tiles = F.array_distinct(F.array(*[at("tx", i) * F.lit(k).cast("long") + at("ty", j) for i in (-margin, margin) for j in (-margin, margin)]))

    def outside(v, tile, by):
        """Whether places lie further than ``by`` outside a tile (inside for a negative one); the outermost tiles have no end."""
        return ((v < tile / k - by) & (tile > 0)) | ((v > (tile + 1) / k + by) & (tile < k - 1))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        tile, seq = (table.column(c).to_numpy() for c in ("tile", "seq"))
        order = np.lexsort((seq, tile))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(tile[order]) != 0)))
        for rows in np.split(order, starts[1:]):
            i, j = divmod(int(tile[rows[0]]), k)
            x, y = (table.column(c).to_numpy()[rows] for c in ("x", "y"))
            tx, ty = (v.astype(np.float32).astype(np.float64) for v in (x, y))
            first, place = distinct({"x": x, "y": y})
            inner = margin - r - SLACK
            edge = outside(tx, i, inner) | outside(ty, j, inner)
            state, best, unsure, alone = certain(x[first], y[first], tx[first], ty[first], r, edge[first])
            alone &= np.bincount(place, minlength=len(first)) == 1
            ends = np.append(first, 0)[best]
            core = np.flatnonzero((np.clip(np.floor(tx * k), 0, k - 1) == i) & (np.clip(np.floor(ty * k), 0, k - 1) == j))
            mine = place[core]
            own, found = seq[rows][ends[mine]], best[mine] < len(first)
            kind = np.where(state[mine] == 0, 1, np.where(unsure[mine], 2, 0)).astype(np.int32)
            wide = np.full(len(core), not widely or any_near(x, y, tx, ty, reach, core) if alone.all() else True)
            near = (outside(tx[core], i, -(r + SLACK)) | outside(ty[core], j, -(r + SLACK))) & (state[mine] == 1) & (first[mine] == core)
            kept = table.select(names).take(pa.array(rows[core]))
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(own, mask=~found), pa.array(kind), pa.array(alone[mine]), pa.array(near), pa.array(wide)], [*names, "owner", "kind", "alone", "near", "wide"])

    names = list(KEPT)
    rows = store(placed(nodes).select(F.explode(tiles).alias("tile"), *KEPT).repartition(max(n // 200_000, 8), "tile").mapInArrow(run, TILED))
    unsure, near, rest, wide = rows.agg(F.count_if(F.col("kind") > 0), F.count_if("near"), F.count_if(~F.col("alone")), F.count_if("wide")).first()
    if unsure + near > local_open and unsure:
        return None
    alone = rows.where("alone").select(*KEPT, "owner")
    found = rows.where("kind = 0 and not alone").select(*KEPT, "owner")
    if unsure:
        few = rows.where("kind > 0 or near").select("seq", "x", "y", F.coalesce("owner", F.lit(-1)).alias("owner"), "kind").toArrow().sort_by("seq")
        seq, own = settled({c: few.column(c).to_numpy() for c in few.column_names}, r)
        ends = nodes.sparkSession.createDataFrame(pa.table({"seq": seq, "owner": own}))
        found = found.unionByName(rows.where("kind > 0").select(*KEPT).join(F.broadcast(ends), "seq"))
    return found, alone, rest, 0 if wide else WIDE


def settled(few: dict, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(seq, owner) of the nodes that tiles left open, given in order with the origins they may depend on."""
    seq, kind = few["seq"], few["kind"]
    tx, ty = (few[c].astype(np.float32).astype(np.float64) for c in ("x", "y"))

    def first_of(origins):
        """Position of the first of these origins before a node that reaches it; the number of nodes for none."""
        out = np.full(len(seq), len(seq), np.int64)
        for who, o in local.Grid(few["x"][origins], few["y"][origins], r).near(tx, ty):
            before = origins[o] < who
            np.minimum.at(out, who[before], origins[o[before]])
        return out

    origins = np.flatnonzero(kind == 0)
    left = np.flatnonzero((kind == 1) & (first_of(origins) == len(seq)))
    # Nodes of one place go with the first of them.
    first, place = local.distinct_places({c: few[c][left] for c in ("x", "y")}) if len(left) else (left, left)
    lead = left[first]
    new = lead[local.origins(few["x"][lead], few["y"][lead], tx[lead], ty[lead], r)] if len(lead) else lead
    origins = np.sort(np.concatenate((origins, new)))
    at = first_of(origins)
    at[new] = new
    if len(left):
        at[left] = at[lead[place]]
    known = np.append(seq, np.iinfo(np.int64).max)[at]
    own = np.where(few["owner"] >= 0, np.minimum(known, few["owner"]), known)
    return seq[kind > 0], own[kind > 0]


def by_joins(nodes: DataFrame, r: float, store, local_open: int = LOCAL_OPEN) -> DataFrame:
    """Nodes with their owner, by rounds over cells."""
    # Nodes at one place have the same neighbours: the first stands for all.
    place = store(nodes.groupBy("x", "y").agg(F.min("seq").alias("seq")))
    place = place.join(owners(placed(place), r, store, local_open), "seq")
    return store(nodes.select(*KEPT).join(place.select("x", "y", "owner"), ["x", "y"]))


def weighed(c: str) -> list:
    """Sums of a coordinate by weight, in two whole numbers of 2^-30 and 2^-60: exact in any order."""
    scaled = F.col(c) * F.lit(2.0**30)
    high = F.floor(scaled).cast("long")
    low = F.floor((scaled - high) * F.lit(2.0**30)).cast("long")
    return [F.sum(high * F.col("num_points")).alias(f"{c}1"), F.sum(low * F.col("num_points")).alias(f"{c}2")]


def coarser(nodes: DataFrame, n: int, zoom: int, radius: float, extent: float, min_points: int, num_rows: int, store, local_open: int = LOCAL_OPEN, sparse: bool = False) -> tuple[DataFrame, DataFrame, int, bool]:
    """(nodes of ``zoom``, the ``n`` finer nodes with their parent_id, for how many zooms more nothing merges, whether few merged).

    ``store`` materialises a DataFrame; rounds over the first nodes are not tried on ``sparse`` ones.

    Sums are of whole numbers, so they are exact and do not depend on the partitioning, and partial: a place or cluster
    of any number of nodes is one row after them.
    """
    r = radius / (extent * 2.0**zoom)
    rows, open_, left, found = ([], nodes, n, 0) if sparse else by_first(nodes, n, r, store, local_open)
    alone, few = None, False
    if open_ is not None:
        tiled = by_tiles(open_, left, r, store, local_open)
        if tiled:
            more, alone, size, again = tiled
            few = 4 * size <= n and not rows
            if not rows and not size:  # nothing merges: the finer level under another zoom
                return nodes, nodes.withColumn("parent_id", F.lit(None).cast("long")), again, few
        else:
            more = by_joins(open_, r, store, local_open)
        rows.append(more)
    rows = reduce(DataFrame.unionByName, rows)
    groups = rows.groupBy("owner").agg(F.count(F.lit(1)).alias("m"), F.sum("num_points").alias("total"), *weighed("x"), *weighed("y"))
    groups = groups.where((F.col("m") > 1) & (F.col("total") >= min_points))
    none = F.lit(float("nan"))
    mean = lambda c: ((F.col(f"{c}1") * F.lit(2.0**-30) + F.col(f"{c}2") * F.lit(2.0**-60)) / F.col("total")).alias(c)
    merged = store(groups.select("owner", F.col("owner").alias("ms"), ids.encode(F.col("owner"), zoom, num_rows).alias("node_id"), mean("x"), mean("y"), F.col("total").alias("num_points"), none.alias("lng"), none.alias("lat")))
    parents = merged.select("owner", F.col("node_id").alias("parent_id"))
    rows = rows.join(F.broadcast(parents) if open_ is None and found <= MOST_SENT else parents, "owner", "left")
    rows = rows if open_ is None else store(rows)
    if alone is not None:
        rows = rows.unionByName(alone.withColumn("parent_id", F.lit(None).cast("long")))
    single = rows.where("parent_id is null").select("owner", F.col("seq").alias("ms"), "node_id", "x", "y", "num_points", "lng", "lat")
    level = placed(dense(merged.unionByName(single), ["owner", "ms"])).select(*COLUMNS)
    return level, placed(rows), 0, few


def dense(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``seq``, the 0-based rank in this order: sorted by range, then an offset a partition."""
    from pointloom.sources.points import with_row_index

    return with_row_index(df.repartitionByRange(*order).sortWithinPartitions(*order), name="seq")
