"""Metric grid and spatial joins rewritten as tile-key equi-joins.

Nothing here pairs whole tables: candidates meet on tile keys, the tile pyramid adapts to
the local density, and every side that is broadcast has a bound that follows from its
construction (a pyramid level k holds at most 16^k tiles).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terracast import config as C
from terracast.functions.geodesy import ZONE_43N, MetricZone, project_points, unproject_points
from terracast.functions.numbers import half_even, settle
from terracast.functions.single import attach_row
from terracast.functions.shapes import area_centroid, box_of, inside, on_edge, path_crossings, segment_distance
from terracast.session import reliable_cut, spread

FAN = 4                 # children per axis and level
BROADCAST_LEVELS = 3    # level 3 holds at most 4,096 tiles
ITEMS_PER_TILE = 16
MAX_DEPTH = 12
EDGES_PER_TILE = 16
SPLITS = 6              # a shape's tiles are cut into 16 this often at most
CUT_LEVELS = 2          # levels of the cover halve a tile's side, so a cut into 16 goes down two
COVER_DEPTH = 24
KEY_SCALE = 10_000_000  # of coordinate keys: 1e-7 degrees
SPOTS_PER_TASK = 200    # a spot meets many candidates where a layer is dense
SPOT_TASKS = 1024       # tasks of one search at most
WALK_LEVELS = 4         # of the pyramid in one stage: each keeps a sort of its own in the task
WALK_ROWS_PER_TASK = 1000
TILES_PER_TASK = 500    # of a quad cover: a tile meets many spots where a layer is dense


def ordered_index(df: DataFrame, major: str, minor: str, name: str) -> DataFrame:
    """Dense 1-based index in (major, minor) order without one window over all rows.

    Ranks are taken inside each major value; the offsets are prefix sums over one row
    per major value.
    """
    inner = df.withColumn("_rn", F.row_number().over(W.partitionBy(major).orderBy(minor)))
    sizes = df.groupBy(major).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.orderBy(major).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(major, ahead.alias("_before"))
    return inner.join(offsets, major).withColumn(name, (F.col("_before") + F.col("_rn")).cast("long")).drop("_rn", "_before")


def point_registry(forecasts: DataFrame, prefix: str = "FC_GRID_") -> DataFrame:
    """Distinct forecast points with ids in (latitude, longitude) order."""
    pts = forecasts.groupBy(*coordinate_key()).agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude")).drop("_lat_key", "_lon_key")
    return ordered_index(pts, "latitude", "longitude", "point_idx").withColumn(
        "forecast_parent_id", F.format_string(prefix + "%02d", "point_idx")
    )


def coordinate_key(lat="latitude", lon="longitude") -> list[Column]:
    """Scaled integer keys for joins on coordinates; doubles are never joined raw. Points less than a centimetre apart are one."""
    return [F.round(F.col(lat) * KEY_SCALE).cast("long").alias("_lat_key"), F.round(F.col(lon) * KEY_SCALE).cast("long").alias("_lon_key")]


def attach_parent(forecasts: DataFrame, registry: DataFrame, how: str = "inner") -> DataFrame:
    """Forecast rows with the id of their point."""
    right = registry.select(*coordinate_key(), "forecast_parent_id")
    return forecasts.select("*", *coordinate_key()).join(right, ["_lat_key", "_lon_key"], how).drop("_lat_key", "_lon_key")


# ---------------------------------------------------------------- grid
def metric_grid(extent: DataFrame, cell_m: float = C.CELL_M, pad: float = C.BBOX_PAD_DEG, prefix: str = "GRID_", zone: MetricZone = ZONE_43N) -> DataFrame:
    """Square cells over a one-row extent (min_lat, max_lat, min_lon, max_lon).

    Rows of cells are spread over the cluster before they are opened into cells, so no
    task holds more than its rows.
    """
    corner = F.explode(F.array(*[
        F.struct(F.col(lo).alias("lon"), F.col(la).alias("lat")) for lo in ("min_lon", "max_lon") for la in ("min_lat", "max_lat")
    ]))
    box = ["min_lat", "max_lat", "min_lon", "max_lon"]
    corners = project_points(extent.select(*box, corner.alias("k")).select(*box, "k.lon", "k.lat"), "lon", "lat", zone=zone)
    down, up = (lambda c: F.floor(c / cell_m).cast("long")), (lambda c: F.ceil(c / cell_m).cast("long"))
    frame = corners.groupBy(*box).agg(
        down(F.min("x")).alias("ix0"), up(F.max("x")).alias("ix1"), down(F.min("y")).alias("iy0"), up(F.max("y")).alias("iy1")
    )
    rows = frame.select(*box, "ix0", "ix1", F.explode(F.sequence("iy0", F.col("iy1") - 1)).alias("iy")).repartition("iy")
    cells = rows.select(*box, "iy", F.explode(F.sequence("ix0", F.col("ix1") - 1)).alias("ix"))
    half = cell_m / 2.0
    cells = cells.withColumns({"centroid_x": F.col("ix") * cell_m + half, "centroid_y": F.col("iy") * cell_m + half})
    cells = unproject_points(cells, "centroid_x", "centroid_y", zone=zone)
    cells = cells.filter(
        F.col("latitude").between(F.col("min_lat") - pad, F.col("max_lat") + pad)
        & F.col("longitude").between(F.col("min_lon") - pad, F.col("max_lon") + pad)
    )
    cells = ordered_index(cells.select("iy", "ix", "centroid_x", "centroid_y", "latitude", "longitude"), "iy", "ix", "cell_idx")
    return cells.select(
        F.format_string(prefix + "%05d", "cell_idx").alias("grid_id"), "cell_idx",
        half_even("centroid_x", 2).alias("centroid_x"), half_even("centroid_y", 2).alias("centroid_y"),
        settle("latitude", 6).alias("latitude"), settle("longitude", 6).alias("longitude"),
        (F.col("centroid_x") - half).alias("min_x"), (F.col("centroid_y") - half).alias("min_y"),
        (F.col("centroid_x") + half).alias("max_x"), (F.col("centroid_y") + half).alias("max_y"),
    )


def cell_ring() -> Column:
    """Closed five-point ring of a cell box."""
    c = F.col
    return F.array(*[F.array(c(x), c(y)) for x, y in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y"))])


# ---------------------------------------------------------------- nearest
def _tile(v: Column, origin: float, size: float) -> Column:
    return F.floor((v - F.lit(origin)) / F.lit(size)).cast("long")


def _up(c: str, name: str) -> Column:
    return F.floor(F.col(c) / FAN).cast("long").alias(name)


def _tile_layout(items: DataFrame) -> tuple[float, float, float, int] | None:
    """Origin, root size and depth of the pyramid: the depth at which no tile is crowded.

    Two small aggregates come back to the driver: the extent and one maximum per level.
    """
    e = items.agg(F.min("_x1"), F.min("_y1"), F.max("_x2"), F.max("_y2")).first()
    if e[0] is None:
        return None
    x0, y0 = e[0], e[1]
    root = max(e[2] - x0, e[3] - y0, 1e-9) * 1.0001
    fine = root / FAN**MAX_DEPTH
    tiles = items.select(_tile(F.col("_mx"), x0, fine).alias("tx"), _tile(F.col("_my"), y0, fine).alias("ty"))
    tiles = tiles.groupBy("tx", "ty").agg(F.count("*").alias("n"))
    per_level = tiles.select(F.explode(F.sequence(F.lit(1), F.lit(MAX_DEPTH))).alias("level"), "tx", "ty", "n")
    shrink = F.pow(F.lit(float(FAN)), F.lit(MAX_DEPTH) - F.col("level"))
    per_level = per_level.groupBy("level", F.floor(F.col("tx") / shrink).alias("tx"), F.floor(F.col("ty") / shrink).alias("ty")).agg(F.sum("n").alias("n"))
    worst = {r["level"]: r["n"] for r in per_level.groupBy("level").agg(F.max("n").alias("n")).collect()}
    depth = next((k for k in range(1, MAX_DEPTH + 1) if worst[k] <= ITEMS_PER_TILE), MAX_DEPTH)
    return x0, y0, root, depth


def _same(y1: Column, y2: Column) -> tuple[Column, Column]:
    """Horizontal scale of the plane."""
    return F.lit(1.0), F.lit(1.0)


def _gap2(q: tuple, n: tuple, x_scale=_same) -> Column:
    """Squared smallest distance between two boxes."""
    dx = F.greatest(F.lit(0.0), n[0] - q[2], q[0] - n[2]) * x_scale(q[1], q[3])[0]
    dy = F.greatest(F.lit(0.0), n[1] - q[3], q[1] - n[3])
    return dx * dx + dy * dy


def _reach2(q: tuple, n: tuple, x_scale=_same) -> Column:
    """Squared largest distance between two boxes."""
    dx = F.greatest(F.abs(n[2] - q[0]), F.abs(q[2] - n[0])) * x_scale(q[1], q[3])[1]
    dy = F.greatest(F.abs(n[3] - q[1]), F.abs(q[3] - n[1]))
    return dx * dx + dy * dy


def _box(prefix: str) -> tuple:
    return tuple(F.col(f"{prefix}{s}") for s in ("x1", "y1", "x2", "y2"))


def nearest_join(
    queries: DataFrame, items: DataFrame, qx: str, qy: str, item_box: tuple[str, str, str, str],
    distance: Column, order: list[str], payload: list[str], out: str = "distance", x_scale=_same,
) -> DataFrame:
    """Every query row with the payload of its nearest item; ties go to the lowest `order`.

    items carry a bounding box; `distance` is written over the query's and the item's
    columns. Exact for any layout: query points are grouped by tile, each tile walks down a
    pyramid of item tiles and keeps those whose smallest distance does not exceed the
    smallest guaranteed one, and only the survivors are compared point by point. The
    nearest item is found once per distinct query coordinate. Where x counts for less than y, x_scale gives the least
    and greatest share for a range of query y; `distance` may carry a constant factor.
    """
    item_cols = sorted(set(order) | set(payload) | set(item_box))
    items = items.select(*item_cols, *[F.col(c).alias(n) for c, n in zip(item_box, ("_x1", "_y1", "_x2", "_y2"))])
    items = items.withColumns({"_mx": (F.col("_x1") + F.col("_x2")) / 2.0, "_my": (F.col("_y1") + F.col("_y2")) / 2.0})
    # of points on one spot only the first can win, so a crowded spot cannot crowd a tile
    if item_box[0] == item_box[2]:
        first = F.min(F.struct(*order, *[c for c in item_cols if c not in order])).alias("k")
        items = items.groupBy("_x1", "_y1", "_x2", "_y2", "_mx", "_my").agg(first).select("k.*", "_x1", "_y1", "_x2", "_y2", "_mx", "_my")
    layout = _tile_layout(items)
    if layout is None:
        empty = {c: F.lit(None).cast(items.schema[c].dataType) for c in payload}
        return queries.withColumns({**empty, out: F.lit(None).cast("double")})
    x0, y0, root, depth = layout
    fine = root / FAN**depth

    items = items.withColumns({"_tx": _tile(F.col("_mx"), x0, fine), "_ty": _tile(F.col("_my"), y0, fine)})
    box_aggs = [F.min("_x1").alias("_x1"), F.min("_y1").alias("_y1"), F.max("_x2").alias("_x2"), F.max("_y2").alias("_y2")]
    levels = {depth: items.groupBy("_tx", "_ty").agg(*box_aggs)}
    for k in range(depth - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(_up("_tx", "_tx"), _up("_ty", "_ty")).agg(*box_aggs)

    spots = queries.select(qx, qy).filter(F.col(qx).isNotNull() & F.col(qy).isNotNull()).distinct()
    spots = spots.withColumns({"_qx": _tile(F.col(qx), x0, fine), "_qy": _tile(F.col(qy), y0, fine)})
    # dealt by tile: the candidates of a tile are made, bounded and compared in its task
    spots = spread(spots, SPOTS_PER_TASK, ("_qx", "_qy"), SPOT_TASKS)
    walk = spots.groupBy("_qx", "_qy").agg(
        F.min(qx).alias("_qx1"), F.min(qy).alias("_qy1"), F.max(qx).alias("_qx2"), F.max(qy).alias("_qy2")
    )
    # the top level has at most 16 tiles: every walk starts from all of them, held in one array
    top = levels[1].agg(F.collect_list(F.struct("_tx", "_ty", "_x1", "_y1", "_x2", "_y2")).alias("n")).scalar()
    q_cols = ["_qx", "_qy", "_qx1", "_qy1", "_qx2", "_qy2"]
    per_tile = W.partitionBy("_qx", "_qy")
    for k in range(1, depth + 1):
        if k == 1:
            walk = walk.select(*q_cols, F.explode(top).alias("n")).select(*q_cols, "n.*")
        else:
            nodes = levels[k].withColumns({"_px": _up("_tx", "_px"), "_py": _up("_ty", "_py")})
            walk = walk.join(F.broadcast(nodes) if k <= BROADCAST_LEVELS else nodes, ["_px", "_py"])
        walk = walk.withColumns({"_lb": _gap2(_box("_q"), _box("_"), x_scale), "_ub": _reach2(_box("_q"), _box("_"), x_scale)})
        walk = walk.withColumn("_best", F.min("_ub").over(per_tile)).filter(F.col("_lb") <= F.col("_best") * (1 + 1e-9) + 1e-9)
        walk = walk.select(*q_cols, F.col("_tx").alias("_px"), F.col("_ty").alias("_py"))
        if k % WALK_LEVELS == 0 and k < depth:
            # a dense layer asks for more levels: they go on from a written table, so a task's sorts do not add up over all of them
            walk = spread(reliable_cut(walk, "walk"), WALK_ROWS_PER_TASK, ("_qx", "_qy"), SPOT_TASKS)

    near = walk.join(items.drop("_mx", "_my").withColumnsRenamed({"_tx": "_px", "_ty": "_py"}), ["_px", "_py"])
    near = near.withColumns({"_lb": _gap2(_box("_q"), _box("_"), x_scale), "_ub": _reach2(_box("_q"), _box("_"), x_scale)})
    near = near.withColumn("_best", F.min("_ub").over(per_tile)).filter(F.col("_lb") <= F.col("_best") * (1 + 1e-9) + 1e-9)
    near = near.select("_qx", "_qy", *item_cols)

    rest = [c for c in payload if c not in order]
    # distances are settled at 1e-6 before the comparison, so that ties are ties
    pick = F.min(F.struct(settle(distance, 6).alias("_d"), *order, *rest)).alias("k")
    best = spots.join(near, ["_qx", "_qy"]).groupBy(qx, qy).agg(pick)
    best = best.select(qx, qy, *[F.col(f"k.{c}").alias(c) for c in payload], F.col("k._d").alias(out))
    return queries.join(best, [qx, qy], "left")


def plane_distance(x1: str, y1: str, x2: str, y2: str) -> Column:
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return F.sqrt(dx * dx + dy * dy)


def nearest_forecast_point(cells: DataFrame, registry: DataFrame, zone: MetricZone = ZONE_43N) -> DataFrame:
    """Parent forecast point of every cell, with the distance in metres."""
    pts = project_points(registry, "longitude", "latitude", "_fx", "_fy", zone)
    pts = pts.select("point_idx", "forecast_parent_id", half_even("_fx", 2).alias("_fx"), half_even("_fy", 2).alias("_fy"))
    out = nearest_join(
        cells, pts, "centroid_x", "centroid_y", ("_fx", "_fy", "_fx", "_fy"),
        plane_distance("centroid_x", "centroid_y", "_fx", "_fy"), ["point_idx"], ["forecast_parent_id"], "distance_to_forecast_grid_m",
    )
    return out.withColumn("distance_to_forecast_grid_m", settle("distance_to_forecast_grid_m", 2))


def nearest_cell(stations: DataFrame, cells: DataFrame, carry: list[str], zone: MetricZone = ZONE_43N) -> DataFrame:
    """Nearest cell of every station, carrying cell columns, and the station group."""
    st = project_points(stations, "longitude", "latitude", "station_x", "station_y", zone)
    out = nearest_join(
        st, cells.select("cell_idx", "centroid_x", "centroid_y", *carry), "station_x", "station_y",
        ("centroid_x", "centroid_y", "centroid_x", "centroid_y"),
        plane_distance("station_x", "station_y", "centroid_x", "centroid_y"), ["cell_idx"], carry, "distance_to_cell_m",
    )
    return out.withColumn("station_group", F.concat(F.lit("GROUP_"), F.col("station_id").cast("string")))


def nearest_station(villages: DataFrame, stations: DataFrame) -> DataFrame:
    """Nearest station of every village centre, equirectangular kilometres."""
    dlat = (F.col("latitude") - F.col("_sla")) * 111.0
    dlon = (F.col("longitude") - F.col("_slo")) * 111.0 * F.cos(F.radians("latitude"))
    return _nearest_scaled(villages, stations, F.sqrt(dlat * dlat + dlon * dlon))


def _nearest_scaled(villages: DataFrame, stations: DataFrame, distance: Column) -> DataFrame:
    """Exact nearest under d = 111 * hypot(dlat, dlon * cos(lat)), for |lat| < 90: one walk with bounds of that metric."""
    c = F.col
    st = stations.select(c("station_id").alias("_sid"), c("latitude").alias("_sla"), c("longitude").alias("_slo"))
    st = st.groupBy("_sla", "_slo").agg(F.min("_sid").alias("_sid"))
    best = nearest_join(villages, st, "longitude", "latitude", ("_slo", "_sla", "_slo", "_sla"), distance, ["_sid"], ["_sid"], "_km", x_scale=_degree_shrink)
    return best.withColumnsRenamed({"_sid": "nearest_station_id"}).withColumn("nearest_station_distance_km", settle("_km", 2)).drop("_km")


def _degree_shrink(y1: Column, y2: Column) -> tuple[Column, Column]:
    """Least and greatest length of a degree of longitude between two latitudes, in degrees of latitude."""
    far, near = F.greatest(F.abs(y1), F.abs(y2)), F.when(y1 * y2 <= 0, F.lit(0.0)).otherwise(F.least(F.abs(y1), F.abs(y2)))
    return F.cos(F.radians(far)), F.cos(F.radians(near))


# ---------------------------------------------------------------- polygons
def polygon_boxes(shapes: DataFrame, edges: str = "edges") -> DataFrame:
    return shapes.withColumns({f"_b{k}": v for k, v in box_of(edges).items()})


def _touching(edges: Column, x: Column, y: Column, side: Column, slack: float) -> Column:
    """Edges that touch a tile; a hair of slack keeps those on its border."""
    return F.filter(edges, lambda s: (
        (F.greatest(s.x1, s.x2) >= x - slack) & (F.least(s.x1, s.x2) <= x + side + slack)
        & (F.greatest(s.y1, s.y2) >= y - slack) & (F.least(s.y1, s.y2) <= y + side + slack)
        & ~_passes_by(s, x - slack, y - slack, x + side + slack, y + side + slack)
    ))


def _passes_by(s: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """All corners of a box lie on one side of the edge's line."""
    turn = lambda x, y: (s.x2 - s.x1) * (y - s.y1) - (s.y2 - s.y1) * (x - s.x1)
    corners = [turn(x, y) for x in (x1, x2) for y in (y1, y2)]
    return (F.least(*corners) > 0) | (F.greatest(*corners) < 0)


def quad_cover(shapes: DataFrame, order: str, payload: list[str], frame: tuple[float, float, float], longest: int, edges: str = "edges") -> DataFrame:
    """Tiles that cover each shape: rows of `order`, payload, the shape's box, _level, _tx, _ty, _odd and _edges.

    A shape starts on the level whose tiles are about as large as its box, on four tiles at most, whatever the
    size of other shapes. A tile with more than `EDGES_PER_TILE` edges is cut into 16, `SPLITS` times at most (past that a
    tile keeps all its edges, which is slower and still right). Each tile carries the edges that touch it and
    the parity of its lower right corner, passed down from the tile above. A tile without edges lies wholly inside
    (kept, no edges) or outside (dropped). Everything is a row of its own: no shuffle, and no ring travels
    beyond its first tiles. frame is (x0, y0, root side), longest the most edges of a shape: a ring spread evenly over its
    tiles needs one cut for each factor of `FAN`, and one more is made for uneven rings.
    """
    c, (x0, y0, root) = F.col, frame
    slack = (abs(x0) + abs(y0) + root) * 1e-14  # some roundings of a coordinate
    rest = [p for p in payload if p != order]
    boxed = polygon_boxes(shapes.select(order, c(edges).alias("_edges"), *rest), "_edges")
    extent = F.greatest(c("_bx2") - c("_bx1"), c("_by2") - c("_by1"), F.lit(root / 2.0**COVER_DEPTH))
    level = F.least(F.greatest(F.floor(F.log2(F.lit(root) / extent)), F.lit(0)), F.lit(COVER_DEPTH)).cast("int")
    side = lambda k: F.lit(root) / F.pow(F.lit(2.0), k)
    key = lambda v, o: F.floor((v - F.lit(o)) / side(c("_level"))).cast("long")
    tiles = boxed.where(c("_bx1").isNotNull()).withColumn("_level", level)
    tiles = tiles.select("*", F.explode(F.sequence(key(c("_bx1"), x0), key(c("_bx2"), x0))).alias("_tx"))
    tiles = tiles.select("*", F.explode(F.sequence(key(c("_by1"), y0), key(c("_by2"), y0))).alias("_ty"))
    at = lambda: (F.lit(x0) + c("_tx") * side(c("_level")), F.lit(y0) + c("_ty") * side(c("_level")), side(c("_level")))
    place = ["_level", "_tx", "_ty"]
    held = [order, *rest, "_bx1", "_by1", "_bx2", "_by2"]
    tiles = tiles.withColumns(dict(zip(("_x", "_y", "_s"), at())))
    odd = inside(c("_x") + c("_s"), "_y", "_edges")
    tiles = tiles.select(*held, *place, odd.alias("_odd"), _touching(c("_edges"), c("_x"), c("_y"), c("_s"), slack).alias("_edges"))

    def settled(t: DataFrame) -> DataFrame:
        return t.where((F.size("_edges") > 0) | c("_odd"))

    tiles = settled(tiles)
    cuts = 0 if longest <= EDGES_PER_TILE else min(SPLITS, 1 + math.ceil(math.log(longest / EDGES_PER_TILE, FAN)))
    for _ in range(cuts):
        full = F.size("_edges") > EDGES_PER_TILE
        part = F.when(full, F.sequence(F.lit(0), F.lit(FAN * FAN - 1))).otherwise(F.array(F.lit(-1)))
        tiles = tiles.withColumns({"_px": F.lit(x0) + (c("_tx") + 1) * side(c("_level")), "_py": F.lit(y0) + c("_ty") * side(c("_level"))})
        tiles = tiles.select("*", F.explode(part).alias("_k"))
        cut = c("_k") >= 0
        tiles = tiles.withColumns({
            "_level": F.when(cut, c("_level") + CUT_LEVELS).otherwise(c("_level")),
            "_tx": F.when(cut, c("_tx") * FAN + c("_k") % FAN).otherwise(c("_tx")),
            "_ty": F.when(cut, c("_ty") * FAN + F.floor(c("_k") / FAN)).otherwise(c("_ty")),
        })
        tiles = tiles.withColumns(dict(zip(("_x", "_y", "_s"), at())))
        steps = path_crossings(c("_x") + c("_s"), "_y", "_px", "_py", "_edges")
        tiles = tiles.withColumns({
            "_odd": F.when(cut, c("_odd") != (steps % 2 == 1)).otherwise(c("_odd")),
            "_local": F.when(cut, _touching(c("_edges"), c("_x"), c("_y"), c("_s"), slack)).otherwise(c("_edges")),
        })
        tiles = settled(tiles.select(*held, *place, "_odd", c("_local").alias("_edges")))
    return tiles


def point_in_polygon(points: DataFrame, shapes: DataFrame, px: str, py: str, order: str, payload: list[str], edges: str = "edges") -> DataFrame:
    """Inner join of points with the first shape (lowest `order`) that contains or touches them.

    Shapes are listed under the tiles of their quad cover, points under their tile of every level the cover
    uses (a driver-side list of at most `COVER_DEPTH + CUT_LEVELS * SPLITS + 1` numbers). A point is tested against the edges of one tile only.
    """
    c = F.col
    rest = [p for p in payload if p != order]
    box = polygon_boxes(shapes.select(edges), edges).agg(F.min("_bx1"), F.min("_by1"), F.max("_bx2"), F.max("_by2"), F.max(F.size(edges))).first()
    if box[0] is None:
        return points.join(shapes.select(*payload).limit(0), F.lit(False))
    # tile lines at odd places: the frame begins a little outside the layer, by no round share of it
    span = max(box[2] - box[0], box[3] - box[1], 1e-9)
    frame = (box[0] - span * 0.00271828, box[1] - span * 0.00314159, span * 1.00618034)
    cover = spread(reliable_cut(quad_cover(shapes, order, payload, frame, box[4], edges), "quad-cover"), TILES_PER_TASK, most=SPOT_TASKS)
    x0, y0, root = frame
    levels = sorted(r[0] for r in cover.select("_level").distinct().collect())
    key = lambda v, o, k: F.floor((c(v) - F.lit(o)) / F.lit(root / 2.0**k)).cast("long")
    spots = points.select(px, py).distinct().where(c(px).between(box[0], box[2]) & c(py).between(box[1], box[3]))
    spots = spread(spots, SPOTS_PER_TASK, (px, py), SPOT_TASKS)
    under = F.array(*[F.struct(F.lit(k).alias("_level"), key(px, x0, k).alias("_tx"), key(py, y0, k).alias("_ty")) for k in levels])
    spots = spots.select(px, py, F.inline(under))
    side = F.lit(root) / F.pow(F.lit(2.0), c("_level"))
    met = spots.join(cover, ["_level", "_tx", "_ty"]).where(c(px).between(c("_bx1"), c("_bx2")) & c(py).between(c("_by1"), c("_by2")))
    steps = path_crossings(px, py, F.lit(x0) + (c("_tx") + 1) * side, F.lit(y0) + c("_ty") * side, "_edges")
    hit = met.where((c("_odd") != (steps % 2 == 1)) | on_edge(px, py, "_edges"))
    first = hit.groupBy(px, py).agg(F.min(F.struct(order, *rest)).alias("k"))
    first = first.select(px, py, *[c(f"k.{p}").alias(p) for p in payload])
    return points.join(first, [px, py])


def assign_villages(cells: DataFrame, shapes: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Village of every cell: the containing polygon, else the nearest polygon centroid.

    The containment join is written once; the cells it leaves over and the final union both
    read it from there.
    """
    carry = ["panchayat_id", "panchayat_name", "block_name", "district_name"]
    inside_cells = reliable_cut(point_in_polygon(cells, shapes, lon, lat, "feature_idx", carry), "containment")
    inside_cells = inside_cells.withColumn("assignment_mode", F.lit("centroid_contains"))
    outside = cells.join(inside_cells.select("grid_id"), "grid_id", "left_anti")
    centres = shapes.select("feature_idx", *carry, area_centroid("edges").alias("k"))
    centres = centres.select("feature_idx", *carry, F.col("k.x").alias("_cx"), F.col("k.y").alias("_cy"))
    near = nearest_join(
        outside, centres, lon, lat, ("_cx", "_cy", "_cx", "_cy"), plane_distance(lon, lat, "_cx", "_cy"), ["feature_idx"], carry, "_d"
    ).drop("_d")
    found = F.col("panchayat_id").isNotNull()
    # fixed values: what an empty polygon layer gives
    unknown = {"panchayat_id": "GP_UNKNOWN", "panchayat_name": "Unknown Panchayat", "block_name": "Unknown Block", "district_name": "Coimbatore"}
    near = near.withColumn("assignment_mode", F.when(found, "nearest_fallback").otherwise("unassigned"))
    near = near.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in unknown.items()})
    return inside_cells.unionByName(near)


def villages_without_cells(shapes: DataFrame, assigned: DataFrame) -> DataFrame:
    return shapes.select("panchayat_name").distinct().join(assigned.select("panchayat_name").distinct(), "panchayat_name", "left_anti")


def shape_distance(points: DataFrame, shapes: DataFrame, px: str, py: str, order: str, edges: str = "edges", out: str = "distance") -> DataFrame:
    """Distance from points to the nearest shape: 0 inside, else to the nearest edge.

    Without any shape the distance is the fixed far value.
    """
    segs = shapes.select(F.col(order).alias("_so"), F.posexplode(edges).alias("_k", "s")).select("_so", "_k", "s.*")
    c = F.col
    segs = segs.withColumns({
        "_bx1": F.least("x1", "x2"), "_by1": F.least("y1", "y2"), "_bx2": F.greatest("x1", "x2"), "_by2": F.greatest("y1", "y2"),
    }).withColumnsRenamed({"x1": "_sx1", "y1": "_sy1", "x2": "_sx2", "y2": "_sy2"})
    near = nearest_join(
        points, segs, px, py, ("_bx1", "_by1", "_bx2", "_by2"),
        segment_distance(px, py, "_sx1", "_sy1", "_sx2", "_sy2"), ["_so", "_k"], ["_sx1", "_sy1", "_sx2", "_sy2"], "_d",
    ).drop("_sx1", "_sy1", "_sx2", "_sy2")
    covered = point_in_polygon(points.select(px, py).distinct(), shapes, px, py, order, [order], edges).select(px, py, F.lit(True).alias("_in"))
    joined = near.join(covered, [px, py], "left")
    value = F.when(c("_in"), 0.0).otherwise(F.coalesce(settle("_d", 2), F.lit(C.NO_WATER_M)))
    return joined.withColumn(out, value).drop("_d", "_in")


# ---------------------------------------------------------------- layer quality
def crossing_features(shapes: DataFrame, order: str, edges: str = "edges") -> DataFrame:
    """Features with two edges that properly cross: distinct `order` values.

    Edges of one feature meet on tiles of its own box, about one edge per tile, so long rings
    are not compared edge by edge.
    """
    c = F.col
    boxed = polygon_boxes(shapes.select(order, edges), edges)
    side = F.greatest(c("_bx2") - c("_bx1"), c("_by2") - c("_by1")) / F.greatest(F.sqrt(F.size(edges).cast("double")), F.lit(1.0))
    rows = boxed.select(order, "_bx1", "_by1", F.greatest(side, F.lit(1e-12)).alias("_s"), F.posexplode(edges).alias("_k", "e"))
    key = lambda v, o: F.floor((v - c(o)) / c("_s")).cast("long")
    lo, hi = (lambda a, b: F.least(c(a), c(b))), (lambda a, b: F.greatest(c(a), c(b)))
    rows = rows.select("*", F.explode(F.sequence(key(lo("e.x1", "e.x2"), "_bx1"), key(hi("e.x1", "e.x2"), "_bx1"))).alias("_tx"))
    rows = rows.select("*", F.explode(F.sequence(key(lo("e.y1", "e.y2"), "_by1"), key(hi("e.y1", "e.y2"), "_by1"))).alias("_ty"))
    a = rows.select(order, "_tx", "_ty", c("_k").alias("_ka"), c("e").alias("a"))
    b = rows.select(order, "_tx", "_ty", c("_k").alias("_kb"), c("e").alias("b"))
    turn = lambda s, x, y: F.signum((s.x2 - s.x1) * (y - s.y1) - (s.y2 - s.y1) * (x - s.x1))
    s, t = c("a"), c("b")
    cross = (turn(s, t.x1, t.y1) * turn(s, t.x2, t.y2) < 0) & (turn(t, s.x1, s.y1) * turn(t, s.x2, s.y2) < 0)
    return a.join(b, [order, "_tx", "_ty"]).filter((c("_ka") < c("_kb")) & cross).select(order).distinct()


def vector_checks(layer: DataFrame, order: str, code: str, name: str, levels: list[str]) -> DataFrame:
    """Null, empty and invalid geometries, duplicate codes, missing names, counts per admin level.

    layer carries polygons (NULL for no geometry) and their edge array.
    """
    from terracast.functions.shapes import signed_area
    from terracast.operators.quality import checks_to_rows, duplicate_count

    c = F.col
    ring_bad = lambda r: (F.size(r) < 4) | ~(r[0] == F.element_at(r, -1))
    flat = F.flatten("polygons")
    shaped = c("polygons").isNotNull() & (F.size("edges") > 0)
    odd = layer.filter(shaped & (F.exists(flat, ring_bad) | (F.abs(signed_area("edges")) == 0.0))).select(order)
    bad = odd.unionByName(crossing_features(layer.filter(shaped), order)).distinct().agg(F.count("*").alias("invalid"))
    agg = layer.agg(
        F.count_if(c("polygons").isNull()).alias("null_geometry"), F.count_if(c("polygons").isNotNull() & (F.size("edges") == 0)).alias("empty"),
        F.count_if(c(name).isNull()).alias("no_name"), *[F.count_distinct(v).alias(f"n_{v}") for v in levels],
    )
    one = attach_row(attach_row(agg, bad), duplicate_count(layer, [code if code in layer.columns else name]).select("duplicates"))
    return checks_to_rows(one, [
        ("invalid_geometry", "WARN", c("invalid")), ("empty_geometry", "WARN", c("empty")), ("null_geometry", "ERROR", c("null_geometry")),
        ("duplicate_code", "WARN", c("duplicates")), ("missing_name", "WARN", c("no_name")), *[(f"count_{v}", "INFO", c(f"n_{v}")) for v in levels],
    ])
