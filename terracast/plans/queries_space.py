"""Projection, grid, spatial-join and raster queries (P-11.., J-09.., T, W-03, G-10.., Q-12..)."""
from __future__ import annotations

from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.geodesy import project_points, unproject_points
from terracast.functions.shapes import area_centroid, vertex_mean
from terracast.functions.single import attach_row
from terracast.operators import raster as R
from terracast.operators import spatial as S
from terracast.operators import villages as G
from terracast.plans import views as V
from terracast.plans.oracle import VIEWS, even, fix, forward, inverse
from terracast.plans.registry import query
from terracast.session import scratch_path
from terracast.sources.raster import header_report, read_raster, write_raster
from terracast.sources import geojson as J

GRID_COLS = "centroid_x centroid_y latitude longitude min_x min_y max_x max_y"


# ---------------------------------------------------------------- projection and grid
@query("p11_project_points", f"select event_id, x, y from {forward('v_obs', 'longitude', 'latitude')}", "x y")
def p11(spark, sf):
    return project_points(V.observations(spark, sf).select("event_id", "longitude", "latitude"), "longitude", "latitude").select("event_id", "x", "y")


@query("p12_unproject_points", f"select event_id, lo as longitude, la as latitude, abs(lo-longitude) < 1e-5 and abs(la-latitude) < 1e-5 as round_trip from {inverse(forward('v_obs', 'longitude', 'latitude'), 'x', 'y', 'lo', 'la')}", "longitude latitude")
def p12(spark, sf):
    xy = project_points(V.observations(spark, sf).select("event_id", "longitude", "latitude"), "longitude", "latitude")
    back = unproject_points(xy, "x", "y", "lo", "la")
    ok = (F.abs(F.col("lo") - F.col("longitude")) < 1e-5) & (F.abs(F.col("la") - F.col("latitude")) < 1e-5)
    return back.select("event_id", F.col("lo").alias("longitude"), F.col("la").alias("latitude"), ok.alias("round_trip"))


@query("p13_metric_grid", "select grid_id, cell_idx, centroid_x, centroid_y, latitude, longitude, min_x, min_y, max_x, max_y from v_grid", GRID_COLS)
def p13(spark, sf):
    return V.fresh_grid(spark, sf)


@query("p14_cell_ring", "select grid_id, printf('%d %d, %d %d, %d %d, %d %d, %d %d', min_x::bigint, min_y::bigint, max_x::bigint, min_y::bigint, max_x::bigint, max_y::bigint, min_x::bigint, max_y::bigint, min_x::bigint, min_y::bigint) as ring from v_grid")
def p14(spark, sf):
    pt = lambda p: F.concat(p[0].cast("long").cast("string"), F.lit(" "), p[1].cast("long").cast("string"))
    return V.grid(spark, sf).select("grid_id", F.array_join(F.transform(S.cell_ring(), pt), ", ").alias("ring"))


@query("f05_padded_box", "select grid_id, latitude between min_lat-0.005e0 and max_lat+0.005e0 and longitude between min_lon-0.005e0 and max_lon+0.005e0 as near_box from v_grid, v_extent")
def f05(spark, sf):
    g = attach_row(V.grid(spark, sf), V.extent(spark, sf))
    pad = 0.005
    ok = F.col("latitude").between(F.col("min_lat") - pad, F.col("max_lat") + pad) & F.col("longitude").between(F.col("min_lon") - pad, F.col("max_lon") + pad)
    return g.select("grid_id", ok.alias("near_box"))


@query("j17_axis_product", "select centroid_y, count(*) as cells, min(centroid_x) as first_x, max(centroid_x) as last_x from v_grid group by 1", "centroid_y first_x last_x")
def j17(spark, sf):
    return V.grid(spark, sf).groupBy("centroid_y").agg(F.count("*").alias("cells"), F.min("centroid_x").alias("first_x"), F.max("centroid_x").alias("last_x"))


@query("x01_padded_ids", "select cell_idx, 'GRID_'||lpad(cast(cell_idx as varchar),5,'0') as a, 'FC_GRID_'||lpad(cast(cell_idx%12+1 as varchar),2,'0') as b, 'GP_'||lpad(cast(cell_idx as varchar),greatest(4,len(cast(cell_idx as varchar)))::int,'0') as c, 'GROUP_'||cell_idx as g from v_grid")
def x01(spark, sf):
    i = F.col("cell_idx")
    return V.grid(spark, sf).select("cell_idx", F.format_string("GRID_%05d", i).alias("a"), F.format_string("FC_GRID_%02d", i % 12 + 1).alias("b"), F.format_string("GP_%04d", i).alias("c"), F.concat(F.lit("GROUP_"), i.cast("string")).alias("g"))


# ---------------------------------------------------------------- nearest
@query("j09_nearest_point", "select grid_id, forecast_parent_id, distance_to_forecast_grid_m from v_parent", "distance_to_forecast_grid_m")
def j09(spark, sf):
    return S.nearest_forecast_point(V.grid(spark, sf), V.point_registry(spark, sf)).select("grid_id", "forecast_parent_id", "distance_to_forecast_grid_m")


@query("j10_nearest_cell", f"""select station_id, 'GROUP_'||station_id as station_group, k.g as grid_id, k.d as distance_to_cell_m, x as station_x, y as station_y from (
    select s.station_id, any_value(s.station_x) as x, any_value(s.station_y) as y, min(struct_pack(d := {fix('sqrt((station_x-centroid_x)*(station_x-centroid_x)+(station_y-centroid_y)*(station_y-centroid_y))', 6)}, i := cell_idx, g := grid_id)) as k
    from v_stationxy s, v_grid group by 1)""", "distance_to_cell_m station_x station_y")
def j10(spark, sf):
    out = S.nearest_cell(V.stations(spark, sf), V.grid(spark, sf), ["grid_id"])
    return out.select("station_id", "station_group", "grid_id", "distance_to_cell_m", "station_x", "station_y")


@query("j11_nearest_station", f"""select panchayat_id, k.s as nearest_station_id, {fix('k.d', 2)} as nearest_station_distance_km from (select panchayat_id,
    min(struct_pack(d := {fix('sqrt(((cy-latitude)*111e0)*((cy-latitude)*111e0)+((cx-longitude)*111e0*cos(radians(cy)))*((cx-longitude)*111e0*cos(radians(cy))))', 6)}, s := station_id)) as k from v_unit, v_station group by 1)""", "nearest_station_distance_km")
def j11(spark, sf):
    villages = V.units(spark, sf).select("panchayat_id", F.col("cy").alias("latitude"), F.col("cx").alias("longitude"))
    return S.nearest_station(villages, V.stations(spark, sf)).select("panchayat_id", "nearest_station_id", "nearest_station_distance_km")


# ---------------------------------------------------------------- polygons
@query("j12_point_in_polygon", "select grid_id, min(unit_idx) as feature_idx from v_pip group by 1")
def j12(spark, sf):
    return S.point_in_polygon(V.grid(spark, sf), V.shapes(spark, sf), "longitude", "latitude", "feature_idx", ["feature_idx"]).select("grid_id", "feature_idx")


@query("j13_village_assignment", "select grid_id, panchayat_id, panchayat_name, block_name, district_name, assignment_mode from v_assign")
def j13(spark, sf):
    return S.assign_villages(V.grid(spark, sf), V.shapes(spark, sf)).select("grid_id", "panchayat_id", "panchayat_name", "block_name", "district_name", "assignment_mode")


@query("j14_water_distance", "select grid_id, distance_to_nearest_water from v_water", "distance_to_nearest_water")
def j14(spark, sf):
    g = V.grid(spark, sf).select("grid_id", "centroid_x", "centroid_y")
    out = S.shape_distance(g, V.projected_shapes(spark, sf), "centroid_x", "centroid_y", "feature_idx", out="distance_to_nearest_water")
    return out.select("grid_id", "distance_to_nearest_water")


@query("j16_villages_without_cells", """select panchayat_name from v_unit where panchayat_name not in (select u.panchayat_name from v_station s join v_unit u on
    (select count(*) from v_hex e where e.unit_idx=u.unit_idx and (e.y1 > s.latitude) <> (e.y2 > s.latitude) and s.longitude < (e.x2-e.x1)*(s.latitude-e.y1)/(e.y2-e.y1)+e.x1) % 2 = 1
    where not exists (select 1 from v_unit w where w.unit_idx < u.unit_idx and (select count(*) from v_hex e where e.unit_idx=w.unit_idx and (e.y1 > s.latitude) <> (e.y2 > s.latitude) and s.longitude < (e.x2-e.x1)*(s.latitude-e.y1)/(e.y2-e.y1)+e.x1) % 2 = 1))""")
def j16(spark, sf):
    shapes = V.shapes(spark, sf)
    return S.villages_without_cells(shapes, S.point_in_polygon(V.stations(spark, sf), shapes, "longitude", "latitude", "feature_idx", ["feature_idx", "panchayat_name"]))


@query("u02_name_difference", "select distinct p_name from part where p_name not in (select p_name from part where p_size >= 49)")
def u02(spark, sf):
    p = V.table(spark, sf, "part").select("p_name", "p_size")
    return p.select("p_name").distinct().join(p.filter("p_size >= 49").select("p_name").distinct(), "p_name", "left_anti")


@query("x21_centroids", """select c.unit_idx as feature_idx, ax, ay, mx, my from v_centroid c join (select unit_idx, (sum(x1)+max(x1) filter (k=0))/7e0 as mx, (sum(y1)+max(y1) filter (k=0))/7e0 as my from v_hex group by 1) using (unit_idx)""", "ax ay mx my")
def x21(spark, sf):
    s = V.shapes(spark, sf).select("feature_idx", area_centroid("edges").alias("a"), vertex_mean("edges").alias("m"))
    return s.select("feature_idx", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("m.x").alias("mx"), F.col("m.y").alias("my"))


def broken_layer(spark, sf):
    """Units with bow ties, lost geometries, lost names and repeated codes among them."""
    from terracast.functions.shapes import shape_edges

    s = F.col("feature_idx")
    r = V.hex_ring()
    twisted = F.array(r[0], r[3], r[2], r[1], r[4], r[5], r[0])
    ring = F.when(s % 10 == 0, twisted).otherwise(r)
    u = V.units(spark, sf).withColumn("polygons", F.when(s % 13 != 0, F.when(s % 11 == 0, F.array().cast("array<array<array<array<double>>>>")).otherwise(F.array(F.array(ring)))))
    return u.select("feature_idx", F.format_string("GP_%04d", F.floor(s / 2)).alias("panchayat_code"), F.when(s % 17 != 0, F.col("panchayat_name")).alias("panchayat_name"),
                    "block_name", "district_name", "polygons", shape_edges(F.coalesce("polygons", F.array().cast("array<array<array<array<double>>>>"))).alias("edges"))


@query("q12_vector_checks", """select check_id, n_bad, case when n_bad > 0 then sev else 'OK' end as severity from (select
    unnest(['invalid_geometry','empty_geometry','null_geometry','duplicate_code','missing_name','count_district_name','count_block_name']) as check_id, unnest(['WARN','WARN','ERROR','WARN','WARN','INFO','INFO']) as sev,
    unnest([count(*) filter (unit_idx%10=0 and unit_idx%13<>0 and unit_idx%11<>0), count(*) filter (unit_idx%11=0 and unit_idx%13<>0), count(*) filter (unit_idx%13=0), count(*)-count(distinct unit_idx//2), count(*) filter (unit_idx%17=0), count(distinct district_name), count(distinct block_name)]) as n_bad from v_unit)""")
def q12(spark, sf):
    return S.vector_checks(broken_layer(spark, sf), "feature_idx", "panchayat_code", "panchayat_name", ["district_name", "block_name"])


# ---------------------------------------------------------------- raster
def _stored_raster(spark, sf, headed=True):
    """The pixels as a stored raster, with its box in the header or without one."""
    path = scratch_path(spark, "raster")
    px = V.pixels(spark, sf)
    return write_raster(px, path, V.RASTER_BOX, "EPSG:4326", -9999.0) if headed else write_raster(px, path)


@query("s05_raster_scan", "select r as \"row\", c as \"col\", z as value from v_pixel", "value")
def s05(spark, sf):
    return read_raster(spark, _stored_raster(spark, sf)).select("row", "col", "value")


@query("s05_raster_window", """select r as "row", c as "col", z as value from v_pixel, (select max(r)+1 as h, max(c)+1 as w from v_pixel)
    where r between floor((11.40-11.00)/((11.40-10.20)/h)) and floor((11.40-10.70)/((11.40-10.20)/h)) and c between floor((76.80-76.60)/((77.30-76.60)/w)) and floor((77.05-76.60)/((77.30-76.60)/w))""", "value")
def s05w(spark, sf):
    """Pixels under a box: tiles and rows outside of it are not read."""
    box = {"min_lon": 76.80, "max_lon": 77.05, "min_lat": 10.70, "max_lat": 11.00}
    return read_raster(spark, _stored_raster(spark, sf), box).select("row", "col", "value")


@query("s05_raster_headers", """select *, (77.30e0-76.60e0)/n_cols as lon_step, (11.40e0-10.20e0)/n_rows as lat_step, 'EPSG:4326' as crs from
    (select (max(r)+1)::bigint as n_rows, (max(c)+1)::bigint as n_cols from v_pixel), (select unnest(['header','fallback']) as box_source)""", "lon_step lat_step")
def s05h(spark, sf):
    """A raster that brings its box and one that doesn't: size, steps and the source of the box."""
    rows = [header_report(spark, _stored_raster(spark, sf, headed)) for headed in (True, False)]
    return rows[0].unionByName(rows[1]).select("n_rows", "n_cols", "box_source", "lon_step", "lat_step", "crs")


@query("w03_neighbourhood", "select r as \"row\", c as \"col\", w[1] as nw, w[2] as n, w[3] as ne, w[4] as w, w[5] as z, w[6] as e, w[7] as sw, w[8] as s, w[9] as se from v_near9", "nw n ne w z e sw s se")
def w03(spark, sf):
    names = ["nw", "n", "ne", "w", "z", "e", "sw", "s", "se"]
    w = R.neighbourhood(V.pixels(spark, sf)).withColumnRenamed("w", "_w")
    return w.select("row", "col", *[F.col("_w")[i].alias(n) for i, n in enumerate(names)])


@query("t01_slope", "select r as \"row\", c as \"col\", slope from v_terrain", "slope")
def t01(spark, sf):
    return R.terrain(V.pixels(spark, sf)).select("row", "col", "slope")


@query("t02_aspect", "select r as \"row\", c as \"col\", aspect from v_terrain", "aspect")
def t02(spark, sf):
    return R.terrain(V.pixels(spark, sf)).select("row", "col", "aspect")


@query("t03_ruggedness", "select r as \"row\", c as \"col\", tri from v_terrain", "tri")
def t03(spark, sf):
    return R.terrain(V.pixels(spark, sf)).select("row", "col", "tri")


@query("j15_window_join", "select grid_id, count(*) as n, sum(r) as sum_r, sum(c) as sum_c from (select grid_id, r::bigint as r, c::bigint as c from v_window) group by 1".replace("sum(r)", "sum(r)::bigint").replace("sum(c)", "sum(c)::bigint"))
def j15(spark, sf):
    px = V.pixels(spark, sf).select("row", "col", F.col("row").alias("r"), F.col("col").alias("c"))
    return R.window_pixels(V.cell_pixels(spark, sf), px, ["r", "c"]).groupBy("grid_id").agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


_TERR = """select grid_id, avg(t.z) as elevation_mean, stddev_pop(t.z) as elevation_std, min(t.z) as elevation_min, max(t.z) as elevation_max, max(t.z)-min(t.z) as elevation_range,
    avg(slope) as slope_mean, stddev_pop(slope) as slope_std, min(slope) as slope_min, max(slope) as slope_max, avg(sin(radians(aspect))) as aspect_sin, avg(cos(radians(aspect))) as aspect_cos, avg(aspect) as aspect_mean,
    avg(tri) as tri_mean, stddev_pop(tri) as tri_std from v_window w join v_terrain t on w.r=t.r and w.c=t.c group by 1"""


def terr(spark, sf):
    px = V.pixels(spark, sf)
    return R.terrain_features(V.cell_pixels(spark, sf), R.terrain(px), rounding=False)


@query("g12_elevation_stats", f"select grid_id, elevation_mean, elevation_std, elevation_min, elevation_max, elevation_range from ({_TERR})", "elevation_mean elevation_std elevation_min elevation_max elevation_range")
def g12(spark, sf):
    return terr(spark, sf).select("grid_id", "elevation_mean", "elevation_std", "elevation_min", "elevation_max", "elevation_range")


@query("g13_slope_stats", f"select grid_id, slope_mean, slope_std, slope_min, slope_max from ({_TERR})", "slope_mean slope_std slope_min slope_max")
def g13(spark, sf):
    return terr(spark, sf).select("grid_id", "slope_mean", "slope_std", "slope_min", "slope_max")


@query("g14_aspect_stats", f"select grid_id, aspect_sin, aspect_cos, aspect_mean from ({_TERR})", "aspect_sin aspect_cos aspect_mean")
def g14(spark, sf):
    return terr(spark, sf).select("grid_id", "aspect_sin", "aspect_cos", "aspect_mean")


@query("g15_ruggedness_stats", f"select grid_id, tri_mean, tri_std from ({_TERR})", "tri_mean tri_std")
def g15(spark, sf):
    return terr(spark, sf).select("grid_id", "tri_mean", "tri_std")


_SHARE = ", ".join(f"{even(f'count(*) filter (cls={code}) / count(*)', 4)} as landcover_fraction_{n}" for n, code in C.LANDCOVER_FRACTIONS.items())
_NAMES = "case cls " + " ".join(f"when {k} then '{v}'" for k, v in C.LANDCOVER_CLASSES.items()) + " else 'Class_'||cls end"
_SUM = "0e0+" + "+".join(f"landcover_fraction_{n}" for n in C.LANDCOVER_FRACTIONS)
_COVER = f"""select f.*, greatest(0e0, {even(f'1e0-({_SUM})', 4)}) as nodata_fraction, d.dominant_landcover_class from (select grid_id, {_SHARE} from v_window group by 1) f
    join (select grid_id, {_NAMES} as dominant_landcover_class from (select grid_id, cls, count(*) as n from v_window group by all) qualify row_number() over (partition by grid_id order by n desc, cls)=1) d using (grid_id)"""
_FRACTIONS = " ".join(f"landcover_fraction_{n}" for n in C.LANDCOVER_FRACTIONS) + " nodata_fraction"


# the master table with all feature families
_DIGITS = {c: 4 if c in ("aspect_sin", "aspect_cos") else 2 for c in ("elevation_mean", "elevation_std", "elevation_min", "elevation_max", "elevation_range", "slope_mean", "slope_std", "slope_min", "slope_max", "aspect_sin", "aspect_cos", "aspect_mean", "tri_mean", "tri_std")}
VIEWS["v_features"] = f"""select m.* exclude (elevation_mean), {", ".join(f"{fix('t.' + c, n)} as {c}" for c, n in _DIGITS.items())}, c.* exclude (grid_id), w.distance_to_nearest_water from v_master m
      left join ({_TERR}) t using (grid_id) left join ({_COVER}) c using (grid_id) left join v_water w using (grid_id)"""


@query("g16_class_fractions", _COVER, _FRACTIONS)
def g16(spark, sf):
    cls = V.pixels(spark, sf).select("row", "col", F.col("cls").alias("value"))
    return R.landcover_features(V.cell_pixels(spark, sf), cls)


@query("x24_class_names", f"select r as \"row\", c as \"col\", {_NAMES} as name from v_pixel")
def x24(spark, sf):
    return V.pixels(spark, sf).select("row", "col", R.class_name("cls").alias("name"))


@query("g17_raster_summary", "select count(*) as cells, count(*) filter (cls=60) as nodata, count(*) filter (cls=60)/count(*)*100e0 as nodata_pct, 0::bigint as nan, min(cls::double) filter (cls<>60) as min_value, max(cls::double) filter (cls<>60) as max_value, count(distinct cls) filter (cls<>60) as distinct_values from v_pixel",
    "nodata_pct min_value max_value")
def g17(spark, sf):
    return R.raster_summary(V.pixels(spark, sf).select(F.col("cls").cast("double").alias("value")), 60.0)


@query("q13_raster_checks", "select unnest(['nodata_cells','nan_cells','no_valid_cells']) as check_id, unnest([count(*) filter (cls=60), 0, 0]) as n_bad, unnest(['INFO','OK','OK']) as severity from v_pixel")
def q13(spark, sf):
    return R.raster_checks(V.pixels(spark, sf).select(F.col("cls").cast("double").alias("value")), 60.0)


# ---------------------------------------------------------------- diagnostics and suites
@query("g11_cells_per_village", "select count(*) as villages, min(n) as min_cells, max(n) as max_cells from (select panchayat_id, count(*) as n from v_assign group by 1)")
def g11(spark, sf):
    return G.cells_per_village(S.assign_villages(V.grid(spark, sf), V.shapes(spark, sf)))


@query("g25_alignment_diagnostics", "select forecast_parent_id, count(*) as cells, max(distance_to_forecast_grid_m) as max_m, avg(distance_to_forecast_grid_m) as mean_m from v_parent group by 1", "max_m mean_m")
def g25(spark, sf):
    p = S.nearest_forecast_point(V.grid(spark, sf), V.point_registry(spark, sf))
    d = "distance_to_forecast_grid_m"
    return p.groupBy("forecast_parent_id").agg(F.count("*").alias("cells"), F.max(d).alias("max_m"), F.avg(d).alias("mean_m"))


@query("g25_assignment_modes", "select assignment_mode, count(*) as n from v_assign group by 1")
def g25b(spark, sf):
    return S.assign_villages(V.grid(spark, sf), V.shapes(spark, sf)).groupBy("assignment_mode").agg(F.count("*").alias("n"))


@query("g10_village_profile", f"""select a.panchayat_id, any_value(a.panchayat_name) as panchayat_name, any_value(a.block_name) as block_name, any_value(a.district_name) as district_name,
    arg_min(a.assignment_mode, a.grid_id) as assignment_mode, avg(g.latitude) as latitude, avg(g.longitude) as longitude, avg({fix('t.elevation_mean', 2)}) as elevation_mean, count(*) as grid_cell_count
    from v_assign a join v_grid g using (grid_id) join ({_TERR}) t using (grid_id) group by 1""", "latitude longitude elevation_mean")
def g10(spark, sf):
    return G.village_profile(V.master(spark, sf))


@query("q14_grid_suite", f"""select check_id, n_bad, case when n_bad > 0 then sev else 'OK' end as severity from (select unnest(['A null cell box','B cell size','D coverage','E unassigned village','F null elevation','G elevation range','H null land cover','H fraction sum','I negative water distance',
    'J null parent','K nulls in all','N outside country','C crs note','L duplicate grid id','M duplicate centroid','O villages','O min cells','O max cells']) as check_id,
    unnest(['ERROR','ERROR','WARN','ERROR','ERROR','WARN','ERROR','WARN','ERROR','ERROR','WARN','ERROR','INFO','ERROR','ERROR','INFO','INFO','INFO']) as sev,
    unnest([count(*) filter (g.min_x is null), count(*) filter (abs(max_x-min_x-1000e0)>0.01 or abs(max_y-min_y-1000e0)>0.01), cast(min(latitude)>10.30 or max(latitude)<11.30 or min(longitude)>76.70 or max(longitude)<77.20 as bigint),
      count(*) filter (a.panchayat_name is null), count(*) filter (t.elevation_mean is null), count(*) filter (t.elevation_mean<0 or t.elevation_mean>3000), count(*) filter (c.dominant_landcover_class is null),
      count(*) filter (abs({_SUM}+nodata_fraction-1e0)>0.05), count(*) filter (w.distance_to_nearest_water<0), count(*) filter (p.forecast_parent_id is null),
      (select count(*) from v_grid where grid_id not in (select grid_id from v_assign))::bigint, count(*) filter (latitude<6 or latitude>38 or longitude<68 or longitude>98), 0,
      count(*)-count(distinct g.grid_id), count(*)-count(distinct (centroid_x,centroid_y)), count(distinct a.panchayat_id), min(n.n), max(n.n)]) as n_bad
    from v_grid g left join v_assign a using (grid_id) left join ({_TERR}) t using (grid_id) left join ({_COVER}) c using (grid_id) left join v_water w using (grid_id) left join v_parent p using (grid_id)
    left join (select panchayat_id, count(*) as n from v_assign group by 1) n on n.panchayat_id=a.panchayat_id)""")
def q14(spark, sf):
    return G.grid_checks(V.fresh_master(spark, sf))


# ---------------------------------------------------------------- vector text
@query("s04_geojson_features", """select unit_idx as feature_idx, panchayat_id, case when unit_idx%9=0 then 'UNKNOWN' else panchayat_name end as panchayat_name, 'Coimbatore' as district_name, 'Polygon' as geometry_type, 6::int as n_edges, x1 as first_x, y1 as first_y
    from v_unit join v_hex using (unit_idx, panchayat_id) where k=0""", "first_x first_y")
def s04(spark, sf):
    s = F.col("feature_idx")
    props = F.struct(F.col("panchayat_id").alias("panchayat_code"), F.when(s % 9 != 0, F.col("panchayat_name")).alias("panchayat_name"))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(V.hex_ring()).alias("coordinates")).alias("geometry")))
    feats = J.parse_features(V.units(spark, sf).select("feature_idx", text.alias("value")), order="feature_idx")
    b = J.boundary_shapes(feats).join(feats.select("feature_idx", "geometry_type"), "feature_idx")
    e = F.col("edges")[0]
    return b.select("feature_idx", "panchayat_id", "panchayat_name", "district_name", "geometry_type", F.size("edges").alias("n_edges"), e.x1.alias("first_x"), e.y1.alias("first_y"))


@query("s04_multi_polygon", "select unit_idx as feature_idx, 'MultiPolygon' as geometry_type, 2::int as n_polygons, 12::int as n_edges, mx from (select unit_idx, avg(x1) as mx from v_hex group by 1)", "mx")
def s04m(spark, sf):
    two = F.array(F.array(V.hex_ring()), F.array(V.hex_ring()))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("panchayat_id").alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), two.alias("coordinates")).alias("geometry")))
    feats = J.parse_features(V.units(spark, sf).select("feature_idx", text.alias("value")), order="feature_idx")
    from terracast.functions.shapes import shape_edges

    f = feats.withColumn("edges", shape_edges(J.exterior_only()))
    mx = F.aggregate("edges", F.lit(0.0), lambda acc, x: acc + x.x1) / F.size("edges")
    return f.select("feature_idx", "geometry_type", F.size("polygons").alias("n_polygons"), F.size("edges").alias("n_edges"), mx.alias("mx"))


@query("s04_collection_in_parts", """select panchayat_id, case when unit_idx%9=0 then 'UNKNOWN' else panchayat_name end as panchayat_name, 'Polygon' as geometry_type, 6::int as n_edges, x1 as first_x, y1 as first_y
    from v_unit join v_hex using (unit_idx, panchayat_id) where k=0""", "first_x first_y")
def s04c(spark, sf):
    path = scratch_path(spark, "collections")
    units = V.units(spark, sf).withColumns({"panchayat_code": F.col("panchayat_id"), "panchayat_name": F.when(F.col("feature_idx") % 9 != 0, F.col("panchayat_name"))})
    J.write_collections(units, path, V.hex_ring(), ["panchayat_code", "panchayat_name"])
    feats = J.read_collection(spark, path)
    b = J.boundary_shapes(feats)
    e = F.col("edges")[0]
    return b.select("panchayat_id", "panchayat_name", F.lit("Polygon").alias("geometry_type"), F.size("edges").alias("n_edges"), e.x1.alias("first_x"), e.y1.alias("first_y"))


@query("x12_trigonometry", "select event_id, sin(radians(value)) as s, cos(radians(value)) as c, tan(radians(value/2e0)) as t, degrees(atan(value)) as a, degrees(atan2(value,50e0)) as b, sqrt(value) as q, abs(value-50e0) as d from events", "s c t a b q d")
def x12(spark, sf):
    v = F.col("value")
    return V.table(spark, sf, "events").select(
        "event_id", F.sin(F.radians(v)).alias("s"), F.cos(F.radians(v)).alias("c"), F.tan(F.radians(v / 2.0)).alias("t"), F.degrees(F.atan(v)).alias("a"),
        F.degrees(F.atan2(v, F.lit(50.0))).alias("b"), F.sqrt(v).alias("q"), F.abs(v - 50.0).alias("d"))
