"""Weather-shaped views over the given tables (the inputs of the registered queries)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.numbers import settle
from terracast.operators import baselines, matchup, quality, spatial
from terracast.session import spread, stored_table

SPLITS = C.SplitWindows("2024-01-15 23:00:00", "2024-01-22 23:00:00")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lat(u) -> Column:
    return F.lit(10.20) + ((u * 37) % 120) / F.lit(100.0)


def _lon(u) -> Column:
    return F.lit(76.60) + ((u * 53) % 70) / F.lit(100.0)


def _elev(u) -> Column:
    return (F.lit(200) + (u * 97) % 1800).cast("double")


def stations(spark, sf) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf, "events").select("user_id").distinct().select(
        u.alias("station_id"), _lat(u).alias("latitude"), _lon(u).alias("longitude"), _elev(u).alias("station_elevation"))


def observations(spark, sf, dealt: bool = False) -> DataFrame:
    u, v, e = F.col("user_id"), F.col("value"), F.col("event_id")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return (spread(events) if dealt else events).select(
        "event_id", u.alias("station_id"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("timestamp"),
        _lat(u).alias("latitude"), _lon(u).alias("longitude"), _elev(u).alias("station_elevation"),
        F.when(e % 19 != 0, settle(v * 0.6 - 20.0, 2)).alias("temperature"),
        F.when(e % 23 != 0, settle((v * 3.7) % F.lit(108.0), 2)).alias("humidity"),
        settle(F.greatest(v - 60.0, F.lit(0.0)) / 4.0, 2).alias("rainfall"),
    )


def _points() -> list[tuple[int, float, float]]:
    lats, lons = [10.3, 10.6, 10.9, 11.2], [76.7, 76.9, 77.1]
    return [(i * len(lons) + j + 1, la, lo) for i, la in enumerate(lats) for j, lo in enumerate(lons)]


def forecasts(spark, sf) -> DataFrame:
    """Hourly forecasts at 12 coarse points for three leads."""
    hours = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("valid_time")).agg(
        F.avg(F.col("value") * 0.6 - 20.0).alias("t"))
    pts = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(la).alias("la"), F.lit(lo).alias("lo")) for i, la, lo in _points()])
    rows = hours.select("valid_time", "t", F.explode(pts).alias("p")).select("*", F.explode(F.array(*[F.lit(h) for h in C.LEADS])).alias("lead_time"))
    return rows.select(
        F.col("p.idx").alias("point_idx"), F.format_string("FC_GRID_%02d", "p.idx").alias("forecast_parent_id"),
        F.col("p.la").alias("latitude"), F.col("p.lo").alias("longitude"), "valid_time", "lead_time",
        (F.col("valid_time") - F.make_dt_interval(F.lit(0), F.col("lead_time"))).alias("forecast_issue_time"),
        settle(F.col("t") + F.col("p.idx") * 0.3 + F.col("lead_time") * 0.01, 2).alias("temperature"),
        F.least(F.lit(100.0), settle(F.lit(40.0) + F.col("t") + F.col("p.idx"), 2)).alias("humidity"),
        settle(F.greatest(F.col("t") - 10.0, F.lit(0.0)) / 10.0, 2).alias("rainfall"),
    )


def standard_forecasts(spark, sf) -> DataFrame:
    return forecasts(spark, sf).withColumnsRenamed({
        "temperature": "forecast_temperature", "humidity": "forecast_humidity", "rainfall": "forecast_rainfall", "lead_time": "lead_time_hours"})


def sites(spark, sf) -> DataFrame:
    """Station -> parent, cell, cell height, group (the look-up table of the matchup)."""
    p = F.col("station_id") % 12 + 1
    return stations(spark, sf).select(
        "station_id", F.format_string("FC_GRID_%02d", p).alias("forecast_parent_id"), F.format_string("GRID_%05d", F.col("station_id") + 1).alias("grid_id"),
        F.format_string("GP_%04d", F.col("station_id") % 40).alias("panchayat_id"), (p * 25.0 + 300.0).alias("grid_elevation"),
        F.concat(F.lit("GROUP_"), F.col("station_id").cast("string")).alias("station_group"),
    )


def checked(spark, sf, dealt: bool = False) -> DataFrame:
    """Observations with value classes and row status, in standard names."""
    obs = quality.with_row_status(quality.with_qc(observations(spark, sf, dealt), ["temperature", "humidity", "rainfall"]))
    return obs.withColumnsRenamed({f"{v}": f"observed_{v}" for v in ("temperature", "humidity", "rainfall")})


def matchups(spark, sf, dealt: bool = False) -> DataFrame:
    """Matched rows with B0, B2, residuals and split; obs x 3 leads. `dealt`: worked on by tasks of equal size."""
    fc = standard_forecasts(spark, sf).drop("latitude", "longitude", "point_idx")
    m = matchup.match(checked(spark, sf, dealt), fc, sites(spark, sf), SPLITS, ["grid_id", "panchayat_id", "grid_elevation", "station_group"])
    return baselines.residuals(baselines.lapse_rate(baselines.coarse(m)))


def intervals(spark, sf) -> DataFrame:
    """Matchups with quantile forecasts around B2 that widen with the lead."""
    m = matchups(spark, sf)
    lead = F.col("lead_time_hours")
    out = m.withColumns({
        "q10_temperature": F.col("b2_temperature") - (lead / 12.0 + 8.0), "q50_temperature": F.col("b2_temperature") - 0.5,
        "q90_temperature": F.col("b2_temperature") + (lead / 8.0 + 6.0),
        "q10_humidity": F.col("b2_humidity") - (lead / 6.0 + 20.0), "q50_humidity": F.col("b2_humidity") + 1.0,
        "q90_humidity": F.col("b2_humidity") + (lead / 4.0 + 15.0),
        "b3_temperature": F.col("b2_temperature") + 1.5, "ml_temperature": F.col("b2_temperature") * 0.75 + 1.0,
        "b3_humidity": F.col("b2_humidity") - 2.5, "ml_humidity": F.col("b2_humidity") * 0.9 + 3.0,
    })
    return out.withColumns({
        "temperature_interval_width": F.col("q90_temperature") - F.col("q10_temperature"),
        "humidity_interval_width": F.col("q90_humidity") - F.col("q10_humidity"),
    })


def pixels(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    codes = F.array(*[F.lit(c) for c in (10, 20, 30, 40, 50, 60, 80)])
    return table(spark, sf, "part").select(
        F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), (F.col("p_retailprice") / 3.0).alias("value"),
        F.element_at(codes, ((k * 7919) % 7 + 1).cast("int")).alias("cls"))


RASTER_BOX = {"min_lon": 76.60, "max_lon": 77.30, "min_lat": 10.20, "max_lat": 11.40}


def probabilities(spark, sf) -> DataFrame:
    """Probability forecasts with truth; two labels, raw and damped probabilities."""
    d, l = table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels")
    p = ((F.col("doc_id") * 7919) % 1000) / F.lit(1000.0)
    return d.join(l, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), F.col("toxic").alias("y2"), p.alias("p"),
                                      (p * 0.8 + 0.1).alias("p_cal"))


def units(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.alias("feature_idx"), F.format_string("GP_%04d", s).alias("panchayat_id"), F.col("s_name").alias("panchayat_name"),
        F.format_string("BLOCK_%02d", "s_nationkey").alias("block_name"), F.lit("Coimbatore").alias("district_name"),
        (F.lit(76.70) + ((s * 31) % 50) / F.lit(100.0)).alias("cx"), (F.lit(10.35) + ((s * 17) % 95) / F.lit(100.0)).alias("cy"),
        (F.lit(0.03) + F.lit(0.004) * (s % 4)).alias("rad"),
    )


def hex_ring() -> Column:
    """Closed hexagon around (cx, cy) as ARRAY<ARRAY<DOUBLE>>, rounded to 6 decimals."""
    pt = lambda k: F.array(settle(F.col("cx") + F.col("rad") * F.cos(F.lit(k * math.pi / 3.0)), 6), settle(F.col("cy") + F.col("rad") * F.sin(F.lit(k * math.pi / 3.0)), 6))
    return F.array(*[pt(k % 6) for k in range(7)])


def shapes(spark, sf) -> DataFrame:
    from terracast.functions.shapes import shape_edges

    u = units(spark, sf).withColumn("polygons", F.array(F.array(hex_ring())))
    return u.select("feature_idx", "panchayat_id", "panchayat_name", "block_name", "district_name", "polygons", shape_edges("polygons").alias("edges"))


def extent(spark, sf) -> DataFrame:
    """Bounding box of the stations: one row."""
    return stations(spark, sf).agg(F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"))


def fresh_grid(spark, sf) -> DataFrame:
    return spatial.metric_grid(extent(spark, sf))


def grid(spark, sf) -> DataFrame:
    """The stored grid that the feature stages read."""
    return stored_table(spark, (sf, "grid"), lambda: fresh_grid(spark, sf))


def point_registry(spark, sf) -> DataFrame:
    return spatial.point_registry(forecasts(spark, sf))


def raw_observations(spark, sf) -> DataFrame:
    """Observations as text, with unreadable and missing values among them."""
    e = F.col("event_id")
    t = table(spark, sf, "events")
    u, v = F.col("user_id"), F.col("value")
    text = lambda c: c.cast("string")
    return t.select(
        "event_id", F.when(e % 29 != 0, F.concat(F.lit("ST"), text(u))).alias("station_id"),
        F.when(e % 17 == 0, "not-a-date").when(e % 13 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(e % 31 == 0, "abc").when(e % 37 != 0, text(_lat(u) + F.when(e % 997 == 0, 30.0).otherwise(0.0))).alias("latitude"),
        F.when(e % 43 == 0, "-").when(e % 41 != 0, text(_lon(u))).alias("longitude"),
        F.when(e % 41 == 0, "n/a").when(e % 19 != 0, text(v * 0.6 - 20.0)).alias("temperature"),
        F.when(e % 23 != 0, text((v * 3.7) % F.lit(108.0))).alias("humidity"),
        F.when(e % 7 != 0, text(F.greatest(v - 60.0, F.lit(0.0)) * 12.0)).alias("rainfall"),
        F.when(e % 2 == 0, text(v * 2.5 + 860.0)).alias("pressure"), F.when(e % 5 != 0, text(v * 1.5 - 20.0)).alias("wind_speed"),
        F.when(e % 11 != 0, text(_elev(u))).alias("station_elevation"),
    )


def raw_forecasts(spark, sf) -> DataFrame:
    """Order and ship dates as issue and valid times, in both orders, with unreadable leads."""
    o, l = table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf, "lineitem")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    lead = F.timestamp_diff("HOUR", F.col("o_orderdate").cast("timestamp_ntz"), F.col("l_shipdate").cast("timestamp_ntz"))
    return j.select(
        F.when(k % 53 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("forecast_issue_time"),
        F.when(k % 59 != 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("valid_time"),
        F.when(k % 61 == 0, "x").otherwise(lead.cast("string")).alias("lead_time"),
        (F.lit(10.0) + F.col("l_suppkey") % 4).cast("string").alias("latitude"),
        (F.lit(76.0) + F.col("l_suppkey") % 3).cast("string").alias("longitude"),
        F.col("l_quantity").cast("string").alias("temperature"), F.when(k % 3 != 0, (F.col("l_tax") * 1000.0).cast("string")).alias("humidity"),
        F.when(k % 5 != 0, (F.col("l_discount") * 100.0).cast("string")).alias("rainfall"),
    )


def projected_shapes(spark, sf) -> DataFrame:
    """The unit polygons with their corners in metres (the water layer of the distance join)."""
    from terracast.functions.geodesy import project_points
    from terracast.functions.shapes import ring_edges

    pts = units(spark, sf).select("feature_idx", F.posexplode(hex_ring()).alias("k", "p")).select("feature_idx", "k", F.col("p")[0].alias("lo"), F.col("p")[1].alias("la"))
    xy = project_points(pts, "lo", "la")
    ring = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.struct(s.x.alias("x"), s.y.alias("y")))
    return xy.groupBy("feature_idx").agg(ring.alias("ring")).select("feature_idx", ring_edges("ring").alias("edges"))


def cell_pixels(spark, sf, cells: DataFrame | None = None) -> DataFrame:
    from terracast.operators import raster

    cells = grid(spark, sf) if cells is None else cells
    return raster.pixel_of(cells, raster.raster_header(pixels(spark, sf)), RASTER_BOX)


def fresh_master(spark, sf) -> DataFrame:
    """The grid with every feature family, each joined to the stored grid."""
    from terracast.operators import raster

    g = grid(spark, sf)
    px = cell_pixels(spark, sf, g)
    terr = raster.terrain_features(px, raster.terrain(pixels(spark, sf)))
    cover = raster.landcover_features(px, pixels(spark, sf).select("row", "col", F.col("cls").alias("value")))
    parents = spatial.nearest_forecast_point(g, point_registry(spark, sf)).select("grid_id", "forecast_parent_id", "distance_to_forecast_grid_m")
    villages = spatial.assign_villages(g, shapes(spark, sf)).select("grid_id", "panchayat_id", "panchayat_name", "block_name", "district_name", "assignment_mode")
    water = spatial.shape_distance(g.select("grid_id", "centroid_x", "centroid_y"), projected_shapes(spark, sf), "centroid_x", "centroid_y", "feature_idx",
                                   out="distance_to_nearest_water").select("grid_id", "distance_to_nearest_water")
    out = g
    for part in (villages, terr, cover, water, parents):
        out = out.join(part, "grid_id", "left")
    return out


def daily_forecasts(spark, sf) -> DataFrame:
    """One forecast per day, point and lead: the day's mean, valid at midnight."""
    day = F.date_trunc("day", F.col("valid_time")).cast("timestamp_ntz")
    f = forecasts(spark, sf).groupBy("point_idx", "latitude", "longitude", day.alias("valid_time"), "lead_time")
    return f.agg(settle(F.avg("temperature"), 2).alias("temperature"), settle(F.avg("humidity"), 2).alias("humidity"), settle(F.avg("rainfall"), 2).alias("rainfall"))


def test_dates(spark, sf) -> DataFrame:
    """Dates of the TEST observations."""
    o = observations(spark, sf).select("timestamp", matchup.split_label("timestamp", SPLITS).alias("split"))
    return o.filter("split = 'TEST'").select(F.date_format("timestamp", "yyyy-MM-dd").alias("observation_time")).distinct()


def master(spark, sf) -> DataFrame:
    return stored_table(spark, (sf, "master"), lambda: fresh_master(spark, sf))


def stored_matchups(spark, sf) -> DataFrame:
    """The stored matchups that the baseline ladder reads."""
    return stored_table(spark, (sf, "matchups"), lambda: matchups(spark, sf))


def stored_forecasts(spark, sf) -> DataFrame:
    return stored_table(spark, (sf, "forecasts"), lambda: standard_forecasts(spark, sf))


def grid_probabilities(spark, sf) -> DataFrame:
    """Every cell on every TEST date and lead with three probabilities."""
    from terracast.operators import villages

    f = villages.grid_features(master(spark, sf), daily_forecasts(spark, sf), test_dates(spark, sf), point_registry(spark, sf))
    p = ((F.col("cell_idx") * 37 + F.col("lead_time_hours") + F.dayofmonth(F.to_date("observation_time")) * 11) % 1000) / F.lit(1000.0)
    return f.withColumn("prob_1mm", p).withColumns({"prob_10mm": F.col("prob_1mm") * 0.4, "prob_25mm": F.col("prob_1mm") * F.col("prob_1mm")})


def fresh_village_rain(spark, sf) -> DataFrame:
    from terracast.operators import villages

    bound = villages.cells_per_village(master(spark, sf)).first()["max_cells"]
    return villages.village_rainfall(grid_probabilities(spark, sf), largest=bound)


def village_rain(spark, sf) -> DataFrame:
    """The stored village forecasts that the serving stage reads."""
    return stored_table(spark, (sf, "village_rain"), lambda: fresh_village_rain(spark, sf))


def village_polygons(spark, sf) -> DataFrame:
    """Polygon attributes with the mean of the ring points as centre."""
    from terracast.functions.shapes import vertex_mean

    s = shapes(spark, sf).withColumn("m", vertex_mean("edges"))
    return s.select("panchayat_id", "panchayat_name", "block_name", "district_name", F.col("m.y").alias("latitude"), F.col("m.x").alias("longitude"),
                    (F.col("feature_idx") + 0.5).alias("area_sq_km"))
