"""Source and sink round trips (S-01, S-06, S-07, K, Q-22, X-03, X-05, X-10, P-10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.times import lead_hours
from terracast.operators import quality as Q
from terracast.operators import spatial
from terracast.plans import queries_space  # noqa: F401  (defines v_features)
from terracast.plans import views as V
from terracast.plans.queries_quality import _OBS_CHECKS, _QC5, _REPORT, RAW_COLS
from terracast.plans.registry import query
from terracast.session import scratch_path
from terracast.sources import geojson as J
from terracast.sources import sinks as K
from terracast.sources import tables as S


# ---------------------------------------------------------------- sources
@query("s01_csv_scan", "select event_id::varchar as event_id, station_id, \"timestamp\", humidity is null as no_humidity, try_cast(rainfall as double) as rainfall from v_raw", "rainfall")
def s01(spark, sf):
    path = K.write_table(V.raw_observations(spark, sf), scratch_path(spark, "observations-csv"), "csv")
    raw = S.read_csv(spark, path, ["event_id", *RAW_COLS])
    return raw.select("event_id", "station_id", "timestamp", F.col("humidity").isNull().alias("no_humidity"), F.col("rainfall").try_cast("double").alias("rainfall"))


def _swept(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "event_type")
    path = scratch_path(spark, "sweep")
    V.raw_observations(spark, sf).join(e, "event_id").write.partitionBy("event_type").option("header", True).csv(path)
    return S.sweep(spark, path, "*.csv", ["event_id", *RAW_COLS])


@query("s06_directory_sweep", """select event_type, sum(null_station)::bigint as null_station, sum(bad_time)::bigint as bad_time from (select event_type, (station_id is null)::int as null_station, ("timestamp" is not null and t is null)::int as bad_time from v_typed join events using (event_id)) group by 1""")
def s06(spark, sf):
    rows = Q.observation_checks(_swept(spark, sf), ["source_file"])
    kind = F.regexp_extract("source_file", "event_type=([^/]+)/", 1).alias("event_type")
    n = lambda c: F.sum(F.when(F.col("check_id") == c, F.col("n_bad")))
    return rows.groupBy(kind).agg(n("null_station_id").alias("null_station"), n("unparseable_timestamp").alias("bad_time"))


@query("q22_file_formats", "select event_type, 'csv' as extension, 'OK' as severity from events group by 1")
def q22(spark, sf):
    f = Q.format_checks(_swept(spark, sf), "source_file", ("csv",))
    return f.select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("event_type"), "extension", "severity").distinct()


@query("s07_json_artifact", f"select dataset_name, status, record_count, n_errors, true as missing_is_skipped from ({_REPORT})")
def s07(spark, sf):
    raw = V.raw_observations(spark, sf).select(*RAW_COLS)
    path = K.write_report(Q.dataset_report(raw, C.OBSERVATIONS, Q.observation_checks(raw)), scratch_path(spark, "reports"), "observations")
    back = S.read_json_artifact(spark, path)
    skipped = S.read_json_artifact(spark, path + "-absent") is None
    return back.select("dataset_name", "status", "record_count", F.size("errors").cast("bigint").alias("n_errors"), F.lit(skipped).alias("missing_is_skipped"))


# ---------------------------------------------------------------- sinks
@query("k01_processed_table", f"select event_id, temperature, qc_temperature, qc_wind_speed from v_raw join ({_QC5}) using (event_id)".replace("select event_id, temperature,", "select event_id, try_cast(temperature as double) as temperature,"), "temperature")
def k01(spark, sf):
    path = K.write_table(Q.with_qc(V.raw_observations(spark, sf)), scratch_path(spark, "processed"))
    return spark.read.parquet(path).select("event_id", F.col("temperature").try_cast("double").alias("temperature"), "qc_temperature", "qc_wind_speed")


@query("k02_feature_family", """select unnest(['master','terrain','landcover','hydro','forecast_grid']) as part, unnest([n,n,n,n,n]) as n, unnest([40,15,9,2,3]) as n_columns, unnest([k,k,k,k,k]) as n_keys,
    unnest([z,z,c,w,d]) as total from (select count(*) as n, count(distinct grid_id) as k, sum(elevation_mean) as z, sum(landcover_fraction_water) as c, sum(distance_to_nearest_water) as w, sum(distance_to_forecast_grid_m) as d from v_features)""", "total")
def k02(spark, sf):
    paths = K.write_feature_family(V.master(spark, sf), scratch_path(spark, "features"))
    sums = {"master": "elevation_mean", "terrain": "elevation_mean", "landcover": "landcover_fraction_water", "hydro": "distance_to_nearest_water", "forecast_grid": "distance_to_forecast_grid_m"}
    out = None
    for part, column in sums.items():
        t = spark.read.parquet(paths[part])
        row = t.agg(F.count("*").alias("n"), F.count_distinct("grid_id").alias("n_keys"), F.sum(column).alias("total")).select(F.lit(part).alias("part"), "n", F.lit(len(t.columns)).alias("n_columns"), "n_keys", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("k03_geojson_cells", "select grid_id, 'Polygon' as geometry_type, 4::int as n_edges, min_x, max_y from v_grid", "min_x max_y")
def k03(spark, sf):
    path = scratch_path(spark, "cells-geojson")
    K_props = ["grid_id", "latitude", "longitude"]
    J.write_feature_lines(V.grid(spark, sf), path, spatial.cell_ring(), K_props)
    from terracast.functions.shapes import box_of, shape_edges

    f = J.read_feature_lines(spark, path).select(J.prop("grid_id").alias("grid_id"), "geometry_type", shape_edges("polygons").alias("edges"))
    b = box_of("edges")
    return f.select("grid_id", "geometry_type", F.size("edges").alias("n_edges"), b["x1"].alias("min_x"), b["y2"].alias("max_y"))


@query("k04_vector_layer", "select unit_idx as feature_idx, panchayat_id, 6::int as n_edges, true as empty_skipped from v_unit")
def k04(spark, sf):
    layer = V.shapes(spark, sf)
    path = K.write_layer(layer, scratch_path(spark, "layer"))
    skipped = K.write_layer(layer.filter("feature_idx < 0"), scratch_path(spark, "empty")) is None
    return spark.read.parquet(path).select("feature_idx", "panchayat_id", F.size("edges").alias("n_edges"), F.lit(skipped).alias("empty_skipped"))


@query("k05_raster_table", "select r//256 as row_band, count(*) as n, sum(z) as total from v_pixel group by 1".replace("r//256", "(r//256)::int"), "total")
def k05(spark, sf):
    path = K.write_raster(V.pixels(spark, sf), scratch_path(spark, "raster"))
    return spark.read.parquet(path).groupBy("row_band").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("k06_json_report", f"select dataset_name, status as processing_status, record_count, min_lat, start_date from ({_REPORT})", "min_lat")
def k06(spark, sf):
    raw = V.raw_observations(spark, sf).select(*RAW_COLS)
    meta = Q.metadata_record(Q.dataset_report(raw, C.OBSERVATIONS, Q.observation_checks(raw)), C.OBSERVATIONS)
    path = K.write_report(meta, scratch_path(spark, "metadata"), "observations")
    return spark.read.json(path).select("dataset_name", "processing_status", "record_count", "validation_summary.spatial_extent.min_lat", "temporal_coverage.start_date")


_PRED = ["event_id", "lead_time_hours", "ml_temperature", "split"]


@query("k07_prediction_export", "select event_id, lead_time_hours, ml_temperature, split, true as strict from v_int", "ml_temperature")
def k07(spark, sf):
    m = V.intervals(spark, sf)
    path = K.write_predictions(m, scratch_path(spark, "predictions"), _PRED)
    try:
        K.strict_columns(m, [*_PRED, "no_such_column"])
        strict = False
    except ValueError:
        strict = True
    return spark.read.parquet(path).select(*_PRED, F.lit(strict).alias("strict"))


@query("k08_matchup_export", "select split, count(*) as n, 28 as n_columns, sum(b2_temperature) as total from v_match group by 1".replace("28 as", "28::int as"), "total")
def k08(spark, sf):
    path = K.write_matchups(V.matchups(spark, sf), scratch_path(spark, "matchups"))
    t = spark.read.parquet(path)
    return t.groupBy("split").agg(F.count("*").alias("n"), F.sum("b2_temperature").alias("total")).withColumn("n_columns", F.lit(len(t.columns)))


@query("k09_model_store", "select event_id, lead_time_hours, true as same from v_match")
def k09(spark, sf):
    from pyspark.ml import PipelineModel

    from terracast.operators import models as M
    from terracast.plans.queries_models import _residual

    f, feats, model = _residual(spark, sf)
    path = K.save_model(model, scratch_path(spark, "model"), feats, {"target": "temperature", "seed": "42"}, spark)
    again = [r["feature"] for r in spark.read.json(f"{path}/features").orderBy("position").collect()]
    back = PipelineModel.load(f"{path}/model")
    a = M.predict_residual(model, f, feats, "temperature", "b2_temperature").withColumnRenamed("ml_temperature", "first")
    b = M.predict_residual(back, a.drop("predicted_temperature_residual"), again, "temperature", "b2_temperature")
    return b.select("event_id", "lead_time_hours", (F.col("first") == F.col("ml_temperature")).alias("same"))


# ---------------------------------------------------------------- text and time helpers
@query("x03_path_parts", "select page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) as extension, regexp_extract(url, '([^/]*)$', 1) as name from pages")
def x03(spark, sf):
    p = V.table(spark, sf, "pages")
    return p.select("page_id", F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.regexp_extract("url", "([^/]*)$", 1).alias("name"))


@query("x05_prefix_columns", f"select event_id, qc_temperature, qc_humidity, qc_rainfall, qc_pressure, qc_wind_speed from ({_QC5})")
def x05(spark, sf):
    q = Q.with_qc(V.raw_observations(spark, sf))
    return q.select("event_id", *[c for c in q.columns if c.startswith("qc_")])


@query("x10_lead_definition", "select lead as lead_time, count(*) as n, min(date_sub('hour', issue_time, valid_time))::int as min_lead, max(date_sub('hour', issue_time, valid_time))::int as max_lead from v_fc group by 1")
def x10(spark, sf):
    f = V.forecasts(spark, sf)
    h = lead_hours("forecast_issue_time", "valid_time")
    return f.groupBy("lead_time").agg(F.count("*").alias("n"), F.min(h).alias("min_lead"), F.max(h).alias("max_lead"))


@query("p10_time_alias", "select count(*) filter (observation_time = valid_time) as n_equal, count(*) as n from v_match")
def p10(spark, sf):
    m = V.matchups(spark, sf)
    return m.agg(F.count_if(F.col("observation_time") == F.col("timestamp")).alias("n_equal"), F.count("*").alias("n"))
