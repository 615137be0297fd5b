"""Village aggregation and serving queries (G-09, J-05, J-18, J-19, M-03, V, W-10, B-14, S-08, S-09, Q-20)."""
from __future__ import annotations

from pyspark.sql import functions as F

from terracast.functions.times import day_text
from terracast.operators import evaluate as E
from terracast.operators import serve as S
from terracast.operators import villages as G
from terracast.plans import views as V
from terracast.plans.oracle import fix, stamp
from terracast.plans.registry import query
from terracast.sources.tables import optional_table

_VCOLS = ["rain_probability_1mm", "rain_probability_10mm", "rain_probability_25mm"] + [f"rain_probability_{t}_{q}" for t in ("1mm", "10mm", "25mm") for q in ("p10", "p90")] + [f"spatial_spread_{t}" for t in ("1mm", "10mm", "25mm")]


@query("p09_training_names", "select parent as forecast_parent_id, strftime(valid_time,'%Y-%m-%d') as day, lead as lead_time_hours, forecast_temperature, forecast_humidity, forecast_rainfall from v_fcday", "forecast_temperature forecast_humidity forecast_rainfall")
def p09(spark, sf):
    f = V.daily_forecasts(spark, sf).withColumnsRenamed({"temperature": "forecast_temperature", "humidity": "forecast_humidity", "rainfall": "forecast_rainfall", "lead_time": "lead_time_hours"})
    return f.select(F.format_string("FC_GRID_%02d", "point_idx").alias("forecast_parent_id"), day_text("valid_time").alias("day"), "lead_time_hours", "forecast_temperature", "forecast_humidity", "forecast_rainfall")


@query("j05_cells_by_forecasts", "select forecast_parent_id, lead_time_hours, observation_time, count(*) as cells, sum(cell_idx)::bigint as idx_sum from v_gridp group by 1, 2, 3")
def j05(spark, sf):
    return V.grid_probabilities(spark, sf).groupBy("forecast_parent_id", "lead_time_hours", "observation_time").agg(F.count("*").alias("cells"), F.sum("cell_idx").alias("idx_sum"))


@query("m03_grid_features", "select grid_id, observation_time, lead_time_hours, forecast_temperature, forecast_rainfall, elevation_mean, day_of_year_sin, day_of_year_cos, month from v_gridp", "forecast_temperature forecast_rainfall elevation_mean day_of_year_sin day_of_year_cos")
def m03(spark, sf):
    return V.grid_probabilities(spark, sf).select("grid_id", "observation_time", "lead_time_hours", "forecast_temperature", "forecast_rainfall", "elevation_mean", "day_of_year_sin", "day_of_year_cos", "month")


@query("g09_village_rainfall", "select * from v_village", " ".join(_VCOLS))
def g09(spark, sf):
    return V.fresh_village_rain(spark, sf)


@query("g09_village_rainfall_hot_groups", "select * from v_village", " ".join(_VCOLS))
def g09hot(spark, sf):
    # a low limit sends the larger villages through the order-statistic route
    return G.village_rainfall(V.grid_probabilities(spark, sf), hot_group=100)


# ---------------------------------------------------------------- registries
@query("s08_source_fallback", """select station_id, case when station_id%3=0 then 'GP_A' else 'GP_B' end as panchayat_id, case when station_id%3=0 then 'Name A' else 'Station Host GP_B' end as panchayat_name,
    case when station_id%3=0 then 'Block A' else 'Coimbatore' end as block_name, latitude, longitude, station_elevation, case when station_id%3=0 then 1 else 2 end as priority from v_station""", "latitude longitude station_elevation")
def s08(spark, sf):
    st = V.stations(spark, sf)
    first = st.filter("station_id % 3 = 0").withColumns({"panchayat_id": F.lit("GP_A"), "panchayat_name": F.lit("Name A"), "block_name": F.lit("Block A")})
    other = st.withColumn("panchayat_id", F.lit("GP_B")).withColumnsRenamed({"latitude": "latitude_obs", "longitude": "longitude_obs"})
    return S.station_registry(first, other)


@query("v02_station_registry", "select station_id, panchayat_id, 'Station Host '||panchayat_id as panchayat_name, 'Coimbatore' as block_name, latitude, longitude, station_elevation from v_station join v_site using (station_id)", "latitude longitude station_elevation")
def v02(spark, sf):
    m = V.matchups(spark, sf).select("station_id", "panchayat_id", "latitude_obs", "longitude_obs", "station_elevation")
    return S.station_registry(None, m).drop("priority")


@query("v01_village_profiles", "select * from v_profile join v_profst using (panchayat_id)", "latitude longitude elevation_mean area_sq_km nearest_station_distance_km")
def v01(spark, sf):
    return S.village_table(V.village_polygons(spark, sf), V.master(spark, sf), V.stations(spark, sf))


@query("v01_villages_from_predictions", "select distinct 'GP_'||lpad(cast(user_id%40 as varchar),4,'0') as panchayat_id, 'Panchayat GP_'||lpad(cast(user_id%40 as varchar),4,'0') as panchayat_name, 'Coimbatore' as block_name, 'Coimbatore' as district_name, 11e0 as latitude, 77e0 as longitude, 400e0 as elevation_mean from events", "latitude longitude elevation_mean")
def v01p(spark, sf):
    preds = V.matchups(spark, sf).select("panchayat_id")
    return S.village_table(None, None, None, preds).drop("area_sq_km", "grid_cell_count", "assignment_mode")


# ---------------------------------------------------------------- station weather
_MT = "case when ml_temperature is null then 'Temperature value is missing' when ml_temperature < -10 or ml_temperature > 60 then printf('Temperature %.2f°C out of valid physical range [-10, 60]', ml_temperature) end"
_MH = "case when ml_humidity is null then 'Humidity value is missing' when ml_humidity < 0 or ml_humidity > 100 then printf('Humidity %.2f%% out of valid physical range [0, 100]', ml_humidity) end"


@query("v03_weather_record", f"""select event_id, lead_time_hours, ml_temperature, q10_temperature, humidity_interval_width, null::double as b1_temperature, 'MEDIUM' as temperature_reliability, 'LOW' as humidity_reliability,
    nullif(concat_ws(' | ', {_MT}, {_MH}), '') is null as is_valid, nullif(concat_ws(' | ', {_MT}, {_MH}), '') is not null and {_MT} is not null as bad_temperature from v_int""", "ml_temperature q10_temperature humidity_interval_width b1_temperature")
def v03(spark, sf):
    r = S.weather_record(V.intervals(spark, sf))
    bad_t = F.coalesce(F.col("validation_error").contains("Temperature"), F.lit(False))
    return r.select("event_id", "lead_time_hours", "ml_temperature", "q10_temperature", "humidity_interval_width", "b1_temperature", "temperature_reliability", "humidity_reliability", "is_valid", bad_t.alias("bad_temperature"))


@query("v06_ladder_rows", " union all ".join(f"select event_id, lead_time_hours, '{m}' as model, {c} as value from v_int where {c} is not null" for m, c in {"B0": "b0_temperature", "B2": "b2_temperature", "B3": "b3_temperature", "ML": "ml_temperature", "OBSERVED": "observed_temperature"}.items()), "value")
def v06(spark, sf):
    return S.ladder_rows(V.intervals(spark, sf), "temperature", ["event_id", "lead_time_hours"])


# ---------------------------------------------------------------- village rain
@query("b14_evaluability_gate", """select bool_or(rainfall>=1 and seen) as is_evaluable_1mm, bool_or(rainfall>=10 and seen) as is_evaluable_10mm, bool_or(rainfall>=25 and seen) as is_evaluable_25mm from (select observed_rainfall as rainfall, split in ('TRAIN','CALIBRATION') as seen from v_match)""")
def b14(spark, sf):
    return S.evaluable_thresholds(E.rain_labels(V.matchups(spark, sf)))


@query("v04_rainfall_record", """select panchayat_id, "timestamp", lead_time, rain_probability_1mm, null::double as rain_probability_10mm, null::double as rain_probability_25mm, spatial_spread_1mm, grid_cell_count, aggregation_status, false as is_evaluable_10mm, false as is_evaluable_25mm, true as is_valid from v_village""",
    "rain_probability_1mm rain_probability_10mm rain_probability_25mm spatial_spread_1mm")
def v04(spark, sf):
    r = S.rainfall_record(V.village_rain(spark, sf))
    return r.select("panchayat_id", "timestamp", "lead_time", *[f"rain_probability_{t}" for t in ("1mm", "10mm", "25mm")], "spatial_spread_1mm", "grid_cell_count", "aggregation_status", "is_evaluable_10mm", "is_evaluable_25mm", "is_valid")


@query("w10_rain_series", 'select panchayat_id, lead_time, "timestamp", rain_probability_1mm*100e0 as pct from v_village', "pct")
def w10(spark, sf):
    r = V.village_rain(spark, sf)
    return r.select("panchayat_id", "lead_time", "timestamp", (F.col("rain_probability_1mm") * 100.0).alias("pct")).orderBy("panchayat_id", "lead_time", "timestamp")


@query("v07_rain_timeline", """select panchayat_id, lead_time, string_agg("timestamp"||'='||cast(cast(floor(rain_probability_1mm*1e6+0.5003e0) as bigint) as varchar), ';' order by "timestamp") as series from v_village group by 1, 2""")
def v07(spark, sf):
    t = S.rain_timeline(V.village_rain(spark, sf))
    text = F.transform("series", lambda s: F.concat(s["timestamp"], F.lit("="), F.floor(s["pct"] / 100.0 * 1e6 + 0.5003).cast("string")))
    return t.select("panchayat_id", "lead_time", F.array_join(text, ";").alias("series"))


@query("j18_village_map_join", f"""select p.panchayat_id, p.panchayat_name, {fix('coalesce(v.rain_probability_1mm,0e0)*100e0', 1)} as rain_prob_pct, coalesce(v.aggregation_status,'OK') as status from v_profile p
    left join (select * from v_village where lead_time=24 and "timestamp"=(select max(day) from v_testday)) v using (panchayat_id)""", "rain_prob_pct")
def j18(spark, sf):
    return _map(spark, sf).select("panchayat_id", "panchayat_name", "rain_prob_pct", "status")


def _map(spark, sf):
    rain = V.village_rain(spark, sf).filter("lead_time = 24")
    last = V.test_dates(spark, sf).agg(F.max("observation_time").alias("timestamp"))
    villages = S.village_table(V.village_polygons(spark, sf), V.master(spark, sf))
    return S.map_table(villages, rain.join(F.broadcast(last), "timestamp"), "GP_0007")


@query("v08_map_table", f"""select p.panchayat_id, p.panchayat_name, p.block_name, p.latitude, p.longitude, p.elevation_mean as elevation, {fix('coalesce(v.rain_probability_1mm,0e0)*100e0', 1)} as rain_prob_pct, coalesce(v.aggregation_status,'OK') as status, p.panchayat_id='GP_0007' as is_selected from v_profile p
    left join (select * from v_village where lead_time=24 and "timestamp"=(select max(day) from v_testday)) v using (panchayat_id)""", "latitude longitude elevation rain_prob_pct")
def v08(spark, sf):
    return _map(spark, sf)


_VIEW = """select v.panchayat_id, v."timestamp", v.lead_time, v.rain_probability_1mm, v.grid_cell_count, p.panchayat_name, s.nearest_station_id, w.ml_temperature, w.ml_humidity, coalesce(w.ok, false) as weather_valid, null::varchar as reliability_level
    from v_village v join v_profile p using (panchayat_id) join v_profst s using (panchayat_id) left join v_weather w on w.station_id=s.nearest_station_id and w.day=v."timestamp" and w.lead_time_hours=v.lead_time"""


def _view(spark, sf):
    villages = S.village_table(V.village_polygons(spark, sf), V.master(spark, sf), V.stations(spark, sf))
    w = S.weather_record(V.intervals(spark, sf)).filter("ml_temperature is not null and ml_humidity is not null")
    w = w.select("station_id", day_text("observation_time").alias("observation_date"), "lead_time_hours", "observation_time", "event_id", "ml_temperature", "ml_humidity", "is_valid")
    latest = S.latest_per_key(w, ["station_id", "observation_date", "lead_time_hours"], ["observation_time", "event_id"])
    from terracast.sources.tables import text_schema
    from terracast.session import shared_dir

    none = optional_table(spark, f"{shared_dir(spark)}/terracast/no-reliability-table", text_schema(["panchayat_id", "reliability_level"]))
    return S.village_view(villages, V.village_rain(spark, sf), latest, none)


@query("j19_village_view_join", f"select panchayat_id, \"timestamp\", lead_time, nearest_station_id, ml_temperature, weather_valid from ({_VIEW})", "ml_temperature")
def j19(spark, sf):
    v = _view(spark, sf)
    return v.select("panchayat_id", "timestamp", "lead_time", "nearest_station_id", "ml_temperature", F.coalesce("weather_valid", F.lit(False)).alias("weather_valid"))


@query("v05_village_view", _VIEW, "rain_probability_1mm ml_temperature ml_humidity")
def v05(spark, sf):
    v = _view(spark, sf).withColumn("weather_valid", F.coalesce("weather_valid", F.lit(False)))
    return v.select("panchayat_id", "timestamp", "lead_time", "rain_probability_1mm", "grid_cell_count", "panchayat_name", "nearest_station_id", "ml_temperature", "ml_humidity", "weather_valid", "reliability_level")


@query("s09_optional_artifact", "select event_id, null::varchar as reliability_level from v_obs")
def s09(spark, sf):
    from terracast.sources.tables import text_schema
    from terracast.session import shared_dir

    none = optional_table(spark, f"{shared_dir(spark)}/terracast/no-such-table", text_schema(["station_id", "reliability_level"]))
    return V.observations(spark, sf).select("event_id", F.col("station_id").cast("string").alias("station_id")).join(none, "station_id", "left").select("event_id", "reliability_level")


@query("v09_available_dates", """select distinct "timestamp" as date from v_village""")
def v09(spark, sf):
    return S.available_dates(V.village_rain(spark, sf))


@query("v09_lead_times", "select distinct lead_time::int as lead_time from v_village")
def v09leads(spark, sf):
    return S.available_leads(V.village_rain(spark, sf))


@query("v09_leads_from_weather", "select distinct lead_time_hours::int as lead_time from v_match")
def v09leads_weather(spark, sf):
    return S.available_leads(None, V.matchups(spark, sf))


@query("v09_dates_from_weather", f"select distinct {stamp('observation_time')} as date from v_match")
def v09w(spark, sf):
    return S.available_dates(None, V.matchups(spark, sf))


@query("q20_system_status", f"""select unnest(['weather','rainfall','reliability']) as artifact, unnest([true,true,false]) as available, {stamp('max("timestamp")')} as latest_timestamp,
    case when date_sub('hour', max("timestamp"), timestamp '2024-02-01 00:00:00') <= 24 then 'FRESH' when date_sub('hour', max("timestamp"), timestamp '2024-02-01 00:00:00') <= 72 then 'AGING' else 'EXPIRED' end as freshness from v_obs""")
def q20(spark, sf):
    o = V.observations(spark, sf)
    return S.system_status(spark, {"weather": o, "rainfall": o, "reliability": None}, ("weather", "timestamp"), as_of="2024-02-01 00:00:00")
