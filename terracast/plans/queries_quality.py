"""Ingest, projection and quality queries (S, P, Q, G-01..G-08)."""
from __future__ import annotations

from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions import checks, labels
from terracast.functions.numbers import half_even, to_number
from terracast.functions.times import parse_time, parsed_times
from terracast.operators import quality as Q
from terracast.plans import views as V
from terracast.plans.oracle import even, qc, stamp
from terracast.plans.registry import query
from terracast.sources import tables as S

RAW_COLS = ["station_id", "timestamp", "latitude", "longitude", "temperature", "humidity", "rainfall", "pressure", "wind_speed", "station_elevation"]


def nn(df, names):
    """Non-null count per named column, as rows."""
    row = df.agg(*[F.count(F.col(n)).alias(n) for n in names])
    return row.unpivot([], names, "field", "filled")


# ---------------------------------------------------------------- loads
@query("s03_standard_forecasts", f"""select {stamp('it')} as forecast_issue_time, {stamp('vt')} as valid_time, cast(trunc(lt) as int) as lead_time_hours, cast(latitude as double) as latitude,
    cast(longitude as double) as longitude, cast(temperature as double) as forecast_temperature, cast(humidity as double) as forecast_humidity,
    coalesce(cast(rainfall as double),0e0) as forecast_rainfall, 'REAL' as data_status from v_typedfc where it is not null and vt is not null""",
    "latitude longitude forecast_temperature forecast_humidity forecast_rainfall")
def s03(spark, sf):
    return S.standard_forecasts(V.raw_forecasts(spark, sf))


# ---------------------------------------------------------------- projections
@query("p01_column_mapping", "select event_id as record_id, station_id as stn, temperature as temp from v_raw")
def p01(spark, sf):
    raw = V.raw_observations(spark, sf).select("event_id", "station_id", "temperature")
    return Q.apply_mapping(raw, {"record_id": "event_id", "stn": "station_id", "temp": "temperature", "absent": "no_such_column"})


@query("p02_find_column", "select count(temperature) as n from v_raw")
def p02(spark, sf):
    raw = V.raw_observations(spark, sf).withColumnRenamed("temperature", "TempERATURE")
    return raw.agg(F.count(F.col(Q.find_column(raw, "temperature"))).alias("n"))


@query("p03_coercing_numbers", "select event_id, xt as temperature, la as latitude, temperature is not null and xt is null as bad_temperature from v_typed", "temperature latitude")
def p03(spark, sf):
    return V.raw_observations(spark, sf).select(
        "event_id", to_number("temperature").alias("temperature"), to_number("latitude").alias("latitude"),
        (F.col("temperature").isNotNull() & to_number("temperature").isNull()).alias("bad_temperature"))


@query("p04_coercing_times", f"""select event_id, {stamp('t')} as t, "timestamp" is not null and t is null as bad from v_typed""")
def p04(spark, sf):
    t = parse_time("timestamp")
    return V.raw_observations(spark, sf).select("event_id", t.alias("t"), (F.col("timestamp").isNotNull() & t.isNull()).alias("bad"))


@query("p05_alias_fallback", "select event_id, coalesce(xt, xh) as reading from v_typed", "reading")
def p05(spark, sf):
    return V.raw_observations(spark, sf).select("event_id", F.coalesce(to_number("temperature"), to_number("humidity")).alias("reading"))


@query("p06_default_fill", "select event_id, coalesce(xr, 0e0) as rainfall, coalesce(try_cast(station_elevation as double), 350e0) as station_elevation from v_typed", "rainfall station_elevation")
def p06(spark, sf):
    raw = V.raw_observations(spark, sf).select("event_id", to_number("rainfall").alias("rainfall"), to_number("station_elevation").alias("station_elevation"))
    return raw.fillna({"rainfall": C.DEFAULT_RAIN, "station_elevation": C.DEFAULT_ELEVATION})


@query("p07_drop_null_times", "select count(*) as n_kept from v_typedfc where it is not null and vt is not null")
def p07(spark, sf):
    raw = parsed_times(V.raw_forecasts(spark, sf), i="forecast_issue_time", v="valid_time")
    return raw.na.drop(subset=["i", "v"]).agg(F.count("*").alias("n_kept"))


@query("p15_display_labels", f"""select event_id, case when temperature is null then 'N/A' else printf('%.1f °C', temperature+0.003e0) end as t_label,
    case when humidity is null then 'N/A' else printf('%.1f %%', humidity+0.003e0) end as h_label,
    case when temperature is null or humidity is null then 'Interval unavailable' else printf('%.1f — %.1f mm', temperature+0.003e0, humidity+0.003e0) end as i_label,
    case when rainfall >= 5 then printf('%.1f%%', (rainfall/10e0+0.00003e0)*100e0) else 'Not evaluable' end as p_label, printf('ST%d (B Block)', station_id) as v_label from v_obs""")
def p15(spark, sf):
    # values are moved off the decimal ties of the one-digit format
    o = V.observations(spark, sf)
    t, h = F.col("temperature") + 0.003, F.col("humidity") + 0.003
    return o.select(
        "event_id", labels.temperature_label(t).alias("t_label"), labels.humidity_label(h).alias("h_label"), labels.interval_label(t, h, "mm").alias("i_label"),
        labels.probability_label(F.col("rainfall") / 10.0 + 0.00003, F.col("rainfall") >= 5).alias("p_label"),
        labels.village_label(F.concat(F.lit("ST"), F.col("station_id").cast("string")), F.lit("B")).alias("v_label"))


# ---------------------------------------------------------------- quality suites
@query("q01_field_presence", """select * from (values
    ('station_id','required',true,'OK'),('timestamp','required',true,'OK'),('latitude','required',true,'OK'),('longitude','required',true,'OK'),('issue_code','required',false,'ERROR'),
    ('temperature','optional',true,'OK'),('humidity','optional',true,'OK'),('visibility','optional',false,'INFO')) f(field, kind, present, severity)
    left join (select unnest(['station_id','timestamp','latitude','longitude','temperature','humidity']) as field,
      unnest([count(station_id),count("timestamp"),count(latitude),count(longitude),count(temperature),count(humidity)]) as filled from v_raw) using (field)""")
def q01(spark, sf):
    raw = V.raw_observations(spark, sf).withColumnRenamed("latitude", "Latitude")
    fields = Q.field_presence(raw, [*C.OBSERVATION_REQUIRED, "issue_code"], ["temperature", "humidity", "visibility"])
    return fields.join(nn(raw.withColumnRenamed("Latitude", "latitude"), ["station_id", "timestamp", "latitude", "longitude", "temperature", "humidity"]), "field", "left")


@query("q02_station_ids", "select count(*) filter (station_id is null) as null_stations, count(distinct station_id) as stations from v_raw")
def q02(spark, sf):
    return V.raw_observations(spark, sf).agg(F.count_if(F.col("station_id").isNull()).alias("null_stations"), F.count_distinct("station_id").alias("stations"))


_OBS_CHECKS = """select unnest(['null_station_id','unparseable_timestamp','null_latitude','null_longitude','non_numeric_latitude','non_numeric_longitude','south_bound','north_bound','west_bound','east_bound']) as check_id,
    unnest([count(*) filter (station_id is null), count(*) filter ("timestamp" is not null and t is null), count(*) filter (latitude is null), count(*) filter (longitude is null),
      count(*) filter (latitude is not null and la is null), count(*) filter (longitude is not null and lo is null),
      cast(min(la)<6 as bigint), cast(max(la)>38 as bigint), cast(min(lo)<68 as bigint), cast(max(lo)>98 as bigint)]) as n_bad from v_typed"""
_FLAG = "select check_id, n_bad, case when n_bad > 0 then 'WARN' else 'OK' end as severity from ({})"


@query("q03_unparseable_times", _FLAG.format(_OBS_CHECKS) + " where check_id = 'unparseable_timestamp'")
def q03(spark, sf):
    return Q.observation_checks(V.raw_observations(spark, sf)).filter("check_id = 'unparseable_timestamp'")


@query("q04_coordinates", _FLAG.format(_OBS_CHECKS) + " where check_id not in ('unparseable_timestamp','null_station_id')")
def q04(spark, sf):
    return Q.observation_checks(V.raw_observations(spark, sf)).filter("check_id not in ('unparseable_timestamp', 'null_station_id')")


_MISSING = f"""select *, case when pct >= 50 then 'ERROR' when pct >= 10 then 'WARN' else 'INFO' end as severity from (
    select total, "column", n_missing, {even('n_missing/total*100e0', 2)} as pct from (select count(*) as total,
    unnest(['station_id','timestamp','latitude','longitude','temperature','humidity','rainfall','pressure','wind_speed','station_elevation']) as "column",
    unnest([count(*)-count(station_id),count(*)-count("timestamp"),count(*)-count(latitude),count(*)-count(longitude),count(*)-count(temperature),count(*)-count(humidity),
      count(*)-count(rainfall),count(*)-count(pressure),count(*)-count(wind_speed),count(*)-count(station_elevation)]) as n_missing from v_raw) where n_missing > 0)"""


@query("g02_missing_values", f"select total, \"column\", n_missing, pct from ({_MISSING})", "pct")
def g02(spark, sf):
    return Q.missing_stats(V.raw_observations(spark, sf).select(*RAW_COLS)).drop("severity")


@query("q05_missing_thresholds", f"select \"column\", severity from ({_MISSING})")
def q05(spark, sf):
    return Q.missing_stats(V.raw_observations(spark, sf).select(*RAW_COLS)).select("column", "severity")


def _qc_sql(raw, num, var):
    return f"(case when {raw} is null then 'MISSING' when {num} is null then 'INVALID' else {qc(num, var)} end)"


_QC5 = f"""select event_id, {_qc_sql('temperature','xt','temperature')} as qc_temperature, {_qc_sql('humidity','xh','humidity')} as qc_humidity, {_qc_sql('rainfall','xr','rainfall')} as qc_rainfall,
    {_qc_sql('pressure','xp','pressure')} as qc_pressure, {_qc_sql('wind_speed','xw','wind_speed')} as qc_wind_speed from v_typed"""


@query("s02_standard_observations", f"""select station_id, {stamp('t')} as "timestamp", la as latitude, lo as longitude, xt as observed_temperature, xh as observed_humidity,
    coalesce(xr,0e0) as observed_rainfall, coalesce(try_cast(station_elevation as double),350e0) as station_elevation, qc_temperature, qc_humidity, qc_rainfall, qc_pressure, qc_wind_speed,
    case when 'INVALID' in (qc_temperature,qc_humidity,qc_rainfall,qc_pressure,qc_wind_speed) then 'INVALID'
    when 'SUSPICIOUS' in (qc_temperature,qc_humidity,qc_rainfall,qc_pressure,qc_wind_speed) then 'SUSPICIOUS' else 'VALID' end as qc_status
    from v_typed join ({_QC5}) using (event_id) where t is not null""", "latitude longitude observed_temperature observed_humidity observed_rainfall station_elevation")
def s02(spark, sf):
    return S.standard_observations(Q.with_qc(V.raw_observations(spark, sf)))


@query("q06_qc_classify", _QC5)
def q06(spark, sf):
    return Q.with_qc(V.raw_observations(spark, sf)).select("event_id", *[f"qc_{v}" for v in C.WEATHER_VARIABLES])


@query("q07_row_status", f"""select event_id, case when 'INVALID' in (qc_temperature,qc_humidity,qc_rainfall,qc_pressure,qc_wind_speed) then 'INVALID'
    when 'SUSPICIOUS' in (qc_temperature,qc_humidity,qc_rainfall,qc_pressure,qc_wind_speed) then 'SUSPICIOUS' else 'VALID' end as qc_status from ({_QC5})""")
def q07(spark, sf):
    return Q.with_row_status(Q.with_qc(V.raw_observations(spark, sf))).select("event_id", "qc_status")


@query("q08_forecast_time_logic", _FLAG.format("""select unnest(['unparseable_issue_time','unparseable_valid_time','valid_before_issue','negative_lead','null_lead']) as check_id,
    unnest([count(*) filter (forecast_issue_time is not null and it is null), count(*) filter (valid_time is not null and vt is null), count(*) filter (vt < it), count(*) filter (lt < 0), count(*) filter (lt is null)]) as n_bad from v_typedfc"""))
def q08(spark, sf):
    return Q.forecast_checks(V.raw_forecasts(spark, sf))


@query("q09_duplicates", """select count(*) - count(distinct (coalesce(station_id,'~'), coalesce("timestamp",'~'))) as duplicates, count(*) as records from v_raw""")
def q09(spark, sf):
    return Q.duplicate_count(V.raw_observations(spark, sf), ["station_id", "timestamp"])


_REPORT = f"""select 'observations' as dataset_name, 'PARTIAL' as status, count(*) as record_count, min(la) as min_lat, max(la) as max_lat, min(lo) as min_lon, max(lo) as max_lon,
    strftime(min(t),'%Y-%m-%d') as start_date, strftime(max(t),'%Y-%m-%d') as end_date,
    (select count(*) from ({_OBS_CHECKS}) where n_bad > 0) + (select count(*) from ({_MISSING}) where severity='WARN') as n_warnings,
    (select count(*) from ({_MISSING}) where severity='ERROR') as n_errors from v_typed"""


@query("q10_dataset_report", _REPORT, "min_lat max_lat min_lon max_lon")
def q10(spark, sf):
    raw = V.raw_observations(spark, sf).select(*RAW_COLS)
    r = Q.dataset_report(raw, C.OBSERVATIONS, Q.observation_checks(raw))
    return r.select("dataset_name", "status", "record_count", "spatial_extent.*", "temporal_extent.*",
                    F.size("warnings").cast("bigint").alias("n_warnings"), F.size("errors").cast("bigint").alias("n_errors"))


@query("q11_metadata_record", f"""select 'observations' as dataset_name, 'csv' as format, 'EPSG:4326' as crs, start_date, end_date, 10 as n_variables, record_count, status as processing_status,
    'UNVERIFIED' as data_status, record_count as embedded_count from ({_REPORT})""")
def q11(spark, sf):
    raw = V.raw_observations(spark, sf).select(*RAW_COLS)
    m = Q.metadata_record(Q.dataset_report(raw, C.OBSERVATIONS, Q.observation_checks(raw)), C.OBSERVATIONS)
    return m.select("dataset_name", "format", "crs", "temporal_coverage.*", F.size("variables").alias("n_variables"), "record_count", "processing_status",
                    "data_status", F.col("validation_summary.record_count").alias("embedded_count"))


@query("q16_rainfall_audit", """select count(*) as total_records, count(*) filter (r is null) as missing_observed_rainfall, count(*) filter (r < 0) as negative_observed_rainfall,
    count(*) filter (r > 500) as impossible_observed_rainfall, count(distinct station_id) as unique_stations, count(*) - count(distinct (station_id, h)) as duplicate_records, false as clean_data
    from (select user_id as station_id, date_trunc('hour', ts) as h, case when event_id%47<>0 then value*6e0-30e0 end as r from events)""")
def q16(spark, sf):
    e = V.table(spark, sf, "events").select(
        F.col("user_id").alias("station_id"), F.date_trunc("hour", "ts").alias("observation_time"), F.when(F.col("event_id") % 47 != 0, F.col("value") * 6.0 - 30.0).alias("observed_rainfall"))
    return Q.rainfall_audit(e, ["station_id", "observation_time"])


_MSG_T = "case when temperature is null then 'Temperature value is missing' when temperature < -10 or temperature > 60 then printf('Temperature %.2f°C out of valid physical range [-10, 60]', temperature) end"
_MSG_H = "case when humidity is null then 'Humidity value is missing' when humidity < 0 or humidity > 100 then printf('Humidity %.2f%% out of valid physical range [0, 100]', humidity) end"
_MSG_P = "case when rainfall/8e0 < 0 or rainfall/8e0 > 1 then printf('Probability %.4f out of bounds [0.0, 1.0]', rainfall/8e0+0.00001e0) end"
_MSG_O = "case when temperature is not null and humidity is not null and not (temperature <= humidity and humidity <= rainfall*8e0) then printf('Quantile violation: P10 (%.2f) <= P50 (%.2f) <= P90 (%.2f) failed', temperature, humidity, rainfall*8e0) end"


@query("q17_value_validators", f"select event_id, {_MSG_T} as t, {_MSG_H} as h, {_MSG_P} as p, {_MSG_O} as o from v_obs")
def q17(spark, sf):
    p = F.col("rainfall") / 8.0
    p_msg = F.when(checks.probability_message(p).isNotNull(), checks.probability_message(p + 0.00001))
    return V.observations(spark, sf).select(
        "event_id", checks.temperature_message("temperature").alias("t"), checks.humidity_message("humidity").alias("h"), p_msg.alias("p"),
        checks.ordering_message("temperature", "humidity", F.col("rainfall") * 8.0).alias("o"))


@query("q18_record_validity", f"select event_id, concat_ws(' | ', {_MSG_T}, {_MSG_H}, {_MSG_O}) as message, concat_ws(' | ', {_MSG_T}, {_MSG_H}, {_MSG_O}) = '' as is_valid from v_obs")
def q18(spark, sf):
    m = checks.weather_messages("temperature", "humidity", ("temperature", "humidity", F.col("rainfall") * 8.0))
    return V.observations(spark, sf).select("event_id", m.alias("message"), (m == "").alias("is_valid"))


@query("q19_uncertainty_audit", """select unnest(['humidity_below_0','humidity_above_100','missing_observed_temperature','missing_observed_humidity','missing_b2_temperature','unique_stations','unique_cells','duplicates']) as metric,
    unnest([count(*) filter (observed_humidity < 0), count(*) filter (observed_humidity > 100), count(*) filter (observed_temperature is null), count(*) filter (observed_humidity is null),
      count(*) filter (b2_temperature is null), count(distinct station_id), count(distinct grid_id), count(*) - count(distinct (station_id, observation_time, lead_time_hours))]) as n from v_match""")
def q19(spark, sf):
    return Q.uncertainty_audit(V.matchups(spark, sf), ["station_id", "observation_time", "lead_time_hours"], ["observed_temperature", "observed_humidity", "b2_temperature"])


@query("x04_id_format", """select user_id, trim(vid) as trimmed, len(string_split(trim(vid),'_')) >= 4 and string_split(trim(vid),'_')[1]='GP' as long_form,
    case when trim(vid)='' then 'Panchayat ID is empty or not a string' end as message
    from (select user_id, case when user_id%7=0 then '  ' when user_id%3=0 then ' GP_33_12_'||user_id||' ' else 'V_'||user_id end as vid from events)""")
def x04(spark, sf):
    u = F.col("user_id")
    vid = F.when(u % 7 == 0, "  ").when(u % 3 == 0, F.concat(F.lit(" GP_33_12_"), u.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("V_"), u.cast("string")))
    t = V.table(spark, sf, "events").select("user_id", vid.alias("vid"))
    return t.select("user_id", F.trim("vid").alias("trimmed"), checks.is_full_village_id("vid").alias("long_form"), checks.village_id_message("vid").alias("message"))


# ---------------------------------------------------------------- aggregates of ingest
@query("g01_counts", "select count(*) as n, count(distinct station_id) as stations, count(distinct \"timestamp\") as hours from v_obs")
def g01(spark, sf):
    return V.observations(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("station_id").alias("stations"), F.count_distinct("timestamp").alias("hours"))


@query("g03_value_counts", "select qc_status, count(*) as n from v_checked group by 1")
def g03(spark, sf):
    return V.checked(spark, sf).groupBy("qc_status").agg(F.count("*").alias("n"))


@query("g04_qc_summary", f"""select variable, status, count(*) as n from (select unnest(['qc_temperature','qc_humidity','qc_rainfall','qc_pressure','qc_wind_speed']) as variable,
    unnest([qc_temperature,qc_humidity,qc_rainfall,qc_pressure,qc_wind_speed]) as status from ({_QC5})) group by all""")
def g04(spark, sf):
    return Q.qc_summary(Q.with_qc(V.raw_observations(spark, sf)))


@query("g05_extents", "select count(*) as record_count, strftime(min(t),'%Y-%m-%d') as start_date, strftime(max(t),'%Y-%m-%d') as end_date, min(la) as min_lat, max(la) as max_lat, min(lo) as min_lon, max(lo) as max_lon from v_typed",
    "min_lat max_lat min_lon max_lon")
def g05(spark, sf):
    return Q.extents(V.raw_observations(spark, sf))


@query("g06_lead_distribution", "select min(lt) as min_lead, max(lt) as max_lead, avg(lt) as mean_lead, count(distinct lt) as n_leads from v_typedfc", "min_lead max_lead mean_lead")
def g06(spark, sf):
    x = V.raw_forecasts(spark, sf).select(to_number("lead_time").alias("lt"))
    return x.agg(F.min("lt").alias("min_lead"), F.max("lt").alias("max_lead"), F.avg("lt").alias("mean_lead"), F.count_distinct("lt").alias("n_leads"))


@query("g07_duplicate_keys", "select count(*) - count(distinct (station_id, \"timestamp\")) as duplicates, count(*) as records from v_obs")
def g07(spark, sf):
    return Q.duplicate_count(V.observations(spark, sf), ["station_id", "timestamp"])


@query("g08_conditional_counts", "select count(*) filter (temperature < 0) as below_zero, count(*) filter (rainfall > 5) as heavy, count(*) filter (humidity is null) as no_humidity from v_obs")
def g08(spark, sf):
    c = F.col
    return V.observations(spark, sf).agg(F.count_if(c("temperature") < 0).alias("below_zero"), F.count_if(c("rainfall") > 5).alias("heavy"), F.count_if(c("humidity").isNull()).alias("no_humidity"))


@query("u03_raw_with_qc", f"select event_id, temperature, humidity, {_qc_sql('temperature','xt','temperature')} as qc_temperature, {_qc_sql('humidity','xh','humidity')} as qc_humidity from (select * replace (try_cast(temperature as double) as temperature, try_cast(humidity as double) as humidity), temperature as rt, humidity as rh from v_typed)".replace("case when temperature is", "case when rt is").replace("case when humidity is", "case when rh is"), "temperature humidity")
def u03(spark, sf):
    q = Q.with_qc(V.raw_observations(spark, sf), ["temperature", "humidity"])
    return q.select("event_id", to_number("temperature").alias("temperature"), to_number("humidity").alias("humidity"), "qc_temperature", "qc_humidity")


# ---------------------------------------------------------------- scalar functions
@query("x07_season_parts", "select event_id, cast(dayofyear(ts) as int) as doy, cast(month(ts) as int) as mon, strftime(ts,'%Y-%m-%d') as day, strftime(ts,'%B') as month_name from events")
def x07(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.dayofyear("ts").alias("doy"), F.month("ts").alias("mon"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "MMMM").alias("month_name"))


@query("x09_time_order", "select count(*) filter (vt < it) as backwards, count(*) filter (vt = it) as same, sum(date_sub('hour', it, vt))::bigint as total_lead from v_typedfc where it is not null and vt is not null")
def x09(spark, sf):
    from terracast.functions.times import lead_hours

    t = parsed_times(V.raw_forecasts(spark, sf), i="forecast_issue_time", v="valid_time").na.drop()
    return t.agg(F.count_if(F.col("v") < F.col("i")).alias("backwards"), F.count_if(F.col("v") == F.col("i")).alias("same"), F.sum(lead_hours("i", "v").cast("bigint")).alias("total_lead"))


@query("x13_rounding", f"select event_id, {even('value/3e0', 1)} as r1, {even('value/3e0', 2)} as r2, {even('value/3e0', 3)} as r3, {even('value/3e0', 4)} as r4 from events", "r1 r2 r3 r4")
def x13(spark, sf):
    return V.table(spark, sf, "events").select("event_id", *[half_even(F.col("value") / 3.0, k).alias(f"r{k}") for k in (1, 2, 3, 4)])


@query("x20_threshold_flag", "select event_id, cast(coalesce(temperature >= 10, false) as int) as warm, least(greatest(coalesce(humidity,0e0),20e0),80e0) as h_clipped, floor(station_elevation/100e0)*100e0 as z_down, ceil(station_elevation/100e0)*100e0 as z_up from v_obs", "h_clipped z_down z_up")
def x20(spark, sf):
    from terracast.functions.numbers import clip

    c = F.col
    return V.observations(spark, sf).select(
        "event_id", F.coalesce((c("temperature") >= 10).cast("int"), F.lit(0)).alias("warm"), clip(F.coalesce("humidity", F.lit(0.0)), 20.0, 80.0).alias("h_clipped"),
        (F.floor(c("station_elevation") / 100.0) * 100.0).alias("z_down"), (F.ceil(c("station_elevation") / 100.0) * 100.0).alias("z_up"))


@query("x23_property_default", "select event_id, coalesce(cast(json_extract_string(props,'$.k') as int), -1) as k, coalesce(json_extract_string(props,'$.missing'),'UNKNOWN') as other from events")
def x23(spark, sf):
    p = F.from_json("props", "map<string,string>")
    return V.table(spark, sf, "events").select("event_id", F.coalesce(p["k"].cast("int"), F.lit(-1)).alias("k"), F.coalesce(p["missing"], F.lit("UNKNOWN")).alias("other"))


@query("x25_json_round_trip", "select event_id, '{\"type\":\"Feature\",\"k\":'||json_extract_string(props,'$.k')||'}' as feature from events")
def x25(spark, sf):
    p = F.from_json("props", "k int")
    return V.table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.lit("Feature").alias("type"), p["k"].alias("k"))).alias("feature"))


@query("x02_prefix_concat", "select event_id, 'GROUP_'||station_id as station_group, printf('%s (%s Block)', 'ST'||station_id, qc_temperature) as label from v_checked")
def x02(spark, sf):
    c = V.checked(spark, sf)
    text = F.col("station_id").cast("string")
    return c.select("event_id", F.concat(F.lit("GROUP_"), text).alias("station_group"), labels.village_label(F.concat(F.lit("ST"), text), "qc_temperature").alias("label"))


@query("x08_date_text", "select event_id, strftime(ts,'%Y-%m-%d') as day, strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M:%S') as hour from events")
def x08(spark, sf):
    from terracast.functions.times import day_text, stamp as text

    return V.table(spark, sf, "events").select("event_id", day_text("ts").alias("day"), text(F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("hour"))


@query("x11_month_names", "select strftime(o_orderdate,'%B') as month_name, count(*) as n from orders group by 1")
def x11(spark, sf):
    return V.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "MMMM").alias("month_name")).agg(F.count("*").alias("n"))


@query("x14_snap_to_cell", "select event_id, floor(station_elevation/1000e0)*1000e0 as low, ceil(station_elevation/1000e0)*1000e0 as high from v_obs", "low high")
def x14(spark, sf):
    z = F.col("station_elevation") / C.CELL_M
    return V.observations(spark, sf).select("event_id", (F.floor(z) * C.CELL_M).alias("low"), (F.ceil(z) * C.CELL_M).alias("high"))


@query("x15_clip", "select event_id, case when humidity is not null then least(greatest(humidity,0e0),60e0) end as clipped from v_obs", "clipped")
def x15(spark, sf):
    from terracast.functions.numbers import clip

    return V.observations(spark, sf).select("event_id", clip("humidity", 0.0, 60.0).alias("clipped"))


@query("x16_larger_of_two", "select event_id, case when temperature is not null and humidity is not null then greatest(temperature, humidity) end as larger from v_obs", "larger")
def x16(spark, sf):
    t, h = F.col("temperature"), F.col("humidity")
    return V.observations(spark, sf).select("event_id", F.when(t.isNotNull() & h.isNotNull(), F.greatest(t, h)).alias("larger"))


@query("x19_ordered_case", "select event_id, case when rainfall >= 5 then 'HEAVY' when rainfall > 0 then 'LIGHT' when rainfall = 0 then 'DRY' else 'UNKNOWN' end as class from v_obs")
def x19(spark, sf):
    r = F.col("rainfall")
    return V.observations(spark, sf).select("event_id", F.when(r >= 5, "HEAVY").when(r > 0, "LIGHT").when(r == 0, "DRY").otherwise("UNKNOWN").alias("class"))
