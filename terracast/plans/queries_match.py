"""Matchup, baseline and conformal queries (J, B, F, W, M-01, M-09)."""
from __future__ import annotations

from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.times import day_text, season_columns
from terracast.operators import baselines as B
from terracast.operators import evaluate as E
from terracast.operators import matchup as M
from terracast.operators import models, quantiles, serve, spatial
from terracast.operators import uncertainty as U
from terracast.plans import views as V
from terracast.plans.oracle import VIEWS, clip, even, stamp
from terracast.plans.registry import query

KEY = "event_id, lead_time_hours"


def keyed(df, *cols):
    return df.select("event_id", "lead_time_hours", *cols)


# ---------------------------------------------------------------- joins
@query("j01_matchup_join", f"select {KEY}, {stamp('observation_time')} as observation_time, forecast_parent_id, forecast_temperature, observed_temperature from v_match", "forecast_temperature observed_temperature")
def j01(spark, sf):
    return keyed(V.matchups(spark, sf), "observation_time", "forecast_parent_id", "forecast_temperature", "observed_temperature")


@query("j02_forecasts_with_parent", f"select parent as forecast_parent_id, {stamp('valid_time')} as valid_time, lead as lead_time, forecast_temperature as temperature from v_fc", "temperature")
def j02(spark, sf):
    fc = V.forecasts(spark, sf)
    return spatial.attach_parent(fc.drop("forecast_parent_id"), spatial.point_registry(fc)).select("forecast_parent_id", "valid_time", "lead_time", "temperature")


@query("j03_left_join_registry", "select parent as forecast_parent_id, lead as lead_time, count(*) as n from (select case when longitude < 77 then parent end as parent, lead from v_fc) group by all")
def j03(spark, sf):
    fc = V.forecasts(spark, sf)
    part = spatial.point_registry(fc).filter("longitude < 77.0")
    return spatial.attach_parent(fc.drop("forecast_parent_id"), part, "left").groupBy("forecast_parent_id", "lead_time").agg(F.count("*").alias("n"))


@query("j06_uncertainty_join", """select event_id, lead_time_hours, case when split='TEST' then q10_temperature end as q10_temperature, case when split='TEST' then q90_temperature end as q90_temperature from v_int""",
    "q10_temperature q90_temperature")
def j06(spark, sf):
    u = V.intervals(spark, sf).filter("split = 'TEST'").select("event_id", *M.MATCH_KEYS, "q10_temperature", "q90_temperature", "b2_temperature")
    return keyed(serve.join_uncertainty(V.matchups(spark, sf), u, ["event_id", *M.MATCH_KEYS]), "q10_temperature", "q90_temperature")


@query("j07_station_lookup", "select event_id, parent as forecast_parent_id, grid_id, panchayat_id, grid_elevation, station_group from v_obs join v_site using (station_id)", "grid_elevation")
def j07(spark, sf):
    return V.observations(spark, sf).select("event_id", "station_id").join(V.sites(spark, sf), "station_id").drop("station_id")


@query("j08_keyed_attach", "select event_id, lead_time_hours, b2_temperature, ml_temperature from v_int", "b2_temperature ml_temperature")
def j08(spark, sf):
    preds = V.intervals(spark, sf).select("event_id", *M.MATCH_KEYS, "ml_temperature")
    return keyed(V.matchups(spark, sf).join(preds, ["event_id", *M.MATCH_KEYS]), "b2_temperature", "ml_temperature")


# ---------------------------------------------------------------- splits and filters
@query("b06_split_label", "select event_id, case when \"timestamp\" <= timestamp '2024-01-15 23:00:00' then 'TRAIN' when \"timestamp\" <= timestamp '2024-01-22 23:00:00' then 'CALIBRATION' else 'TEST' end as split from v_obs")
def b06(spark, sf):
    return V.observations(spark, sf).select("event_id", M.split_label("timestamp", V.SPLITS).alias("split"))


@query("f01_split_filter", "select lead_time_hours, count(*) as n, avg(observed_temperature) as t from v_match where split = 'TEST' group by 1", "t")
def f01(spark, sf):
    return V.matchups(spark, sf).filter("split = 'TEST'").groupBy("lead_time_hours").agg(F.count("*").alias("n"), F.avg("observed_temperature").alias("t"))


@query("f02_valid_truth", "select split, count(*) as n from v_match where qc_status = 'VALID' group by 1")
def f02(spark, sf):
    return V.matchups(spark, sf).filter("qc_status = 'VALID'").groupBy("split").agg(F.count("*").alias("n"))


@query("f03_pairwise_present", "select split, count(*) as n from v_match where observed_humidity is not null and b2_humidity is not null group by 1")
def f03(spark, sf):
    return V.matchups(spark, sf).filter(F.col("observed_humidity").isNotNull() & F.col("b2_humidity").isNotNull()).groupBy("split").agg(F.count("*").alias("n"))


@query("f04_test_dates", "select event_id from v_obs where strftime(\"timestamp\",'%Y-%m-%d') in (select distinct strftime(observation_time,'%Y-%m-%d') from v_match where split='TEST')")
def f04(spark, sf):
    days = V.matchups(spark, sf).filter("split = 'TEST'").select(day_text("observation_time").alias("day")).distinct()
    return V.observations(spark, sf).select("event_id", day_text("timestamp").alias("day")).join(days, "day", "left_semi").select("event_id")


@query("f07_window_relabel", f"""select {KEY}, case when observation_time between timestamp '2024-01-03' and timestamp '2024-01-10' then 'TRAIN'
    when observation_time between timestamp '2024-01-11' and timestamp '2024-01-20' then 'CALIBRATION' when observation_time between timestamp '2024-01-21' and timestamp '2024-01-28' then 'TEST' else split end as split from v_match""")
def f07(spark, sf):
    ranges = {"TRAIN": ("2024-01-03", "2024-01-10"), "CALIBRATION": ("2024-01-11", "2024-01-20"), "TEST": ("2024-01-21", "2024-01-28")}
    return keyed(V.matchups(spark, sf), M.relabel_split("observation_time", ranges).alias("split"))


@query("f06_point_lookup", f"""select station_id, {stamp('observation_time')} as observation_time, lead_time_hours, b2_temperature from v_match where station_id=7 and lead_time_hours=48
    order by v_match.observation_time desc, event_id desc limit 1""", "b2_temperature")
def f06(spark, sf):
    m = V.matchups(spark, sf).select("station_id", "observation_time", "lead_time_hours", "event_id", "b2_temperature")
    return serve.lookup(m, "station_id", 7, "observation_time", None, "lead_time_hours", 48, ["observation_time", "event_id"]).drop("event_id")


@query("f08_display_gate", f"select {KEY}, case when ml_temperature between -10 and 60 then ml_temperature end as shown from v_int", "shown")
def f08(spark, sf):
    m = V.intervals(spark, sf)
    return keyed(m, serve.gate("ml_temperature", F.col("ml_temperature").between(-10, 60)).alias("shown"))


# ---------------------------------------------------------------- baselines
@query("b01_coarse", f"select {KEY}, forecast_temperature as b0_temperature, forecast_humidity as b0_humidity, forecast_rainfall as b0_rainfall from v_match", "b0_temperature b0_humidity b0_rainfall")
def b01(spark, sf):
    return keyed(V.matchups(spark, sf), "b0_temperature", "b0_humidity", "b0_rainfall")


_B1 = f"""select m.event_id, m.lead_time_hours, case when ok then 'INTERPOLATED' else 'FALLBACK_B0' end as b1_status,
    case when ok then {even('0e0 + (1e0-u)*(1e0-w)*f00.forecast_temperature + u*(1e0-w)*f01.forecast_temperature + (1e0-u)*w*f10.forecast_temperature + u*w*f11.forecast_temperature', 2)} else {even('m.forecast_temperature', 2)} end as b1_temperature,
    case when ok then {even('0e0 + (1e0-u)*(1e0-w)*f00.forecast_humidity + u*(1e0-w)*f01.forecast_humidity + (1e0-u)*w*f10.forecast_humidity + u*w*f11.forecast_humidity', 2)} else {even('m.forecast_humidity', 2)} end as b1_humidity
    from (select *, coalesce(x0 < x1 and y0 < y1, false) as ok, (longitude_obs-x0)/(x1-x0) as u, (latitude_obs-y0)/(y1-y0) as w from (
      select *, (select max(p.latitude) from v_point p where p.latitude <= latitude_obs) as y0, (select min(p.latitude) from v_point p where p.latitude >= latitude_obs) as y1,
        (select max(p.longitude) from v_point p where p.longitude <= longitude_obs) as x0, (select min(p.longitude) from v_point p where p.longitude >= longitude_obs) as x1 from v_match)) m
    left join v_fc f00 on f00.valid_time=m.valid_time and f00.lead=m.lead_time_hours and f00.latitude=y0 and f00.longitude=x0
    left join v_fc f01 on f01.valid_time=m.valid_time and f01.lead=m.lead_time_hours and f01.latitude=y0 and f01.longitude=x1
    left join v_fc f10 on f10.valid_time=m.valid_time and f10.lead=m.lead_time_hours and f10.latitude=y1 and f10.longitude=x0
    left join v_fc f11 on f11.valid_time=m.valid_time and f11.lead=m.lead_time_hours and f11.latitude=y1 and f11.longitude=x1"""


@query("b02_bilinear", _B1, "b1_temperature b1_humidity")
def b02(spark, sf):
    out = B.bilinear(V.matchups(spark, sf), V.standard_forecasts(spark, sf))
    return keyed(out, "b1_status", "b1_temperature", "b1_humidity")


@query("b02_parent_mode", f"select event_id, lead_time_hours, b1_status, {even('forecast_temperature', 2)} as b1_temperature from ({_B1}) join (select event_id, lead_time_hours, forecast_temperature from v_match) using (event_id, lead_time_hours)", "b1_temperature")
def b02_parent(spark, sf):
    out = B.bilinear(V.matchups(spark, sf), V.standard_forecasts(spark, sf), mode="parent")
    return keyed(out, "b1_status", "b1_temperature")


@query("b03_lapse_rate", f"select {KEY}, b2_temperature, b2_humidity from v_match", "b2_temperature b2_humidity")
def b03(spark, sf):
    return keyed(V.matchups(spark, sf), "b2_temperature", "b2_humidity")


_LEVELS = "[" + ",".join(f"{k}/99e0" for k in range(100)) + "]"


def _interp(x: str) -> str:
    """Mapping through lists q.s -> q.d, the last break point at or below x starting the segment."""
    n = f"len(list_filter(q.s, lambda v: v <= {x}))"
    i = f"least(greatest({n},1),99)"
    return f"""(case when {x} is null then null when {n}=0 then q.d[1] when {n}>=100 then q.d[100]
      else q.d[{i}]+(q.d[{i}+1]-q.d[{i}])/(q.s[{i}+1]-q.s[{i}])*({x}-q.s[{i}]) end)"""


_B3T = f"""select m.event_id, m.lead_time_hours, {even(_interp('m.b2_temperature'), 2)} as b3_temperature from v_match m,
    (select quantile_cont(b2_temperature, {_LEVELS}) as s, quantile_cont(observed_temperature, {_LEVELS}) as d from v_match where split='TRAIN') q"""
_B3H = f"""select m.event_id, m.lead_time_hours, {even(clip(_interp('m.b0_humidity'), '0e0', '100e0'), 2)} as b3_humidity from v_match m,
    (select quantile_cont(b0_humidity, {_LEVELS}) as s, quantile_cont(observed_humidity, {_LEVELS}) as d from v_match where split='TRAIN') q"""


@query("b04_quantile_map", _B3T, "b3_temperature")
def b04(spark, sf):
    return keyed(B.quantile_map(V.matchups(spark, sf), {"temperature": "b2_temperature"}), "b3_temperature")


@query("b04_quantile_map_humidity", _B3H, "b3_humidity")
def b04h(spark, sf):
    return keyed(B.quantile_map(V.matchups(spark, sf), {"humidity": "b0_humidity"}), "b3_humidity")


@query("x18_quantile_vector", f"select cast(unnest(range(100)) as int) as level_no, unnest(quantile_cont(observed_temperature, {_LEVELS})) as quantile from v_match", "quantile")
def x18(spark, sf):
    return quantiles.quantile_rows(V.matchups(spark, sf), "observed_temperature", [k / 99 for k in range(100)])


@query("b05_residuals", f"select {KEY}, residual_temperature, residual_humidity from v_match", "residual_temperature residual_humidity")
def b05(spark, sf):
    return keyed(V.matchups(spark, sf), "residual_temperature", "residual_humidity")


# ---------------------------------------------------------------- conformal
_SCORE = "greatest(q10_{0}-observed_{0}, observed_{0}-q90_{0})"


@query("b07_conformity_score", f"select {KEY}, case when observed_temperature is not null then {_SCORE.format('temperature')} end as score from v_int where split='CALIBRATION'", "score")
def b07(spark, sf):
    m = V.intervals(spark, sf).filter("split = 'CALIBRATION'")
    return keyed(m, U.conformity_score("observed_temperature", "q10_temperature", "q90_temperature").alias("score"))


_CORR = """select score as correction, n from (select score, row_number() over (order by score) - 1 as r, count(*) over () as n from (
    select {s} as score from v_int where split='CALIBRATION' and observed_{v} is not null)) where r = cast(ceil(least(0.8e0*(1e0+1e0/n),1e0)*(n-1)) as bigint)"""


def _corr(v):
    return _CORR.format(s=_SCORE.format(v), v=v)


def correction(spark, sf, v):
    cal = V.intervals(spark, sf).filter("split = 'CALIBRATION'")
    s = cal.select(U.conformity_score(f"observed_{v}", f"q10_{v}", f"q90_{v}").alias("score"))
    return U.conformal_correction(s)


@query("b08_conformal_correction", f"select 'temperature' as variable, correction, cast(n as bigint) as n from ({_corr('temperature')}) union all select 'humidity', correction, cast(n as bigint) from ({_corr('humidity')})", "correction")
def b08(spark, sf):
    cal = V.intervals(spark, sf).filter("split = 'CALIBRATION'")
    scores = F.array(*[F.struct(F.lit(v).alias("variable"), U.conformity_score(f"observed_{v}", f"q10_{v}", f"q90_{v}").alias("score")) for v in ("temperature", "humidity")])
    rows = cal.select(F.explode(scores).alias("k")).select("k.*")
    return U.conformal_correction(rows, "score", ["variable"])


VIEWS["v_corr"] = _corr("temperature")


@query("b09_interval_widening", f"select {KEY}, q10_temperature - q.correction as q10_temperature_cal, q90_temperature + q.correction as q90_temperature_cal from v_int cross join v_corr q", "q10_temperature_cal q90_temperature_cal")
def b09(spark, sf):
    out = U.widen(V.intervals(spark, sf), correction(spark, sf, "temperature"), "q10_temperature", "q90_temperature")
    return keyed(out, "q10_temperature_cal", "q90_temperature_cal")


@query("b10_monotone_quantiles", f"select {KEY}, a as lo, greatest(a,b) as mid, greatest(greatest(a,b),c) as hi from (select {KEY}, observed_temperature as a, b2_temperature as b, forecast_temperature-5e0 as c from v_match) where a is not null", "lo mid hi")
def b10(spark, sf):
    m = V.matchups(spark, sf).filter("observed_temperature is not null").withColumn("c", F.col("forecast_temperature") - 5.0)
    lo, mid, hi = U.monotone("observed_temperature", "b2_temperature", "c")
    return keyed(m, lo.alias("lo"), mid.alias("mid"), hi.alias("hi"))


@query("b11_absolute_scale", f"""select {KEY}, b2_temperature-3e0 as q10_temperature, b2_temperature as q50_temperature, b2_temperature+4e0 as q90_temperature, (b2_temperature+4e0)-(b2_temperature-3e0) as temperature_interval_width,
    {clip('b2_humidity-30e0','0e0','100e0')} as q10_humidity, {clip('b2_humidity+1e0','0e0','100e0')} as q50_humidity, {clip('b2_humidity+45e0','0e0','100e0')} as q90_humidity,
    {clip('b2_humidity+45e0','0e0','100e0')}-{clip('b2_humidity-30e0','0e0','100e0')} as humidity_interval_width from v_match""",
    "q10_temperature q50_temperature q90_temperature temperature_interval_width q10_humidity q50_humidity q90_humidity humidity_interval_width")
def b11(spark, sf):
    m = V.matchups(spark, sf).withColumns({"t_q10": F.lit(-3.0), "t_q50": F.lit(0.0), "t_q90": F.lit(4.0), "h_q10": F.lit(-30.0), "h_q50": F.lit(1.0), "h_q90": F.lit(45.0)})
    out = U.to_absolute(m, {"temperature": "t", "humidity": "h"})
    return keyed(out, *[f"{q}_{v}" for v in ("temperature", "humidity") for q in ("q10", "q50", "q90")], "temperature_interval_width", "humidity_interval_width")


@query("b12_reliability_class", f"""select {KEY}, case when w > 5 then 'LOW' when w > 3 then 'MEDIUM' else 'HIGH' end as t_class, case when h > 40 then 'LOW' when h > 20 then 'MEDIUM' else 'HIGH' end as h_class
    from (select {KEY}, temperature_interval_width/4e0 as w, humidity_interval_width/1.5e0 as h from v_int)""")
def b12(spark, sf):
    m = V.intervals(spark, sf).withColumns({"w": F.col("temperature_interval_width") / 4.0, "h": F.col("humidity_interval_width") / 1.5})
    return keyed(m, U.reliability("w", "temperature").alias("t_class"), U.reliability("h", "humidity").alias("h_class"))


# ---------------------------------------------------------------- order, first, last
@query("w01_keep_first", f"select station_id, {stamp('min(\"timestamp\")')} as first_time, arg_min(event_id, event_id) as event_id from v_obs group by 1")
def w01(spark, sf):
    o = V.observations(spark, sf).select("station_id", "timestamp", "event_id")
    f = serve.first_per_key(o, ["station_id"], ["timestamp", "event_id"])
    return f.select("station_id", F.col("timestamp").alias("first_time"), "event_id")


@query("w02_point_ids", "select idx as point_idx, parent as forecast_parent_id, latitude, longitude from v_point where exists (select 1 from v_fc f where f.idx = v_point.idx)", "latitude longitude")
def w02(spark, sf):
    return V.point_registry(spark, sf).select("point_idx", "forecast_parent_id", "latitude", "longitude")


@query("w04_arg_extreme", "select station_id, arg_min(event_id, (temperature, event_id)) as coldest, arg_max(event_id, (temperature, -event_id)) as warmest from v_obs where temperature is not null group by 1")
def w04(spark, sf):
    o = V.observations(spark, sf).filter("temperature is not null")
    lo, hi = F.min(F.struct("temperature", "event_id")), F.max(F.struct(F.col("temperature"), (-F.col("event_id")).alias("neg")))
    return o.groupBy("station_id").agg(lo.alias("a"), hi.alias("b")).select("station_id", F.col("a.event_id").alias("coldest"), (-F.col("b.neg")).alias("warmest"))


@query("w05_latest_row", f"select station_id, lead_time_hours, {stamp('observation_time')} as observation_time, event_id, b2_temperature from v_match qualify row_number() over (partition by station_id order by v_match.observation_time desc, lead_time_hours desc, event_id desc)=1", "b2_temperature")
def w05(spark, sf):
    m = V.matchups(spark, sf).select("station_id", "lead_time_hours", "observation_time", "event_id", "b2_temperature")
    return serve.latest_per_key(m, ["station_id"], ["observation_time", "lead_time_hours", "event_id"])


@query("w06_distinct_sorted", "select distinct strftime(observation_time,'%Y-%m-%d') as day, lead_time_hours from v_match")
def w06(spark, sf):
    return V.matchups(spark, sf).select(day_text("observation_time").alias("day"), "lead_time_hours").distinct().orderBy("day", "lead_time_hours")


@query("w07_order_by_error", "select station_id, avg(abs(b2_temperature-observed_temperature)) as mae from v_match group by 1", "mae")
def w07(spark, sf):
    e = F.avg(F.abs(F.col("b2_temperature") - F.col("observed_temperature")))
    return V.matchups(spark, sf).groupBy("station_id").agg(e.alias("mae")).orderBy(F.desc("mae"), "station_id")


@query("w08_top_ten", "select event_id, rainfall from v_obs order by rainfall desc, event_id limit 10", "rainfall")
def w08(spark, sf):
    return V.observations(spark, sf).select("event_id", "rainfall").orderBy(F.desc("rainfall"), "event_id").limit(10)


@query("w09_seeded_sample", "select event_id, station_id from v_obs order by md5(concat_ws('|', '42', cast(event_id as varchar))), event_id limit 500")
def w09(spark, sf):
    return models.seeded_sample(V.observations(spark, sf).select("event_id", "station_id"), ["event_id"])


@query("w11_latest_time", f"select {stamp('max(\"timestamp\")')} as latest from v_obs")
def w11(spark, sf):
    return V.observations(spark, sf).agg(F.max("timestamp").alias("latest"))


@query("w12_first_per_lead", f"""select lead_time_hours, station_id, {stamp('observation_time')} as observation_time, {stamp('forecast_issue_time')} as forecast_issue_time, {stamp('valid_time')} as valid_time, observed_rainfall, forecast_rainfall
    from v_match qualify row_number() over (partition by lead_time_hours order by v_match.observation_time, station_id, event_id)=1""", "observed_rainfall forecast_rainfall")
def w12(spark, sf):
    m = V.matchups(spark, sf).select("lead_time_hours", "observation_time", "station_id", "event_id", "forecast_issue_time", "valid_time", "observed_rainfall", "forecast_rainfall")
    return serve.first_per_key(m, ["lead_time_hours"], ["observation_time", "station_id", "event_id"]).drop("event_id")


# ---------------------------------------------------------------- features, labels, checks
@query("m01_season_features", f"select event_id, sin(2e0*pi()*dayofyear(\"timestamp\")/365.25e0) as day_of_year_sin, cos(2e0*pi()*dayofyear(\"timestamp\")/365.25e0) as day_of_year_cos, cast(month(\"timestamp\") as int) as month from v_obs", "day_of_year_sin day_of_year_cos")
def m01(spark, sf):
    o = V.observations(spark, sf)
    return o.select("event_id", *[c.alias(n) for n, c in season_columns("timestamp").items()])


@query("m09_rain_labels", "select event_id, cast(coalesce(rainfall>=1,false) as int) as rain_1mm, cast(coalesce(rainfall>=10,false) as int) as rain_10mm, cast(coalesce(rainfall>=25,false) as int) as rain_25mm from v_obs")
def m09(spark, sf):
    return E.rain_labels(V.observations(spark, sf), "rainfall").select("event_id", *C.RAIN_THRESHOLDS)


@query("g24_matching_stats", f"""select 'rows' as metric, 'all' as item, count(*) as n from v_match union all select 'stations','all',count(distinct station_id) from v_match
    union all select 'split', split, count(*) from v_match group by split union all select 'lead', cast(lead_time_hours as varchar), count(*) from v_match group by lead_time_hours
    union all select 'first_time', {stamp('min(observation_time)')}, 1 from v_match union all select 'last_time', {stamp('max(observation_time)')}, 1 from v_match""")
def g24(spark, sf):
    return M.matching_stats(V.matchups(spark, sf))


@query("q15_matchup_suite", f"""select check_id, n_bad, case when n_bad > 0 then sev else 'OK' end as severity from (select unnest(
    ['A duplicate station/time/lead','B null observation time','C negative lead','D qc VALID','D qc SUSPICIOUS','D qc INVALID','E observation time differs from valid time','F valid before issue','G inputs known at issue time','H split overlap',
     'I null station group','J null b0 temperature','J null b1 temperature','J null b2 temperature','J null b3 temperature','K temperature outside -10..55','L humidity outside 0..100','M negative rain','N b0 differs from forecast','O b1 INTERPOLATED','O b1 FALLBACK_B0','P mean b2 temperature','Q mapping fitted on TRAIN only']) as check_id,
    unnest(['ERROR','ERROR','ERROR','INFO','INFO','INFO','ERROR','ERROR','INFO','ERROR','ERROR','ERROR','ERROR','ERROR','ERROR','WARN','WARN','ERROR','ERROR','INFO','INFO','INFO','INFO']) as sev,
    unnest([count(*)-count(distinct (station_id,observation_time,lead_time_hours)), count(*) filter (observation_time is null), count(*) filter (lead_time_hours<0), count(*) filter (qc_status='VALID'), count(*) filter (qc_status='SUSPICIOUS'), count(*) filter (qc_status='INVALID'),
     count(*) filter (observation_time is distinct from valid_time), count(*) filter (valid_time<forecast_issue_time), 0,
     cast(max(observation_time) filter (split='TRAIN') >= min(observation_time) filter (split='CALIBRATION') as bigint) + cast(max(observation_time) filter (split='CALIBRATION') >= min(observation_time) filter (split='TEST') as bigint),
     count(*) filter (station_group is null), count(*) filter (b0_temperature is null), count(*) filter (b1_temperature is null), count(*) filter (b2_temperature is null), count(*) filter (b3_temperature is null),
     count(*) filter (observed_temperature < -10 or observed_temperature > 55), count(*) filter (observed_humidity<0 or observed_humidity>100), count(*) filter (observed_rainfall<0),
     count(*) filter (abs(b0_temperature-forecast_temperature) > 1e-8), count(*) filter (b1_status='INTERPOLATED'), count(*) filter (b1_status='FALLBACK_B0'), cast(round(avg(b2_temperature)) as bigint), 0]) as n_bad
     from v_int join ({_B1}) using (event_id, lead_time_hours))""")
def q15(spark, sf):
    return M.matchup_checks(B.bilinear(V.intervals(spark, sf), V.standard_forecasts(spark, sf)))
