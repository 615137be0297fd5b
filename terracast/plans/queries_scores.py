"""Evaluation queries (E, G-18..G-23, B-13 scores, U-01, X-06, X-11, X-22)."""
from __future__ import annotations

from pyspark.sql import functions as F

from terracast import config as C
from terracast.operators import baselines as B
from terracast.operators import evaluate as E
from terracast.plans import views as V
from terracast.plans.oracle import even
from terracast.plans.queries_match import _B1, _B3H, _B3T
from terracast.plans.registry import query

POINT = "avg(abs({p}-{y})) as mae, sqrt(avg(({p}-{y})*({p}-{y}))) as rmse, avg({p}-{y}) as bias"
MODELS = {"B0": "b0_{}", "B2": "b2_{}", "B3": "b3_{}", "ML": "ml_{}"}


def _models(v):
    return {m: c.format(v) for m, c in MODELS.items()}


def _long(v, keep):
    """SQL: one row per model."""
    return " union all ".join(f"select {keep}, '{m}' as model, {c.format(v)} as pred, observed_{v} as y from v_int" for m, c in MODELS.items())


# ---------------------------------------------------------------- point scores
@query("e01_point_scores", "select " + POINT.format(p="b2_temperature", y="observed_temperature") + " from v_match", "mae rmse bias")
def e01(spark, sf):
    return V.matchups(spark, sf).agg(*E.point_scores("observed_temperature", "b2_temperature", None))


@query("e02_null_skipping_scores", "select count(*) filter (observed_humidity is not null) as n, " + POINT.format(p="b2_humidity", y="observed_humidity") + " from v_match", "mae rmse bias")
def e02(spark, sf):
    return V.matchups(spark, sf).agg(F.count("observed_humidity").alias("n"), *E.point_scores("observed_humidity", "b2_humidity", None))


@query("e04_ladder_scores", f"""select model, split, count(*) as record_count, count(*) filter (ok) as valid_count,
    avg(abs(pt-t)) filter (ok) as temp_mae, sqrt(avg((pt-t)*(pt-t)) filter (ok)) as temp_rmse, avg(pt-t) filter (ok) as temp_bias,
    avg(abs(ph-h)) filter (ok) as hum_mae, sqrt(avg((ph-h)*(ph-h)) filter (ok)) as hum_rmse, avg(ph-h) filter (ok) as hum_bias
    from (select model, split, ok, pt, ph, observed_temperature as t, observed_humidity as h from (
      select split, observed_temperature, observed_humidity, qc_status='VALID' as ok, unnest(['B0','B1','B2','B3']) as model,
        unnest([b0_temperature,b1_temperature,b2_temperature,b3_temperature]) as pt, unnest([b0_humidity,b1_humidity,b2_humidity,b3_humidity]) as ph
      from v_match join ({_B1}) using (event_id, lead_time_hours) join ({_B3T}) using (event_id, lead_time_hours) join ({_B3H}) using (event_id, lead_time_hours))) group by 1, 2""",
    "temp_mae temp_rmse temp_bias hum_mae hum_rmse hum_bias")
def e04(spark, sf):
    m = V.stored_matchups(spark, sf)
    rows = B.quantile_map(B.bilinear(m, V.stored_forecasts(spark, sf)), history=m)
    return E.ladder_scores(rows, ["b0", "b1", "b2", "b3"], None)


@query("e05_model_scores", f"select split, model, count(*) as record_count, {POINT.format(p='pred', y='y')}, 'temperature' as target from ({_long('temperature', 'split')}) group by split, model", "mae rmse bias")
def e05(spark, sf):
    return E.model_scores(V.intervals(spark, sf), "temperature", _models("temperature"), ["split"], None)


@query("e03_improvement", f"""select 'humidity' as target, split, b2 as b2_mae, b3 as b3_mae, ml as ml_mae, case when b2=0 then 0e0 else 100e0*(b2-ml)/b2 end as ml_vs_b2_pct, case when b3=0 then 0e0 else 100e0*(b3-ml)/b3 end as ml_vs_b3_pct
    from (select split, avg(abs(pred-y)) filter (model='B2') as b2, avg(abs(pred-y)) filter (model='B3') as b3, avg(abs(pred-y)) filter (model='ML') as ml from ({_long('humidity', 'split')}) group by 1)""",
    "b2_mae b3_mae ml_mae ml_vs_b2_pct ml_vs_b3_pct")
def e03(spark, sf):
    s = E.model_scores(V.intervals(spark, sf), "humidity", _models("humidity"), ["split"], None)
    return E.improvement_table(s, ["B2", "B3"], digits=None)


@query("e06_station_scores", """select station_id, min(station_elevation) as station_elevation, count(*) as record_count, avg(abs(b2_temperature-observed_temperature)) as b2_mae, avg(abs(b3_temperature-observed_temperature)) as b3_mae,
    avg(abs(ml_temperature-observed_temperature)) as ml_mae, case when min(station_elevation) > 500 then 'HIGH (>500m)' else 'LOW (<=500m)' end as elevation_group,
    case when avg(abs(b2_temperature-observed_temperature))=0 then 0e0 else 100e0*(avg(abs(b2_temperature-observed_temperature))-avg(abs(ml_temperature-observed_temperature)))/avg(abs(b2_temperature-observed_temperature)) end as ml_vs_b2_imp_pct,
    case when avg(abs(b3_temperature-observed_temperature))=0 then 0e0 else 100e0*(avg(abs(b3_temperature-observed_temperature))-avg(abs(ml_temperature-observed_temperature)))/avg(abs(b3_temperature-observed_temperature)) end as ml_vs_b3_imp_pct,
    'temperature' as target from v_int where split='TEST' group by 1""", "station_elevation b2_mae b3_mae ml_mae ml_vs_b2_imp_pct ml_vs_b3_imp_pct")
def e06(spark, sf):
    return E.station_scores(V.intervals(spark, sf).filter("split = 'TEST'"), "temperature", digits=None)


@query("e27_station_consistency", "select avg(abs(ml_temperature-observed_temperature)) as weighted_mae, avg(abs(ml_temperature-observed_temperature)) as overall_mae, true as consistent from v_int where split='TEST'", "weighted_mae overall_mae")
def e27(spark, sf):
    t = V.intervals(spark, sf).filter("split = 'TEST'")
    e = F.abs(F.col("ml_temperature") - F.col("observed_temperature"))
    stations = t.groupBy("station_id").agg(F.avg(e).alias("mae"), F.count(e).alias("n")).filter("n > 0")
    return E.consistency(stations, t.agg(F.avg(e).alias("overall_mae")), 1e-6)


@query("u01_target_union", f"select target, split, model, count(*) as record_count, avg(abs(pred-y)) as mae from (select 'temperature' as target, * from ({_long('temperature', 'split')}) union all select 'humidity', * from ({_long('humidity', 'split')})) group by all", "mae")
def u01(spark, sf):
    m = V.intervals(spark, sf)
    both = E.model_scores(m, "temperature", _models("temperature"), ["split"], None).unionByName(E.model_scores(m, "humidity", _models("humidity"), ["split"], None))
    return both.select("target", "split", "model", "record_count", "mae")


# ---------------------------------------------------------------- intervals
_IN = "coalesce(cast(observed_{0} between q10_{0} and q90_{0} as double), 0e0)"
_T, _H = _IN.format("temperature"), _IN.format("humidity")
_COV = f"avg({_T}) as temp_coverage, avg(temperature_interval_width) as temp_mean_width, avg({_H}) as hum_coverage, avg(humidity_interval_width) as hum_mean_width"
_COVD = "temp_coverage temp_mean_width hum_coverage hum_mean_width"


@query("e07_coverage_levels", f"""select 'overall' as level, 'all' as item, count(*) as n_records, {_COV} from v_int union all select 'split', split, count(*), {_COV} from v_int group by split
    union all select 'station', cast(station_id as varchar), count(*), {_COV} from v_int group by station_id union all select 'lead', cast(lead_time_hours as varchar), count(*), {_COV} from v_int group by lead_time_hours""", _COVD)
def e07(spark, sf):
    return E.coverage_levels(V.intervals(spark, sf))


def _q(x, p):
    return f"quantile_cont({x}, {p}e0)"


@query("e08_width_distribution", f"""select split, 'humidity_interval_width' as variable, count(humidity_interval_width) as n, avg(humidity_interval_width) as mean, stddev_samp(humidity_interval_width) as std, min(humidity_interval_width) as min, max(humidity_interval_width) as max,
    {_q('humidity_interval_width', 0.1)} as p10, {_q('humidity_interval_width', 0.5)} as median, {_q('humidity_interval_width', 0.9)} as p90 from v_int group by 1""", "mean std min max p10 median p90")
def e08(spark, sf):
    return E.distribution(V.intervals(spark, sf), ["humidity_interval_width"], ["split"], extra=False)


@query("e08_raw_vs_calibrated", f"""select split, avg({_T}) as raw_coverage, avg(coalesce(cast(observed_temperature between q10_temperature-5e0 and q90_temperature+5e0 as double),0e0)) as cal_coverage from v_int group by 1""", "raw_coverage cal_coverage")
def e08b(spark, sf):
    m = V.intervals(spark, sf).withColumns({"lo": F.col("q10_temperature") - 5.0, "hi": F.col("q90_temperature") + 5.0})
    return m.groupBy("split").agg(F.avg(E.covered("observed_temperature", "q10_temperature", "q90_temperature")).alias("raw_coverage"), F.avg(E.covered("observed_temperature", "lo", "hi")).alias("cal_coverage"))


@query("e09_truth_position", "select split, count(*) as n, avg(coalesce(cast(observed_humidity < q10_humidity as double),0e0)) as below, avg(coalesce(cast(observed_humidity between q10_humidity and q90_humidity as double),0e0)) as inside, avg(coalesce(cast(observed_humidity > q90_humidity as double),0e0)) as above from v_int group by 1", "below inside above")
def e09(spark, sf):
    return E.truth_position(V.intervals(spark, sf), "observed_humidity", "q10_humidity", "q90_humidity", ["split"])


@query("e10_quantile_crossings", """select split, count(*) as n, count(*) filter (a > b) as low_over_mid, count(*) filter (b > c) as mid_over_high, max(greatest(a-b,0e0)) as max_low_over_mid, max(greatest(b-c,0e0)) as max_mid_over_high
    from (select split, b2_temperature as a, b2_temperature*0.9e0+2e0 as b, b2_temperature*0.8e0+5e0 as c from v_match) group by 1""", "max_low_over_mid max_mid_over_high")
def e10(spark, sf):
    t = F.col("b2_temperature")
    return E.crossings(V.matchups(spark, sf).select("split", t.alias("a"), (t * 0.9 + 2.0).alias("b"), (t * 0.8 + 5.0).alias("c")), "a", "b", "c", ["split"])


@query("e11_residual_shift", f"""select *, test_mean-calibration_mean as mean_shift, test_median-calibration_median as median_shift, case when abs(test_mean-calibration_mean) > 10 then 'D' else 'NONE' end as shift_class from (select
    avg(residual_humidity) filter (split='TRAIN') as train_mean, avg(residual_humidity) filter (split='CALIBRATION') as calibration_mean, avg(residual_humidity) filter (split='TEST') as test_mean,
    {_q('residual_humidity', 0.5)} filter (split='TRAIN') as train_median, {_q('residual_humidity', 0.5)} filter (split='CALIBRATION') as calibration_median, {_q('residual_humidity', 0.5)} filter (split='TEST') as test_median from v_match)""",
    "train_mean calibration_mean test_mean train_median calibration_median test_median mean_shift median_shift")
def e11(spark, sf):
    return E.shift(V.matchups(spark, sf), "residual_humidity")


_SER = ["q10_humidity", "q50_humidity", "q90_humidity", "humidity_interval_width"]


def _dist_sql(cols, keys, src, std, qs):
    stats = ", ".join(f"quantile_cont(x, {p}e0) as {n}" for n, p in qs.items())
    rows = " union all ".join(f"select {keys}, '{c}' as variable, {c}::double as x from {src}" for c in cols)
    return f"select {keys}, variable, count(x) as n, avg(x) as mean, {std}(x) as std, min(x) as min, max(x) as max, {stats} from ({rows}) group by {keys}, variable"


@query("e12_prediction_distribution", _dist_sql(_SER, "split", "v_int", "stddev_pop", {"p10": 0.1, "median": 0.5, "p90": 0.9}), "mean std min max p10 median p90")
def e12(spark, sf):
    return E.distribution(V.intervals(spark, sf), _SER, ["split"], std="population", extra=False)


@query("g20_split_distribution", _dist_sql(["residual_temperature", "residual_humidity"], "split", "v_match", "stddev_samp", {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}), "mean std min max p10 p25 median p75 p90")
def g20(spark, sf):
    return E.distribution(V.matchups(spark, sf), ["residual_temperature", "residual_humidity"], ["split"])


@query("e13_elevation_coverage", f"""select split, case when grid_elevation <= m then 'LOW_ELEV' else 'HIGH_ELEV' end as "group", count(*) as n_records, {_COV} from v_int join (select split, quantile_cont(grid_elevation, 0.5e0) as m from v_int group by 1) using (split) group by 1, 2""", _COVD)
def e13(spark, sf):
    return E.elevation_coverage(V.intervals(spark, sf))


@query("e14_interval_bias", "select split, avg(observed_humidity-b2_humidity) as mean_residual, avg(q50_humidity-observed_humidity) as q50_error, avg((q10_humidity+q90_humidity)/2e0-observed_humidity) as midpoint_error, avg(abs(q50_humidity-observed_humidity)) as q50_mae from v_int group by 1", "mean_residual q50_error midpoint_error q50_mae")
def e14(spark, sf):
    return E.interval_bias(V.intervals(spark, sf), "humidity", ["split"])


def _summary(v, keys, cols):
    r = f"observed_{v}-b2_{v}"
    return (f"select {keys}, count(*) as n, avg({r}) as mean_residual, stddev_samp({r}) as std_residual, avg(abs(q50_{v}-observed_{v})) as q50_mae, avg({_IN.format(v)}) as coverage, avg({v}_interval_width) as mean_width, "
            f"quantile_cont({r}, 0.5e0) as median_residual, quantile_cont(q90_{v}-q10_{v}, 0.5e0) as median_width from v_int group by {cols}")


_SUMD = "mean_residual std_residual q50_mae coverage mean_width median_residual median_width"


@query("e15_weekly_summary", _summary("humidity", "cast(day(observation_time)//7 as int) as week", "1"), _SUMD)
def e15(spark, sf):
    # the events span one month, so the period of the monthly table is the week here
    m = V.intervals(spark, sf).withColumn("week", F.floor(F.dayofmonth("observation_time") / 7).cast("int"))
    return E.interval_summary(m, "humidity", ["week"])


@query("e15_monthly_summary", _summary("temperature", "cast(month(observation_time) as int) as month", "1"), _SUMD)
def e15m(spark, sf):
    return E.interval_summary(V.intervals(spark, sf).withColumn("month", F.month("observation_time")), "temperature", ["month"])


@query("e16_split_comparison", _summary("humidity", "split", "split"), _SUMD)
def e16(spark, sf):
    return E.interval_summary(V.intervals(spark, sf), "humidity", ["split"])


@query("e17_reliability_distribution", "select case when temperature_interval_width > 5 then 'LOW' when temperature_interval_width > 3 then 'MEDIUM' else 'HIGH' end as t_class, case when humidity_interval_width > 40 then 'LOW' when humidity_interval_width > 20 then 'MEDIUM' else 'HIGH' end as h_class, count(*) as n from v_int where split='TEST' group by 1, 2")
def e17(spark, sf):
    from terracast.operators.uncertainty import reliability

    t = V.intervals(spark, sf).filter("split = 'TEST'")
    return t.groupBy(reliability("temperature_interval_width", "temperature").alias("t_class"), reliability("humidity_interval_width", "humidity").alias("h_class")).agg(F.count("*").alias("n"))


@query("e25_lead_coverage", f"select split, lead_time_hours, count(*) as n_records, {_COV} from v_int group by 1, 2", _COVD)
def e25(spark, sf):
    return E.coverage(V.intervals(spark, sf), ["split", "lead_time_hours"])


@query("e26_station_coverage", f"select split, station_id, count(*) as n, avg({_H}) as coverage, avg(humidity_interval_width) as mean_width, avg(observed_humidity-b2_humidity) as mean_residual from v_int group by 1, 2", "coverage mean_width mean_residual")
def e26(spark, sf):
    m = V.intervals(spark, sf)
    return m.groupBy("split", "station_id").agg(
        F.count("*").alias("n"), F.avg(E.covered("observed_humidity", "q10_humidity", "q90_humidity")).alias("coverage"),
        F.avg("humidity_interval_width").alias("mean_width"), F.avg(F.col("observed_humidity") - F.col("b2_humidity")).alias("mean_residual"))


# ---------------------------------------------------------------- probabilities
@query("e18_brier", "select lang, avg((p-y)*(p-y)) as brier_score from v_prob group by 1", "brier_score")
def e18(spark, sf):
    return V.probabilities(spark, sf).groupBy("lang").agg(E.brier("p", "y").alias("brier_score"))


_CONT = "count(*) filter (p>=0.5 and y=1) as tp, count(*) filter (p>=0.5 and y<>1) as fp, count(*) filter (p<0.5 and y=1) as fn, count(*) filter (p<0.5 and y<>1) as tn"
_SKILL = "case when tp+fn>0 then tp/(tp+fn) else 0e0 end as pod, case when tp+fp>0 then fp/(tp+fp) else 0e0 end as far, case when tp+fp+fn>0 then tp/(tp+fp+fn) else 0e0 end as csi"


def _scores_sql(keys, src):
    return f"select *, {_SKILL} from (select {keys}, count(*) as records, sum(y)::bigint as event_count, avg(y) as observed_rate, avg(p) as predicted_prob_mean, avg((p-y)*(p-y)) as brier_score, {_CONT} from {src} group by {keys})"


_SD = "observed_rate predicted_prob_mean brier_score pod far csi"


@query("e19_contingency", f"select source, tp, fp, fn, tn, pod, far, csi from ({_scores_sql('source', 'v_prob')})", "pod far csi")
def e19(spark, sf):
    return E.probability_scores(V.probabilities(spark, sf), "p", "y", ["source"]).select("source", "tp", "fp", "fn", "tn", "pod", "far", "csi")


@query("e20_model_threshold_table", _scores_sql("model, threshold", "(select 'raw' as model, '1mm' as threshold, p, y from v_prob union all select 'calibrated', '1mm', p_cal, y from v_prob union all select 'raw', '10mm', p, y2 from v_prob union all select 'calibrated', '10mm', p_cal, y2 from v_prob)"), _SD)
def e20(spark, sf):
    p = V.probabilities(spark, sf).withColumnsRenamed({"y": "rain_1mm", "y2": "rain_10mm"})
    rows = E.long_probabilities(p, {("raw", "1mm"): "p", ("calibrated", "1mm"): "p_cal", ("raw", "10mm"): "p", ("calibrated", "10mm"): "p_cal"}, [])
    return E.probability_scores(rows, "p", "y", ["model", "threshold"])


@query("e21_reliability_curve", """select i*0.2e0 as bin_lower, (i+1)*0.2e0 as bin_upper, coalesce(n,0) as "count", coalesce(pm,(i*0.2e0+(i+1)*0.2e0)/2e0) as mean_pred_prob, coalesce(ym,0e0) as mean_observed_rate from (select unnest(range(5)) as i) b
    left join (select (p>=0.2e0)::int+(p>=0.4e0)::int+(p>=0.2e0*3)::int+(p>=0.8e0)::int as i, count(*) as n, avg(p) as pm, avg(y) as ym from v_prob group by 1) g using (i)""", "bin_lower bin_upper mean_pred_prob mean_observed_rate")
def e21(spark, sf):
    return E.reliability_curve(V.probabilities(spark, sf), "p", "y")


@query("x22_equal_bins", """select k.lang, k.i as bin, coalesce(n,0) as n from (select lang, i from (select distinct lang from v_prob), (select unnest(range(4)) as i)) k
    left join (select lang, least(floor((p*0.3e0)*4)::bigint,3) as i, count(*) as n from v_prob group by all) g using (lang, i)""")
def x22(spark, sf):
    p = V.probabilities(spark, sf).withColumn("p3", F.col("p") * 0.3)
    return E.reliability_curve(p, "p3", "y", 4, ["lang"]).select("lang", (F.col("bin_lower") * 4).cast("bigint").alias("bin"), F.col("count").alias("n"))


def _rain(spark, sf):
    m = E.rain_labels(V.matchups(spark, sf))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("forecast_rainfall") * 0.9 + F.col("lead_time_hours") / 1000.0))
    return m.withColumn("p", p)


_RAIN = "(select *, least(1e0,greatest(0e0,forecast_rainfall*0.9e0+lead_time_hours/1000e0)) as p, coalesce((observed_rainfall>=1)::int,0) as y from v_match)"


@query("e22_station_rain_scores", _scores_sql("station_id", _RAIN), _SD)
def e22(spark, sf):
    return E.probability_scores(_rain(spark, sf), "p", "rain_1mm", ["station_id"])


@query("e23_lead_rain_scores", _scores_sql("lead_time_hours", _RAIN), _SD)
def e23(spark, sf):
    return E.probability_scores(_rain(spark, sf), "p", "rain_1mm", ["lead_time_hours"])


@query("e24_month_rain_scores", _scores_sql("month, month_name", f"(select *, month(observation_time)::int as month, strftime(observation_time,'%B') as month_name from {_RAIN})"), _SD)
def e24(spark, sf):
    m = _rain(spark, sf).withColumns({"month": F.month("observation_time"), "month_name": F.date_format("observation_time", "MMMM")})
    return E.probability_scores(m, "p", "rain_1mm", ["month", "month_name"])


@query("e29_probability_range", """select source, series, min(x) as min, max(x) as max, avg(x) as mean, count(*) filter (x>=0.5) as n_high, sum(y)::bigint as positives, quantile_cont(x,0.5e0) as median from (select source, 'p' as series, p as x, y from v_prob union all select source, 'p_cal', p_cal, y from v_prob) group by 1, 2""", "min max mean median")
def e29(spark, sf):
    return E.probability_range(V.probabilities(spark, sf), ["p", "p_cal"], "y", ["source"])


# ---------------------------------------------------------------- rain events
_LAB = "(select *, coalesce((observed_rainfall>=1)::int,0) as rain_1mm, coalesce((observed_rainfall>=10)::int,0) as rain_10mm, coalesce((observed_rainfall>=25)::int,0) as rain_25mm from v_match)"


@query("g18_event_stats", f"""select split, target, total, events, total-events as non_events, case when total>0 then events/total else 0e0 end as event_rate, case when total>0 then events/total else 0e0 end*100e0 as event_rate_pct from (
    select split, unnest(['rain_1mm','rain_10mm','rain_25mm']) as target, count(*) as total, unnest([sum(rain_1mm)::bigint, sum(rain_10mm)::bigint, sum(rain_25mm)::bigint]) as events from {_LAB} group by split)""", "event_rate event_rate_pct")
def g18(spark, sf):
    return E.event_stats(E.rain_labels(V.matchups(spark, sf)))


@query("g18_empty_splits", f"""select s.split, t.target, coalesce(total,0) as total, coalesce(events,0) as events from (select unnest(['TRAIN','CALIBRATION','TEST']) as split) s, (select unnest(['rain_1mm','rain_10mm','rain_25mm']) as target) t
    left join (select split, unnest(['rain_1mm','rain_10mm','rain_25mm']) as target, count(*) as total, unnest([sum(rain_1mm)::bigint, sum(rain_10mm)::bigint, sum(rain_25mm)::bigint]) as events from {_LAB} where split<>'TEST' group by split) e on e.split=s.split and e.target=t.target""")
def g18e(spark, sf):
    m = E.rain_labels(V.matchups(spark, sf)).filter("split <> 'TEST'")
    return E.event_stats(m).select("split", "target", "total", "events")


@query("g19_climatology", f"select avg(rain_1mm) filter (split='TRAIN') as prior_rain_1mm, avg(rain_10mm) filter (split='TRAIN') as prior_rain_10mm, avg(rain_25mm) filter (split='TRAIN') as prior_rain_25mm from {_LAB}", "prior_rain_1mm prior_rain_10mm prior_rain_25mm")
def g19(spark, sf):
    return E.climatology(E.rain_labels(V.matchups(spark, sf)))


@query("g21_driver_shift", " union all ".join(f"select split, '{c}' as variable, avg({c}) as mean, stddev_samp({c}) as std, max({c}) as max from v_match group by split" for c in ("forecast_rainfall", "forecast_temperature", "forecast_humidity")), "mean std max")
def g21(spark, sf):
    rows = E.long_columns(V.matchups(spark, sf), ["forecast_rainfall", "forecast_temperature", "forecast_humidity"], ["split"])
    return rows.groupBy("split", "variable").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.max("x").alias("max"))


_TH = ", ".join(f"count(*) filter (observed_rainfall>={t}) as {n}, count(*) filter (observed_rainfall>={t})/count(*)*100e0 as {n}_pct" for n, t in C.RAIN_THRESHOLDS.items())


@query("g22_rain_label_audit", f"select split, count(*) as n, {_TH}, count(*) filter (observed_rainfall=0) as zeros, min(observed_rainfall) as min, max(observed_rainfall) as max, avg(observed_rainfall) as mean, quantile_cont(observed_rainfall,0.5e0) as median from v_match group by 1",
    "rain_1mm_pct rain_10mm_pct rain_25mm_pct min max mean median")
def g22(spark, sf):
    return E.rain_label_audit(V.matchups(spark, sf))


@query("g23_rain_by_month", "select month(observation_time)::int as month, strftime(observation_time,'%B') as month_name, count(*) as n, count(*) filter (observed_rainfall=0)/count(*)*100e0 as zero_pct, "
    + ", ".join(f"count(*) filter (observed_rainfall>={t})/count(*)*100e0 as {n}_pct" for n, t in C.RAIN_THRESHOLDS.items()) + ", max(observed_rainfall) as max_rain from v_match group by 1, 2", "zero_pct rain_1mm_pct rain_10mm_pct rain_25mm_pct max_rain")
def g23(spark, sf):
    return E.rain_by_month(V.matchups(spark, sf))


@query("x06_threshold_names", f"select regexp_extract(target,'rain_(.*)$',1) as threshold, sum(events)::bigint as events from (select unnest(['rain_1mm','rain_10mm','rain_25mm']) as target, unnest([sum(rain_1mm), sum(rain_10mm), sum(rain_25mm)]) as events from {_LAB}) group by 1")
def x06(spark, sf):
    e = E.event_stats(E.rain_labels(V.matchups(spark, sf)))
    return e.groupBy(F.regexp_extract("target", "rain_(.*)$", 1).alias("threshold")).agg(F.sum("events").alias("events"))


@query("x17_interpolation", f"select event_id, case when value is null then null when value < 20 then 5e0 when value >= 80 then 30e0 when value < 40 then 5e0+(10e0-5e0)/(40e0-20e0)*(value-20e0) else 10e0+(30e0-10e0)/(80e0-40e0)*(value-40e0) end as mapped, {even('value', 1)} as shown from events", "mapped shown")
def x17(spark, sf):
    from terracast.functions.numbers import half_even, interpolate

    e = V.table(spark, sf, "events").select("event_id", "value", F.array(*[F.lit(x) for x in (20.0, 40.0, 80.0)]).alias("xs"), F.array(*[F.lit(y) for y in (5.0, 10.0, 30.0)]).alias("ys"))
    return interpolate(e, "value", "xs", "ys", "mapped").select("event_id", "mapped", half_even("value", 1).alias("shown"))
