"""Feature, model and calibration queries (M, B-13, E-28, Q-21, Q-23, J-04, P-08)."""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from terracast import config as C
from terracast.operators import attribution as A
from terracast.operators import evaluate as E
from terracast.operators import models as M
from terracast.operators import uncertainty as U
from terracast.operators import villages as G
from terracast.plans import queries_space  # noqa: F401  (defines v_features)
from terracast.plans import views as V
from terracast.plans.registry import query
from terracast.session import reliable_cut, scratch_path, stored_table

KEYS = ["event_id", "lead_time_hours"]


_FITTED: dict[tuple, object] = {}


def fitted(spark, sf, name, build):
    """A model of the library's default settings, fitted once per session and tables: several queries share it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITTED:
        _FITTED[key] = build()
    return _FITTED[key]


def featured(spark, sf):
    """Matchups with cell features, season and residual labels: the stored training table."""
    return stored_table(spark, (sf, "featured"), lambda: _featured(spark, sf))


def _featured(spark, sf):
    m = M.with_season(M.join_features(V.matchups(spark, sf, dealt=True), V.master(spark, sf)))
    return E.rain_labels(m).withColumns({f"y_{v}": F.col(f"observed_{v}") - F.col(f"b2_{v}") for v in ("temperature", "humidity")})


@query("p08_overlap_pruned_join", "select event_id, lead_time_hours, grid_id, m.panchayat_id, g.elevation_mean from v_match m left join (select grid_id, elevation_mean from v_master) g using (grid_id)", "elevation_mean")
def p08(spark, sf):
    return M.join_features(V.matchups(spark, sf).select(*KEYS, "grid_id", "panchayat_id"), V.master(spark, sf)).select(*KEYS, "grid_id", "panchayat_id", "elevation_mean")


@query("j04_feature_join", "select event_id, lead_time_hours, g.elevation_mean, g.distance_to_forecast_grid_m from v_match m left join (select grid_id, elevation_mean, distance_to_forecast_grid_m from v_master) g using (grid_id)", "elevation_mean distance_to_forecast_grid_m")
def j04(spark, sf):
    return M.join_features(V.matchups(spark, sf), V.master(spark, sf)).select(*KEYS, "elevation_mean", "distance_to_forecast_grid_m")


_GEO = "+".join(f"g.{c}" for c in C.GEO_FEATURES)


@query("m02_feature_matrix", f"""select event_id, lead_time_hours, 25::int as n_features, forecast_temperature+forecast_humidity+forecast_rainfall+lead_time_hours+b2_temperature+{_GEO}
    +sin(2e0*pi()*dayofyear(observation_time)/365.25e0)+cos(2e0*pi()*dayofyear(observation_time)/365.25e0)+month(observation_time) as total from v_match m join v_features g using (grid_id)""", "total")
def m02(spark, sf):
    from pyspark.ml import Pipeline

    m = M.with_season(M.join_features(V.matchups(spark, sf), V.master(spark, sf)))
    feats = M.feature_list(m)
    d = M.with_inputs(m, feats)
    v = Pipeline(stages=M.assembler(feats)).fit(d).transform(d).withColumn("v", vector_to_array("features"))
    return v.select(*KEYS, F.size("v").alias("n_features"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("q21_leakage_guard", "select unnest(['forecast_temperature','b2_temperature','observed_humidity','residual_temperature']) as feature, unnest([false,false,true,true]) as forbidden, unnest([count(forecast_temperature),count(b2_temperature),count(observed_humidity),count(residual_temperature)]) as filled from v_match")
def q21(spark, sf):
    from terracast.operators.quality import leakage_guard

    names = ["forecast_temperature", "b2_temperature", "observed_humidity", "residual_temperature"]

    def refused(name):
        try:
            leakage_guard([name])
            return False
        except ValueError:
            return True

    row = V.matchups(spark, sf).agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "feature", "filled")
    bad = [n for n in names if refused(n)]
    return row.withColumn("forbidden", F.col("feature").isin(bad))


def _residual(spark, sf, variable="temperature"):
    f = featured(spark, sf)
    feats = M.feature_list(f, f"b2_{variable}")
    return f, feats, fitted(spark, sf, ("residual", variable), lambda: M.fit_residual(f.filter("split = 'TRAIN'"), feats, f"y_{variable}"))


def _rain(spark, sf, kinds, targets=tuple(C.RAIN_THRESHOLDS)):
    """Rain models by kind and target; those not fitted in this session share their training rows."""
    f = featured(spark, sf)
    names = [(k, t) for k in kinds for t in targets]
    limits = {"logistic": {"max_iter": 1000}}
    new = {n: M.RainModel(n[0], _rain_features(f), n[1], **limits.get(n[0], {})) for n in names if (spark.sparkContext.applicationId, sf, n) not in _FITTED}
    M.fit_events(list(new.values()), f.filter("split = 'TRAIN'"), list(C.RAIN_THRESHOLDS))
    return {n: fitted(spark, sf, n, lambda n=n: new[n]) for n in names}


@query("m04_residual_model")
def m04(spark, sf):
    f, feats, model = _residual(spark, sf)
    return M.predict_residual(model, f, feats, "temperature", "b2_temperature").select(*KEYS, "split", "b2_temperature", "predicted_temperature_residual", "ml_temperature")


@query("m04_residual_model_humidity")
def m04h(spark, sf):
    f, feats, model = _residual(spark, sf, "humidity")
    return M.predict_residual(model, f, feats, "humidity", "b2_humidity").select(*KEYS, "split", "b2_humidity", "predicted_humidity_residual", "ml_humidity")


@query("q23_prediction_sanity_humidity", "select count(*) as rows, 0::bigint as null_ml_humidity from v_match where b2_humidity is not null")
def q23h(spark, sf):
    f, feats, model = _residual(spark, sf, "humidity")
    return M.sanity(M.predict_residual(model, f.filter("b2_humidity is not null"), feats, "humidity", "b2_humidity"), ["ml_humidity"])


@query("q23_prediction_sanity", "select count(*) as rows, 0::bigint as null_ml_temperature from v_match")
def q23(spark, sf):
    f, feats, model = _residual(spark, sf)
    return M.sanity(M.predict_residual(model, f, feats, "temperature", "b2_temperature"), ["ml_temperature"])


def _intervals(spark, sf, variable):
    """Forest quantiles, put in order, conformally widened, on the absolute scale."""
    f = featured(spark, sf)
    label, base = f"y_{variable}", f"b2_{variable}"
    forest = fitted(spark, sf, ("forest", variable), lambda: M.QuantileForest(M.feature_list(f, base), label).fit(f.filter("split = 'TRAIN'")))
    q = forest.transform(f.filter(F.col(base).isNotNull()), KEYS, "r")
    lo, mid, hi = U.monotone("r_q10", "r_q50", "r_q90")
    q = q.select(*KEYS, "split", base, label, lo.alias("r_q10"), mid.alias("r_q50"), hi.alias("r_q90"))
    # scored once: the correction and the intervals read it from here
    q = reliable_cut(q, f"forest-{variable}")
    scores = q.filter("split = 'CALIBRATION'").select(U.conformity_score(label, "r_q10", "r_q90").alias("score"))
    q = U.widen(q, U.conformal_correction(scores), "r_q10", "r_q90", "")
    return U.to_absolute(q, {variable: "r"})


def _interval_columns(variable):
    return [*KEYS, "split", *[f"{q}_{variable}" for q in ("q10", "q50", "q90")], f"{variable}_interval_width", f"{variable}_reliability"]


@query("m05_quantile_forest")
def m05(spark, sf):
    return _intervals(spark, sf, "temperature").select(*_interval_columns("temperature"))


@query("m05_quantile_forest_humidity")
def m05h(spark, sf):
    return _intervals(spark, sf, "humidity").select(*_interval_columns("humidity"))


@query("m05_interval_invariants", """select 'temperature' as variable, count(*) as rows, 0::bigint as missing, 0::bigint as outside, true as covers from v_match where b2_temperature is not null
    union all select 'humidity', count(*), 0::bigint, 0::bigint, true from v_match where b2_humidity is not null""")
def m05i(spark, sf):
    """No quantile is missing, humidity stays in 0 to 100, and CALIBRATION is covered as often as the interval promises."""
    out = None
    for v in ("temperature", "humidity"):
        lo, hi, y = F.col(f"q10_{v}"), F.col(f"q90_{v}"), F.col(f"b2_{v}") + F.col(f"y_{v}")
        held = (F.col("split") == "CALIBRATION") & y.isNotNull()
        if v == "humidity":  # forecasts are held in 0..100, and so is the truth they are compared with
            y = F.least(F.greatest(y, F.lit(0.0)), F.lit(100.0))
        limit = F.lit(v == "humidity") & ((lo < 0) | (hi > 100))
        part = _intervals(spark, sf, v).agg(
            F.count("*").alias("rows"), F.count_if(lo.isNull() | hi.isNull() | F.col(f"q50_{v}").isNull()).alias("missing"), F.count_if(limit).alias("outside"),
            (F.count_if(held & y.between(lo - 1e-9, hi + 1e-9)) >= (1 - C.ALPHA) * F.count_if(held)).alias("covers"),
        ).select(F.lit(v).alias("variable"), "rows", "missing", "outside", "covers")
        out = part if out is None else out.unionByName(part)
    return out


def _rain_features(f):
    return M.feature_list(f, baseline=None)


def _rain_scores(spark, sf, kind, prefix):
    """Event probabilities at every threshold; a threshold without events in TRAIN, or with nothing else, gets its constant."""
    models = {f"{prefix}_{t[5:]}": m for (_, t), m in _rain(spark, sf, [kind]).items()}
    return M.score_all(featured(spark, sf), models).select(*KEYS, *C.RAIN_THRESHOLDS, *models)


@query("m06_logistic_rain")
def m06(spark, sf):
    return _rain_scores(spark, sf, "logistic", "r1")


@query("m07_boosted_rain")
def m07(spark, sf):
    return _rain_scores(spark, sf, "boosted", "r2")


@query("m07_probability_bounds", "select count(*) as n_rows, 0::bigint as n_off from v_match")
def m07b(spark, sf):
    """Rows with a probability that is missing or outside of 0 to 1, at any threshold and of either model: none."""
    _rain(spark, sf, ["logistic", "boosted"])
    both = _rain_scores(spark, sf, "logistic", "r1").join(_rain_scores(spark, sf, "boosted", "r2").drop(*C.RAIN_THRESHOLDS), KEYS)
    names = [f"{k}_{t[5:]}" for k in ("r1", "r2") for t in C.RAIN_THRESHOLDS]
    off = F.exists(F.array(*names), lambda p: p.isNull() | ~p.between(0.0, 1.0))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(off).alias("n_off"))


@query("m08_single_class_guard", "select event_id, lead_time_hours, 0e0 as p from v_match", "p")
def m08(spark, sf):
    f = featured(spark, sf).withColumn("never", (F.col("observed_rainfall") > 1000.0).cast("int"))
    return M.RainModel("boosted", _rain_features(f), "never").fit(f.filter("split = 'TRAIN'")).transform(f, "p").select(*KEYS, "p")


@query("b13_isotonic_calibration",
    """select doc_id, v.p, f.fit as calibrated from v_prob v join (select p, max(m) as fit from (
      select p, min(a) over (partition by j order by i desc) as m from (select l.i as j, r.i as i, r.p, (r.s-l.s+l.y)/(r.w-l.w+l.n) as a
        from (select row_number() over (order by p) as i, p, y, n, sum(y) over (order by p) as s, sum(n) over (order by p) as w from (select p, sum(y)::double as y, count(*)::double as n from v_prob group by 1)) l
        join (select row_number() over (order by p) as i, p, sum(y) over (order by p) as s, sum(n) over (order by p) as w from (select p, sum(y)::double as y, count(*)::double as n from v_prob group by 1)) r on r.i >= l.i)) group by 1) f using (p)""", "p calibrated")
def b13(spark, sf):
    v = V.probabilities(spark, sf)
    return M.IsotonicScaler("p", "y").fit(v).transform(v, "calibrated").select("doc_id", "p", "calibrated")


@query("m10_feature_importance")
def m10(spark, sf):
    f, feats, model = _residual(spark, sf)
    path = scratch_path(spark, "residual-trees")
    model.stages[-1].write().overwrite().save(path)
    return M.tree_importance(spark, path, feats)


@query("m10_permutation_importance")
def m10p(spark, sf):
    f, feats, model = _residual(spark, sf)
    return M.permutation_importance(model, f.filter("split = 'TEST'"), feats, "temperature", "b2_temperature", KEYS)


@query("m10_shapley_attribution")
def m10s(spark, sf):
    """Mean absolute Shapley value of each input over the TEST rows."""
    f, feats, model = _residual(spark, sf)
    return A.mean_attribution(A.attributions(model, f.filter("split = 'TEST'"), feats, KEYS), feats)


@query("m10_shapley_sums", "select count(*) as n_rows, 0::bigint as n_off from v_match where split = 'TEST'")
def m10sum(spark, sf):
    """Rows whose attributions don't add up to the prediction less the mean prediction: none."""
    f, feats, model = _residual(spark, sf)
    test = f.filter("split = 'TEST'")
    told = M.predict_residual(model, test, feats, "temperature", "b2_temperature").select(*KEYS, "predicted_temperature_residual")
    both = A.attributions(model, test, feats, KEYS).join(told, KEYS, "left")
    total = F.col("base") + F.aggregate("shap", F.lit(0.0), lambda a, v: a + v)
    right = F.coalesce(F.abs(total - F.col("predicted_temperature_residual")) < 1e-6, F.lit(False))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(~right).alias("n_off"))


@query("m11_ablation")
def m11(spark, sf):
    return M.ablation(featured(spark, sf), "temperature")


def _rain_models(spark, sf):
    cal = featured(spark, sf).filter("split = 'CALIBRATION'")
    models, calibrators = {}, {}
    for (_, t), m in _rain(spark, sf, ["boosted"]).items():
        raw = f"r2_{t[5:]}"
        models[raw] = m
        calibrators[f"prob_{t[5:]}"] = fitted(spark, sf, ("isotonic", t), lambda m=models[raw], raw=raw, t=t: M.IsotonicScaler(raw, t).fit(m.transform(cal, raw)))
    return models, calibrators


@query("m12_batch_scoring")
def m12(spark, sf):
    f = featured(spark, sf)
    fits = _rain(spark, sf, ["boosted", "logistic"])
    models, cal = _rain_models(spark, sf)
    models |= {f"r1_{t[5:]}": fits["logistic", t] for t in C.RAIN_THRESHOLDS}
    out = M.score_all(M.attach_prior(f, f, ["rain_1mm", "rain_10mm", "rain_25mm"]), models, cal)
    return out.select(*KEYS, "split", *[c for c in out.columns if c.startswith(("r0_", "r1_", "r2_", "prob_"))])


@query("m13_grid_scoring")
def m13(spark, sf):
    models, cal = _rain_models(spark, sf)
    master = V.master(spark, sf)
    cells = G.grid_features(master, V.daily_forecasts(spark, sf), V.test_dates(spark, sf), V.point_registry(spark, sf))
    bound = G.cells_per_village(master).first()["max_cells"]
    return G.village_rainfall(M.score_all(cells, models, cal), largest=bound)


@query("e28_logistic_diagnostic")
def e28(spark, sf):
    f = featured(spark, sf)
    m = _rain(spark, sf, ["logistic"], ["rain_1mm"])["logistic", "rain_1mm"]
    top = m.coefficients(spark).limit(5).select(F.lit("coefficient").alias("kind"), F.col("feature").alias("item"), F.col("coefficient").alias("value"))
    p = m.transform(f, "p")
    spread = E.distribution(p.filter("split <> 'CALIBRATION'"), ["p"], ["split"], extra=False)
    stats = spread.unpivot(["split"], ["min", "mean", "median", "max"], "item", "value").select(F.concat(F.lit("probability "), "split").alias("kind"), "item", "value")
    return top.unionByName(stats)


@query("j08_prediction_attach", "select event_id, lead_time_hours, true as has_prediction from v_match")
def j08p(spark, sf):
    f, feats, model = _residual(spark, sf)
    p = M.predict_residual(model, f, feats, "temperature", "b2_temperature").select(*KEYS, "ml_temperature")
    return V.matchups(spark, sf).select(*KEYS).join(p, KEYS, "left").select(*KEYS, F.col("ml_temperature").isNotNull().alias("has_prediction"))
