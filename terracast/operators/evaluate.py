"""Scores of point, interval and probability forecasts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.numbers import half_even, safe_div
from terracast.functions.single import attach_row
from terracast.operators.quantiles import quantile_columns


def _r(c: Column, digits: int | None) -> Column:
    return c if digits is None else half_even(c, digits)


# ---------------------------------------------------------------- point forecasts
def point_scores(truth: str, pred: str, digits: int | None = 4) -> list[Column]:
    """MAE, RMSE and bias over rows where both sides are present; NULL when there are none."""
    e = F.col(pred) - F.col(truth)
    return [_r(F.avg(F.abs(e)), digits).alias("mae"), _r(F.sqrt(F.avg(e * e)), digits).alias("rmse"), _r(F.avg(e), digits).alias("bias")]


def improvement(base, model, digits: int | None = 2) -> Column:
    """Percentage by which the model's error is below the base's; 0 for a zero base."""
    b, m = (F.col(x) if isinstance(x, str) else x for x in (base, model))
    return _r(F.when(b == 0, 0.0).otherwise(F.try_divide((b - m) * 100.0, b)), digits)


def long_models(df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """Model columns as rows (model, pred); one pass, whatever the number of models."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in columns.items() if c in df.columns])
    return df.select(*keep, F.explode(items).alias("k")).select(*keep, "k.model", "k.pred")


def model_scores(df: DataFrame, variable: str, models: dict[str, str], by: list[str] = ("split",), digits: int | None = 4) -> DataFrame:
    """Scores of several models for one variable by group."""
    truth = f"observed_{variable}"
    rows = long_models(df, models, [*by, truth])
    return rows.groupBy(*by, "model").agg(F.count("*").alias("record_count"), *point_scores(truth, "pred", digits)).withColumn("target", F.lit(variable))


def ladder_scores(df: DataFrame, levels: list[str] = ("b0", "b1", "b2", "b3"), digits: int | None = 3) -> DataFrame:
    """Model x split table of both variables, truth restricted to VALID rows."""
    keep = ["split", "qc_status", "observed_temperature", "observed_humidity"]
    items = F.array(*[
        F.struct(F.lit(k.upper()).alias("model"), F.col(f"{k}_temperature").alias("pt"), F.col(f"{k}_humidity").alias("ph")) for k in levels
    ])
    rows = df.select(*keep, F.explode(items).alias("k")).select(*keep, "k.*")
    ok = F.col("qc_status") == "VALID"
    out = []
    for short, truth, pred in (("temp", "observed_temperature", "pt"), ("hum", "observed_humidity", "ph")):
        e = F.when(ok, F.col(pred) - F.col(truth))
        out += [
            _r(F.avg(F.abs(e)), digits).alias(f"{short}_mae"), _r(F.sqrt(F.avg(e * e)), digits).alias(f"{short}_rmse"),
            _r(F.avg(e), digits).alias(f"{short}_bias"),
        ]
    return rows.groupBy("model", "split").agg(F.count("*").alias("record_count"), F.count_if(ok).alias("valid_count"), *out)


def improvement_table(scores: DataFrame, base_models: list[str], model: str = "ML", keys: list[str] = ("target", "split"), digits: int | None = 2) -> DataFrame:
    """MAE improvement of one model over others, from a score table."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("mae"))).alias(f"{m.lower()}_mae")
    wide = scores.groupBy(*keys).agg(*[pick(m) for m in [*base_models, model]])
    return wide.withColumns({f"{model.lower()}_vs_{b.lower()}_pct": improvement(f"{b.lower()}_mae", f"{model.lower()}_mae", digits) for b in base_models})


def station_scores(test: DataFrame, variable: str, models: list[str] = ("b2", "b3", "ml"), digits: int | None = 4) -> DataFrame:
    """Per station: elevation group, MAE of each model, improvements of the last one."""
    truth = F.col(f"observed_{variable}")
    mae = [_r(F.avg(F.abs(F.col(f"{m}_{variable}") - truth)), digits).alias(f"{m}_mae") for m in models]
    out = test.groupBy("station_id").agg(F.min("station_elevation").alias("station_elevation"), F.count("*").alias("record_count"), *mae)
    out = out.withColumn("elevation_group", F.when(F.col("station_elevation") > C.HIGH_STATION_M, "HIGH (>500m)").otherwise("LOW (<=500m)"))
    last = models[-1]
    pct = None if digits is None else 2
    return out.withColumns({f"{last}_vs_{m}_imp_pct": improvement(f"{m}_mae", f"{last}_mae", pct) for m in models[:-1]}).withColumn("target", F.lit(variable))


def consistency(station_table: DataFrame, overall_mae: DataFrame, tolerance: float) -> DataFrame:
    """Record-weighted station MAE against the overall MAE."""
    w = station_table.agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("weighted_mae"))
    return attach_row(w, overall_mae).withColumn(
        "consistent", F.abs(F.col("weighted_mae") - F.col("overall_mae")) <= tolerance
    )


# ---------------------------------------------------------------- intervals
def covered(truth: str, lo: str, hi: str) -> Column:
    """1.0 inside the closed interval, else 0.0; a missing truth counts as not covered."""
    return F.coalesce(F.col(truth).between(F.col(lo), F.col(hi)).cast("double"), F.lit(0.0))


def coverage(df: DataFrame, by: list[str], variables: list[str] = ("temperature", "humidity"), lo: str = "q10", hi: str = "q90") -> DataFrame:
    aggs = [F.count("*").alias("n_records")]
    for v in variables:
        s = {"temperature": "temp", "humidity": "hum"}[v]
        aggs += [F.avg(covered(f"observed_{v}", f"{lo}_{v}", f"{hi}_{v}")).alias(f"{s}_coverage"),
                 F.avg(F.col(f"{hi}_{v}") - F.col(f"{lo}_{v}")).alias(f"{s}_mean_width")]
    return df.groupBy(*by).agg(*aggs)


def coverage_levels(df: DataFrame) -> DataFrame:
    """Coverage overall, by split, by station and by lead in one pass."""
    dims = ["split", "station_id", "lead_time_hours"]
    sets = [[], [F.col("split")], [F.col("station_id")], [F.col("lead_time_hours")]]
    base = df.withColumns({
        "_t": covered("observed_temperature", "q10_temperature", "q90_temperature"), "_tw": F.col("q90_temperature") - F.col("q10_temperature"),
        "_h": covered("observed_humidity", "q10_humidity", "q90_humidity"), "_hw": F.col("q90_humidity") - F.col("q10_humidity"),
    })
    out = base.groupingSets(sets, *dims).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n_records"), F.avg("_t").alias("temp_coverage"), F.avg("_tw").alias("temp_mean_width"),
        F.avg("_h").alias("hum_coverage"), F.avg("_hw").alias("hum_mean_width"),
    )
    names = {7: "overall", 3: "split", 5: "station", 6: "lead"}
    level = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[F.col("gid").cast("int")]
    item = F.coalesce("split", F.col("station_id").cast("string"), F.col("lead_time_hours").cast("string"), F.lit("all"))
    return out.select(level.alias("level"), item.alias("item"), "n_records", "temp_coverage", "temp_mean_width", "hum_coverage", "hum_mean_width")


def truth_position(df: DataFrame, truth: str, lo: str, hi: str, by: list[str]) -> DataFrame:
    """Shares of truths below, inside and above their interval."""
    t = F.col(truth)
    share = lambda cond: F.avg(F.coalesce(cond.cast("double"), F.lit(0.0)))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), share(t < F.col(lo)).alias("below"), share(t.between(F.col(lo), F.col(hi))).alias("inside"), share(t > F.col(hi)).alias("above")
    )


def crossings(df: DataFrame, lo: str, mid: str, hi: str, by: list[str]) -> DataFrame:
    """Counts and largest size of quantile crossings."""
    over = lambda a, b: F.max(F.greatest(F.col(a) - F.col(b), F.lit(0.0)))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col(lo) > F.col(mid)).alias("low_over_mid"), F.count_if(F.col(mid) > F.col(hi)).alias("mid_over_high"),
        over(lo, mid).alias("max_low_over_mid"), over(mid, hi).alias("max_mid_over_high"),
    )


def long_columns(df: DataFrame, columns: list[str], keep: list[str], name: str = "variable", value: str = "x") -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.explode(items).alias("k")).select(*keep, f"k.{name}", f"k.{value}")


def distribution(df: DataFrame, columns: list[str], by: list[str], std: str = "sample", extra: bool = True) -> DataFrame:
    """Mean, std, min, max, median and percentiles of columns by group.

    Percentiles are exact order statistics found without gathering a group in one task.
    """
    rows = long_columns(df, columns, by)
    keys = [*by, "variable"]
    spread = F.stddev_samp("x") if std == "sample" else F.stddev_pop("x")
    moments = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), spread.alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    levels = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9} if extra else {"p10": 0.1, "median": 0.5, "p90": 0.9}
    return moments.join(quantile_columns(rows, "x", levels, keys), keys)


def shift(df: DataFrame, value: str, a: str = "CALIBRATION", b: str = "TEST") -> DataFrame:
    """Mean and median per split side by side, their difference, and the shift class."""
    base = df.groupBy("split").agg(F.avg(value).alias("mean"))
    med = quantile_columns(df, value, {"median": 0.5}, ["split"])
    t = base.join(med, "split")
    pick = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c)))
    wide = t.agg(*[pick(c, s).alias(f"{s.lower()}_{c}") for c in ("mean", "median") for s in C.ALL_SPLITS])
    d = F.col(f"{b.lower()}_mean") - F.col(f"{a.lower()}_mean")
    return wide.withColumns({
        "mean_shift": d, "median_shift": F.col(f"{b.lower()}_median") - F.col(f"{a.lower()}_median"),
        "shift_class": F.when(F.abs(d) > C.SHIFT_LIMIT, "D").otherwise("NONE"),
    })


def elevation_coverage(df: DataFrame, elevation: str = "grid_elevation") -> DataFrame:
    """Coverage of cells at or below, and above, the median elevation of their split."""
    med = quantile_columns(df, elevation, {"median_elevation": 0.5}, ["split"])
    tagged = df.join(med, "split").withColumn("group", F.when(F.col(elevation) <= F.col("median_elevation"), "LOW_ELEV").otherwise("HIGH_ELEV"))
    return coverage(tagged.filter(F.col(elevation).isNotNull()), ["split", "group"])


def interval_bias(df: DataFrame, variable: str, by: list[str]) -> DataFrame:
    """Errors of the median and of the interval midpoint, and the median's MAE."""
    y, mid = F.col(f"observed_{variable}"), F.col(f"q50_{variable}")
    centre = (F.col(f"q10_{variable}") + F.col(f"q90_{variable}")) / 2.0
    return df.groupBy(*by).agg(
        F.avg(y - F.col(f"b2_{variable}")).alias("mean_residual"), F.avg(mid - y).alias("q50_error"),
        F.avg(centre - y).alias("midpoint_error"), F.avg(F.abs(mid - y)).alias("q50_mae"),
    )


def interval_summary(df: DataFrame, variable: str, by: list[str]) -> DataFrame:
    """Residual, coverage and width table by group (month, split, station, lead)."""
    y, b2 = F.col(f"observed_{variable}"), F.col(f"b2_{variable}")
    base = df.withColumns({"_res": y - b2, "_w": F.col(f"q90_{variable}") - F.col(f"q10_{variable}")})
    main = base.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("_res").alias("mean_residual"), F.stddev_samp("_res").alias("std_residual"),
        F.avg(F.abs(F.col(f"q50_{variable}") - y)).alias("q50_mae"),
        F.avg(covered(f"observed_{variable}", f"q10_{variable}", f"q90_{variable}")).alias("coverage"), F.avg("_w").alias("mean_width"),
    )
    res = quantile_columns(base, "_res", {"median_residual": 0.5}, by)
    wid = quantile_columns(base, "_w", {"median_width": 0.5}, by)
    return main.join(res, list(by), "left").join(wid, list(by), "left")


# ---------------------------------------------------------------- probabilities
def brier(p: str, y: str) -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def contingency(p: str, y: str, threshold: float = C.DECISION_THRESHOLD) -> list[Column]:
    yes, hit = F.col(p) >= threshold, F.col(y) == 1
    return [F.count_if(yes & hit).alias("tp"), F.count_if(yes & ~hit).alias("fp"), F.count_if(~yes & hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn")]


def with_skill(df: DataFrame) -> DataFrame:
    """POD, FAR and CSI from the four counts; 0 where a denominator is empty."""
    c = F.col
    return df.withColumns({
        "pod": safe_div(c("tp"), c("tp") + c("fn")), "far": safe_div(c("fp"), c("tp") + c("fp")), "csi": safe_div(c("tp"), c("tp") + c("fp") + c("fn")),
    })


def probability_scores(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    out = df.groupBy(*by).agg(
        F.count("*").alias("records"), F.sum(F.col(y).cast("bigint")).alias("event_count"), F.avg(F.col(y).cast("double")).alias("observed_rate"),
        F.avg(p).alias("predicted_prob_mean"), brier(p, y).alias("brier_score"), *contingency(p, y),
    )
    return with_skill(out)


def long_probabilities(df: DataFrame, columns: dict[tuple[str, str], str], keep: list[str]) -> DataFrame:
    """(model, threshold) -> probability column, as rows with the matching label y."""
    items = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(t).alias("threshold"), F.col(c).alias("p"), F.col(f"rain_{t}").alias("y")) for (m, t), c in columns.items()
    ])
    return df.select(*keep, F.explode(items).alias("k")).select(*keep, "k.*")


def reliability_curve(df: DataFrame, p: str, y: str, bins: int = 5, by: list[str] = ()) -> DataFrame:
    """Equal-width bins, last one closed; an empty bin shows its midpoint and rate 0."""
    by = list(by)
    step = 1.0 / bins
    b = sum(((F.col(p) >= F.lit(i * step)).cast("int") for i in range(1, bins)), F.lit(0))
    got = df.filter(F.col(p).isNotNull()).groupBy(*by, b.alias("bin")).agg(
        F.count("*").alias("_n"), F.avg(p).alias("_p"), F.avg(F.col(y).cast("double")).alias("_y"))
    frame = got.select(*by).distinct() if by else got.agg(F.lit(1).alias("_one"))
    frame = frame.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo, hi = F.col("bin") * F.lit(step), (F.col("bin") + 1) * F.lit(step)
    return frame.join(got, [*by, "bin"], "left").select(
        *by, lo.alias("bin_lower"), hi.alias("bin_upper"), F.coalesce("_n", F.lit(0)).alias("count"),
        F.coalesce("_p", (lo + hi) / 2.0).alias("mean_pred_prob"), F.coalesce("_y", F.lit(0.0)).alias("mean_observed_rate"),
    )


def probability_range(df: DataFrame, columns: list[str], y: str, by: list[str]) -> DataFrame:
    """Range, mean, median, count at or above the threshold, and positives, raw against calibrated."""
    rows = long_columns(df, columns, [*by, y], "series", "p")
    keys = [*by, "series"]
    main = rows.groupBy(*keys).agg(
        F.min("p").alias("min"), F.max("p").alias("max"), F.avg("p").alias("mean"),
        F.count_if(F.col("p") >= C.DECISION_THRESHOLD).alias("n_high"), F.sum(F.col(y).cast("bigint")).alias("positives"),
    )
    return main.join(quantile_columns(rows, "p", {"median": 0.5}, keys), keys)


# ---------------------------------------------------------------- rain events
def rain_labels(df: DataFrame, column: str = "observed_rainfall") -> DataFrame:
    """0/1 labels per threshold; missing rain counts as no event."""
    return df.withColumns({n: F.coalesce((F.col(column) >= t).cast("int"), F.lit(0)) for n, t in C.RAIN_THRESHOLDS.items()})


def event_stats(df: DataFrame) -> DataFrame:
    """Events per threshold and split over the full 3 x 3 frame; empty splits give zeros."""
    names = list(C.RAIN_THRESHOLDS)
    got = df.groupBy("split").agg(F.count("*").alias("total"), *[F.sum(F.col(n).cast("bigint")).alias(n) for n in names])
    rows = got.select("split", "total", F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.col(n).alias("events")) for n in names])).alias("k"))
    rows = rows.select("split", "total", "k.target", "k.events")
    frame = rows.agg(F.lit(1).alias("_one")).select(F.explode(F.array(*[F.lit(s) for s in C.ALL_SPLITS])).alias("split"))
    frame = frame.select("split", F.explode(F.array(*[F.lit(n) for n in names])).alias("target"))
    out = frame.join(rows, ["split", "target"], "left").fillna(0, ["total", "events"])
    rate = safe_div("events", "total")
    return out.withColumns({"non_events": F.col("total") - F.col("events"), "event_rate": rate, "event_rate_pct": rate * 100.0})


def rain_label_audit(df: DataFrame) -> DataFrame:
    """Per split: counts and shares at the thresholds, exact zeros, range, mean, median."""
    r = F.col("observed_rainfall")
    aggs = [F.count("*").alias("n")]
    for n, t in C.RAIN_THRESHOLDS.items():
        aggs += [F.count_if(r >= t).alias(n), (F.count_if(r >= t) / F.count("*") * 100.0).alias(f"{n}_pct")]
    aggs += [F.count_if(r == 0).alias("zeros"), F.min(r).alias("min"), F.max(r).alias("max"), F.avg(r).alias("mean")]
    return df.groupBy("split").agg(*aggs).join(quantile_columns(df, "observed_rainfall", {"median": 0.5}, ["split"]), "split")


def rain_by_month(df: DataFrame, time_col: str = "observation_time") -> DataFrame:
    """Zero share, exceedance shares and maximum per month."""
    r = F.col("observed_rainfall")
    pct = lambda cond: F.count_if(cond) / F.count("*") * 100.0
    return df.groupBy(F.month(time_col).alias("month"), F.date_format(time_col, "MMMM").alias("month_name")).agg(
        F.count("*").alias("n"), pct(r == 0).alias("zero_pct"), *[pct(r >= t).alias(f"{n}_pct") for n, t in C.RAIN_THRESHOLDS.items()], F.max(r).alias("max_rain"),
    )


def climatology(df: DataFrame, targets: list[str] = tuple(C.RAIN_THRESHOLDS)) -> DataFrame:
    """Mean TRAIN label per threshold, 0 without TRAIN rows: one row."""
    return df.agg(*[F.coalesce(F.avg(F.when(F.col("split") == "TRAIN", F.col(t).cast("double"))), F.lit(0.0)).alias(f"prior_{t}") for t in targets])
