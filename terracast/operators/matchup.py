"""Observation-forecast matchups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.single import attach_row

# fixed values: column contract of the exported matchup table
MATCHUP_COLUMNS = [
    "station_id", "station_group", "observation_time", "forecast_issue_time", "valid_time", "lead_time_hours",
    "latitude_obs", "longitude_obs", "grid_id", "panchayat_id", "forecast_parent_id", "station_elevation", "grid_elevation",
    "observed_temperature", "observed_humidity", "observed_rainfall", "forecast_temperature", "forecast_humidity",
    "forecast_rainfall", "b0_temperature", "b0_humidity", "b0_rainfall", "b1_temperature", "b1_humidity", "b1_rainfall",
    "b1_status", "b2_temperature", "b2_humidity", "b3_temperature", "b3_humidity", "residual_temperature",
    "residual_humidity", "qc_status", "split", "data_status",
]
MATCH_KEYS = ["station_id", "observation_time", "lead_time_hours"]


def split_label(time_col, windows: C.SplitWindows = C.SplitWindows()) -> Column:
    t = F.col(time_col) if isinstance(time_col, str) else time_col
    end = lambda text: F.lit(text).cast("timestamp_ntz")
    return F.when(t <= end(windows.train_end), "TRAIN").when(t <= end(windows.calibration_end), "CALIBRATION").otherwise("TEST")


def relabel_split(time_col: str, ranges: dict[str, tuple[str, str]]) -> Column:
    """Label by closed time ranges; rows outside every range keep the label they have."""
    t, out = F.col(time_col), None
    for name, (lo, hi) in ranges.items():
        hit = t.between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.col("split"))


def match(observations: DataFrame, forecasts: DataFrame, sites: DataFrame | None = None, windows: C.SplitWindows = C.SplitWindows(),
          site_columns: list[str] = ()) -> DataFrame:
    """Observations with the forecasts valid at their hour at their parent point.

    `sites` maps station_id to the parent and other station attributes. The forecast side has
    one row per (valid hour, parent, lead) however many observations there are; which side is
    broadcast is left to the measured sizes.
    """
    obs = observations
    if sites is not None:
        obs = obs.join(sites.select("station_id", "forecast_parent_id", *site_columns), "station_id")
    o = obs.withColumnsRenamed({"latitude": "latitude_obs", "longitude": "longitude_obs"})
    f = forecasts.withColumnsRenamed({"latitude": "latitude_fc", "longitude": "longitude_fc", "forecast_parent_id": "_parent"})
    joined = o.join(f, (F.col("timestamp") == F.col("valid_time")) & (F.col("forecast_parent_id") == F.col("_parent"))).drop("_parent")
    return joined.withColumns({"observation_time": F.col("timestamp"), "split": split_label("timestamp", windows)})


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when a join came out empty."""
    if df.isEmpty():
        raise ValueError(f"{what}: no matching rows; check the time formats of both sides")
    return df


def matching_stats(df: DataFrame) -> DataFrame:
    """Totals and split / lead counts as (metric, item, n) rows."""
    t = "observation_time"
    base = df.agg(F.count("*").alias("n"), F.count_distinct("station_id").alias("s"))
    totals = base.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("metric"), F.lit("all").alias("item"), F.col("n").alias("n")),
        F.struct(F.lit("stations").alias("metric"), F.lit("all").alias("item"), F.col("s").alias("n")),
    )).alias("k")).select("k.*")
    by = lambda name, c: df.groupBy(c.cast("string").alias("item")).agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "item", "n")
    days = df.agg(F.date_format(F.min(t), "yyyy-MM-dd HH:mm:ss").alias("a"), F.date_format(F.max(t), "yyyy-MM-dd HH:mm:ss").alias("b"))
    dates = days.select(F.explode(F.array(
        F.struct(F.lit("first_time").alias("metric"), F.col("a").alias("item"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("last_time").alias("metric"), F.col("b").alias("item"), F.lit(1).cast("bigint").alias("n")),
    )).alias("k")).select("k.*")
    return totals.unionByName(by("split", F.col("split"))).unionByName(by("lead", F.col("lead_time_hours"))).unionByName(dates)


def matchup_checks(df: DataFrame) -> DataFrame:
    """The matchup suite A to Q as check rows; one aggregation plus the duplicate count."""
    from terracast.operators.quality import checks_to_rows, duplicate_count

    c = F.col
    at = lambda fn, s: fn(F.when(c("split") == s, c("observation_time")))
    out_of = lambda x, lo, hi: F.count_if((c(x) < lo) | (c(x) > hi))
    agg = df.agg(
        F.count_if(c("observation_time").isNull()).alias("b"), F.count_if(c("lead_time_hours") < 0).alias("c"),
        *[F.count_if(c("qc_status") == s).alias(f"d_{s.lower()}") for s in ("VALID", "SUSPICIOUS", "INVALID")],
        F.count_if(~c("observation_time").eqNullSafe(c("valid_time"))).alias("e"),
        F.count_if(c("valid_time") < c("forecast_issue_time")).alias("f"),
        at(F.max, "TRAIN").alias("train_max"), at(F.min, "CALIBRATION").alias("cal_min"),
        at(F.max, "CALIBRATION").alias("cal_max"), at(F.min, "TEST").alias("test_min"),
        F.count_if(c("station_group").isNull()).alias("i"),
        *[F.count_if(c(f"b{k}_temperature").isNull()).alias(f"j{k}") for k in range(4) if f"b{k}_temperature" in df.columns],
        out_of("observed_temperature", -10.0, 55.0).alias("k"), out_of("observed_humidity", 0.0, 100.0).alias("l"),
        F.count_if(c("observed_rainfall") < 0).alias("m"),
        F.count_if(F.abs(c("b0_temperature") - c("forecast_temperature")) > 1e-8 + 1e-5 * F.abs(c("forecast_temperature"))).alias("n"),
        *([F.count_if(c("b1_status") == s).alias(f"o_{s.lower()}") for s in ("INTERPOLATED", "FALLBACK_B0")] if "b1_status" in df.columns else []),
        F.round(F.avg("b2_temperature")).alias("p"),
    )
    agg = attach_row(agg, duplicate_count(df, MATCH_KEYS).select(c("duplicates").alias("a")))
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    rows = [("A duplicate station/time/lead", "ERROR", c("a")), ("B null observation time", "ERROR", c("b")), ("C negative lead", "ERROR", c("c"))]
    rows += [(f"D qc {s}", "INFO", c(f"d_{s.lower()}")) for s in ("VALID", "SUSPICIOUS", "INVALID")]
    rows += [
        ("E observation time differs from valid time", "ERROR", c("e")), ("F valid before issue", "ERROR", c("f")),
        ("G inputs known at issue time", "INFO", F.lit(0)),
        ("H split overlap", "ERROR", flag(c("train_max") >= c("cal_min")) + flag(c("cal_max") >= c("test_min"))),
        ("I null station group", "ERROR", c("i")),
    ]
    rows += [(f"J null b{k} temperature", "ERROR", c(f"j{k}")) for k in range(4) if f"j{k}" in agg.columns]
    rows += [
        ("K temperature outside -10..55", "WARN", c("k")), ("L humidity outside 0..100", "WARN", c("l")),
        ("M negative rain", "ERROR", c("m")), ("N b0 differs from forecast", "ERROR", c("n")),
    ]
    rows += [(f"O b1 {s}", "INFO", c(f"o_{s.lower()}")) for s in ("INTERPOLATED", "FALLBACK_B0") if f"o_{s.lower()}" in agg.columns]
    rows += [("P mean b2 temperature", "INFO", c("p")), ("Q mapping fitted on TRAIN only", "INFO", F.lit(0))]
    return checks_to_rows(agg, rows)
