"""Baseline ladder B0 to B3 and the residual targets."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.numbers import clip, half_even, interpolate
from terracast.functions.single import attach_row
from terracast.operators.evaluate import long_columns
from terracast.operators.quantiles import quantile_array
from terracast.operators.spatial import KEY_SCALE, coordinate_key

VARS = ["temperature", "humidity", "rainfall"]


def coarse(df: DataFrame) -> DataFrame:
    """B0: the parent forecast as it is."""
    return df.withColumns({f"b0_{v}": F.col(f"forecast_{v}") for v in VARS})


def axis_brackets(points: DataFrame, sites: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct site coordinates with the forecast axis values around them.

    Axis values are met per unit band of the axis, so the joins are on equal keys; sites
    whose bracket lies outside the neighbouring bands look it up among band extremes.
    """
    spots = sites.select(lat, lon).distinct()
    for name, axis, c in (("y", "latitude", lat), ("x", "longitude", lon)):
        values = points.select(F.col(axis).alias("_v")).distinct()
        spots = spots.join(_bracket(spots.select(c).distinct(), values, c, name), c)
    return spots


def _bracket(spots: DataFrame, values: DataFrame, c: str, name: str) -> DataFrame:
    """Largest axis value at or below, smallest at or above, in one sorted pass.

    Both sides are laid on one line per band; each band also carries the last value before
    it and the first one after it, from a prefix pass over one row per band.
    """
    from pyspark.sql import Window as W

    # 100 bands per degree keep a band small; there are at most 36,000 of them
    band = F.floor(F.col("_v") * 100).cast("long").alias("_band")
    line = values.select("_v", band, F.lit(True).alias("_axis")).unionByName(
        spots.select(F.col(c).alias("_v")).select("_v", band, F.lit(False).alias("_axis"))
    )
    axis_v = F.when(F.col("_axis"), F.col("_v"))
    ends = line.groupBy("_band").agg(F.min(axis_v).alias("_lo"), F.max(axis_v).alias("_hi"))
    order = W.orderBy("_band")
    ends = ends.select(
        "_band",
        F.last("_hi", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    inner = W.partitionBy("_band").orderBy("_v")
    placed = line.withColumns({
        "_b": F.max(axis_v).over(inner.rangeBetween(W.unboundedPreceding, 0)),
        "_a": F.min(axis_v).over(inner.rangeBetween(0, W.unboundedFollowing)),
    }).filter(~F.col("_axis")).join(ends, "_band")
    return placed.select(
        F.col("_v").alias(c), F.coalesce("_b", "_before").alias(f"{name}0"), F.coalesce("_a", "_after").alias(f"{name}1")
    )


def bilinear(df: DataFrame, forecasts: DataFrame, lat: str = "latitude_obs", lon: str = "longitude_obs", mode: str = "weights") -> DataFrame:
    """B1: weights over the four surrounding points at the same issue and lead, else B0.

    mode "parent" keeps the parent value on interpolated rows and only sets the status.
    """
    c = F.col
    spots = axis_brackets(forecasts.select("latitude", "longitude").distinct(), df, lat, lon)
    spots = spots.filter((c("x0") < c("x1")) & (c("y0") < c("y1")))
    if mode == "weights":
        asked = df.select(lat, lon, "valid_time", "lead_time_hours").distinct().join(spots, [lat, lon])
        met = _weighted(asked, forecasts, lat, lon)
        out = df.join(met, [lat, lon, "valid_time", "lead_time_hours"], "left")
        value = {v: F.when(c("_full"), c(f"_m_{v}")).otherwise(c(f"forecast_{v}")) for v in VARS}
    else:
        out = df.join(spots.select(lat, lon, F.lit(True).alias("_full")), [lat, lon], "left")
        value = {v: c(f"forecast_{v}") for v in VARS}
    out = out.withColumns({f"b1_{v}": half_even(value[v], 2) for v in VARS})
    out = out.withColumn("b1_status", F.when(c("_full"), "INTERPOLATED").otherwise("FALLBACK_B0"))
    return out.drop("_full", *[f"_m_{v}" for v in VARS])


def _weighted(asked: DataFrame, forecasts: DataFrame, lat: str, lon: str) -> DataFrame:
    """Sparse product of corner weights with the forecasts: one join, then four terms per asked site, time and lead.

    A site, time and lead for which a corner has no forecast is left out.
    """
    c = F.col
    u, w = (c(lon) - c("x0")) / (c("x1") - c("x0")), (c(lat) - c("y0")) / (c("y1") - c("y0"))
    corners = [("y0", "x0", (1 - u) * (1 - w)), ("y0", "x1", u * (1 - w)), ("y1", "x0", (1 - u) * w), ("y1", "x1", u * w)]
    key = lambda k: F.round(c(k) * KEY_SCALE).cast("long")
    parts = F.array(*[F.struct(F.lit(i).alias("k"), key(y).alias("_lat_key"), key(x).alias("_lon_key"), wt.alias("w")) for i, (y, x, wt) in enumerate(corners)])
    weights = asked.select(lat, lon, "valid_time", "lead_time_hours", F.explode(parts).alias("p")).select(lat, lon, "valid_time", "lead_time_hours", "p.*")
    fc = forecasts.select("valid_time", "lead_time_hours", *coordinate_key(), *[f"forecast_{v}" for v in VARS])
    terms = weights.join(fc, ["valid_time", "lead_time_hours", "_lat_key", "_lon_key"])
    at = lambda v, i: F.max(F.when(c("k") == i, c("w") * c(f"forecast_{v}")))
    met = terms.groupBy(lat, lon, "valid_time", "lead_time_hours").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), c("k"))).alias("_k"), *[sum((at(v, i) for i in range(4)), F.lit(0.0)).alias(f"_m_{v}") for v in VARS])
    return met.filter(c("_k") == 15).drop("_k").withColumn("_full", F.lit(True))


def lapse_rate(df: DataFrame, gamma: float = C.LAPSE_RATE) -> DataFrame:
    """B2: temperature moved to the station's height; humidity unchanged."""
    ref = F.col("grid_elevation") if "grid_elevation" in df.columns else F.lit(C.DEFAULT_ELEVATION)
    moved = F.col("forecast_temperature") + F.lit(gamma) * (F.col("station_elevation") - ref)
    return df.withColumns({"b2_temperature": half_even(moved, 2), "b2_humidity": F.col("forecast_humidity")})


# baseline column that each variable is mapped from
MAP_SOURCES = {"temperature": "b2_temperature", "humidity": "b0_humidity"}


def fit_quantile_map(train: DataFrame, sources: dict[str, str] = MAP_SOURCES, n: int = C.QUANTILE_LEVELS) -> DataFrame:
    """One row with the source and target quantiles of every variable at n even levels."""
    series = {f"src_{v}": s for v, s in sources.items()} | {f"dst_{v}": f"observed_{v}" for v in sources}
    rows = long_columns(train, list(series.values()), [], "series", "v")
    arrays = quantile_array(rows, "v", [k / (n - 1) for k in range(n)], ["series"], "q")
    return arrays.agg(*[F.max(F.when(F.col("series") == c, F.col("q"))).alias(k) for k, c in series.items()])


def quantile_map(df: DataFrame, sources: dict[str, str] = MAP_SOURCES, n: int = C.QUANTILE_LEVELS, history: DataFrame | None = None) -> DataFrame:
    """B3: empirical quantile mapping fitted on TRAIN, applied to every row.

    `history` holds the rows to fit on where they are at hand before df's later columns are worked out (else df
    itself). Without TRAIN rows the result is the source column itself. The fitted table is one row of arrays of n numbers.
    """
    fitted = fit_quantile_map((df if history is None else history).filter(F.col("split") == "TRAIN"), sources, n)
    out = attach_row(df, fitted)
    for v, s in sources.items():
        out = interpolate(out, s, f"src_{v}", f"dst_{v}", "_m")
        mapped = clip("_m", 0.0, 100.0) if v == "humidity" else F.col("_m")
        have = F.col(f"src_{v}").isNotNull() & F.col(f"dst_{v}").isNotNull()
        out = out.withColumn(f"b3_{v}", F.when(have, half_even(mapped, 2)).otherwise(F.col(s))).drop("_m", f"src_{v}", f"dst_{v}")
    return out


def residuals(df: DataFrame, rounding: bool = True) -> DataFrame:
    """Observed minus baseline: temperature against B2, humidity against B0."""
    r = (lambda c: half_even(c, 2)) if rounding else (lambda c: c)
    return df.withColumns({
        "residual_temperature": r(F.col("observed_temperature") - F.col("b2_temperature")),
        "residual_humidity": r(F.col("observed_humidity") - F.col("b0_humidity")),
    })


def ladder(df: DataFrame, forecasts: DataFrame | None = None) -> DataFrame:
    """All baselines in order; B1 needs the full forecast table. The mapping is fitted before B1, which it doesn't need."""
    history = lapse_rate(coarse(df))
    out = bilinear(history, forecasts) if forecasts is not None else history
    return residuals(quantile_map(out, history=history))
