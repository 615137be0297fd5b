"""Serving tables: the read side, precomputed for all villages and stations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.checks import probability_message, weather_messages
from terracast.functions.numbers import col, settle
from terracast.functions.single import attach_row
from terracast.operators.evaluate import long_models
from terracast.operators.matchup import MATCH_KEYS
from terracast.operators.spatial import nearest_station
from terracast.operators.villages import village_profile

# fixed values: defaults of the serving layer
DEFAULT_DATE = "2024-05-01"
DEFAULT_RELIABILITY = {"temperature": "MEDIUM", "humidity": "LOW"}
FRESHNESS = ["FRESH", "AGING", "EXPIRED", "UNAVAILABLE"]


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by the order columns.

    A maximum over a struct combines on the map side, so a key with very many rows is no
    single sorted group.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("k"))
    return best.select(*keys, *[F.col(f"k.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by the order columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("k"))
    return best.select(*keys, *[F.col(f"k.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def lookup(df: DataFrame, key: str, value, time_col: str | None = None, time=None, lead_col: str | None = None, lead=None,
           order: list[str] = ()) -> DataFrame:
    """Rows of one key, optionally at a time and a lead (0 or None: any); the last one wins."""
    out = df.filter(F.col(key) == F.lit(value))
    if time:
        out = out.filter(F.col(time_col) == F.lit(time))
    if lead:
        out = out.filter(F.col(lead_col) == F.lit(lead))
    return latest_per_key(out, [key], list(order))


def join_uncertainty(weather: DataFrame, uncertainty: DataFrame, keys: list[str] = MATCH_KEYS) -> DataFrame:
    """Predictions with the uncertainty columns they lack, by station, time and lead."""
    extra = [c for c in uncertainty.columns if c in keys or c not in weather.columns]
    return weather.join(uncertainty.select(*extra), list(keys), "left")


def gate(value, ok) -> Column:
    """The value where its record is valid, else NULL."""
    return F.when(col(ok), col(value))


def weather_record(df: DataFrame) -> DataFrame:
    """Station weather records with validity; absent optional columns become NULL."""
    out = df
    numbers = [f"{k}_{v}" for v in ("temperature", "humidity") for k in ("ml", "observed", "b0", "b1", "b2", "b3", "q10", "q50", "q90")]
    numbers += ["temperature_interval_width", "humidity_interval_width"]
    out = out.withColumns({c: F.lit(None).cast("double") for c in numbers if c not in out.columns})
    for v, d in DEFAULT_RELIABILITY.items():
        name = f"{v}_reliability"
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(d)) if name in out.columns else F.lit(d))
    msg = weather_messages("ml_temperature", "ml_humidity", ("q10_temperature", "q50_temperature", "q90_temperature"), ("q10_humidity", "q50_humidity", "q90_humidity"))
    return out.withColumn("validation_error", F.nullif(msg, F.lit(""))).withColumn("is_valid", F.col("validation_error").isNull())


def evaluable_thresholds(labelled: DataFrame) -> DataFrame:
    """One row: is there any TRAIN or CALIBRATION event behind each threshold."""
    seen = F.col("split").isin("TRAIN", "CALIBRATION")
    return labelled.agg(*[(F.count_if(seen & (F.col(n) == 1)) > 0).alias(f"is_evaluable_{n[5:]}") for n in C.RAIN_THRESHOLDS])


def rainfall_record(villages: DataFrame, evaluable: DataFrame | None = None) -> DataFrame:
    """Village rain records: probabilities of thresholds that are not evaluable are withheld.

    Without an evaluability row only the 1 mm threshold is served.
    """
    if evaluable is None:
        out = villages.withColumns({"is_evaluable_1mm": F.lit(True), "is_evaluable_10mm": F.lit(False), "is_evaluable_25mm": F.lit(False)})
    else:
        out = attach_row(villages, evaluable)
    out = out.withColumns({f"rain_probability_{t}": gate(f"rain_probability_{t}", f"is_evaluable_{t}") for t in ("10mm", "25mm")})
    out = out.withColumn("validation_error", probability_message("rain_probability_1mm"))
    return out.withColumn("is_valid", F.col("validation_error").isNull())


def village_table(polygons: DataFrame | None, master: DataFrame | None, stations: DataFrame | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """Village list: polygon attributes, overridden by grid means where cells exist, else from predictions."""
    names = ["panchayat_name", "block_name", "district_name"]
    numbers = ["latitude", "longitude", "elevation_mean"]
    prof = None
    if master is not None:
        prof = village_profile(master).withColumn("elevation_mean", settle("elevation_mean", 1))
    if polygons is not None:
        base = polygons.select("panchayat_id", *names, "latitude", "longitude", F.lit(0.0).alias("elevation_mean"), "area_sq_km")
        if prof is None:
            out = base.withColumns({"grid_cell_count": F.lit(None).cast("bigint"), "assignment_mode": F.lit(None).cast("string")})
        else:
            p = prof.withColumnsRenamed({c: f"_p_{c}" for c in [*names, *numbers]})
            out = base.join(p, "panchayat_id", "full")
            out = out.select("panchayat_id", *[F.coalesce(f"_p_{c}", c).alias(c) for c in [*names, *numbers]], "area_sq_km", "grid_cell_count", "assignment_mode")
    elif prof is not None:
        out = prof.withColumn("area_sq_km", F.lit(None).cast("double"))
    else:
        # fixed values: what is known of a village seen in predictions only
        out = predictions.select("panchayat_id").distinct().select(
            "panchayat_id", F.concat(F.lit("Panchayat "), "panchayat_id").alias("panchayat_name"), F.lit("Coimbatore").alias("block_name"),
            F.lit("Coimbatore").alias("district_name"), F.lit(11.0).alias("latitude"), F.lit(77.0).alias("longitude"), F.lit(400.0).alias("elevation_mean"),
            F.lit(None).cast("double").alias("area_sq_km"), F.lit(None).cast("bigint").alias("grid_cell_count"), F.lit(None).cast("string").alias("assignment_mode"),
        )
    if stations is not None:
        out = nearest_station(out, stations)
    return out


def station_registry(primary: DataFrame | None, fallback: DataFrame | None) -> DataFrame:
    """Stations from the first source that has each of them; names are made up for the fallback."""
    cols = ["station_id", "panchayat_id", "panchayat_name", "block_name", "latitude", "longitude", "station_elevation"]
    parts = []
    if primary is not None:
        parts.append(primary.select(*cols).withColumn("priority", F.lit(1)))
    if fallback is not None:
        f = fallback.select(
            "station_id", "panchayat_id", F.concat(F.lit("Station Host "), "panchayat_id").alias("panchayat_name"), F.lit("Coimbatore").alias("block_name"),
            F.col("latitude_obs").alias("latitude"), F.col("longitude_obs").alias("longitude"), "station_elevation",
        )
        parts.append(f.withColumn("priority", F.lit(2)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return first_per_key(both, ["station_id"], ["priority", "panchayat_id", "latitude", "longitude"])


def village_view(villages: DataFrame, rain: DataFrame, weather: DataFrame, reliability: DataFrame, date_col: str = "timestamp") -> DataFrame:
    """All villages with their rain record, the nearest station's weather and optional reliability."""
    w = weather.select(
        F.col("station_id").alias("nearest_station_id"), F.col("observation_date").alias(date_col), F.col("lead_time_hours").alias("lead_time"),
        "ml_temperature", "ml_humidity", F.col("is_valid").alias("weather_valid"),
    )
    out = rain.join(villages.drop("grid_cell_count"), "panchayat_id")
    return out.join(w, ["nearest_station_id", date_col, "lead_time"], "left").join(reliability, "panchayat_id", "left")


def map_table(villages: DataFrame, rain: DataFrame, selected: str | None = None) -> DataFrame:
    """One row per village for the map: probability in percent (0 when absent), status, selection."""
    r = rain.select("panchayat_id", F.col("rain_probability_1mm").alias("_p"), "aggregation_status")
    out = villages.join(r, "panchayat_id", "left")
    return out.select(
        "panchayat_id", "panchayat_name", "block_name", "latitude", "longitude", F.col("elevation_mean").alias("elevation"),
        settle(F.coalesce("_p", F.lit(0.0)) * 100.0, 1).alias("rain_prob_pct"), F.coalesce("aggregation_status", F.lit("OK")).alias("status"),
        F.coalesce(F.col("panchayat_id") == F.lit(selected), F.lit(False)).alias("is_selected"),
    )


def ladder_rows(df: DataFrame, variable: str, keep: list[str]) -> DataFrame:
    """(model, value) rows of the ladder and the truth, missing ones left out."""
    models = {**{f"B{k}": f"b{k}_{variable}" for k in range(4)}, "ML": f"ml_{variable}", "OBSERVED": f"observed_{variable}"}
    return long_models(df, models, keep).withColumnRenamed("pred", "value").filter(F.col("value").isNotNull())


def rain_timeline(rain: DataFrame) -> DataFrame:
    """Date-ordered probabilities in percent per village and lead, as one array each.

    An array has one entry per forecast date.
    """
    pair = F.struct("timestamp", (F.col("rain_probability_1mm") * 100.0).alias("pct"))
    return rain.groupBy("panchayat_id", "lead_time").agg(F.array_sort(F.collect_list(pair)).alias("series"))


def available_leads(rain: DataFrame | None, weather: DataFrame | None = None) -> DataFrame:
    """Sorted distinct lead times in hours: rain table, else weather table, else the fixed ones."""
    for df, c in ((rain, "lead_time"), (weather, "lead_time_hours")):
        if df is not None:
            return df.select(F.col(c).cast("int").alias("lead_time")).where("lead_time is not null").distinct().orderBy("lead_time")
    return SparkSession.active().range(1).select(F.explode(F.array(*[F.lit(h) for h in C.LEADS])).alias("lead_time"))


def available_dates(rain: DataFrame | None, weather: DataFrame | None = None) -> DataFrame:
    """Sorted distinct dates: rain table, else weather table, else the default."""
    for df, c in ((rain, "timestamp"), (weather, "observation_time")):
        if df is not None:
            return df.select(F.col(c).cast("string").alias("date")).distinct().orderBy("date")
    spark = SparkSession.active()
    return spark.range(1).select(F.lit(DEFAULT_DATE).alias("date"))


def system_status(spark, artifacts: dict[str, DataFrame | None], times: tuple[str, str] | None, as_of=None, aging_h: float = 24.0, expired_h: float = 72.0) -> DataFrame:
    """Presence flag per artifact, latest time and a freshness label from its age."""
    flags = spark.createDataFrame([(n, df is not None) for n, df in artifacts.items()], "artifact string, available boolean")
    if times is None or artifacts.get(times[0]) is None:
        return flags.withColumns({"latest_timestamp": F.lit(None).cast("timestamp_ntz"), "freshness": F.lit("UNAVAILABLE")})
    latest = artifacts[times[0]].agg(F.max(F.col(times[1]).cast("timestamp_ntz")).alias("latest_timestamp"))
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
    age = F.timestamp_diff("HOUR", F.col("latest_timestamp"), now)
    label = F.when(F.col("latest_timestamp").isNull(), "UNAVAILABLE").when(age <= aging_h, "FRESH").when(age <= expired_h, "AGING").otherwise("EXPIRED")
    return attach_row(flags, latest).withColumn("freshness", label)

