"""Ingest quality: field contract, value classes, one-pass check suites, reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions.numbers import half_even, to_number
from terracast.functions.single import attach_row
from terracast.functions.times import parse_time

QC_STATES = ["VALID", "MISSING", "SUSPICIOUS", "INVALID"]


# ---------------------------------------------------------------- columns and fields
def find_column(df: DataFrame, name: str) -> str | None:
    """Column of that name whatever its case."""
    wanted = name.casefold()
    return next((c for c in df.columns if c.casefold() == wanted), None)


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename raw columns to canonical names; mapping is {canonical: raw}."""
    renames = {raw: name for name, raw in mapping.items() if raw != name and raw in df.columns}
    return df.withColumnsRenamed(renames) if renames else df


def field_presence(df: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """One row per contracted field: is it there, and what its absence means."""
    rows = [(f, kind, find_column(df, f) is not None) for kind, fs in (("required", required), ("optional", optional)) for f in fs]
    spark = df.sparkSession
    out = spark.createDataFrame(rows, "field string, kind string, present boolean")
    missing = ~F.col("present")
    return out.withColumn(
        "severity", F.when(missing & (F.col("kind") == "required"), "ERROR").when(missing, "INFO").otherwise("OK")
    )


# ---------------------------------------------------------------- value classes
def qc_class(raw, variable: str) -> Column:
    """MISSING / INVALID / SUSPICIOUS / VALID of one raw value; nothing is removed."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    x = to_number(raw)
    state = F.when(raw.isNull(), "MISSING").when(x.isNull(), "INVALID")
    if variable in C.HARD_LIMITS:
        lo, hi = C.HARD_LIMITS[variable]
        state = state.when(~x.between(lo, hi), "INVALID")
    if variable in C.SOFT_LIMITS:
        lo, hi = C.SOFT_LIMITS[variable]
        state = state.when(~x.between(lo, hi), "SUSPICIOUS")
    return state.otherwise("VALID")


def with_qc(df: DataFrame, variables: list[str] = C.WEATHER_VARIABLES) -> DataFrame:
    """Add qc_<variable> beside the raw columns, in one projection."""
    found = {v: find_column(df, v) for v in variables}
    return df.withColumns({f"qc_{v}": qc_class(c, v) for v, c in found.items() if c})


def row_status(columns: list[str]) -> Column:
    """Row state from per-variable states; MISSING counts as VALID."""
    if not columns:
        return F.lit("VALID")
    states = F.array(*[F.col(c) for c in columns])
    return (
        F.when(F.array_contains(states, "INVALID"), "INVALID")
        .when(F.array_contains(states, "SUSPICIOUS"), "SUSPICIOUS")
        .otherwise("VALID")
    )


def with_row_status(df: DataFrame) -> DataFrame:
    if "qc_status" in df.columns:
        return df
    return df.withColumn("qc_status", row_status([c for c in df.columns if c.startswith("qc_")]))


def qc_summary(df: DataFrame) -> DataFrame:
    """Counts per qc column and state."""
    cols = [c for c in df.columns if c.startswith("qc_") and c != "qc_status"]
    return (
        df.select(*cols)
        .unpivot([], cols, "variable", "status")
        .groupBy("variable", "status")
        .agg(F.count("*").alias("n"))
    )


# ---------------------------------------------------------------- counts
def missing_stats(df: DataFrame) -> DataFrame:
    """Columns that have nulls: count, percentage (2 decimals), severity. One pass."""
    row = df.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns if c != "total"]
    )
    pct = half_even(F.col("n_missing") / F.col("total") * 100.0, 2)
    return (
        row.unpivot(["total"], [c for c in row.columns if c != "total"], "column", "n_missing")
        .filter("n_missing > 0")
        .withColumn("pct", F.when(F.col("total") > 0, pct).otherwise(0.0))
        .withColumn(
            "severity",
            F.when(F.col("pct") >= C.MISSING_FAIL_PCT, "ERROR").when(F.col("pct") >= C.MISSING_WARN_PCT, "WARN").otherwise("INFO"),
        )
    )


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key set. NULL keys compare equal.

    Counts are summed per key before the final total, so a key that holds a large share
    of the rows is reduced on the map side.
    """
    return (
        df.groupBy(*keys).agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
             F.coalesce(F.sum("_n"), F.lit(0)).alias("records"))
    )


def checks_to_rows(agg: DataFrame, checks: list[tuple[str, str, Column]], keep: list[str] = ()) -> DataFrame:
    """One aggregated row -> check rows (check_id, severity when it fails, n_bad)."""
    items = F.array(*[
        F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), n.cast("bigint").alias("n_bad")) for i, s, n in checks
    ])
    return (
        agg.select(*keep, F.explode(items).alias("k"))
        .select(*keep, "k.check_id", "k.n_bad", F.when(F.col("k.n_bad") > 0, F.col("k.severity")).otherwise("OK").alias("severity"))
    )


def bounds_checks(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> list:
    b = C.COUNTRY_BOUNDS
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    return [
        ("south_bound", "WARN", flag(lat_min < b["lat_min"])),
        ("north_bound", "WARN", flag(lat_max > b["lat_max"])),
        ("west_bound", "WARN", flag(lon_min < b["lon_min"])),
        ("east_bound", "WARN", flag(lon_max > b["lon_max"])),
    ]


# ---------------------------------------------------------------- suites
def observation_checks(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Station ids, timestamps, coordinates and bounds in one aggregation.

    `keep` groups the suite, for instance per file.
    """
    keep = list(keep)
    lat, lon, ts = find_column(df, "latitude"), find_column(df, "longitude"), find_column(df, "timestamp") or find_column(df, "date")
    lat_x, lon_x = to_number(lat), to_number(lon)
    agg = df.groupBy(*keep).agg(
        F.count("*").alias("records"),
        F.count_if(F.col("station_id").isNull()).alias("null_station"),
        F.count_if(F.col(ts).isNotNull() & parse_time(ts).isNull()).alias("bad_time"),
        F.count_if(F.col(lat).isNull()).alias("null_lat"),
        F.count_if(F.col(lon).isNull()).alias("null_lon"),
        F.count_if(F.col(lat).isNotNull() & lat_x.isNull()).alias("bad_lat"),
        F.count_if(F.col(lon).isNotNull() & lon_x.isNull()).alias("bad_lon"),
        F.min(lat_x).alias("lat_min"), F.max(lat_x).alias("lat_max"),
        F.min(lon_x).alias("lon_min"), F.max(lon_x).alias("lon_max"),
    )
    c = F.col
    checks = [
        ("null_station_id", "WARN", c("null_station")),
        ("unparseable_timestamp", "WARN", c("bad_time")),
        ("null_latitude", "WARN", c("null_lat")),
        ("null_longitude", "WARN", c("null_lon")),
        ("non_numeric_latitude", "WARN", c("bad_lat")),
        ("non_numeric_longitude", "WARN", c("bad_lon")),
    ] + bounds_checks(c("lat_min"), c("lat_max"), c("lon_min"), c("lon_max"))
    return checks_to_rows(agg, checks, keep)


def forecast_checks(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Parseable times, valid before issue, negative and missing leads."""
    keep = list(keep)
    # parsed in a step of its own: each time is used three times
    df = df.select(*keep, "forecast_issue_time", "valid_time", parse_time("forecast_issue_time").alias("_issue"), parse_time("valid_time").alias("_valid"), to_number("lead_time").alias("_lead"))
    issue, valid, lead = F.col("_issue"), F.col("_valid"), F.col("_lead")
    agg = df.groupBy(*keep).agg(
        F.count_if(F.col("forecast_issue_time").isNotNull() & issue.isNull()).alias("bad_issue"),
        F.count_if(F.col("valid_time").isNotNull() & valid.isNull()).alias("bad_valid"),
        F.count_if(valid < issue).alias("backwards"),
        F.count_if(lead < 0).alias("negative"),
        F.count_if(lead.isNull()).alias("no_lead"),
    )
    return checks_to_rows(agg, [
        ("unparseable_issue_time", "WARN", F.col("bad_issue")),
        ("unparseable_valid_time", "WARN", F.col("bad_valid")),
        ("valid_before_issue", "WARN", F.col("backwards")),
        ("negative_lead", "WARN", F.col("negative")),
        ("null_lead", "WARN", F.col("no_lead")),
    ], keep)


def format_checks(df: DataFrame, path_col, expected: tuple) -> DataFrame:
    """Extension of every source file against the accepted set."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return (
        df.select(F.col(path_col).alias("path")).distinct()
        .withColumn("extension", ext)
        .withColumn("severity", F.when(F.col("extension").isin(*expected), "OK").otherwise("WARN"))
    )


def extents(df: DataFrame, time_col: str = "timestamp", lat: str = "latitude", lon: str = "longitude", keep: list[str] = ()) -> DataFrame:
    """Record count with the space and time extent."""
    t, la, lo = parse_time(time_col), to_number(lat), to_number(lon)
    return df.groupBy(*keep).agg(
        F.count("*").alias("record_count"),
        F.date_format(F.min(t), "yyyy-MM-dd").alias("start_date"), F.date_format(F.max(t), "yyyy-MM-dd").alias("end_date"),
        F.min(la).alias("min_lat"), F.max(la).alias("max_lat"), F.min(lo).alias("min_lon"), F.max(lo).alias("max_lon"),
    )


def dataset_report(df: DataFrame, spec: C.SourceSpec, checks: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """One nested row: extents, counts, warnings, errors and the resulting status."""
    fields = field_presence(df, spec.required, spec.optional)
    lost = fields.filter((F.col("kind") == "required") & ~F.col("present"))
    miss = missing_stats(df)
    issues = (
        checks.filter("severity <> 'OK'").select("severity", F.concat_ws(": ", "check_id", F.col("n_bad").cast("string")).alias("message"))
        .unionByName(lost.select(F.lit("ERROR").alias("severity"), F.concat(F.lit("missing field: "), "field").alias("message")))
        .unionByName(miss.filter("severity <> 'INFO'").select("severity", F.concat(F.lit("missing values: "), "column", F.lit(" "), F.col("pct").cast("string"), F.lit("%")).alias("message")))
    )
    text = lambda s: F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.col("message"))))
    found = issues.agg(text("WARN").alias("warnings"), text("ERROR").alias("errors"))
    counts = miss.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "n_missing")))).alias("missing_value_counts"))
    present = fields.agg(F.array_sort(F.collect_list(F.when(F.col("present"), F.col("field")))).alias("fields_present"))
    one = extents(df, time_col)
    for part in (found, counts, present):
        one = attach_row(one, part)
    return one.select(
        F.lit(spec.name).alias("dataset_name"),
        F.when(F.size("errors") == 0, "READY").otherwise("PARTIAL").alias("status"),
        "record_count",
        F.struct("min_lat", "max_lat", "min_lon", "max_lon").alias("spatial_extent"),
        F.struct("start_date", "end_date").alias("temporal_extent"),
        "fields_present", "missing_value_counts", "warnings", "errors",
    )


def metadata_record(report: DataFrame, spec: C.SourceSpec, crs: str = "EPSG:4326") -> DataFrame:
    """Provenance record that embeds the report."""
    return report.select(
        "dataset_name", F.lit(spec.extensions[0]).alias("format"), F.lit(crs).alias("crs"),
        F.col("temporal_extent").alias("temporal_coverage"), F.col("fields_present").alias("variables"),
        "record_count", F.col("status").alias("processing_status"), F.lit(spec.provenance).alias("data_status"),
        F.struct(*report.columns).alias("validation_summary"),
    )


def rainfall_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Missing, negative, impossible and duplicate rain records, stations, clean flag."""
    r = F.col("observed_rainfall")
    main = df.agg(
        F.count("*").alias("total_records"),
        F.count_if(r.isNull()).alias("missing_observed_rainfall"),
        F.count_if(r < 0).alias("negative_observed_rainfall"),
        F.count_if(r > 500.0).alias("impossible_observed_rainfall"),
        F.count_distinct("station_id").alias("unique_stations"),
    )
    dup = duplicate_count(df, keys).select(F.col("duplicates").alias("duplicate_records"))
    clean = (
        F.col("missing_observed_rainfall") + F.col("negative_observed_rainfall")
        + F.col("impossible_observed_rainfall") + F.col("duplicate_records")
    ) == 0
    return attach_row(main, dup).withColumn("clean_data", clean)


def uncertainty_audit(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Duplicates, humidity outside 0..100, nulls per key column, station and cell counts."""
    h = F.col("observed_humidity")
    main = df.agg(
        F.count_if(h < 0).alias("humidity_below_0"), F.count_if(h > 100).alias("humidity_above_100"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
        F.count_distinct("station_id").alias("unique_stations"), F.count_distinct("grid_id").alias("unique_cells"),
    )
    out = attach_row(main, duplicate_count(df, keys).select("duplicates"))
    cols = out.columns
    return out.unpivot([], cols, "metric", "n")


def leakage_guard(features: list[str], forbidden: list[str] = C.FORBIDDEN_FEATURES) -> list[str]:
    """Raise when a forbidden column is among the model inputs."""
    leaked = sorted(set(features) & set(forbidden))
    if leaked:
        raise ValueError(f"forbidden model inputs: {leaked}")
    return features
