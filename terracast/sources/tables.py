"""Table sources: CSV and JSON scans, standardised observation and forecast loads."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracast import config as C
from terracast.functions.numbers import to_number
from terracast.functions.times import parse_time
from terracast.operators.quality import find_column, with_row_status


# fixed values: texts that a table reader takes for "missing"
NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def without_tokens(df: DataFrame, tokens=NULL_TOKENS) -> DataFrame:
    """Text columns with NULL where they hold one of the tokens."""
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if tokens and t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def read_csv(spark: SparkSession, path, columns: list[str] | None = None, null_tokens=NULL_TOKENS) -> DataFrame:
    """CSV with a header, every value as text, `null_tokens` as NULL; a missing path raises.

    Without `columns` the header of the files is taken (one line is read).
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    if columns:
        reader = reader.schema(text_schema(columns)).option("enforceSchema", False)
    return without_tokens(reader.csv(path), null_tokens)


def sweep(spark: SparkSession, folder: str, pattern: str = "*.csv", columns: list[str] | None = None, null_tokens=NULL_TOKENS) -> DataFrame:
    """All matching files of a folder in one scan, with their path as `source_file`.

    Suites grouped by `source_file` then give one report per file from a single job; a value
    that does not parse is counted there and never stops the sweep.
    """
    reader = spark.read.option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if columns:
        reader = reader.schema(text_schema(columns))
    return without_tokens(reader.csv(folder).select("*", F.col("_metadata.file_path").alias("source_file")), null_tokens)


def read_json_artifact(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A JSON report, or None where there is none."""
    return optional(lambda: (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path))


def optional(load) -> DataFrame | None:
    """The table, or None when its path does not exist."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def optional_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table of that schema, empty where the path is missing."""
    found = optional(lambda: spark.read.schema(schema).parquet(path))
    return found if found is not None else spark.createDataFrame([], schema)


def _need(df: DataFrame, names: list[str]) -> dict[str, str]:
    found = {n: find_column(df, n) for n in names}
    lost = [n for n, c in found.items() if c is None]
    if lost:
        raise ValueError(f"missing required columns: {lost}")
    return found


def _number(df: DataFrame, name: str, default: float | None = None):
    c = find_column(df, name)
    x = to_number(c) if c else F.lit(None).cast("double")
    return x if default is None else F.coalesce(x, F.lit(default))


def standard_observations(df: DataFrame) -> DataFrame:
    """Typed observations: rows without a readable time go, rain and height get defaults, states kept."""
    got = _need(df, C.OBSERVATION_REQUIRED)
    states = [c for c in df.columns if c.startswith("qc_")]
    out = df.select(
        F.col(got["station_id"]).alias("station_id"), parse_time(got["timestamp"]).alias("timestamp"),
        to_number(got["latitude"]).alias("latitude"), to_number(got["longitude"]).alias("longitude"),
        _number(df, "temperature").alias("observed_temperature"), _number(df, "humidity").alias("observed_humidity"),
        _number(df, "rainfall", C.DEFAULT_RAIN).alias("observed_rainfall"),
        _number(df, "station_elevation", C.DEFAULT_ELEVATION).alias("station_elevation"), *states,
    )
    return with_row_status(out.na.drop(subset=["timestamp"]))


def standard_forecasts(df: DataFrame, data_status: str = "REAL") -> DataFrame:
    """Typed forecasts: rows without both times go, lead in whole hours (NULL if unreadable)."""
    got = _need(df, C.FORECAST_REQUIRED)
    out = df.select(
        parse_time(got["forecast_issue_time"]).alias("forecast_issue_time"), parse_time(got["valid_time"]).alias("valid_time"),
        to_number(got["lead_time"]).cast("int").alias("lead_time_hours"),
        to_number(got["latitude"]).alias("latitude"), to_number(got["longitude"]).alias("longitude"),
        _number(df, "temperature").alias("forecast_temperature"), _number(df, "humidity").alias("forecast_humidity"),
        _number(df, "rainfall", C.DEFAULT_RAIN).alias("forecast_rainfall"), F.lit(data_status).alias("data_status"),
    )
    return out.na.drop(subset=["forecast_issue_time", "valid_time"])
