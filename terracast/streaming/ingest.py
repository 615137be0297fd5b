"""Incremental ingest: the row-wise operators on arriving files.

Standardisation and value classes look at one row at a time, so the batch functions are
used as they are; nothing is kept between rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terracast import config as C
from terracast.operators.quality import with_qc
from terracast.sources.tables import standard_observations, text_schema


def observation_stream(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Observations from CSV files as they appear, standardised and classified."""
    columns = columns or [*C.OBSERVATION_REQUIRED, *C.OBSERVATION_OPTIONAL]
    raw = spark.readStream.schema(text_schema(columns)).option("header", True).csv(folder)
    return standard_observations(with_qc(raw))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Start an append-only parquet sink that works off what is there and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
