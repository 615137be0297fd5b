"""Rasters as tiled pixel tables with a header.

A raster is a folder: `pixels` holds (row, col, value), one partition folder for each tile, and `header` one row with size, box,
reference system, missing value and tile side. A raster without header, or without a box in it, stands on the
fallback box. Row 0 is the northern edge.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracast.operators.raster import raster_header

TILE = 2048
# fixed values: box and reference system of a raster that brings none
FALLBACK_BOX = {"min_lon": 76.60, "max_lon": 77.30, "min_lat": 10.20, "max_lat": 11.40}
FALLBACK_CRS = "EPSG:4326"
_HEADER = "n_rows long, n_cols long, min_lon double, max_lon double, min_lat double, max_lat double, crs string, nodata double, tile int, source string"


@dataclass(frozen=True)
class RasterHeader:
    n_rows: int
    n_cols: int
    min_lon: float
    max_lon: float
    min_lat: float
    max_lat: float
    crs: str = FALLBACK_CRS
    nodata: float | None = None
    tile: int = TILE
    #: "header" or "fallback": where the box comes from
    source: str = "header"

    @property
    def box(self) -> dict[str, float]:
        return {k: getattr(self, k) for k in FALLBACK_BOX}

    @property
    def resolution(self) -> tuple[float, float]:
        """Degrees a pixel along longitude and latitude."""
        return (self.max_lon - self.min_lon) / max(self.n_cols, 1), (self.max_lat - self.min_lat) / max(self.n_rows, 1)

    def rows_of(self, min_lat: float, max_lat: float) -> tuple[int, int]:
        """First and last pixel row that touch a band of latitudes; the last is smaller where none does."""
        step = self.resolution[1]
        return max(int((self.max_lat - max_lat) // step), 0), min(int((self.max_lat - min_lat) // step), self.n_rows - 1)

    def cols_of(self, min_lon: float, max_lon: float) -> tuple[int, int]:
        step = self.resolution[0]
        return max(int((min_lon - self.min_lon) // step), 0), min(int((max_lon - self.min_lon) // step), self.n_cols - 1)


def write_raster(pixels: DataFrame, path: str, box: dict[str, float] | None = None, crs: str | None = None, nodata: float | None = None, tile: int = TILE) -> str:
    """Store (row, col, value) by tile, a shuffle by tile and a file each; other columns go along."""
    tiled = pixels.withColumns({"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")})
    tiled.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(f"{path}/pixels")
    spark = pixels.sparkSession
    n_rows, n_cols = raster_header(spark.read.parquet(f"{path}/pixels"))
    b = box or dict.fromkeys(FALLBACK_BOX)
    row = (n_rows, n_cols, b["min_lon"], b["max_lon"], b["min_lat"], b["max_lat"], crs, nodata, tile, "header")
    spark.createDataFrame([row], _HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    return path


def read_header(spark: SparkSession, path: str) -> RasterHeader:
    """The header row; what it lacks comes from the pixels (size) and the fallback values (box, reference system)."""
    try:
        found = spark.read.parquet(f"{path}/header").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    got = found.asDict() if found else {}
    if got.get("n_rows") is None or got.get("n_cols") is None:
        got["n_rows"], got["n_cols"] = raster_header(spark.read.parquet(f"{path}/pixels"))
    boxed = all(got.get(k) is not None for k in FALLBACK_BOX)
    if not boxed:
        got.update(FALLBACK_BOX)
    kept = {k: got[k] for k in ("n_rows", "n_cols", *FALLBACK_BOX)}
    return RasterHeader(**kept, crs=got.get("crs") or FALLBACK_CRS, nodata=got.get("nodata"), tile=got.get("tile") or TILE, source="header" if boxed else "fallback")


def read_raster(spark: SparkSession, path: str, window: dict[str, float] | None = None) -> DataFrame:
    """Pixels with NULL for the missing value and for NaN; with a window, only tiles and rows that touch its box are read."""
    h = read_header(spark, path)
    px = spark.read.parquet(f"{path}/pixels")
    if window:
        for axis, (first, last) in (("row", h.rows_of(window["min_lat"], window["max_lat"])), ("col", h.cols_of(window["min_lon"], window["max_lon"]))):
            px = px.where(F.col(f"tile_{axis}").between(first // h.tile, last // h.tile) & F.col(axis).between(first, last))
    value = F.col("value")
    gone = F.isnan(value.cast("double")) if h.nodata is None else F.isnan(value.cast("double")) | (value == F.lit(h.nodata))
    return px.withColumn("value", F.when(~gone, value)).drop("tile_row", "tile_col")


def header_report(spark: SparkSession, path: str) -> DataFrame:
    """One row: size, reference system, degrees a pixel, box and where the box comes from."""
    h = read_header(spark, path)
    dx, dy = h.resolution
    return spark.createDataFrame(
        [(h.n_rows, h.n_cols, h.crs, dx, dy, h.min_lon, h.max_lon, h.min_lat, h.max_lat, h.source)],
        "n_rows long, n_cols long, crs string, lon_step double, lat_step double, min_lon double, max_lon double, min_lat double, max_lat double, box_source string",
    )
