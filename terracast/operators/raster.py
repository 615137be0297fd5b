"""Pixel tables: 3x3 terrain kernels and windows around grid cells.

A raster is a table (row, col, value). Work is cut into square tiles with a halo, so no
window or group spans more than one tile.
"""
from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terracast import config as C
from terracast.functions.numbers import clip, half_even, settle

TILE = 256
BAND = 64
PIXELS_PER_TASK = TILE * TILE  # small exchanges would be merged into one task


def raster_header(pixels: DataFrame, row: str = "row", col: str = "col") -> tuple[int, int]:
    """(rows, columns) of a raster; two integers reach the driver."""
    r = pixels.agg(F.max(row), F.max(col)).first()
    return (r[0] or 0) + 1, (r[1] or 0) + 1


def _with_halo(pixels: DataFrame, row: str, col: str) -> DataFrame:
    """Each pixel under its tile, and under the neighbour tiles it borders."""
    span = lambda c: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(c) + d) / TILE)))
    out = pixels.select("*", F.explode(span(row)).alias("_tr"))
    return out.select("*", F.explode(span(col)).alias("_tc"))


def neighbourhood(pixels: DataFrame, value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """3x3 values around every pixel as w[0..8] (row-major); the edge repeats itself.

    One shuffle by tile serves both window passes.
    """
    parts = math.ceil(pixels.count() / PIXELS_PER_TASK)
    tiled = _with_halo(pixels.select(row, col, value), row, col)
    tiled = tiled.repartition(parts, "_tr", "_tc") if parts > 1 else tiled.repartition("_tr", "_tc")
    across = W.partitionBy("_tr", "_tc", row).orderBy(col)
    down = W.partitionBy("_tr", "_tc", col).orderBy(row)

    def beside(fn, what, key, step, window, own):
        near = fn(F.struct(F.col(key).alias("k"), what.alias("v"))).over(window)
        return F.when(near["k"] == F.col(key) + step, near["v"]).otherwise(own)

    v = F.col(value)
    line = tiled.withColumn("_line", F.array(beside(F.lag, v, col, -1, across, v), v, beside(F.lead, v, col, 1, across, v)))
    own = F.col("_line")
    out = line.withColumns({"_above": beside(F.lag, own, row, -1, down, own), "_below": beside(F.lead, own, row, 1, down, own)})
    out = out.filter((F.floor(F.col(row) / TILE) == F.col("_tr")) & (F.floor(F.col(col) / TILE) == F.col("_tc")))
    return out.select(row, col, value, F.concat("_above", "_line", "_below").alias("w"))


def terrain(pixels: DataFrame, step_m: float = C.RASTER_STEP_M, value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Slope and aspect (degrees, Horn 1981) and ruggedness (Riley et al. 1999) per pixel."""
    w = neighbourhood(pixels, value, row, col)
    z = [F.col("w")[i] for i in range(9)]
    east = (z[2] + 2.0 * z[5] + z[8]) - (z[0] + 2.0 * z[3] + z[6])
    south = (z[6] + 2.0 * z[7] + z[8]) - (z[0] + 2.0 * z[1] + z[2])
    scale = F.lit(8.0 * step_m)
    g = w.withColumns({"_gx": east / scale, "_gy": south / scale})
    g = g.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))))
    bearing = F.pmod(F.degrees(F.atan2(-F.col("_gy"), F.col("_gx"))), F.lit(360.0))
    squares = F.aggregate("w", F.lit(0.0), lambda acc, v: acc + (v - F.col(value)) * (v - F.col(value)))
    return g.select(
        row, col, value, "slope",
        F.when(F.col("slope") < C.FLAT_SLOPE_DEG, 0.0).otherwise(bearing).alias("aspect"), F.sqrt(squares).alias("tri"),
    )


# ---------------------------------------------------------------- windows around cells
def pixel_of(cells: DataFrame, shape: tuple[int, int], box: dict[str, float], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Pixel index of every cell centre, clipped into the raster."""
    rows, cols = shape
    fx = (F.col(lon) - box["min_lon"]) / (box["max_lon"] - box["min_lon"]) * cols
    fy = (F.lit(box["max_lat"]) - F.col(lat)) / (box["max_lat"] - box["min_lat"]) * rows
    whole = lambda c, n: clip(c.cast("int"), 0, n - 1).cast("int")
    return cells.withColumns({"pixel_row": whole(fy, rows), "pixel_col": whole(fx, cols)})


def window_pixels(cells: DataFrame, pixels: DataFrame, values: list[str], key: str = "grid_id", radius: int = C.WINDOW_RADIUS,
                  row: str = "row", col: str = "col") -> DataFrame:
    """Pixels in the (2*radius+1)^2 window of every cell: key, values.

    Pixels of one row are packed into strips of BAND columns with a halo of `radius`; a
    cell meets one strip per window row (an equi-join) and takes its slice from it. A strip
    holds at most BAND + 2*radius pixels.
    """
    bands = F.sequence(F.floor((F.col(col) - radius) / BAND), F.floor((F.col(col) + radius) / BAND))
    strips = (
        pixels.select(F.col(row).alias("_r"), F.explode(bands).alias("_b"), F.struct(F.col(col).alias("_at"), *values).alias("p"))
        .groupBy("_r", "_b").agg(F.collect_list("p").alias("_strip"))
    )
    rows_of = F.explode(F.sequence(F.col("pixel_row") - radius, F.col("pixel_row") + radius)).alias("_r")
    asked = cells.select(key, "pixel_col", F.floor(F.col("pixel_col") / BAND).alias("_b"), rows_of)
    met = asked.join(strips, ["_r", "_b"])
    near = F.filter("_strip", lambda p: p["_at"].between(F.col("pixel_col") - radius, F.col("pixel_col") + radius))
    return met.select(key, F.explode(near).alias("p")).select(key, *[F.col(f"p.{v}").alias(v) for v in values])


def _rounded(c: Column, places: int | None) -> Column:
    return c if places is None else settle(c, places)


def terrain_features(cells: DataFrame, derived: DataFrame, key: str = "grid_id", radius: int = C.WINDOW_RADIUS, rounding: bool = True,
                     value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Elevation, slope, aspect and ruggedness statistics of every cell window."""
    px = window_pixels(cells, derived, [value, "slope", "aspect", "tri"], key, radius, row, col)
    r = (lambda c, p: _rounded(c, p)) if rounding else (lambda c, p: c)
    a = F.radians("aspect")
    return px.groupBy(key).agg(
        r(F.avg(value), 2).alias("elevation_mean"), r(F.stddev_pop(value), 2).alias("elevation_std"),
        r(F.min(value), 2).alias("elevation_min"), r(F.max(value), 2).alias("elevation_max"),
        r(F.max(value) - F.min(value), 2).alias("elevation_range"),
        r(F.avg("slope"), 2).alias("slope_mean"), r(F.stddev_pop("slope"), 2).alias("slope_std"),
        r(F.min("slope"), 2).alias("slope_min"), r(F.max("slope"), 2).alias("slope_max"),
        r(F.avg(F.sin(a)), 4).alias("aspect_sin"), r(F.avg(F.cos(a)), 4).alias("aspect_cos"), r(F.avg("aspect"), 2).alias("aspect_mean"),
        r(F.avg("tri"), 2).alias("tri_mean"), r(F.stddev_pop("tri"), 2).alias("tri_std"),
    )


def class_name(code) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    names = F.create_map(*[F.lit(v) for v in chain.from_iterable(C.LANDCOVER_CLASSES.items())])
    return F.coalesce(names[c], F.concat(F.lit("Class_"), c.cast("string")))


def landcover_features(cells: DataFrame, classes: DataFrame, key: str = "grid_id", radius: int = C.WINDOW_RADIUS,
                       value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Dominant class (lowest code on ties) and class fractions of every cell window.

    A window without pixels counts as cropland.
    """
    px = window_pixels(cells, classes, [value], key, radius, row, col)
    counts = px.groupBy(key, value).agg(F.count("*").alias("_n"))
    share = lambda code: half_even(
        F.coalesce(F.sum(F.when(F.col(value) == code, F.col("_n"))), F.lit(0)) / F.sum("_n"), 4
    )
    best = F.max(F.struct(F.col("_n"), (-F.col(value)).alias("neg"))).alias("_k")
    out = counts.groupBy(key).agg(best, *[share(code).alias(f"landcover_fraction_{n}") for n, code in C.LANDCOVER_FRACTIONS.items()])
    out = out.withColumn("dominant_landcover_class", class_name(-F.col("_k.neg"))).drop("_k")
    names = [f"landcover_fraction_{n}" for n in C.LANDCOVER_FRACTIONS]
    total = sum((F.col(n) for n in names), F.lit(0.0))
    out = out.withColumn("nodata_fraction", F.greatest(F.lit(0.0), half_even(F.lit(1.0) - total, 4)))
    full = cells.select(key).join(out, key, "left")
    fill = {n: (1.0 if n.endswith("cropland") else 0.0) for n in names}
    return full.fillna({**fill, "nodata_fraction": 0.0, "dominant_landcover_class": C.LANDCOVER_CLASSES[40]})


def raster_summary(pixels: DataFrame, nodata: float | None = None, value: str = "value") -> DataFrame:
    """Cell count, nodata and NaN share, value range and number of distinct values."""
    v = F.col(value)
    is_nodata = (v == nodata) if nodata is not None else F.lit(False)
    good = F.when(~is_nodata & ~F.isnan(v) & v.isNotNull(), v)
    return pixels.agg(
        F.count("*").alias("cells"), F.count_if(is_nodata).alias("nodata"),
        (F.count_if(is_nodata) / F.count("*") * 100.0).alias("nodata_pct"),
        F.count_if(F.isnan(v) | v.isNull()).alias("nan"),
        F.min(good).alias("min_value"), F.max(good).alias("max_value"), F.count_distinct(good).alias("distinct_values"),
    )


def raster_checks(pixels: DataFrame, nodata: float | None = None, value: str = "value") -> DataFrame:
    from terracast.operators.quality import checks_to_rows

    s = raster_summary(pixels, nodata, value)
    return checks_to_rows(s, [
        ("nodata_cells", "INFO", F.col("nodata")),
        ("nan_cells", "WARN", F.col("nan")),
        ("no_valid_cells", "WARN", F.when(F.col("min_value").isNull(), 1).otherwise(0)),
    ])
