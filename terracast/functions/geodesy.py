"""Transverse Mercator projection as column arithmetic (Snyder, USGS PP 1395, 1987)."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetricZone:
    """A UTM zone on WGS84. Zone 43 north by default."""

    central_meridian: float = 75.0
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257223563
    scale: float = 0.9996
    false_easting: float = 500000.0
    false_northing: float = 0.0

    @property
    def ecc2(self) -> float:
        f = 1.0 / self.inverse_flattening
        return f * (2.0 - f)

    @property
    def second_ecc2(self) -> float:
        return self.ecc2 / (1.0 - self.ecc2)

    @property
    def arc(self) -> list[float]:
        """Meridian arc coefficients of phi, sin 2phi, sin 4phi, sin 6phi."""
        e = self.ecc2
        return [
            1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256,
            -(3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024),
            15 * e**2 / 256 + 45 * e**3 / 1024,
            -35 * e**3 / 3072,
        ]

    @property
    def footpoint(self) -> list[float]:
        """Footpoint latitude coefficients of sin 2mu, sin 4mu, sin 6mu."""
        root = math.sqrt(1 - self.ecc2)
        n = (1 - root) / (1 + root)
        return [3 * n / 2 - 27 * n**3 / 32, 21 * n**2 / 16 - 55 * n**4 / 32, 151 * n**3 / 96]


ZONE_43N = MetricZone()


def _fixed(df: DataFrame, keep: list[str], a, a_name: str, b, b_name: str) -> DataFrame:
    """Both results behind a generator: a later filter on them is then not pushed down as a
    second copy of the whole series (which outgrows the code generator)."""
    pair = F.explode(F.array(F.struct(a.alias(a_name), b.alias(b_name)))).alias("_k")
    return df.select(*keep, pair).select(*keep, f"_k.{a_name}", f"_k.{b_name}")


def project_points(df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y", zone: MetricZone = ZONE_43N) -> DataFrame:
    """Add easting `x` and northing `y` in metres for degree columns."""
    z, c = zone, F.col
    p2 = z.second_ecc2
    a0, a2, a4, a6 = z.arc
    keep = [k for k in df.columns if k not in (x, y)]
    s1 = df.select(*keep, F.radians(c(lat)).alias("_ph"), F.radians(c(lon) - F.lit(z.central_meridian)).alias("_dl"))
    s2 = s1.select(
        *keep, "_ph",
        (F.lit(z.semi_major) / F.sqrt(1.0 - z.ecc2 * F.sin("_ph") * F.sin("_ph"))).alias("_n"),
        F.tan("_ph").alias("_tan"),
        (p2 * F.cos("_ph") * F.cos("_ph")).alias("_c"),
        (c("_dl") * F.cos("_ph")).alias("_a"),
        (z.semi_major * (a0 * c("_ph") + a2 * F.sin(2.0 * c("_ph")) + a4 * F.sin(4.0 * c("_ph")) + a6 * F.sin(6.0 * c("_ph")))).alias("_m"),
    )
    t, cc, a, aa = c("_tan") * c("_tan"), c("_c"), c("_a"), c("_a") * c("_a")
    east = a * (1.0 + aa / 6.0 * ((1.0 - t + cc) + aa / 20.0 * (5.0 - 18.0 * t + t * t + 72.0 * cc - 58.0 * p2)))
    north = aa / 2.0 * (
        1.0 + aa / 12.0 * ((5.0 - t + 9.0 * cc + 4.0 * cc * cc) + aa / 30.0 * (61.0 - 58.0 * t + t * t + 600.0 * cc - 330.0 * p2))
    )
    return _fixed(
        s2, keep, z.false_easting + z.scale * c("_n") * east, x,
        z.false_northing + z.scale * (c("_m") + c("_n") * c("_tan") * north), y,
    )


def unproject_points(df: DataFrame, x: str, y: str, lon: str = "longitude", lat: str = "latitude", zone: MetricZone = ZONE_43N) -> DataFrame:
    """Add degree columns for metric `x`, `y`."""
    z, c = zone, F.col
    e2, p2 = z.ecc2, z.second_ecc2
    f2, f4, f6 = z.footpoint
    keep = [k for k in df.columns if k not in (lon, lat)]
    s1 = df.select(*keep, ((c(y) - z.false_northing) / z.scale / (z.semi_major * z.arc[0])).alias("_mu"))
    s2 = s1.select(*keep, (c("_mu") + f2 * F.sin(2.0 * c("_mu")) + f4 * F.sin(4.0 * c("_mu")) + f6 * F.sin(6.0 * c("_mu"))).alias("_ph"))
    s3 = s2.select(
        *keep, "_ph", F.tan("_ph").alias("_tan"), F.cos("_ph").alias("_cos"),
        (1.0 - e2 * F.sin("_ph") * F.sin("_ph")).alias("_w"),
    )
    s4 = s3.select(
        *keep, "_ph", "_tan", "_cos", "_w", (p2 * c("_cos") * c("_cos")).alias("_c"),
        ((c(x) - z.false_easting) * F.sqrt("_w") / (z.semi_major * z.scale)).alias("_d"),
    )
    t, cc, d, dd = c("_tan") * c("_tan"), c("_c"), c("_d"), c("_d") * c("_d")
    # N1 / R1 = w / (1 - e^2)
    fall = c("_w") / (1.0 - e2) * c("_tan") * dd / 2.0 * (
        1.0 - dd / 12.0 * ((5.0 + 3.0 * t + 10.0 * cc - 4.0 * cc * cc - 9.0 * p2)
                           - dd / 30.0 * (61.0 + 90.0 * t + 298.0 * cc + 45.0 * t * t - 252.0 * p2))
    )
    # sixth-order latitude coefficient without the -3C^2 term, as in the matched results
    turn = d / c("_cos") * (
        1.0 - dd / 6.0 * ((1.0 + 2.0 * t + cc)
                          - dd / 20.0 * (5.0 - 2.0 * cc + 28.0 * t - 3.0 * cc * cc + 8.0 * p2 + 24.0 * t * t))
    )
    return _fixed(s4, keep, F.lit(z.central_meridian) + F.degrees(turn), lon, F.degrees(c("_ph") - fall), lat)
