"""Time column helpers."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracast.functions.numbers import col

# fixed values: accepted time formats are a date with - or /, optionally with HH:mm, HH:mm:ss or
# HH:mm:ss.fraction after a space or T, then optionally Z or an offset (+HH:mm, +HHmm)
TIME_PATTERN = r"^\d{4}([-/])\d{2}\1\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$"
# fixed value: mean year length behind the seasonal cycle
YEAR_DAYS = 365.25


def parse_time(c) -> Column:
    """Text to zone-less timestamp; NULL when it has no accepted format.

    A time with an offset becomes the UTC time; one without is taken as it stands. One pattern test and
    one cast a value: trying format after format costs an exception per miss. A zone mark is told by its place
    from the end, and only texts that carry one are cut and shifted. The text is bound by a lambda: named in a
    dozen places, it would be worked out anew at each of them.
    """
    return F.transform(F.array(F.trim(col(c).cast("string"))), _parsed)[0]


def parsed_times(df: DataFrame, **times) -> DataFrame:
    """The named texts as times, parsed once a row: behind a generator, so that filters and sums that follow do not repeat the work."""
    return df.select(F.inline(F.array(F.struct(*[parse_time(c).alias(n) for n, c in times.items()]))))


def _parsed(text: Column) -> Column:
    sign = lambda at: F.substring(text, at, 1).isin("+", "-")
    # digits of the zone mark; 16 characters are the longest time without seconds
    zone = F.when(F.length(text) <= 16, 0).when(text.endswith("Z"), 1).when(sign(-6), 6).when(sign(-5), 5).otherwise(0)
    return F.when(text.rlike(TIME_PATTERN), F.when(zone == 0, _plain(text)).otherwise(_shifted(text, zone)))


def _plain(text: Column) -> Column:
    dashed = F.translate(text, "/", "-")
    return F.when(F.length(dashed) == 16, F.concat(dashed, F.lit(":00"))).otherwise(dashed).try_cast("timestamp_ntz")


def _shifted(text: Column, zone: Column) -> Column:
    minutes = F.when(zone == 1, 0).otherwise(text.substr(F.length(text) - zone + 2, F.lit(2)).try_cast("int") * 60 + F.substring(text, -2, 2).try_cast("int"))
    east = text.substr(F.length(text) - zone + 1, F.lit(1)) == "+"
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.when(east, -minutes).otherwise(minutes), F.lit(0))
    return _plain(F.trim(text.substr(F.lit(1), F.length(text) - zone))) + shift


def stamp(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def day_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def lead_hours(issue, valid) -> Column:
    """Hours from issue to valid time."""
    return F.timestamp_diff("HOUR", col(issue), col(valid)).cast("int")


def season_columns(time_col) -> dict[str, Column]:
    """Seasonal sine / cosine of the day of year, and the month."""
    angle = F.lit(2.0 * math.pi) * F.dayofyear(col(time_col)) / F.lit(YEAR_DAYS)
    return {"day_of_year_sin": F.sin(angle), "day_of_year_cos": F.cos(angle), "month": F.month(col(time_col))}
