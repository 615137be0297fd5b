"""Display text for values."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracast.functions.numbers import col


def _or(c, missing: str, text: Column) -> Column:
    return F.when(col(c).isNull() | F.isnan(col(c)), F.lit(missing)).otherwise(text)


def temperature_label(c, decimals: int = 1) -> Column:
    return _or(c, "N/A", F.format_string(f"%.{decimals}f °C", col(c)))


def humidity_label(c, decimals: int = 1) -> Column:
    return _or(c, "N/A", F.format_string(f"%.{decimals}f %%", col(c)))


def interval_label(p10, p90, unit: str = "", decimals: int = 1) -> Column:
    tail = f" {unit}".replace("%", "%%") if unit else ""
    text = F.format_string(f"%.{decimals}f — %.{decimals}f{tail}", col(p10), col(p90))
    return _or(p10, "Interval unavailable", _or(p90, "Interval unavailable", text))


def probability_label(c, evaluable=None) -> Column:
    pct = F.format_string("%.1f%%", col(c) * 100.0)
    text = _or(c, "Not evaluable", pct)
    return text if evaluable is None else F.when(col(evaluable), text).otherwise(F.lit("Not evaluable"))


def village_label(name, block) -> Column:
    return F.format_string("%s (%s Block)", col(name), col(block))
