"""Value validators: each gives a message, or NULL when the value is fine."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracast.functions.numbers import col

# fixed values: accepted ranges of the validators
TEMPERATURE_RANGE = (-10.0, 60.0)
HUMIDITY_RANGE = (0.0, 100.0)


def _range_message(c, name: str, unit: str, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c.isNull(), F.lit(f"{name} value is missing")).when(
        (c < lo) | (c > hi), F.format_string(f"{name} %.2f{unit} out of valid physical range [{lo:.0f}, {hi:.0f}]", c)
    )


def temperature_message(c) -> Column:
    return _range_message(c, "Temperature", "°C", *TEMPERATURE_RANGE)


def humidity_message(c) -> Column:
    return _range_message(c, "Humidity", "%%", *HUMIDITY_RANGE)


def probability_message(c) -> Column:
    """A missing probability is accepted: it stands for `not evaluable`."""
    c = col(c)
    return F.when((c < 0.0) | (c > 1.0), F.format_string("Probability %.4f out of bounds [0.0, 1.0]", c))


def ordering_message(p10, p50, p90) -> Column:
    a, b, c = col(p10), col(p50), col(p90)
    return F.when(
        a.isNotNull() & b.isNotNull() & c.isNotNull() & ~((a <= b) & (b <= c)),
        F.format_string("Quantile violation: P10 (%.2f) <= P50 (%.2f) <= P90 (%.2f) failed", a, b, c),
    )


def village_id_message(c) -> Column:
    """Any non-blank id is accepted."""
    return F.when(col(c).isNull() | (F.trim(col(c)) == ""), F.lit("Panchayat ID is empty or not a string"))


def is_full_village_id(c) -> Column:
    """True for ids of the long form GP_<state>_<district>_<number>."""
    parts = F.split(F.trim(col(c)), "_")
    return (F.size(parts) >= 4) & (F.element_at(parts, 1) == "GP")


def weather_messages(temp, hum, q_temp=None, q_hum=None) -> Column:
    """All messages of one weather record joined by ' | '; empty text when valid."""
    parts = [temperature_message(temp), humidity_message(hum)]
    for q in (q_temp, q_hum):
        if q is not None:
            parts.append(ordering_message(*q))
    return F.concat_ws(" | ", *parts)
