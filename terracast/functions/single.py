"""Values of one-row tables on every row of another table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, row: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Add the columns of a one-row table (an aggregate) as a scalar subquery.

    The row is computed once and reaches the tasks as a value; no join is planned.
    """
    names = {c: (rename or {}).get(c, c) for c in row.columns}
    value = row.select(F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("_row")).scalar()
    out = df.withColumn("_row", value)
    return out.select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in names.values()])
