"""Joins in which one key may hold a large share of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a key with more than this part of all rows is dealt out; there are fewer than 500 of them, whatever the input
HEAVY = 1 / 500
SALTS = 64


def heavy_keys(rows: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that hold more than the part HEAVY of the rows (499 at most reach the driver)."""
    counts = rows.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return [r.h for r in counts.where(F.col("n") > max(total * HEAVY, 1000)).collect()]


def spread_join(rows: DataFrame, one: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left") -> DataFrame:
    """`rows` joined with `one`, which holds one row per key at most.

    Rows of a heavy key are dealt over SALTS tasks by a hash of the columns `spread`, and that key's row
    of `one` is repeated for each of them. rows is read twice: pass a written table.
    """
    heavy = heavy_keys(rows, keys)
    if not heavy:
        return rows.join(one, list(keys), how)
    is_heavy: Column = F.xxhash64(*keys).isin(heavy)
    dealt = rows.withColumn("_salt", F.when(is_heavy, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0))
    repeated = one.withColumn("_salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
