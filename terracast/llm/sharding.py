"""Uniform shuffle into shards of exact sizes, with DataFrame functions only.

The hypergeometric communication matrix says how many rows of each block go to each shard. It is drawn
before any row moves: block after block, a multivariate hypergeometric draw from what the shards have
left. Then each block permutes its rows, deals them by its row of the matrix, and each shard permutes
again. Every assignment that meets the sizes is equally likely, and sizes differ by at most one row.
"""
from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracast.llm.storage import free_name

BLOCK_ROWS = 50_000
MAX_BLOCKS = 100_000
NUMPY_POOL = 1_000_000_000  # numpy draws from smaller pools only


def communication_matrix(block_sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each block to each shard: exact margins, drawn without bias."""
    rng = np.random.default_rng(seed)
    total = int(sum(block_sizes))
    left = np.full(shards, total // shards, dtype=np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(block_sizes), shards), dtype=np.int64)
    for i, n in enumerate(block_sizes):
        rest = int(n)
        pool = int(left.sum())
        for s in range(shards):
            if not rest:
                break
            pool -= int(left[s])
            out[i, s] = min(rest, left[s]) if pool == 0 else _draw(rng, int(left[s]), pool, rest)
            rest -= int(out[i, s])
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw: good ones among n of good + bad."""
    if good + bad < NUMPY_POOL:
        return int(rng.hypergeometric(good, bad, n))
    return rejection_draw(rng, good, bad, n)


def rejection_draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same draw for pools of any size: rejection under the hat that every log-concave law on the integers has (Devroye 1987).

    The hat is flat about the mode and falls off exponentially; a value x is accepted with p(x) / p(mode) against it, so
    the law is the hypergeometric one. The hat's height may be too low but not too high, hence the tenth taken off.
    """
    least, most = max(0, n - bad), min(good, n)
    if least == most:
        return least
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), least), most)
    chance = lambda a, k: lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1)
    height = min(0.9 * exp(min(chance(good, mode) + chance(bad, n - mode) - chance(good + bad, n), 0.0)), 1.0)
    width = 1 + height / 2
    while True:
        u, v, w = rng.random(3)
        y = (v * width if u <= width / (1 + width) else width - log(1.0 - v)) / height
        x = mode + (-1 if rng.random() < 0.5 else 1) * round(y)
        if least <= x <= most and w * min(1.0, exp(min(width - height * y, 0.0))) <= exp(min(_log_ratio(good, bad, n, mode, x), 0.0)):
            return x


def _log_ratio(good: int, bad: int, n: int, m: int, x: int) -> float:
    """log p(x) / p(m): of each factorial only its change."""
    d = x - m
    return -(_log_step(m + 1, d) + _log_step(good - m + 1, -d) + _log_step(n - m + 1, -d) + _log_step(bad - n + m + 1, d))


def _log_step(a: int, d: int) -> float:
    """log gamma(a + d) - log gamma(a); by Stirling's series where both are large, as their difference would lose the last digits."""
    if min(a, a + d) < 10_000:
        return lgamma(a + d) - lgamma(a)
    return (a + d - 0.5) * log1p(d / a) + d * (log(a) - 1.0) + (1 / (a + d) - 1 / a) / 12


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of df with `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in each shard).

    A block is a hash range of whole rows, of about `block_rows` rows (at most `MAX_BLOCKS` blocks: the
    matrix has blocks x shards cells and is drawn by the driver, which sees counts only). Hot sources and
    texts don't matter, as the hash covers the whole row; rows alike in every column share a block and are
    interchangeable. Null values hash like others, an empty table gives an empty result, columns named
    shard or slot are replaced, and any other name may be there.
    """
    df = df.drop("shard", "slot")
    mark, block, sums, place, bucket, n, first = (free_name(df, x) for x in ("mark", "block", "sums", "place", "bucket", "n_rows", "first_slot"))
    blocks = min(MAX_BLOCKS, max(1, -(-df.count() // block_rows)))
    whole = [F.map_entries(f"`{c}`") if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]
    rows = df.withColumn(mark, F.xxhash64(F.lit(seed), *whole))
    rows = rows.withColumn(block, F.pmod(F.xxhash64(F.lit(1), mark), F.lit(blocks)).cast("int"))

    # draw: counts of rows per block come to the driver, the matrix goes back as cumulative counts
    sizes = {r[0]: r[1] for r in rows.groupBy(block).count().collect()}
    order = sorted(sizes)
    matrix = np.cumsum(communication_matrix([sizes[b] for b in order], shards, seed), axis=1)
    table = df.sparkSession.createDataFrame([(b, m.tolist()) for b, m in zip(order, matrix, strict=True)], f"`{block}` int, `{sums}` array<bigint>")

    # permute within the block, deal by the block's row of the matrix
    local = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(2), mark), mark)
    dealt = rows.withColumn(place, F.row_number().over(local) - 1).join(F.broadcast(table), block)
    dealt = dealt.withColumn("shard", F.size(F.filter(F.col(sums), lambda s: s <= F.col(place))).cast("int"))

    # permute within the shard: in order of a second hash, bucket by bucket, so that no task sorts a whole shard
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(F.lit(3), mark), F.lit(max(1, blocks // shards + 1))).cast("int"))
    counts = dealt.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    again = Window.partitionBy("shard", bucket).orderBy(F.xxhash64(F.lit(4), mark), mark)
    out = dealt.join(starts, ["shard", bucket]).withColumn("slot", (F.col(first) + F.row_number().over(again) - 1).cast("long"))
    return out.select(*[f"`{c}`" for c in df.columns], "shard", "slot")
