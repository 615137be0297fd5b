"""Exact order statistics by selection inside a sketched bracket.

A mergeable quantile sketch per group gives, for each level, two values between which the wanted ranks must lie. One more
pass counts the rows between the brackets, combined before the shuffle, and moves the rows inside a bracket only;
prefix sums over the cells of a group say how many rows lie below each, and ranks run inside a bracket. The sketch
decides how many rows move, never the result. No group is gathered, and no join is on the group alone.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terracast.functions.single import attach_row
from terracast.session import reliable_cut

#: the sketch's rank error is 1 / ACCURACY of the rows; a bracket reaches twice as far to both sides
ACCURACY = 10_000
#: groups up to this size are one bracket: there the reach would be less than two ranks
SMALL = 2 * ACCURACY
SALTS = 32
BLOCK = 16


def _doubles(values: list[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _edges(df: DataFrame, value: str, by: list[str], levels: list[float], small: int, accuracy: int) -> DataFrame:
    """by..., _ends (sorted ends of all brackets), _tops (each BLOCK-th of them), _keep (per cell: in a bracket); NULL for a small group.

    Cells are numbered in order of value: 2k lies above k ends, 2k - 1 is the k-th end itself.
    """
    reach = 2.0 / accuracy
    ends = lambda side: F.percentile_approx(value, _doubles([min(max(q + side * reach, 0.0), 1.0) for q in levels]), accuracy)
    open_ = lambda name, shut: F.transform(name, lambda x, i: F.when(F.element_at(F.array(*[F.lit(s) for s in shut]), i + 1), x))
    known = df.groupBy(*by).agg(F.count("*").alias("_n"), ends(-1).alias("_l"), ends(1).alias("_h"))
    known = known.select(*by, "_n", open_("_l", [q > reach for q in levels]).alias("_l"), open_("_h", [q < 1 - reach for q in levels]).alias("_h"))
    known = known.withColumn("_ends", F.when(F.col("_n") > small, F.array_sort(F.array_distinct(F.array_compact(F.concat("_l", "_h"))))))
    brackets = F.arrays_zip("_l", "_h")
    # a cell reaches from its lower to its upper end (NULL: without end), one end being both
    low, high = lambda c: F.get("_ends", F.floor((c + 1) / 2).cast("int") - 1), lambda c: F.get("_ends", F.floor(c / 2).cast("int"))
    holds = lambda c: lambda k: (k["_l"].isNull() | F.coalesce(k["_l"] <= low(c), F.lit(False))) & (k["_h"].isNull() | F.coalesce(k["_h"] >= high(c), F.lit(False)))
    keep = F.transform(F.sequence(F.lit(0), 2 * F.size("_ends")), lambda c: F.exists(brackets, holds(c)))
    return known.select(*by, "_ends", F.filter("_ends", lambda e, i: (i + 1) % BLOCK == 0).alias("_tops"), F.when(F.col("_ends").isNotNull(), keep).alias("_keep"))


def _ranked(df: DataFrame, value: str, by: list[str], levels: list[float], targets: Callable[[Column], Column], small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """Distinct values of the cells that hold a target, with the ranks they cover: by..., value, _first, _last, _total (0-based).

    targets maps the row count of a group to its wanted ranks (an array of whole numbers), which lie within a rank or two of
    `levels`; a rank outside its bracket is an error. Rows without a value, or with a NULL in a group column, are left out.
    """
    df = df.filter(F.col(value).isNotNull()).select(*by, value)
    edges = _edges(df, value, by, levels, small, accuracy)
    if by:
        # stored, so that its size is known: a small table reaches the rows without moving them
        edges = reliable_cut(edges, "brackets").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")).join(edges, [*by, "_salt"])
    else:
        placed = attach_row(df, edges)
    v = F.col(value)
    # ends at or below the value, in two short scans
    at_most = lambda arr: F.size(F.filter(arr, lambda e: e <= v))
    placed = placed.withColumn("_full", at_most("_tops"))
    placed = placed.withColumn("_k", F.col("_full") * BLOCK + at_most(F.slice("_ends", F.col("_full") * BLOCK + 1, F.lit(BLOCK))))
    cell = 2 * F.col("_k") - F.coalesce(F.get("_ends", F.col("_k") - 1) == v, F.lit(False)).cast("int")
    placed = placed.select(*by, value, "_keep", F.when(F.col("_ends").isNull(), 0).otherwise(cell).alias("_cell"))
    placed = placed.select(*by, value, "_cell", F.coalesce(F.get("_keep", "_cell"), F.lit(True)).alias("_inside"))
    placed = placed.select(*by, "_cell", "_inside", F.when(F.col("_inside"), v).alias("_v"))
    # as an aggregate the mark isn't pushed below the shuffle, which the sums and the ranks then share
    pieces = placed.groupBy(*by, "_cell", F.col("_v").alias(value)).agg(F.count("*").alias("_n"), F.bool_and("_inside").alias("_in"))
    # a cell's first rank: sums over a few cells per group
    over = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    cells = pieces.groupBy(*by, "_cell").agg(F.sum("_n").alias("_size"), F.every("_in").alias("_all"))
    cells = cells.select(*by, "_cell", "_size", "_all", (F.sum("_size").over(over.orderBy("_cell")) - F.col("_size")).alias("_before"), F.sum("_size").over(over).alias("_total"))
    wanted = F.exists(targets(F.col("_total")), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")))
    lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("boolean")
    cells = cells.filter(F.when(wanted & ~F.col("_all"), lost).otherwise(wanted))
    values = pieces.filter("_in").join(cells.select(*by, "_cell", "_before", "_total"), [*by, "_cell"])
    run = F.sum("_n").over(W.partitionBy(*by, "_cell").orderBy(value))
    return values.withColumn("_run", run).select(
        *by, value, (F.col("_before") + F.col("_run") - F.col("_n")).alias("_first"), (F.col("_before") + F.col("_run") - 1).alias("_last"), "_total",
    )


def quantile_rows(df: DataFrame, value: str, levels: list[float], by: list[str] = (), small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles with linear interpolation: by..., level_no (0-based), quantile."""
    by = list(by)
    places = lambda total: F.transform(_doubles(levels), lambda q, i: F.struct(i.alias("no"), (q * (total - 1)).alias("pos")))
    ranks = lambda total: F.flatten(F.transform(places(total), lambda t: F.array(F.floor(t.pos), F.ceil(t.pos))))
    ranked = _ranked(df, value, by, levels, ranks, small, accuracy)
    touches = lambda t: (F.floor(t.pos) <= F.col("_last")) & (F.ceil(t.pos) >= F.col("_first"))
    rows = ranked.select(*by, value, "_first", "_last", F.explode(F.filter(places(F.col("_total")), touches)).alias("t"))
    lo, hi = F.floor("t.pos"), F.ceil("t.pos")
    pick = lambda at: F.max(F.when((at >= F.col("_first")) & (at <= F.col("_last")), F.col(value)))
    out = rows.groupBy(*by, F.col("t.no").alias("level_no"), F.col("t.pos").alias("_pos")).agg(pick(lo).alias("_lo"), pick(hi).alias("_hi"))
    frac = F.col("_pos") - F.floor("_pos")
    return out.select(*by, "level_no", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("quantile"))


def quantile_columns(df: DataFrame, value: str, names: dict[str, float], by: list[str] = ()) -> DataFrame:
    """One row per group with a column per named level."""
    by = list(by)
    rows = quantile_rows(df, value, list(names.values()), by)
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("level_no") == i, F.col("quantile"))).alias(n) for i, n in enumerate(names)])


def quantile_array(df: DataFrame, value: str, levels: list[float], by: list[str] = (), name: str = "levels") -> DataFrame:
    """One row per group with all quantiles in one array, in level order."""
    by = list(by)
    rows = quantile_rows(df, value, levels, by)
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("level_no", "quantile"))), lambda s: s["quantile"]).alias(name))


def order_statistic(df: DataFrame, value: str, rank: Callable[[Column], Column], near: float, by: list[str] = (), name: str = "value", small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """The value at a 0-based rank; `rank` maps the group's row count (a column) to it, `near` is about that rank as a level."""
    by = list(by)
    ranked = _ranked(df, value, by, [near], lambda total: F.array(rank(total).cast("long")), small, accuracy)
    r = rank(F.col("_total"))
    return ranked.filter((F.col("_first") <= r) & (r <= F.col("_last"))).select(*by, F.col(value).alias(name), F.col("_total").alias("n"))
