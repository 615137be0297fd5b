"""Connected components of an edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracast.llm.storage import reliable_cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge between two nodes names; component is its smallest node.

    Each step is an aggregate of smallest neighbours (combined before the shuffle) and a join back, so a hub
    with any number of neighbours is never gathered; a hot hub's join partition can be split. The edges of a
    step are written to the shared folder: a lost executor costs one step. Steps grow with the logarithm
    of the longest path. Null ends and loops are ignored, an empty table gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    now, state = _stored(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour of u moves to the smallest of u's neighbourhood
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before = state
        now, state = _stored(step.select("e.*").where("u != v").distinct())
        if state == before:
            break
    joined = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return joined.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and figures that stay alike only when a step changes nothing."""
    kept = reliable_cut(edges, "edges")
    mark = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return kept, tuple(mark)
