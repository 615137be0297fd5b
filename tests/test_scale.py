"""Work is dealt over tasks by the number of rows, not by the size of files; forests score rows where they stand."""
import pytest
from pyspark.sql import functions as F

from terracast.operators import models as M
from terracast.operators import raster, spatial
from terracast.session import spread


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id")
    return spark.range(0, 4000, 1, 1).select(
        x.alias("k"), ((x * 37) % 101 / 7.0).alias("a"), ((x * 11) % 13).cast("double").alias("b"), ((x * 37) % 101 / 7.0 + (x * 7919) % 29 / 10.0).alias("y"))


def test_spread_deals_rows_and_leaves_small_tables(rows):
    dealt = spread(rows, 500)
    assert dealt.rdd.getNumPartitions() == 8 and dealt.exceptAll(rows).isEmpty() and dealt.count() == 4000
    assert max(len(p) for p in dealt.rdd.glom().collect()) < 700
    assert spread(rows, 4000).rdd.getNumPartitions() == 1
    assert spread(rows, 1, ("k",), most=5).rdd.getNumPartitions() == 5


def test_training_rows_are_dealt(rows, monkeypatch):
    monkeypatch.setattr(M, "TRAIN_ROWS_PER_TASK", 500)
    with M.training_rows(rows, ["a", "b"], "y") as train:
        assert train.rdd.getNumPartitions() == 8 and train.count() == 4000
        assert train.is_cached
    assert not train.is_cached


def test_forest_scores_without_a_shuffle(spark, rows):
    forest = M.QuantileForest(["a", "b"], "y", trees=6, depth=3).fit(rows)
    out = forest.transform(rows, ["k"], "r")
    assert out.columns == [*rows.columns, "r_q10", "r_q50", "r_q90"]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    # the plain way: every row's leaves joined with the leaf table
    leaf = forest._leaves(rows).select("k", F.posexplode(M.vector_to_array("_leaf")).alias("tree", "leaf"))
    met = leaf.withColumn("leaf", F.col("leaf").cast("int")).join(forest.table, ["tree", "leaf"])
    plain = met.groupBy("k").agg(*[F.avg(F.col("q")[i]).alias(f"p{i}") for i in range(3)])
    off = out.join(plain, "k").filter((F.abs(F.col("r_q10") - F.col("p0")) > 1e-9) | (F.abs(F.col("r_q50") - F.col("p1")) > 1e-9) | (F.abs(F.col("r_q90") - F.col("p2")) > 1e-9))
    assert out.count() == 4000 and plain.count() == 4000 and off.isEmpty()


def test_permuted_inputs_come_from_stored_pairs(spark, rows, monkeypatch):
    stored = []
    monkeypatch.setattr(M, "reliable_cut", lambda df, label: stored.append((label, df.columns, df.count())) or df)
    from terracast.config import BoostParams

    d = rows.withColumns({"observed_temperature": F.col("y"), "b2_temperature": F.lit(0.0)})
    model = M.fit_residual(d, ["a", "b"], "y", BoostParams(trees=3, depth=2))
    got = {r["feature"]: r["mae_rise"] for r in M.permutation_importance(model, d, ["a", "b"], "temperature", "b2_temperature", ["k"]).collect()}
    assert got["a"] > got["b"] and len(got) == 2
    assert [(s[0], s[2]) for s in stored] == [("permuted", 4000)]


def test_searches_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SPOTS_PER_TASK", 50)
    spots = spark.range(0, 400, 1, 1).select(F.col("id"), ((F.col("id") * 7) % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    items = spark.range(0, 300, 1, 1).select(F.col("id").alias("no"), ((F.col("id") * 13) % 19).cast("double").alias("ix"), ((F.col("id") * 5) % 17).cast("double").alias("iy"))
    seen = []
    real = spatial.spread
    monkeypatch.setattr(spatial, "spread", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    got = spatial.nearest_join(spots, items, "x", "y", ("ix", "iy", "ix", "iy"), spatial.plane_distance("x", "y", "ix", "iy"), ["no"], ["no"])
    assert got.count() == 400 and [s.rdd.getNumPartitions() for s in seen] == [8]
    pts = items.collect()
    for r in got.select("x", "y", "no", "distance").collect():
        d, no = min((round(((r["x"] - p["ix"]) ** 2 + (r["y"] - p["iy"]) ** 2) ** 0.5, 6), p["no"]) for p in pts)
        assert (r["no"], round(r["distance"], 6)) == (no, d)


def test_terrain_tiles_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(raster, "PIXELS_PER_TASK", 100)
    px = spark.range(0, 600, 1, 1).select(F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), (F.col("id") * 1.5).alias("value"))
    out = raster.neighbourhood(px)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 600
