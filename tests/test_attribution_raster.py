"""Shapley values against all subsets; rasters with and without header."""
import random
from itertools import combinations
from math import factorial

import pytest
from pyspark.sql import functions as F

from terracast.config import BoostParams
from terracast.operators import attribution as A
from terracast.operators import models as M
from terracast.sources import raster as R

FEATURES = ["a", "b", "c"]


def by_subsets(nodes, weights, x):
    """Shapley values of one row by definition: every subset of known inputs, every tree walked."""
    trees = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["id"]] = n

    def value(tree, node, known):
        if node["left"] < 0:
            return node["prediction"]
        left, right = tree[node["left"]], tree[node["right"]]
        if node["feature"] in known:
            return value(tree, left if x[node["feature"]] <= node["threshold"] else right, known)
        return (left["rows"] * value(tree, left, known) + right["rows"] * value(tree, right, known)) / node["rows"]

    def worth(known):
        return sum(weights[t] * value(tree, tree[0], known) for t, tree in trees.items())

    n = len(x)
    out = []
    for j in range(n):
        rest = [k for k in range(n) if k != j]
        out.append(sum(
            factorial(s) * factorial(n - s - 1) / factorial(n) * (worth({*S, j}) - worth(set(S))) for s in range(n) for S in combinations(rest, s)
        ))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(400):
        a, b, c = rnd.random(), rnd.gauss(0, 1), float(rnd.randint(0, 4))
        rows.append((k, a, None if k % 17 == 0 else b, c, 3 * a * c + (b > 0) + rnd.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, y double")
    return df, M.fit_residual(df, FEATURES, "y", BoostParams(trees=6, depth=4, rate=0.3, row_share=0.8, column_share="all", min_rows=5))


def test_shapley_values_equal_the_sum_over_subsets(spark, fitted):
    df, model = fitted
    trees = model.stages[-1]
    nodes = A.ensemble_nodes(spark, trees)
    got = {r.k: r for r in A.attributions(model, df, FEATURES, ["k"]).collect()}
    told = {r.k: r for r in model.transform(M.with_inputs(df, FEATURES)).collect()}
    assert len(got) == 400
    for k in got:
        assert got[k].base + sum(got[k].shap) == pytest.approx(told[k].prediction, abs=1e-9)
    for k in (0, 17, 33, 250):
        want = by_subsets(nodes, list(trees.treeWeights), list(told[k].features))
        assert got[k].shap == pytest.approx(want, abs=1e-9)


def test_mean_attribution_ranks_inputs_and_takes_no_rows(fitted):
    df, model = fitted
    got = A.mean_attribution(A.attributions(model, df, FEATURES, ["k"]), FEATURES).collect()
    assert {r.feature for r in got} == set(FEATURES) and got[0].feature in ("a", "c")
    assert A.attributions(model, df.limit(0), FEATURES, ["k"]).count() == 0


def grid(spark, rows=30, cols=50):
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.col("id").cast("double").alias("value"))


def test_raster_with_header(spark, tmp_path):
    box = {"min_lon": 70.0, "max_lon": 75.0, "min_lat": 10.0, "max_lat": 13.0}
    px = grid(spark).withColumn("value", F.when(F.col("value") == 7, -1.0).when(F.col("value") == 8, float("nan")).otherwise(F.col("value")))
    path = R.write_raster(px, str(tmp_path / "r"), box, "EPSG:32643", -1.0, tile=16)
    h = R.read_header(spark, path)
    assert (h.n_rows, h.n_cols, h.crs, h.nodata, h.source, h.box) == (30, 50, "EPSG:32643", -1.0, "header", box)
    assert h.resolution == pytest.approx((0.1, 0.1))
    got = {(r.row, r.col): r.value for r in R.read_raster(spark, path).collect()}
    assert len(got) == 1500 and [k for k, v in got.items() if v is None] in ([(0, 7), (0, 8)], [(0, 8), (0, 7)]) and got[29, 49] == 1499.0


def test_raster_window_reads_its_tiles_only(spark, tmp_path):
    box = {"min_lon": 70.0, "max_lon": 75.0, "min_lat": 10.0, "max_lat": 13.0}
    path = R.write_raster(grid(spark), str(tmp_path / "r"), box, tile=16)
    part = R.read_raster(spark, path, {"min_lon": 70.05, "max_lon": 70.95, "min_lat": 12.05, "max_lat": 12.95})
    assert {(r.row, r.col) for r in part.collect()} == {(r, c) for r in range(10) for c in range(10)}
    assert len(part.inputFiles()) >= 1 and "tile_row" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert R.read_raster(spark, path, {"min_lon": 80.0, "max_lon": 81.0, "min_lat": 12.0, "max_lat": 12.5}).count() == 0


def test_raster_without_header_stands_on_the_fallback_box(spark, tmp_path):
    path = str(tmp_path / "r")
    tiled = grid(spark).withColumns({"tile_row": F.lit(0), "tile_col": F.lit(0)})
    tiled.write.partitionBy("tile_row", "tile_col").parquet(f"{path}/pixels")
    h = R.read_header(spark, path)
    assert (h.n_rows, h.n_cols, h.source, h.crs, h.box) == (30, 50, "fallback", "EPSG:4326", R.FALLBACK_BOX)
    assert R.read_raster(spark, path).count() == 1500
    assert R.header_report(spark, R.write_raster(grid(spark), str(tmp_path / "b"))).first().box_source == "fallback"
