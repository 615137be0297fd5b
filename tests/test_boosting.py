"""Trees grown from histograms are MLlib's trees."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from terracast.operators import boosting as B
from terracast.operators import models as M

FEATURES = ["a", "b", "c", "d"]
SETTINGS = {"featuresCol": "features", "maxIter": 6, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6", "minInstancesPerNode": 5, "seed": 11}


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id")
    df = spark.range(0, 3000, 1, 3).select(
        x.alias("k"), F.when(x % 17 != 0, (x * 7919) % 1009 / 7.0).alias("a"), ((x * 31) % 13).cast("double").alias("b"), F.sin(x * 0.37).alias("c"), F.lit(1.0).alias("d"))
    y = F.coalesce("a", F.lit(0.0)) * F.col("b") / 10 + F.col("c") * 5 + (x_noise := (F.col("k") * 104729) % 97 / 31.0)
    return df.withColumns({"y": y, "rain": (F.col("c") * 3 + x_noise > 2.5).cast("int")})


@pytest.fixture(scope="module")
def dataset(rows):
    d = M.with_inputs(rows, FEATURES)
    return Pipeline(stages=M.assembler(FEATURES)).fit(d).transform(d)


def tree_nodes(model):
    out = []

    def walk(n):
        leaf = n.getClass().getSimpleName() == "LeafNode"
        stats = n.impurityStats()
        out.append((None if leaf else (n.split().featureIndex(), n.split().threshold(), n.gain()), n.prediction(), n.impurity(), stats.rawCount(), list(stats.stats())))
        if not leaf:
            walk(n.leftChild())
            walk(n.rightChild())

    for t in model._call_java("trees"):
        walk(t.rootNode())
    return out


def test_regression_trees_are_the_library_s_bit_by_bit(dataset, spark, tmp_path):
    mine, theirs = B.BoostedRegressor(labelCol="y", **SETTINGS).fit(dataset), GBTRegressor(labelCol="y", **SETTINGS).fit(dataset)
    assert tree_nodes(mine) == tree_nodes(theirs) and len(tree_nodes(mine)) > 100
    assert mine.treeWeights == theirs.treeWeights and mine.numFeatures == 4
    assert {p.name: v for p, v in mine.extractParamMap().items()} == {p.name: v for p, v in theirs.extractParamMap().items()}
    got = mine.transform(dataset).select("k", "prediction")
    assert got.exceptAll(theirs.transform(dataset).select("k", "prediction")).isEmpty()
    mine.write().overwrite().save(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "data")).count() == len(tree_nodes(mine))


def test_event_trees_are_the_library_s(dataset):
    mine, theirs = B.BoostedClassifier(labelCol="rain", **SETTINGS).fit(dataset), GBTClassifier(labelCol="rain", **SETTINGS).fit(dataset)
    assert tree_nodes(mine) == tree_nodes(theirs)
    p = lambda m: [r[0][1] for r in m.transform(dataset).orderBy("k").select("probability").collect()]
    assert np.allclose(p(mine), p(theirs), atol=1e-12)


def test_all_rows_and_all_inputs(dataset):
    given = {**SETTINGS, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    assert tree_nodes(B.BoostedRegressor(labelCol="y", **given).fit(dataset)) == tree_nodes(GBTRegressor(labelCol="y", **given).fit(dataset))


def test_passes_read_packed_rows_of_few_tasks(dataset, monkeypatch):
    """More partitions than tasks, several chunks a partition, scores worked out anew: the same trees up to the order of sums."""
    plain = tree_nodes(B.BoostedRegressor(labelCol="y", **SETTINGS).fit(dataset))
    seen = []
    real = B._Grower.sums
    monkeypatch.setattr(B._Grower, "sums", lambda self, rows, *a: seen.append((rows.getNumPartitions(), rows.map(lambda c: (c[1].dtype.name, c[1].shape)).collect())) or real(self, rows, *a))
    monkeypatch.setattr(B, "CHAIN", 2)
    monkeypatch.setattr(B, "DIRECT", 1)
    split = tree_nodes(B.BoostedRegressor(labelCol="y", **SETTINGS).fit(dataset))
    assert [(x[0] and x[0][:2], x[3]) for x in plain] == [(x[0] and x[0][:2], x[3]) for x in split]
    assert {s[0] for s in seen} == {3} and all(c[0] == "uint8" and c[1][0] == 4 for _, chunks in seen for c in chunks)
    many = B._Grower(B.BoostedRegressor(labelCol="y", **SETTINGS), dataset.repartition(40), False)
    assert many.base.getNumPartitions() <= 8 and many.base.map(lambda c: len(c[2])).sum() == 3000
    many.base.unpersist()


def test_draws_are_those_of_the_library(spark):
    state = 0x9E3779B97F4A7C15
    step, s = [], state
    for _ in range(200):
        d, s = B.uniform(s)
        step.append(d)
    assert B.uniforms(state, 200, B.lane_map()).tolist() == step and len(B.uniforms(state, 33, B.lane_map())) == 33
    theirs = spark.sparkContext._jvm.java.util.Random(5)
    mine = B.JavaRandom(5)
    assert [mine.long() for _ in range(20)] == [theirs.nextLong() for _ in range(20)]


def test_exponential_is_the_jvm_s(spark):
    x = np.concatenate([np.random.default_rng(1).uniform(-9, 9, 1500), np.random.default_rng(2).normal(0, 0.3, 500), [0.0, -0.0, 699.9, -699.9, 710.0, -800.0]])
    told = spark.sparkContext._jvm.java.lang.Math.exp
    assert B.java_exp(x).tolist() == [told(float(v)) for v in x]


def test_chunks_are_cut_and_missing_values_refused(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "CHUNK_ROWS", 4)
    batch = lambda x, y: pa.RecordBatch.from_arrays([pa.array([7] * len(y)), pa.array(x), pa.array(y)], names=["part", "x", "y"])
    cuts = [np.array([1.0, 2.0]), np.array([])]
    got = [c.to_pylist()[0] for c in B.binned_chunks(iter([batch([[float(k), 0.0] for k in range(6)], [float(k) for k in range(6)])]), cuts, False)]
    assert [c["n"] for c in got] == [4, 2] and list(got[0]["bins"]) == [0, 0, 1, 2, 0, 0, 0, 0]
    for bad in (batch([[1.0, float("nan")]], [1.0]), batch([[1.0, 1.0]], [None]), batch([[1.0, 1.0]], [float("inf")])):
        with pytest.raises(ValueError):
            list(B.binned_chunks(iter([bad]), cuts, False))
    with pytest.raises(ValueError):
        list(B.binned_chunks(iter([batch([[1.0, 1.0]], [0.5])]), cuts, True))


def test_rain_models_share_their_training_rows(rows, monkeypatch):
    from contextlib import contextmanager

    held, real = [], M.training_rows

    @contextmanager
    def noted(train, features, *labels):
        with real(train, features, *labels) as r:
            held.append(labels)
            yield r

    monkeypatch.setattr(M, "training_rows", noted)
    d = rows.withColumns({"heavy": (F.col("y") > 40).cast("int"), "never": F.lit(0)})
    from terracast.config import BoostParams

    few = BoostParams(trees=3, depth=2)
    make = lambda: [M.RainModel("boosted", FEATURES, "rain", few), M.RainModel("logistic", FEATURES, "heavy", few), M.RainModel("boosted", FEATURES, "never", few)]
    together, alone = make(), make()
    M.fit_events(together, d, ["heavy", "never", "rain"])
    assert [set(h) for h in held] == [{"rain", "heavy", "never"}] and together[2].constant == 0.0
    for m in alone:
        m.fit(d)
    assert len(held) == 3  # the constant one holds no rows
    score = lambda models: M.score_all(d, {f"p{i}": m for i, m in enumerate(models)}).orderBy("k").select("p0", "p1", "p2").collect()
    assert np.allclose(score(together), score(alone), atol=1e-9)
    assert len(together[0].model.stages) == 3 and len(together[1].model.stages) == 4
    with pytest.raises(ValueError):
        M.fit_events([M.RainModel("boosted", FEATURES, "rain"), M.RainModel("boosted", ["a"], "rain")], d)
