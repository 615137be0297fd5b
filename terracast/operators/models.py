"""Residual, quantile and rain-event models on MLlib."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terracast import config as C
from terracast.functions.single import attach_row
from terracast.functions.times import season_columns
from terracast.operators.boosting import BoostedClassifier, BoostedRegressor
from terracast.operators.evaluate import climatology, point_scores
from terracast.operators.leaf_quantiles import leaf_quantiles
from terracast.operators.quality import leakage_guard
from terracast.session import reliable_cut, spread

QUANTILES = (0.1, 0.5, 0.9)
# rows are permuted within so many hash buckets, whatever their number
PERMUTATION_BUCKETS = 256
# training rows of one task: a fit passes over them some hundred times, so they are dealt evenly
TRAIN_ROWS_PER_TASK = 50_000


# ---------------------------------------------------------------- features

def with_season(df: DataFrame, time_col: str = "observation_time") -> DataFrame:
    return df.withColumns(season_columns(time_col))


def join_features(matchups: DataFrame, master: DataFrame, key: str = "grid_id") -> DataFrame:
    """Matchups with the cell features they do not have yet."""
    extra = [c for c in master.columns if c == key or c not in matchups.columns]
    return matchups.join(master.select(*extra), key, "left")


def feature_list(df: DataFrame, baseline: str | None = "b2_temperature", geo: bool = True) -> list[str]:
    """Ordered inputs: forecast, baseline, terrain and land cover, season; guarded against leakage."""
    names = [*C.FORECAST_FEATURES, *([baseline] if baseline else []), *(C.GEO_FEATURES if geo else []), *C.TIME_FEATURES]
    return leakage_guard([n for n in names if n in df.columns])


def assembler(features: list[str]) -> list:
    """Median-filled numeric inputs in one vector. Trees in MLlib take no missing values."""
    given, filled = [f"_d_{f}" for f in features], [f"_i_{f}" for f in features]
    return [Imputer(strategy="median", inputCols=given, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")]


def with_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Double copies of the inputs; the given columns keep their types."""
    return df.withColumns({f"_d_{f}": F.col(f).cast("double") for f in features})


def drop_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    return df.drop("features", "_scaled", "rawPrediction", "probability", *[f"{k}{f}" for f in features for k in ("_d_", "_i_")])


@contextmanager
def training_rows(train: DataFrame, features: list[str], *labels: str) -> Iterator[DataFrame]:
    """Inputs and labels of the training rows in tasks of equal size, held while models are fitted."""
    rows = spread(with_inputs(train.select(*features, *labels), features), TRAIN_ROWS_PER_TASK).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


# ---------------------------------------------------------------- residual model
def fit_residual(train: DataFrame, features: list[str], label: str, params: C.BoostParams = C.REGRESSION_BOOST) -> PipelineModel:
    gbt = BoostedRegressor(
        labelCol=label, featuresCol="features", predictionCol="prediction", maxIter=params.trees, maxDepth=params.depth, stepSize=params.rate,
        subsamplingRate=params.row_share, featureSubsetStrategy=params.column_share, minInstancesPerNode=params.min_rows, seed=params.seed,
    )
    with training_rows(train.filter(F.col(label).isNotNull()), features, label) as rows:
        return Pipeline(stages=[*assembler(features), gbt]).fit(rows)


def predict_residual(model: PipelineModel, df: DataFrame, features: list[str], variable: str, base: str) -> DataFrame:
    """ml_<variable> = baseline + predicted residual."""
    out = drop_inputs(model.transform(with_inputs(df, features)), features)
    name = f"predicted_{variable}_residual"
    return out.withColumnRenamed("prediction", name).withColumn(f"ml_{variable}", F.col(base) + F.col(name))


def ablation(df: DataFrame, variable: str, params: C.BoostParams = C.REGRESSION_BOOST, digits: int | None = 4) -> DataFrame:
    """TEST scores without and with the terrain inputs."""
    base, label = f"b2_{variable}", "_residual"
    rows = df.withColumn(label, F.col(f"observed_{variable}") - F.col(base))
    out = None
    for name, geo in (("Model A (Forecast + Time Only)", False), ("Model B (Full Forecast + Time + Terrain/GIS)", True)):
        feats = feature_list(rows, base, geo)
        model = fit_residual(rows.filter("split = 'TRAIN'"), feats, label, params)
        scored = predict_residual(model, rows.filter("split = 'TEST'"), feats, variable, base)
        part = scored.agg(*point_scores(f"observed_{variable}", f"ml_{variable}", digits)).select(
            F.lit(variable).alias("target"), F.lit(name).alias("ablation_setting"), F.lit(len(feats)).alias("feature_count"), "mae", "rmse", "bias"
        )
        out = part if out is None else out.unionByName(part)
    return out


def sanity(df: DataFrame, predictions: list[str]) -> DataFrame:
    """Null predictions and row count."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(p).isNull()).alias(f"null_{p}") for p in predictions])


# ---------------------------------------------------------------- importance
def tree_importance(spark, path: str, features: list[str]) -> DataFrame:
    """Split counts and summed gain per input, read from a saved tree ensemble's node table."""
    nodes = spark.read.parquet(f"{path.rstrip('/')}/data").select("nodeData.split.featureIndex", "nodeData.gain")
    got = nodes.filter("featureIndex >= 0").groupBy("featureIndex").agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
    names = spark.createDataFrame(list(enumerate(features)), "featureIndex int, feature string")
    return names.join(got, "featureIndex", "left").fillna(0, ["splits", "gain"]).select("feature", "splits", "gain").orderBy(F.desc("gain"))


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], variable: str, base: str, keys: list[str], seed: int = 42) -> DataFrame:
    """Rise of the MAE when one input is shuffled between rows.

    Rows are numbered twice by hash inside hash buckets, and the value moves between equal
    numbers of one bucket, so no single task sorts the table. All inputs move the same way: rows meet
    their partner once, and each input is scored from the stored pairs.
    """
    truth = F.col(f"observed_{variable}")
    rows = df.withColumn("_h", F.xxhash64(*keys, F.lit(seed)))
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(PERMUTATION_BUCKETS)))
    rows = rows.withColumns({
        "_i": F.row_number().over(W.partitionBy("_b").orderBy("_h", *keys)),
        "_j": F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64("_h", F.lit(seed + 1)), *keys)),
    })
    score = lambda frame, name: predict_residual(model, frame, features, variable, base).agg(F.avg(F.abs(F.col(f"ml_{variable}") - truth)).alias("mae")).select(F.lit(name).alias("feature"), "mae")
    given = list(dict.fromkeys([*features, base, f"observed_{variable}"]))
    moved = rows.select("_b", F.col("_j").alias("_i"), F.struct(*features).alias("_new"))
    pairs = reliable_cut(rows.select("_b", "_i", *given).join(moved, ["_b", "_i"]).drop("_b", "_i"), "permuted")
    base_row = score(df.select(*given), "")
    out = None
    for f in features:
        part = score(pairs.withColumn(f, F.col("_new")[f]).drop("_new"), f)
        out = part if out is None else out.unionByName(part)
    return attach_row(out, base_row.select(F.col("mae").alias("_base"))).select("feature", (F.col("mae") - F.col("_base")).alias("mae_rise")).orderBy(F.desc("mae_rise"))


# ---------------------------------------------------------------- quantile forest
class QuantileForest:
    """Random forest whose leaves carry the quantiles of their TRAIN residuals.

    A row's quantile forecast is the mean of its leaves' quantiles over the trees. The leaf
    table has (trees x leaves) rows however many rows were trained on, is stored and reaches the rows as one value, so a
    row is scored where it stands; leaf quantiles are exact order statistics from one sort by label, so a crowded leaf is
    never gathered in one task.
    """

    def __init__(self, features: list[str], label: str, trees: int = 40, depth: int = 5, min_rows: int = 10, seed: int = 42, levels=QUANTILES):
        self.features, self.label, self.levels = features, label, levels
        forest = RandomForestRegressor(
            labelCol=label, featuresCol="features", predictionCol="_mean", leafCol="_leaf", numTrees=trees, maxDepth=depth,
            minInstancesPerNode=min_rows, featureSubsetStrategy="0.8", subsamplingRate=0.8, seed=seed,
        )
        self._pipeline = Pipeline(stages=[*assembler(features), forest])

    def _leaves(self, df: DataFrame) -> DataFrame:
        return drop_inputs(self.model.transform(with_inputs(df, self.features)), self.features).drop("_mean")

    def fit(self, train: DataFrame) -> "QuantileForest":
        train = train.filter(F.col(self.label).isNotNull())
        with training_rows(train, self.features, self.label) as rows:
            self.model = self._pipeline.fit(rows)
            placed = self._leaves(rows).select(self.label, vector_to_array("_leaf").cast("array<int>").alias("_leaf"))
            placed = reliable_cut(placed, "leaves")
        self.table = reliable_cut(leaf_quantiles(placed, self.label, "_leaf", self.levels), "leaf-quantiles")
        return self

    def _lookup(self) -> DataFrame:
        """The leaf table as one row: for each tree (from 0) the quantiles of its leaves in order of their number."""
        slots = lambda found, n: F.transform(F.sequence(F.lit(0), n), lambda k: F.try_element_at(F.map_from_entries(found), k))
        per = self.table.groupBy("tree").agg(F.collect_list(F.struct("leaf", "q")).alias("_f"), F.max("leaf").alias("_n"))
        per = per.select("tree", slots(F.col("_f"), F.col("_n")).alias("q"))
        return per.agg(F.collect_list(F.struct("tree", "q")).alias("_f"), F.max("tree").alias("_n")).select(slots(F.col("_f"), F.col("_n")).alias("_table"))

    def transform(self, df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        """Adds <prefix>_q10, _q50, _q90 in order; `keys` identify a row, one without a key is left out."""
        names = [f"{prefix}_q{int(round(x * 100))}" for x in self.levels]
        rows = df.dropna(subset=keys)
        lv = attach_row(self._leaves(rows).withColumn("_leaf", vector_to_array("_leaf").cast("array<int>")), self._lookup())
        met = F.filter(F.transform("_leaf", lambda leaf, tree: F.get(F.get("_table", tree), leaf)), lambda q: q.isNotNull())
        # behind a generator: the look-up is made once for all levels
        lv = lv.select(*df.columns, F.explode(F.array(met)).alias("_met")).where(F.size("_met") > 0)
        mean = lambda i: F.aggregate("_met", F.lit(0.0), lambda a, q: a + q[i]) / F.size("_met")
        return lv.select(*df.columns, *[mean(i).alias(n) for i, n in enumerate(names)])


# ---------------------------------------------------------------- rain models
def label_classes(train: DataFrame, label: str) -> tuple[int, float]:
    """(number of distinct labels, mean label)."""
    r = train.agg(F.count_distinct(label), F.avg(F.col(label).cast("double"))).first()
    return r[0], float(r[1] or 0.0)


class RainModel:
    """Event probability; a single-class training set gives a constant."""

    def __init__(self, kind: str, features: list[str], label: str, params: C.BoostParams = C.RAIN_BOOST, c: float = 1.0, max_iter: int = 100):
        self.kind, self.features, self.label, self.params, self.c, self.max_iter = kind, features, label, params, c, max_iter
        self.constant, self.model = None, None

    def fit(self, train: DataFrame) -> "RainModel":
        fit_events([self], train)
        return self

    def learners(self, rows: DataFrame) -> list:
        """What follows the assembled inputs."""
        if self.kind == "logistic":
            return [
                StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True),
                LogisticRegression(labelCol=self.label, featuresCol="_scaled", regParam=1.0 / (self.c * max(rows.count(), 1)), elasticNetParam=0.0,
                                   standardization=False, maxIter=self.max_iter, predictionCol="_cls"),
            ]
        p = self.params
        return [BoostedClassifier(
            labelCol=self.label, featuresCol="features", maxIter=p.trees, maxDepth=p.depth, stepSize=p.rate, subsamplingRate=p.row_share,
            featureSubsetStrategy=p.column_share, minInstancesPerNode=p.min_rows, seed=p.seed, predictionCol="_cls",
        )]

    def transform(self, df: DataFrame, name: str) -> DataFrame:
        if self.constant is not None:
            return df.withColumn(name, F.lit(self.constant))
        out = self.model.transform(with_inputs(df, self.features))
        p = vector_to_array("probability")[1]
        out = out.withColumn(name, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
        return drop_inputs(out.drop("_cls"), self.features)

    def coefficients(self, spark) -> DataFrame:
        lr = self.model.stages[-1]
        rows = [(f, float(v)) for f, v in zip(self.features, lr.coefficients)]
        return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")))


def fit_events(models: list[RainModel], train: DataFrame, labels: list[str] = ()) -> None:
    """Fits models of the same inputs; their training rows are dealt, and gaps filled, once for all.

    `labels`: labels held beside the models' own. Rows are dealt by their content, so the same labels make the same draws whichever models are asked for.
    """
    todo = []
    for m in models:
        classes, rate = label_classes(train, m.label)
        if classes < 2:
            m.constant = rate
        else:
            todo.append(m)
    if not todo:
        return
    features = todo[0].features
    if any(m.features != features for m in todo):
        raise ValueError("models that share training rows must have the same inputs")
    with training_rows(train, features, *dict.fromkeys([*labels, *[m.label for m in todo]])) as rows:
        inputs = Pipeline(stages=assembler(features)).fit(rows)
        filled = inputs.transform(rows)
        for m in todo:
            m.model = PipelineModel([*inputs.stages, *Pipeline(stages=m.learners(rows)).fit(filled).stages])


class IsotonicScaler:
    """Monotone calibration; scores outside the fitted range are clipped to it."""

    def __init__(self, score: str, label: str):
        self.score, self.label, self.constant, self.model = score, label, None, None

    def fit(self, calibration: DataFrame) -> "IsotonicScaler":
        rows = calibration.filter(F.col(self.score).isNotNull() & F.col(self.label).isNotNull())
        classes, rate = label_classes(rows, self.label)
        if classes < 2:
            self.constant = rate
            return self
        # equal scores are pooled into one weighted point before anything is shuffled on
        pooled = rows.groupBy(F.col(self.score).alias("_s")).agg(F.avg(F.col(self.label).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
        self.model = IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_w", predictionCol="_p").fit(pooled)
        return self

    def transform(self, df: DataFrame, name: str) -> DataFrame:
        if self.constant is not None:
            return df.withColumn(name, F.lit(self.constant))
        out = self.model.transform(df.withColumn("_s", F.col(self.score))).drop("_s")
        return out.withColumn(name, F.least(F.greatest(F.col("_p"), F.lit(0.0)), F.lit(1.0))).drop("_p")


def attach_prior(df: DataFrame, train: DataFrame, targets: list[str]) -> DataFrame:
    """R0: the TRAIN event rate as every row's probability."""
    return attach_row(df, climatology(train, targets), {f"prior_{t}": f"r0_{t}" for t in targets})


def score_all(df: DataFrame, models: dict[str, RainModel], calibrators: dict[str, IsotonicScaler] | None = None) -> DataFrame:
    """Probability columns of every fitted model, then the calibrated ones."""
    for name, m in models.items():
        df = m.transform(df, name)
    for name, c in (calibrators or {}).items():
        df = c.transform(df, name)
    return df


def seeded_sample(df: DataFrame, keys: list[str], n: int = 500, seed: int = 42) -> DataFrame:
    """The same min(n, rows) rows for the same seed, whatever the partitioning."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(drawn, *keys).limit(n)


def category_codes(c, values: list[str]) -> Column:
    """Code of a category in sorted order, -1 when unknown."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_position(F.array(*[F.lit(v) for v in sorted(values)]), c).cast("int") - 1
