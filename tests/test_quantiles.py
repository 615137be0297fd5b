"""Selection inside brackets against numpy: brackets that bite, ties, one group of all rows, many groups, open ends."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from terracast.operators import quantiles as Q
from terracast.session import reliable_cut

LEVELS = [0.0, 0.001, 0.1, 0.25, 0.5, 0.5, 0.9, 0.9995, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    x = F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 7 == 0, None).otherwise(F.floor(F.rand(5) * 40000) / 8 - 900)
    return reliable_cut(spark.range(60000).select("id", (F.col("id") % 5).alias("g"), F.lit("one").alias("all"), x.alias("x")).repartition(7), "rows")


def expected(rows, by):
    d = rows.toPandas().dropna()
    return {k: np.quantile(v["x"], LEVELS) for k, v in d.groupby(by)}


@pytest.mark.parametrize(("small", "accuracy"), [(10, 100), (Q.SMALL, Q.ACCURACY), (1000, 2000)])
@pytest.mark.parametrize("by", ["all", "g"])
def test_quantiles_by_group(rows, by, small, accuracy):
    want = expected(rows, by)
    got = {}
    for r in Q.quantile_rows(rows, "x", LEVELS, [by], small, accuracy).collect():
        got.setdefault(r[by], {})[r.level_no] = r.quantile
    assert set(got) == set(want)
    for k, values in want.items():
        assert [got[k][i] for i in range(len(LEVELS))] == pytest.approx(list(values), abs=1e-12)


def test_quantiles_of_all_rows(rows):
    got = {r.level_no: r.quantile for r in Q.quantile_rows(rows, "x", LEVELS, small=10, accuracy=200).collect()}
    assert [got[i] for i in range(len(LEVELS))] == pytest.approx(list(expected(rows, "all")["one"]), abs=1e-12)


def test_few_rows_leave_their_task(rows):
    """Beyond the brackets a group is a few counts a task: the moved rows are a small part of all."""
    edges = Q._edges(rows.filter("x is not null"), "x", [], [0.5], 10, 2000).first()
    d = rows.toPandas().dropna()["x"]
    assert edges["_keep"] == [False, True, True, True, False]
    assert ((d >= edges["_ends"][0]) & (d <= edges["_ends"][1])).mean() < 0.01


def test_order_statistic_and_wrong_hint(rows):
    d = np.sort(rows.toPandas().dropna()["x"].to_numpy())
    r = Q.order_statistic(rows, "x", lambda n: F.floor(n * 0.8), 0.8, small=10, accuracy=500).first()
    assert (r["value"], r["n"]) == (d[int(len(d) * 0.8)], len(d))
    with pytest.raises(Exception, match="outside its bracket"):
        Q.order_statistic(rows, "x", lambda n: F.floor(n * 0.8), 0.2, small=10, accuracy=500).collect()


def test_groups_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (2, 5.0), (3, 7.0)], "g int, x double")
    assert sorted((r.g, r.quantile) for r in Q.quantile_rows(df, "x", [0.5], ["g"]).collect()) == [(2, 4.0), (3, 7.0)]
    assert Q.quantile_rows(df.filter("g = 1"), "x", [0.5]).count() == 0
