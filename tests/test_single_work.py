"""Work is done once a row or once a pattern, and a stage holds a bounded number of sorts."""
from pyspark.sql import functions as F

from terracast.functions.times import parse_time, parsed_times

TIMES = ["2024-01-02 03:04:05", "2024/01/02 03:04", "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05+05:30", " 2024-01-02 ", "2024-13-02", "soon", "", None]


def test_a_text_is_worked_out_once(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TIMES)], "k int, t string")
    plan = d.select("k", parse_time(F.reverse(F.reverse("t"))).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(reverse(") == 1
    got = [None if r[0] is None else str(r[0]) for r in d.orderBy("k").select(parse_time("t")).collect()]
    want = ["2024-01-02 03:04:05", "2024-01-02 03:04:00", "2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-01 21:34:05", "2024-01-02 00:00:00"]
    assert got == [*want, None, None, None, None]


def test_times_are_parsed_once_before_filters_and_sums(spark):
    d = spark.createDataFrame([(t, u) for t in TIMES for u in TIMES], "t string, u string")
    out = parsed_times(d, i="t", v="u").na.drop().agg(F.count_if(F.col("v") < F.col("i")).alias("a"), F.count_if(F.col("v") == F.col("i")).alias("b"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2
    plain = d.select(parse_time("t").alias("i"), parse_time("u").alias("v")).collect()
    pairs = [(r["i"], r["v"]) for r in plain if r["i"] is not None and r["v"] is not None]
    r = out.first()
    assert (r["a"], r["b"]) == (sum(v < i for i, v in pairs), sum(v == i for i, v in pairs))
