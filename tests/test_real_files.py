"""Values as real files bring them."""
import pytest

from terracast.functions.numbers import to_number
from terracast.functions.times import parse_time
from terracast.operators import models, serve, spatial, villages
from terracast.sources.tables import read_csv


def test_times(spark):
    given = {
        "2024-01-01": "2024-01-01 00:00:00", "2024/01/01": "2024-01-01 00:00:00", "2024-01-01 06:30": "2024-01-01 06:30:00", "2024-01-01T06:30Z": "2024-01-01 06:30:00",
        "2024-01-01 00:00:00.000": "2024-01-01 00:00:00", "2024-01-01T00:00:00+05:30": "2023-12-31 18:30:00", "2024-01-01T00:00:00-0230": "2024-01-01 02:30:00",
        "2024-01-01 01:02:03Z": "2024-01-01 01:02:03", "soon": None, "2024-01/01": None, "2024-13-01": None, "2024-01-01+05:30": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", parse_time("t").cast("string").alias("p")).collect()
    assert {r.t: r.p for r in rows} == given


def test_numbers(spark):
    given = {"10": 10.0, " -1.5e3 ": -1500.0, ".5": 0.5, "7.": 7.0, "10D": None, "10f": None, "0x1p3": None, "NaN": None, "1,5": None, "": None, "inf": float("inf")}
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", to_number("t").alias("x")).collect()
    assert {r.t: r.x for r in rows} == given
    assert spark.range(1).select(to_number("id").alias("x")).first().x == 0.0


def test_missing_tokens(spark, tmp_path):
    path = tmp_path / "obs.csv"
    path.write_text("station_id,temperature\nA,n/a\nB,NA\nC,21.5\nD,cold\nE,\nF,NaN\n")
    got = {r.station_id: r.temperature for r in read_csv(spark, str(path)).collect()}
    assert got == {"A": None, "B": None, "C": "21.5", "D": "cold", "E": None, "F": None}
    assert {r.station_id: r.temperature for r in read_csv(spark, str(path), null_tokens=()).collect()}["A"] == "n/a"


def test_points_close_together_stay_apart(spark):
    f = spark.createDataFrame([(10.3, 76.7, 1), (10.30001, 76.7, 2)], "latitude double, longitude double, k int")
    registry = spatial.point_registry(f)
    out = spatial.attach_parent(f, registry).collect()
    assert registry.count() == 2 and len(out) == 2 and len({r.forecast_parent_id for r in out}) == 2


def test_village_without_probabilities_stays_on_either_route(spark):
    rows = [("GP_1", "2024-01-01", 24, 0.2, 0.1, 0.0)] * 4 + [("GP_2", "2024-01-01", 24, None, None, None)] * 5
    df = spark.createDataFrame(rows, "panchayat_id string, timestamp string, lead_time int, prob_1mm double, prob_10mm double, prob_25mm double")
    key = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert key(villages.village_rainfall(df)) == key(villages.village_rainfall(df, hot_group=2)) and villages.village_rainfall(df, hot_group=2).count() == 2


def test_default_date_and_sample(spark):
    assert [r.date for r in serve.available_dates(None).collect()] == [serve.DEFAULT_DATE]
    df = spark.range(2000)
    a, b = (sorted(r.id for r in models.seeded_sample(d, ["id"], 50).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 50


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from terracast import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())
