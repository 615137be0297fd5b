"""Closed-form values of single operators."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from terracast import config as C
from terracast.functions import checks, labels
from terracast.functions.geodesy import project_points, unproject_points
from terracast.functions.numbers import half_even, interpolate
from terracast.functions.times import parse_time
from terracast.operators import baselines as B
from terracast.operators import evaluate as E
from terracast.operators import matchup, models, quality, quantiles, raster, serve, spatial, villages
from terracast.operators import uncertainty as U
from terracast.sources import geojson, sinks, tables


def col(df, name):
    return [r[name] for r in df.collect()]


# ---------------------------------------------------------------- ingest
OBS = "station_id string, timestamp string, latitude string, longitude string, temperature string, humidity string, rainfall string"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([
        ("S1", "2024-06-01", "10.0", "77.0", "30", "60", "0"), ("S1", "2024-06-02", "11.0", "77.1", "65", "55", "1"), ("S2", "2024-06-01", "11.5", "77.2", None, "3", "2"),
        ("S2", "2024-06-02", "12.0", "77.3", "28", None, "0"), ("S3", "2024-06-01", "11.0", "76.9", "25", "80", None)], OBS)


def test_value_classes(sample):
    q = quality.with_qc(sample)
    assert col(q, "qc_temperature") == ["VALID", "INVALID", "MISSING", "VALID", "VALID"]
    assert col(q, "qc_humidity") == ["VALID", "VALID", "SUSPICIOUS", "MISSING", "VALID"]
    assert col(quality.with_row_status(q), "qc_status") == ["VALID", "INVALID", "SUSPICIOUS", "VALID", "VALID"]


def test_extents(sample):
    e = quality.extents(sample).first()
    assert (e.record_count, e.start_date, e.end_date, e.min_lat, e.max_lat) == (5, "2024-06-01", "2024-06-02", 10.0, 12.0)


def test_report_of_a_file_without_required_fields(spark):
    df = spark.createDataFrame([("S1", "10")], "station_id string, latitude string").withColumns({"timestamp": F.lit("2024-01-01"), "Longitude": F.lit("77")})
    assert quality.field_presence(df, C.OBSERVATION_REQUIRED).filter("severity = 'ERROR'").count() == 0
    assert set(col(quality.field_presence(df.drop("timestamp", "Longitude"), C.OBSERVATION_REQUIRED).filter("severity = 'ERROR'"), "field")) == {"timestamp", "longitude"}
    with pytest.raises(ValueError):
        tables.standard_observations(df.drop("timestamp"))


def test_missing_share(spark):
    df = spark.createDataFrame([("a", None), ("b", "1"), ("c", "2")], "station_id string, temperature string")
    r = quality.missing_stats(df).first()
    assert (r.column, r.n_missing, r.pct, r.severity) == ("temperature", 1, 33.33, "WARN")


def test_empty_table(spark):
    df = spark.createDataFrame([], OBS)
    assert quality.extents(df).first()["record_count"] == 0
    assert quality.duplicate_count(df, ["station_id"]).first()["duplicates"] == 0


def test_duplicates_null_safe(spark):
    df = spark.createDataFrame([("a", "t"), ("a", "t"), (None, "t"), (None, "t"), ("b", "t")], "station_id string, timestamp string")
    assert quality.duplicate_count(df, ["station_id", "timestamp"]).first()["duplicates"] == 2


def test_time_formats(spark):
    texts = ["2024-06-01", "2024-06-01 05:06", "2024-06-01 05:06:07", "2024-06-01T05:06:07", "2024-06-01T05:06:07Z", "not-a-date", "2024-13-01", None, " 2024-06-01 "]
    got = col(spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(parse_time("t"), "yyyy-MM-dd HH:mm:ss").alias("x")), "x")
    day = "2024-06-01 "
    assert got == [day + "00:00:00", day + "05:06:00", day + "05:06:07", day + "05:06:07", day + "05:06:07", None, None, None, day + "00:00:00"]


def test_bounds(spark):
    def n(*box):
        df = spark.createDataFrame([tuple(map(float, box))], "a double, b double, c double, d double")
        return sum(col(quality.checks_to_rows(df, quality.bounds_checks(F.col("a"), F.col("b"), F.col("c"), F.col("d"))), "n_bad"))

    assert n(3, 40, 65, 100) == 4 and n(8, 35, 70, 95) == 0


def test_forecast_order(spark):
    df = spark.createDataFrame([("2024-06-02 00:00", "2024-06-01 00:00", "-24", "10", "77")], "forecast_issue_time string, valid_time string, lead_time string, latitude string, longitude string")
    bad = {r.check_id: r.n_bad for r in quality.forecast_checks(df).collect()}
    assert bad["valid_before_issue"] == 1 and bad["negative_lead"] == 1


def test_mapping_and_lookup(sample):
    assert quality.apply_mapping(sample, {"stn": "station_id", "x": "absent"}).columns[0] == "stn"
    assert quality.find_column(sample, "LATITUDE") == "latitude" and quality.find_column(sample, "nope") is None


def test_leakage_guard():
    with pytest.raises(ValueError):
        quality.leakage_guard(["month", "observed_humidity"])
    assert quality.leakage_guard([*C.FORECAST_FEATURES, *C.GEO_FEATURES]) == [*C.FORECAST_FEATURES, *C.GEO_FEATURES]


# ---------------------------------------------------------------- space
def test_projection_round_trip(spark):
    df = spark.createDataFrame([(76.96, 10.99), (75.0, 0.0), (78.5, 28.0)], "lon double, lat double")
    r = unproject_points(project_points(df, "lon", "lat"), "x", "y", "lo", "la").collect()
    assert all(abs(k.lon - k.lo) < 1e-5 and abs(k.lat - k.la) < 1e-5 for k in r)
    assert project_points(df.filter("lon = 75"), "lon", "lat").first()["x"] == 500000.0


def test_grid_cells(spark):
    box = spark.createDataFrame([(10.90, 11.10, 76.80, 77.00)], "min_lat double, max_lat double, min_lon double, max_lon double")
    g = spatial.metric_grid(box)
    rows = g.orderBy("cell_idx").collect()
    assert len({r.grid_id for r in rows}) == len(rows) and rows[0].grid_id == "GRID_00001" and rows[-1].cell_idx == len(rows)
    assert all(r.max_x - r.min_x == 1000.0 and r.max_y - r.min_y == 1000.0 for r in rows)
    assert [(r.min_y, r.min_x) for r in rows] == sorted((r.min_y, r.min_x) for r in rows)


def test_full_box_grid_size(spark):
    box = spark.createDataFrame([(10.20, 11.40, 76.60, 77.30)], "min_lat double, max_lat double, min_lon double, max_lon double")
    assert spatial.metric_grid(box).count() == 10530


@pytest.mark.parametrize("layout", ["uniform", "clustered", "one_spot", "line"])
def test_nearest_against_brute_force(spark, layout):
    rnd = random.Random(7)
    if layout == "uniform":
        items = [(i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(300)]
    elif layout == "clustered":  # most items in one dense corner
        items = [(i, 900 + rnd.random() * 0.01, 900 + rnd.random() * 0.01) if i % 3 else (i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(300)]
    elif layout == "one_spot":
        items = [(i, 5.0, 5.0) for i in range(100)] + [(200, 800.0, 1.0)]
    else:
        items = [(i, float(i), 0.0) for i in range(200)]
    queries = [(k, rnd.uniform(-300, 1300), rnd.uniform(-300, 1300)) for k in range(120)] + [(120, 2.5, 0.0), (121, 900.0, 900.0)]
    q, it = spark.createDataFrame(queries, "k int, qx double, qy double"), spark.createDataFrame(items, "i int, x double, y double")
    got = spatial.nearest_join(q, it, "qx", "qy", ("x", "y", "x", "y"), spatial.plane_distance("qx", "qy", "x", "y"), ["i"], ["i"])
    want = {k: min((math.floor(math.hypot(a - x, b - y) * 1e6 + 0.5003) / 1e6, i) for i, x, y in items)[1] for k, a, b in queries}
    assert {r.k: r.i for r in got.collect()} == want


def square(i, x, y, side):
    pts = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return (i, f"GP_{i}", f"Name {i}", "B", "D", [[[list(map(float, p)) for p in pts]]])


LAYER = "feature_idx int, panchayat_id string, panchayat_name string, block_name string, district_name string, polygons array<array<array<array<double>>>>"


def layer(spark, *shapes):
    from terracast.functions.shapes import shape_edges

    return spark.createDataFrame(list(shapes), LAYER).withColumn("edges", shape_edges("polygons"))


def test_assignment_modes(spark):
    cells = spark.createDataFrame([("a", 0.5, 0.5), ("b", 1.0, 0.5), ("c", 9.0, 9.0)], "grid_id string, longitude double, latitude double")
    got = {r.grid_id: (r.panchayat_id, r.assignment_mode) for r in spatial.assign_villages(cells, layer(spark, square(0, 0, 0, 1), square(1, 1, 0, 1), square(2, 5, 5, 1))).collect()}
    # b lies on the shared border: the first feature wins
    assert got == {"a": ("GP_0", "centroid_contains"), "b": ("GP_0", "centroid_contains"), "c": ("GP_2", "nearest_fallback")}


def test_assignment_without_polygons(spark):
    cells = spark.createDataFrame([("a", 0.5, 0.5)], "grid_id string, longitude double, latitude double")
    r = spatial.assign_villages(cells, layer(spark, square(0, 0, 0, 1)).limit(0)).first()
    assert (r.panchayat_id, r.assignment_mode) == ("GP_UNKNOWN", "unassigned")


def test_shape_distance(spark):
    pts = spark.createDataFrame([(0.5, 0.5), (3.0, 0.5), (4.0, 5.0)], "px double, py double")
    got = {(r.px, r.py): r.distance for r in spatial.shape_distance(pts, layer(spark, square(0, 0, 0, 1)), "px", "py", "feature_idx").collect()}
    assert got == {(0.5, 0.5): 0.0, (3.0, 0.5): 2.0, (4.0, 5.0): 5.0}
    empty = spatial.shape_distance(pts, layer(spark, square(0, 0, 0, 1)).limit(0), "px", "py", "feature_idx")
    assert set(col(empty, "distance")) == {C.NO_WATER_M}


def test_self_crossing(spark):
    bow = (1, "GP_1", "n", "B", "D", [[[[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]])
    assert col(spatial.crossing_features(layer(spark, square(0, 0, 0, 1), bow), "feature_idx"), "feature_idx") == [1]


def test_feature_collection(spark):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"panchayat_code":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[0,0]}}]}'
    f = geojson.parse_collection(spark.createDataFrame([(text,)], "value string"))
    assert col(f.orderBy("feature_idx"), "geometry_type") == ["Polygon", "Point"]
    b = geojson.boundary_shapes(f).collect()
    assert len(b) == 1 and b[0].panchayat_id == "A" and b[0].panchayat_name == "UNKNOWN" and len(b[0].edges) == 3


# ---------------------------------------------------------------- raster
def test_mini_raster(spark):
    px = spark.createDataFrame([(r, c, [100.0, 110.0, 120.0][c]) for r in range(3) for c in range(3)], "row int, col int, value double")
    mid = raster.terrain(px).filter("row = 1 and col = 1").first()
    assert mid.slope == pytest.approx(math.degrees(math.atan(1 / 3))) and mid.tri == pytest.approx(math.sqrt(600))


def test_tile_borders(spark, monkeypatch):
    rnd = random.Random(3)
    z = {(r, c): rnd.random() for r in range(7) for c in range(9)}
    monkeypatch.setattr(raster, "TILE", 3)
    px = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, value double")
    clampd = lambda v, n: min(max(v, 0), n - 1)
    for r in raster.neighbourhood(px).collect():
        assert list(r.w) == [z[clampd(r.row + a, 7), clampd(r.col + b, 9)] for a in (-1, 0, 1) for b in (-1, 0, 1)]


def test_window_strips(spark, monkeypatch):
    monkeypatch.setattr(raster, "BAND", 4)
    px = spark.createDataFrame([(r, c, float(r * 30 + c)) for r in range(12) for c in range(30)], "row int, col int, value double")
    cells = spark.createDataFrame([("a", 0, 0), ("b", 6, 15), ("c", 11, 29)], "grid_id string, pixel_row int, pixel_col int")
    got = {r.grid_id: (r.n, r.s) for r in raster.window_pixels(cells, px, ["value"]).groupBy("grid_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    want = lambda pr, pc: [float(r * 30 + c) for r in range(max(0, pr - 5), min(12, pr + 6)) for c in range(max(0, pc - 5), min(30, pc + 6))]
    assert got == {k: (len(want(r, c)), sum(want(r, c))) for k, r, c in (("a", 0, 0), ("b", 6, 15), ("c", 11, 29))}
    assert got["b"][0] == 121


def test_landcover_ties_and_unknown(spark):
    px = spark.createDataFrame([(0, 0, 20), (0, 1, 10), (0, 2, 60)], "row int, col int, value int")
    cells = spark.createDataFrame([("a", 0, 1), ("far", 99, 99)], "grid_id string, pixel_row int, pixel_col int")
    got = {r.grid_id: r for r in raster.landcover_features(cells, px).collect()}
    assert got["a"].dominant_landcover_class == "Tree cover" and got["a"].nodata_fraction == 0.3334
    assert got["far"].dominant_landcover_class == "Cropland" and got["far"].landcover_fraction_cropland == 1.0


# ---------------------------------------------------------------- baselines and intervals
def test_lapse_rate(spark):
    df = spark.createDataFrame([(25.0, 50.0, 1000.0, 350.0), (25.0, 50.0, 350.0, 350.0)], "forecast_temperature double, forecast_humidity double, station_elevation double, grid_elevation double")
    got = col(B.lapse_rate(df), "b2_temperature")
    assert got[0] in (20.77, 20.78) and got[1] == 25.0


def test_quantile_map_shift(spark):
    df = spark.createDataFrame([("TRAIN", 20.0, 22.0, 60.0, 55.0), ("TRAIN", 24.0, 26.0, 80.0, 75.0), ("TEST", 22.0, 0.0, 65.0, 0.0), ("TEST", 28.0, 0.0, 75.0, 0.0)],
                               "split string, b2_temperature double, observed_temperature double, b0_humidity double, observed_humidity double")
    out = B.quantile_map(df).filter("split = 'TEST'").orderBy("b2_temperature").collect()
    assert [(r.b3_temperature, r.b3_humidity) for r in out] == [(24.0, 60.0), (26.0, 70.0)]
    none = B.quantile_map(df.filter("split = 'TEST'")).orderBy("b2_temperature").collect()
    assert [(r.b3_temperature, r.b3_humidity) for r in none] == [(22.0, 65.0), (28.0, 75.0)]


def test_interpolation(spark):
    xs, ys = [float(i) for i in range(25)], [float(i * i) for i in range(25)]
    df = spark.createDataFrame([(x, xs, ys) for x in (-1.0, 0.0, 9.5, 10.0, 23.99, 24.0, 99.0)], "x double, xs array<double>, ys array<double>")
    assert col(interpolate(df, "x", "xs", "ys", "y"), "y") == pytest.approx([0.0, 0.0, 90.5, 100.0, 575.53, 576.0, 576.0])


def test_conformal(spark):
    df = spark.createDataFrame([(1.0, 0.5, 2.0), (5.0, 4.0, 6.0), (5.0, 6.0, 7.0)], "y double, lo double, hi double")
    assert col(df.select(U.conformity_score("y", "lo", "hi").alias("s")), "s") == [-0.5, -1.0, 1.0]
    ten = spark.createDataFrame([(float(i - 4),) for i in range(10)], "score double")
    assert U.rank_for(10) == 8 and U.conformal_correction(ten).first()["correction"] == 4.0
    for n in range(1, 40):
        got = spark.range(1).select(U.conformal_rank(F.lit(n)).alias("k")).first()["k"]
        assert got == U.rank_for(n)


def test_reliability_and_order(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (6.0,), (3.0,), (5.0,)], "w double")
    assert col(df.select(U.reliability("w", "temperature").alias("c")), "c") == ["HIGH", "MEDIUM", "LOW", "HIGH", "MEDIUM"]
    lo, mid, hi = U.monotone(F.lit(3.0), F.lit(2.0), F.lit(1.0))
    assert tuple(spark.range(1).select(lo, mid, hi).first()) == (3.0, 3.0, 3.0)


def test_exact_quantiles_with_a_hot_value(spark):
    rnd = random.Random(5)
    xs = [1.5] * 400 + [round(rnd.gauss(0, 3), 2) for _ in range(800)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    s, levels = sorted(xs), [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    want = []
    for q in levels:
        p = q * (len(s) - 1)
        a, b = s[math.floor(p)], s[math.ceil(p)]
        want.append(a + (b - a) * (p - math.floor(p)))
    got = {r.level_no: r.quantile for r in quantiles.quantile_rows(df, "x", levels).collect()}
    assert [got[i] for i in range(len(levels))] == pytest.approx(want)


# ---------------------------------------------------------------- scores
def test_point_scores(spark):
    df = spark.createDataFrame([(20.0, 21.0), (25.0, 24.0), (30.0, 30.0), (None, 1.0)], "y double, p double")
    assert tuple(df.agg(*E.point_scores("y", "p")).first()) == (0.6667, 0.8165, 0.0)
    i = [spark.range(1).select(E.improvement(F.lit(a), F.lit(b)).alias("x")).first()["x"] for a, b in ((2.0, 1.5), (1.5, 2.0), (0.0, 1.5))]
    assert i == [25.0, -33.33, 0.0]


def test_probability_scores(spark):
    df = spark.createDataFrame([(0.7, 1), (0.8, 0), (0.2, 1), (0.3, 0)], "p double, y int")
    r = E.probability_scores(df, "p", "y", []).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.pod, r.far) == (1, 1, 1, 1, 0.5, 0.5) and r.csi == pytest.approx(1 / 3)
    three = spark.createDataFrame([(0.8, 1), (0.2, 0), (0.9, 1)], "p double, y int")
    assert three.agg(E.brier("p", "y").alias("b")).first()["b"] == pytest.approx(0.03)


def test_rain_labels(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 5.0, 10.0, 20.0, 25.0, 30.0, None)], "observed_rainfall double")
    out = E.rain_labels(df)
    assert col(out, "rain_1mm") == [0, 0, 1, 1, 1, 1, 1, 1, 0] and col(out, "rain_10mm") == [0, 0, 0, 0, 1, 1, 1, 1, 0] and col(out, "rain_25mm") == [0, 0, 0, 0, 0, 0, 1, 1, 0]


def test_empty_reliability_bins(spark):
    c = E.reliability_curve(spark.createDataFrame([(0.1, 1), (1.0, 1)], "p double, y int"), "p", "y").orderBy("bin_lower").collect()
    assert [r["count"] for r in c] == [1, 0, 0, 0, 1] and c[1].mean_pred_prob == pytest.approx(0.3)


def test_isotonic_and_single_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.3, 0), (0.6, 1), (0.8, 1)], "p double, y int")
    out = models.IsotonicScaler("p", "y").fit(df).transform(spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.9,)], "p double"), "c")
    got = col(out, "c")
    assert got == sorted(got) and got[0] == 0.0 and got[-1] == 1.0
    zero = df.withColumn("y", F.lit(0))
    assert set(col(models.IsotonicScaler("p", "y").fit(zero).transform(df, "c"), "c")) == {0.0}


# ---------------------------------------------------------------- villages and serving
def _cells(spark):
    rows = [("GP_01", "2024-05-01", 24, p / 10, p / 20, 0.0) for p in range(1, 6)] + [("GP_02", "2024-05-01", 24, 0.5, 0.1, 0.0), ("GP_02", "2024-05-01", 24, 0.7, 0.1, 0.0), ("GP_03", "2024-05-01", 24, 0.2, 0.1, 0.0)]
    return spark.createDataFrame(rows, "panchayat_id string, timestamp string, lead_time int, prob_1mm double, prob_10mm double, prob_25mm double")


@pytest.mark.parametrize("hot", [1000, 2])
def test_village_aggregation(spark, hot):
    got = {r.panchayat_id: r for r in villages.village_rainfall(_cells(spark), hot_group=hot).collect()}
    a, b, c = got["GP_01"], got["GP_02"], got["GP_03"]
    assert a.grid_cell_count == 5 and a.aggregation_status == "OK" and a.rain_probability_1mm == pytest.approx(0.3)
    assert a.rain_probability_1mm_p10 == pytest.approx(0.14) and a.rain_probability_1mm_p90 == pytest.approx(0.46)
    assert b.aggregation_status == "SUBGRID_RANGE_UNRESOLVED" and c.spatial_spread_1mm == 0.0


def test_gating_keeps_nulls(spark):
    r = serve.rainfall_record(villages.village_rainfall(_cells(spark))).filter("panchayat_id = 'GP_01'").first()
    assert r.rain_probability_10mm is None and r.rain_probability_25mm is None and r.is_valid and not r.is_evaluable_10mm


def test_weather_record_without_optional_columns(spark):
    df = spark.createDataFrame([("S", "2024-05-01", 24, 25.0, 60.0)], "station_id string, observation_time string, lead_time_hours int, ml_temperature double, ml_humidity double")
    r = serve.weather_record(df).first()
    assert r.is_valid and r.b1_temperature is None and r.q10_humidity is None and (r.temperature_reliability, r.humidity_reliability) == ("MEDIUM", "LOW")


def test_validators(spark):
    one = spark.range(1)
    bad = one.select(checks.temperature_message(F.lit(150.0)), checks.humidity_message(F.lit(-10.0)), checks.humidity_message(F.lit(105.0)), checks.ordering_message(F.lit(35.0), F.lit(30.0), F.lit(40.0)), checks.probability_message(F.lit(1.5))).first()
    assert all(bad)
    good = one.select(checks.temperature_message(F.lit(60.0)), checks.humidity_message(F.lit(0.0)), checks.ordering_message(F.lit(1.0), F.lit(1.0), F.lit(2.0)), checks.probability_message(F.lit(None).cast("double"))).first()
    assert not any(good)


def test_labels(spark):
    nul = F.lit(None).cast("double")
    r = spark.range(1).select(labels.temperature_label(F.lit(25.04)), labels.temperature_label(nul), labels.humidity_label(F.lit(60.0)), labels.interval_label(F.lit(1.0), F.lit(2.0), "%"), labels.interval_label(nul, F.lit(2.0)),
                              labels.probability_label(F.lit(0.25)), labels.probability_label(F.lit(0.25), F.lit(False))).first()
    assert tuple(r) == ("25.0 °C", "N/A", "60.0 %", "1.0 — 2.0 %", "Interval unavailable", "25.0%", "Not evaluable")


def test_strict_export(sample):
    with pytest.raises(ValueError):
        sinks.strict_columns(sample, ["station_id", "ml_temperature"])


def test_no_match_raises(spark):
    with pytest.raises(ValueError):
        matchup.require_rows(spark.range(0), "matchup")


def test_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,)], "x double")
    assert col(df.select(half_even("x", 2).alias("r")), "r") == [0.12, 0.38, -0.12]


def test_streaming_ingest(spark, tmp_path):
    from terracast.streaming.ingest import append_to, observation_stream

    rows = [("S1", "2024-06-01", "10", "77", "30", "60", "0", None, None, None), ("S2", "bad", "10", "77", "30", "60", "0", None, None, None), ("S3", "2024-06-01", "10", "77", "99", "60", "0", None, None, None)]
    cols = [*C.OBSERVATION_REQUIRED, *C.OBSERVATION_OPTIONAL]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).write.option("header", True).csv(str(tmp_path / "in"))
    q = append_to(observation_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.station_id: r.qc_status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"S1": "VALID", "S3": "INVALID"}


def test_model_invariants(spark):
    rnd = random.Random(11)
    rows = [(i, i % 24, rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, h int, a double, b double").withColumns({"y": F.col("a") * 4 + F.col("b"), "b2_temperature": F.lit(1.0), "e": (F.col("a") > 0.5).cast("int")})
    p = C.BoostParams(trees=5, depth=3)
    one = col(models.predict_residual(models.fit_residual(df, ["a", "b"], "y", p), df, ["a", "b"], "temperature", "b2_temperature").orderBy("k"), "ml_temperature")
    two = col(models.predict_residual(models.fit_residual(df, ["a", "b"], "y", p), df, ["a", "b"], "temperature", "b2_temperature").orderBy("k"), "ml_temperature")
    assert one == two and all(v is not None for v in one)
    q = models.QuantileForest(["a", "b"], "y", trees=5).fit(df).transform(df, ["k"], "r").select(F.avg((F.col("y").between(F.col("r_q10"), F.col("r_q90"))).cast("int")).alias("c")).first()["c"]
    assert q > 0.6
    pr = col(models.RainModel("logistic", ["a", "b"], "e").fit(df).transform(df, "p"), "p")
    assert all(0.0 <= v <= 1.0 for v in pr)
    assert len(list(itertools.islice(models.seeded_sample(df, ["k"], 50).collect(), 60))) == 50


def test_lead_times_fall_back(spark):
    from terracast.operators import serve

    rain = spark.createDataFrame([(48,), (24,), (48,), (None,)], "lead_time int")
    weather = spark.createDataFrame([(72,)], "lead_time_hours int")
    leads = lambda *t: [r.lead_time for r in serve.available_leads(*t).collect()]
    assert (leads(rain, weather), leads(None, weather), leads(None)) == ([24, 48], [72], [24, 48, 72])
