"""Feature collections cut into many parts against a plain JSON parser."""
import json

import pytest
from pyspark.sql import functions as F

from terracast.sources import geojson as J


def _ring(x):
    return [[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 0.0]]


NAMES = ["plain", "a } brace", 'quote " inside', "back\\slash \\", "}{[]", '"features": [{', "", "தமிழ் }", "line\nfeed", 'end \\"}']


def _feature(i, **more):
    holes = {"type": "Polygon", "coordinates": [_ring(i), _ring(i + 0.1)]}
    many = {"type": "MultiPolygon", "coordinates": [[_ring(i)], [_ring(i + 2)]]}
    point = {"type": "Point", "coordinates": [i, 1]}
    return {"type": "Feature", "properties": {"name": NAMES[i % len(NAMES)], "no": str(i)}, "geometry": [holes, many, point, None][i % 4], **more}


def _collections():
    crs = {"type": "name", "properties": {"name": "urn:x", "features": [{"a": 1}]}}
    usual = {"type": "FeatureCollection", "name": "a } { \" layer", "crs": crs, "bbox": [1, 2, [3]], "features": [_feature(i) for i in range(60)]}
    after = {"type": "FeatureCollection", "other": [{"no": 1}, {"no": 2}], "features": [_feature(i, id={"x": {"y": i}}) for i in range(7)], "more": [{"type": "Feature"}], "last": {"a": {}}}
    return {
        "usual": json.dumps(usual), "pretty": json.dumps(usual, indent=3, ensure_ascii=False) + "\n", "dense": json.dumps(usual, separators=(",", ":")),
        "after": json.dumps(after), "after_pretty": json.dumps(after, indent=1), "empty": json.dumps({"type": "FeatureCollection", "features": []}),
        "empty_then_other": json.dumps({"type": "FeatureCollection", "features": [], "other": [{"a": 1}]}), "none": json.dumps({"type": "FeatureCollection"}),
        "nothing": "", "features_first": json.dumps({"features": [_feature(3), {}, {"type": "Feature"}, {"properties": 5}, _feature(4)], "type": "FeatureCollection"}),
    }


@pytest.mark.parametrize("size", ["64", "700", "128m"])
def test_texts_equal_a_json_parser(spark, tmp_path, size):
    texts = _collections()
    for name, text in texts.items():
        (tmp_path / f"{name}.geojson").write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = J.collection_texts(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", r"([^/]+)\.geojson", 1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {(r.file, r.feature_idx): json.loads(r.value) for r in got}
    assert len(found) == len(got)
    want = {(name, i): f for name, text in texts.items() if text for i, f in enumerate(json.loads(text).get("features", []))}
    assert found == want


def test_bad_features_are_rows_and_a_collection_has_parts(spark, tmp_path):
    bad = '{"type":"Feature","properties":{"no": oops},"geometry":null}'
    text = '{"type":"FeatureCollection","features":[' + ",".join([json.dumps(_feature(0)), bad, json.dumps(_feature(1)), '{"type":"Feature","proper']) 
    (tmp_path / "bad.geojson").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 3
        rows = {r.feature_idx: r for r in J.read_collection(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == [0, 1, 2, 3]
    assert rows[0].properties["no"] == "0" and rows[0].geometry_type == "Polygon" and len(rows[0].polygons[0]) == 2
    assert rows[1].geometry_type is None and rows[1].polygons is None
    assert rows[2].geometry_type == "MultiPolygon" and len(rows[2].polygons) == 2
    assert rows[3].properties is None and rows[3].polygons is None


def test_written_collections_come_back(spark, tmp_path):
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in _ring(0)])
    df = spark.range(25, numPartitions=4).withColumn("name", F.concat(F.lit('} "'), F.col("id").cast("string")))
    J.write_collections(df, str(tmp_path / "c"), ring, ["id", "name"])
    rows = J.read_collection(spark, str(tmp_path / "c")).collect()
    assert sorted(int(r.properties["id"]) for r in rows) == list(range(25))
    assert all(r.properties["name"] == '} "' + r.properties["id"] and r.polygons == [[_ring(0)]] for r in rows)
