"""A dense layer's pyramid is walked in several stages, with the same nearest items."""
from pyspark.sql import functions as F

from terracast.operators import spatial


def test_deep_walks_go_on_from_written_tables(spark, monkeypatch):
    seen = []
    real = spatial.reliable_cut
    monkeypatch.setattr(spatial, "reliable_cut", lambda df, label: seen.append(label) or real(df, label))
    monkeypatch.setattr(spatial, "WALK_ROWS_PER_TASK", 20)
    spots = spark.range(0, 60).select(F.col("id"), ((F.col("id") * 7) % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    # boxes of one place, more than a tile may hold: no depth parts them
    items = spark.range(0, 90).select(F.col("id").alias("no"), (F.col("id") % 3 * 8.0).alias("ix"), F.lit(1.5).alias("iy")).select("*", (F.col("ix") + 0.25).alias("jx"))
    middle = spatial.plane_distance("x", "y", "ix", "iy")
    got = spatial.nearest_join(spots, items, "x", "y", ("ix", "iy", "jx", "iy"), middle, ["no"], ["no"])
    rows = got.select("id", "x", "y", "no", "distance").collect()
    assert len(rows) == 60 and seen.count("walk") == 2
    pts = items.collect()
    for r in rows:
        d, no = min((round(((r["x"] - p["ix"]) ** 2 + (r["y"] - p["iy"]) ** 2) ** 0.5, 6), p["no"]) for p in pts)
        assert (r["no"], round(r["distance"], 6)) == (no, d)
