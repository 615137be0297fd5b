"""GeoJSON features as rows and back."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terracast.functions.shapes import shape_edges
from terracast.session import reliable_cut

_FEATURE = "STRUCT<type STRING, properties MAP<STRING,STRING>, geometry STRUCT<type STRING, coordinates STRING>>"
_POLYGON = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
_MULTI = "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"

# fixed values: property defaults of boundary and water features
BOUNDARY_DEFAULTS = {"panchayat_code": "UNKNOWN_GP", "panchayat_name": "UNKNOWN", "block_name": "UNKNOWN", "district_name": "Coimbatore"}


def _typed(feature: Column) -> list[Column]:
    kind, raw = feature["geometry"]["type"], feature["geometry"]["coordinates"]
    polygons = F.when(kind == "Polygon", F.array(F.from_json(raw, _POLYGON))).when(kind == "MultiPolygon", F.from_json(raw, _MULTI))
    return [feature["properties"].alias("properties"), kind.alias("geometry_type"), polygons.alias("polygons")]


def parse_features(lines: DataFrame, text: str = "value", order: str | None = None) -> DataFrame:
    """One feature per line: feature order (if given), properties, type, polygons."""
    keep = [order] if order else []
    return lines.select(*keep, F.from_json(F.col(text), _FEATURE).alias("f")).select(*keep, *_typed(F.col("f")))


def parse_collection(docs: DataFrame, text: str = "value") -> DataFrame:
    """Feature collections, one document per row: feature_idx is the position in the document."""
    fc = F.from_json(F.col(text), f"STRUCT<type STRING, features ARRAY<{_FEATURE}>>")
    rows = docs.select(fc.alias("c")).select(F.posexplode("c.features").alias("feature_idx", "f"))
    return rows.select("feature_idx", *_typed(F.col("f")))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection files of any size and layout, read in parts: file, feature_idx (place among the file's features), properties, geometry_type, polygons.

    Objects of the top-level array "features" are features; one that can't be read is a row of NULLs. Members of
    "features" that aren't objects are no rows and take no place; other members of the collection are ignored. An empty collection gives no
    rows; of a text cut off in mid-feature the last row holds what could be read.
    """
    return collection_texts(spark, path).select("file", "feature_idx", F.from_json("value", _FEATURE).alias("f")).select("file", "feature_idx", *_typed(F.col("f")))


def _carried(pieces: DataFrame, steps: dict[str, str]) -> DataFrame:
    """Adds sums of columns over all pieces of the file before this one: over blocks first (one row each), then inside a block."""
    order = W.partitionBy("file", "block").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(*[F.sum(c).alias(f"_{c}") for c in steps])
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in steps])
    inside = pieces.withColumns({name: F.coalesce(F.sum(c).over(order), F.lit(0)) for c, name in steps.items()})
    sums = inside.join(blocks, ["file", "block"]).withColumns({name: F.col(name) + F.col(f"_{c}") for c, name in steps.items()})
    return sums.drop(*[f"_{c}" for c in steps])


def collection_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, feature_idx, value: the text of each feature of FeatureCollection files, cut out by many tasks.

    The text reader cuts a file at closing braces, so that tasks share it by byte ranges. What a piece means
    depends on what stands before it: whether it begins inside a string (the parity of the quotes so far) and how
    many objects are open (the sum of braces outside strings). Both are prefix sums, over blocks and inside a block. An object that
    opens inside the collection starts a member; its pieces are put together again.
    """
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value",
    )
    # an escaped character takes part in nothing; its place is kept
    plain = F.regexp_replace("value", r"(?s)\\.", "__")
    pieces = pieces.withColumn("quotes", F.length(F.regexp_replace(plain, '[^"]', "")).cast("long"))
    pieces = reliable_cut(pieces, "collection-pieces")
    known = _carried(pieces, {"quotes": "quotes_before"})
    quoted = F.col("quotes_before") % 2 == 1
    # a string that goes on from the piece before, whole strings, and one that the next piece ends
    outside = F.when(quoted, F.regexp_replace(plain, '^[^"]*+"?', "")).otherwise(plain)
    bare = F.regexp_replace(F.regexp_replace(outside, '"[^"]*+"', ""), '"[^"]*+$', "")
    known = known.withColumn("opens", F.length(F.regexp_replace(bare, "[^{]", "")).cast("long"))
    closes = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("long")
    known = known.withColumn("rise", F.col("opens") - closes)
    known = _carried(known.select("file", "block", "id", "value", "quotes_before", "opens", "rise"), {"rise": "depth"})
    starts = (F.col("depth") <= 1) & (F.col("depth") + F.col("opens") >= 2)
    known = known.withColumn("starts", starts.cast("long"))
    known = reliable_cut(_carried(known, {"starts": "number"}).drop("rise", "opens"), "collection-places")
    # the number of the member that a piece is part of, from 0
    known = known.withColumn("number", F.col("number") + F.col("starts") - 1).where((F.col("number") >= 0) & ((F.col("depth") > 1) | (F.col("starts") == 1)))

    # what stands before the member's brace says whether an array begins or ends there
    head = lambda text: F.regexp_extract(text, r'^[^"{]*+(?:"[^"]*+"[^"{]*+)*+\{', 0)
    rest = lambda text: F.substring(text, F.length(head(text)) + 1, F.length(text))
    lead = F.when(F.col("depth") == 1, head(outside)).otherwise(F.concat(head(outside), head(rest(outside))))
    opened = known.where("starts = 1").withColumn("lead", lead)
    marks = F.regexp_replace("lead", r'"features"\s*+:\s*+\[', "<")
    marks = F.regexp_replace(F.regexp_replace(marks, '"[^"]*+"', ""), r"\[[^\[\]<]*+\]", "")
    marks = F.regexp_replace(marks, r"[^\[\]<]", "")
    decided = opened.select("file", "number", marks.alias("marks")).where("marks != '' or number = 0")
    spans = decided.withColumn("until", F.lead("number").over(W.partitionBy("file").orderBy("number")))
    spans = spans.where(F.col("marks").endswith("<")).select("file", F.col("number").alias("first"), "until")

    skip = F.length(F.col("value")) - F.length(outside) + F.length("lead")
    cut = known.join(opened.select("file", "block", "id", skip.alias("skip")), ["file", "block", "id"], "left")
    text = F.when(F.col("skip").isNull(), F.col("value")).otherwise(F.substring(F.col("value"), F.col("skip"), F.length("value")))
    parts = cut.select("file", "number", F.struct("block", "id", text.alias("text")).alias("part"))
    whole = parts.groupBy("file", "number").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = whole.join(spans, "file").where("number >= first and (until is null or number < until)")
    value = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}"))
    return whole.select("file", (F.col("number") - F.col("first")).alias("feature_idx"), value.alias("value"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_features(spark.read.text(path))


def prop(name: str, default: str | None = None) -> Column:
    c = F.col("properties")[name]
    return c if default is None else F.coalesce(c, F.lit(default))


def boundary_shapes(features: DataFrame) -> DataFrame:
    """Village polygons ready for the spatial joins."""
    d = BOUNDARY_DEFAULTS
    return features.filter(F.col("polygons").isNotNull()).select(
        "feature_idx", prop("panchayat_code", d["panchayat_code"]).alias("panchayat_id"), prop("panchayat_name", d["panchayat_name"]).alias("panchayat_name"),
        prop("block_name", d["block_name"]).alias("block_name"), prop("district_name", d["district_name"]).alias("district_name"),
        prop("area_sq_km").try_cast("double").alias("area_sq_km"), shape_edges("polygons").alias("edges"),
    )


def exterior_only(polygons="polygons") -> Column:
    """Only the outer ring of every polygon, as the water distance uses it."""
    return F.transform(F.col(polygons) if isinstance(polygons, str) else polygons, lambda p: F.slice(p, 1, 1))


def to_feature(properties: list[str], ring: Column) -> Column:
    """A GeoJSON Feature text from columns and one closed ring."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    ))


def write_feature_lines(df: DataFrame, path: str, ring: Column, properties: list[str]) -> None:
    df.select(to_feature(properties, ring).alias("value")).write.mode("overwrite").text(path)


def write_collections(df: DataFrame, path: str, ring: Column, properties: list[str]) -> None:
    """One FeatureCollection file for each task, a feature a line; a task without rows writes an empty collection."""

    def framed(batches):
        first = True
        yield pd.DataFrame({"value": ['{"type": "FeatureCollection", "features": [']})
        for b in batches:
            comma = pd.Series([","] * len(b), dtype=object)
            if first and len(b):
                comma[0], first = "", False
            yield pd.DataFrame({"value": comma + b["value"].reset_index(drop=True)})
        yield pd.DataFrame({"value": ["]}"]})

    df.select(to_feature(properties, ring).alias("value")).mapInPandas(framed, "value string").write.mode("overwrite").text(path)
