"""Corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Every stage works on all that the one before kept and returns the columns of documents; the last returns
packed pieces. A stage begins by deleting the working tables of the pipeline's stages before it, and no others, so
write a stage's rows before the next stage is called. In order: the quality classifier drops what it rejects, line dedup takes repeated lines out,
one document of each near-duplicate group stays, documents contaminated with benchmark words go, and the
rest is packed into sequences.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracast.llm import decontaminate, linededup, minhash, packing, quality
from terracast.llm.storage import drop_tables, owned_by, reliable_cut, ship_package
from terracast.session import reliable_cut as stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


OWNER = "pipeline"


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the working tables of the stage before (its docs are stored) and puts its own on the pipeline's list."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        drop_tables(spark, OWNER)
        with owned_by(OWNER):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above; empty texts are scored like others."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = quality.scored(docs.select(*COLUMNS), model)
    return rated.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line holds; n_chars follows the text.

    A document all of whose lines of words went (it repeats others throughout) goes; one without such
    lines from the start stays as it is.
    """
    cut = linededup.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\r\\n]")
    changed = F.col("n_exact") + F.col("n_near") > 0
    n_chars = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumn("n_chars", n_chars).select(*COLUMNS)


@stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group: five-word shingles, similarity 0.8; documents without words stay."""
    return minhash.keep_one(docs.select(*COLUMNS), shingle=5, percent=80)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in benchmark windows."""
    numbered = reliable_cut(docs.select(*COLUMNS).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    hits = decontaminate.contamination(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="uid")
    bad = hits.where(decontaminate.is_contaminated()).select(F.col("doc_id").alias("uid"))
    return numbered.join(bad, "uid", "left_anti").select(*COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, with its token ids and its place in a sequence of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
#: a trained classifier and a tokenizer decide about the rows: SQL can't express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that come out of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    drop_tables(spark, OWNER)
    return docs
