"""Row numbers and written tables that the operators share."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from terracast.session import scratch_path

_SHIPPED: set[str] = set()
_TABLES: dict[tuple[str, str], list[str]] = {}
_OWNERS: list[str] = []


def _own_path(spark: SparkSession, label: str) -> str:
    path = scratch_path(spark, label)
    if _OWNERS:
        _TABLES.setdefault((spark.sparkContext.applicationId, _OWNERS[-1]), []).append(path)
    return path


@contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Tables written inside belong to `owner`, who can delete them. Those of other callers are never on its list."""
    _OWNERS.append(owner)
    try:
        yield
    finally:
        _OWNERS.pop()


def reliable_cut(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: what follows starts from files."""
    spark = df.sparkSession
    path = _own_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, owner: str) -> None:
    """Delete the tables written for `owner` so far. Call it once the results that read them are stored elsewhere."""
    for path in _TABLES.pop((spark.sparkContext.applicationId, owner), []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Hand this package's source to the executors, once per application: their Python needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    top = os.path.join(root, "terracast")
    path = os.path.join(tempfile.mkdtemp(prefix="terracast-src-"), "terracast.zip")  # Spark's file server sends it on
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most `rows` rows at once to a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def first_uid() -> int:
    """First of a task's row numbers. The rows must be written before a second use: a retry may number others so."""
    return TaskContext.get().partitionId() << 40


def bucketed_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """df written once to the shared folder, bucketed by `key`: later joins on it move the other side only."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _own_path(spark, label)
    name = "t_" + path.rpartition("-")[2]
    # one task writes one bucket, so there are n files
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: an external table keeps its files
    return table


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, or with underscores in front where the table has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish
