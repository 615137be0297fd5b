"""Session helpers: local session for tests and benches, shared scratch folder."""
from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def local_session(cores: str = "8", name: str = "terracast") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="terracast-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session.

    Only a local session may go without the setting: it gets a temporary folder, stored in the
    session so that later calls agree on it. On a cluster each machine would see a folder of its own, so
    there the setting must name one that all share.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.terracast.scratch", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="terracast-")
        spark.conf.set("spark.terracast.scratch", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/terracast/{label}-{uuid.uuid4().hex[:12]}"


def reliable_cut(df, label: str):
    """Cut lineage by writing the table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: rows of one task where the work on a row is heavy beside reading it
ROWS_PER_TASK = 25_000


def spread(df, rows_per_task: int = ROWS_PER_TASK, by: tuple[str, ...] = (), most: int | None = None):
    """The same rows dealt over as many tasks as their number asks for (`by`: equal values together); a table of one task's rows stays as it is.

    A small file of many rows is read by one or two tasks, and small exchanges are merged into one, whatever is done with the rows afterwards.
    """
    parts = math.ceil(df.count() / rows_per_task)
    parts = min(parts, most or parts)
    return df.repartition(parts, *by) if parts > 1 else df


_STORED: dict[tuple, str] = {}


def file_marks(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of every file in a folder: changes when its tables do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def stored_table(spark: SparkSession, key: tuple, build):
    """A derived table that later steps read: built and written once per session and state of the folder key[0], then read.

    The stages of the pipeline hand over stored tables (grid, master, village forecasts), so
    a stage starts from files and not from the whole lineage before it. A table whose files
    are gone is built again.
    """
    full = (spark.sparkContext.applicationId, *key, file_marks(spark, key[0]))
    path = _STORED.get(full)
    if path:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    path = scratch_path(spark, str(key[-1]))
    build().write.mode("overwrite").parquet(path)
    _STORED[full] = path
    return spark.read.parquet(path)
