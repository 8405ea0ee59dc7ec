"""Session settings and the shared folder used to cut lineage and to stage outputs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lets a JSON label repeat a key; the last value counts.
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def build_session(name: str = "fieldwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC timestamps."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        REPEATED_KEYS: "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` (or a folder already set on the context) is used
    as it is. A session without either gets a folder of its own only when its
    executors run on this machine, as in tests; a cluster must name one.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-fieldwarden-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    For results that later steps read several times: the work behind them runs
    once, survives lost executors, and the scan of the table prunes columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame) -> DataFrame:
    """Keeps derived columns from being copied into the filters and batch functions above them.

    Neither filters nor projections are merged through a generator, so the
    expressions below it run once per row.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def task_count(spark: SparkSession) -> int:
    """How many tasks CPU-heavy work on few bytes is cut into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Most rows of a table in a task that multiplies or sorts them: what a task holds does not grow with the table.
TASK_ROWS = 125_000


def parts_of(df: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """How many tasks take at most about ``task_rows`` rows of a table each; at least one per core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows))


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """``df`` over at least as many tasks as there are cores; only a scan of few splits is reshuffled.

    With ``task_rows`` a table is counted and cut into tasks of at most about as many rows.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism if task_rows is None else parts_of(df, task_rows)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def table_path(sf_dir: str, name: str) -> str:
    """Path of one driver table."""
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; filters and columns chosen later reach this Parquet scan."""
    spark.conf.set(REPEATED_KEYS, "true")
    return spark.read.parquet(table_path(sf_dir, name))
