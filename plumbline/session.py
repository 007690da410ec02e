"""Session, scratch folders and lineage control."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows a lookup table may have before it stops being read to the driver.
SMALL_ROWS = 20_000


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on."""
    b = SparkSession.builder.appName("plumbline")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    base = tempfile.mkdtemp(prefix="plumbline-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _is_local(spark) and "://" not in path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The copy survives losing executors, drops the lineage, is computed once and
    has a known size, so later joins with a small one are broadcast by Spark.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames returned by `cut`, once nothing that is still to run reads them."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fetch_small(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """Rows of `df` when it has at most `limit`, else None; never reads more than `limit + 1`."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Mark `df` for broadcast only after counting that it stays within `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work every core when a small source comes in fewer splits than there are cores.

    A source with enough splits is returned as it is, and so is anything that
    already went through a shuffle.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def task_count(spark: SparkSession) -> int:
    """Partitions for CPU-heavy groups, which Spark would otherwise merge by their few bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
