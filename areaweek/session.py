"""Session settings and the durable cut used between dependent stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", name: str = "areaweek", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the checkpoint folder the session names.

    Only when neither the session nor its context has one and Spark runs in this
    process (local runs and tests) is a fresh local folder made and set on the
    context; on a cluster that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    active = context._jsc.sc().getCheckpointDir()
    if active.isEmpty():
        if not configured and not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="areaweek-"))
        active = context._jsc.sc().getCheckpointDir()
    return configured or active.get()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage so later plans read the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``durable`` as compressed columns: for tables as long as the texts, of which each reader wants a few columns."""
    path = work_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are worth a task of their own where one table is read by very many short jobs.
ROWS_PER_TASK = 20_000


def one_wave(written: DataFrame) -> DataFrame:
    """A written table in as few pieces as its rows need: one wave of tasks, more only for more than ``ROWS_PER_TASK`` rows each.

    Meant for small tables that come in hundreds of pieces, each of which costs a task in
    every job that reads them. Rows do not move between tasks.
    """
    return written.coalesce(max(written.sparkSession.sparkContext.defaultParallelism, -(-written.count() // ROWS_PER_TASK)))


def gathered(df: DataFrame) -> DataFrame:
    """``durable``, read in one wave."""
    return one_wave(durable(df))


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for written tables and topics."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def spread(scan: DataFrame) -> DataFrame:
    """Use every core on a scan that comes in fewer pieces than there are cores.

    Meant for tables of long texts, where the work per row is large. A big table
    already has more scan tasks than cores and is returned unchanged, so its
    texts are never shuffled. ``scan`` must be a plain table read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
