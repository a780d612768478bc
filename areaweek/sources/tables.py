"""Stored tables: upsert on the natural key, typed readers, counts, topics."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.panel import degree
from ..schemas import INCIDENTS, LGA_ADJACENCY, LGA_REGISTRY, TABLE_KEYS
from . import contracts, versions

def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def upsert(spark: SparkSession, path: str, table: str, rows: DataFrame, order: Sequence[str] = ("ingested_at",), batch: tuple[str, int] | None = None) -> bool:
    """Add ``rows`` to the stored table as a new version; rows that share a natural key are merged when read.

    The row with the highest ``order`` columns wins, a later batch among equals.
    Replaying rows leaves the table as it is, and so does an older batch over a newer
    one. With ``batch``, (writer, number), a repeated batch is not even stored.
    """
    return versions.append(spark, path, rows, TABLE_KEYS[table], order, batch=batch)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, versioned or plain Parquet."""
    return versions.read(spark, path, schema) if versions.is_versioned(spark, path) else spark.read.schema(schema).parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LGA_REGISTRY).orderBy("lga_code")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LGA_ADJACENCY).select("lga_code", "neighbour_code", "weight", "centroid_km")


def located_incidents(incidents: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    found = incidents.where(F.col("lga_code").isNotNull())
    return found if classes is None else found.where(F.col("event_class").isin(*classes))


def read_incidents(spark: SparkSession, path: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Located incidents; both conditions are pushed into the file scan."""
    dropped = ("source_event_id", "geolocation_precision", "date_precision", "description", "source_url", "ingested_at", "geom_wkt")
    return located_incidents(read_table(spark, path, INCIDENTS), classes).drop(*dropped)


def table_counts(tables: dict[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """Rows per table; a missing table counts 0."""
    out = None
    for name, frame in tables.items():
        n = F.count(F.lit(1))
        row = (spark.range(0) if frame is None else frame).agg(n.alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def degree_summary(adjacency: DataFrame) -> DataFrame:
    return degree(adjacency).agg(
        F.avg("n_neighbours").alias("mean_degree"), F.min("n_neighbours").alias("min_degree"), F.max("n_neighbours").alias("max_degree")
    )


def load_since(incidents: DataFrame | None, panel_start: str, until: str, days: int) -> str:
    """First day to load: a long backfill into an empty table, else a short recent window."""
    if incidents is None or incidents.isEmpty():
        return (date.fromisoformat(panel_start) - timedelta(days=3 * 365)).isoformat()
    return (date.fromisoformat(until) - timedelta(days=days)).isoformat()


def run_summary(records: DataFrame, producers: DataFrame) -> DataFrame:
    """One row per producer with its record count, 0 when it sent nothing."""
    sent = records.groupBy(F.col("source").alias("producer")).agg(F.count(F.lit(1)).alias("records"))
    return producers.join(sent, "producer", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def active_producers(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("records").alias("records"), F.count_if(F.col("records") > 0).alias("active"), F.count(F.lit(1)).alias("producers")
    )


def publish(
    rows: DataFrame, topic: str, schema: T.StructType, producer: str, ingest_date: str, defaults: dict | None = None, allowed: dict[str, Sequence[str]] | None = None,
    batch: str | None = None, strict: bool = False,
) -> None:
    """Append the rows that fit ``schema`` to a topic folder; the others go to its quarantine with their reasons.

    Rows are checked while they are written to a staging folder that no reader looks
    at, and move into the topic only once all of them are there. A publish that breaks before
    that leaves no row; one that stops while files move is finished by publishing
    again under the same ``batch`` name, which moves the missing files only. ``strict``
    refuses a batch with any bad row.
    """
    spark, batch = rows.sparkSession, batch or uuid.uuid4().hex
    stage, place = f"{topic}/_staging/{batch}", f"producer={producer}/ingest_date={ingest_date}"
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    files = new_path(topic).getFileSystem(spark._jsc.hadoopConfiguration())
    every, parted = f"{stage}/every", f"{stage}/parted"
    # Written as they come: one write into two folders would have every task sort all its rows first.
    if not path_exists(spark, f"{every}/_SUCCESS"):
        checked = contracts.check(rows, schema, defaults, allowed)
        checked.withColumn("fits", F.size(contracts.REASONS) == 0).write.mode("overwrite").parquet(every)
    # The files' statistics leave no file to read when all rows fit, and then the files are the topic's as they are.
    kinds = T.StructType([*schema.fields, T.StructField(contracts.REASONS, T.ArrayType(T.StringType())), T.StructField("fits", T.BooleanType())])
    staged = spark.read.schema(kinds).parquet(every)
    reasons = [r[0] for r in staged.where("not fits").select(contracts.REASONS).limit(5).collect()]
    if strict and reasons:
        files.delete(new_path(stage), True)
        raise contracts.ContractBroken("; ".join(", ".join(r) for r in reasons))
    if reasons:
        for fits in ("false", "true"):
            if not path_exists(spark, f"{parted}/fits={fits}/_SUCCESS"):
                staged.where(f"fits = {fits}").drop("fits").write.mode("overwrite").parquet(f"{parted}/fits={fits}")
    moves = [("parted/fits=false", f"{topic}/_quarantine/{place}"), ("parted/fits=true", f"{topic}/{place}")] if reasons else [("every", f"{topic}/{place}")]
    for part, target in moves:
        if not path_exists(spark, f"{stage}/{part}"):
            continue
        files.mkdirs(new_path(target))
        for found in files.listStatus(new_path(f"{stage}/{part}")):
            if found.getPath().getName().endswith(".parquet") and not files.rename(found.getPath(), new_path(f"{target}/{batch}-{found.getPath().getName()}")):
                raise OSError(f"{found.getPath()} could not be moved")


def quarantine(spark: SparkSession, topic: str, schema: T.StructType) -> DataFrame:
    """Rows of a topic that did not fit, with their reasons."""
    kinds = T.StructType([*schema.fields, T.StructField(contracts.REASONS, T.ArrayType(T.StringType())), *topic_schema(T.StructType([])).fields])
    at = f"{topic}/_quarantine"
    return spark.read.schema(kinds).parquet(at) if path_exists(spark, at) else spark.createDataFrame([], kinds)


def replay(spark: SparkSession, topic: str, schema: T.StructType) -> DataFrame:
    """Every record ever published to a topic."""
    return spark.read.schema(topic_schema(schema)).parquet(topic)


def topic_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("producer", T.StringType()), T.StructField("ingest_date", T.StringType())])


def write_panel(panel: DataFrame, path: str) -> None:
    panel.withColumn("year", F.year("week_start")).repartition("year", F.pmod(F.xxhash64("lga_code"), F.lit(16))).write.mode("overwrite").partitionBy("year").parquet(path)


def read_panel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
