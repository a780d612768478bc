"""Structured Streaming forms of the drains and the weekly chatter measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLE_KEYS
from ..sources import versions
from ..sources.tables import topic_schema, upsert

FILES_PER_BATCH = 2000


def topic_stream(spark: SparkSession, topic: str, schema: T.StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Records of a topic folder as they arrive, in bounded micro-batches."""
    return spark.readStream.schema(topic_schema(schema)).option("maxFilesPerTrigger", files_per_batch).parquet(topic)


def drain(
    spark: SparkSession, topic: str, schema: T.StructType, table: str, table_path: str, checkpoint: str,
    files_per_batch: int = FILES_PER_BATCH, dedupe_within: str | None = None, event_time: str = "ingested_at", once: bool = True,
):
    """Upsert a topic into its table, a version for each batch; a replayed batch changes nothing.

    ``dedupe_within`` also drops repeats of a key inside that delay before the sink.
    """
    rows = topic_stream(spark, topic, schema, files_per_batch)
    if dedupe_within:
        rows = rows.withWatermark(event_time, dedupe_within).dropDuplicatesWithinWatermark(list(TABLE_KEYS[table]))

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, table_path, table, batch.drop("producer", "ingest_date"), batch=(checkpoint, number))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def weekly_deltas(posts: DataFrame, sign: str | None = None) -> DataFrame:
    """What ``posts`` add to each unit and Monday-aligned week: (lga_code, week_start, volume, threat).

    With ``sign``, a column of 1 and -1, withdrawn posts are taken off the volume; a
    peak of threat stays once it was seen. Posts without a unit or time count nowhere.
    """
    threat = F.greatest(F.coalesce("threat_score", F.lit(0.0)), F.lit(0.0))
    one = F.col(sign) if sign else F.lit(1)
    week = F.date_trunc("week", F.col("posted_at").cast("timestamp")).cast("date").alias("week_start")
    return posts.where("lga_code is not null and posted_at is not null").groupBy("lga_code", week).agg(
        F.sum(one).cast("long").alias("volume"), F.coalesce(F.max(F.when(one > 0, threat)), F.lit(0.0)).alias("threat")
    )


def keep_weekly(posts: DataFrame, table_path: str, checkpoint: str, writer: str = "weekly", sign: str | None = None, once: bool = True):
    """Keep weekly measures of a stream of posts as deltas, one version for each batch number of ``writer``.

    However late a post comes, it adds to its week: there is no watermark, no state
    and nothing to drop. A batch whose number was committed adds nothing again. The
    table is read by ``read_weekly``.
    """

    def write(batch: DataFrame, number: int) -> None:
        versions.append(
            batch.sparkSession, table_path, weekly_deltas(batch, sign), ("lga_code", "week_start"), measures={"volume": "sum", "threat": "max"}, batch=(writer, number)
        )

    started = posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()


def read_weekly(spark: SparkSession, table_path: str) -> DataFrame:
    """(lga_code, week_start, volume, threat) with the deltas of all batches; weeks that were taken back to nothing are absent."""
    return versions.read(spark, table_path).where("volume <> 0")
