"""Corpus pipeline: from documents to packed token ids, each stage one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. All but the last return the columns of ``docs``. Extra columns pass through, an
empty table stays empty, and null texts and empty texts go through unchanged up to the
mix, which draws no text without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweek.llm import bpe, jaccard, lines, mixing, toxicity
from areaweek.llm.common import stored, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut stay. The scorer learns from the labelled ones that are not held out."""
    scorer = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return scorer.score(docs, F.col("text"), docs.columns).where(F.col("score") < toxicity.CUT).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing but white space is left goes too."""
    done = lines.dedup(docs)
    left = done.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    changed = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("doc.n_chars")).otherwise(F.length("kept"))}
    return left.select(*[changed[c].cast(kind).alias(c) if c in changed else F.col(f"doc.`{c}`").alias(c) for c, kind in docs.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays; null ids come last.

    Rows with equal id and text are one document. Rows that share an id but not the
    text are documents of their own, and both stay unless they are linked.
    """
    known = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("key"), F.struct("*").alias("doc"))
    found = jaccard.join(known.select("key", F.col("doc.text").alias("text")), "key").select(F.col("id").alias("key"), "component").distinct()
    ids = known.select("key", F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), "key").alias("rank")).distinct()
    first = found.join(ids, "key").groupBy("component").agg(F.min_by("key", "rank").alias("key")).select("key")
    return known.join(first, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix draws them, in the order of its shards."""
    draws, rows = mixing.mix(docs, block_words=None)
    keyed = docs.select(mixing.row_key().alias("key"), F.struct("*").alias("doc")).dropDuplicates(["key"])
    drawn = draws.join(rows.select("row_id", "key"), "row_id").select("key", "shard", "place")
    return keyed.join(drawn, "key").repartition("shard").sortWithinPartitions("shard", "place").select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per drawn document, packed as unsigned 32-bit integers, and whether they decode to its text."""
    ids = docs.select("doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("mark"), bpe.round_trip(F.col("text")).alias("both"))
    ids = ids.select("doc_id", "source", "lang", "mark", "both.*")
    return ids.select("doc_id", "source", "lang", bpe.count(F.col("ids")).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("mark")).alias("exact"))


STAGES = [("toxicity", toxicity_filter), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Trees, a seeded mix and byte-pair merges are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
