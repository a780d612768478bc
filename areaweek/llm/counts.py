"""Token counts as rollups that signed deltas maintain.

A change inserts, revises or deletes one document. A commit looks up what the rollup
holds for the document, adds the new counts and takes off the old ones, and writes
both the entries and the additive deltas as one batch under its own identifier. A
batch that is already committed is left as it is, so a commit can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaweek.llm import bpe
from areaweek.llm.common import WORD

#: Tokenizer version -> tokens of a text column.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(WORD)).cast("long"),
    "byte_bpe_multi_50k": lambda text: bpe.count(bpe.encode(text)),
}
_ENTRIES = "id string, source string, lang string, tokenizer string, tokens long, alive boolean, seq long"
_DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"


def _committed(spark: SparkSession, root: str, kind: str) -> list[str]:
    """Folders of the batches whose deltas are complete, which are written last."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/deltas/*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return [f"{root}/{kind}/{f.getPath().getParent().getName()}" for f in files or []]


def _read(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    folders = _committed(spark, root, kind)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def commit(changes: DataFrame, root: str, batch: str, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS) -> bool:
    """Apply ``changes`` (op, id, text, source, lang, seq) once; False if ``batch`` is already in.

    ``op`` is 'put' (insert or revise) or 'delete'; null counts as 'put'. Of several
    changes of one id the one with the largest ``seq`` holds, and a change with a
    smaller ``seq`` than the held one is passed over. At equal ``seq`` the larger row
    (op, source, lang, text) holds, so repeated rows count once. A null id is an id of
    its own; null sources and languages are groups of their own; a null text has no
    tokens. Deleting an unknown id changes nothing. An empty batch is committed.
    """
    spark = changes.sparkSession
    if f"{root}/deltas/{batch}" in _committed(spark, root, "deltas"):
        return False
    rows = changes.select(
        F.col("id").cast("string").alias("id"), F.coalesce(F.col("op"), F.lit("put")).alias("op"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("mark", F.xxhash64("text"))
    counted = rows.select("id", "op", "seq", "source", "lang", "mark", *[f(F.col("text")).cast("long").alias(f"t{i}") for i, f in enumerate(tokenizers.values())])
    latest = counted.groupBy("id").agg(F.max_by(F.struct("*"), F.struct("seq", "op", "source", "lang", "mark")).alias("new")).select("new.*")
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"t{i}").alias("tokens")) for i, name in enumerate(tokenizers)])
    fresh = latest.select("id", "source", "lang", F.inline(each), (F.col("op") != "delete").alias("alive"), "seq").select(*_names(_ENTRIES))

    newest = Window.partitionBy("id", "tokenizer").orderBy(F.col("seq").desc())
    held = _read(spark, root, "entries", _ENTRIES)
    touched = held.alias("h").join(
        latest.select(F.col("id").alias("touched")).alias("l"), F.col("h.id").eqNullSafe(F.col("l.touched")), "left_semi"
    )
    held = touched.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
    joined = fresh.alias("f").join(held.alias("h"), F.col("f.id").eqNullSafe(F.col("h.id")) & (F.col("f.tokenizer") == F.col("h.tokenizer")), "left")
    joined = joined.where("h.seq is null or f.seq > h.seq")
    entries = joined.select("f.*", *[F.col(f"h.{c}").alias(f"old_{c}") for c in ("source", "lang", "tokens", "alive")])
    path = f"{root}/entries/{batch}"
    entries.write.mode("overwrite").parquet(path)

    entries = spark.read.parquet(path)
    plus = entries.where("alive").select("source", "lang", "tokenizer", F.lit(1).alias("sign"), "tokens")
    minus = entries.where("old_alive").select(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer", F.lit(-1).alias("sign"), F.col("old_tokens").alias("tokens"))
    deltas = plus.unionByName(minus).groupBy("source", "lang", "tokenizer").agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
    deltas.write.mode("overwrite").parquet(f"{root}/deltas/{batch}")
    return True


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def totals(spark: SparkSession, root: str) -> DataFrame:
    """(source, lang, tokenizer, documents, tokens) of all committed batches; empty groups are left out."""
    summed = _read(spark, root, "deltas", _DELTAS).groupBy("source", "lang", "tokenizer").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return summed.where("documents != 0")
