"""Secret scans with an incremental blob ledger.

Every version of a text is a blob named by the SHA-256 of its bytes. The ledger
holds, per blob and rule version, the spans found. A scan reads only blobs that the
ledger lacks for this rule version, commits what it found as one batch, and joins the
ledger back to every path and version that carries the blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


KINDS = ("assign", "access", "hex")
RULE_VERSION = "1"
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in code points, in that order.

    A match that is too short still takes up its characters: the next match of its
    kind starts after it.
    """
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[dict(zip(("start", "kind", "end"), s)) for s in find(text)] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, _SPAN_TYPE)], names=["blob", "spans"])


def _committed(spark: SparkSession, ledger: str) -> list[str]:
    """Folders of batches whose commit was completed."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/batch=*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(f.getPath().getParent().toString() for f in files or [])


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rule_version, spans) of all committed batches, one row per pair."""
    schema = f"blob string, rule_version string, spans {_SPANS}"
    batches = _committed(spark, ledger)
    return spark.read.schema(schema).parquet(*batches) if batches else spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Bring the ledger up to ``versions`` and return (path, blob, spans) per row of it.

    A null text is an empty blob. Repeated rows give repeated result rows but one
    scan. Rows with a null path keep it. An empty table commits nothing and gives no
    rows. A batch that was cut off before its commit is scanned again.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    known = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    # One carrier per blob, so that copies are not scanned; texts move only to meet it.
    unseen = named.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
    same = F.col("n.path").eqNullSafe(F.col("u.path")) & (F.col("n.blob") == F.col("u.blob"))
    carriers = named.alias("n").join(unseen.alias("u"), same, "left_semi")
    found = carriers.select("blob", "text").mapInArrow(_scan, f"blob string, spans {_SPANS}")
    batch = found.dropDuplicates(["blob"]).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    batch.write.parquet(f"{ledger}/batch={uuid.uuid4().hex}")
    ledger_rows = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob", "spans")
    return named.select("path", "blob").join(ledger_rows, "blob", "left")


def written(spans: Column, sep: str = ",") -> Column:
    """``kind:start:end`` of every span, by start and then by kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), sep
    )


def counted(spans: Column, kind: str) -> Column:
    place = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == place)).cast("long")
