"""Stored tables as append-only parts under a numbered manifest.

A write adds one folder of rows and then one small manifest that lists every part of
the table; the manifest with the highest number is the table. A writer that stops
before the manifest leaves a folder that nobody reads, and no reader ever sees half a
batch. Nothing that is listed is overwritten.

Parts are merged when read. Tables of records keep the row with the highest ``order``
columns of each key, later batches winning ties, so an older row over a newer one
changes nothing. Tables of totals add up their measures. Once more than
``COMPACT_AFTER`` parts have come together they are written as one. One
writer at a time may commit to a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import top_in_group

SEQ = "_seq"
COMPACT_AFTER = 16
_MEASURES = {"sum": F.sum, "max": F.max, "min": F.min}


class _Folder:
    """The manifests of one table, in whatever store Spark reaches it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.new_path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.new_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self.new_path(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self) -> dict | None:
        numbers = self.numbers()
        if not numbers:
            return None
        stream = self.files.open(self.new_path(f"{self.path}/_manifests/{numbers[-1]:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes())) | {"number": numbers[-1]}
        finally:
            stream.close()

    def swap(self, manifest: dict, number: int) -> None:
        """The new manifest appears whole, by a rename, or not at all."""
        target = self.new_path(f"{self.path}/_manifests/{number:010d}.json")
        draft = self.new_path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self.files.exists(target) or not self.files.rename(draft, target):
            raise RuntimeError(f"another writer has committed to {self.path}")


def is_versioned(spark: SparkSession, path: str) -> bool:
    return bool(_Folder(spark, path).numbers())


def _merged(rows: DataFrame, manifest: dict) -> DataFrame:
    """Parts of a table as one row per key, with the sequence number of the row that won."""
    key = manifest["key"]
    if manifest["measures"]:
        return rows.groupBy(*key).agg(*[_MEASURES[how](c).alias(c) for c, how in manifest["measures"].items()], F.max(SEQ).alias(SEQ))
    settled = F.desc(F.xxhash64(*[c for c in rows.columns if c != SEQ]))
    return top_in_group(rows, key, [*(F.desc(c) for c in manifest["order"]), F.desc(SEQ), settled], 1, "_place").drop("_place")


def _current(folder: _Folder, manifest: dict) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    stored = T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])
    read = lambda parts: folder.spark.read.schema(stored).parquet(*[f"{folder.path}/{p['folder']}" for p in parts])
    whole, new = ([p for p in manifest["parts"] if p["unique"] == u] for u in (True, False))
    if not new:
        return read(whole)
    if not whole:
        return _merged(read(new), manifest)
    # Only keys that the new parts hold are merged; the others stay where they are.
    base, keys = read(whole), read(new).select(*manifest["key"]).distinct()
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}")) for c in manifest["key"]]
    touched = base.alias("b").join(keys.alias("k"), same, "left_semi")
    return base.alias("b").join(keys.alias("k"), same, "left_anti").unionByName(_merged(read(new).unionByName(touched), manifest))


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table as the newest manifest has it."""
    folder = _Folder(spark, path)
    manifest = folder.read()
    names = schema.names if schema else T.StructType.fromJson(manifest["schema"]).names
    return _current(folder, manifest).select(*names)


def append(
    spark: SparkSession, path: str, rows: DataFrame, key: Sequence[str], order: Sequence[str] = (), measures: dict[str, str] | None = None,
    batch: tuple[str, int] | None = None, compact_after: int = COMPACT_AFTER,
) -> bool:
    """Add a batch; False if this writer has already committed ``batch``, (writer, number), or a later one.

    The key, order, measures and columns of a table are those of its first batch.
    The rows are written as they come, without a shuffle.
    """
    folder = _Folder(spark, path)
    old = folder.read()
    if old and batch and batch[1] <= old["writers"].get(batch[0], -1):
        return False
    manifest = old or {
        "key": list(key), "order": [c for c in order if c in rows.columns], "measures": measures or {}, "schema": rows.schema.jsonValue(), "parts": [], "writers": {}, "number": 0,
    }
    number = manifest.pop("number") + 1
    schema = T.StructType.fromJson(manifest["schema"])
    part = f"part-{number:010d}-{uuid.uuid4().hex}"
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], F.lit(number).cast("long").alias(SEQ)).write.parquet(f"{folder.path}/{part}")
    manifest["parts"] = [*manifest["parts"], {"folder": part, "unique": False}]
    if batch:
        manifest["writers"] = manifest["writers"] | {batch[0]: batch[1]}
    folder.swap(manifest, number)
    if sum(not p["unique"] for p in manifest["parts"]) > compact_after:
        compact(spark, path)
    return True


def compact(spark: SparkSession, path: str) -> None:
    """Write the table as one part with one row per key; readers of older manifests keep their parts."""
    folder = _Folder(spark, path)
    manifest = folder.read()
    number = manifest.pop("number") + 1
    part = f"part-{number:010d}-{uuid.uuid4().hex}"
    _current(folder, manifest).write.parquet(f"{folder.path}/{part}")
    folder.swap(manifest | {"parts": [{"folder": part, "unique": True}]}, number)


def expire(spark: SparkSession, path: str) -> None:
    """Remove parts and manifests that the newest manifest does not need; for when nobody reads older ones or writes."""
    folder = _Folder(spark, path)
    manifest = folder.read()
    keep = {p["folder"] for p in manifest["parts"]}
    for found in folder.files.listStatus(folder.new_path(folder.path)):
        if found.getPath().getName().startswith("part-") and found.getPath().getName() not in keep:
            folder.files.delete(found.getPath(), True)
    for number in folder.numbers():
        if number < manifest["number"]:
            folder.files.delete(folder.new_path(f"{folder.path}/_manifests/{number:010d}.json"), False)
