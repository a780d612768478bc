"""Exact ranks and running totals over groups of any size.

A plain ``row_number()`` over one big group sends that group to one task. Here
rows are range-partitioned on the whole sort key, so a group (or a run of equal
scores broken only by the tie key) is spread over many tasks; the per-partition
sizes give each partition its offset. The ranged rows are made durable first, so
the sizes and the rows always come from the same layout, also after a lost
executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

_POSITION_BITS = 33


def row_index(df: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of every row in the total order."""
    ranged = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _POSITION_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so this window is bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_at", "_part", "_offset")
    )


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the 1-based rank of every row inside its group, ties broken by ``order``."""
    indexed = row_index(df, [*(F.col(g) for g in group), *order], "_index")
    if not group:
        return indexed.withColumn(name, F.col("_index") + 1).drop("_index")
    first = indexed.groupBy(*group).agg(F.min("_index").alias("_first"))
    return indexed.join(first, list(group)).withColumn(name, F.col("_index") - F.col("_first") + 1).drop("_index", "_first")


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Add inclusive running sums ``{source column: new column}`` per group in ``order``."""
    keys = [F.col(g) for g in group]
    ranged = durable(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    scope = [*group, "_part"]
    totals = ranged.groupBy(*scope).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*scope, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in sums])
    return local.join(offsets, scope).select(
        *df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(out) for c, out in sums.items()]
    )


def top_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    The rank filter lets Spark keep only ``k`` rows per group in every input
    task before the shuffle, so a hot group never travels whole.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def exact_quantiles(df: DataFrame, value: str, points: Sequence[float], name: str = "quantile") -> DataFrame:
    """Quantiles with linear interpolation, one row per point.

    Only the two rows around each position leave the sorted frame.
    """
    clean = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    indexed = row_index(clean, [F.asc("_v")], "_i")
    size = indexed.agg(F.count(F.lit(1)).alias("_n"))
    spots = size.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("point"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("_pos")) for q in points])).alias("s")).select(
        "s.point", "s._pos", F.explode(F.array_distinct(F.array(F.floor("s._pos"), F.ceil("s._pos")))).alias("_i")
    )
    # Two rows per requested point.
    found = indexed.join(F.broadcast(spots), "_i")
    share = F.col("_pos") - F.floor("_pos")
    low = F.min_by("_v", "_i")
    high = F.max_by("_v", "_i")
    return found.groupBy("point").agg((low + F.max(share) * (high - low)).alias(name))
