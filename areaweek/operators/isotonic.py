"""Isotonic regression by pooling adjacent violators over ranges of scores.

Points become blocks, which are pooled inside ranges of a bounded number of blocks;
only the summaries (ends, sum and weight) go on. The next round cuts the ranges half a
range further on, so what was a border lies inside. Pooling does not depend on its order, so
once neither way of cutting pools anything the blocks are those of the plain fit. No
task and no step holds more than one range of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ranking import row_index

RANGE_BLOCKS = 100_000
_BLOCK = "low double, high double, total double, weight double"


def _pool(table: pa.Table) -> pa.Table:
    """Blocks of one range, pooled until their means rise strictly."""
    rows = np.stack([table[c].to_numpy() for c in ("low", "high", "total", "weight")], axis=1)
    done: list[list[float]] = []
    for low, high, total, weight in rows[np.argsort(rows[:, 0], kind="stable")].tolist():
        while done and done[-1][2] * weight >= total * done[-1][3]:
            before = done.pop()
            low, total, weight = before[0], before[2] + total, before[3] + weight
        done.append([low, high, total, weight])
    columns = np.array(done).T if done else np.empty((4, 0))
    return pa.table(dict(zip(("low", "high", "total", "weight"), map(pa.array, columns), strict=True)))


def pooled(points: DataFrame, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """(low, high, mean, weight): the steps of the isotonic fit of ``points`` (feature, label, weight).

    Scores are distinct and weights above 0. Steps with equal means are one.
    """
    blocks = durable(points.select(F.col("feature").alias("low"), F.col("feature").alias("high"), (F.col("label") * F.col("weight")).alias("total"), "weight"))
    n, quiet, shift = blocks.count(), 0, 0
    while quiet < 2:
        ranged = row_index(blocks, [F.asc("low")], "_place")
        blocks = durable(ranged.groupBy(F.expr(f"(_place + {shift}) div {range_blocks}")).applyInArrow(lambda _, t: _pool(t), _BLOCK))
        left = blocks.count()
        if shift == 0 and n <= range_blocks:
            break
        quiet = quiet + 1 if left == n else 0
        n, shift = left, range_blocks // 2 - shift
        shift = 0 if n <= range_blocks else shift
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("mean"), "weight")


def step_ends(steps: DataFrame) -> DataFrame:
    """(feature, label, weight): the two ends of every step, one where they agree; a plain fit of these rows gives back the steps."""
    ends = F.array_distinct(F.array("low", "high"))
    return steps.select(F.explode(ends).alias("feature"), F.col("mean").alias("label"), (F.col("weight") / F.size(ends)).alias("weight"))
