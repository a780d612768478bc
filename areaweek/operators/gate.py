"""Temporal split, split guard and the train/serve feature gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURE_LABELS

# Fewest positives per fold, coverage floor, skew factor, recent weeks.
MIN_POSITIVES = {"train": 200, "valid": 20, "test": 20}
COVERAGE_FLOOR = 0.01
SKEW_FACTOR = 5
RECENT_WEEKS = 26


def temporal_split(panel: DataFrame, train_end: str, valid_end: str) -> DataFrame:
    week = F.col("week_start")
    return panel.withColumn(
        "fold",
        F.when(week <= F.lit(train_end).cast("date"), "train").when(week <= F.lit(valid_end).cast("date"), "valid").otherwise("test"),
    )


def describe_split(folded: DataFrame) -> DataFrame:
    return folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"),
        F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"),
    )


def split_check(folded: DataFrame) -> DataFrame:
    """One row per fold, also for empty folds, with the minimum it has to reach."""
    minimums = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(n).cast("long").alias("minimum")) for f, n in MIN_POSITIVES.items()]))
    wanted = folded.sparkSession.range(1).select(minimums.alias("m")).select("m.*")
    seen = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"))
    return wanted.join(seen, "fold", "left").select(
        "fold", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("positives", F.lit(0)).alias("positives"), "minimum",
        (F.coalesce("positives", F.lit(0)) >= F.col("minimum")).alias("enough"),
    )


class SplitTooThin(ValueError):
    """The panel cannot support training."""


def require_trainable(folded: DataFrame) -> None:
    """Raise when a fold is empty or has too few positive weeks."""
    problems = [
        f"the {r.fold} fold is empty" if r.rows == 0 else f"the {r.fold} fold has {r.positives} positive weeks, below {r.minimum}"
        for r in sorted(split_check(folded).collect())
        if not r.enough
    ]
    if problems:
        raise SplitTooThin("cannot train: " + "; ".join(problems) + ". Backfill events so that they cover the panel period.")


def coverage(panel: DataFrame, features: Sequence[str], train_end: str, recent_weeks: int = RECENT_WEEKS, until: str | None = None) -> DataFrame:
    """Per feature: share non-zero in training, share non-zero lately, spread.

    With ``until`` the gate sees no week after it, so the test fold stays unseen.
    One pass over the panel computes every feature.
    """
    seen = panel if until is None else panel.where(F.col("week_start") <= F.lit(until).cast("date"))
    week = F.col("week_start")
    # One row: the last week.
    marked = seen.crossJoin(F.broadcast(seen.agg(F.max("week_start").alias("_last"))))
    training = week <= F.lit(train_end).cast("date")
    recent = week > F.date_sub("_last", 7 * recent_weeks)
    aggregates = []
    for f in features:
        hit = F.when(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) != 0, 1.0).otherwise(0.0)
        aggregates += [
            F.avg(F.when(training, hit)).alias(f"t_{f}"), F.avg(F.when(recent, hit)).alias(f"r_{f}"), F.stddev_samp(F.col(f).cast("double")).alias(f"s_{f}")
        ]
    rows = [
        F.struct(F.lit(f).alias("feature"), F.lit(FEATURE_LABELS.get(f, f)).alias("label"), F.col(f"t_{f}").alias("train_coverage"),
                 F.col(f"r_{f}").alias("recent_coverage"), F.col(f"s_{f}").alias("spread"))
        for f in features
    ]
    return marked.agg(*aggregates).select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def feature_gate(table: DataFrame) -> DataFrame:
    """Drop features that never vary or that appear only after training ended."""
    constant = F.coalesce("spread", F.lit(0.0)) == 0
    skewed = (F.col("train_coverage") < COVERAGE_FLOOR) & (F.col("recent_coverage") > SKEW_FACTOR * F.col("train_coverage"))
    return table.select(
        "feature", "label", "train_coverage", "recent_coverage", (~(constant | skewed)).alias("in_model"),
        F.when(constant, "constant").when(skewed, "train-serve skew").otherwise("").alias("excluded_because"),
    )
