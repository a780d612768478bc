"""Ranking and probability metrics over (model, week_start, unit, score, label) rows.

Every function works on the long form, so any number of models is measured in
one pass. Nothing collects a model's rows into one task: ranks inside a week are
top-k filters, curve metrics first collapse to distinct scores and then use
range-partitioned running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import rank_in_group, running_totals, top_in_group

# List sizes of the headline table and of the coverage curve.
HEADLINE_K = (10, 20, 50)
COVERAGE_BUDGETS = (5, 10, 15, 20, 30, 40, 50, 75, 100, 150, 200)


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("lga_code")]


def top_k_in_week(scored: DataFrame, k: int) -> DataFrame:
    return top_in_group(scored, ["model", "week_start"], best_first(), k)


def weekly_hits(scored: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per model, week and k: rows, positives, hits and list length."""
    sizes = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    weeks = scored.groupBy("model", "week_start").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))
    top = top_k_in_week(scored, max(ks)).select("model", "week_start", "rank", "label", sizes).where(F.col("rank") <= F.col("k"))
    hits = top.groupBy("model", "week_start", "k").agg(F.count(F.lit(1)).alias("listed"), F.sum("label").alias("hits"))
    return hits.join(weeks, ["model", "week_start"])


def at_k(scored: DataFrame, ks: Sequence[int] = HEADLINE_K) -> DataFrame:
    """Precision, recall and lift at k: per week, then averaged over weeks.

    Recall and lift leave out weeks without a positive.
    """
    precision = F.col("hits") / F.col("listed")
    base = F.col("positives") / F.col("rows")
    some = F.col("positives") > 0
    return weekly_hits(scored, ks).groupBy("model", "k").agg(
        F.avg(precision).alias("precision"),
        F.avg(F.when(some, F.col("hits") / F.col("positives"))).alias("recall"),
        F.avg(F.when(some, precision / base)).alias("lift"),
    )


def coverage_curve(scored: DataFrame, budgets: Sequence[int] = COVERAGE_BUDGETS) -> DataFrame:
    return at_k(scored, budgets).select("model", "k", "recall")


def weekly_capture(scored: DataFrame, k: int = 20) -> DataFrame:
    """Per week: positives and how many the top ``k`` held."""
    return weekly_hits(scored, (k,)).select("model", "week_start", F.col("positives").alias("attacked"), F.col("hits").alias("caught"))


def missed_weeks(scored: DataFrame, k: int = 20) -> DataFrame:
    return weekly_capture(scored, k).groupBy("model").agg(
        F.count(F.lit(1)).alias("weeks"), F.count_if(F.col("caught") == 0).alias("weeks_without_hit")
    )


def score_curve(scored: DataFrame) -> DataFrame:
    """One row per model and distinct score, with running counts from the top."""
    points = scored.groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("pos"))
    return running_totals(points, ["model"], [F.desc("score")], {"n": "cum_n", "pos": "cum_pos"})


def curve_metrics(scored: DataFrame) -> DataFrame:
    """ROC AUC (ties count half) and step-wise average precision per model.

    AUC is null with one class only, average precision without a positive.
    """
    curve = score_curve(scored)
    totals = scored.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"))
    neg_here = F.col("n") - F.col("pos")
    neg_below = (F.col("rows") - F.col("positives")) - (F.col("cum_n") - F.col("cum_pos"))
    pairs = F.sum(F.col("pos") * (neg_below + neg_here / 2))
    step = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    summed = curve.join(totals, "model").groupBy("model", "rows", "positives").agg(pairs.alias("won"), step.alias("ap"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    return summed.select(
        "model", "rows", "positives",
        F.when(both, F.col("won") / (F.col("positives") * (F.col("rows") - F.col("positives")))).alias("roc_auc"),
        F.when(F.col("positives") > 0, F.col("ap") / F.col("positives")).alias("average_precision"),
    )


def clipped(score="score") -> Column:
    return F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0))


def brier(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model").agg(
        F.when(F.sum("label") > 0, F.avg(F.pow(clipped() - F.col("label"), F.lit(2)))).alias("brier")
    )


def with_bucket(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-count bucket of the first-come rank by score, 0 to bins - 1."""
    ranked = rank_in_group(scored, ["model"], [F.asc("score"), F.asc("week_start"), F.asc("lga_code")], "_r")
    sizes = scored.groupBy("model").agg(F.count(F.lit(1)).alias("_n"))
    spot = F.ceil((F.col("_r") - 1) * bins / F.greatest(F.col("_n") - 1, F.lit(1))) - 1
    return ranked.join(sizes, "model").withColumn("bucket", F.greatest(spot, F.lit(0)).cast("long")).drop("_r", "_n")


def calibration_table(scored: DataFrame, bins: int = 10) -> DataFrame:
    return (
        with_bucket(scored.withColumn("score", clipped()), bins)
        .groupBy("model", "bucket")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("predicted"), F.avg("label").alias("observed"))
        .withColumn("gap", F.col("observed") - F.col("predicted"))
    )


def evaluate(scored: DataFrame, ks: Sequence[int] = HEADLINE_K) -> DataFrame:
    """The comparison table: one row per model with every metric."""
    table = curve_metrics(scored).join(brier(scored), "model")
    measures = ("precision", "recall", "lift")
    wide = at_k(scored, ks).groupBy("model").agg(
        *[F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_at_{k}") for k in ks for m in measures]
    )
    return table.join(wide, "model")


def baseline_scores(panel: DataFrame, models: dict[str, str]) -> DataFrame:
    """Long form of score columns already in the panel, ``{model name: column}``; each must be there."""
    if absent := sorted(set(models.values()) - set(panel.columns)):
        raise ValueError(f"score columns are not in the panel: {', '.join(absent)}")
    entries = [F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in models.items()]
    return panel.select("lga_code", "week_start", "label", F.explode(F.array(*entries)).alias("s")).select(
        "s.model", "week_start", "lga_code", "s.score", "label"
    )


# The model-free scores and the column each one reads.
BASELINES = {"persistence": "own_events_1w", "historical_rate": "own_events_52w", "point_process": "hawkes_prob_any"}


def without_point_process(features: Sequence[str]) -> list[str]:
    return [f for f in features if not f.startswith("hawkes_")]
