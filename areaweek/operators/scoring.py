"""Tier cut points, tiers, ranks and run records for scored units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TIERS
from .ranking import exact_quantiles, rank_in_group

# Validation quantiles that open each tier, and the share of the raw
# score added to break ties inside a calibrated step.
TIER_QUANTILES = {"Elevated": 0.90, "High": 0.98, "Severe": 0.995}
TIE_BREAK = 1e-6


def tier_cut_points(scored: DataFrame, column: str = "probability") -> DataFrame:
    """One row with the cut point of each tier above the lowest."""
    q = exact_quantiles(scored, column, list(TIER_QUANTILES.values()), "cut")
    return q.agg(*[F.max(F.when(F.col("point") == F.lit(p), F.col("cut"))).alias(t) for t, p in TIER_QUANTILES.items()])


def tier_for(probability: Column, cuts: dict[str, Column]) -> Column:
    out = F.lit(TIERS[0])
    for tier in TIERS[1:]:
        out = F.when(probability >= cuts[tier], tier).otherwise(out)
    return out


def assign_tiers(scored: DataFrame, cuts: DataFrame, column: str = "probability") -> DataFrame:
    """Add ``risk_tier``; ``cuts`` is the single row from ``tier_cut_points``."""
    named = cuts.select(*[F.col(t).alias(f"_cut_{t}") for t in TIERS[1:]])
    return (
        scored.crossJoin(F.broadcast(named))
        .withColumn("risk_tier", tier_for(F.col(column), {t: F.col(f"_cut_{t}") for t in TIERS[1:]}))
        .drop(*[f"_cut_{t}" for t in TIERS[1:]])
    )


def tier_rank(column: str | Column) -> Column:
    """0 to 3; an unknown tier counts as the lowest."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(0)
    for i, tier in enumerate(TIERS):
        out = F.when(c == tier, i).otherwise(out)
    return out


def rank_units(scored: DataFrame, week: Sequence[str] = ("week_start",)) -> DataFrame:
    """National and state rank by probability, ties by unit code."""
    order = [F.desc("probability"), F.asc("lga_code")]
    national = rank_in_group(scored, list(week), order, "rank_national")
    return rank_in_group(national, [*week, "state_name"], [F.asc("rank_national")], "rank_state")


def calibrated(step_value: Column, raw: Column) -> Column:
    """Calibrated probability that keeps the raw order inside each step."""
    return F.greatest(F.least(step_value + F.lit(TIE_BREAK) * raw, F.lit(1.0)), F.lit(0.0))


def latest_run(model_runs: DataFrame) -> DataFrame:
    """One row: the id of the run created last."""
    return model_runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def of_latest_run(table: DataFrame, model_runs: DataFrame) -> DataFrame:
    return table.join(F.broadcast(latest_run(model_runs)), "run_id")


def tier_counts(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Units per tier as columns, zero where a tier is empty, and the total."""
    return predictions.groupBy(*by).agg(
        *[F.count_if(F.col("risk_tier") == t).alias(f"n_{t.lower()}") for t in TIERS], F.count(F.lit(1)).alias("n_scored")
    )
