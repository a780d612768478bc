"""Training and scoring runs from a panel to stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, gate, metrics, model, scoring
from ..session import durable, gathered, one_wave
from .features import feature_columns


@dataclass
class TrainedRun:
    run_id: str
    model: model.RiskModel
    cuts: DataFrame
    comparison: DataFrame
    split: DataFrame
    coverage: DataFrame


def prepare(panel: DataFrame, train_end: str, valid_end: str, gate_sees_test: bool = False) -> tuple[DataFrame, list[str], DataFrame]:
    """Folded panel, features that pass the gate, and the gate table.

    By default the gate sees nothing after the validation fold.
    """
    folded = durable(gate.temporal_split(panel, train_end, valid_end))
    table = gate.feature_gate(gate.coverage(one_wave(folded), feature_columns(panel), train_end, until=None if gate_sees_test else valid_end))
    # One row per feature.
    kept = [r.feature for r in table.where("in_model").select("feature").collect()]
    return folded, [f for f in feature_columns(panel) if f in kept], table


def train_run(panel: DataFrame, run_id: str, train_end: str, valid_end: str, **settings) -> TrainedRun:
    folded, features, coverage = prepare(panel, train_end, valid_end)
    # In the pieces of the fits, few enough for all that follows.
    near = durable(model.fit_pieces(folded))
    gate.require_trainable(near)
    full = model.train(near, features, **settings)
    reduced_features = metrics.without_point_process(features)
    reduced = model.fit_booster(near, reduced_features, **settings) if reduced_features != features else full.booster
    valid = model.score(full, near.where("fold = 'valid'"))
    return TrainedRun(
        run_id, full, durable(scoring.tier_cut_points(valid)), model.compare(near, full, reduced, reduced_features), gate.describe_split(near), coverage
    )


class NothingToScore(ValueError):
    """The panel has no rows for the week."""


def score_week(run: TrainedRun, panel: DataFrame, week: str | None = None) -> DataFrame:
    """Every unit of one week (the last one by default) with probability, tier and ranks."""
    chosen = panel.agg(F.max("week_start")).first()[0] if week is None else week
    rows = gathered(panel.where(F.col("week_start") == F.lit(chosen).cast("date")))
    if rows.isEmpty():
        raise NothingToScore(str(chosen))
    tiered = scoring.assign_tiers(model.score(run.model, rows), run.cuts)
    return scoring.rank_units(tiered).withColumn("run_id", F.lit(run.run_id))


def week_drivers(run: TrainedRun, scored: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(top drivers per unit, global importance) of a scored week."""
    shares = explain.tree_attributions(run.model.booster, scored, run.model.features)
    return explain.top_drivers(shares, k).withColumn("run_id", F.lit(run.run_id)), explain.global_importance(shares)


def run_record(run: TrainedRun, created_at: str, version: str, train_end: str, horizon: int = 7, notes: str = "") -> DataFrame:
    """One model_runs row with the split and the comparison as JSON."""
    split = run.split.agg(F.array_sort(F.collect_list(F.struct("fold", "rows", "positives"))).alias("split"))
    table = run.comparison.agg(F.array_sort(F.collect_list(F.struct("model", "roc_auc", "average_precision", "brier"))).alias("comparison"))
    return split.crossJoin(table).select(
        F.lit(run.run_id).alias("run_id"), F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(version).alias("model_version"),
        F.lit(horizon).alias("horizon_days"), F.lit(train_end).cast("date").alias("train_end"),
        F.to_json(F.struct("split", "comparison")).alias("metrics"), F.lit(notes).alias("notes"),
    )
