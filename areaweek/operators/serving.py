"""Reads that dashboards and services ask for."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TARGET_CLASS
from .ranking import top_in_group
from .scoring import of_latest_run

REGISTRY_COLUMNS = ("lga_name", "state_name", "zone", "centre_lat", "centre_lon")


def latest_predictions(predictions: DataFrame, registry: DataFrame, model_runs: DataFrame) -> DataFrame:
    """Predictions of the last run with the unit attributes."""
    return of_latest_run(predictions, model_runs).join(registry.select("lga_code", *REGISTRY_COLUMNS), "lga_code").select(
        "run_id", "lga_code", *REGISTRY_COLUMNS, "week_start", "probability", "risk_tier", "rank_national", "rank_state"
    )


def filtered(predictions: DataFrame, state: str | None = None, tier: str | None = None) -> DataFrame:
    """Case-blind state and tier filters."""
    keep: Column = F.lit(True)
    if state:
        keep = keep & (F.lower("state_name") == state.lower())
    if tier:
        keep = keep & (F.lower("risk_tier") == tier.lower())
    return predictions.where(keep)


def ranked_list(predictions: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` units by probability (each task keeps its own top rows)."""
    return predictions.orderBy(F.desc("probability"), F.asc("lga_code")).limit(limit)


def counted_list(predictions: DataFrame, limit: int, state: str | None = None, tier: str | None = None) -> DataFrame:
    """Ranked list with the number of matches before the limit on every row."""
    matches = filtered(predictions, state, tier)
    total = matches.agg(F.count(F.lit(1)).alias("matches"))
    return ranked_list(matches, limit).crossJoin(F.broadcast(total))


def on_boundaries(boundaries: DataFrame, predictions: DataFrame, state: str | None = None, default_tier: str = "Unscored") -> DataFrame:
    """Every boundary with its score; unscored units keep their row."""
    kept = boundaries if state is None else boundaries.where(F.lower("state_name") == state.lower())
    scores = predictions.select("lga_code", "probability", "risk_tier", "rank_national")
    return kept.join(scores, "lga_code", "left").withColumn("risk_tier", F.coalesce("risk_tier", F.lit(default_tier)))


def recent_incidents(incidents: DataFrame, k: int = 12) -> DataFrame:
    """The last ``k`` target events of every unit."""
    target = incidents.where((F.col("event_class") == TARGET_CLASS) & F.col("lga_code").isNotNull())
    return top_in_group(target, ["lga_code"], [F.desc("event_date"), F.asc("event_id")], k, "recent_rank")


def unit_drivers(drivers: DataFrame, model_runs: DataFrame, lga_code: str | None = None) -> DataFrame:
    latest = of_latest_run(drivers, model_runs)
    return latest if lga_code is None else latest.where(F.col("lga_code") == lga_code)


def latest_brief(briefs: DataFrame) -> DataFrame:
    """The brief generated last in every scope."""
    return top_in_group(briefs, ["scope"], [F.desc("generated_at"), F.asc("brief_id")], 1, "_r").drop("_r")


def serving_incidents(incidents: DataFrame) -> DataFrame:
    """Located target events with the nine served columns."""
    return incidents.where((F.col("event_class") == TARGET_CLASS) & F.col("lga_code").isNotNull()).select(
        "event_id", "lga_code", "event_date", "event_class", "event_type", "actor_primary", "actor_secondary", "fatalities", "headline"
    )


# The served tables; the keys that their readers filter and sort by.
SERVED = {
    "lga_registry": ("lga_code",),
    "model_runs": ("run_id",),
    "predictions": ("run_id", "-probability"),
    "prediction_drivers": ("run_id", "lga_code"),
    "threat_actor_edges": ("run_id", "target_kind", "target"),
    "security_briefs": ("brief_id",),
    "incidents": ("lga_code", "-event_date"),
}


def serving_extract(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the served tables below ``folder``: six whole ones, and the located target events. Returns their paths.

    Rows are dealt by ranges of the keys that readers ask by and sorted in each file,
    so a read for one run or unit opens few files and row groups.
    """
    absent = set(SERVED) - set(tables)
    if absent:
        raise ValueError(f"no table {', '.join(sorted(absent))}")
    paths = {}
    for name, keys in SERVED.items():
        frame = serving_incidents(tables[name]) if name == "incidents" else tables[name]
        order = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys]
        paths[name] = os.path.join(folder, name)
        frame.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(paths[name])
    return paths


def register_views(tables: dict[str, DataFrame]) -> None:
    """Name the stored tables so that the same reads can be written as SQL."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
