"""Alert decisions with cooldown, blast-radius hold and an append-only audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TIERS
from .scoring import tier_rank

# Lowest tier that alerts, cooldown, largest share of units that may alert.
MINIMUM_TIER = "High"
COOLDOWN_DAYS = 7
MAX_ALERT_SHARE = 0.05


def last_sent(alerts: DataFrame, as_of: str, cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """Latest sent alert of each unit inside the cooldown that ends at ``as_of``."""
    now = F.lit(as_of).cast("timestamp")
    sent = alerts.where(
        (F.col("status") == "sent") & (F.col("dispatched_at") >= now - F.expr(f"interval {cooldown_days} days")) & (F.col("dispatched_at") <= now)
    )
    return sent.groupBy("lga_code").agg(
        F.max_by("risk_tier", F.struct("dispatched_at", tier_rank("risk_tier"))).alias("last_tier"), F.max("dispatched_at").alias("last_sent_at")
    )


def decide(predictions: DataFrame, alerts: DataFrame, as_of: str, minimum: str = MINIMUM_TIER, cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """One decision per unit at or above the minimum tier."""
    history = last_sent(alerts, as_of, cooldown_days)
    eligible = predictions.where(tier_rank("risk_tier") >= TIERS.index(minimum))
    joined = eligible.join(history, "lga_code", "left")
    repeat = F.col("last_tier").isNotNull() & (tier_rank("risk_tier") <= tier_rank("last_tier"))
    return joined.select(
        "lga_code", "lga_name", "state_name", "risk_tier", "probability",
        F.when(repeat, "suppress_cooldown").otherwise("send").alias("action"),
        F.when(repeat, F.concat(F.lit("already alerted at "), "last_tier", F.lit(" on "), F.date_format("last_sent_at", "yyyy-MM-dd")))
        .when(F.col("last_tier").isNotNull(), F.concat(F.lit("escalated from "), "last_tier", F.lit(" to "), "risk_tier"))
        .otherwise(F.concat(F.lit("first "), "risk_tier", F.lit(" alert within the cooldown window")))
        .alias("reason"),
    )


def hold_blast_radius(decisions: DataFrame, predictions: DataFrame, ceiling: float = MAX_ALERT_SHARE) -> DataFrame:
    """Hold every send when too large a share of all scored units would alert."""
    sends = decisions.agg(F.count_if(F.col("action") == "send").alias("_sends"))
    scored = predictions.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_scored"))
    # Two one-row aggregates.
    share = sends.crossJoin(scored).select((F.col("_sends") / F.col("_scored")).alias("_share"))
    held = (F.col("action") == "send") & (F.col("_share") > ceiling)
    return decisions.crossJoin(F.broadcast(share)).select(
        "lga_code", "lga_name", "state_name", "risk_tier", "probability",
        F.when(held, "held_blast_radius").otherwise(F.col("action")).alias("action"),
        F.when(held, F.format_string("held, %.0f%% of areas above threshold", F.col("_share") * 100)).otherwise(F.col("reason")).alias("reason"),
    )


def audit_rows(decisions: DataFrame, run_id: str, week_start: str, as_of: str, channel: str = "log", sent_status: str = "dry_run") -> DataFrame:
    """Audit records. The evaluation time is part of the key, so a re-run adds rows and never rewrites a sent one."""
    return decisions.select(
        F.concat_ws(":", F.lit(run_id), F.col("lga_code"), F.lit(as_of)).alias("alert_id"),
        F.lit(run_id).alias("run_id"), "lga_code", F.lit(week_start).cast("date").alias("week_start"), "risk_tier", "probability",
        F.lit(channel).alias("channel"),
        F.when(F.col("action") == "send", sent_status).otherwise("suppressed").alias("status"),
        F.lit(as_of).cast("timestamp").alias("dispatched_at"),
        F.to_json(F.struct(F.col("lga_name").alias("lga"), F.col("state_name").alias("state"), "action", "reason")).alias("payload"),
    )
