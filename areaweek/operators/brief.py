"""Briefing tables: per-scope entries, context documents and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TIERS
from . import actors as act
from .explain import sentences
from .ranking import top_in_group

NATIONAL = "national"
TOP_UNITS = 10
TOP_ACTORS = 3


def with_movement(predictions: DataFrame, previous: DataFrame) -> DataFrame:
    """Places gained since the previous run, null for units it did not rank."""
    before = previous.select("lga_code", F.col("rank_national").alias("_before"))
    return predictions.join(before, "lga_code", "left").withColumn("rank_change", F.col("_before") - F.col("rank_national")).drop("_before")


def scoped_top(predictions: DataFrame, n: int = TOP_UNITS) -> DataFrame:
    """Top units of the country and of every state, one row per scope and position."""
    both = predictions.withColumn("scope", F.explode(F.array(F.lit(NATIONAL), F.col("state_name"))))
    return top_in_group(both, ["scope"], [F.desc("probability"), F.asc("lga_code")], n, "position")


def entries(predictions: DataFrame, previous: DataFrame, drivers: DataFrame, edges: DataFrame, n: int = TOP_UNITS) -> DataFrame:
    """Everything a brief may say about each listed unit.

    Drivers and actors are cut to the few listed rows before they are gathered.
    """
    top = with_movement(scoped_top(predictions, n), previous)
    listed = top.select("lga_code").distinct()
    lines = (
        sentences(drivers.join(listed, "lga_code", "left_semi"))
        .groupBy("lga_code")
        .agg(F.array_sort(F.collect_list(F.struct("driver_rank", "sentence"))).alias("d"))
        .select("lga_code", F.col("d.sentence").alias("drivers"))
    )
    named = act.top_actors(edges.join(listed.withColumnRenamed("lga_code", "target"), "target", "left_semi"), "lga", TOP_ACTORS)
    groups = (
        named.groupBy(F.col("target").alias("lga_code"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "actor", "events", "last_seen"))).alias("a"))
        .select("lga_code", F.transform("a", lambda x: F.struct(x["actor"].alias("actor"), x["events"].alias("events"), x["last_seen"].alias("last_seen"))).alias("actors"))
    )
    return top.join(lines, "lga_code", "left").join(groups, "lga_code", "left").select(
        "scope", "position", "lga_code", "lga_name", "state_name", F.round("probability", 4).alias("probability"),
        "risk_tier", "rank_national", "rank_change",
        F.coalesce("drivers", F.array().cast("array<string>")).alias("drivers"),
        F.coalesce("actors", F.array().cast("array<struct<actor:string,events:bigint,last_seen:date>>")).alias("actors"),
    )


def contexts(entry_rows: DataFrame, predictions: DataFrame, week_start: str) -> DataFrame:
    """One JSON document per scope; each gathers at most the listed units."""
    counts = predictions.agg(
        F.count(F.lit(1)).alias("lgas_scored"), *[F.count_if(F.col("risk_tier") == t).alias(t) for t in TIERS]
    ).select("lgas_scored", F.struct(*TIERS).alias("tier_counts"))
    entry = F.struct(
        "position", F.col("lga_name").alias("lga"), F.col("state_name").alias("state"), "probability", F.col("risk_tier").alias("tier"),
        F.col("rank_national").alias("national_rank"), F.col("rank_change").alias("rank_change_since_last_week"), "drivers",
        F.col("actors").alias("actors_recorded_here"),
    )
    grouped = entry_rows.groupBy("scope").agg(
        F.array_sort(F.collect_set("state_name")).alias("states_represented_in_top_list"), F.array_sort(F.collect_list(entry)).alias("top_lgas")
    )
    # ``counts`` is one row.
    document = F.struct(
        F.lit(week_start).alias("week_beginning"), "scope", F.lit("7 days").alias("horizon"), "lgas_scored", "tier_counts",
        "states_represented_in_top_list", F.transform("top_lgas", lambda e: e.dropFields("position")).alias("top_lgas"),
    )
    return grouped.crossJoin(F.broadcast(counts)).select("scope", F.to_json(document).alias("context"))


def distribution_line(predictions: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """Per scope: the sentence on tier counts and leading states. Only tiers that occur are named, in name order."""
    seen = predictions.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"))
    parts = seen.agg(F.array_sort(F.collect_list(F.struct("risk_tier", "n"))).alias("t")).select(
        F.array_join(F.transform("t", lambda x: F.concat(x["n"].cast("string"), F.lit(" areas at "), F.lower(x["risk_tier"]), F.lit(" risk"))), ", ").alias("_tiers")
    )
    states = entry_rows.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_set("state_name")), ", ").alias("_states"))
    return states.crossJoin(F.broadcast(parts)).select(
        "scope",
        F.concat(F.lit("Across the country the model places "), "_tiers",
                 F.lit(". The areas carrying the highest scores this week are concentrated in "), "_states", F.lit(".")).alias("line"),
    )


def entry_lines(entry_rows: DataFrame) -> DataFrame:
    """The fixed sentence for each listed unit, without line wrapping."""
    change = F.col("rank_change")
    moved = (
        F.when(change.isNull(), "no comparable position last week")
        .when(change > 0, F.format_string("up %d places on last week", change))
        .when(change < 0, F.format_string("down %d places on last week", F.abs(change)))
        .otherwise("unchanged on last week")
    )
    drivers = F.when(F.size("drivers") > 0, F.array_join(F.slice("drivers", 1, 3), "; ")).otherwise("no single dominant driver")
    actors = F.when(F.size("actors") > 0, F.array_join(F.transform("actors", lambda a: a["actor"]), ", ")).otherwise("no named actor recorded recently")
    return entry_rows.select(
        "scope", "position",
        F.concat(
            "lga_name", F.lit(", "), "state_name", F.lit(". Probability "), F.format_string("%.3f", "probability"), F.lit(", tier "), "risk_tier",
            F.lit(", national rank "), F.col("rank_national").cast("string"), F.lit(", "), moved, F.lit(". Principal drivers: "), drivers,
            F.lit(". Actors recorded in this area: "), actors, F.lit("."),
        ).alias("line"),
    )


def brief_rows(entry_rows: DataFrame, predictions: DataFrame, run_id: str, week_start: str, generated_at: str) -> DataFrame:
    """Stored brief per scope: heading, distribution line and the listed units."""
    lines = entry_lines(entry_rows).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    head = distribution_line(predictions, entry_rows)
    return lines.join(head, "scope").select(
        F.concat_ws(":", F.lit(run_id), "scope").alias("brief_id"), F.lit(run_id).alias("run_id"), F.lit(week_start).cast("date").alias("week_start"),
        "scope", F.lit("template").alias("generator"), F.lit(generated_at).cast("timestamp").alias("generated_at"),
        F.concat_ws("\n", F.lit(f"Weekly security outlook, week beginning {week_start}"), "line", F.array_join(F.col("l.line"), "\n")).alias("content"),
    )
