"""Actor-target graph: edges, roll-up, rivalries and degree centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_in_group

# Names that identify nobody, the recency half life, the look-back.
UNINFORMATIVE = ("civilians", "unknown", "", "none", "civilians (nigeria)")
HALF_LIFE_DAYS = 365
LOOKBACK_YEARS = 5


def clean_actor(name: str) -> Column:
    text = F.trim(F.col(name))
    return F.when(~F.lower(text).isin(*UNINFORMATIVE), text)


def recency_weight(day: Column, as_of: Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.datediff(as_of, day), F.lit(0)) / HALF_LIFE_DAYS)


def recent_actor_events(incidents: DataFrame, as_of: str, bounded: bool = True, years: int = LOOKBACK_YEARS) -> DataFrame:
    """Located events of the look-back with the acting party and a recency weight.

    ``bounded`` leaves out events after ``as_of``.
    """
    reference = F.lit(as_of).cast("date")
    day = F.col("event_date")
    keep = F.col("lga_code").isNotNull() & (day >= F.date_sub(reference, 365 * years))
    if bounded:
        keep = keep & (day <= reference)
    return (
        incidents.where(keep)
        .withColumn("actor", F.coalesce(clean_actor("actor_secondary"), clean_actor("actor_primary")))
        .where(F.col("actor").isNotNull())
        .withColumn("recency", recency_weight(day, reference))
    )


def actor_edges(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges from each actor to units and to states.

    State edges are rolled up from the unit edges, so events are read once.
    """
    units = events.groupBy("actor", F.col("lga_code").alias("target")).agg(
        F.count("event_id").alias("events"), F.sum(F.coalesce("fatalities", F.lit(0))).alias("fatalities"),
        F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"), F.sum("recency").alias("weight"),
    )
    states = (
        units.join(registry.select(F.col("lga_code").alias("target"), "state_name"), "target")
        .where(F.col("state_name").isNotNull())
        .groupBy("actor", F.col("state_name").alias("target"))
        .agg(F.sum("events").alias("events"), F.sum("fatalities").alias("fatalities"), F.min("first_seen").alias("first_seen"),
             F.max("last_seen").alias("last_seen"), F.sum("weight").alias("weight"))
    )
    return units.withColumn("target_kind", F.lit("lga")).unionByName(states.withColumn("target_kind", F.lit("state")))


def unit_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("target_kind") == "lga")


def actor_rollup(edges: DataFrame) -> DataFrame:
    """Per actor: footprint, totals and last sighting. An edge is one unit, so counting edges counts units."""
    return unit_edges(edges).groupBy("actor").agg(
        F.count(F.lit(1)).alias("lgas"), F.sum("events").alias("events"), F.sum("fatalities").alias("fatalities"),
        F.sum("weight").alias("weight"), F.max("last_seen").alias("last_seen"),
    )


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Units reached over all other nodes of the actor-unit graph."""
    reached = unit_edges(edges)
    degree = reached.groupBy("actor").agg(F.count(F.lit(1)).alias("degree"))
    nodes = degree.agg(F.count(F.lit(1)).alias("a")).crossJoin(
        reached.select("target").distinct().agg(F.count(F.lit(1)).alias("u"))
    )
    # ``nodes`` is one row of counts.
    return degree.crossJoin(F.broadcast(nodes)).select("actor", "degree", (F.col("degree") / (F.col("a") + F.col("u") - 1)).alias("degree_centrality"))


def rivalries(events: DataFrame) -> DataFrame:
    """Unordered pairs of named sides that met in an event."""
    a, b = clean_actor("actor_primary"), clean_actor("actor_secondary")
    sides = events.where(a.isNotNull() & b.isNotNull()).select(
        F.least(a, b).alias("pair_a"), F.greatest(a, b).alias("pair_b"), "event_id", "fatalities", "recency", "lga_code"
    )
    # Units first, so the distinct count never gathers one pair's events.
    per_unit = sides.groupBy("pair_a", "pair_b", "lga_code").agg(
        F.count("event_id").alias("events"), F.sum(F.coalesce("fatalities", F.lit(0))).alias("fatalities"), F.sum("recency").alias("weight")
    )
    return per_unit.groupBy("pair_a", "pair_b").agg(
        F.sum("events").alias("events"), F.sum("fatalities").alias("fatalities"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("lgas")
    )


def top_actors(edges: DataFrame, kind: str, k: int) -> DataFrame:
    """The ``k`` heaviest actors of every unit (or state)."""
    return top_in_group(edges.where(F.col("target_kind") == kind), ["target"], [F.desc("weight"), F.asc("actor")], k)
