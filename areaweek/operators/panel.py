"""Unit-by-week panel: weekly facts, neighbour exposure, lag windows, labels.

The plan stays sparse until the last step. Events are pre-aggregated to
(unit, week), spread along the adjacency edges, and merged into one sparse fact
table. The dense grid is then made in place: each unit's facts are ordered by
week and every gap is expanded by a generator, so the full unit-by-week grid is
never built by a join and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import week_start
from ..schemas import OPERATION_CLASS, TARGET_CLASS

# Default windows in weeks and the gap ceiling.
OWN_EVENT_WEEKS = (1, 2, 4, 8, 12, 26, 52)
OWN_FATALITY_WEEKS = (4, 12, 52)
OWN_OPERATION_WEEKS = (4, 12)
NEIGHBOUR_EVENT_WEEKS = (1, 4, 12)
NEIGHBOUR_FATALITY_WEEKS = (4,)
NEIGHBOUR_OPERATION_WEEKS = (4, 12)
GAP_CEILING_WEEKS = 260


@dataclass(frozen=True)
class WeekRange:
    """Mondays from ``first`` to ``last``, both ISO dates."""

    first: str
    last: str

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(
            F.posexplode(F.sequence(F.lit(self.first).cast("date"), F.lit(self.last).cast("date"), F.expr("interval 7 days")))
        ).select(F.col("pos").cast("int").alias("week_index"), F.col("col").alias("week_start"))

    def index_of(self, day) -> Column:
        return F.floor(F.datediff(day, F.lit(self.first).cast("date")) / 7).cast("int")

    def start_of(self, index) -> Column:
        return F.date_add(F.lit(self.first).cast("date"), (index * 7).cast("int"))

    @property
    def count(self) -> int:
        from datetime import date

        return (date.fromisoformat(self.last) - date.fromisoformat(self.first)).days // 7 + 1

    def contains(self, day) -> Column:
        # A bare date comparison, so the bound reaches the file scan.
        return (day >= F.lit(self.first).cast("date")) & (day < F.date_add(F.lit(self.last).cast("date"), 7))


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def is_class(name: str) -> Column:
    return F.col("event_class") == name


def weekly_events(incidents: DataFrame) -> DataFrame:
    """Target events, target fatalities and operations per unit and week."""
    target = is_class(TARGET_CLASS)
    return (
        incidents.where(F.col("lga_code").isNotNull())
        .groupBy("lga_code", week_start("event_date").alias("week_start"))
        .agg(
            F.count_if(target).alias("events"),
            F.sum(F.when(target, F.coalesce("fatalities", F.lit(0))).otherwise(0)).alias("fatalities"),
            F.count_if(is_class(OPERATION_CLASS)).alias("operations"),
        )
    )


def weekly_actors(incidents: DataFrame) -> DataFrame:
    """Distinct named actors of target events per unit and week."""
    return (
        incidents.where(F.col("lga_code").isNotNull() & is_class(TARGET_CLASS))
        .groupBy("lga_code", week_start("event_date").alias("week_start"))
        .agg(F.countDistinct(F.coalesce("actor_secondary", "actor_primary", F.lit("unknown"))).alias("actors"))
    )


def weekly_own(incidents: DataFrame, weeks: WeekRange, decay: float | None = None) -> DataFrame:
    """Every own measure of a unit and week in one pass over the events.

    With ``decay`` also the kernel mass the week's target events leave at the
    start of the next week.
    """
    target = is_class(TARGET_CLASS)
    measures = [
        F.count_if(target).alias("events"),
        F.sum(F.when(target, F.coalesce("fatalities", F.lit(0))).otherwise(0)).alias("fatalities"),
        F.count_if(is_class(OPERATION_CLASS)).alias("operations"),
        F.countDistinct(F.when(target, F.coalesce("actor_secondary", "actor_primary", F.lit("unknown")))).alias("actors"),
    ]
    if decay is not None:
        age = 7 - F.datediff("event_date", week_start("event_date"))
        measures.append(F.sum(F.when(target, F.exp(-decay * age)).otherwise(0.0)).alias("mass"))
    seen = F.col("lga_code").isNotNull() & F.col("event_class").isin(TARGET_CLASS, OPERATION_CLASS) & weeks.contains(F.col("event_date"))
    return incidents.where(seen).groupBy("lga_code", week_start("event_date").alias("week_start")).agg(*measures)


def broadcast_within(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Hint a broadcast only when the counted number of rows is below the limit."""
    return F.broadcast(df) if rows <= limit else df


def weekly_mentions(documents: DataFrame) -> DataFrame:
    """Reports naming each unit per week, and those that carry a ransom figure."""
    return (
        documents.where(F.col("published_at").isNotNull())
        .select(week_start("published_at").alias("week_start"), F.explode("lga_codes").alias("lga_code"), "ransom_ngn")
        .groupBy("lga_code", "week_start")
        .agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("ransom_ngn") > 0).alias("ransoms"))
    )


def weekly_chatter(chatter: DataFrame) -> DataFrame:
    """Posts and peak threat per unit and week."""
    return (
        chatter.where(F.col("lga_code").isNotNull() & F.col("posted_at").isNotNull())
        .groupBy("lga_code", week_start("posted_at").alias("week_start"))
        .agg(
            F.count(F.lit(1)).alias("volume"),
            F.max(F.greatest(F.coalesce("threat_score", F.lit(0.0)), F.lit(0.0))).alias("threat"),
        )
    )


def edges(adjacency: DataFrame) -> DataFrame:
    return adjacency.select("lga_code", "neighbour_code", "weight").dropDuplicates(["lga_code", "neighbour_code"])


def neighbour_sums(facts: DataFrame, adjacency: DataFrame, measures: dict[str, str], keys: Sequence[str] = ("week_start",)) -> DataFrame:
    """Weighted sums over each unit's neighbours, ``{measure: new column}``.

    ``facts`` must already be one row per (unit, *keys), so only aggregates are
    moved along the edges.
    """
    moved = facts.withColumnRenamed("lga_code", "neighbour_code").join(edges(adjacency), "neighbour_code")
    return moved.groupBy("lga_code", *keys).agg(*[F.sum(F.col(m) * F.col("weight")).alias(out) for m, out in measures.items()])


def degree(adjacency: DataFrame) -> DataFrame:
    return edges(adjacency).where(F.col("weight") > 0).groupBy("lga_code").agg(F.count(F.lit(1)).alias("n_neighbours"))


def unit_week_grid(registry: DataFrame, weeks: WeekRange) -> DataFrame:
    """Every unit in every week, made by a generator on the unit rows."""
    return registry.select("lga_code", F.explode(F.sequence(F.lit(0), F.lit(weeks.count - 1))).alias("week_index")).withColumn(
        "week_start", weeks.start_of(F.col("week_index"))
    )


def merge_facts(parts: Sequence[DataFrame], measures: Sequence[str], weeks: WeekRange) -> DataFrame:
    """Stack sparse (unit, week, some measures) tables into one row per unit and week."""
    stacked = None
    for part in parts:
        present = [m for m in measures if m in part.columns]
        rows = part.where(weeks.contains(F.col("week_start"))).select(
            "lga_code", weeks.index_of(F.col("week_start")).alias("week_index"),
            *[(F.col(m) if m in present else F.lit(None)).cast("double").alias(m) for m in measures],
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.groupBy("lga_code", "week_index").agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures])


def densify(facts: DataFrame, registry: DataFrame, measures: Sequence[str], weeks: WeekRange, carry: Sequence[str] = ()) -> DataFrame:
    """Dense unit-by-week rows from sparse facts, zero where nothing happened.

    Every unit gets a start row at week 0; each row is then repeated up to the
    next one, keeping its values only in its own week. Units unknown to the
    registry drop out.
    """
    starts = registry.select(
        "lga_code", F.lit(0).alias("week_index"), *[F.lit(0.0).alias(m) for m in measures],
        *carry, F.lit(True).alias("_known"),
    )
    padded = facts.select("lga_code", "week_index", *measures).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy("lga_code").orderBy("week_index")
    whole = Window.partitionBy("lga_code")
    # Placed by unit once: the aggregate, the windows and every later lag window
    # over the unit run inside this one exchange. The count is explicit because the
    # sparse rows grow many-fold after it, which a size-based merge cannot foresee.
    merged = padded.repartition(shuffle_width(registry), "lga_code").groupBy("lga_code", "week_index").agg(
        *[F.sum(m).alias(m) for m in measures], *[F.max(c).alias(c) for c in carry], F.max("_known").alias("_known")
    )
    spans = merged.select(
        "lga_code", "week_index", *measures,
        *[F.max(c).over(whole).alias(c) for c in carry],
        F.max("_known").over(whole).alias("_known"),
        F.lead("week_index", 1, weeks.count).over(w).alias("_next"),
    ).where("_known")
    here = F.col("_week") == F.col("week_index")
    return spans.withColumn("_week", F.explode(F.sequence(F.col("week_index"), F.col("_next") - 1))).select(
        "lga_code",
        F.col("_week").alias("week_index"),
        weeks.start_of(F.col("_week")).alias("week_start"),
        *carry,
        *[F.when(here, F.col(m)).otherwise(F.lit(0.0)).alias(m) for m in measures],
    )


def dense_facts(parts: Sequence[DataFrame], registry: DataFrame, measures: Sequence[str], weeks: WeekRange, carry: Sequence[str] = ()) -> DataFrame:
    """Dense unit-by-week rows with prior sums, straight from sparse weekly tables."""
    return prior_sums(densify(merge_facts(parts, measures, weeks), registry, measures, weeks, carry), measures)


def unit_window(key: str | Sequence[str] = "lga_code"):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy("week_index")


def prior_sums(panel: DataFrame, measures: Sequence[str], key="lga_code") -> DataFrame:
    """Add ``_p_<measure>``: the sum over all earlier weeks."""
    before = unit_window(key).rowsBetween(Window.unboundedPreceding, -1)
    return panel.select("*", *[F.coalesce(F.sum(m).over(before), F.lit(0.0)).alias(f"_p_{m}") for m in measures])


def lag_sum(measure: str, n: int, key="lga_code") -> Column:
    """Sum over the ``n`` weeks before this one, as a difference of two prior sums.

    One running sum serves every window length, so a 52-week window costs the
    same as a 1-week one.
    """
    total = F.col(f"_p_{measure}")
    return total - F.coalesce(F.lag(total, n).over(unit_window(key)), F.lit(0.0))


def weeks_since(measure: str, ceiling: int = GAP_CEILING_WEEKS, key="lga_code") -> Column:
    """Weeks since the last earlier non-zero week, at most ``ceiling``."""
    before = unit_window(key).rowsBetween(Window.unboundedPreceding, -1)
    last_active = F.last(F.when(F.col(measure) > 0, F.col("week_index")), ignorenulls=True).over(before)
    return F.coalesce(F.least(F.col("week_index") - last_active, F.lit(ceiling)), F.lit(ceiling)).cast("double")


def historical_rate(measure: str = "events") -> Column:
    """All earlier events divided by the weeks up to and including this one."""
    return F.col(f"_p_{measure}") / (F.col("week_index") + 1)


def label(measure: str = "events") -> Column:
    return (F.col(measure) > 0).cast("int")


def state_features(facts: DataFrame, registry: DataFrame, weeks: WeekRange, n: int = 4) -> DataFrame:
    """Lag sums of the state totals, one row per state and week."""
    by_state = (
        facts.join(registry.select("lga_code", "state_name"), "lga_code")
        .groupBy(F.col("state_name").alias("lga_code"), "week_index")
        .agg(F.sum("events").alias("events"), F.sum("operations").alias("operations"))
    )
    states = registry.select(F.col("state_name").alias("lga_code")).distinct()
    dense = prior_sums(densify(by_state, states, ("events", "operations"), weeks), ("events", "operations"))
    return dense.select(
        F.col("lga_code").alias("state_name"),
        "week_index",
        lag_sum("events", n).alias(f"state_events_{n}w"),
        lag_sum("operations", n).alias(f"state_ops_{n}w"),
    )


def true_distinct_actors(incidents: DataFrame, registry: DataFrame, weeks: WeekRange, n: int = 26) -> DataFrame:
    """Actors seen at least once in the ``n`` weeks before, counted once each.

    Each (unit, actor, week) sighting is active for the next ``n`` weeks; a
    sighting followed by another within that span only lasts until the next one,
    so intervals of one actor never overlap and +1/-1 marks count distinct actors.
    """
    seen = (
        incidents.where(F.col("lga_code").isNotNull() & is_class(TARGET_CLASS) & weeks.contains(F.col("event_date")))
        .select(
            "lga_code",
            F.coalesce("actor_secondary", "actor_primary", F.lit("unknown")).alias("actor"),
            weeks.index_of(F.col("event_date")).alias("week_index"),
        )
        .distinct()
    )
    following = F.lead("week_index").over(Window.partitionBy("lga_code", "actor").orderBy("week_index"))
    spans = seen.select(
        "lga_code", (F.col("week_index") + 1).alias("enter"),
        F.least(F.col("week_index") + n + 1, F.coalesce(following + 1, F.lit(weeks.count))).alias("leave"),
    )
    marks = spans.select(
        "lga_code",
        F.explode(F.array(F.struct(F.col("enter").alias("week_index"), F.lit(1.0).alias("delta")),
                          F.struct(F.col("leave").alias("week_index"), F.lit(-1.0).alias("delta")))).alias("m"),
    ).select("lga_code", "m.*").where(F.col("week_index") < weeks.count)
    facts = marks.groupBy("lga_code", "week_index").agg(F.sum("delta").alias("delta"))
    running = unit_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return densify(facts, registry, ("delta",), weeks).select(
        "lga_code", "week_index", "week_start", F.sum("delta").over(running).alias(f"distinct_actors_{n}w")
    )
