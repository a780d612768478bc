"""The full feature panel as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import panel as p
from ..operators import pointprocess as pp
from ..schemas import FEATURE_LABELS
from ..session import durable

OWN = ("events", "fatalities", "operations", "actors")
NEIGHBOUR = {"events": "nb_events", "fatalities": "nb_fatalities", "operations": "nb_operations", "actors": "nb_actors"}
ATTENTION = ("mentions", "ransoms", "volume", "threat")


def sparse_facts(
    incidents: DataFrame, registry: DataFrame, adjacency: DataFrame, weeks: p.WeekRange,
    documents: DataFrame | None = None, chatter: DataFrame | None = None, decay: float | None = None,
) -> DataFrame:
    """One sparse row per unit and week with any activity there or next door."""
    measures, spread = list(OWN), dict(NEIGHBOUR)
    if decay is not None:
        measures.append("mass")
        spread["mass"] = "nb_mass"
    own = p.weekly_own(incidents, weeks, decay)
    inside = adjacency.join(registry.select(F.col("lga_code").alias("neighbour_code")), "neighbour_code", "left_semi")
    parts = [own, p.neighbour_sums(own, inside, spread)]
    if documents is not None:
        parts.append(p.weekly_mentions(documents))
    if chatter is not None:
        parts.append(p.weekly_chatter(chatter))
    return p.merge_facts(parts, [*measures, *spread.values(), *ATTENTION], weeks)


def build_panel(
    incidents: DataFrame, registry: DataFrame, adjacency: DataFrame, weeks: p.WeekRange,
    documents: DataFrame | None = None, chatter: DataFrame | None = None,
    hawkes: pp.HawkesParameters | None = None, baseline: str = "fit_window", fit_end: str | None = None,
) -> DataFrame:
    """Every panel feature and the label, one row per unit and week.

    The sparse facts are written once: the state totals and the dense rows both
    start from them, so the events themselves are scanned a single time.
    """
    decay = hawkes.decay if hawkes else None
    facts = durable(sparse_facts(incidents, registry, adjacency, weeks, documents, chatter, decay))
    measures = [m for m in facts.columns if m not in ("lga_code", "week_index")]

    units = registry.select("lga_code", "lga_name", "state_name", "zone", "area_sqkm").join(p.degree(adjacency), "lga_code", "left")
    carry = ["lga_name", "state_name", "zone", "area_sqkm", "n_neighbours"]
    if hawkes:
        rates = pp.baseline_rates(incidents, registry, weeks, fit_end, baseline)
        units = units.join(rates, "lga_code", "left")
        carry.append("base_rate")

    dense = p.prior_sums(p.densify(facts, units, measures, weeks, carry), measures)

    columns = {f"own_events_{n}w": p.lag_sum("events", n) for n in p.OWN_EVENT_WEEKS}
    columns |= {f"own_fatalities_{n}w": p.lag_sum("fatalities", n) for n in p.OWN_FATALITY_WEEKS}
    columns |= {f"own_ops_{n}w": p.lag_sum("operations", n) for n in p.OWN_OPERATION_WEEKS}
    columns |= {f"nb_events_{n}w": p.lag_sum("nb_events", n) for n in p.NEIGHBOUR_EVENT_WEEKS}
    columns |= {f"nb_fatalities_{n}w": p.lag_sum("nb_fatalities", n) for n in p.NEIGHBOUR_FATALITY_WEEKS}
    columns |= {f"nb_ops_{n}w": p.lag_sum("nb_operations", n) for n in p.NEIGHBOUR_OPERATION_WEEKS}
    columns["weeks_since_event"] = p.weeks_since("events")
    columns["weeks_since_nb_event"] = p.weeks_since("nb_events")
    columns["hist_rate"] = p.historical_rate()
    columns["actors_26w"] = p.lag_sum("actors", 26) + p.lag_sum("nb_actors", 26)
    columns["n_neighbours"] = F.coalesce("n_neighbours", F.lit(0)).cast("double")
    columns["area_sqkm"] = F.col("area_sqkm")
    columns["doc_mentions_4w"] = p.lag_sum("mentions", 4)
    columns["doc_ransom_12w"] = p.lag_sum("ransoms", 12)
    columns["chatter_volume_1w"] = p.lag_sum("volume", 1)
    columns["chatter_threat_1w"] = p.lag_sum("threat", 1)
    usual = p.lag_sum("volume", 8) / 8
    columns["chatter_escalation"] = F.when(usual > 0, p.lag_sum("volume", 1) / usual).otherwise(F.lit(0.0))
    if hawkes:
        columns["_own_decay"] = pp.weekly_decay_sum("mass", hawkes.decay, weeks.count)
        columns["_nb_decay"] = pp.weekly_decay_sum("nb_mass", hawkes.decay, weeks.count)
        columns["base_rate"] = F.col("base_rate")
    columns["label"] = p.label()

    wide = dense.select("lga_code", "week_index", "week_start", "lga_name", "state_name", "zone", *[c.alias(n) for n, c in columns.items()])
    if hawkes:
        wide = wide.select("*", *pp.intensity_columns(hawkes, F.col("base_rate"), F.col("_own_decay"), F.col("_nb_decay"))).drop(
            "base_rate", "_own_decay", "_nb_decay"
        )
    n_states = registry.select("state_name").distinct().count()
    states = p.broadcast_within(p.state_features(facts, registry, weeks), n_states * weeks.count)
    # The calendar holds one row per week of the range, so its size is fixed by the range.
    calendar = cal.calendar_dimension(weeks.frame(incidents.sparkSession)).drop("cal_festival_name")
    return wide.join(states, ["state_name", "week_index"], "left").join(F.broadcast(calendar), "week_start", "left")


def feature_columns(panel: DataFrame) -> list[str]:
    return [c for c in FEATURE_LABELS if c in panel.columns]
