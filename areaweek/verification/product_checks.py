"""Ranks, tiers, actor graph, alerts, briefs and serving reads on customer-level units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Domain
from ..operators import actors as act
from ..operators import alerts as al
from ..operators import brief as br
from ..operators import explain as ex
from ..operators import scoring as sc
from ..operators import serving as sv
from ..session import work_path
from .panel_checks import r6
from .sql import compose

QUERIES: dict = {}
SQL: dict[str, str] = {}

LAST, PREVIOUS = "2001-07-30", "2001-07-23"
AS_OF = "2001-07-30 06:00:00"
RUN, PREVIOUS_RUN = f"run-{LAST}", f"run-{PREVIOUS}"
WEIGHTS = {"events_52w": 0.05, "events_4w": 0.3, "fatalities_52w": -0.02, "operations_52w": 0.015}

PARTS = {
    "run_weeks": f"select unnest([date '{PREVIOUS}', date '{LAST}']) as week_start",
    "unit_counts": """select r.*, w.week_start, cast(count(*) filter (event_class = 'banditry_kidnapping') as double) as events_52w,
        cast(count(*) filter (event_class = 'banditry_kidnapping' and event_date >= w.week_start - 28) as double) as events_4w,
        cast(coalesce(sum(fatalities) filter (event_class = 'banditry_kidnapping'), 0) as double) as fatalities_52w,
        cast(count(*) filter (event_class = 'state_operation') as double) as operations_52w
        from registry_l r cross join run_weeks w left join incidents_l i on i.lga_code = r.lga_code and event_date < w.week_start and event_date >= w.week_start - 364
        group by all""",
    "scores": "select *, round(1 - exp(-(0.01 + 0.05 * events_52w + 0.3 * events_4w)), 6) as probability from unit_counts",
    "cuts": f"select quantile_cont(probability, 0.9) as c1, quantile_cont(probability, 0.98) as c2, quantile_cont(probability, 0.995) as c3 from scores where week_start = date '{PREVIOUS}'",
    "predictions": """select 'run-' || cast(week_start as varchar) as run_id, lga_code, lga_name, state_name, zone, week_start, probability,
        case when probability >= c3 then 'Severe' when probability >= c2 then 'High' when probability >= c1 then 'Elevated' else 'Low' end as risk_tier,
        row_number() over (partition by week_start order by probability desc, lga_code) as rank_national,
        row_number() over (partition by week_start, state_name order by probability desc, lga_code) as rank_state
        from scores cross join cuts""",
    "latest": f"select * from predictions where run_id = '{RUN}'",
    "prior": f"select * from predictions where run_id = '{PREVIOUS_RUN}'",
    "attributions": f"""select lga_code, week_start, feature_name, value as feature_value, w * (value - mean) as shap_value from (
        select lga_code, week_start, feature_name, value, avg(value) over (partition by feature_name) as mean, w from (
        select lga_code, week_start, unnest(['events_52w', 'events_4w', 'fatalities_52w', 'operations_52w']) as feature_name,
        unnest([events_52w, events_4w, fatalities_52w, operations_52w]) as value, unnest([0.05, 0.3, -0.02, 0.015]::double[]) as w
        from scores where week_start = date '{LAST}'))""",
    "drivers": "select * from (select *, row_number() over (partition by lga_code order by abs(shap_value) desc, feature_name) as driver_rank from attributions) where driver_rank <= 5",
    "lines": """select *, feature_name || ' at ' || case when abs(feature_value) < 1000 then regexp_replace(printf('%.2f', feature_value), '\\.?0+$', '')
        else format('{:,}', cast(round(feature_value) as bigint)) end || ' ' || case when shap_value > 0 then 'raises' else 'lowers' end || ' the score' as sentence from drivers""",
    "named": f"""select *, pow(0.5, greatest(date '{LAST}' - event_date, 0) / 365) as recency, coalesce(sec, prim) as actor from (
        select *, case when lower(trim(actor_secondary)) not in ('civilians', 'unknown', '', 'none', 'civilians (nigeria)') then trim(actor_secondary) end as sec,
        case when lower(trim(actor_primary)) not in ('civilians', 'unknown', '', 'none', 'civilians (nigeria)') then trim(actor_primary) end as prim
        from incidents_l where event_date >= date '{LAST}' - 1825 and event_date <= date '{LAST}') where coalesce(sec, prim) is not null""",
    "edges": """select actor, lga_code as target, 'lga' as target_kind, count(*) as events, sum(fatalities) as fatalities, min(event_date) as first_seen,
        max(event_date) as last_seen, round(sum(recency), 9) as weight from named group by all
        union all select actor, state_name, 'state', count(*), sum(fatalities), min(event_date), max(event_date), round(sum(recency), 9)
        from named join registry_l using (lga_code) group by all""",
    "history": f"""select lga_code, risk_tier as last_tier, timestamp '{PREVIOUS} 08:00:00' as dispatched_at from prior where risk_tier in ('High', 'Severe')""",
    "decisions": """select l.lga_code, l.lga_name, l.state_name, l.risk_tier, l.probability,
        case when rep then 'suppress_cooldown' else 'send' end as action,
        case when rep then 'already alerted at ' || last_tier || ' on ' || strftime(dispatched_at, '%Y-%m-%d')
             when last_tier is not null then 'escalated from ' || last_tier || ' to ' || risk_tier
             else 'first ' || risk_tier || ' alert within the cooldown window' end as reason
        from (select l.*, h.last_tier, h.dispatched_at, coalesce(case l.risk_tier when 'Severe' then 3 else 2 end <= case h.last_tier when 'Severe' then 3 when 'High' then 2 end, false) as rep
              from latest l left join history h using (lga_code) where l.risk_tier in ('High', 'Severe')) l""",
    "scoped": """select * from (select *, row_number() over (partition by scope order by probability desc, lga_code) as position from (
        select 'national' as scope, * from latest union all select state_name as scope, * from latest)) where position <= 10""",
    "actor_top": "select * from (select *, row_number() over (partition by target_kind, target order by weight desc, actor) as rank from edges)",
}
# Sorting by a sum of floating weights: both engines compare the same rounded value.
PARTS["actor_top"] = PARTS["actor_top"].replace("order by weight desc", "order by round(weight, 9) desc")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, PARTS)
        return fn

    return add


def scores(d: Domain):
    """Counts of the year before each of the two scored weeks, and a probability."""
    runs = F.explode(F.array(F.lit(PREVIOUS).cast("date"), F.lit(LAST).cast("date")))
    target, day, week = F.col("event_class") == "banditry_kidnapping", F.col("event_date"), F.col("week_start")
    counted = (
        d.incidents.where((day < F.lit(LAST).cast("date")) & (day >= F.date_sub(F.lit(PREVIOUS).cast("date"), 364)))
        .select("lga_code", "event_date", "event_class", "fatalities", runs.alias("week_start"))
        .where((day < week) & (day >= F.date_sub(week, 364)))
        .groupBy("lga_code", "week_start")
        .agg(
            F.count_if(target).cast("double").alias("events_52w"),
            F.count_if(target & (day >= F.date_sub(week, 28))).cast("double").alias("events_4w"),
            F.sum(F.when(target, F.col("fatalities")).otherwise(0)).cast("double").alias("fatalities_52w"),
            F.count_if(F.col("event_class") == "state_operation").cast("double").alias("operations_52w"),
        )
    )
    units = d.registry.select("*", runs.alias("week_start"))
    wide = units.join(counted, ["lga_code", "week_start"], "left").fillna(0.0, list(WEIGHTS))
    rate = F.lit(0.01) + F.lit(0.05) * F.col("events_52w") + F.lit(0.3) * F.col("events_4w")
    return wide.withColumn("probability", F.round(1 - F.exp(-rate), 6))


def predictions(d: Domain):
    scored = scores(d)
    cuts = sc.tier_cut_points(scored.where(F.col("week_start") == F.lit(PREVIOUS).cast("date")))
    ranked = sc.rank_units(sc.assign_tiers(scored, cuts))
    return ranked.select(
        F.concat(F.lit("run-"), F.col("week_start").cast("string")).alias("run_id"), "lga_code", "lga_name", "state_name", "zone",
        "week_start", "probability", "risk_tier", "rank_national", "rank_state",
    )


def latest(d: Domain):
    return predictions(d).where(F.col("run_id") == RUN)


def run_pair(d: Domain):
    both = predictions(d)
    return both.where(F.col("run_id") == RUN), both.where(F.col("run_id") == PREVIOUS_RUN)


def model_runs(d: Domain):
    """One run record per scored week, created the morning after it."""
    return d.incidents.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(*[F.struct(F.lit(f"run-{w}").alias("run_id"), F.lit(f"{w} 05:00:00").cast("timestamp").alias("created_at")) for w in (PREVIOUS, LAST)])).alias("r"),
        F.to_json(F.struct("n")).alias("metrics"),
    ).select("r.*", "metrics")


def history(prior):
    return prior.where(F.col("risk_tier").isin("High", "Severe")).select(
        "lga_code", "risk_tier", F.lit("sent").alias("status"), F.lit(f"{PREVIOUS} 08:00:00").cast("timestamp").alias("dispatched_at")
    )


def attributions(d: Domain):
    return ex.linear_attributions(scores(d).where(F.col("week_start") == F.lit(LAST).cast("date")), WEIGHTS)


def events(d: Domain):
    return act.recent_actor_events(d.incidents, LAST)


def edges(d: Domain):
    return act.actor_edges(events(d), d.registry).withColumn("weight", F.round("weight", 9))


def large(spark, sf):
    return Domain(spark, sf, large=True)


@query("w10_ranks", "select run_id, lga_code, probability, rank_national, rank_state from predictions")
def w10(spark, sf):
    return predictions(large(spark, sf)).select("run_id", "lga_code", "probability", "rank_national", "rank_state")


@query("m6_tier_cut_points", 'select round(c1, 6) as "Elevated", round(c2, 6) as "High", round(c3, 6) as "Severe" from cuts')
def m6(spark, sf):
    scored = scores(large(spark, sf)).where(F.col("week_start") == F.lit(PREVIOUS).cast("date"))
    return sc.tier_cut_points(scored).select(*[r6(c, c) for c in ("Elevated", "High", "Severe")])


@query("m6_tiers", "select run_id, lga_code, risk_tier from predictions")
def m6b(spark, sf):
    return predictions(large(spark, sf)).select("run_id", "lga_code", "risk_tier")


@query("w11_driver_rank", "select lga_code, week_start, driver_rank, feature_name, feature_value, round(shap_value, 6) as shap_value from drivers")
def w11(spark, sf):
    return ex.top_drivers(attributions(large(spark, sf))).select(
        "lga_code", "week_start", "driver_rank", "feature_name", "feature_value", r6("shap_value", "shap_value")
    )


@query("m17_driver_sentences", "select lga_code, driver_rank, sentence from lines")
def m17(spark, sf):
    return ex.sentences(ex.top_drivers(attributions(large(spark, sf)))).select("lga_code", "driver_rank", "sentence")


@query("k6_unit_drivers", "select lga_code, driver_rank, feature_name from drivers where lga_code = (select max(lga_code) from registry_l)")
def k6(spark, sf):
    d = large(spark, sf)
    drivers = ex.top_drivers(attributions(d)).withColumn("run_id", F.lit(RUN))
    last_unit = d.registry.agg(F.max("lga_code").alias("lga_code"))
    return sv.unit_drivers(drivers, model_runs(d)).join(F.broadcast(last_unit), "lga_code").orderBy("driver_rank").select(
        "lga_code", "driver_rank", "feature_name"
    )


IMPORTANCE = "select feature_name, avg(abs(shap_value)) as m from attributions group by all"


@query(
    "a15_global_importance",
    f"with imp as ({IMPORTANCE}) select feature_name, round(m, 6) as mean_abs_shap, round(m / (select sum(m) from imp), 6) as share, "
    "round((select sum(m) filter (feature_name like 'events%') / sum(m) from imp), 6) as event_share from imp",
)
def a15(spark, sf):
    imp = ex.global_importance(attributions(large(spark, sf)))
    return imp.crossJoin(F.broadcast(ex.prefix_share(imp, "events"))).select(
        "feature_name", r6("mean_abs_shap", "mean_abs_shap"), r6("share", "share"), r6("prefix_share", "event_share")
    )


@query(
    "a11_tier_counts",
    """select run_id, count(*) filter (risk_tier = 'Low') as n_low, count(*) filter (risk_tier = 'Elevated') as n_elevated,
       count(*) filter (risk_tier = 'High') as n_high, count(*) filter (risk_tier = 'Severe') as n_severe, count(*) as n_scored from predictions group by all""",
)
def a11(spark, sf):
    return sc.tier_counts(predictions(large(spark, sf)), ["run_id"])


@query("a16_latest_run", f"select run_id, count(*) as units from predictions where run_id = '{RUN}' group by all")
def a16(spark, sf):
    d = large(spark, sf)
    return sc.of_latest_run(predictions(d), model_runs(d)).groupBy("run_id").agg(F.count(F.lit(1)).alias("units"))


# ---------------------------------------------------------------- actor graph
@query("g3_recency_weight", f"select event_id, round(pow(0.5, greatest(date '{LAST}' - event_date, 0) / 365), 6) as recency from incidents_l")
def g3(spark, sf):
    incidents = large(spark, sf).incidents
    return incidents.select("event_id", F.round(act.recency_weight(F.col("event_date"), F.lit(LAST).cast("date")), 6).alias("recency"))


@query(
    "g4_clean_actor",
    """select event_id, case when lower(trim(actor_secondary)) not in ('civilians', 'unknown', '', 'none', 'civilians (nigeria)') then trim(actor_secondary) end as sec,
       case when lower(trim(actor_primary)) not in ('civilians', 'unknown', '', 'none', 'civilians (nigeria)') then trim(actor_primary) end as prim from incidents_l""",
)
def g4(spark, sf):
    return large(spark, sf).incidents.select("event_id", act.clean_actor("actor_secondary").alias("sec"), act.clean_actor("actor_primary").alias("prim"))


@query("b6_actor_lookback", "select event_id, actor from named")
def b6(spark, sf):
    return events(large(spark, sf)).select("event_id", "actor")


@query(
    "a7_actor_edges",
    "select actor, target, target_kind, events, cast(fatalities as bigint) as fatalities, first_seen, last_seen, round(weight, 6) as weight from edges",
)
def a7(spark, sf):
    return edges(large(spark, sf)).withColumn("weight", F.round("weight", 6))


SQL["u1_union_edge_kinds"] = compose("select target_kind, count(*) as edges, cast(sum(events) as bigint) as events from edges group by all", PARTS)
QUERIES["u1_union_edge_kinds"] = lambda spark, sf: edges(large(spark, sf)).groupBy("target_kind").agg(
    F.count(F.lit(1)).alias("edges"), F.sum("events").alias("events")
)


@query(
    "a8_actor_rollup",
    """select actor, count(distinct target) as lgas, cast(sum(events) as bigint) as events, cast(sum(fatalities) as bigint) as fatalities,
       round(sum(weight), 5) as weight, max(last_seen) as last_seen from edges where target_kind = 'lga' group by all""",
)
def a8(spark, sf):
    return act.actor_rollup(edges(large(spark, sf))).withColumn("weight", F.round("weight", 5))


@query(
    "a9_rivalries",
    """select least(prim, sec) as pair_a, greatest(prim, sec) as pair_b, count(*) as events, cast(sum(fatalities) as bigint) as fatalities,
       round(sum(recency), 5) as weight, count(distinct lga_code) as lgas from named where prim is not null and sec is not null group by all""",
)
def a9(spark, sf):
    return act.rivalries(events(large(spark, sf))).withColumn("weight", F.round("weight", 5))


@query(
    "a10_degree_centrality",
    """select actor, count(*) as degree, round(count(*) / ((select count(distinct actor) + count(distinct target) from edges where target_kind = 'lga') - 1), 9) as degree_centrality
       from edges where target_kind = 'lga' group by all""",
)
def a10(spark, sf):
    return act.degree_centrality(edges(large(spark, sf))).withColumn("degree_centrality", F.round("degree_centrality", 9))


@query(
    "k3_top_actors",
    """select target_kind, target, rank, actor, events, round(weight, 6) as weight from actor_top where (target_kind = 'lga' and rank <= 5) or (target_kind = 'state' and rank <= 8)""",
)
def k3(spark, sf):
    e = edges(large(spark, sf))
    both = act.top_actors(e, "lga", 5).unionByName(act.top_actors(e, "state", 8))
    return both.select("target_kind", "target", "rank", "actor", "events", r6("weight", "weight"))


@query(
    "k4_recent_incidents",
    """select lga_code, event_date, event_id, recent_rank from (select *, row_number() over (partition by lga_code order by event_date desc, event_id) as recent_rank
       from incidents_l where event_class = 'banditry_kidnapping') where recent_rank <= 12""",
)
def k4(spark, sf):
    return sv.recent_incidents(large(spark, sf).incidents).select("lga_code", "event_date", "event_id", "recent_rank")


# ---------------------------------------------------------------- alerts
@query("j12_alert_history", "select lga_code, last_tier, dispatched_at as last_sent_at from history")
def j12(spark, sf):
    _, prior = run_pair(large(spark, sf))
    return al.last_sent(history(prior), AS_OF)


@query("b1_alert_decisions", "select lga_code, risk_tier, probability, action, reason from decisions")
def b1(spark, sf):
    now, prior = run_pair(large(spark, sf))
    return al.decide(now, history(prior), AS_OF).select("lga_code", "risk_tier", "probability", "action", "reason")


HELD = """with share as (select count(*) filter (action = 'send') / (select count(*) from latest) as s from decisions)
    select lga_code, lga_name, state_name, risk_tier, probability, case when action = 'send' and s > {c} then 'held_blast_radius' else action end as action,
    case when action = 'send' and s > {c} then printf('held, %.0f%% of areas above threshold', s * 100) else reason end as reason from decisions cross join share"""


def held(spark, sf, ceiling):
    now, prior = run_pair(large(spark, sf))
    return al.hold_blast_radius(al.decide(now, history(prior), AS_OF), now, ceiling)


@query("b2_blast_radius_open", HELD.format(c=0.05))
def b2(spark, sf):
    return held(spark, sf, 0.05)


@query("b2_blast_radius_held", HELD.format(c=0.001))
def b2b(spark, sf):
    return held(spark, sf, 0.001)


@query(
    "b3_alert_audit",
    f"""select '{RUN}:' || lga_code || ':{AS_OF}' as alert_id, '{RUN}' as run_id, lga_code, date '{LAST}' as week_start, risk_tier, probability, 'log' as channel,
        case when action = 'send' then 'dry_run' else 'suppressed' end as status, timestamp '{AS_OF}' as dispatched_at,
        '{{"lga":"' || lga_name || '","state":"' || state_name || '","action":"' || action || '","reason":"' || reason || '"}}' as payload from decisions""",
)
def b3(spark, sf):
    return al.audit_rows(held(spark, sf, 1.0), RUN, LAST, AS_OF)


# ---------------------------------------------------------------- briefs
def brief_entries(spark, sf):
    d = large(spark, sf)
    now, prior = run_pair(d)
    return br.entries(now, prior, ex.top_drivers(attributions(d)), edges(d)), now


ENTRY_PARTS = """, txt as (select lga_code, string_agg(sentence, '; ' order by driver_rank) as drivers, string_agg(case when driver_rank <= 3 then sentence end, '; ' order by driver_rank) as three from lines group by all),
    who as (select target as lga_code, string_agg(actor, ', ' order by rank) as actors from actor_top where target_kind = 'lga' and rank <= 3 group by all),
    entry as (select s.scope, s.position, s.lga_code, s.lga_name, s.state_name, round(s.probability, 4) as probability, s.risk_tier, s.rank_national,
       prior.rank_national - s.rank_national as rank_change, drivers, three, coalesce(actors, '') as actors
       from scoped s left join prior using (lga_code) left join txt using (lga_code) left join who using (lga_code))"""


def with_entries(body: str) -> str:
    base = compose("select 1 from scoped, prior, lines, actor_top, latest", PARTS)
    return base[: base.rindex("\nselect 1")] + ENTRY_PARTS + "\n" + body


@query("b4_brief_entries")
def b4(spark, sf):
    rows, _ = brief_entries(spark, sf)
    return rows.select(
        "scope", "position", "lga_code", "probability", "risk_tier", "rank_national", "rank_change",
        F.array_join("drivers", "; ").alias("drivers"), F.array_join(F.transform("actors", lambda a: a["actor"]), ", ").alias("actors"),
    )


SQL["b4_brief_entries"] = with_entries("select scope, position, lga_code, probability, risk_tier, rank_national, rank_change, drivers, actors from entry")


@query("b4_brief_context")
def b4b(spark, sf):
    rows, now = brief_entries(spark, sf)
    schema = "week_beginning string, lgas_scored bigint, states_represented_in_top_list array<string>, top_lgas array<struct<lga:string,national_rank:bigint>>"
    read = F.from_json("context", schema)
    return br.contexts(rows, now, LAST).select(
        "scope", read["week_beginning"].alias("week_beginning"), read["lgas_scored"].alias("lgas_scored"),
        F.array_join(read["states_represented_in_top_list"], ", ").alias("states"),
        F.array_join(F.transform(read["top_lgas"], lambda e: e["lga"]), ", ").alias("units"),
    )


SQL["b4_brief_context"] = with_entries(
    f"""select scope, '{LAST}' as week_beginning, (select count(*) from latest) as lgas_scored, string_agg(distinct state_name, ', ' order by state_name) as states,
        string_agg(lga_name, ', ' order by position) as units from entry group by scope"""
)


@query("b5_brief_lines")
def b5(spark, sf):
    rows, _ = brief_entries(spark, sf)
    return br.entry_lines(rows)


SQL["b5_brief_lines"] = with_entries(
    """select scope, position, lga_name || ', ' || state_name || '. Probability ' || printf('%.3f', probability) || ', tier ' || risk_tier || ', national rank ' || rank_national || ', ' ||
       case when rank_change is null then 'no comparable position last week' when rank_change > 0 then 'up ' || rank_change || ' places on last week'
            when rank_change < 0 then 'down ' || abs(rank_change) || ' places on last week' else 'unchanged on last week' end
       || '. Principal drivers: ' || three || '. Actors recorded in this area: ' || case when actors = '' then 'no named actor recorded recently' else actors end || '.' as line from entry"""
)


@query(
    "k5_top_units_per_scope",
    "select scope, position, lga_code, probability from scoped",
)
def k5(spark, sf):
    return br.scoped_top(latest(large(spark, sf))).select("scope", "position", "lga_code", "probability")


@query(
    "j11_rank_movement",
    "select l.lga_code, l.rank_national, p.rank_national - l.rank_national as rank_change from latest l left join prior p using (lga_code)",
)
def j11(spark, sf):
    now, prior = run_pair(large(spark, sf))
    return br.with_movement(now, prior).select("lga_code", "rank_national", "rank_change")


@query("k7_latest_brief")
def k7(spark, sf):
    rows, now = brief_entries(spark, sf)
    stored = br.brief_rows(rows, now, RUN, LAST, f"{LAST} 07:00:00").unionByName(br.brief_rows(rows, now, PREVIOUS_RUN, PREVIOUS, f"{PREVIOUS} 07:00:00"))
    return sv.latest_brief(stored).select("brief_id", "run_id", "scope", "generator", F.substring_index("content", "\n", 2).alias("head"))


SQL["k7_latest_brief"] = with_entries(
    f"""select '{RUN}:' || scope as brief_id, '{RUN}' as run_id, scope, 'template' as generator,
        'Weekly security outlook, week beginning {LAST}' || chr(10) || 'Across the country the model places ' ||
        (select string_agg(n || ' areas at ' || lower(risk_tier) || ' risk', ', ' order by risk_tier) from (select risk_tier, count(*) as n from latest group by all))
        || '. The areas carrying the highest scores this week are concentrated in ' || string_agg(distinct state_name, ', ' order by state_name) || '.' as head
        from entry group by scope"""
)


# ---------------------------------------------------------------- serving
@query(
    "j9_latest_predictions",
    "select run_id, lga_code, l.lga_name, l.state_name, l.zone, centre_lat, centre_lon, week_start, probability, risk_tier, rank_national, rank_state from latest l join (select lga_code, centre_lat, centre_lon from registry_l) using (lga_code)",
)
def j9(spark, sf):
    d = large(spark, sf)
    stored = predictions(d).select("run_id", "lga_code", "week_start", "probability", "risk_tier", "rank_national", "rank_state")
    return sv.latest_predictions(stored, d.registry, model_runs(d))


@query(
    "n14_prediction_filters",
    """select lga_code, probability, (select count(*) from latest where state_name = 'NATION_3' and risk_tier = 'Low') as matches
       from latest where state_name = 'NATION_3' and risk_tier = 'Low' order by probability desc, lga_code limit 10""",
)
def n14(spark, sf):
    return sv.counted_list(latest(large(spark, sf)), 10, state="nation_3", tier="LOW").select("lga_code", "probability", "matches")


@query("k1_ranked_list", "select lga_code, probability, risk_tier, rank_national from latest order by probability desc, lga_code limit 100")
def k1(spark, sf):
    return sv.ranked_list(latest(large(spark, sf)), 100).select("lga_code", "probability", "risk_tier", "rank_national")


@query(
    "j10_scores_on_boundaries",
    """select r.lga_code, r.state_name, case when l.risk_tier in ('High', 'Severe') then l.probability end as probability,
       case when l.risk_tier in ('High', 'Severe') then l.risk_tier else 'Unscored' end as risk_tier from registry_l r left join latest l using (lga_code)""",
)
def j10(spark, sf):
    d = large(spark, sf)
    alerting = latest(d).where(F.col("risk_tier").isin("High", "Severe"))
    return sv.on_boundaries(d.registry.select("lga_code", "state_name"), alerting).select("lga_code", "state_name", "probability", "risk_tier")


@query(
    "s16_serving_extract",
    """select event_id, lga_code, event_date, event_class, event_type, actor_primary, actor_secondary, fatalities, headline
       from incidents_l where event_class = 'banditry_kidnapping' and lga_code is not null""",
)
def s16(spark, sf):
    return sv.serving_incidents(large(spark, sf).incidents)


@query("s16_serving_tables")
def s16b(spark, sf):
    """All seven served tables, written and read again: rows, and a sum over one column of each."""
    d = large(spark, sf)
    rows, now = brief_entries(spark, sf)
    ranked = predictions(d).select("run_id", "lga_code", "week_start", "probability", "risk_tier", "rank_national", "rank_state")
    tables = {
        "lga_registry": d.registry, "model_runs": model_runs(d), "predictions": ranked, "incidents": d.incidents,
        "prediction_drivers": ex.top_drivers(attributions(d)).withColumn("run_id", F.lit(RUN)), "threat_actor_edges": edges(d).withColumn("run_id", F.lit(RUN)),
        "security_briefs": br.brief_rows(rows, now, RUN, LAST, f"{LAST} 07:00:00"),
    }
    paths = sv.serving_extract(tables, work_path(spark, "serving"))
    sums = {
        "lga_registry": F.length("lga_name"), "model_runs": F.length("run_id"), "predictions": F.col("rank_national") + F.col("rank_state"), "incidents": F.col("fatalities"),
        "prediction_drivers": F.col("driver_rank"), "threat_actor_edges": F.col("events"), "security_briefs": F.length("brief_id"),
    }
    out = None
    for name, value in sums.items():
        row = spark.read.parquet(paths[name]).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).cast("long").alias("total")).select(F.lit(name).alias("output"), "rows", "total")
        out = row if out is None else out.unionByName(row)
    return out


SQL["s16_serving_tables"] = with_entries(
    f"""select 'lga_registry' as output, count(*) as rows, cast(sum(length(lga_name)) as bigint) as total from registry_l
    union all select 'model_runs', 2, {len(RUN) + len(PREVIOUS_RUN)}
    union all select 'predictions', count(*), cast(sum(rank_national + rank_state) as bigint) from predictions
    union all select 'incidents', count(*), cast(sum(fatalities) as bigint) from incidents_l where event_class = 'banditry_kidnapping' and lga_code is not null
    union all select 'prediction_drivers', count(*), cast(sum(driver_rank) as bigint) from drivers
    union all select 'threat_actor_edges', count(*), cast(sum(events) as bigint) from edges
    union all select 'security_briefs', count(*), cast(sum(length('{RUN}:' || scope)) as bigint) from (select distinct scope from entry)"""
)
