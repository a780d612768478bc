"""Panel queries: grid, weekly facts, windows, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import CHATTER_WEEKS, WEEKS, Domain
from ..functions import calendar as cf
from ..operators import calendar as cal
from ..operators import panel as p
from ..plans import features
from .sql import compose, lag, since

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, parts: dict[str, str] | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, parts)
        return fn

    return add


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def own_dense(d: Domain, measures=("events", "fatalities", "operations")):
    return p.dense_facts([p.weekly_events(d.incidents)], d.registry, measures, WEEKS)


def nb_dense(d: Domain):
    own = p.weekly_events(d.incidents)
    around = p.neighbour_sums(own, d.adjacency, {"events": "nb_events", "fatalities": "nb_fatalities", "operations": "nb_operations"})
    return p.dense_facts([around], d.registry, ("nb_events", "nb_fatalities", "nb_operations"), WEEKS)


SLICE_SQL = f"""select lga_code, week_start, round({lag('events', 4)}, 6) as own_events_4w, round({lag('nb_events', 12)}, 6) as nb_events_12w,
    round(coalesce(sum(events) over (partition by lga_code order by week_index rows between unbounded preceding and 1 preceding), 0) / (week_index + 1), 6) as hist_rate,
    {since('events')} as weeks_since_event, cast(events > 0 as integer) as label from dense"""


@query("panel_slice", SLICE_SQL)
def panel_slice(spark, sf):
    d = Domain(spark, sf)
    own = p.weekly_events(d.incidents)
    around = p.neighbour_sums(own, d.adjacency, {"events": "nb_events"})
    dense = p.dense_facts([own, around], d.registry, ("events", "nb_events"), WEEKS)
    return dense.select(
        "lga_code", "week_start", r6(p.lag_sum("events", 4), "own_events_4w"), r6(p.lag_sum("nb_events", 12), "nb_events_12w"),
        r6(p.historical_rate(), "hist_rate"), p.weeks_since("events").alias("weeks_since_event"), p.label().alias("label"),
    )


@query("j1_unit_week_grid", "select lga_code, week_start, week_index from grid")
def j1(spark, sf):
    d = Domain(spark, sf)
    return p.unit_week_grid(d.registry, WEEKS).select("lga_code", "week_start", F.col("week_index").cast("long").alias("week_index"))


@query("j2_densify", "select lga_code, week_start, events, fatalities, operations from own")
def j2(spark, sf):
    return own_dense(Domain(spark, sf)).select("lga_code", "week_start", "events", "fatalities", "operations")


@query(
    "j3_neighbour_exposure",
    "select lga_code, week_start, round(nb_events, 6) as nb_events, round(nb_fatalities, 6) as nb_fatalities, round(nb_operations, 6) as nb_operations from dense",
)
def j3(spark, sf):
    return nb_dense(Domain(spark, sf)).select(
        "lga_code", "week_start", r6("nb_events", "nb_events"), r6("nb_fatalities", "nb_fatalities"), r6("nb_operations", "nb_operations")
    )


@query(
    "j4_attribute_lookups",
    """select i.event_id, i.lga_code, r.lga_name, r.state_name, r.zone, r.area_sqkm, w.week_index
       from incidents i left join registry r using (lga_code) left join weeks w on w.week_start = date_trunc('week', i.event_date)""",
)
def j4(spark, sf):
    d = Domain(spark, sf)
    registry = d.registry.select("lga_code", "lga_name", "state_name", "zone", "area_sqkm")
    index = F.when(WEEKS.contains(F.col("event_date")), WEEKS.index_of(F.col("event_date")).cast("long"))
    return d.incidents.select("event_id", "lga_code", index.alias("week_index")).join(registry, "lga_code", "left")


@query(
    "j13_document_units",
    "select doc_id, published_at, r.lga_code, r.lga_name from (select doc_id, published_at, unnest(lga_codes) as lga_code from docs) join registry r using (lga_code)",
)
def j13(spark, sf):
    d = Domain(spark, sf)
    return d.documents.select("doc_id", "published_at", F.explode("lga_codes").alias("lga_code")).join(
        d.registry.select("lga_code", "lga_name"), "lga_code"
    )


@query(
    "a1_weekly_events",
    "select lga_code, week_start, events, cast(fatalities as bigint) as fatalities, operations from weekly",
)
def a1(spark, sf):
    return p.weekly_events(Domain(spark, sf).incidents).withColumn("fatalities", F.col("fatalities").cast("long"))


@query(
    "a2_state_weekly_totals",
    "select lga_code, week_start, s_events as state_events, s_operations as state_operations from dense",
)
def a2(spark, sf):
    d = Domain(spark, sf)
    facts = p.merge_facts([p.weekly_events(d.incidents)], ("events", "operations"), WEEKS)
    totals = (
        facts.join(d.registry.select("lga_code", "state_name"), "lga_code")
        .groupBy("state_name", "week_index")
        .agg(F.sum("events").alias("state_events"), F.sum("operations").alias("state_operations"))
    )
    grid = p.unit_week_grid(d.registry, WEEKS).join(d.registry.select("lga_code", "state_name"), "lga_code")
    return grid.join(totals, ["state_name", "week_index"], "left").select(
        "lga_code", "week_start", F.coalesce("state_events", F.lit(0.0)).alias("state_events"),
        F.coalesce("state_operations", F.lit(0.0)).alias("state_operations"),
    )


@query("a3_distinct_actors", "select lga_code, week_start, actors from weekly_actors")
def a3(spark, sf):
    return p.weekly_actors(Domain(spark, sf).incidents)


@query("a4_document_mentions", "select lga_code, week_start, mentions, ransoms from weekly_docs")
def a4(spark, sf):
    return p.weekly_mentions(Domain(spark, sf).documents)


CHATTER_PARTS = {
    "weekly_chatter": """select lga_code, cast(date_trunc('week', posted_at) as date) as week_start, count(*) as volume,
        max(greatest(coalesce(threat_score, 0), 0)) as threat from chatter group by all""",
    "chatter_weeks": f"""select row_number() over (order by d) - 1 as week_index, cast(d as date) as week_start
        from (select unnest(generate_series(date '{CHATTER_WEEKS.first}', date '{CHATTER_WEEKS.last}', interval 7 day)) as d)""",
    "chatter_dense": """select r.lga_code, w.week_index, w.week_start, cast(coalesce(volume, 0) as double) as volume, coalesce(threat, 0) as threat
        from registry r cross join chatter_weeks w left join weekly_chatter c on c.lga_code = r.lga_code and c.week_start = w.week_start""",
}


@query("a5_chatter_weekly", "select lga_code, week_start, volume, round(threat, 6) as threat from weekly_chatter", CHATTER_PARTS)
def a5(spark, sf):
    return p.weekly_chatter(Domain(spark, sf).chatter).withColumn("threat", F.round("threat", 6))


@query(
    "a6_degree",
    """with k as (select c_custkey from customer) select concat('C', lpad(cast(a.c_custkey as string), 9, '0')) as lga_code, count(*) as n_neighbours
       from k a join k b on b.c_custkey in (a.c_custkey - 1, a.c_custkey + 1) group by all""",
)
def a6(spark, sf):
    return p.degree(Domain(spark, sf, large=True).adjacency)


W1 = {f"own_events_{n}w": ("events", n) for n in p.OWN_EVENT_WEEKS}
W2 = {f"own_fatalities_{n}w": ("fatalities", n) for n in p.OWN_FATALITY_WEEKS} | {f"own_ops_{n}w": ("operations", n) for n in p.OWN_OPERATION_WEEKS}
W3 = (
    {f"nb_events_{n}w": ("nb_events", n) for n in p.NEIGHBOUR_EVENT_WEEKS}
    | {f"nb_fatalities_{n}w": ("nb_fatalities", n) for n in p.NEIGHBOUR_FATALITY_WEEKS}
    | {f"nb_ops_{n}w": ("nb_operations", n) for n in p.NEIGHBOUR_OPERATION_WEEKS}
)


def lag_sql(spec: dict, table: str = "dense") -> str:
    return "select lga_code, week_start, " + ", ".join(f"round({lag(m, n)}, 6) as {c}" for c, (m, n) in spec.items()) + f" from {table}"


def lag_cols(spec: dict):
    return [r6(p.lag_sum(m, n), c) for c, (m, n) in spec.items()]


@query("w1_own_event_lags", lag_sql(W1))
def w1(spark, sf):
    return own_dense(Domain(spark, sf)).select("lga_code", "week_start", *lag_cols(W1))


@query("w2_own_fatality_operation_lags", lag_sql(W2))
def w2(spark, sf):
    return own_dense(Domain(spark, sf)).select("lga_code", "week_start", *lag_cols(W2))


@query("w3_neighbour_lags", lag_sql(W3))
def w3(spark, sf):
    return nb_dense(Domain(spark, sf)).select("lga_code", "week_start", *lag_cols(W3))


@query("w4_weeks_since", f"select lga_code, week_start, {since('events')} as weeks_since_event, {since('nb_events')} as weeks_since_nb_event from dense")
def w4(spark, sf):
    d = Domain(spark, sf)
    own = p.weekly_events(d.incidents)
    around = p.neighbour_sums(own, d.adjacency, {"events": "nb_events"})
    return p.dense_facts([own, around], d.registry, ("events", "nb_events"), WEEKS).select(
        "lga_code", "week_start", p.weeks_since("events").alias("weeks_since_event"), p.weeks_since("nb_events").alias("weeks_since_nb_event")
    )


@query(
    "w5_historical_rate",
    "select lga_code, week_start, round(coalesce(sum(events) over (partition by lga_code order by week_index rows between unbounded preceding and 1 preceding), 0) / (week_index + 1), 6) as hist_rate from own",
)
def w5(spark, sf):
    return own_dense(Domain(spark, sf)).select("lga_code", "week_start", r6(p.historical_rate(), "hist_rate"))


@query(
    "w6_state_lags",
    f"select lga_code, week_start, {lag('s_events', 4)} as state_events_4w, {lag('s_operations', 4)} as state_ops_4w from dense",
)
def w6(spark, sf):
    d = Domain(spark, sf)
    facts = p.merge_facts([p.weekly_events(d.incidents)], ("events", "operations"), WEEKS)
    states = p.state_features(facts, d.registry, WEEKS)
    grid = p.unit_week_grid(d.registry, WEEKS).join(d.registry.select("lga_code", "state_name"), "lga_code")
    return grid.join(states, ["state_name", "week_index"], "left").select("lga_code", "week_start", "state_events_4w", "state_ops_4w")


@query(
    "w7_actor_diversity",
    f"select lga_code, week_start, round({lag('actors', 26)} + {lag('nb_actors', 26)}, 6) as actors_26w from dense",
)
def w7(spark, sf):
    d = Domain(spark, sf)
    own = p.weekly_actors(d.incidents)
    around = p.neighbour_sums(own, d.adjacency, {"actors": "nb_actors"})
    dense = p.dense_facts([own, around], d.registry, ("actors", "nb_actors"), WEEKS)
    return dense.select("lga_code", "week_start", r6(p.lag_sum("actors", 26) + p.lag_sum("nb_actors", 26), "actors_26w"))


@query(
    "w7_true_distinct_actors",
    """select g.lga_code, g.week_start, cast(count(distinct coalesce(actor_secondary, actor_primary, 'unknown')) as double) as distinct_actors_26w
       from grid g left join incidents i on i.lga_code = g.lga_code and event_class = 'banditry_kidnapping'
       and i.event_date < g.week_start and i.event_date >= g.week_start - 182 and i.event_date >= date '1995-01-02' group by all""",
)
def w7b(spark, sf):
    d = Domain(spark, sf)
    return p.true_distinct_actors(d.incidents, d.registry, WEEKS).select("lga_code", "week_start", "distinct_actors_26w")


# The count above must ignore the no-match row of the outer join.
SQL["w7_true_distinct_actors"] = SQL["w7_true_distinct_actors"].replace(
    "count(distinct coalesce(actor_secondary, actor_primary, 'unknown'))",
    "count(distinct case when event_id is not null then coalesce(actor_secondary, actor_primary, 'unknown') end)",
)

W8D = {"doc_mentions_4w": ("mentions", 4), "doc_ransom_12w": ("ransoms", 12)}
W8C = {"chatter_volume_1w": ("volume", 1), "chatter_threat_1w": ("threat", 1)}


@query("w8_document_lags", lag_sql(W8D))
def w8d(spark, sf):
    d = Domain(spark, sf)
    return p.dense_facts([p.weekly_mentions(d.documents)], d.registry, ("mentions", "ransoms"), WEEKS).select("lga_code", "week_start", *lag_cols(W8D))


def chatter_dense(d: Domain):
    return p.dense_facts([p.weekly_chatter(d.chatter)], d.registry, ("volume", "threat"), CHATTER_WEEKS)


@query("w8_chatter_lags", lag_sql(W8C, "chatter_dense"), CHATTER_PARTS)
def w8c(spark, sf):
    return chatter_dense(Domain(spark, sf)).select("lga_code", "week_start", *lag_cols(W8C))


@query(
    "w9_chatter_escalation",
    f"select lga_code, week_start, round(case when {lag('volume', 8)} > 0 then {lag('volume', 1)} / ({lag('volume', 8)} / 8) else 0 end, 6) as chatter_escalation from chatter_dense",
    CHATTER_PARTS,
)
def w9(spark, sf):
    usual = p.lag_sum("volume", 8) / 8
    return chatter_dense(Domain(spark, sf)).select(
        "lga_code", "week_start", r6(F.when(usual > 0, p.lag_sum("volume", 1) / usual).otherwise(F.lit(0.0)), "chatter_escalation")
    )


@query("w12_label", "select lga_code, week_start, cast(events > 0 as integer) as label from own")
def w12(spark, sf):
    return own_dense(Domain(spark, sf)).select("lga_code", "week_start", p.label().alias("label"))


@query(
    "w13_statics",
    """select g.lga_code, g.week_start, g.area_sqkm, cast(n as double) as n_neighbours from grid g
       join (select lga_code, count(*) as n from adjacency where weight > 0 group by all) using (lga_code)""",
)
def w13(spark, sf):
    d = Domain(spark, sf)
    units = d.registry.select("lga_code", "area_sqkm").join(p.degree(d.adjacency), "lga_code", "left")
    weeks = F.explode(F.sequence(F.lit(0), F.lit(WEEKS.count - 1)))
    return units.withColumn("i", weeks).select(
        "lga_code", WEEKS.start_of(F.col("i")).alias("week_start"), "area_sqkm", F.coalesce("n_neighbours", F.lit(0)).cast("double").alias("n_neighbours")
    )


# ---------------------------------------------------------------- calendar
EASTER_SQL = """select y as year, make_date(y, cast(floor((h + l - 7 * m + 114) / 31) as int), cast((h + l - 7 * m + 114) % 31 + 1 as int)) as easter from (
  select *, cast(floor((a + 11 * h + 22 * l) / 451) as int) as m from (
  select *, (32 + 2 * e + 2 * i - h - k) % 7 as l from (
  select *, (19 * a + b - d - g + 15) % 30 as h, c // 4 as i, c % 4 as k from (
  select *, (b - f + 1) // 3 as g from (
  select y, y % 19 as a, y // 100 as b, y % 100 as c, (y // 100) // 4 as d, (y // 100) % 4 as e, (y // 100 + 8) // 25 as f from years)))))"""
CAL_PARTS = {
    "years": "select unnest(generate_series((select min(year(o_orderdate)) - 1 from orders), (select max(year(o_orderdate)) + 1 from orders))) as y",
    "easters": EASTER_SQL,
    "moon": """select y, label, date '1970-01-01' + cast((hd - 1) + (29 * (hm - 1) + hm // 2) + (hy - 1) * 354 + (3 + 11 * hy) // 30 + 1948439 - 2440588 as integer) as holiday, hy * 10 + p as pr
        from (select y, unnest(generate_series(h0 - 1, h0 + 1)) as hy from (select y, cast(trunc((date_diff('day', date '1970-01-01', make_date(cast(y as int), 1, 1)) + 2440588 - 1948439) / 354.367) as bigint) + 1 as h0 from years))
        cross join (values ('Eid al-Fitr', 10, 1, 1), ('Eid al-Adha', 12, 10, 2), ('Eid al-Mawlid', 3, 12, 3)) t(label, hm, hd, p)""",
    "civil": """select y, label, make_date(cast(y as int), mo, da) as holiday, 0 as pr from years cross join (values ('New Year', 1, 1), ('Workers Day', 5, 1), ('Independence Day', 10, 1), ('Christmas', 12, 25), ('Boxing Day', 12, 26)) t(label, mo, da)
        union all select y, 'Democracy Day', case when y >= 2019 then make_date(cast(y as int), 6, 12) else make_date(cast(y as int), 5, 29) end, 1 from years
        union all select year, 'Good Friday', easter - 2, 0 from easters union all select year, 'Easter Monday', easter + 1, 0 from easters""",
    "holidays": """select y as year, holiday, max_by(label, pr) as holiday_name from (select * from civil union all select * from moon where year(holiday) = y) group by all""",
    "order_days": "select cast(o_orderdate as date) as day, count(*) as orders_that_day from orders group by all",
    "festive": """select day, count(holiday) as n from (select distinct day from order_days) left join holidays on holiday between day - 1 and day + 8 group by all""",
}


def order_days(spark, sf):
    return Domain(spark, sf).table("orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders_that_day"))


def order_years(spark, sf):
    return cal.years_of(order_days(spark, sf), "day")


@query(
    "d1_easter",
    "select cast(year as integer) as year, easter, coalesce(orders_that_day, 0) as orders_that_day from easters left join order_days on day = easter",
    CAL_PARTS,
)
def d1(spark, sf):
    days = order_days(spark, sf)
    return cal.easter_by_year(order_years(spark, sf)).join(days, F.col("day") == F.col("easter"), "left").select(
        "year", "easter", F.coalesce("orders_that_day", F.lit(0)).alias("orders_that_day")
    )


@query(
    "d2_moon_festivals",
    "select cast(y as integer) as year, holiday, label as holiday_name, coalesce(orders_that_day, 0) as orders_that_day from moon left join order_days on day = holiday where year(holiday) = y",
    CAL_PARTS,
)
def d2(spark, sf):
    days = order_days(spark, sf)
    return cal.moon_festivals(order_years(spark, sf)).join(days, F.col("day") == F.col("holiday"), "left").select(
        "year", "holiday", "holiday_name", F.coalesce("orders_that_day", F.lit(0)).alias("orders_that_day")
    )


@query("d3_holidays", "select cast(year as integer) as year, holiday, holiday_name, coalesce(orders_that_day, 0) as orders_that_day from holidays left join order_days on day = holiday", CAL_PARTS)
def d3(spark, sf):
    days = order_days(spark, sf)
    return cal.holiday_table(order_years(spark, sf)).join(days, F.col("day") == F.col("holiday"), "left").select(
        "year", "holiday", "holiday_name", F.coalesce("orders_that_day", F.lit(0)).alias("orders_that_day")
    )


@query("d4_festival_flag", "select day, orders_that_day, cast(n > 0 as integer) as cal_festival_within_horizon from order_days join festive using (day)", CAL_PARTS)
def d4(spark, sf):
    return cal.festival_flags(order_days(spark, sf), cal.holiday_table(order_years(spark, sf)), "day").drop("cal_festival_name")


DAY_FLAGS_SQL = {
    "d5_dry_season": ("cal_dry_season", "cast(month(day) in (11, 12, 1, 2, 3) as integer)"),
    "d6_school_in_session": (
        "cal_school_in_session",
        """cast(not (month(day) = 8 or (month(day) = 7 and day(day) > 20) or (month(day) = 12 and day(day) > 15)
           or (month(day) = 1 and day(day) < 8) or (month(day) = 4 and day(day) <= 14)) as integer)""",
    ),
}


@query("d5_dry_season", f"select day, orders_that_day, {DAY_FLAGS_SQL['d5_dry_season'][1]} as cal_dry_season from order_days", CAL_PARTS)
def d5(spark, sf):
    return order_days(spark, sf).withColumn("cal_dry_season", cf.dry_season(F.col("day")))


@query("d6_school_in_session", f"select day, orders_that_day, {DAY_FLAGS_SQL['d6_school_in_session'][1]} as cal_school_in_session from order_days", CAL_PARTS)
def d6(spark, sf):
    return order_days(spark, sf).withColumn("cal_school_in_session", cf.school_in_session(F.col("day")))


@query("d7_week_and_month", "select day, orders_that_day, cast(weekofyear(day) as integer) as cal_week_of_year, cast(month(day) as integer) as cal_month from order_days", CAL_PARTS)
def d7(spark, sf):
    return order_days(spark, sf).select("day", "orders_that_day", F.weekofyear("day").alias("cal_week_of_year"), F.month("day").alias("cal_month"))


WEEK_CAL_PARTS = {
    **CAL_PARTS,
    "week_flags": "select week_start, week_index, cast(count(holiday) > 0 as integer) as cal_festival_within_horizon from weeks left join holidays on holiday between week_start - 1 and week_start + 8 group by all",
}


@query(
    "d8_calendar_join",
    """select e.event_id, w.cal_festival_within_horizon, cast(month(w.week_start) in (11, 12, 1, 2, 3) as integer) as cal_dry_season,
       cast(weekofyear(w.week_start) as integer) as cal_week_of_year, cast(month(w.week_start) as integer) as cal_month
       from incidents e join week_flags w on w.week_start = date_trunc('week', e.event_date)""",
    WEEK_CAL_PARTS,
)
def d8(spark, sf):
    d = Domain(spark, sf)
    weeks = cal.calendar_dimension(WEEKS.frame(spark))
    keyed = d.incidents.where(WEEKS.contains(F.col("event_date"))).select("event_id", p.week_start("event_date").alias("week_start"))
    return keyed.join(F.broadcast(weeks), "week_start").select(
        "event_id", "cal_festival_within_horizon", "cal_dry_season", "cal_week_of_year", "cal_month"
    )


FULL = {**W1, **W2, **W3, **W8D}
PANEL_SQL = (
    "select lga_code, week_start, state_name, "
    + ", ".join(f"round({lag(m, n)}, 6) as {c}" for c, (m, n) in FULL.items())
    + f""", {since('events')} as weeks_since_event, {since('nb_events')} as weeks_since_nb_event,
    round(coalesce(sum(events) over (partition by lga_code order by week_index rows between unbounded preceding and 1 preceding), 0) / (week_index + 1), 6) as hist_rate,
    {lag('s_events', 4)} as state_events_4w, {lag('s_operations', 4)} as state_ops_4w,
    round({lag('actors', 26)} + {lag('nb_actors', 26)}, 6) as actors_26w, area_sqkm, 2.0::double as n_neighbours,
    cal_festival_within_horizon, cast(month(week_start) as integer) as cal_month, cast(events > 0 as integer) as label
    from dense join week_flags using (week_start, week_index)"""
)


@query("panel_full", PANEL_SQL, WEEK_CAL_PARTS)
def panel_full(spark, sf):
    d = Domain(spark, sf)
    panel = features.build_panel(d.incidents, d.registry, d.adjacency, WEEKS, d.documents)
    rounded = [*FULL, "hist_rate", "actors_26w"]
    plain = ["weeks_since_event", "weeks_since_nb_event", "state_events_4w", "state_ops_4w", "area_sqkm", "n_neighbours",
             "cal_festival_within_horizon", "cal_month", "label"]
    return panel.select("lga_code", "week_start", "state_name", *[r6(c, c) for c in rounded], *plain)
