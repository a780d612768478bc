"""Point-process queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import FIT_END, WEEKS, Domain
from ..operators import panel as p
from ..operators import pointprocess as pp
from .panel_checks import r6
from .sql import compose

QUERIES: dict = {}
SQL: dict[str, str] = {}

SPAN = pp.horizon_days(WEEKS, FIT_END)
PAR = pp.HawkesParameters(mu_scale=0.6, branching=0.5, self_share=0.8, decay=0.03)
CANDIDATES = [
    pp.HawkesParameters(mu, rho, phi, 0.03) for mu in (0.4, 0.6, 1.0) for rho in (0.2, 0.5, 0.8) for phi in (0.5, 0.8)
]

PARTS = {
    "days": f"""select lga_code, cast(event_date - date '{WEEKS.first}' as integer) as day, count(*) as n from incidents
        where event_class = 'banditry_kidnapping' and event_date between date '{WEEKS.first}' and date '{FIT_END}' group by all""",
    "all_days": f"""select lga_code, cast(event_date - date '{WEEKS.first}' as integer) as day, count(*) as n from incidents
        where event_class = 'banditry_kidnapping' and event_date between date '{WEEKS.first}' and date '{WEEKS.last}' group by all""",
    "rates": f"select r.lga_code, (coalesce(sum(n), 0) + 0.5) / {SPAN} as base_rate from registry r left join days d using (lga_code) group by all",
    "week_r": f"""select r.lga_code, w.week_index, w.week_start, coalesce(sum(d.n * exp(-0.03 * (w.week_index * 7 - d.day))), 0) as r
        from registry r cross join weeks w left join all_days d on d.lga_code = r.lga_code and d.day < w.week_index * 7 group by all""",
    "week_rn": "select e.lga_code, week_start, sum(weight * r) as rn from adjacency e join week_r on week_r.lga_code = e.neighbour_code group by all",
    "pairs": """select a.lga_code, a.day, any_value(a.n) as n, coalesce(sum(b.n * exp(-0.03 * (a.day - b.day))) filter (b.lga_code = a.lga_code), 0) as own_r,
        coalesce(sum(b.n * exp(-0.03 * (a.day - b.day)) * e.weight) filter (b.lga_code <> a.lga_code), 0) as nb_r
        from days a left join days b on b.day < a.day left join adjacency e on e.lga_code = a.lga_code and e.neighbour_code = b.lga_code
        group by a.lga_code, a.day""",
    "comp": f"select lga_code, sum(n * (1 - exp(-0.03 * ({SPAN} - day)))) as compensator from days group by all",
    "params": "select row_number() over (order by mu, rho, phi) - 1 as candidate, mu, rho * phi as a_s, rho * (1 - phi) as a_n "
    "from (values (0.4), (0.6), (1.0)) a(mu), (values (0.2), (0.5), (0.8)) b(rho), (values (0.5), (0.8)) c(phi)",
}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, PARTS)
        return fn

    return add


@query("h1_event_time_index", "select lga_code, day, n from days")
def h1(spark, sf):
    return pp.target_days(Domain(spark, sf).incidents, WEEKS, FIT_END)


@query("h2_baseline_rate", "select lga_code, round(base_rate, 9) as base_rate from rates")
def h2(spark, sf):
    d = Domain(spark, sf)
    return pp.baseline_rates(d.incidents, d.registry, WEEKS, FIT_END).withColumn("base_rate", F.round("base_rate", 9))


@query("h3_decay_sums", "select lga_code, week_start, round(r, 6) as decay_sum from week_r")
def h3(spark, sf):
    d = Domain(spark, sf)
    evaluation = p.unit_week_grid(d.registry, WEEKS).select("lga_code", (F.col("week_index") * 7).alias("day"))
    points = pp.with_evaluation_days(pp.target_days(d.incidents, WEEKS), evaluation)
    summed = pp.decay_sums(points, PAR.decay, pp.horizon_days(WEEKS))
    return summed.where("wanted = 1").select("lga_code", WEEKS.start_of(F.col("day") / 7).alias("week_start"), r6("decay_sum", "decay_sum"))


@query(
    "h3_fast_decay",
    f"""select u.lga_code, decay, round(sum(d.n * exp(-decay * (w.week_index * 7 - d.day))), 9) as decay_sum, count(*) as terms
        from registry u cross join weeks w cross join (values (0.4::double), (2.0::double)) t(decay) join all_days d on d.lga_code = u.lga_code and d.day < w.week_index * 7
        where w.week_index % 8 = 0 group by all""",
)
def h3b(spark, sf):
    """Decay times span far above what one exponential can hold; every earlier day is a term."""
    d = Domain(spark, sf)
    evaluation = p.unit_week_grid(d.registry, WEEKS).where("week_index % 8 = 0").select("lga_code", (F.col("week_index") * 7).alias("day"))
    points = pp.with_evaluation_days(pp.target_days(d.incidents, WEEKS), evaluation)
    earlier = F.count_if(F.col("n") > 0).over(Window.partitionBy("lga_code").orderBy("day").rangeBetween(Window.unboundedPreceding, -1))
    out = None
    for decay in (0.4, 2.0):
        rows = pp.decay_sums(points, decay, pp.horizon_days(WEEKS)).withColumn("terms", earlier).where("wanted = 1 and terms > 0")
        rows = rows.groupBy("lga_code").agg(F.round(F.sum("decay_sum"), 9).alias("decay_sum"), F.sum("terms").alias("terms")).withColumn("decay", F.lit(decay))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("h4_neighbour_decay_sums", "select lga_code, week_start, round(rn, 6) as nb_decay_sum from week_rn")
def h4(spark, sf):
    d = Domain(spark, sf)
    evaluation = p.unit_week_grid(d.registry, WEEKS).select("lga_code", (F.col("week_index") * 7).alias("day"))
    points = pp.with_evaluation_days(pp.target_days(d.incidents, WEEKS), evaluation)
    own = pp.decay_sums(points, PAR.decay, pp.horizon_days(WEEKS)).where("wanted = 1")
    around = pp.neighbour_decay_sums(own, d.adjacency)
    return around.select("lga_code", WEEKS.start_of(F.col("day") / 7).alias("week_start"), r6("nb_decay_sum", "nb_decay_sum"))


@query("h5_compensator", "select lga_code, round(compensator, 6) as compensator from comp")
def h5(spark, sf):
    d = Domain(spark, sf)
    return pp.compensator(pp.target_days(d.incidents, WEEKS, FIT_END), PAR.decay, SPAN).withColumn("compensator", F.round("compensator", 6))


@query(
    "h6_log_likelihood",
    f"""select candidate, round(sum(n * ln(greatest(mu * base_rate + a_s * 0.03 * own_r + a_n * 0.03 * nb_r, 1e-12)))
        - (any_value(mu) * (select sum(base_rate) from rates) * {SPAN} + any_value(a_s) * (select sum(compensator) from comp)
           + any_value(a_n) * (select sum(weight * compensator) from adjacency e join comp c on c.lga_code = e.neighbour_code)), 4) as log_likelihood
        from pairs join rates using (lga_code) cross join params group by candidate""",
)
def h6(spark, sf):
    d = Domain(spark, sf)
    events = pp.target_days(d.incidents, WEEKS, FIT_END)
    rates = pp.baseline_rates(d.incidents, d.registry, WEEKS, FIT_END)
    terms = pp.event_terms(events, d.adjacency, rates, PAR.decay, SPAN)
    totals = pp.compensator_totals(events, d.adjacency, rates, PAR.decay, SPAN)
    return pp.log_likelihood(terms, totals, CANDIDATES).select(
        F.col("candidate").cast("long").alias("candidate"), F.round("log_likelihood", 4).alias("log_likelihood")
    )


@query("h7_parameter_fit")
def h7(spark, sf):
    d = Domain(spark, sf)
    fitted = pp.fit(d.incidents, d.registry, d.adjacency, WEEKS, FIT_END)
    return pp.fit_summary(spark, fitted, pp.target_days(d.incidents, WEEKS, FIT_END), d.registry)


H8_SQL = """select lga_code, week_start, round(mu, 6) as hawkes_background, round(s, 6) as hawkes_self, round(nb, 6) as hawkes_neighbour,
    round(mu + s + nb, 6) as hawkes_total, round(s / greatest(mu + s + nb, 1e-12), 6) as hawkes_self_share, round(nb / greatest(mu + s + nb, 1e-12), 6) as hawkes_neighbour_share,
    round(expected, 6) as hawkes_expected_events, round(1 - exp(-greatest(expected, 0)), 6) as hawkes_prob_any
    from (select lga_code, week_start, 0.6 * base_rate as mu, 0.4 * 0.03 * r as s, 0.1 * 0.03 * rn as nb,
          0.6 * base_rate * 7 + (0.4 * r + 0.1 * rn) * (1 - exp(-0.21)) as expected
          from week_r join week_rn using (lga_code, week_start) join rates using (lga_code))"""


@query("h8_intensity_features", H8_SQL)
def h8(spark, sf):
    d = Domain(spark, sf)
    own = pp.weekly_mass(d.incidents, WEEKS, PAR.decay)
    around = p.neighbour_sums(own, d.adjacency, {"mass": "nb_mass"})
    units = d.registry.select("lga_code").join(pp.baseline_rates(d.incidents, d.registry, WEEKS, FIT_END), "lga_code")
    dense = p.densify(p.merge_facts([own, around], ("mass", "nb_mass"), WEEKS), units, ("mass", "nb_mass"), WEEKS, ["base_rate"])
    summed = dense.select(
        "lga_code", "week_start", "base_rate",
        pp.weekly_decay_sum("mass", PAR.decay, WEEKS.count).alias("own"), pp.weekly_decay_sum("nb_mass", PAR.decay, WEEKS.count).alias("around"),
    )
    wide = summed.select("lga_code", "week_start", *pp.intensity_columns(PAR, F.col("base_rate"), F.col("own"), F.col("around")))
    return wide.select("lga_code", "week_start", *[r6(c, c) for c in wide.columns[2:]])


@query(
    "h9_fit_summary",
    f"""select round(ln(2) / 0.03, 6) as half_life_days, cast(0.4 as double) as alpha_self, cast(0.1 as double) as alpha_neighbour,
        (select cast(sum(n) as bigint) from days) as n_events, (select count(*) from registry) as n_dimensions""",
)
def h9(spark, sf):
    d = Domain(spark, sf)
    row = pp.fit_summary(spark, PAR, pp.target_days(d.incidents, WEEKS, FIT_END), d.registry)
    return row.select(r6("half_life_days", "half_life_days"), r6("alpha_self", "alpha_self"), r6("alpha_neighbour", "alpha_neighbour"), "n_events", "n_dimensions")
