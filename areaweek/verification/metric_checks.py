"""Metric, split and baseline queries on scores derived from the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import TRAIN_END, VALID_END, WEEKS, Domain
from ..operators import gate
from ..operators import metrics as m
from ..operators import panel as p
from .panel_checks import own_dense, r6
from .sql import compose, lag

QUERIES: dict = {}
SQL: dict[str, str] = {}

PARTS = {
    "features": f"""select lga_code, week_start, state_name, week_index, {lag('events', 1)} as own_events_1w, {lag('events', 52)} as own_events_52w,
        {lag('fatalities', 12)} as own_fatalities_12w, {lag('operations', 4)} as own_ops_4w, cast(events > 0 as integer) as label from own""",
    "scored": """select 'persistence' as model, week_start, lga_code, cast(own_events_1w as double) as score, label from features
        union all select 'historical_rate', week_start, lga_code, cast(own_events_52w as double), label from features""",
    "ranked": "select *, row_number() over (partition by model, week_start order by score desc, lga_code) as rank from scored",
    "week_stats": "select model, week_start, count(*) as rows, sum(label) as positives from scored group by all",
    "ks": "select unnest([5, 10, 15, 20, 30, 40, 50, 75, 100, 150, 200]) as k",
    "hits": """select model, week_start, k, count(*) as listed, sum(label) as hits, any_value(rows) as rows, any_value(positives) as positives
        from ranked join ks on rank <= k join week_stats using (model, week_start) group by all""",
    "curve": """select model, score, n, pos, sum(n) over w as cum_n, sum(pos) over w as cum_pos from
        (select model, score, count(*) as n, sum(label) as pos from scored group by all) window w as (partition by model order by score desc)""",
    "sizes": "select model, count(*) as rows, sum(label) as positives from scored group by all",
    "buckets": """select *, greatest(cast(ceil((r - 1) * 10.0 / (n - 1)) as bigint) - 1, 0) as bucket from (
        select model, week_start, lga_code, greatest(least(score, 1.0), 0.0) as score, label,
        row_number() over (partition by model order by greatest(least(score, 1.0), 0.0), week_start, lga_code) as r, count(*) over (partition by model) as n from scored)""",
}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, PARTS)
        return fn

    return add


def small_features(spark, sf):
    return own_dense(Domain(spark, sf)).select(
        "lga_code", "week_start", "week_index", p.lag_sum("events", 1).alias("own_events_1w"), p.lag_sum("events", 52).alias("own_events_52w"),
        p.lag_sum("fatalities", 12).alias("own_fatalities_12w"), p.lag_sum("operations", 4).alias("own_ops_4w"), p.label().alias("label"),
    )


def scored(spark, sf):
    own = {name: m.BASELINES[name] for name in ("persistence", "historical_rate")}
    return m.baseline_scores(small_features(spark, sf), own)


@query("m13_baseline_scores", "select model, week_start, lga_code, score, label from scored")
def m13(spark, sf):
    return scored(spark, sf)


@query("k2_top_k_in_week", "select model, week_start, lga_code, score, rank from ranked where rank <= 5")
def k2(spark, sf):
    return m.top_k_in_week(scored(spark, sf), 5).select("model", "week_start", "lga_code", "score", "rank")


@query("m7_equal_count_bucket", "select model, week_start, lga_code, bucket from buckets")
def m7(spark, sf):
    clip = scored(spark, sf).withColumn("score", m.clipped())
    return m.with_bucket(clip).select("model", "week_start", "lga_code", "bucket")


@query(
    "m8_precision_recall_lift",
    """select model, k, round(avg(hits / listed), 6) as precision, round(avg(case when positives > 0 then hits / positives end), 6) as recall,
       round(avg(case when positives > 0 then (hits / listed) / (positives / rows) end), 6) as lift from hits where k in (10, 20, 50) group by all""",
)
def m8(spark, sf):
    return m.at_k(scored(spark, sf)).select("model", "k", r6("precision", "precision"), r6("recall", "recall"), r6("lift", "lift"))


AUC = "sum(pos * ((rows - positives) - (cum_n - cum_pos) + (n - pos) / 2)) / (any_value(positives) * (any_value(rows) - any_value(positives)))"
AP = "sum(pos * cum_pos / cum_n) / any_value(positives)"


@query("m9_roc_auc", f"select model, round({AUC}, 6) as roc_auc from curve join sizes using (model) group by model")
def m9(spark, sf):
    return m.curve_metrics(scored(spark, sf)).select("model", r6("roc_auc", "roc_auc"))


@query("m10_average_precision", f"select model, round({AP}, 6) as average_precision from curve join sizes using (model) group by model")
def m10(spark, sf):
    return m.curve_metrics(scored(spark, sf)).select("model", r6("average_precision", "average_precision"))


BRIER = "avg(pow(greatest(least(score, 1.0), 0.0) - label, 2))"


@query("m11_brier", f"select model, round({BRIER}, 6) as brier from scored group by model")
def m11(spark, sf):
    return m.brier(scored(spark, sf)).select("model", r6("brier", "brier"))


@query(
    "m12_evaluate",
    f"""with c as (select model, {AUC} as roc_auc, {AP} as average_precision from curve join sizes using (model) group by model),
        b as (select model, {BRIER} as brier, count(*) as rows, cast(sum(label) as bigint) as positives from scored group by model),
        k as (select model, """
    + ", ".join(
        f"avg(case when k = {k} then hits / listed end) as precision_at_{k}, avg(case when k = {k} and positives > 0 then hits / positives end) as recall_at_{k}, "
        f"avg(case when k = {k} and positives > 0 then (hits / listed) / (positives / rows) end) as lift_at_{k}"
        for k in (10, 20, 50)
    )
    + """ from hits group by model)
        select model, rows, positives, round(roc_auc, 6) as roc_auc, round(average_precision, 6) as average_precision, round(brier, 6) as brier, """
    + ", ".join(f"round({x}_at_{k}, 6) as {x}_at_{k}" for k in (10, 20, 50) for x in ("precision", "recall", "lift"))
    + " from c join b using (model) join k using (model)",
)
def m12(spark, sf):
    table = m.evaluate(scored(spark, sf))
    exact = ("model", "rows", "positives")
    return table.select(*exact, *[r6(c, c) for c in table.columns if c not in exact])


@query("m18_coverage_curve", "select model, k, round(avg(case when positives > 0 then hits / positives end), 6) as recall from hits group by all")
def m18(spark, sf):
    return m.coverage_curve(scored(spark, sf)).withColumn("recall", F.round("recall", 6))


@query(
    "a14_calibration_table",
    """select model, bucket, count(*) as rows, round(avg(score), 6) as predicted, round(avg(label), 6) as observed,
       round(avg(label) - avg(score), 6) as gap from buckets group by all""",
)
def a14(spark, sf):
    return m.calibration_table(scored(spark, sf)).select(
        "model", "bucket", "rows", r6("predicted", "predicted"), r6("observed", "observed"), r6("gap", "gap")
    )


@query("a17_weekly_capture", "select model, week_start, cast(positives as bigint) as attacked, cast(hits as bigint) as caught from hits where k = 20")
def a17(spark, sf):
    return m.weekly_capture(scored(spark, sf))


@query("a17_missed_weeks", "select model, count(*) as weeks, count(*) filter (hits = 0) as weeks_without_hit from hits where k = 20 group by model")
def a17b(spark, sf):
    return m.missed_weeks(scored(spark, sf))


FOLD = f"case when week_start <= date '{TRAIN_END}' then 'train' when week_start <= date '{VALID_END}' then 'valid' else 'test' end"


@query("m1_temporal_split", f"select lga_code, week_start, label, {FOLD} as fold from features")
def m1(spark, sf):
    return gate.temporal_split(small_features(spark, sf), TRAIN_END, VALID_END).select("lga_code", "week_start", "label", "fold")


@query(
    "a12_split_description",
    f"select {FOLD} as fold, count(*) as rows, cast(sum(label) as bigint) as positives, min(week_start) as first_week, max(week_start) as last_week from features group by all",
)
def a12(spark, sf):
    return gate.describe_split(gate.temporal_split(small_features(spark, sf), TRAIN_END, VALID_END))


@query(
    "m2_split_guard",
    f"""select fold, rows, positives, cast(case fold when 'train' then 200 else 20 end as bigint) as minimum,
        positives >= case fold when 'train' then 200 else 20 end as enough
        from (select {FOLD} as fold, count(*) as rows, cast(sum(label) as bigint) as positives from features group by all)""",
)
def m2(spark, sf):
    return gate.split_check(gate.temporal_split(small_features(spark, sf), TRAIN_END, VALID_END))


COVERED = ("own_events_1w", "own_events_52w", "own_fatalities_12w", "own_ops_4w")
COVERAGE_SQL = " union all ".join(
    f"""select '{c}' as feature, round(avg(case when {c} <> 0 then 1.0 else 0 end) filter (week_start <= date '{TRAIN_END}'), 6) as train_coverage,
    round(avg(case when {c} <> 0 then 1.0 else 0 end) filter (week_start > date '{WEEKS.last}' - 182), 6) as recent_coverage,
    round(stddev_samp({c}), 6) as spread from features"""
    for c in COVERED
)


@query("a13_feature_coverage", COVERAGE_SQL)
def a13(spark, sf):
    table = gate.coverage(small_features(spark, sf), COVERED, TRAIN_END)
    return table.select("feature", r6("train_coverage", "train_coverage"), r6("recent_coverage", "recent_coverage"), r6("spread", "spread"))


@query(
    "m3_feature_gate",
    f"""select feature, round(train_coverage, 6) as train_coverage, round(recent_coverage, 6) as recent_coverage,
        not (coalesce(spread, 0) = 0 or (train_coverage < 0.01 and recent_coverage > 5 * train_coverage)) as in_model,
        case when coalesce(spread, 0) = 0 then 'constant' when train_coverage < 0.01 and recent_coverage > 5 * train_coverage then 'train-serve skew' else '' end as excluded_because
        from ({COVERAGE_SQL})""",
)
def m3(spark, sf):
    table = gate.feature_gate(gate.coverage(small_features(spark, sf), COVERED, TRAIN_END))
    return table.select("feature", r6("train_coverage", "train_coverage"), r6("recent_coverage", "recent_coverage"), "in_model", "excluded_because")
