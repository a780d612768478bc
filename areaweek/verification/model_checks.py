"""Fitted-model queries. Those of boosted trees have no SQL twins; the tests hold their invariants."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..fixtures import FIT_END, TRAIN_END, VALID_END, WEEKS, Domain
from ..operators import explain, isotonic
from ..operators import model as md
from ..operators.pointprocess import HawkesParameters
from ..plans import features, runs
from ..schemas import MODEL_RUNS, PREDICTIONS
from ..session import gathered, work_path
from ..sources import tables as tb

QUERIES: dict = {}
SQL: dict[str, str] = {}

PAR = HawkesParameters(mu_scale=0.6, branching=0.5, self_share=0.8, decay=0.03)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def panel(spark, sf):
    d = Domain(spark, sf)
    # Written once: training and scoring both read it, the latter several times.
    return gathered(features.build_panel(d.incidents, d.registry, d.adjacency, WEEKS, d.documents, hawkes=PAR, fit_end=FIT_END))


def folded(spark, sf):
    return runs.prepare(panel(spark, sf), TRAIN_END, VALID_END)


def trained(spark, sf):
    frame = panel(spark, sf)
    return runs.train_run(frame, "run-check", TRAIN_END, VALID_END), frame


@query("m4_boosted_classifier")
def m4(spark, sf):
    rows, names, _ = folded(spark, sf)
    booster = md.fit_booster(rows, names)
    scored = md.raw_scores(booster, rows, names)
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg("raw").alias("mean_score"), F.avg("label").alias("rate"))


@query("m5_calibration")
def m5(spark, sf):
    rows, names, _ = folded(spark, sf)
    fitted = md.train(rows, names)
    return md.score(fitted, rows.where("fold = 'test'")).select("lga_code", "week_start", "raw", "probability")


@query(
    "m5_isotonic_fit",
    """with points as (select cast(floor(l_extendedprice / 600) as double) as feature, avg(case when l_returnflag = 'R' then 1.0 else 0.0 end) as label, count(*) as weight from lineitem group by 1),
    sums as (select *, row_number() over o as i, sum(label * weight) over o as s, sum(weight) over o as w from points window o as (order by feature)),
    runs as (select a.i as j, b.i as k, (b.s - a.s + a.label * a.weight) / (b.w - a.w + a.weight) as mean from sums a join sums b on a.i <= b.i),
    lowest as (select r.j, p.i, min(r.mean) as mean from runs r join sums p on r.j <= p.i and r.k >= p.i group by all)
    select feature, round(max(mean), 9) as fitted from lowest join sums using (i) group by all""",
)
def m5b(spark, sf):
    """Share of returned lines by price, fitted in ranges of 16 steps, as the greatest of the least means."""
    lines = Domain(spark, sf).table("lineitem")
    points = lines.groupBy(F.floor(F.col("l_extendedprice") / 600).cast("double").alias("feature")).agg(
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    steps = isotonic.pooled(points, range_blocks=16)
    at = points.join(steps, (F.col("feature") >= F.col("low")) & (F.col("feature") <= F.col("high")))
    return at.select("feature", F.round("mean", 9).alias("fitted"))


@query("m12_model_comparison")
def m12(spark, sf):
    run, _ = trained(spark, sf)
    return run.comparison


@query("m14_grid_sweep")
def m14(spark, sf):
    rows, names, _ = folded(spark, sf)
    return md.sweep(rows, names)


@query("m15_score_week")
def m15(spark, sf):
    run, frame = trained(spark, sf)
    return runs.score_week(run, frame).select("run_id", "lga_code", "week_start", "probability", "risk_tier", "rank_national", "rank_state")


@query("m16_tree_attributions")
def m16(spark, sf):
    run, frame = trained(spark, sf)
    drivers, _ = runs.week_drivers(run, runs.score_week(run, frame))
    return drivers


@query("m16_additivity", "select count(*) as rows, 0 as violations from nation")
def m16b(spark, sf):
    """Units of the last week whose attributions and the base value do not add up to the raw margin."""
    rows, names, _ = folded(spark, sf)
    booster = md.fit_booster(rows, names)
    leaves, base = explain.ensemble_leaves(booster, names)
    last = rows.where(F.col("week_start") == rows.agg(F.max("week_start")).first()[0]).fillna(0.0, names)
    margins = booster.transform(md.as_vectors(last, names)).select("lga_code", vector_to_array("rawPrediction")[1].alias("margin"))
    added = explain.leaf_attributions(leaves, last, names).groupBy("lga_code").agg((F.sum("shap_value") + base).alias("added"))
    wrong = F.coalesce(F.abs(F.col("added") - F.col("margin")) > 1e-6, F.lit(True))
    return margins.join(added, "lga_code", "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(wrong).cast("int").alias("violations"))


@query("m19_stored_run")
def m19(spark, sf):
    """Run record and predictions upserted twice; the second write changes nothing."""
    run, frame = trained(spark, sf)
    scored = runs.score_week(run, frame).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTIONS.fields])
    record = runs.run_record(run, "2001-08-01 05:00:00", "boosted-1", TRAIN_END)
    table, book = work_path(spark, "predictions"), work_path(spark, "runs")
    for _ in range(2):
        tb.upsert(spark, table, "predictions", scored)
        tb.upsert(spark, book, "model_runs", record, order=("created_at",))
    return tb.read_table(spark, table, PREDICTIONS).join(tb.read_table(spark, book, MODEL_RUNS).select("run_id", "metrics"), "run_id")


@query("s10_model_roundtrip")
def s10(spark, sf):
    rows, names, _ = folded(spark, sf)
    fitted = md.train(rows, names)
    path = work_path(spark, "model")
    md.save(fitted, path, rows.agg(F.max("week_start").alias("last_week")))
    again = md.load(spark, path)
    test = rows.where("fold = 'test'")
    both = md.score(fitted, test).select("lga_code", "week_start", F.col("probability").alias("before")).join(
        md.score(again, test).select("lga_code", "week_start", F.col("probability").alias("after")), ["lga_code", "week_start"]
    )
    return both.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_change"))
