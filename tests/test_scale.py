"""Work that must not grow with the number of pieces a small table comes in."""

import datetime as dt
import re
import threading

from pyspark.sql import functions as F

from areaweek.fixtures import Domain
from areaweek.operators import gate
from areaweek.operators import model as md
from areaweek.operators import places as pl
from areaweek.plans import runs
from areaweek.session import gathered, stored


def test_gathered_keeps_all_rows_in_one_wave_of_tasks(spark):
    rows = gathered(spark.range(1000).repartition(40))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows.agg(F.count("id"), F.sum("id")).first()[:] == (1000, 499500)


def test_prepared_panel_keeps_its_pieces_for_the_fits_and_a_week_is_scored_in_one_wave(spark, monkeypatch):
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=7 * i) for i in range(60)]
    panel = spark.createDataFrame([(f"U{u}", d, float(u + i), int(i % 2)) for u in range(5) for i, d in enumerate(days)], "lga_code string, week_start date, own_events_1w double, label int")
    folded, features, _ = runs.prepare(panel.repartition(30, "lga_code"), "2000-08-01", "2000-12-01")
    assert folded.rdd.getNumPartitions() == 30
    seen = []
    monkeypatch.setattr(runs.model, "score", lambda _, rows: seen.append(rows) or rows)
    monkeypatch.setattr(runs.scoring, "assign_tiers", lambda rows, _: rows)
    monkeypatch.setattr(runs.scoring, "rank_units", lambda rows: rows)
    week = runs.score_week(runs.TrainedRun("r", None, None, None, None, None), folded)
    assert week.count() == 5 and seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert folded.count() == 300 and features == ["own_events_1w"]
    assert {r.fold: r.rows for r in gate.describe_split(folded).collect()} == {"train": 155, "valid": 85, "test": 60}


def test_sweep_fits_several_candidates_at_a_time(spark, monkeypatch):
    rows = [("valid", f"U{i}", dt.date(2000, 1, 3), i % 2) for i in range(40)]
    folded = spark.createDataFrame(rows, "fold string, lga_code string, week_start date, label int")
    together = threading.Barrier(2, timeout=20)

    class Fitted:
        def __init__(self, depth):
            self.depth, self.getNumTrees = depth, 10 * depth

    def fit(frame, features, trees, depth):
        together.wait()
        return Fitted(depth)

    # The deeper candidate ranks the positives first, the other one last.
    scored = lambda b, frame, features: frame.withColumn("raw", F.col("label") * (1.0 if b.depth == 4 else -1.0))
    monkeypatch.setattr(md, "fit_booster", fit)
    monkeypatch.setattr(md, "raw_scores", scored)
    out = md.sweep(folded, [], grid={"depth": (3, 4)}, trees=5)
    assert out.columns == ["depth", "trees", "roc_auc", "average_precision", "recall_at_20", "precision_at_20", "recall_at_50"]
    first, second = out.collect()
    assert (first.depth, first.trees, first.roc_auc, first.recall_at_20) == ("4", 40, 1.0, 1.0)
    assert (second.depth, second.trees, second.roc_auc, second.recall_at_20) == ("3", 30, 0.0, 0.0)


def _panel(spark, pieces):
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=7 * i) for i in range(40)]
    rows = [(f"U{u}", d, "valid" if i >= 30 else "train", float((u * 7 + i * 3) % 11), float((u * i) % 5), int((u * 7 + i * 3) % 11 > 6 or (u + i) % 9 == 0)) for u in range(20) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "lga_code string, week_start date, fold string, a double, b double, label int").repartition(pieces)


def test_a_fit_has_few_pieces_and_the_same_trees_however_its_rows_come(spark):
    placed = md.fit_pieces(_panel(spark, 60))
    assert placed.rdd.getNumPartitions() == md.FIT_PIECES and placed.count() == 800
    trees = [md.fit_booster(_panel(spark, n), ["a", "b"], trees=2, depth=3, min_child=2).toDebugString.split("\n", 1)[1] for n in (3, 60)]
    assert trees[0] == trees[1]


def test_a_sweep_makes_its_vectors_once(spark, monkeypatch):
    seen = []
    assembled = md.VectorAssembler.transform
    monkeypatch.setattr(md.VectorAssembler, "transform", lambda self, rows: seen.append(self.getInputCols()) or assembled(self, rows))
    out = md.sweep(_panel(spark, 6), ["a", "b"], grid={"depth": (2, 3), "min_child": (2,)}, trees=2)
    assert out.count() == 2 and seen == [["a", "b"]]


def _names(spark):
    return spark.createDataFrame([("A", "Obira", "Lomo"), ("B", "Obira", "Kede"), ("C", "Danko", "Lomo")], "lga_code string, lga_name string, state_name string")


def test_mentions_are_dealt_by_text_alone(spark):
    said = [("t", "obira"), ("t", "lomo"), ("u", "obira"), ("u", "danko"), (None, "danko"), (None, "obira"), ("v", "lomo"), ("w", "obira"), ("w", "lomo"), ("w", "kede")]
    found = pl.resolve_units(spark.createDataFrame(said, "text_id string, surface string"), _names(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin [surface") >= 3 and not re.search(r"SortMergeJoin \[text_id#\d+, state_name", plan)
    want = {("t", "A", 0.9), ("u", "A", 0.25), ("u", "B", 0.25), ("u", "C", 0.95), (None, "C", 0.95), ("w", "A", 0.25), ("w", "B", 0.25)}
    assert {(r.text_id, r.lga_code, r.confidence) for r in found.collect()} == want


def test_many_names_meet_the_mentions_over_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(pl, "NAMES_SENT", 0)
    texts = spark.createDataFrame([("t", "obira in lomo"), ("u", "danko"), ("v", None)], "text_id string, norm string")
    found = pl.resolve_units(pl.all_mentions(texts, _names(spark)), _names(spark))
    assert {(r.text_id, r.lga_code, r.confidence) for r in found.collect()} == {("t", "A", 0.9), ("u", "C", 0.95)}


def test_facts_are_joined_with_their_places_by_text_once(spark):
    texts = spark.createDataFrame([("t", "Obira in Lomo"), ("t", "nothing"), ("s", "Kede"), (None, "Danko"), ("e", None)], "text_id string, text string")
    found = pl.extract_facts(texts, _names(spark))
    assert "coalesce(text_id" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.text_id, r.text, r.lga_codes, r.states, r.confidence) for r in found.collect()), key=str)
    assert got == sorted([("t", "Obira in Lomo", ["A"], ["Lomo"], 0.9), ("t", "nothing", ["A"], ["Lomo"], 0.9), ("s", "Kede", [], ["Kede"], 0.0), (None, "Danko", [], [], 0.0), ("e", None, [], [], 0.0)], key=str)


def test_stored_rows_come_back_as_they_are(spark):
    rows = spark.createDataFrame([(1, ["a", None], None, dt.date(1500, 1, 2), float("nan")), (None, [], "\u00e9", None, -0.0)], "i long, w array<string>, s string, d date, x double")
    assert sorted(map(repr, stored(rows).collect())) == sorted(map(repr, rows.collect())) and stored(rows).dtypes == rows.dtypes
    assert stored(rows.limit(0)).count() == 0


def test_order_lines_are_dealt_once(spark, tmp_path):
    tables = {
        "region": ([(1, "ASIA")], "r_regionkey int, r_name string"), "nation": ([(7, "INDIA", 1), (8, "JAPAN", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 7), (2, 8)], "c_custkey long, c_nationkey int"), "orders": ([(10, 1, 5.5), (12, 2, 7.0), (14, 3, 1.0)], "o_orderkey long, o_custkey long, o_totalprice double"),
        "lineitem": ([(10, 1, 1, 1, 2.0, 3.0), (10, 1, 1, 1, 2.0, 3.0), (12, 4, 5, 2, 2.0, 3.0), (14, 1, 1, 1, 2.0, 3.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = Domain(spark, str(tmp_path)).sentences
    joins = [line for line in lines._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "l_orderkey" in joins[0]
    assert sorted(r.text[:20] for r in lines.collect()) == ["Gunmen killed 1 peop", "Gunmen killed 1 peop", "The abducted student"]
