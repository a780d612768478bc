import random

import pytest
from pyspark.sql import functions as F

from areaweek.operators import gate, metrics as m, ranking as rk
from areaweek.operators.scoring import calibrated


@pytest.fixture(scope="module")
def tied(spark):
    """Two groups; a third of all rows share one score."""
    rng = random.Random(1)
    rows = [("g1" if i % 5 else "g2", 0.0 if i % 3 == 0 else round(rng.random(), 2), f"k{i:04d}", i % 7 == 0) for i in range(900)]
    return spark.createDataFrame(rows, "g string, s double, k string, y boolean"), rows


def test_rank_in_group_is_exact_with_a_hot_score(tied):
    df, rows = tied
    got = {r.k: r.r for r in rk.rank_in_group(df, ["g"], [F.desc("s"), F.asc("k")], "r").collect()}
    for g in ("g1", "g2"):
        for place, row in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            assert got[row[2]] == place


def test_running_totals(tied):
    df, rows = tied
    out = rk.running_totals(df.withColumn("one", F.lit(1)), ["g"], [F.desc("s"), F.asc("k")], {"one": "n"}).collect()
    assert len(out) == len(rows)
    for g in ("g1", "g2"):
        assert [r.n for r in sorted((r for r in out if r.g == g), key=lambda r: (-r.s, r.k))] == list(range(1, sum(x[0] == g for x in rows) + 1))


def test_exact_quantiles(tied):
    import numpy as np

    df, rows = tied
    got = {r.point: r["quantile"] for r in rk.exact_quantiles(df, "s", [0.0, 0.9, 0.98, 0.995, 1.0]).collect()}
    for q, value in got.items():
        assert value == pytest.approx(np.quantile([r[1] for r in rows], q))


def scored(spark, rows):
    import datetime as dt

    return spark.createDataFrame([("m", dt.date.fromisoformat(w), u, s, y) for w, u, s, y in rows], "model string, week_start date, lga_code string, score double, label int")


def in_order(week, labels):
    """A week's units by falling score, with their labels."""
    return [(week, f"r{i:02d}", 1 / (i + 2), y) for i, y in enumerate(labels)]


def test_precision_and_recall_are_weekly_means(spark):
    weeks = {"2022-03-07": [1, 0, 1, 1, 0], "2022-03-14": [1, 0, 0, 0, 1], "2022-03-21": [1, 1, 1, 0, 0]}
    r = m.at_k(scored(spark, [row for week, labels in weeks.items() for row in in_order(week, labels)]), (3,)).first()
    # Hits in the first three: 2 of 3, 1 of 2 and 3 of 3 positives.
    assert r.precision == pytest.approx((2 / 3 + 1 / 3 + 1) / 3) and r.recall == pytest.approx((2 / 3 + 1 / 2 + 1) / 3)


def test_lift_against_the_base_rate(spark):
    hits = {0, 2, 3, 19, 34}  # three of five positives among the first four of forty
    r = m.at_k(scored(spark, in_order("2022-03-07", [int(i in hits) for i in range(40)])), (4,)).first()
    assert r.precision == pytest.approx(3 / 4) and r.lift == pytest.approx(6)


def test_week_without_positives_is_left_out_of_recall(spark):
    rows = [("2024-01-01", "A", 0.9, 1), ("2024-01-01", "B", 0.1, 0), ("2024-01-08", "A", 0.9, 0), ("2024-01-08", "B", 0.1, 0)]
    r = m.at_k(scored(spark, rows), (1,)).first()
    assert (r.precision, r.recall) == (0.5, 1.0)


def test_curve_metrics(spark):
    mixed = m.evaluate(scored(spark, in_order("2022-03-07", [1, 0, 1, 1, 0])), (2,)).first()
    # Four of six pairs are in order; precision at the positives is 1, 2/3 and 3/4.
    assert mixed.roc_auc == pytest.approx(4 / 6) and mixed.average_precision == pytest.approx((1 + 2 / 3 + 3 / 4) / 3) and mixed.recall_at_2 == pytest.approx(1 / 3)
    ties = m.curve_metrics(scored(spark, [("2024-01-01", u, 0.5, y) for u, y in zip("ABCD", (1, 0, 0, 1))])).first()
    assert ties.roc_auc == 0.5 and ties.average_precision == 0.5
    single = m.curve_metrics(scored(spark, [("2024-01-01", "A", 0.5, 0)])).first()
    assert single.roc_auc is None and single.average_precision is None


def test_buckets_match_equal_count_cuts(spark):
    pd = pytest.importorskip("pandas")
    for n in (10, 23, 101):
        rows = [("2024-01-01", f"L{i:03d}", i / n, 0) for i in range(n)]
        got = [r.bucket for r in m.with_bucket(scored(spark, rows), 5).orderBy("lga_code").collect()]
        assert got == pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False).tolist()


def test_tie_break_keeps_order_inside_a_step(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0), (0.3, 0.0), (0.8, 1.0)], "raw double, step double")
    got = [r.p for r in df.select(calibrated(F.col("step"), F.col("raw")).alias("p")).orderBy("p").collect()]
    assert got[0] < got[1] < got[2] and got[2] < 1e-5 and got[3] == 1


def folds(spark, train):
    rows = [("train", int(i < train)) for i in range(400)] + [("valid", 1)] * 30 + [("test", 1)] * 30
    return spark.createDataFrame(rows, "fold string, label int")


def test_split_guard(spark):
    gate.require_trainable(folds(spark, 300))
    with pytest.raises(gate.SplitTooThin, match="train fold has 5 positive"):
        gate.require_trainable(folds(spark, 5))
    with pytest.raises(gate.SplitTooThin, match="test fold is empty"):
        gate.require_trainable(folds(spark, 300).where("fold <> 'test'"))


def test_gate_drops_constant_and_skewed_features(spark):
    rows = [(i, 1.0, float(i % 2), 1.0 if i >= 95 else 0.0) for i in range(100)]
    panel = spark.createDataFrame(rows, "i int, flat double, fine double, late double").withColumn("week_start", F.expr("date_add(date'2020-01-06', i * 7)"))
    out = {r.feature: r.excluded_because for r in gate.feature_gate(gate.coverage(panel, ["flat", "fine", "late"], "2021-01-01")).collect()}
    assert out == {"flat": "constant", "fine": "", "late": "train-serve skew"}
    early = gate.feature_gate(gate.coverage(panel, ["late"], "2021-01-01", until="2021-06-01")).first()
    assert early.excluded_because == "constant"
