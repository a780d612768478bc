"""Pooling in ranges against the plain fit."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from areaweek.operators import isotonic


def plain(points):
    done = []
    for x, y, w in sorted(points):
        low = x
        total, weight = y * w, w
        while done and done[-1][2] / done[-1][3] >= total / weight - 1e-15:
            b = done.pop()
            low, total, weight = b[0], total + b[2], weight + b[3]
        done.append((low, x, total, weight))
    return [(low, high, total / weight) for low, high, total, weight in done]


CASES = {
    "noise": lambda r, i: i / 400 + r.uniform(-0.4, 0.4),
    "falling": lambda r, i: -i,
    "rising": lambda r, i: i,
    "binary": lambda r, i: float(r.random() < i / 300),
    "level": lambda r, i: 1.0,
}


@pytest.mark.parametrize("case", CASES)
def test_ranges_give_the_plain_fit(spark, case):
    rng = random.Random(case)
    points = [(float(i), float(CASES[case](rng, i)), float(rng.choice([1, 1, 5]))) for i in range(300)]
    frame = spark.createDataFrame(points, "feature double, label double, weight double").repartition(3)
    steps = sorted((r.low, r.high, r["mean"]) for r in isotonic.pooled(frame, range_blocks=20).collect())
    want = plain(points)
    assert [s[:2] for s in steps] == [w[:2] for w in want]
    assert [s[2] for s in steps] == pytest.approx([w[2] for w in want])


def test_the_model_of_step_ends_is_the_model_of_all_points(spark):
    rng = random.Random(5)
    points = [(rng.random(), float(rng.random() < 0.3), 1.0) for _ in range(400)]
    frame = spark.createDataFrame(points, "feature double, label double, weight double")
    fit = lambda rows: IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="weight").fit(rows)
    ends = fit(isotonic.step_ends(isotonic.pooled(frame, range_blocks=30)))
    asked = spark.range(-10, 111).select((F.col("id") / 100).alias("feature"))
    got, want = ([r.prediction for r in m.transform(asked).orderBy("feature").collect()] for m in (ends, fit(frame)))
    assert got == pytest.approx(want)


def test_no_points(spark):
    assert isotonic.pooled(spark.createDataFrame([], "feature double, label double, weight double")).count() == 0
