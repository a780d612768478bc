"""Boosted classifier, calibration, sweep and stored artefacts on MLlib."""

from __future__ import annotations

import itertools
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ROWS_PER_TASK, durable, gathered, one_wave
from . import isotonic, metrics, scoring

# Training defaults and the sweep grid.
DEFAULTS = {
    "trees": 700, "rate": 0.05, "depth": 6, "row_share": 0.8, "column_share": 0.8, "min_child": 20, "positive_weight": 1.0, "seed": 608,
}
SWEEP = {"depth": (3, 4, 6), "rate": (0.03, 0.05), "positive_weight": ("auto", 1.0), "min_child": (5, 20)}
#: Fits of a sweep that run at the same time; each keeps its own copy of the training rows in Spark's storage.
SWEEP_PARALLELISM = 4
#: Fewest pieces of the rows of a fit, which takes a shuffle over all pieces for each level of each tree.
FIT_PIECES = 8


@dataclass
class RiskModel:
    booster: GBTClassificationModel
    calibrator: IsotonicRegressionModel | None
    features: list[str]
    settings: dict = field(default_factory=dict)


def as_vectors(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the vector column ``features``, unless the frame has it."""
    if "features" in frame.columns:
        return frame
    filled = frame.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def positive_weight(folded: DataFrame, setting) -> float:
    """Weight of the positive class: a number, or negatives over positives for ``auto``."""
    if setting != "auto":
        return float(setting)
    row = folded.where("fold = 'train'").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    positives = max(int(row.p or 0), 1)
    return (row.n - positives) / positives


def fit_pieces(rows: DataFrame) -> DataFrame:
    """Rows of a fit, whole units to a piece and weeks in order, in as many pieces as the rows need.

    The pieces decide which rows a tree samples. They follow from the rows alone, not
    from the way these came or the size of the cluster.
    """
    pieces = max(FIT_PIECES, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(pieces, "lga_code").sortWithinPartitions("lga_code", "week_start")


def fit_booster(folded: DataFrame, features: Sequence[str], **settings) -> GBTClassificationModel:
    """Boosting on the train fold; the valid fold stops it early."""
    s = {**DEFAULTS, **settings}
    weight = positive_weight(folded, s["positive_weight"])
    rows = as_vectors(fit_pieces(folded.where(F.col("fold").isin("train", "valid"))), features).select(
        "features", F.col("label").cast("double").alias("label"), (F.col("fold") == "valid").alias("held_out"),
        F.when(F.col("label") == 1, weight).otherwise(1.0).alias("row_weight"),
    )
    return GBTClassifier(
        maxIter=s["trees"], stepSize=s["rate"], maxDepth=s["depth"], subsamplingRate=s["row_share"], featureSubsetStrategy=str(s["column_share"]),
        minInstancesPerNode=s["min_child"], seed=s["seed"], weightCol="row_weight", validationIndicatorCol="held_out", labelCol="label",
        maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10,
    ).fit(rows)


def raw_scores(booster: GBTClassificationModel, frame: DataFrame, features: Sequence[str], name: str = "raw") -> DataFrame:
    scored = booster.transform(as_vectors(frame, features))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_calibrator(scored: DataFrame, raw: str = "raw") -> IsotonicRegressionModel:
    """Isotonic fit on validation rows only, from one weighted row per distinct score.

    Scores are pooled in ranges; only the ends of the steps that remain make the model.
    """
    points = scored.groupBy(F.col(raw).alias("feature")).agg(F.avg(F.col("label").cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="weight").fit(isotonic.step_ends(isotonic.pooled(points)))


def calibrate(calibrator: IsotonicRegressionModel, scored: DataFrame, raw: str = "raw", name: str = "probability") -> DataFrame:
    stepped = calibrator.setFeaturesCol(raw).setPredictionCol("_step").transform(scored)
    return stepped.withColumn(name, scoring.calibrated(F.col("_step"), F.col(raw))).drop("_step")


def score(model: RiskModel, frame: DataFrame) -> DataFrame:
    return calibrate(model.calibrator, raw_scores(model.booster, frame, model.features))


def train(folded: DataFrame, features: Sequence[str], **settings) -> RiskModel:
    near = one_wave(folded)
    booster = fit_booster(near, features, **settings)
    valid = raw_scores(booster, near.where("fold = 'valid'"), features)
    return RiskModel(booster, fit_calibrator(valid), list(features), {**DEFAULTS, **settings})


def long_scores(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return metrics.baseline_scores(frame, columns)


def compare(folded: DataFrame, full: RiskModel, reduced: GBTClassificationModel, reduced_features: Sequence[str]) -> DataFrame:
    """The six score sets of the comparison on the test fold, measured in one pass."""
    test = folded.where("fold = 'test'")
    scored = score(full, raw_scores(reduced, test, reduced_features, "raw_reduced"))
    sets = {
        **metrics.BASELINES, "boosting_without_point_process": "raw_reduced", "hybrid_uncalibrated": "raw", "hybrid_calibrated": "probability",
    }
    return metrics.evaluate(long_scores(scored, sets))


def sweep(folded: DataFrame, features: Sequence[str], grid: dict[str, Sequence] = SWEEP, trees: int = DEFAULTS["trees"]) -> DataFrame:
    """One row per combination, best validation recall at 20 first, then average precision.

    ``SWEEP_PARALLELISM`` fits run at a time; all candidates are measured in one pass.
    """
    combinations = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    # Vectors are made once for all candidates and written in the pieces of the fits.
    placed = durable(fit_pieces(as_vectors(folded, features).select("lga_code", "week_start", "fold", "label", "features")))
    valid = gathered(placed.where("fold = 'valid'"))
    with ThreadPool(min(SWEEP_PARALLELISM, len(combinations))) as pool:
        fit = inheritable_thread_target(folded.sparkSession)(lambda settings: fit_booster(placed, features, trees=trees, **settings))
        boosters = pool.map(fit, combinations, chunksize=1)
    scores = [long_scores(raw_scores(b, valid, features), {str(i): "raw"}) for i, b in enumerate(boosters)]
    measured = metrics.evaluate(gathered(reduce(DataFrame.unionByName, scores)))
    named = [
        F.struct(F.lit(str(i)).alias("model"), *[F.lit(str(v)).alias(k) for k, v in c.items()], F.lit(b.getNumTrees).alias("trees"))
        for i, (c, b) in enumerate(zip(combinations, boosters))
    ]
    # One row per combination.
    settings = folded.sparkSession.range(1).select(F.explode(F.array(*named)).alias("s")).select("s.*")
    table = settings.join(measured, "model").select(*grid, "trees", "roc_auc", "average_precision", "recall_at_20", "precision_at_20", "recall_at_50")
    return table.orderBy(F.desc("recall_at_20"), F.desc("average_precision"))


def save(model: RiskModel, path: str, metadata: DataFrame) -> None:
    model.booster.write().overwrite().save(os.path.join(path, "booster"))
    model.calibrator.write().overwrite().save(os.path.join(path, "calibrator"))
    metadata.withColumn("features", F.array(*[F.lit(f) for f in model.features])).coalesce(1).write.mode("overwrite").json(os.path.join(path, "metadata"))


def load(spark: SparkSession, path: str) -> RiskModel:
    metadata = spark.read.schema("features array<string>").json(os.path.join(path, "metadata")).first()
    return RiskModel(
        GBTClassificationModel.load(os.path.join(path, "booster")), IsotonicRegressionModel.load(os.path.join(path, "calibrator")), list(metadata.features)
    )
