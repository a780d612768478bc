"""Per-row attributions, driver ranks, sentences and global importance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURE_LABELS
from ..session import work_path
from .ranking import top_in_group

KEYS = ("lga_code", "week_start")


def long_form(wide: DataFrame, features: Sequence[str], value=lambda f: F.col(f), share=lambda f: F.col(f"phi_{f}")) -> DataFrame:
    """One row per unit, week and feature from value and attribution columns."""
    entries = [
        F.struct(F.lit(f).alias("feature_name"), F.lit(FEATURE_LABELS.get(f, f)).alias("feature_label"),
                 value(f).cast("double").alias("feature_value"), share(f).cast("double").alias("shap_value"))
        for f in features
    ]
    return wide.select(*KEYS, F.explode(F.array(*entries)).alias("e")).select(*KEYS, "e.*")


def linear_attributions(frame: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Exact attributions of a linear score: weight times distance from the mean."""
    means = frame.agg(*[F.avg(f).alias(f"_m_{f}") for f in weights])
    # One row of means.
    wide = frame.crossJoin(F.broadcast(means))
    return long_form(wide, list(weights), share=lambda f: F.lit(weights[f]) * (F.col(f) - F.col(f"_m_{f}")))


def top_drivers(attributions: DataFrame, k: int = 5) -> DataFrame:
    return top_in_group(attributions, list(KEYS), [F.desc(F.abs("shap_value")), F.asc("feature_name")], k, "driver_rank")


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature and its share of the total."""
    per = attributions.groupBy("feature_name", "feature_label").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
    total = per.agg(F.sum("mean_abs_shap").alias("_t"))
    return per.crossJoin(F.broadcast(total)).withColumn("share", F.col("mean_abs_shap") / F.col("_t")).drop("_t")


def prefix_share(importance: DataFrame, prefix: str) -> DataFrame:
    return importance.agg((F.sum(F.when(F.col("feature_name").startswith(prefix), F.col("mean_abs_shap")).otherwise(0.0)) / F.sum("mean_abs_shap")).alias("prefix_share"))


def rendered(value: Column) -> Column:
    """Two decimals without trailing zeros, or grouped whole numbers from 1000 up."""
    short = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(F.abs(value) < 1000, short).otherwise(F.format_number(value, 0))


def sentences(drivers: DataFrame) -> DataFrame:
    direction = F.when(F.col("shap_value") > 0, "raises").otherwise("lowers")
    return drivers.withColumn("sentence", F.concat_ws(" ", F.col("feature_label"), F.lit("at"), rendered(F.col("feature_value")), direction, F.lit("the score")))


# ------------------------------------------------------------ tree ensembles
#: Pattern shares worked out at once, and rows looked up at once.
_PATTERNS, _ROWS = 1 << 15, 1024


def node_table(model) -> DataFrame:
    """(tree, weight, node, left, right, feature, cut, value, cover) of a fitted boosted model, read from its saved form.

    ``left`` and ``right`` are -1 at leaves; ``cover`` is the training weight at the node.
    """
    spark = SparkSession.active()
    path = work_path(spark, "booster")
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*").select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), F.col("prediction").alias("value"), F.col("impurityStats")[0].alias("cover"),
    )
    return nodes.join(weights, "tree")


def ensemble_leaves(model, features: Sequence[str]) -> tuple[list[tuple], float]:
    """Leaf table of a fitted boosted model: (weight * value, path) per leaf, and the mean score.

    A path maps each feature to (low, high, cover share): the open-closed interval
    the feature has to be in, and the share of training weight that went this way.
    The tables are as large as the model, not the data.
    """
    nodes = {(r.tree, r.node): r for r in node_table(model).toLocalIterator()}
    leaves: list[tuple] = []
    for tree in sorted({t for t, _ in nodes}):
        waiting = [(nodes[tree, 0], {})]
        while waiting:
            node, path = waiting.pop()
            if node.left < 0:
                leaves.append((node.weight * node.value, path))
                continue
            lo, hi, z = path.get(node.feature, (-math.inf, math.inf, 1.0))
            left, right = nodes[tree, node.left], nodes[tree, node.right]
            waiting.append((right, {**path, node.feature: (max(lo, node.cut), hi, z * right.cover / node.cover)}))
            waiting.append((left, {**path, node.feature: (lo, min(hi, node.cut), z * left.cover / node.cover)}))
    return leaves, sum(value * math.prod(z for _, _, z in path.values()) for value, path in leaves)


def grouped_leaves(leaves: list[tuple]) -> list[tuple]:
    """Arrays (value, feature, low, high, share) for each number of features on a path, with a row per leaf."""
    import numpy as np

    out = []
    for d in sorted({len(path) for _, path in leaves} - {0}):
        own = [(value, path) for value, path in leaves if len(path) == d]
        ends = np.array([list(path.values()) for _, path in own], float)
        out.append((np.array([value for value, _ in own], float), np.array([list(path) for _, path in own]), ends[:, :, 0], ends[:, :, 1], ends[:, :, 2]))
    return out


def _pattern_shares(value, share):
    """Shapley values of each leaf's game for each pattern of fulfilled conditions: leaves x patterns x conditions."""
    import numpy as np

    d = share.shape[1]
    met = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
    weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    out = np.empty((len(value), 1 << d, d))
    for i in range(d):
        # Coefficients of the product over the other conditions of (share + met * t).
        poly = [np.ones((len(value), 1 << d))]
        for j in range(d):
            if j != i:
                away = share[:, j, None]
                poly = [(poly[k] * away if k < len(poly) else 0) + (poly[k - 1] * met[:, j] if k else 0) for k in range(len(poly) + 1)]
        out[:, :, i] = value[:, None] * (met[:, i] - share[:, i, None]) * sum(w * c for w, c in zip(weight, poly))
    return out


def _leaf_attributions(matrix, groups):
    """Exact Shapley values of the leaf games, for a batch of rows (numpy).

    A row fulfils some of a leaf's conditions; what that is worth is looked up.
    """
    import numpy as np

    phi = np.zeros_like(matrix)
    for value, feature, low, high, share in groups:
        d = feature.shape[1]
        step = max(1, _PATTERNS >> d)
        for at in range(0, len(value), step):
            part = slice(at, at + step)
            shares = _pattern_shares(value[part], share[part])
            names, lo, hi = feature[part], low[part], high[part]
            leaf = np.arange(len(names))
            orders = [np.argsort(names[:, j], kind="stable") for j in range(d)]
            for row in range(0, len(matrix), _ROWS):
                tile = matrix[row : row + _ROWS]
                pattern = np.zeros((len(tile), len(names)), np.int64)
                for j in range(d):
                    x = tile[:, names[:, j]]
                    pattern |= ((x > lo[:, j]) & (x <= hi[:, j])).astype(np.int64) << j
                for j, order in enumerate(orders):
                    worth = shares[leaf[order], pattern[:, order], j]
                    found, first = np.unique(names[order, j], return_index=True)
                    phi[row : row + _ROWS, found] += np.add.reduceat(worth, first, axis=1)
    return phi


def tree_attributions(model, frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Additive attributions of the boosted score for every row, in Arrow batches.

    Attributions of a row plus the base value equal its raw margin.
    """
    return leaf_attributions(ensemble_leaves(model, features)[0], frame, features)


def leaf_attributions(leaves: list[tuple], frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """``tree_attributions`` of a leaf table that is at hand."""
    shared = frame.sparkSession.sparkContext.broadcast(grouped_leaves(leaves))  # as large as the model
    names = list(features)

    def attribute(batches: Iterator) -> Iterator:
        for batch in batches:
            values = batch[names].to_numpy(dtype=float)
            phi = _leaf_attributions(values, shared.value)
            for i, f in enumerate(names):
                batch[f"phi_{f}"] = phi[:, i]
            yield batch

    wide = frame.select(*KEYS, *[F.col(f).cast("double").alias(f) for f in names])
    schema = f"lga_code string, week_start date, {', '.join(f'`{f}` double' for f in names)}, {', '.join(f'`phi_{f}` double' for f in names)}"
    return long_form(wide.mapInPandas(attribute, schema), names)
