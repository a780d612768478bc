"""What vector operators share: which vectors take part, and samples to fit on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, id_col: str, vector_col: str, *keep: str) -> DataFrame:
    """(id, vector, kept columns) of the vectors that take part.

    Vectors that are null, empty or zero, or that hold a null or non-finite component,
    do not. A row with a null id does not either. Components become doubles.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *keep)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def common_size(rows: DataFrame) -> int:
    """The most frequent number of components, the smaller on ties; 0 without rows."""
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes["n"] if sizes else 0


def sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most ``n`` vectors, chosen by a hash of the id."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).select("vector").toPandas()
    return np.array(got["vector"].tolist(), np.float64)


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column of equal lengths as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
