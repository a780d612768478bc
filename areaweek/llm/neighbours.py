"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised on its own, so k centroids per half give k * k
cells. A query visits cells by rising sum of its two squared centroid distances, with
a heap over centroid pairs, until they hold enough vectors, and the vectors of those
cells are ranked by their exact distance.

Codebooks are fitted on a bounded sample; every vector is indexed. The index is dealt
out by the first centroid, salted by its size, and stored in blocks of rows. Queries
travel in blocks too, one per first centroid with a bit per second centroid, so a
join meets blocks and not single pairs. The driver holds the codebooks and k * k counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaweek.llm.common import stored
from areaweek.llm.vectors import common_size, matrix, sample, valid

CENTROIDS, SAMPLE, ROUNDS = 64, 20_000, 15
#: A query stops when its cells hold this share of all vectors, and this many.
SHARE, LEAST = 0.5, 2000
_BLOCK_ROWS, _BLOCK_QUERIES = 4096, 512


def codebook(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k-means centroids of ``points``; fewer if there are fewer different points."""
    points = points[np.sort(np.unique(points, axis=0, return_index=True)[1])]
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> np.ndarray:
    """Which cells a query visits: rising sums of ``first`` and ``second``, until ``counts`` add up to ``enough``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    visited, held = np.zeros(counts.shape, bool), 0
    heap, reached = [(x[0] + y[0], 0, 0)], [0] * len(x)  # reached: cells of each row of centroid pairs already taken
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        visited[a[i], b[j]] = True
        held += counts[a[i], b[j]]
        reached[i] = j + 1
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return visited


def search(
    base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    centroids: int = CENTROIDS, sample_rows: int = SAMPLE, share: float = SHARE, least: int = LEAST, seed: int = 5,
) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` nearest by Euclidean distance, ties to the smaller id.

    Rows of ``base`` with the query's own id are no candidates. Vectors that do not
    count (see ``vectors.valid``), or whose number of components is not the common
    one, take no part on either side. Of repeated query ids one row is used, the one
    with the smallest vector; repeated rows of ``base`` are candidates each. With fewer
    than ``k`` candidates all are returned; without any, the query has no rows.
    """
    rows = valid(base, id_col, vector_col)
    size = common_size(rows)
    spark, half = base.sparkSession, size // 2
    schema = "query_id long, rank int, id long, score double"
    if not size:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == size)
    asked = valid(queries, id_col, vector_col).where(F.size("vector") == size).groupBy("id").agg(F.min("vector").alias("vector"))
    points = sample(rows, sample_rows, seed)
    books = spark.sparkContext.broadcast((codebook(points[:, :half], centroids, seed=seed), codebook(points[:, half:], centroids, seed=seed)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column("vector"))
            cells = [pa.array(_nearest(part, book).astype(np.int32)) for part, book in zip((values[:, :half], values[:, half:]), books.value)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), *cells], names=["id", "vector", "first", "second"])

    coded = stored(rows.select("id", "vector").mapInArrow(assign, "id long, vector array<double>, first int, second int"), "cells")
    counts = np.zeros([len(b) for b in books.value], np.int64)
    for r in coded.groupBy("first", "second").count().collect():  # at most centroids * centroids rows
        counts[r["first"], r["second"]] = r["count"]
    salts = [max(1, math.ceil(n / _BLOCK_ROWS)) for n in counts.sum(1).tolist()]
    enough = max(least, math.ceil(share * int(counts.sum())), k + 1)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column("first").to_numpy(), batch.column("second").to_numpy()
            ids, values = batch.column("id").to_numpy(), matrix(batch.column("vector"))
            order = np.argsort(first, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
                for at in range(0, len(group), _BLOCK_ROWS):
                    g = group[at : at + _BLOCK_ROWS]
                    yield pa.RecordBatch.from_pydict({"first": pa.array([first[g[0]]], pa.int32()), "ids": [ids[g].tobytes()], "seconds": [second[g].tobytes()], "vectors": [values[g].tobytes()]})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_QUERIES):
                part = batch.slice(at, _BLOCK_QUERIES)
                values, ids = matrix(part.column("vector")), part.column("id").to_numpy()
                far = [((v[:, None, :] - book[None]) ** 2).sum(-1) for v, book in zip((values[:, :half], values[:, half:]), books.value)]
                cells = np.array([visit(a, b, counts, enough) for a, b in zip(*far)])
                for first in np.flatnonzero(cells.any((0, 2))):
                    here = np.flatnonzero(cells[:, first].any(1))
                    yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32()), "query_ids": [ids[here].tobytes()], "visits": [np.packbits(cells[here, first], axis=1).tobytes()], "query_vectors": [values[here].tobytes()]})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, seconds, vectors, query_ids, visits, query_vectors in zip(*(batch.column(c).to_pylist() for c in ("ids", "seconds", "vectors", "query_ids", "visits", "query_vectors"))):
                ids, seconds, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(seconds, np.int32), np.frombuffer(query_ids, np.int64)
                vectors, query_vectors = np.frombuffer(vectors).reshape(len(ids), -1), np.frombuffer(query_vectors).reshape(len(query_ids), -1)
                visits = np.unpackbits(np.frombuffer(visits, np.uint8).reshape(len(query_ids), -1), axis=1).astype(bool)
                out: list[tuple[np.ndarray, ...]] = []
                for query, seen, point in zip(query_ids, visits, query_vectors):
                    near = np.flatnonzero(seen[seconds] & (ids != query))
                    if len(near):
                        score = np.sqrt(((vectors[near] - point) ** 2).sum(1))
                        if len(near) > k:
                            close = score <= np.partition(score, k - 1)[k - 1]
                            near, score = near[close], score[close]
                        best = np.lexsort((ids[near], score))[:k]
                        out.append((np.full(len(best), query), ids[near[best]], score[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "id", "score"])

    salt = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(s) for s in salts]), F.col("first") + 1))
    index = coded.repartition("first", salt).mapInArrow(block, "first int, ids binary, seconds binary, vectors binary")
    probes = asked.mapInArrow(probe, "first int, query_ids binary, visits binary, query_vectors binary")
    near = index.join(probes, "first").mapInArrow(rank, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
