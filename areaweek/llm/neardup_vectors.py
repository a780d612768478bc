"""Near-duplicate vectors by iterative quantisation, with an exact bound per block.

Vectors are normalised, equal ones of a label become one class. A rotation of the
principal axes is learned on a bounded sample so that signs make balanced binary
codes. The first bits of the code, as many as the label needs, cut it into blocks. A
rotation keeps distances, so two blocks whose ranges along the axes lie too far apart
hold no link; all other pairs of blocks are compared whole, by matrix products. No
link is lost, wherever the vectors lie. On vectors spread evenly over the sphere few
blocks are ruled out and work grows with the square of a label's classes.

What a pair of blocks finds leaves it as one row per class: its links, and one edge to
the smallest class it is connected with. So a dense group makes no row per link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import components, stored
from areaweek.llm.vectors import common_size, matrix, sample, valid

SAMPLE, ROUNDS, BITS, BLOCK = 20_000, 50, 64, 8_192
COSINE = 0.93
#: Rows multiplied at once; products and gaps nearer to the cut than this are settled exactly, or kept.
_TILE, _NEAR = 256, 1e-9


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return values / np.sqrt((values**2).sum(1, keepdims=True))


def rotation(units: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes turned so that signs lose least."""
    mean = units.mean(0)
    centred = units - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    flat = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(flat.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    return mean, axes @ turn


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each component once the edges (i, j) join those of ``root``."""
    while True:
        u, v = root[i], root[j]
        apart = u != v
        if not apart.any():
            return root
        u, v = np.unique(np.stack([np.maximum(u[apart], v[apart]), np.minimum(u[apart], v[apart])]), axis=1)
        np.minimum.at(root, u, v)
        while (root[root] != root).any():
            root = root[root]


def _compare(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of ``left`` and then ``right``; with ``same``, both are one block and only ``left`` counts."""
    size = len(left) if same else len(left) + len(right)
    links, root, first = np.zeros(size, np.int64), np.arange(size), 0 if same else len(left)
    for at in range(0, len(left), _TILE):
        tile, n_tile = left[at : at + _TILE], n_left[at : at + _TILE]
        dots = tile @ right.T
        hit = dots >= cosine
        i, j = np.nonzero(np.abs(dots - cosine) <= _NEAR)
        hit[i, j] = (tile[i] * right[j]).sum(1) >= cosine
        if same:
            hit &= np.arange(len(right)) > np.arange(at, at + len(tile))[:, None]
        i, j = np.nonzero(hit)
        np.add.at(links, at + i, n_right[j])
        np.add.at(links, first + j, n_tile[i])
        root = _roots(root, at + i, first + j)
    return links, root


def link(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
    block: int = BLOCK, sample_rows: int = SAMPLE, seed: int = 5,
) -> DataFrame:
    """(id, n_links, component) for every row of ``df``.

    Rows are compared when their labels are equal and not null, and linked when their
    cosine, in double precision, is at least ``cosine``; every such pair is found.
    Vectors that do not count (see ``vectors.valid``), or whose number of components
    is not the common one, and rows with a null label or id link with nothing and are
    their own component. Equal vectors count each other as links without being paired
    up. ``block`` is about the most classes held on one side at a time. An empty table
    gives no rows.
    """
    every = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), F.col(label_col).alias("group_label")).withColumn("row", F.monotonically_increasing_id())
    every = stored(every, "rows")
    rows = valid(every.where("group_label is not null"), "id", "raw", "group_label", "row")
    size = common_size(rows)
    if not size:
        return every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    rows = rows.where(F.size("vector") == size)
    classes = stored(rows.groupBy("group_label", "vector").agg(F.min("id").alias("cid"), F.count("*").alias("members")), "classes")
    spark = df.sparkSession
    learned = spark.sparkContext.broadcast(rotation(_unit(sample(classes.select(F.col("cid").alias("id"), "vector"), sample_rows, seed)), seed=seed))
    bits = learned.value[1].shape[1]
    label_type = dict(classes.dtypes)["group_label"]

    def turned(batch: pa.RecordBatch) -> np.ndarray:
        mean, projection = learned.value
        return (_unit(matrix(batch.column("vector"))) - mean) @ projection

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                wide = np.zeros((batch.num_rows, 64), np.uint8)
                wide[:, :bits] = turned(batch) > 0
                codes = np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group_label", "vector", "cid", "members")), pa.array(codes)], names=["group_label", "vector", "cid", "members", "code"])

    # As many bits as leave a label about half a block per cell; a cell that is still too full is dealt out by hash.
    coded = classes.select("group_label", "vector", "cid", "members").mapInArrow(code, f"group_label {label_type}, vector array<double>, cid long, members long, code long")
    most = F.greatest(F.lit(0), F.least(F.lit(min(bits, 30)), F.ceil(F.log2(F.count("*") * 2 / block)).cast("int")))
    need = classes.groupBy("group_label").agg(most.alias("bits"))
    celled = stored(coded.join(need, "group_label").withColumn("cell", F.expr("code & (shiftleft(1L, bits) - 1L)")).drop("code", "bits"), "cells")
    parts = celled.groupBy("group_label", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64("vector"), F.col("parts"))
    blocks = stored(celled.join(parts, ["group_label", "cell"]).withColumn("block", F.xxhash64("cell", part)).drop("cell", "parts"), "blocks")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least and the largest value along each axis, of each block in the batch."""
        for batch in batches:
            if batch.num_rows:
                flat, keys = turned(batch), batch.select(["group_label", "block"]).to_pylist()
                places: dict = {}
                for n, key in enumerate(keys):
                    places.setdefault((key["group_label"], key["block"]), []).append(n)
                low, high = ([list(map(float, f(flat[at], 0))) for at in places.values()] for f in (np.min, np.max))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _ in places], batch.column("group_label").type), pa.array([b for _, b in places], pa.int64()), pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))],
                    names=["group_label", "block", "low", "high"],
                )

    found = blocks.select("group_label", "block", "vector").mapInArrow(ranges, f"group_label {label_type}, block long, low array<double>, high array<double>")
    axes = found.select("group_label", "block", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "x")).groupBy("group_label", "block", "axis").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    bounds = stored(axes.groupBy("group_label", "block").agg(F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("axes")), "bounds")
    gap = F.zip_with("a.axes", "b.axes", lambda x, y: F.pow(F.greatest(F.lit(0.0), x["low"] - y["high"], y["low"] - x["high"]), 2))
    reach = 2 - 2 * cosine + _NEAR
    meet = bounds.alias("a").join(bounds.alias("b"), (F.col("a.group_label") == F.col("b.group_label")) & (F.col("a.block") <= F.col("b.block"))).where(
        F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) <= reach
    )
    meet = stored(meet.select("a.group_label", F.col("a.block").alias("a"), F.col("b.block").alias("b")), "meet")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        units = _unit(matrix(group.column("vector").chunk(0)))
        right = group.column("right").to_numpy()
        cid, members = group.column("cid").to_numpy(), group.column("members").to_numpy()
        order = np.concatenate([np.flatnonzero(~right), np.flatnonzero(right)])
        units, cid, members, n = units[order], cid[order], members[order], int((~right).sum())
        same = n == len(cid)
        other = slice(0 if same else n, None)
        links, root = _compare(units[:n], units[other], members[:n], members[other], same, cosine)
        kept = links > 0
        return pa.table({"cid": cid[kept], "n": links[kept], "root": cid[root[kept]]})

    left = blocks.join(meet.withColumnRenamed("a", "block").withColumns({"a": F.col("block")}), ["group_label", "block"]).withColumn("right", F.lit(False))
    right = blocks.join(meet.where("a != b").withColumnRenamed("b", "block").withColumns({"b": F.col("block")}), ["group_label", "block"]).withColumn("right", F.lit(True))
    sides = [d.select("group_label", "a", "b", "right", "vector", "cid", "members") for d in (left, right)]
    linked = stored(sides[0].unionByName(sides[1]).groupBy("group_label", "a", "b").applyInArrow(compare, "cid long, n long, root long"), "links")
    others = linked.groupBy("cid").agg(F.sum("n").alias("others"))
    roots = components(linked.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    known = classes.select("group_label", "vector", "cid", "members").join(others, "cid", "left").join(roots.withColumnRenamed("id", "cid"), "cid", "left").select(
        "group_label", "vector", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")
    )
    found = rows.join(known, ["group_label", "vector"]).select("row", "n_links", "component")
    return every.select("id", "row").join(found, "row", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
