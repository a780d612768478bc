"""Mixing sources to target weights with a hypergeometric splitting tree.

Texts are cut into blocks of words. Each source's blocks get a seeded random order,
its target becomes an exact number of blocks in that order (whole passes over the
source, then part of one), and a tree splits the sources' quotas among the output
shards: each node gives its left half a multivariate-hypergeometric share, so quotas
stay whole numbers and add up. A shard draws its own stretch of every source's order,
stretches are disjoint, and rows are shuffled inside the shard.

Only per-source totals reach the driver, at most ``max_sources`` of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaweek.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 128
#: Expected blocks in one cell of a source's order; each cell is one window partition.
_CELL_BLOCKS = 4096
_CELLS = 1 << 20
#: Equal rows numbered by one task at a time.
_TWINS = 10_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEATS) -> list[float]:
    """Split the sum of ``sizes`` by weight, with ``most`` times its own size as each one's ceiling.

    ``weights`` repeat along the list. What is above a ceiling is shared again among
    the others by weight, until none is above; if all are at it, the rest is not given.
    """
    share = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(share[i] for i in free)
        full = {i for i in free if unit * share[i] >= most * sizes[i]}
        if not full:
            for i in free:
                out[i] = unit * share[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free -= full
    return out


def _share(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric count of any size.

    Beyond the generator's range the distribution function is inverted: probabilities
    are products of their ratios around the mode, over so many standard deviations
    that what lies outside is less than a step of the uniform number.
    """
    if not n or not good:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode, spread = (n + 1) * (good + 1) // (total + 2), (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    reach = int(12 * spread) + 50
    low, high = max(0, n - bad, mode - reach), min(good, n, mode + reach)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    ladder = np.cumsum(np.exp(weight - weight.max()))
    return low + int(min(np.searchsorted(ladder, rng.random() * ladder[-1], side="right"), high - low))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows: shards; columns: sources. Columns add up to ``quotas``; rows differ in sum by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def part(held: list[int], first: int, last: int) -> None:
        if last - first == 1:
            out[first] = held
            return
        middle, total = (first + last) // 2, sum(held)
        starts = [total * (k - first) // (last - first) for k in (middle, last)]
        need, rest, left = starts[0], total, []
        rng = np.random.default_rng([seed, first, last])
        for have in held:
            rest -= have
            left.append(_share(rng, have, rest, need) if rest else min(have, need))
            need -= left[-1]
        part(left, first, middle)
        part([a - b for a, b in zip(held, left)], middle, last)

    part(list(quotas), 0, shards)
    return out


def row_key(source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart; equal rows share it."""
    return F.xxhash64(F.col(id_col), F.xxhash64(_text(text_col)), F.col(source_col).cast("string"))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def mix(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block_words: int | None = BLOCK_WORDS,
    weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS, shards: int = 64, seed: int = 7, max_sources: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """Return (draws, rows).

    draws: row_id, block, first_word, words, pass, shard, place: the blocks that the
    mix takes, once per pass, in the order of ``place`` inside each shard. rows: one
    row per input row with row_id, id, source, size, source_size and target.
    ``block_words`` None makes each text one block.

    Sizes are words; a null text has none. Sources are ordered by code point, a null
    source last as a source of its own. Texts without words and sources without words
    are never drawn. Rows that are equal in id and text are told apart by a number;
    equal rows get the same treatment in any order, so reruns agree. An empty table
    gives no draws. More than ``max_sources`` sources raise an error.
    """
    source = F.col(source_col).cast("string")
    sized = docs.select(
        F.col(id_col).alias("id"), source.alias("source"), F.regexp_count(_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(_text(text_col)).alias("mark"),
    )
    # Equal rows are counted before the shuffle and numbered in stretches, which different tasks unfold.
    equal = sized.groupBy("id", "mark", "source", "size").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("id", "mark", "source"))
    stretch = equal.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _TWINS)))).repartition("key", "at")
    twin = F.explode(F.sequence(F.col("at") * _TWINS + 1, F.least("n", (F.col("at") + 1) * _TWINS))).alias("twin")
    rows = stored(stretch.select("id", "source", "size", "mark", "key", twin).withColumn("row_id", F.xxhash64("id", "mark", "source", "twin")), "sizes")
    length = F.col("size") if block_words is None else F.lit(block_words).cast("long")
    blocks = rows.where("size > 0").select(
        "row_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / length))).alias("block"), length.alias("length")
    ).select("row_id", "source", "block", (F.col("block") * F.col("length")).alias("first_word"), F.least("length", F.col("size") - F.col("block") * F.col("length")).alias("words"))
    blocks = blocks.withColumn("key", F.xxhash64(F.lit(seed), "row_id", "block"))

    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    # Spark orders strings by UTF-8 bytes, which is the order of code points.
    goals = targets([r["source_size"] for r in found], weights, most)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(r["source"], r["source_size"], t, int(t // r["source_size"]) if r["source_size"] else 0) for r, t in zip(found, goals)],
        "source string, source_size long, target double, passes long",
    )
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))

    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    # The order of a source: cells by the high bits of the key, then the key inside the cell.
    counts = blocks.groupBy("source").agg(F.count("*").alias("n_blocks")).withColumn("cells", F.least(F.lit(_CELLS), F.ceil(F.col("n_blocks") / _CELL_BLOCKS)))
    dealt = blocks.alias("b").join(F.broadcast(counts.alias("c")), same("b", "c")).select("b.*", F.pmod(F.shiftrightunsigned("key", 20), F.col("cells")).alias("cell"))
    cells = dealt.groupBy("source", "cell").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("source", "cell").orderBy("key", "row_id", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({"n1": F.count("*").over(inside), "w1": F.coalesce(F.sum("words").over(inside), F.lit(0))})
    ranked = placed.alias("p").join(starts.alias("s"), same("p", "s") & (F.col("p.cell") == F.col("s.cell"))).join(F.broadcast(plan.alias("g")), same("p", "g")).select(
        "p.row_id", "p.source", "p.block", "p.first_word", "p.words", "p.key", (F.col("n0") + F.col("n1")).alias("rank"),
        # The part of a pass ends where the words taken come nearest to the target.
        (F.col("passes") + (F.col("w0") + F.col("w1") + F.col("words") / 2 <= F.col("rest")).cast("long")).alias("draws"),
    )
    ranked = stored(ranked, "blocks")
    totals = {r["source"]: (r["n"], r["q"]) for r in ranked.groupBy("source").agg(F.count("*").alias("n"), F.sum("draws").alias("q")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    quotas = split_quotas([totals[s][1] for s in names], shards, seed)
    ends = spark.createDataFrame([(s, totals[s][0], [int(x) for x in np.cumsum(quotas[:, i])]) for i, s in enumerate(names)], "source string, n_blocks long, ends array<long>")
    at = F.col("pass") * F.col("n_blocks") + F.col("rank")
    draws = ranked.where("draws > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1))).alias("r")
    draws = draws.join(F.broadcast(ends.alias("e")), same("r", "e")).select(
        "row_id", "block", "first_word", "words", "pass", F.size(F.filter("ends", lambda end: end <= at)).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "key", "pass").alias("place"),
    )
    return draws, rows.alias("b").join(F.broadcast(plan.alias("g")), same("b", "g")).select("row_id", "b.key", "id", F.col("b.source").alias("source"), "size", "source_size", "target")
