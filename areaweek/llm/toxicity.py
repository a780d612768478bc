"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

A short list of insults is given; a lexicon of words and word beginnings is learned
from labelled texts. The features are their densities, how near hits are to
second-person words, and rates of capitals, punctuation and obfuscated spelling.
Features of a training text use a lexicon learned on the other folds of the training
texts, so no text helps to choose its own entries. Trees see three quarters of those
texts, the calibration the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import stored

#: Bounds: labelled rows to learn from, and lexicon entries kept.
MAX_LABELLED, MAX_ENTRIES = 20_000, 20_000
#: An entry needs this much of a likelihood-ratio statistic, and this share of toxic texts among those that hold it.
MIN_EVIDENCE, MIN_SHARE = 12.0, 0.5
CUT = 0.7
_BEGINNINGS = (4, 5, 6)
_FOLDS = 4
_NEAR = 5
_WINDOW = 50
#: Second-person words of the languages at hand.
_SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te ti toi ton ta tes vous votre vos usted ustedes vosotros os tuyo tus".split())
#: Common insults, as a start where few labels exist.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown jerk imbecile "
    "bastard bitch freak filth vermin idioten dummkopf arschloch abschaum imbécile crétin connard salaud idiota imbécil estúpido basura".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[0-9@$!*|]+")
_LEET = str.maketrans("013457@$!|", "oieastasil", "*_.-")
_EDGE = " \t\r\n,;:()\"'"
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_MARKS = re.compile(r"[!?]")
_PUNCTUATION = re.compile(r"[^\w\s]")
FEATURES = (
    "insult_density", "word_density", "beginning_density", "log_hits", "densest_window", "masked_hit_density", "near_second", "second_density", "capitals", "shouted", "marks", "punctuation", "masked",
)


def units(text: str) -> set[str]:
    """The words of a text and the beginnings of its longer words, marked by a final '*'."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) <= 40}
    return words | {f"{w[:n]}*" for w in words for n in _BEGINNINGS if len(w) > n}


def masked_words(text: str) -> list[str]:
    """Words with digits or symbols in the place of letters, in plain letters."""
    out, last = [], 0
    for m in _SYMBOLS.finditer(text):
        a, b = m.span()
        if a < last or b == len(text) or not text[b].isalpha() or (a and not text[a - 1].isalpha() and text[a - 1] not in _EDGE):
            continue
        while a and b - a < 40 and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and b - a < 40 and (text[b].isalpha() or text[b] in "0123456789@$!*|"):
            b += 1
        out.append(text[a:b].lower().translate(_LEET))
        last = b
    return out


def features(text: str, words: frozenset[str], beginnings: frozenset[str], marked: frozenset[str] | None = None, roots: frozenset[str] | None = None) -> list[float]:
    """The values of FEATURES for one whole text; all 0 for an empty one. ``marked`` and ``roots``: unions that many texts share."""
    found = _WORD.findall(text.lower())
    n, letters = max(1, len(found)), max(1, len(text))
    marked = words | INSULTS | _SECOND if marked is None else marked
    listed = [(i, w) for i, w in enumerate(found) if w in marked]
    insults = [i for i, w in listed if w in INSULTS]
    in_words = [i for i, w in listed if w in words]
    second = [i for i, w in listed if w in _SECOND]
    roots = frozenset(b[:4] for b in beginnings) if roots is None else roots
    in_starts = [i for i, w in enumerate(found) if w[:4] in roots and (w[:4] in beginnings or w[:5] in beginnings or w[:6] in beginnings)]
    hits = sorted({*insults, *in_words, *in_starts})
    masked = masked_words(text)
    unmasked = 0
    for plain in masked:
        unmasked += plain in INSULTS or plain in words or any(plain[:k] in beginnings for k in _BEGINNINGS)
    near = at = 0
    for i in hits:
        while at < len(second) and second[at] < i - _NEAR:
            at += 1
        near += at < len(second) and second[at] <= i + _NEAR
    densest = first = 0
    for last, i in enumerate(hits):
        while hits[first] <= i - _WINDOW:
            first += 1
        densest = max(densest, last - first + 1)
    rate = lambda pattern: len(pattern.findall(text)) / letters
    return [
        len(insults) / n, len(in_words) / n, len(in_starts) / n, math.log1p(len(hits)), densest / min(n, _WINDOW), unmasked / n, near / max(1, len(hits)), len(second) / n,
        rate(_CAPITALS), len(_SHOUTED.findall(text)) / n, rate(_MARKS), rate(_PUNCTUATION), len(masked) / n,
    ]


def _lexicon(counts: DataFrame, folds: tuple[int, ...], toxic: int, clean: int) -> tuple[frozenset[str], frozenset[str]]:
    """Words and beginnings with enough evidence in the counts of these folds."""
    if not toxic or not clean:
        return frozenset(), frozenset()
    c = counts.where(F.col("fold").isin(*folds)).groupBy("unit").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    base = toxic / (toxic + clean)
    part = lambda x, p: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / ((F.col("t") + F.col("n")) * p))).otherwise(0.0)
    c = c.withColumn("evidence", 2 * (part("t", base) + part("n", 1 - base))).where(
        (F.col("evidence") >= MIN_EVIDENCE) & (F.col("t") > F.greatest(F.lit(base), F.lit(MIN_SHARE)) * (F.col("t") + F.col("n")))
    )
    kept = [r["unit"] for r in c.orderBy(F.desc("evidence"), "unit").limit(MAX_ENTRIES).select("unit").collect()]
    return frozenset(u for u in kept if u[-1] != "*"), frozenset(u[:-1] for u in kept if u[-1] == "*")


def _featured(df: DataFrame, lexicons: list, keep: list[str]) -> DataFrame:
    """``df`` (text, which, ...) with its features; ``which`` picks the lexicon."""
    shared = df.sparkSession.sparkContext.broadcast(lexicons)  # one lexicon of MAX_ENTRIES entries at most for each fold, and one for all
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in keep] + ["features array<double>"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = [(words, starts, words | INSULTS | _SECOND, frozenset(b[:4] for b in starts)) for words, starts in shared.value]
        for part in parts:
            values = [features(text, *full[which]) for text, which in zip(part["text"], part["which"])]
            yield part[keep].assign(features=values)

    return df.select(*keep, "text", "which").mapInPandas(run, schema)


class Scorer:
    """Lexicon, trees and calibration learned from labelled texts; see ``fit``."""

    def __init__(self, lexicon, trees, calibration, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
        """``keep`` columns and ``score`` for every row. Null and empty texts are scored as texts without words."""
        names = [f"kept_{i}" for i in range(len(keep))]  # so that no column of ``docs`` can clash
        rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(0).alias("which"))
        back = [F.col(n).alias(c) for c, n in zip(keep, names)]
        if self.trees is None:
            return rows.select(*back, F.lit(self.base).alias("score"))
        scored = self.trees.transform(_featured(rows, [self.lexicon], names).withColumn("features", array_to_vector("features")))
        scored = scored.withColumn("raw", vector_to_array("probability")[1])
        if self.calibration is None:
            return scored.select(*back, F.col("raw").alias("score"))
        return self.calibration.transform(scored).select(*back, F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 11) -> Scorer:
    """Learn from ``labelled`` (id, text, toxic 0/1).

    Equal texts count once, with the label 1 if any of them has it. Rows with a null
    label are left out. Above ``max_labelled`` rows a sample is taken by a hash of the
    id, so reruns agree. With one class only, every score is that class's share; with
    no rows at all it is 0.
    """
    rows = labelled.where("toxic is not null").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("key", F.xxhash64(F.lit(seed), "text"))
    rows = stored(rows.select("text", "toxic", F.pmod("key", F.lit(_FOLDS)).cast("int").alias("fold"), F.pmod(F.shiftright("key", 8), F.lit(4)).cast("int").alias("quarter")), "labelled")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    total = lambda toxic, folds: sum(sizes.get((f, toxic), 0) for f in folds)
    every = tuple(range(_FOLDS))
    toxic, clean = total(1, every), total(0, every)
    if not toxic or not clean:
        return Scorer(None, None, None, toxic / max(1, toxic + clean))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            seen: dict[tuple[int, int], Counter] = {}
            for text, label, fold in zip(part["text"], part["toxic"], part["fold"]):
                seen.setdefault((fold, label), Counter()).update(units(text))
            for (fold, label), found in seen.items():
                n = list(found.values())
                yield pd.DataFrame({"unit": list(found), "fold": fold, "t": n if label else 0, "n": 0 if label else n})

    counts = stored(rows.mapInPandas(count, "unit string, fold int, t long, n long").groupBy("unit", "fold").agg(F.sum("t").alias("t"), F.sum("n").alias("n")), "units")
    lexicons = [_lexicon(counts, folds, total(1, folds), total(0, folds)) for folds in (every, *[tuple(f for f in every if f != own) for own in every])]
    trained = stored(_featured(rows.withColumn("which", F.col("fold") + 1), lexicons, ["toxic", "quarter"]), "features").withColumn("features", array_to_vector("features"))
    part = lambda condition: trained.where(condition).select("features", F.col("toxic").cast("double").alias("label"))
    classes = lambda df: df.select("label").distinct().count()
    grow, rest = part("quarter != 3"), part("quarter = 3")
    if classes(grow) < 2 or classes(rest) < 2:
        grow, rest = part("true"), None
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=seed, minInstancesPerNode=2).fit(grow)
    calibration = None
    if rest is not None:
        raw = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("raw"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw)
    return Scorer(lexicons[0], trees, calibration, toxic / (toxic + clean))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, text, toxic) of at most ``max_labelled`` labelled documents that are not held out, chosen by a hash of the id.

    Of several labels of one document the larger holds; null ids and labels are left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    return rows.join(F.broadcast(known), F.col("id") == F.col("doc_id")).select("id", "text", F.col("label").alias("toxic"))
