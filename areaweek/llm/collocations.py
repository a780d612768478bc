"""Phrase collocations per language by SON partitioning.

Documents are dealt into a few shards by a hash of their text. Each shard is mined
completely: a phrase is locally frequent when its count in the shard reaches the
support times the shard's share of the language's words, so a phrase that reaches
the support overall is locally frequent somewhere. The union of the locally frequent
phrases is then counted over all documents exactly, as text.

Tasks count inside chunks of bounded size and send sorted 64-bit phrase hashes in
packed rows; a shard of a language is split by hash range, so no task holds a whole
shard and a hot language or phrase is only ever one number per chunk. Two phrases
with equal hashes only make each other candidates; the final counts go by text.
The union reaches the tasks as a bitmap of hashes of at most ``BITMAP_BITS`` bits;
when that is crowded, more phrases are counted than needed and the result is the same.

Null texts count as empty, null languages as ``und``. Repeated rows count again. Texts
of any length are read in windows. Other columns, whatever their names, are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import stored
from areaweek.operators.ranking import top_in_group

SHARDS = 3
#: Words a task holds before it counts them, distinct words among them, and bytes of text split at once.
CHUNK_WORDS, CHUNK_VOCABULARY, WINDOW = 4_000_000, 2_000_000, 1 << 20
#: Phrase hashes that meet in one group, and the limit of the bitmap.
GROUP_HASHES, BITMAP_BITS = 4_000_000, 30
#: Bits of a word's number inside a chunk; three fit into one key.
WORD_BITS = 21
_STOP = b"."
#: A-Z in lower case, every piece separator as the stop, tabs as spaces.
_PLAIN = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def _windows(text: bytes) -> Iterator[list[bytes]]:
    """Words and stops of a text, in order, a window at a time; cuts fall between words."""
    plain = text.lower().translate(_PLAIN)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + WINDOW)
        end = len(plain) if end < 0 else end
        yield plain[at:end].replace(_STOP, b" . ").split()
        at = end


class _Chunk:
    """Word numbers of texts by group, until they are counted. A text may go on in the next chunk."""

    def __init__(self, longest: int):
        self.longest, self.groups, self.held = longest, defaultdict(list), 0
        self.number = defaultdict(count().__next__)
        self.number[_STOP]  # the stop is number 0
        self.context: dict[tuple, int] = {}

    def add(self, group: tuple, words: list[bytes]) -> None:
        self.groups[group].append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.held += len(words)

    @property
    def full(self) -> bool:
        return self.held >= CHUNK_WORDS or len(self.number) >= CHUNK_VOCABULARY

    def carry(self, group: tuple) -> _Chunk:
        """A fresh chunk that knows the last words of the text that is going on."""
        vocabulary = list(self.number)
        last = np.concatenate([a[-self.longest :] for a in self.groups[group][-self.longest :]])[1 - self.longest :]
        fresh = _Chunk(self.longest)
        fresh.add(group, [vocabulary[i] for i in last])
        fresh.context[group] = len(last)
        return fresh

    def phrases(self) -> Iterator[tuple]:
        """(group, words in a phrase, packed keys, counts) of each group's distinct phrases."""
        for group, parts in self.groups.items():
            ids = np.concatenate(parts)
            known = self.context.get(group, 0)  # a phrase that ends there was counted before
            for n in range(1, self.longest + 1):
                size = len(ids) - n + 1
                if size <= 0:
                    break
                keys, inside = np.zeros(size, np.int64), np.ones(size, bool)
                for j in range(n):
                    part = ids[j : j + size]
                    keys = keys << WORD_BITS | part
                    inside &= part > 0
                inside[: max(0, known - n + 1)] = False
                yield group, n, *np.unique(keys[inside], return_counts=True)

    def hashes(self, lang: str, n: int, keys: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), xxhash.xxh3_64_intdigest(f"{n} {lang}".encode()), np.uint64)
        for j in range(n - 1, -1, -1):
            out = out * np.uint64(0x9E3779B97F4A7C15) + of_word[keys >> (WORD_BITS * j) & ((1 << WORD_BITS) - 1)]
            out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return out


def _chunks(batches, longest: int, keys: tuple[str, ...]) -> Iterator[_Chunk]:
    chunk = _Chunk(longest)
    for batch in batches:
        names = [batch.column(k) for k in keys]
        text = batch.column("text")
        for row in range(batch.num_rows):
            group = tuple(c[row].as_py() for c in names)
            for words in _windows(text[row].as_py()):
                chunk.add(group, words)
                if chunk.full:
                    yield chunk
                    chunk = chunk.carry(group)
            chunk.add(group, [_STOP])
    yield chunk


def _of_word(chunk: _Chunk) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chunk.number), np.uint64, len(chunk.number))


def _mine(longest: int, bucket_bits: int):
    """Packed phrase hashes and counts of each chunk, by language, shard and hash range."""

    def mine(batches):
        for chunk in _chunks(batches, longest, ("lang", "shard")):
            of_word, rows = _of_word(chunk), defaultdict(list)
            for group, n, keys, n_times in chunk.phrases():
                rows[group].append((chunk.hashes(group[0], n, keys, of_word), n_times.astype(np.uint32)))
            for (lang, shard), parts in rows.items():
                hashes, n_times = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(hashes)
                hashes, n_times = hashes[order], n_times[order]
                buckets = (hashes >> np.uint64(63 - bucket_bits) >> np.uint64(1)).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else []
                ends = [*starts[1:], len(hashes)]
                for a, b in zip(starts, ends, strict=False):
                    yield pa.RecordBatch.from_pylist(
                        [{"lang": lang, "shard": shard, "bucket": int(buckets[a]), "hashes": hashes[a:b].tobytes(), "counts": n_times[a:b].tobytes()}],
                        schema=pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]),
                    )

    return mine


_FREQUENT = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary())])


def _locally_frequent(table: pa.Table) -> pa.Table:
    """One language, shard and hash range: the hashes that reach the shard's own support."""
    hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]])
    n_times = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]])
    order = np.argsort(hashes)
    hashes = hashes[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    total = np.add.reduceat(n_times[order].astype(np.int64), starts)
    found = hashes[starts][total >= table["need"][0].as_py()]
    return pa.Table.from_pylist([{"bucket": table["bucket"][0].as_py(), "hashes": found.tobytes()}] if len(found) else [], schema=_FREQUENT)


def _bits_set(bucket_bits: int, bits: int):
    """The part of the bitmap that a hash range covers."""

    def part(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        at = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]]) >> np.uint64(64 - bits)
        first = bucket << (bits - bucket_bits)
        flags = np.zeros(1 << (bits - bucket_bits), bool)
        flags[at.astype(np.int64) - first] = True
        return pa.table({"first": pa.array([first // 8], pa.int64()), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    return part


def _count(longest: int, bitmap, bits: int):
    """(lang, words, phrase, n) of the candidates in each chunk, exactly."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.binary()), ("n", pa.int64())])

    def counted(batches):
        flags = np.frombuffer(bitmap.value, np.uint8)
        for chunk in _chunks(batches, longest, ("lang",)):
            of_word, vocabulary = _of_word(chunk), list(chunk.number)
            for (lang,), n, keys, n_times in chunk.phrases():
                at = chunk.hashes(lang, n, keys, of_word) >> np.uint64(64 - bits)
                hit = (flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                keys, n_times = keys[hit], n_times[hit]
                for a in range(0, len(keys), 50_000):
                    part = keys[a : a + 50_000]
                    words = [[vocabulary[i] for i in (part >> (WORD_BITS * j) & ((1 << WORD_BITS) - 1)).tolist()] for j in range(n - 1, -1, -1)]
                    phrases = [b" ".join(x) for x in zip(*words, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array(phrases, pa.binary()), pa.array(n_times[a : a + 50_000], pa.int64())], schema=schema
                    )

    return counted


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words met ``support`` times, and (lang, n) of all words.

    Both are written tables. ``longest`` is 2 or 3.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have 2 or 3 words at most")
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard")
    )
    words = F.expr(r"regexp_count(text, '[^\\x20\\x09.,;:!?\\x0A-\\x0D]+')")
    sizes = stored(texts.groupBy("lang", "shard").agg(F.sum(words).cast("long").alias("w")), "words")
    totals = sizes.groupBy("lang").agg(F.sum("w").alias("n"))
    all_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket_bits = min(20, max(0, math.ceil(math.log2(max(1, all_words * longest / GROUP_HASHES)))))

    needs = sizes.join(totals, "lang").select("lang", "shard", F.expr(f"({support} * w + n - 1) div greatest(n, 1)").alias("need")).where("need > 0")
    raw = texts.select("lang", "shard", F.col("text").cast("binary").alias("text"))
    mined = raw.mapInArrow(_mine(longest, bucket_bits), "lang string, shard int, bucket int, hashes binary, counts binary")
    local = mined.join(needs, ["lang", "shard"]).groupBy("lang", "shard", "bucket").applyInArrow(_locally_frequent, "bucket int, hashes binary")
    local = stored(local, "locally-frequent")

    n_local = local.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0))).first()[0] // 8
    bits = max(bucket_bits + 3, min(BITMAP_BITS, math.ceil(math.log2(max(1, 16 * n_local)))))
    bitmap = bytearray(1 << bits - 3)
    for first, flags in local.groupBy("bucket").applyInArrow(_bits_set(bucket_bits, bits), "first long, flags binary").toLocalIterator():
        bitmap[first : first + len(flags)] = flags
    union = spark.sparkContext.broadcast(bytes(bitmap))
    counted = raw.select("lang", "text").mapInArrow(_count(longest, union, bits), "lang string, words int, phrase binary, n long")
    total = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support)
    return stored(total.withColumn("phrase", F.col("phrase").cast("string")), "phrases"), totals


def _joined(parts: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(parts, start, size), " ")


def mine(docs: DataFrame, support: int = 10, longest: int = 3, top: int = 2000, part_percent: int = 50, shards: int = SHARDS) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    The score is floor(1000000 a a / (l r)) of the lowest-scoring cut, ties to the earliest
    cut. A phrase inside a longer candidate with at least ``part_percent`` percent of its
    count is dropped. Order: score, then count, both descending, then the phrase's bytes.
    """
    phrases, totals = frequent_phrases(docs, support, longest, shards)
    parts = F.split("phrase", " ")
    candidates = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), parts.alias("parts"))
    cuts = candidates.select("lang", "phrase", "a", "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _joined(F.col("parts"), F.lit(1), F.col("k")).alias("first"), _joined(F.col("parts"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    known = phrases.select("lang", "phrase", "f")
    with_first = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    with_both = with_first.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  a * a * 1000000 stays below 10^38
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = with_both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("words > 2").select(
        "lang", "a", "parts", "words", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> struct(s, m))))")).alias("at")
    ).select("lang", _joined(F.col("parts"), F.col("at.s"), F.col("at.m")).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < part_percent * wide("a")))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    ranked = top_in_group(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
