"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Every line of enough characters is cut into one segment more than the edits allowed.
Two lines within that distance share a segment, at nearly the same place, so a line's
segments are indexed under (length, segment number, substring) and longer or equal
lines are looked up under the few substrings that could match. Candidates are checked
by a bit-parallel edit distance that keeps only the band around the diagonal.

Only hashes travel to find candidates. Texts are dealt out twice, by document: for the
check and for the result. A frequent line is one class from the start; its places
meet their class in a plain join, which adaptive execution splits. Where many lines
share a segment, all its pairs would grow with their square. With one edit, the part
that may differ is therefore halved, round by round, and lines meet only if they agree
in all else; a line leaves as soon as few others do. The last part is one character:
lines that agree but for it are all within one edit, so each is paired with the first of
them only, and longer lines find their partner by leaving a character out. No pair that
decides a line is lost, as the edit is in one of the halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import stored

MIN_CHARS, EDITS = 30, 1
#: With one edit, a key of so many lines makes no pairs: they meet again under each half of the part that may differ.
_CROWD = 8


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """(start from 0, width) of segment ``i`` of a line; the last ones are longer by one if need be."""
    base, longer = F.floor(length / (edits + 1)), edits + 1 - length % (edits + 1)
    return i * base + F.greatest(F.lit(0), i - longer), base + (F.lit(i) >= longer).cast("int")


def _key(line: Column, start: Column, width: Column, length: Column, i: int) -> Column:
    return F.xxhash64(F.lit(i), length, F.substring(line, start + 1, width))


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    return [_key(line, *_segment(length, i, edits), length, i) for i in range(edits + 1)]


def probe_keys(line: Column, length: Column, edits: int, shortest: int | None = None) -> list[Column]:
    """Keys of all lines at most ``edits`` (or ``shortest``) shorter that may be within ``edits`` of this one.

    If segment i is the first to match, the segments before it hold i edits at least,
    and those after it all the others but what is left; so only small shifts count.
    """
    keys = []
    for shorter in range((edits if shortest is None else shortest) + 1):
        for i in range(edits + 1):
            start, width = _segment(length - shorter, i, edits)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                keys.append(_key(line, start + shift, width, length - shorter, i))
    return keys


def within(a: str, b: str, edits: int) -> Column:
    """Is the edit distance of two text columns, in code points, at most ``edits`` (20 at most)?

    Bit i of the words stands for row j - edits + i in column j; the words move down
    the diagonal by one shift per column. The score follows the main diagonal and ends
    with the vertical differences below it in the last column.
    """
    chars = lambda name: F.regexp_extract_all(F.col(name), F.lit("(?s)."), F.lit(0))
    swap = F.length(a) <= F.length(b)
    short, long = F.when(swap, chars(a)).otherwise(chars(b)), F.when(swap, chars(b)).otherwise(chars(a))
    gap = F.abs(F.length(a) - F.length(b))
    pad, word = F.array_repeat(F.lit(""), edits), (1 << (2 * edits + 1)) - 1
    full = F.lit(word).cast("long")
    flip = lambda x: F.bitwise_not(x).bitwiseAND(full)

    def equal_rows(both: Column) -> Column:
        """For each character of the shorter text, the rows of the band that hold it."""
        bit = lambda i, j, char: F.when(F.get(both["long"], j + i) == char, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        rows = lambda char, j: sum((bit(i, j, char) for i in range(1, 2 * edits + 1)), bit(0, j, char))
        return F.transform(both["short"], rows)

    def column(state: Column, equal: Column) -> Column:
        plus, minus = state["plus"], state["minus"]
        zero = (equal.bitwiseAND(plus) + plus).bitwiseXOR(plus).bitwiseOR(equal).bitwiseOR(minus).bitwiseAND(full)
        right, down = minus.bitwiseOR(flip(zero.bitwiseOR(plus))), F.shiftright(zero, 1)
        return F.struct(
            zero.bitwiseAND(plus).bitwiseOR(flip(down.bitwiseOR(right))).alias("plus"), down.bitwiseAND(right).alias("minus"),
            (state["score"] + 1 - F.shiftright(zero, edits).bitwiseAND(F.lit(1).cast("long"))).alias("score"),
        )

    def total(state: Column) -> Column:
        below = (F.expr(f"shiftleft(shiftleft(1L, abs(length(`{a}`) - length(`{b}`))) - 1L, {edits})")).bitwiseAND(full)
        return state["score"] + F.bit_count(state["plus"].bitwiseAND(below)) - F.bit_count(state["minus"].bitwiseAND(below))

    both = F.struct(short.alias("short"), F.concat(pad, long, pad).alias("long"))
    start = F.struct(F.lit((word >> edits) << edits).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus"), F.lit(0).cast("long").alias("score"))
    # The one-element array holds the split texts, so that they are split once and not once per character.
    distance = F.transform(F.array(both), lambda x: F.aggregate(equal_rows(x), start, column, total))[0]
    return (gap <= edits) & F.when(gap <= edits, distance <= edits)


def _tier_one(classes: DataFrame, n_index: int, n_probe: int, equal: int, edits: int) -> DataFrame:
    """(h1, h2, key, role, start, stop) of the stored segment keys; the part outside the segment is [start, stop) of the shorter length.

    Roles: "index", "equal" (looks for lines of its own length) and "longer" (looks for
    shorter ones). ``start`` and ``stop`` are only meant for one edit and two segments.
    """
    half = lambda n, i: (F.when(F.lit(i == 0), F.floor(n / 2)).otherwise(F.lit(0)), F.when(F.lit(i == 0), n).otherwise(F.floor(n / 2)))

    def row(name: str, role: str, n: Column, i: int) -> Column:
        start, stop = half(n, i)
        return F.struct(F.col(name).alias("key"), F.lit(role).alias("role"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))

    n, rows = F.col("length"), []
    for i in range(n_index):
        rows.append(row(f"i{i}", "index", n, i))
    for i in range(n_probe):
        rows.append(row(f"p{i}", "equal", n, i) if i < equal else row(f"p{i}", "longer", n - 1, (i - equal) % (edits + 1)))
    return classes.select("h1", "h2", F.inline(F.array(*rows)))


def _meet(keys: DataFrame, split: bool, halved: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a1, a2, b1, b2) that share a key, and the rows of crowded keys, which make no pairs here if ``split``.

    Crowded and ``halved`` rows have no role "equal": with one edit it would repeat "index".
    """
    crowded = None
    if split:
        hot = stored(keys.where("role = 'index'").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= _CROWD).select("key"), "crowded")
        crowded = stored(keys.where("role != 'equal'").join(hot, "key", "left_semi"), "crowded")
        keys = keys.join(hot, "key", "left_anti")
    side = lambda s, *more: [F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), "key", *more]
    a, b = keys.where(F.lit(halved) | (F.col("role") != "index")).select(*side("a", "role")), keys.where("role = 'index'").select(*side("b"))
    met = a.join(b, (a["key"] == b["key"]) & ((F.col("role") == "longer") | (F.struct("a1", "a2") < F.struct("b1", "b2"))))
    return stored(met.select("a1", "a2", "b1", "b2").distinct(), "met"), crowded


def _finer(crowded: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows like ``crowded`` for each half of the part that may hold the one edit; all else must be equal.

    A part of a longer line has one character more.
    """
    n = F.length("line") - (F.col("role") == "longer").cast("int")
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    part = lambda start, stop: F.struct(start.alias("from"), stop.alias("to"))
    each = crowded.join(lines.select("h1", "h2", "line"), ["h1", "h2"]).select("h1", "h2", "role", "line", F.inline(F.array(part(F.col("start"), middle), part(middle, F.col("stop")))))
    after = F.col("to") + 1 + (F.col("role") == "longer").cast("int")
    before, rest = F.col("line").substr(F.lit(1), F.col("from")), F.col("line").substr(after, F.length("line"))
    return each.select("h1", "h2", F.xxhash64(n, "from", "to", before, rest).alias("key"), "role", F.col("from").alias("start"), F.col("to").alias("stop"))


def _settle(single: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (a1, a2, b1, b2) of crowded lines that differ in one known character at most.

    Lines of a key and a length are all within one edit: each is paired with the first.
    A longer line has two characters there, and equals its partner without one of them.
    """
    index = single.where("role = 'index'").select("key", "h1", "h2").join(lines.select("h1", "h2", "first"), ["h1", "h2"])
    least = index.groupBy("key").agg(F.min(F.struct("first", "h1", "h2")).alias("least"))
    star = index.join(least, "key").where("h1 != least.h1 or h2 != least.h2").select(F.col("least.h1").alias("a1"), F.col("least.h2").alias("a2"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    longer = single.where("role = 'longer'").join(lines.select("h1", "h2", "line"), ["h1", "h2"]).withColumn("at", F.explode(F.array("start", F.col("start") + 1)))
    shorter = longer.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.concat(F.col("line").substr(F.lit(1), F.col("at")), F.col("line").substr(F.col("at") + 2, F.length("line"))).alias("line"))
    shorter = shorter.select("a1", "a2", F.xxhash64("line").alias("b1"), F.xxhash64(F.lit(1), "line").alias("b2"))
    return star.unionByName(shorter.join(lines.select(F.col("h1").alias("b1"), F.col("h2").alias("b2")), ["b1", "b2"], "left_semi"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """(doc, n_lines, n_removed, kept) per row: ``doc`` is the whole input row as a struct, ``kept`` its text without repeated lines.

    Lines end at line feeds. A line of at least ``min_chars`` characters goes if an
    equal line stands earlier, or one within ``edits``, removed or not. Earlier means
    smaller id (null first), then smaller hash of the text, then smaller place. Shorter
    lines always stay. Equal rows (id and text) count as one document: all get the
    same result. A null text has no lines and stays null; an empty text has one empty
    line. An empty table gives no rows.
    """
    if min_chars <= 2 * edits + 1:
        raise ValueError("min_chars must leave a character for each segment")
    text = F.col(text_col).cast("string")
    every = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.struct("*").alias("doc")).withColumn("key", F.xxhash64("id", "mark"))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    broken = F.split("text", "\n", -1)
    places = docs.select("id", "mark", F.posexplode(broken).alias("place", "line")).withColumn("length", F.length("line")).where(F.col("length") >= min_chars)
    name = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    index, probe = index_keys(F.col("line"), F.col("length"), edits), probe_keys(F.col("line"), F.col("length"), edits)
    named = [k.alias(f"{kind}{i}") for kind, keys in (("i", index), ("p", probe)) for i, k in enumerate(keys)]
    classes = places.select(*name, F.struct("id", "mark", "place").alias("first"), "length", *named).groupBy("h1", "h2").agg(
        F.min("first").alias("first"), F.count("*").alias("n"), F.min("length").alias("length"), *[F.min(k).alias(k) for k in [f"i{i}" for i in range(len(index))] + [f"p{i}" for i in range(len(probe))]]
    )
    classes = stored(classes, "lines")
    keys = _tier_one(classes, len(index), len(probe), equal=len(probe_keys(F.col("line"), F.col("length"), edits, shortest=0)), edits=edits)
    pairs, crowded = _meet(keys, split=edits == 1)

    # One fetch of texts serves the lines of all pairs and of all crowded keys.
    sides = [pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")), pairs.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"))]
    asked = sides[0].unionByName(sides[1])
    if crowded is not None:
        asked = asked.unionByName(crowded.select("h1", "h2"))
    asked = classes.select("h1", "h2", "first").join(asked.distinct(), ["h1", "h2"]).withColumn("key", F.xxhash64("first.id", "first.mark"))
    texts = docs.select(F.xxhash64("id", "mark").alias("key"), "text")
    lines = asked.join(texts, "key").select("h1", "h2", "first", F.get(broken, F.col("first.place")).alias("line")).dropDuplicates(["h1", "h2"])
    lines = stored(lines, "asked")
    while crowded is not None and not crowded.isEmpty():
        pairs = pairs.unionByName(_settle(crowded.where("stop - start = 1"), lines))
        more, crowded = _meet(_finer(crowded.where("stop - start > 1"), lines), split=True, halved=True)
        pairs = pairs.unionByName(more)

    side = lambda s: lines.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("first").alias(f"{s}_first"), F.col("line").alias(f"{s}_line"))
    close = pairs.distinct().join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).where(within("a_line", "b_line", edits))
    earlier = F.col("a_first") < F.col("b_first")
    near = close.select(*[F.when(earlier, F.col(f"b{i}")).otherwise(F.col(f"a{i}")).alias(f"h{i}") for i in (1, 2)]).distinct()
    repeated = classes.select("h1", "h2", "first", "n").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("near or n > 1")
    here = places.select("id", "mark", "place", *name).join(repeated, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (F.struct("id", "mark", "place") != F.col("first")))
    gone = stored(here.groupBy(F.xxhash64("id", "mark").alias("key")).agg(F.collect_set("place").alias("gone")), "removed")
    # The text travels once, inside its row.
    whole = every.select("key", "doc").join(gone, "key", "left").select("doc", F.col("doc").getField(text_col).cast("string").alias("text"), "gone")
    lost = F.coalesce(F.size("gone"), F.lit(0))
    kept = F.when(lost == 0, F.col("text")).otherwise(F.array_join(F.filter(broken, lambda line, i: ~F.array_contains("gone", i)), "\n"))
    return whole.select("doc", F.coalesce(F.size(broken), F.lit(0)).cast("long").alias("n_lines"), lost.cast("long").alias("n_removed"), kept.alias("kept"))
