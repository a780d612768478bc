"""Similarity join on word n-grams by T-occurrence search with DivideSkip.

A document is the set of its n-grams, as 64-bit hashes. At similarity t a partner of
a set of n n-grams shares T = ceil(t * n) of them at least. So all but the T - c
longest inverted lists of a set are enough to meet each partner c times: these short
lists are built, dealt out by n-gram, and merged with a heap per document; the long
ones are never built but probed, by binary search in the partner's sorted set, only
for documents that the merge retains.

Which n-grams are long is a count over all documents: tasks report n-grams that they
see often, the sums order the frequent ones last. The table of these is bounded by the
share of all n-grams that each must hold; it sets an order and decides no result.

Equal sets are one class from the start. What is wanted is connectedness, so lists are
searched in rounds against few of their members: first the smallest, then eight drawn
anew, sixteen and so on. Lists that lie in one component by then are done and are
carried no further. Once all pairs of different components in the open lists are no more
than the next round would make, these are searched in full. Once, after the first round,
the n-grams of the sets in open lists are counted that occur in another component: no
partner shares more of them, so sets and pairs with too few are not searched. All members of a group draw
alike, so a round makes few candidates per set however large the group. No list is
collected in a task: lists stream in sorted order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaweek.llm.common import components, stored

WORDS, PERCENT = 5, 75
#: A frequent n-gram is reported by a task from this count on, and kept if it makes up one of so many parts of all n-grams.
_REPORT, _PARTS = 2, 4_000_000
#: The short lists of a set of n n-grams meet each partner 1 + n / 20 times at least.
_EXTRA = 20
#: Members that an open list is searched against in the second round; twice as many in each further one, up to the second number.
_PIVOTS, _MOST_PIVOTS = 8, 64
#: Sets checked against one copy of their common partner.
_GROUP = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_words = _Words()


def grams(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """The sorted set of ``n``-word shingles of UTF-8 text as 64-bit hashes, A-Z in lower case.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    words = text.lower().split() if text else []
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64).view(np.int64)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    out = codes[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += codes[k : len(words) - n + 1 + k]
    out *= _MIX
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def required(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def short_part(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The tokens whose lists are built: they meet a partner of ``m`` tokens in 1 + min(n, m) / 20 places at least."""
    n = len(tokens)
    keep = n - required(n, percent) + 1 + n // _EXTRA
    names, order = frequent
    if len(names):
        at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
        long = names[at] == tokens
        tokens = np.concatenate([tokens[~long], tokens[long][np.argsort(order[at[long]], kind="stable")]])
    return tokens[:keep]


def merge(lists: list[list[int]], need: dict[int, int]) -> list[tuple[int, int]]:
    """(document, occurrences) of the documents that occur in enough of the sorted lists."""
    out, last, count = [], None, 0
    for document in heapq.merge(*lists):
        if document != last:
            if last is not None and count >= need[last]:
                out.append((last, count))
            last, count = document, 0
        count += 1
    if last is not None and count >= need[last]:
        out.append((last, count))
    return out


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Do two sorted sets share ``need`` members? Probes the larger in blocks and stops when it is settled."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    found = 0
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        found += int((b[np.minimum(np.searchsorted(b, part), len(b) - 1)] == part).sum())
        if found >= need or found + len(a) - at - len(part) < need:
            break
    return found >= need


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _identity(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _pack(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, in order: enough to tell the members of two sets apart."""
    return (tokens.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(">i8").ravel().astype(np.int64)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, root) of every member of the packed sets of rows (id, root, tokens)."""
    for batch in batches:
        for some in (batch.slice(at, 500) for at in range(0, len(batch), 500)):
            members = [_unpack(t) for t in some.column("tokens").to_pylist()]
            n = np.fromiter(map(len, members), np.int64, len(members))
            columns = [np.concatenate(members), *[np.repeat(_column(some, c), n) for c in ("id", "root")]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "root"])


def _mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and then by set, those whose token has more than one set, each once, with the first set (p) of the token."""
    names = ["token", "n", "id"]
    held, mated, lead = None, False, (None, None, None)
    done = lambda rows, p: pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows, *p)], names=[*names, "p_n", "p"])
    for batch in batches:
        rows = np.stack([_column(batch, c).astype(np.int64) for c in names])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        same = rows[0, 1:] == rows[0, :-1]
        new = np.concatenate([[True], ~(same & (rows[2, 1:] == rows[2, :-1]))])
        rows = rows[:, new]
        same = rows[0, 1:] == rows[0, :-1]
        before = np.concatenate([[mated], same])
        keep = before[:-1] | same
        starts = np.maximum.accumulate(np.where(before, 0, np.arange(rows.shape[1])))
        firsts = rows[1:, starts]
        if lead[0] == rows[0, 0]:
            firsts[:, starts == 0] = np.array(lead[1:], np.int64)[:, None]
        yield done(rows[:, :-1][:, keep], firsts[:, :-1][:, keep])
        held, mated, lead = rows[:, -1:], bool(before[-1]), (rows[0, -1], *firsts[:, -1])
    if held is not None and mated:
        yield done(held, np.array(lead[1:], np.int64)[:, None])


def _first_round(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (token, n, id, p_n, p) sorted by id: the lists of sets that meet others often enough to have a partner, and (q, r) of those to check against p.

    A list row has null q and r, a candidate null token, n and id.
    """
    names = ["token", "n", "id", "p_n", "p"]

    def settle(rows: np.ndarray) -> pa.RecordBatch:
        _, start, met = np.unique(rows[2], return_index=True, return_counts=True)
        n = rows[1, start]
        able = met >= 1 + -(-percent * n // 100) // _EXTRA
        rows = rows[:, np.repeat(able, met)]
        token, n, name, p_n, p = rows
        alike = (p != name) & (100 * np.minimum(n, p_n) >= percent * np.maximum(n, p_n))
        order = np.flatnonzero(alike)[np.lexsort((p[alike], name[alike]))]
        q, r = name[order], p[order]
        at = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (r[1:] != r[:-1])])[: len(q)])
        enough = np.diff(at, append=len(q)) >= 1 + np.minimum(n[order][at], p_n[order][at]) // _EXTRA
        empty = lambda k: pa.nulls(k, pa.int64())
        found = np.stack([q[at], r[at]])[:, enough]
        columns = [pa.chunked_array([pa.array(c), empty(found.shape[1])]) for c in (token, n, name)] + [pa.chunked_array([empty(len(token)), pa.array(c)]) for c in found]
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], names=["token", "n", "id", "q", "r"])

    held = np.zeros((5, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.stack([_column(batch, c).astype(np.int64) for c in names])], axis=1)
        if not rows.shape[1]:
            continue
        last = int(np.searchsorted(rows[2], rows[2, -1]))
        held = rows[:, last:]
        if last:
            yield settle(rows[:, :last])
    if held.shape[1]:
        yield settle(held)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """T-occurrence search per query over rows (q, token, r, need) sorted by q, token and r."""
    out: list[tuple[int, int]] = []
    query, token, lists, need = None, None, [], {}
    for batch in batches:
        for q, t, r, least in zip(*(batch.column(c).to_pylist() for c in ("q", "token", "r", "need"))):
            if q != query:
                out += [(query, r0) for r0, _ in merge(lists, need)]
                query, token, lists, need = q, None, [], {}
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["q", "r"])
                    out = []
            if t != token:
                lists.append([])
                token = t
            lists[-1].append(r)
            need[r] = least
    out += [(query, r0) for r0, _ in merge(lists, need)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["q", "r"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, set_id, component) for every row of ``docs``.

    Two rows link when 100 * intersection >= ``percent`` * union of their shingle sets;
    ``component`` is the smallest id reachable by links. Equal sets are linked. Null,
    empty and wordless texts have an empty set, a null ``set_id``, and are their own
    component. Repeated rows get a result row each. A row with a null id links like
    any other; its component is null only if no linked row has an id. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t, words) for t in batch.column("text").to_pylist()]
            ids = [_identity(s) if len(s) else None for s in sets]
            different = list({i: s for i, s in zip(ids, sets) if i is not None}.values())
            tokens, seen = np.unique(np.concatenate(different) if different else np.array([], np.int64), return_counts=True)
            often = seen >= _REPORT
            many = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())]) for a, b in (
                    (batch.column("doc").to_pylist(), [None] * many), ([len(s) for s in sets], [None] * many), (ids, [None] * many),
                    ([None] * len(sets), tokens[often]), ([None] * len(sets), seen[often]),
                )], names=["doc", "n", "id", "token", "seen"],
            )

    described = stored(rows.mapInArrow(describe, "doc long, n long, id long, token long, seen long"), "sets")
    sizes = described.where("n is not null").select("doc", "n", "id")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    reported = described.where("seen is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= total / _PARTS).orderBy("token").toPandas()
    frequent = spark.sparkContext.broadcast((reported["token"].to_numpy(np.int64), reported["seen"].to_numpy(np.int64)))  # at most _PARTS entries

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, done = [], set()
            for text in batch.column("text").to_pylist():
                tokens = grams(text, words)
                if not len(tokens) or (name := _identity(tokens)) in done:
                    continue
                done.add(name)
                parts.append((short_part(tokens, frequent.value, percent), len(tokens), name))
            if parts:
                lengths = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[0] for p in parts])), *[pa.array(np.repeat(np.array([p[k] for p in parts], np.int64), lengths)) for k in (1, 2)]], names=["token", "n", "id"]
                )

    lists = "token long, n long, id long"
    posted = rows.select("text").mapInArrow(post, lists).repartition("token").sortWithinPartitions("token", "id").mapInArrow(_mates, f"{lists}, p_n long, p long")
    # Sets that meet others too rarely in all cannot have a partner; the first round is searched in the same pass.
    posted = posted.repartition("id").sortWithinPartitions("id").mapInArrow(lambda batches: _first_round(batches, percent), f"{lists}, q long, r long")
    posted = stored(posted, "lists")
    found, posted = posted.where("q is not null").select("q", "r"), posted.where("q is null").select("token", "n", "id")

    carrying = sizes.join(posted.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("doc").alias("carrier")).select("carrier").distinct()
    wanted = rows.join(carrying, F.col("doc").eqNullSafe(F.col("carrier")), "left_semi")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {_identity(s): s for s in (grams(t, words) for t in batch.column("text").to_pylist()) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([_pack(s) for s in sets.values()], pa.binary())], names=["id", "tokens"])

    # Where an id repeats, its other texts come along; they are in no candidate pair, and a set that comes twice gives the same link twice.
    sets = stored(wanted.select("text").mapInArrow(gather, "id long, tokens binary"), "grams")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, first = None, np.array([])
        for batch in batches:
            found = []
            for r, salt, leads, q, tokens in zip(*(batch.column(c).to_pylist() for c in ("r", "salt", "lead", "id", "tokens"))):
                other = _unpack(tokens)
                if leads:
                    lead, first = (r, salt), other
                elif lead == (r, salt) and overlap(first, other, -(-percent * (len(first) + len(other)) // (100 + percent))):
                    found.append((r, q))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    def links(found: DataFrame) -> DataFrame:
        """Check each retained set against the sets that it was retained for, in salted groups led by the common one."""
        groups = found.groupBy("r").agg(F.ceil(F.count("*") / _GROUP).alias("salts"))
        members = found.join(groups, "r").select(F.col("q").alias("id"), "r", F.pmod(F.xxhash64("q"), "salts").alias("salt"), F.lit(False).alias("lead"))
        leads = groups.select(F.col("r").alias("id"), "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("lead"))
        checked = members.unionByName(leads).join(sets, "id").select("r", "salt", "lead", "id", "tokens")
        return stored(checked.repartition("r", "salt").sortWithinPartitions("r", "salt", F.desc("lead")).mapInArrow(verify, "u long, v long"), "links")

    alike = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    need = lambda a, b: 1 + F.floor(F.least(a, b) / _EXTRA)
    def open_lists(placed: DataFrame) -> DataFrame:
        """The lists that hold sets of different components."""
        still = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
        return placed.join(still, "token", "left_semi")

    def shared(placed: DataFrame) -> DataFrame:
        """(id, c): how many n-grams of each of these sets occur in one of another component; no partner shares more. Equal upper bits count as equal."""
        tokens = sets.join(placed.select("id", "root").distinct(), "id").select("id", "root", "tokens").mapInArrow(_one_by_one, "token long, id long, root long")
        return open_lists(tokens).groupBy("id").agg(F.count("*").alias("c"))

    edges, pivots = links(found), _PIVOTS
    roots = components(edges)
    posted, counted = posted.withColumn("c", F.col("n")), False
    while True:
        placed = posted.join(roots, "id", "left").select("token", "n", "id", "c", F.coalesce("component", "id").alias("root"))
        placed = stored(open_lists(placed), "open")
        if not counted:
            # Components only grow from here on, so these numbers stay upper bounds.
            placed = placed.drop("c").join(stored(shared(placed), "shared"), "id").where(100 * F.col("c") >= percent * F.col("n"))
            placed, counted = stored(open_lists(placed.select("token", "n", "id", "c", "root")), "open"), True
        parts = placed.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
        n_open, open_pairs = parts.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("own")) / 2)).first()
        if not n_open:
            break
        full = open_pairs <= pivots * n_open or pivots > _MOST_PIVOTS
        partner = placed.select("token", F.col("n").alias("n2"), F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("root").alias("root2"))
        if not full:
            # All lists of a group draw the same members, which are thus met in enough of the lists: first those with the fewest n-grams of their own.
            own = (F.col("n2") - F.col("c2")) / F.col("n2") if pivots == _PIVOTS else F.lit(0.0)
            drawn = Window.partitionBy("token").orderBy(own, F.xxhash64(F.lit(pivots), "id2"), "id2")
            partner = partner.withColumn("drawn", F.row_number().over(drawn)).where(F.col("drawn") <= pivots).drop("drawn")
        enough = (100 + percent) * F.least("c", "c2") >= percent * (F.col("n") + F.col("n2"))
        met = placed.join(partner, "token").where((F.col("root") < F.col("root2") if full else F.col("root") != F.col("root2")) & alike(F.col("n"), F.col("n2")) & enough)
        candidates = met.select(F.col("id").alias("q"), "token", F.col("id2").alias("r"), need(F.col("n"), F.col("n2")).alias("need"))
        found = stored(candidates.repartition("q").sortWithinPartitions("q", "token", "r").mapInArrow(_search, "q long, r long"), "candidates")
        edges = edges.unionByName(links(found))
        roots = components(edges)
        if full:
            break
        posted, pivots = placed.select("token", "n", "id", "c"), 2 * pivots
    whole = sizes.join(roots, "id", "left").withColumn("root", F.coalesce("component", "id"))
    smallest = whole.where("root is not null").groupBy("root").agg(F.min("doc").alias("smallest"))
    return whole.select("doc", "n", "id", "root").join(smallest, "root", "left").select(
        F.col("doc").alias("id"), F.col("n").alias("n_shingles"), F.col("id").alias("set_id"), F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("smallest")).alias("component")
    )
