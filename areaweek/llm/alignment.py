"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers of the query never join bytes across a single space between two other
characters, so a text is cut there; a cut is where tokens of both end. Each distinct
piece of a batch is encoded once, many of them in one call. Its tokens become incidence matrices in CSR form,
tokens by bytes: the row products of A and B transposed are the overlap links (with the
bytes shared), and the products of the group-incidence matrices are the links between
all tokens that share a group. Pieces of a batch form one block-diagonal matrix.

A first pass writes, for each text, its counts, its groups' hash and its distinct linked
id pairs with their numbers; the numbers are summed over all texts; a second pass
over the written rows looks them up. The table of pair counts is bounded by the
product of both vocabularies and goes to the tasks in ranges of B ids of at most
``TABLE_PAIRS`` pairs, one pass over the written pairs each, so one range is the usual
case and no size needs another plan. A range holds whole B ids, so the highest count
of a B id is known inside it.

Null and empty texts, and texts that either tokenizer does not give back byte by byte,
have no tokens: zeros and an empty hash. Long texts are read in windows that end at
cuts, and hashed as they go. Repeated rows are rows of their own; extra columns,
whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import stored

#: Files of the two tokenizers, byte-level BPE and pieces with byte fallback.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text cut at once, bytes of text encoded together, pairs of the count table in one range.
WINDOW, BATCH_BYTES, TABLE_PAIRS = 1 << 20, 2 << 20, 4_000_000
#: Pieces encoded in one call of a tokenizer.
RUN = 64
#: An id pair as one number: the B id above, the A id in the lower bits.
A_BITS = 16
_CUT = re.compile(r"(?<=\S)(?= \S)")


# --- incidence matrices -----------------------------------------------------------


class Csr:
    """A sparse matrix of ones or counts: row i has columns ``columns[starts[i]:starts[i + 1]]``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    @classmethod
    def of_ranges(cls, sizes: np.ndarray) -> Csr:
        """Row i holds the next ``sizes[i]`` columns: tokens by bytes, or groups by tokens."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return cls(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(starts, rows[order], self.values[order], len(self.starts) - 1)

    def rows_times(self, other: Csr, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``first`` to ``last`` of self times other, row by row: (row, column, value) in order."""
        a, b = self.starts[first], self.starts[last]
        through, scale = self.columns[a:b], self.values[a:b]
        sizes = other.starts[through + 1] - other.starts[through]
        owner = np.repeat(np.repeat(np.arange(first, last), np.diff(self.starts[first : last + 1])), sizes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(other.starts[through], sizes) + inside
        key = owner * other.width + other.columns[at]
        value = np.repeat(scale, sizes) * other.values[at]
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return key[heads] // other.width, key[heads] % other.width, np.add.reduceat(value, heads) if len(heads) else value

    def times(self, other: Csr, entries: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The product in blocks of rows, each of about ``entries`` products or of one row."""
        work = np.concatenate([[0], np.cumsum(other.starts[self.columns + 1] - other.starts[self.columns])])[self.starts]
        first, n = 0, len(self.starts) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(work, work[first] + entries, "right")) - 1)
            yield self.rows_times(other, first, last)
            first = last


# --- tokenizers -------------------------------------------------------------------


class Tokenizers:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, byte_level: str, pieces: str):
        # One thread a task; Spark runs the tasks side by side.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        with open(byte_level, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        of_char = _byte_of_character()
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of_char[c] for c in token)
        self.b = SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("a piece with a space inside: texts can't be cut at spaces")
        if len(self.a_bytes) > 1 << A_BITS:
            raise ValueError(f"more than {1 << A_BITS} ids on the A side")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        text = lambda n, end: np.array([b"%d%s" % (i, end) for i in range(n)], object)
        self.a_text = {end: text(len(self.a_bytes), end) for end in (b",", b"|")}
        self.b_text = {end: text(len(self.b_bytes), end) for end in (b",", b";")}

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, B ids, their numbers per piece and whether both give the piece back, for pieces that begin with the added or the cut space.

        A piece that is not given back has no ids. Pieces that meet at a cut are encoded in runs of
        ``RUN``; where a run is not given back or a token reaches over a cut, its pieces are encoded by themselves.
        """
        plain = [i for i, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace()]
        rest = np.ones(len(pieces), bool)
        rest[plain] = False
        runs = [plain[i : i + RUN] for i in range(0, len(plain), RUN)]
        a, b, order, n_a, n_b, same = [], [], [], [], [], []
        for run, text, x, y in zip(runs, *self._both(["".join([pieces[i] for i in run]) for run in runs]), strict=True):
            ends = np.cumsum([len(pieces[i].encode()) for i in run]) if not text.isascii() else np.cumsum([len(pieces[i]) for i in run])
            places = [self._places(text, ids, known, sizes, ends) for ids, known, sizes in ((x, self.a_bytes, self.a_size), (y, self.b_bytes, self.b_size))]
            if places[0] is None or places[1] is None:
                rest[run] = True
                continue
            order += run
            a.append(x)
            b.append(y)
            n_a.append(places[0])
            n_b.append(places[1])
            same += [True] * len(run)
        single = np.flatnonzero(rest).tolist()
        for p, x, y in zip(*self._both([pieces[i] for i in single]), strict=True):
            raw = p.encode()
            exact = b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y))
            a.append(x if exact else x[:0])
            b.append(y if exact else y[:0])
            n_a.append(np.array([len(a[-1])]))
            n_b.append(np.array([len(b[-1])]))
            same.append(exact)
        order = np.array(order + single, np.int64)
        back = np.argsort(order)
        return *(x for side, n in ((a, n_a), (b, n_b)) for x in _reordered(side, n, back)), np.array(same, bool)[back]

    def _both(self, texts: list[str]) -> tuple[list[str], list[list[int]], list[list[int]]]:
        return texts, [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)

    @staticmethod
    def _places(text: str, ids: list[int], known: list[bytes], sizes: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """How many ids lie in each stretch of the text up to the byte ``ends``; None if the ids are not this text's bytes or reach over an end."""
        if b"".join(map(known.__getitem__, ids)) != text.encode():
            return None
        at = np.cumsum(sizes[ids])
        last = np.searchsorted(at, ends)
        return np.diff(last, prepend=-1) if (at[last] == ends).all() else None


def _reordered(ids: list[list[int]], n: list[np.ndarray], back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces in the pieces' own order, and their numbers."""
    ids = np.fromiter(chain.from_iterable(ids), np.int64)
    n = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
    first, n = (np.cumsum(n) - n)[back], n[back]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return ids[np.repeat(first, n) + inside], n


def _byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as characters from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


@lru_cache(1)
def _loaded(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


# --- one batch of pieces ----------------------------------------------------------


class Aligned:
    """The alignment of distinct pieces: block-diagonal matrices, then sums and links per piece."""

    def __init__(self, tok: Tokenizers, pieces: list[str]):
        self.a_ids, self.n_a, self.b_ids, self.n_b, self.exact = tok.encode(pieces)
        a_rows, b_rows = Csr.of_ranges(tok.a_size[self.a_ids]), Csr.of_ranges(tok.b_size[self.b_ids])
        blocks = list(a_rows.times(b_rows.transposed()))
        self.links_a, self.links_b, self.shared_bytes = (np.concatenate([x[i] for x in blocks]) if blocks else np.zeros(0, np.int64) for i in range(3))
        # A byte where tokens of both end closes a group.
        ends = np.intersect1d(a_rows.starts[1:], b_rows.starts[1:], assume_unique=True)
        self.a_last, self.b_last = (np.searchsorted(rows.starts[1:], ends) for rows in (a_rows, b_rows))
        in_group = lambda last: np.diff(np.concatenate([[-1], last]))
        self.a_groups, self.b_groups = Csr.of_ranges(in_group(self.a_last)), Csr.of_ranges(in_group(self.b_last))
        self.a_from, self.b_from = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        self.group_from = np.searchsorted(self.a_last, self.a_from)
        self.link_from = np.searchsorted(self.links_a, self.a_from)
        self.pairs = (self.b_ids[self.links_b] << A_BITS | self.a_ids[self.links_a]).astype(np.uint32)
        self.n_groups, self.n_links = np.diff(self.group_from), np.diff(self.link_from)
        self.n_shared = np.diff(np.concatenate([[0], np.cumsum(np.diff(self.a_groups.starts) * np.diff(self.b_groups.starts))])[self.group_from])

    def written(self, tok: Tokenizers) -> list[bytes]:
        """Each piece's groups as ``a1,a2|b1;a3|b2,b3;``, with the closing semicolon."""
        closes_a, closes_b = np.zeros(len(self.a_ids), bool), np.zeros(len(self.b_ids), bool)
        closes_a[self.a_last], closes_b[self.b_last] = True, True
        group_a = np.cumsum(closes_a) - closes_a
        group_b = np.cumsum(closes_b) - closes_b
        out = np.empty(len(self.a_ids) + len(self.b_ids), object)
        # An A token follows the B tokens of the groups before its own, a B token the A tokens up to its group's end.
        out[np.arange(len(self.a_ids)) + self.b_groups.starts[group_a]] = np.where(closes_a, tok.a_text[b"|"][self.a_ids], tok.a_text[b","][self.a_ids])
        out[np.arange(len(self.b_ids)) + self.a_groups.starts[group_b + 1]] = np.where(closes_b, tok.b_text[b";"][self.b_ids], tok.b_text[b","][self.b_ids])
        places = (self.a_from + self.b_from).tolist()
        parts = out.tolist()
        return [b"".join(parts[x:y]) for x, y in zip(places[:-1], places[1:], strict=True)]

    def shared_group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A token, B token) of all pairs that share a group, from the group-incidence matrices, in blocks of rows."""
        for rows, columns, _ in self.a_groups.transposed().times(self.b_groups):
            yield rows, columns


# --- texts ------------------------------------------------------------------------


def _windows(text: str) -> Iterator[list[str]]:
    """Pieces of the text with the added space, a window at a time."""
    full, at = " " + text, 0
    while at < len(full):
        end = len(full)
        if end - at > WINDOW and (found := _CUT.search(full, at + WINDOW)):
            end = found.start()
        yield _CUT.split(full[at:end])
        at = end


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
_ROW = pa.schema([("id", pa.int64()), *[(n, pa.int64()) for n in _SUMS], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


class _Text:
    """What is known of a text so far. Its pairs are summed up whenever many have come together."""

    def __init__(self, key):
        self.key, self.exact, self.sums, self.hash, self.some = key, True, np.zeros(len(_SUMS), np.int64), hashlib.sha256(), False
        self.pairs, self.held = [], 0

    def add(self, sums: np.ndarray, exact: bool, groups: bytes, pairs: np.ndarray) -> None:
        self.exact &= exact
        self.sums += sums
        if groups and exact:
            # The semicolon between groups of two windows; the last one is left out.
            self.hash.update((b";" if self.some else b"") + groups[:-1])
            self.some = True
        self.pairs.append((pairs, np.ones(len(pairs), np.int64)))
        self.held += len(pairs)
        if self.held > 4 * WINDOW:
            self.pairs, self.held = [self.summed()], 0

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        keys, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, times, len(keys)).astype(np.int64)

    def row(self) -> dict:
        if not (self.exact and self.some):
            return {"id": self.key, **dict.fromkeys(_SUMS, 0), "groups_sha256": "", "pairs": b"", "times": b""}
        keys, times = self.summed()
        return {"id": self.key, **dict(zip(_SUMS, self.sums.tolist(), strict=True)), "groups_sha256": self.hash.hexdigest(), "pairs": keys.astype(np.uint32).tobytes(), "times": times.astype(np.uint32).tobytes()}


def _encoded(tok: Tokenizers, parts: list[tuple[_Text, list[str]]]) -> None:
    """Align the distinct pieces of some windows and add each window to its text."""
    number = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(pieces for _, pieces in parts)))}
    places = [np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces)) for _, pieces in parts]
    done = Aligned(tok, list(number))
    sums = np.stack([getattr(done, n) for n in _SUMS], axis=1)
    groups = done.written(tok)
    for (text, _), at in zip(parts, places, strict=True):
        sizes = done.n_links[at]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pairs = done.pairs[np.repeat(done.link_from[at], sizes) + inside]
        text.add(sums[at].sum(axis=0), bool(done.exact[at].all()), b"".join([groups[i] for i in at.tolist()]), pairs)


def _align(byte_level: str, pieces: str):
    def align(batches):
        tok = _loaded(byte_level, pieces)
        for batch in batches:
            texts, parts, held, ready = [], [], 0, []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                texts.append(_Text(key))
                for window in _windows(text.as_py()) if text.is_valid and len(text.as_py()) else ():
                    parts.append((texts[-1], window))
                    held += sum(map(len, window))
                    if held >= BATCH_BYTES:
                        _encoded(tok, parts)
                        parts, held = [], 0
                        ready += [t.row() for t in texts[:-1]]
                        texts = texts[-1:]
                        if sum(len(r["pairs"]) for r in ready) > 1 << 24:
                            yield pa.RecordBatch.from_pylist(ready, schema=_ROW)
                            ready = []
            if parts:
                _encoded(tok, parts)
            yield pa.RecordBatch.from_pylist(ready + [t.row() for t in texts], schema=_ROW)

    return align


def _counted(batches):
    """(b, pair, n) summed within some rows of the first pass."""
    schema = pa.schema([("b", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])

    def flush(keys, times):
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(times), len(keys)).astype(np.int64)
        return keys, n

    keys, times, held = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column("pairs"), batch.column("times"), strict=True):
            keys.append(np.frombuffer(k.as_py(), np.uint32).astype(np.int64))
            times.append(np.frombuffer(t.as_py(), np.uint32))
            held += len(keys[-1])
        if held > 4_000_000:
            k, n = flush(keys, times)
            keys, times, held = [k], [n], len(k)
            if held > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(k >> A_BITS, pa.int32()), pa.array(k), pa.array(n)], schema=schema)
                keys, times, held = [], [], 0
    if keys:
        k, n = flush(keys, times)
        yield pa.RecordBatch.from_arrays([pa.array(k >> A_BITS, pa.int32()), pa.array(k), pa.array(n)], schema=schema)


def _looked_up(table):
    """Each text's links of the highest count and sum of counts, for the pairs in the table."""
    schema = pa.schema([*[f for f in _ROW if f.name not in ("pairs", "times")], ("pairs", pa.binary()), ("times", pa.binary()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def look(batches):
        known, counts, best = table.value
        for batch in batches:
            keys = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("pairs")]
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            owner = np.repeat(np.arange(len(keys)), sizes)
            keys = np.concatenate(keys) if len(keys) else np.zeros(0, np.uint32)
            times = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in batch.column("times")]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            owner, at, times = owner[hit], at[hit], times[hit]
            n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, owner, times * best[at])
            np.add.at(count_sum, owner, times * counts[at])
            old = [np.array(batch.column(n).to_pylist(), np.int64) for n in ("n_best", "count_sum")]
            columns = [batch.column(f.name) for f in schema][:-2] + [pa.array(n_best + old[0]), pa.array(count_sum + old[1])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return look


def pair_counts(first: DataFrame) -> DataFrame:
    """(b, pair, n, best): links of every id pair over all texts, and whether no other pair of its B id has more."""
    summed = first.select("pairs", "times").where("length(pairs) > 0").mapInArrow(_counted, "b int, pair long, n long")
    counts = stored(summed.groupBy("b", "pair").agg(F.sum("n").alias("n")), "pair-counts")
    # One row per B id, at most the size of its vocabulary.
    highest = counts.groupBy("b").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("pairs"))
    return counts.join(highest, "b").select("b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_level: str | None = None, pieces: str | None = None, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256) per row of ``docs``.

    ``n_shared`` counts the pairs of tokens that share a group. ``byte_level`` and
    ``pieces`` are paths to the tokenizers' files.
    """
    spark = docs.sparkSession
    files = byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES)
    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'binary' if f.type == pa.binary() else 'long'}" for f in _ROW)
    rows = stored(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_align(*files), kinds), "aligned")
    counts = stored(pair_counts(rows), "pair-table")
    sizes = counts.groupBy("b").agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # one row per B id at most
    ranges, held = [[0, 0]], 0
    for b, n in sizes:
        if held and held + n > table_pairs:
            ranges.append([b, b])
            held = 0
        ranges[-1][1], held = b + 1, held + n
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for low, high in ranges:
        part = counts.where((F.col("b") >= low) & (F.col("b") < high)).orderBy("pair").select("pair", "n", "best").toArrow()
        table = spark.sparkContext.broadcast((part["pair"].to_numpy().astype(np.uint32), part["n"].to_numpy(), part["best"].to_numpy()))
        rows = rows.mapInArrow(_looked_up(table), kinds + ", n_best long, count_sum long")
    return rows.select("id", *_SUMS, "n_best", "count_sum", "groups_sha256")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", shared_groups: bool = False, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """(id, piece, a_place, b_place, a_id, b_id, n_bytes): every link of every text; texts that do not come back have none.

    ``piece`` numbers the stretches of a text between cuts, the places count tokens inside
    it. With ``shared_groups`` the links are all pairs that share a group and
    ``n_bytes`` is null; rows are made and sent in blocks.
    """
    files = byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES)
    schema = pa.schema([("id", pa.int64()), *[(n, pa.int64()) for n in ("piece", "a_place", "b_place", "a_id", "b_id", "n_bytes")]])

    def found(batches):
        tok = _loaded(*files)
        for batch in batches:
            for key_, text_ in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                whole = [Aligned(tok, window) for window in _windows(text_.as_py())] if text_.is_valid and len(text_.as_py()) else []
                before = 0
                for done in whole if all(w.exact.all() for w in whole) else ():
                    for a, b, n in ((a, b, None) for a, b in done.shared_group_links()) if shared_groups else [(done.links_a, done.links_b, done.shared_bytes)]:
                        piece = np.searchsorted(done.a_from, a, "right") - 1
                        columns = [np.full(len(a), -1 if key_ is None else key_), piece + before, a - done.a_from[piece], b - done.b_from[piece], done.a_ids[a], done.b_ids[b]]
                        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.nulls(len(a), pa.int64()) if n is None else pa.array(n, pa.int64())]
                        arrays[0] = pa.nulls(len(a), pa.int64()) if key_ is None else arrays[0]
                        yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                    before += len(done.n_a)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(found, ", ".join(f"{f.name} long" for f in schema))
