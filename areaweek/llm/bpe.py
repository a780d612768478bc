"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one last token that the merges
leave at its end. It is the token t whose own bytes merge to t alone and whose pair
with the last token of the shorter prefix is left alone by the merges. The table of
last tokens gives the encoding by walking back from the end; appended bytes only add
entries, and an edit keeps every entry before it.
"""

from __future__ import annotations

import array
import base64
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MULTI_50K = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces of at most this many characters are remembered, so many bytes of them per worker in each of two generations, and so many pairs.
_KEEP_CHARS, _KEEP_BYTES, _KEEP_PAIRS = 128, 32 << 20, 1 << 18
#: Texts that are Python objects at once; what is made of them goes back to Arrow before the next ones.
_RUN = 256
#: What an entry takes besides its characters and ids: two objects and their place in the table.
_ENTRY_BYTES = 200
#: A later character changes at most this many of the last pieces ("'v" + "e").
_UNSETTLED = 2


class Vocabulary:
    """Tokens and merge ranks of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        self.sizes = {rank: len(token) for token, rank in self.ranks.items()}
        self.longest = max(self.sizes.values())
        self._alone: dict[int, bool] = {}
        self._spines: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self.after = _Followers(self)
        matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            matcher.add_word(token.decode("latin-1"), (rank, -len(token)))
        matcher.make_automaton()
        self.found = matcher.iter
        self.pieces = _Pieces(self)

    def merged(self, data: bytes, least_parts: int = 1) -> list[bytes]:
        """Plain merges of a short string: lowest rank first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least_parts:
            ranks = [self.ranks.get(a + b, len(self.ranks)) for a, b in zip(parts, parts[1:])]
            if (least := min(ranks)) == len(self.ranks):
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, token: int) -> bool:
        """Do the merges of the token's own bytes end in this one token?"""
        if (known := self._alone.get(token)) is None:
            known = self._alone[token] = len(self.merged(self.tokens[token])) == 1
        return known

    def spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's left (0) or right (1) end while its merges run, with the rank of the merge that takes it up."""
        if (known := self._spines.get((token, side))) is None:
            piece, rank, known = self.tokens[token], float("inf"), []
            while True:
                known.append((piece, rank))
                if len(piece) == 1:
                    break
                rank = self.ranks[piece]
                piece = self.merged(piece, 2)[side]
            known = self._spines[token, side] = known[::-1]
        return known

    def pair(self, left: int, right: int) -> bool:
        """Do the merges leave these two side by side?

        They do unless, at some moment, what stands on both sides of the boundary has
        a merge that comes before the next merge of either: before an equal rank to
        the right, as leftmost goes first, but not before an equal rank to the left.
        """
        ranks, ends, starts = self.ranks, self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            (a, taken_a), (b, taken_b) = ends[i], starts[j]
            rank = ranks.get(a + b)
            if rank is not None and rank < taken_a and rank <= taken_b:
                return False
            if taken_a == taken_b == float("inf"):
                return True
            if taken_a <= taken_b:
                i += 1
            else:
                j += 1

    def extend(self, last: list[int], piece: bytes) -> list[int]:
        """Complete ``last``, the last tokens of the first prefixes, to all prefixes of ``piece``."""
        skip = max(0, len(last) - self.longest)
        want, after, append = len(last) - skip, self.after, last.append
        # What may follow each prefix, the longest one last: a token of n bytes that ends at the next byte follows the n-th from the end.
        rows = [after[token] for token in (last[skip - 1 :] if skip else (None, *last))]
        push = rows.append
        for end, (token, back) in self.found(piece[skip:].decode("latin-1")):
            if end == want and rows[back][token]:
                append(token)
                push(after[token])
                want += 1
        return last

    def walk(self, last: list[int], piece: bytes) -> list[int]:
        """The encoding that a full table of last tokens stands for."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]  # a piece that is a token is that token, even if no merges lead to it
        out, end, sizes = [], len(last), self.sizes
        while end:
            out.append(token := last[end - 1])
            end -= sizes[token]
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.walk([] if piece in self.ranks else self.extend([], piece), piece)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.after.held > _KEEP_PAIRS:
            self.after.clear()
            self.after.held = 0
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Followers(dict):
    """Token, or None at the start of a piece -> what may follow it, filled on demand."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, 0

    def __missing__(self, left: int | None) -> _Verdicts:
        self[left] = verdicts = _Verdicts()
        verdicts.followers, verdicts.left = self, left
        return verdicts


class _Verdicts(dict):
    """Token -> whether it stays one token and the merges leave it beside the one before."""

    __slots__ = ("followers", "left")

    def __missing__(self, token: int) -> bool:
        known = self.followers.vocabulary
        self[token] = fits = known.alone(token) and (self.left is None or known.pair(self.left, token))
        self.followers.held += 1
        return fits


class _Pieces(dict):
    """Packed ids of pieces, filled on demand, in two generations of bounded size: pieces still in use move to the younger one."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older, self.held = vocabulary, {}, 0

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = _packed(self.vocabulary.encode_piece(piece.encode()))
        if len(piece) <= _KEEP_CHARS:
            if self.held > _KEEP_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
            self.held += _ENTRY_BYTES + 2 * len(piece) + len(ids)
        return ids


_WHOLE = regex.compile(public_tokenizers.PATTERN)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _plane_pattern() -> re.Pattern:
    """The same pattern for the standard ``re``, with its classes spelled out for the first 65,536 code points: several times faster."""
    runs: dict[str, str] = {}
    for kind, group in groupby(range(0x10000), lambda code: unicodedata.category(chr(code))[0]):
        codes = list(group)
        runs[kind] = runs.get(kind, "") + f"\\u{codes[0]:04x}-\\u{codes[-1]:04x}"
    letter, number, space = runs["L"], runs["N"], "".join(f"\\u{code:04x}" for code in range(0x10000) if regex.match(r"\s", chr(code)))
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


_PLANE = _plane_pattern()


def split(text: str) -> list[str]:
    return _WHOLE.findall(text) if _BEYOND.search(text) else _PLANE.findall(text)


class EditableText:
    """A text with its pieces and their tables of last tokens, for exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.pieces: list[tuple[int, str, list[int]]] = []
        self.append(text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) and re-encode from the pieces just before the edit up to where pieces agree again."""
        whole, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        keep = next((i for i, (at, piece, _) in enumerate(self.pieces) if at + len(piece) >= start), len(self.pieces))
        keep = max(0, keep - _UNSETTLED)
        after = {at + shift: i for i, (at, _, _) in enumerate(self.pieces) if at >= end}
        fresh, old = [], {at: (piece, last) for at, piece, last in self.pieces[keep:]}
        resume = len(self.pieces)
        for found in regex.finditer(public_tokenizers.PATTERN, whole, pos=self.pieces[keep][0] if keep < len(self.pieces) else 0):
            if found.start() >= start + len(new) and found.start() in after:
                resume = after[found.start()]
                break
            piece, last = found[0].encode(), []
            if found.start() in old:
                was, known = old[found.start()]
                same = 0
                for a, b in zip(was.encode(), piece):
                    if a != b:
                        break
                    same += 1
                last = known[:same]
            fresh.append((found.start(), found[0], self.vocabulary.extend(last, piece)))
        self.pieces = self.pieces[:keep] + fresh + [(at + shift, piece, last) for at, piece, last in self.pieces[resume:]]
        self.text = whole

    def ids(self) -> list[int]:
        return [token for _, piece, last in self.pieces for token in self.vocabulary.walk(last, piece.encode())]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _in_runs(values: pa.Array) -> Iterator:
    """The values as Python objects, a few at a time: a whole batch is never held as such."""
    for at in range(0, len(values), _RUN):
        yield from values.slice(at, _RUN).to_pylist()


class _Bytes:
    """A binary array that grows in one buffer."""

    def __init__(self) -> None:
        self.data, self.ends = bytearray(), array.array("i", [0])

    def add(self, value: bytes) -> bytes:
        self.data += value
        self.ends.append(len(self.data))
        return value

    def done(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self.ends) - 1, [None, pa.py_buffer(self.ends), pa.py_buffer(self.data)])


def _mapped(run: Callable[..., bytes], values: pa.Array) -> pa.Array:
    out = _Bytes()
    for value in _in_runs(values):
        out.add(run(value))
    return out.done()


def _both(known: Vocabulary, texts: pa.Array) -> pa.Array:
    ids, decoded = _Bytes(), _Bytes()
    for text in _in_runs(texts):
        decoded.add(known.decode(ids.add(known.encode(text))))
    return pa.StructArray.from_arrays([ids.done(), decoded.done()], names=["ids", "decoded"])


def encode(text: Column, path: str = MULTI_50K) -> Column:
    """Ids of a text column, packed as little-endian unsigned 32-bit integers.

    Each match of the pre-splitting pattern is encoded by itself; no special tokens.
    Null and empty texts have no ids. ``path`` must be readable on every executor.
    """

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return _mapped(vocabulary(path).encode, texts)

    return packed(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str = MULTI_50K) -> Column:
    """The bytes that packed ids stand for; null and empty ids give no bytes."""

    @F.arrow_udf("binary")
    def unpacked(packed: pa.Array) -> pa.Array:
        return _mapped(vocabulary(path).decode, packed)

    return unpacked(F.coalesce(ids, F.lit(b"")))


def round_trip(text: Column, path: str = MULTI_50K) -> Column:
    """(ids, decoded): what ``encode`` gives, and what ``decode`` makes of it.

    One call does both, so a task needs one worker with one vocabulary; two columns,
    one made of the other, would take two.
    """

    @F.arrow_udf("ids binary, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        return _both(vocabulary(path), texts)

    return both(F.coalesce(text.cast("string"), F.lit("")))


def count(ids: Column) -> Column:
    return F.octet_length(ids).cast("long") / 4
