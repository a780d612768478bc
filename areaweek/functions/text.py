"""Text normalisation and fact extraction as column expressions.

Everything here stays inside the JVM and works row by row on whole texts, so no
shuffle is needed. ``normalise_exact`` is the Arrow form with full Unicode
compatibility folding for texts outside the built-in table.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Term weights, negations, multipliers, number words and patterns.
THREAT_TERMS = {
    "gunmen": 0.8, "bandits": 0.9, "banditry": 0.9, "kidnap": 1.0, "kidnapped": 1.0,
    "abduct": 1.0, "abducted": 1.0, "abduction": 1.0, "ransom": 0.9, "hostage": 0.9,
    "attack": 0.7, "attacked": 0.7, "raid": 0.7, "ambush": 0.8, "invaded": 0.7,
    "herdsmen": 0.5, "militia": 0.6, "insurgent": 0.7, "terrorist": 0.7,
    "gunfire": 0.6, "shooting": 0.6, "killed": 0.6, "massacre": 0.9,
    "displaced": 0.4, "fleeing": 0.5, "roadblock": 0.6, "highway": 0.3,
    "motorcycles": 0.4, "reinforcement": 0.3, "levy": 0.5, "tax": 0.2,
    "warning": 0.4, "threat": 0.6, "alert": 0.5, "sighted": 0.6, "movement": 0.4,
    "regrouping": 0.8, "camp": 0.5, "forest": 0.4, "informant": 0.5,
    "school": 0.4, "students": 0.5, "pupils": 0.5, "worshippers": 0.5,
    "military operation": 0.5, "airstrike": 0.6, "troops": 0.4, "deployment": 0.4,
}
DEESCALATION_TERMS = {
    "released": -0.7, "rescued": -0.8, "freed": -0.7, "reunited": -0.6,
    "arrested": -0.4, "neutralised": -0.5, "neutralized": -0.5, "surrendered": -0.6,
    "peace": -0.4, "calm": -0.5, "restored": -0.5, "normalcy": -0.6,
}
NEGATIONS = ("no", "not", "never", "denied", "denies", "false", "rumour", "rumor")
MULTIPLIERS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
MONEY_PATTERNS = (
    r"(?i)(?:₦|N|NGN)\s?([\d,]+(?:\.\d+)?)\s*(million|m|billion|bn|b|thousand|k)?\b",
    r"(?i)\b([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?\s*naira\b",
)
SMALLEST_AMOUNT = 10000.0
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
    "dozen": 12, "scores": 20, "several": 3,
}
PEOPLE = (
    r"persons?|people|residents?|villagers?|students?|pupils?|passengers?|"
    r"worshippers?|farmers?|herders?|herdsmen|travellers?|travelers?|traders?|"
    r"miners?|vigilantes?|soldiers?|troops|officers?|police\w*|civilians?|"
    r"women|children|schoolgirls?|schoolboys?|others?|victims?"
)
NEGATION_REACH = 3
TERMS_KEPT = 8
TOKENS_PER_SCALE = 40.0

_NUMBER = r"(\d{1,4}|" + "|".join(NUMBER_WORDS) + ")"
VICTIM_PATTERN = rf"(?i)\b{_NUMBER}\s+(?:{PEOPLE})\b"
FATALITY_PATTERN = rf"(?i)\b{_NUMBER}\s+(?:{PEOPLE})?\s*(?:were\s+|was\s+|have\s+been\s+|has\s+been\s+)?(?:killed|dead|died|slain|murdered|shot\s+dead|gunned\s+down)\b"


# The same patterns for a faster search. A number is followed by a space, so at most one of the words fits
# wherever it stands; those words are tried by their first letter.
_INITIALS = "".join(sorted({w[0] for w in NUMBER_WORDS}))
_NUMBER_BY_INITIAL = rf"(?=[\d{_INITIALS}])(\d{{1,4}}|" + "|".join(f"{i}(?:{'|'.join(w[1:] for w in NUMBER_WORDS if w[0] == i)})" for i in _INITIALS) + ")"
_FASTER = {p: p.replace(_NUMBER, _NUMBER_BY_INITIAL) for p in (VICTIM_PATTERN, FATALITY_PATTERN)}
# What every match holds: a sign with a figure behind it or the currency's name, and a word for death.
_SIGNED = r"[₦Nn]\s?[\d,]"
_CURRENCY = "naira"
_DEATHS = "killed|dead|died|slain|murdered|gunned"


_MARKER = "\ue000"
_KEPT = set("abcdefghijklmnopqrstuvwxyz0123456789/'-")


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """From Unicode data: (characters, replacements, multi-character expansions).

    The first two form one character table: letters to their lower-case ASCII
    form, everything else that has an ASCII form or is ASCII to a space.
    Characters past the replacements are combining marks and get deleted.
    """
    single: dict[str, str] = {}
    multi: dict[str, str] = {}
    marks: list[str] = []
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        ch = chr(point)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
        if len(folded) == 1 and folded.isascii():
            target = folded if folded in _KEPT else " "
            if target != ch:
                single[ch] = target
        elif any(c in _KEPT for c in folded):
            multi[ch] = folded
    return "".join(single) + "".join(marks), "".join(single.values()), multi


def fold(text: Column) -> Column:
    """Lower-case ASCII of every character that has such a form, spaces for the rest of ASCII."""
    source, target, multi = _folding()
    # The table turns every character that needs an expansion into one marker, so a
    # plain search for the marker finds the rare texts that take the long way.
    first = F.translate(text, "".join(multi) + source, _MARKER * len(multi) + target)
    # One literal, so that the plan stays small.
    pairs = F.split(F.lit("\n".join(f"{ch}\t{folded}" for ch, folded in multi.items())), "\n")
    expanded = F.aggregate(pairs, text, lambda acc, p: F.replace(acc, F.substring_index(p, "\t", 1), F.substring_index(p, "\t", -1)))
    return F.when(F.contains(first, F.lit(_MARKER)), F.translate(expanded, source, target)).otherwise(first)


def normalise(text) -> Column:
    """Lower-case ASCII words, slashes, apostrophes and hyphens, single spaces.

    ASCII texts are cut into runs of kept characters and joined again. Others take one
    pass over a character table, and patterns only touch leftover foreign characters
    and runs of spaces.
    """
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    kept = F.array_join(F.regexp_extract_all(F.lower(column), F.lit(r"[a-z0-9/'-]++"), F.lit(0)), " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(fold(column), r"[^\x00-\x7F]+", " "), " {2,}", " "))
    return F.when(F.octet_length(column) == F.char_length(column), kept).otherwise(plain)


def normalise_exact(text) -> Column:
    """The same with the complete Unicode tables, in Arrow batches."""
    keep, gap = re.compile(r"[^a-z0-9\s/'-]"), re.compile(r"\s+")

    def fold(value: str | None) -> str:
        decomposed = unicodedata.normalize("NFKD", value or "")
        base = "".join(c for c in decomposed if not unicodedata.combining(c)).lower()
        return gap.sub(" ", keep.sub(" ", base)).strip()

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(fold, na_action=None)

    return run(F.col(text) if isinstance(text, str) else text)


def tokens(normalised: Column) -> Column:
    """Words of a normalised text; an empty text has none."""
    return F.when(normalised == "", F.array().cast("array<string>")).otherwise(F.split(normalised, " "))


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def money(text) -> Column:
    """Largest naira amount of at least the floor, null when there is none."""
    column = F.col(text) if isinstance(text, str) else text
    units = literal_map(MULTIPLIERS)
    amounts = []
    for pattern, stated in zip(MONEY_PATTERNS, (F.rlike(column, F.lit(_SIGNED)), F.contains(F.lower(column), F.lit(_CURRENCY)))):
        found = F.arrays_zip(
            F.regexp_extract_all(column, F.lit(pattern), 1).alias("figure"), F.regexp_extract_all(column, F.lit(pattern), 2).alias("unit")
        )
        read = F.transform(
            found,
            lambda m: F.replace(m["figure"], F.lit(","), F.lit("")).try_cast("double")
            * F.coalesce(F.try_element_at(units, F.lower(m["unit"])), F.lit(1.0)),
        )
        amounts.append(F.when(stated, read).otherwise(F.array().cast("array<double>")))
    large = F.filter(F.concat(*amounts), lambda a: a >= SMALLEST_AMOUNT)
    return F.array_max(large)


def largest_count(text, pattern: str) -> Column:
    """Largest number, in digits or words, that the pattern finds."""
    column = F.col(text) if isinstance(text, str) else text
    words = literal_map(NUMBER_WORDS)
    found = F.regexp_extract_all(column, F.lit(_FASTER.get(pattern, pattern)), 1)
    return F.array_max(F.transform(found, lambda t: F.coalesce(t.try_cast("int"), F.try_element_at(words, F.lower(t)))))


def victims(text) -> Column:
    return largest_count(text, VICTIM_PATTERN)


def fatalities(text) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.when(F.rlike(F.lower(column), F.lit(_DEATHS)), largest_count(column, FATALITY_PATTERN))


def _hits(words: Column, terms: dict[str, float], negatable: bool) -> Column:
    """(term, weight) of every listed word in order.

    Words are screened with a hashed membership test first; only the places of the few
    hits are kept, which then look up a weight or look back for a negation.
    """
    weights = literal_map(terms)
    listed = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*terms), i)), lambda i: i.isNotNull())
    if negatable:

        def free(i: Column) -> Column:
            # Reading outside the array gives null, which counts as no negation.
            back = [F.coalesce(F.get(words, i - k).isin(*NEGATIONS), F.lit(False)) for k in range(1, NEGATION_REACH + 1)]
            return ~(back[0] | back[1] | back[2])

        listed = F.filter(listed, free)
    return F.transform(listed, lambda i: F.struct(F.get(words, i).alias("term"), F.element_at(weights, F.get(words, i)).alias("weight")))


def threat_hits(normalised: Column, words: Column) -> Column:
    """Scored terms: phrases, then threat words not negated, then de-escalation words.

    ``words`` must be a column of the input, so that it is cut only once.
    """
    phrases = {t: w for t, w in THREAT_TERMS.items() if " " in t}
    singles = {t: w for t, w in THREAT_TERMS.items() if " " not in t}
    found = F.filter(
        F.array(*[F.when(F.contains(normalised, F.lit(t)), F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight"))) for t, w in phrases.items()]),
        lambda x: x.isNotNull(),
    )
    return F.concat(found, _hits(words, singles, True), _hits(words, DEESCALATION_TERMS, False))


def threat_score(words: Column, hits: Column, continuous: bool = False) -> Column:
    """Squashed score in 0..1. ``continuous`` maps a negative total linearly below one half."""
    total = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["weight"])
    scale = F.greatest(F.lit(1.0), F.size(words) / TOKENS_PER_SCALE)
    squashed = total / (scale + F.abs(total))
    shifted = (squashed + 1) / 2
    score = shifted if continuous else F.when(squashed < 0, shifted).otherwise(squashed)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def threat_terms(hits: Column) -> Column:
    return F.slice(F.transform(hits, lambda h: h["term"]), 1, TERMS_KEPT)


def sentiment(words: Column) -> Column:
    """(calming - threatening) / both over distinct words, 0 when neither occurs."""
    listed = F.array_distinct(F.filter(words, lambda w: w.isin(*THREAT_TERMS, *DEESCALATION_TERMS)))

    def balance(found: Column) -> Column:
        calming = F.size(F.filter(found, lambda w: w.isin(*DEESCALATION_TERMS)))
        return F.when(F.size(found) == 0, F.lit(0.0)).otherwise((2 * calming - F.size(found)) / F.size(found))

    # Bound as a lambda variable, the few listed words are looked for once and not once for each use.
    return F.get(F.transform(F.array(listed), balance), F.lit(0))
