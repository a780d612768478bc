"""Place names: gazetteer, mentioned states, resolved units and the fact bundle.

Surface forms are found through an index of whole word n-grams. In the task that reads
a text, words that begin some surface, by a bit table of fixed size, are extended to the
lengths that surfaces have, and those n-grams that pass a second bit table are
joined with the surfaces as a whole. However many surfaces share their
first word, an n-gram meets only its own; n-grams that overlap are all tried, so a
name inside a longer name counts as well. The text itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import durable, stored
from .panel import broadcast_within
from .ranking import top_in_group

# Confidences, shortest surface, direction words and extra state names.
UNIQUE_CONFIDENCE = 0.95
RESOLVED_CONFIDENCE = 0.9
SHARED_CONFIDENCE = 0.5
SHORTEST_SURFACE = 4
DIRECTIONS = r"\b(east|west|north|south|central)\b"
STATE_ALIASES = {"fct": "Federal Capital Territory", "abuja": "Federal Capital Territory"}
UNITS_KEPT = 5

#: Bits of a table of hashes; a crowded table lets more n-grams through to the join and changes no result.
TABLE_BITS = 1 << 16
#: Most surfaces or units that are sent to the tasks; more meet the mentions over a shuffle.
NAMES_SENT = 100_000
_WORD, _PIECE = r"[a-z0-9]++", r"[a-z0-9]++[^a-z0-9]*+"


def gazetteer(registry: DataFrame) -> DataFrame:
    """(surface, lga_code, state_name): every way a unit name is written."""
    base = F.col("base")
    slash = F.contains(base, F.lit("/"))
    parts = F.filter(F.transform(F.split(base, "/"), lambda s: F.trim(s)), lambda s: F.length(s) >= SHORTEST_SURFACE)
    forms = F.concat(
        F.array(base),
        F.when(slash, F.concat(parts, F.array(F.replace(base, F.lit("/"), F.lit(" "))))).otherwise(F.array().cast("array<string>")),
        F.when(F.contains(base, F.lit("-")), F.array(F.replace(base, F.lit("-"), F.lit(" ")))).otherwise(F.array().cast("array<string>")),
        F.array(F.trim(F.regexp_replace(base, DIRECTIONS, ""))),
    )
    # Written once: the forms use the normalised name many times over, and so do the readers of this table.
    named = durable(registry.select("lga_code", "state_name", tx.normalise("lga_name").alias("base")))
    return (
        named.select("lga_code", "state_name", F.explode(F.array_distinct(F.filter(forms, lambda s: F.length(s) >= SHORTEST_SURFACE))).alias("surface"))
    )


def state_surfaces(registry: DataFrame) -> DataFrame:
    """(surface, state_name) for every state and the fixed aliases."""
    names = durable(registry.select("state_name").distinct().select(tx.normalise("state_name").alias("surface"), "state_name", F.lit(0).alias("p")))
    aliases = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(n).alias("state_name"), F.lit(1).alias("p")) for s, n in STATE_ALIASES.items()])
    extra = registry.limit(1).select(F.explode(aliases).alias("a")).select("a.*")
    return names.unionByName(extra).groupBy("surface").agg(F.min_by("state_name", "p").alias("state_name"))


def _sent(names: DataFrame) -> DataFrame:
    """A table of names, broadcast after its rows are counted, so that mentions need not be dealt by name."""
    return broadcast_within(names, names.count(), NAMES_SENT)


def _slot(value) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(TABLE_BITS))


class NameIndex:
    """Surfaces by their core, the stretch from the first to the last word, with bit tables for a look inside text rows."""

    def __init__(self, surfaces: DataFrame):
        core = r"[a-z0-9](?:.*[a-z0-9])?"
        found = surfaces.select("surface").distinct().withColumn("core", F.regexp_extract("surface", core, 0)).where("core <> ''")
        # What stands outside the core, at most a separator at either end, must match too.
        self.surfaces = _sent(found).withColumns({"lead": F.regexp_extract("surface", r"^[^a-z0-9]*", 0), "tail": F.regexp_extract("surface", r"[^a-z0-9]*$", 0)})
        first, words = F.regexp_extract("core", _WORD, 0), F.size(F.regexp_extract_all("core", F.lit(_WORD), 0))
        slots = found.select(words.alias("words"), F.explode(F.array(F.struct(F.lit(0).alias("table"), _slot(first).alias("at")), F.struct(F.lit(1).alias("table"), _slot("core").alias("at")))).alias("s"))
        long = slots.groupBy("s.table", F.expr("s.at div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s.at % 64 as int))")).alias("bits"), F.collect_set("words").alias("words"))
        self.lengths, tables = set(), ([0] * (TABLE_BITS // 64), [0] * (TABLE_BITS // 64))
        for row in long.collect():  # at most one row per table and 64 bits
            tables[row["table"]][row["at"]] = row["bits"]
            self.lengths |= set(row["words"])
        # One literal, so that the plan stays small; it folds to an array of longs.
        self.first, self.whole = (F.split(F.lit(",".join(map(str, t))), ",").cast("array<bigint>") for t in tables)

    @staticmethod
    def _in(table: Column, value: Column) -> Column:
        slot = _slot(value)
        return F.getbit(F.get(table, F.floor(slot / 64).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1

    def hits(self, texts: DataFrame, text_id: str, normalised: str = "norm") -> DataFrame:
        """(text_id, surface), a row for each place in column ``normalised`` where a surface stands, bounded on both sides."""
        cut = texts.select(
            text_id, F.regexp_extract_all(normalised, F.lit(_WORD), 0).alias("_words"), F.regexp_extract_all(normalised, F.lit(_PIECE), 0).alias("_pieces")
        )
        # The outer form: of the plain one Spark infers that arrays are not empty, and asks that by cutting every text twice more below this.
        starts = cut.select(text_id, "_words", "_pieces", F.posexplode_outer("_words").alias("_i", "_w")).where(self._in(self.first, F.col("_w")))
        grams = starts.select(text_id, F.explode(F.array(*[self._extended(n) for n in sorted(self.lengths)])).alias("g")).select(text_id, "g.*")
        whole = "(lead = '' or lead <=> before) and (tail = '' or tail <=> after)"
        return grams.where(self._in(self.whole, F.col("core"))).join(self.surfaces, "core").where(whole).select(text_id, "surface")

    @staticmethod
    def _extended(n: int) -> Column:
        """(core, before, after) of the ``n`` words from word ``_i`` on, with the separators around them."""
        words, pieces, i = F.col("_words"), F.col("_pieces"), F.col("_i")
        gap = lambda k: F.substring(F.get(pieces, k), F.length(F.get(words, k)) + 1, F.length(F.get(pieces, k)))
        last = i + (n - 1)
        core = F.col("_w") if n == 1 else F.concat(F.array_join(F.slice(pieces, i + 1, n - 1), ""), F.get(words, last))
        return F.struct(core.alias("core"), F.when(i > 0, gap(i - 1)).alias("before"), F.when(last + 1 < F.size(words), gap(last)).alias("after"))


def mentions(texts: DataFrame, surfaces: DataFrame, text_id: str = "text_id", normalised: str = "norm") -> DataFrame:
    """(text_id, surface): surfaces that occur with word boundaries on both sides."""
    index = NameIndex(surfaces)
    if not index.lengths:
        return texts.select(text_id, F.lit("").alias("surface")).limit(0)
    return index.hits(texts, text_id, normalised).distinct()


def all_surfaces(registry: DataFrame) -> DataFrame:
    return gazetteer(registry).select("surface").unionByName(state_surfaces(registry).select("surface"))


def all_mentions(texts: DataFrame, registry: DataFrame, text_id: str = "text_id", normalised: str = "norm") -> DataFrame:
    """Mentions of unit and state surfaces in one pass over the texts; a surface comes as often as a text names it.

    Units and states both read this frame several times. It is small next to the
    texts, so it is written once, where it arises, and the texts are read a single time.
    """
    index = NameIndex(all_surfaces(registry))
    if not index.lengths:
        return texts.select(text_id, F.lit("").alias("surface")).limit(0)
    return stored(index.hits(texts, text_id, normalised))


def find_states(seen: DataFrame, registry: DataFrame, text_id: str = "text_id") -> DataFrame:
    """States named in each text."""
    return seen.join(_sent(state_surfaces(registry)), "surface").select(text_id, "state_name").distinct()


def resolve_units(seen: DataFrame, registry: DataFrame, text_id: str = "text_id", k: int = UNITS_KEPT) -> DataFrame:
    """The ``k`` best units of every text with their confidence.

    Rows are dealt by text alone, so the steps after that share one shuffle.
    """
    names = gazetteer(registry)
    holders = names.groupBy("surface").agg(F.count(F.lit(1)).alias("n_units"))
    held = _sent(names.join(holders, "surface"))
    shared = F.col("n_units") > 1
    sole = seen.join(held.where(~shared), "surface").select(text_id, "lga_code", F.lit(UNIQUE_CONFIDENCE).alias("confidence"))
    # A text counts once for each unit that holds a name, however often it says the name; texts without an id cannot be told apart.
    known = seen.where(F.col(text_id).isNotNull())
    said = known.join(_sent(holders.where(shared)), "surface").select(text_id, "surface").repartition(text_id).distinct()
    # Only surfaces shared by several units need the states of the text. They come as one row per text: a join by
    # text and state would deal all rows anew.
    states = known.join(_sent(state_surfaces(registry)), "surface").select(text_id, "state_name").repartition(text_id)
    states = states.groupBy(text_id).agg(F.collect_set("state_name").alias("_states"))
    named = F.when(F.array_contains("_states", F.col("state_name")), 1)
    placed = said.join(states, text_id, "left").join(held.where(shared), "surface").withColumn("named", named)
    n_named = F.count("named").over(Window.partitionBy(text_id, "surface"))
    rated = placed.withColumn("n_named", n_named).where((F.col("n_named") != 1) | F.col("named").isNotNull()).select(
        text_id, "lga_code",
        F.when(F.col("n_named") == 1, F.lit(RESOLVED_CONFIDENCE)).otherwise(F.lit(SHARED_CONFIDENCE) / F.col("n_units")).alias("confidence"),
    )
    best = sole.unionByName(rated).repartition(text_id).groupBy(text_id, "lga_code").agg(F.max("confidence").alias("confidence"))
    return top_in_group(best, [text_id], [F.desc("confidence"), F.asc("lga_code")], k, "place_rank")


def text_facts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add the facts read from the text alone: money, counts, threat, sentiment."""
    normed = texts.withColumn("norm", tx.normalise(text))
    cut = normed.withColumn("_tokens", tx.tokens(F.col("norm")))
    hit = cut.withColumn("_hits", tx.threat_hits(F.col("norm"), F.col("_tokens")))
    return hit.select(
        *texts.columns, "norm",
        tx.money(text).alias("ransom_ngn"), tx.victims(text).alias("victims"), tx.fatalities(text).alias("fatalities"),
        tx.threat_score(F.col("_tokens"), F.col("_hits")).alias("threat_score"), tx.sentiment(F.col("_tokens")).alias("sentiment"),
        tx.threat_terms(F.col("_hits")).alias("drivers"),
    )


def extract_facts(texts: DataFrame, registry: DataFrame, text_id: str = "text_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The fact bundle per text, places included, with the ``keep`` columns of ``texts`` (default: all).

    Texts are read and normalised once; what is kept of a row is written with its
    facts and its normalised text, and only that meets the places.
    """
    index = NameIndex(all_surfaces(registry))
    facts = text_facts(texts, text)
    added = [c for c in facts.columns if c not in texts.columns and c != "norm"]
    kept = list(dict.fromkeys([text_id, *(texts.columns if keep is None else keep)]))
    rows = stored(facts.select(*kept, *added, F.col("norm").alias("_norm")))
    seen = stored(index.hits(rows, text_id, "_norm"))
    units = resolve_units(seen, registry, text_id).groupBy(text_id).agg(
        F.array_sort(F.collect_list(F.struct("place_rank", "lga_code", "confidence"))).alias("_u")
    )
    states = find_states(seen, registry, text_id).groupBy(text_id).agg(F.array_sort(F.collect_set("state_name")).alias("states"))
    units = units.select(text_id, F.col("_u.lga_code").alias("lga_codes"), F.col("_u")[0]["confidence"].alias("confidence"))
    none = F.array().cast("array<string>")
    # One after the other, all by text: what a full join of the two returns would be dealt again.
    return rows.drop("_norm").join(units, text_id, "left").join(states, text_id, "left").withColumns(
        {"lga_codes": F.coalesce("lga_codes", none), "states": F.coalesce("states", none), "confidence": F.coalesce("confidence", F.lit(0.0))}
    )
