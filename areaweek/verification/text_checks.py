"""Text extraction and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Domain
from ..functions import text as tx
from ..operators import places as pl
from ..session import spread
from ..sources import pages as pg
from .panel_checks import r6
from .sql import compose

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _values(entries: dict) -> str:
    return ", ".join(f"('{k}', {v}::double)" for k, v in entries.items())


NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9\\s/''-]', ' ', 'g'), '\\s+', ' ', 'g'))"
NEG = ", ".join(f"'{n}'" for n in tx.NEGATIONS)
UNIT = "case lower({u}) " + " ".join(f"when '{k}' then {v}" for k, v in tx.MULTIPLIERS.items()) + " else 1.0 end"


def _amounts(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return (
        f"select text_id, try_cast(replace(f, ',', '') as double) * {UNIT.format(u='u')} as amount from (select text_id, "
        f"unnest(regexp_extract_all(text, '{p}', 1)) as f, unnest(regexp_extract_all(text, '{p}', 2)) as u from texts)"
    )


def _counts(pattern: str) -> str:
    words = "case lower(t) " + " ".join(f"when '{k}' then {v}" for k, v in tx.NUMBER_WORDS.items()) + " end"
    return (
        f"select text_id, max(coalesce(try_cast(t as integer), {words})) as n from (select text_id, "
        f"unnest(regexp_extract_all(text, '{pattern}', 1)) as t from texts) group by all"
    )


PARTS = {
    "texts": "select text_id, text from sentences union all select 'doc-' || doc_id, text from documents",
    "normed": f"select text_id, text, {NORM.format(c='text')} as norm from texts",
    "toks": "select text_id, unnest(string_split(norm, ' ')) as w, generate_subscripts(string_split(norm, ' '), 1) as i from normed where norm <> ''",
    "lexicon": f"select * from (values {_values({k: v for k, v in tx.THREAT_TERMS.items() if ' ' not in k})}) t(w, weight)",
    "calming": f"select * from (values {_values(tx.DEESCALATION_TERMS)}) t(w, weight)",
    "tagged": f"select *, coalesce(lag(w, 1) over o in ({NEG}), false) or coalesce(lag(w, 2) over o in ({NEG}), false) or coalesce(lag(w, 3) over o in ({NEG}), false) as negated from toks window o as (partition by text_id order by i)",
    "hits": """select text_id, 0 as kind, 0 as i, 'military operation' as w, 0.5::double as weight from normed where contains(norm, 'military operation')
        union all select text_id, 1, i, t.w, weight from tagged t join lexicon l on l.w = t.w where not negated
        union all select text_id, 2, i, t.w, weight from toks t join calming c on c.w = t.w""",
    "totals": "select text_id, sum(weight) as total, string_agg(w, ',' order by kind, i) filter (r <= 8) as terms from (select *, row_number() over (partition by text_id order by kind, i) as r from hits) group by all",
    "threat": """select n.text_id, case when norm = '' then 0.0 else greatest(0.0, least(1.0, case when s < 0 then (s + 1) / 2 else s end)) end as score, coalesce(terms, '') as terms
        from (select n.*, t.terms, coalesce(total, 0) / (greatest(1.0, len(string_split(norm, ' ')) / 40.0) + abs(coalesce(total, 0))) as s from normed n left join totals t using (text_id)) n""",
    "feelings": f"""select n.text_id, coalesce(v, 0.0) as sentiment from normed n left join (select text_id, (count(distinct c.w) - count(distinct l.w)) / (count(distinct c.w) + count(distinct l.w)) as v
        from toks t left join (select w from lexicon) l on l.w = t.w left join calming c on c.w = t.w where l.w is not null or c.w is not null group by all) using (text_id)""",
    "surfaces": f"select lga_code, state_name, {NORM.format(c='lga_name')} as surface from registry",
    "state_names": f"select distinct {NORM.format(c='state_name')} as surface, state_name from registry union all select * from (values ('fct', 'Federal Capital Territory'), ('abuja', 'Federal Capital Territory'))",
    "said_states": "select distinct text_id, state_name from normed join state_names on contains(norm, surface) and regexp_matches(norm, '\\b' || surface || '\\b')",
    "said_units": "select distinct text_id, lga_code, 0.95::double as confidence from normed join surfaces on contains(norm, surface) and regexp_matches(norm, '\\b' || surface || '\\b')",
    "places": "select * from (select *, row_number() over (partition by text_id order by confidence desc, lga_code) as place_rank from said_units) where place_rank <= 5",
    # Names shared by several units: each nation is the state of a unit named after its region.
    "shared_units": "select 'R' || n_nationkey as lga_code, r_name as lga_name, n_name as state_name from nation join region on n_regionkey = r_regionkey",
    "shared_surfaces": f"select lga_code, state_name, {NORM.format(c='lga_name')} as surface, count(*) over (partition by lga_name) as n_units from shared_units",
    "shared_states": f"select text_id, state_name from normed join (select state_name, {NORM.format(c='state_name')} as s from shared_units) on contains(norm, s) and regexp_matches(norm, '\\b' || s || '\\b')",
    "shared_hits": "select text_id, s.lga_code, surface, n_units, st.state_name is not null as named from normed join shared_surfaces s on contains(norm, surface) and regexp_matches(norm, '\\b' || surface || '\\b') left join shared_states st using (text_id, state_name)",
    "shared_rated": "select text_id, lga_code, case when n_named = 1 then 0.9 else 0.5 / n_units end as confidence from (select *, count(*) filter (named) over (partition by text_id, surface) as n_named from shared_hits) where n_named <> 1 or named",
    "amounts": _amounts(tx.MONEY_PATTERNS[0]) + " union all " + _amounts(tx.MONEY_PATTERNS[1]),
    "monies": "select text_id, max(amount) as ransom_ngn from amounts where amount >= 10000 group by all",
    "victim_counts": _counts(tx.VICTIM_PATTERN),
    "death_counts": _counts(tx.FATALITY_PATTERN),
}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, PARTS)
        return fn

    return add


def texts(spark, sf):
    """Report-like sentences from the order lines, and every document in full."""
    d = Domain(spark, sf)
    docs = d.long_texts.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    return d.sentences.unionByName(docs)


def normed(spark, sf):
    return texts(spark, sf).withColumn("norm", tx.normalise("text"))


@query("x1_normalise_text", "select text_id, norm from normed")
def x1(spark, sf):
    return normed(spark, sf).select("text_id", "norm")


@query("x1_normalise_exact", "select text_id, norm from normed")
def x1b(spark, sf):
    return texts(spark, sf).select("text_id", tx.normalise_exact("text").alias("norm"))


@query("x2_gazetteer", "select lga_code, surface, (select count(*) from normed where contains(norm, 'nation')) as texts_with_units from surfaces")
def x2(spark, sf):
    d = Domain(spark, sf)
    count = normed(spark, sf).where(F.contains(F.col("norm"), F.lit("nation"))).agg(F.count(F.lit(1)).alias("texts_with_units"))
    return pl.gazetteer(d.registry).select("lga_code", "surface").crossJoin(F.broadcast(count))


@query("x3_states", "select text_id, state_name from said_states")
def x3(spark, sf):
    registry = Domain(spark, sf).registry
    return pl.find_states(pl.all_mentions(normed(spark, sf), registry), registry)


@query("x4_resolve_places", "select text_id, lga_code, confidence, place_rank from places")
def x4(spark, sf):
    registry = Domain(spark, sf).registry
    return pl.resolve_units(pl.all_mentions(normed(spark, sf), registry), registry)


@query(
    "x4_shared_names",
    "select text_id, lga_code, round(confidence, 6) as confidence, place_rank from (select *, row_number() over (partition by text_id order by confidence desc, lga_code) as place_rank from shared_rated) where place_rank <= 5",
)
def x4b(spark, sf):
    nation = Domain(spark, sf).table("nation").join(Domain(spark, sf).table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    registry = nation.select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("lga_code"), F.col("r_name").alias("lga_name"), F.col("n_name").alias("state_name"))
    return pl.resolve_units(pl.all_mentions(normed(spark, sf), registry), registry).withColumn("confidence", F.round("confidence", 6))


@query(
    "x4_shared_first_word",
    f"""with named as (select lga_code, {NORM.format(c="'near ' || lga_name")} as surface from registry union all select 'L' || lga_code, {NORM.format(c="'near ' || lga_name || ' and'")} from registry),
        marked as (select text_id, regexp_replace(norm, '([a-z0-9]+)', '<\\1>', 'g') as m from normed),
        said as (select distinct text_id, lga_code from marked join (select lga_code, regexp_replace(surface, '([a-z0-9]+)', '<\\1>', 'g') as s from named) on contains(m, s))
        select * from (select text_id, lga_code, 0.95::double as confidence, row_number() over (partition by text_id order by lga_code) as place_rank from said) where place_rank <= 5""",
)
def x4c(spark, sf):
    """Every surface begins with the same frequent word, and each name lies inside a longer one."""
    registry = Domain(spark, sf).registry
    named = lambda code, end: registry.withColumns({"lga_code": F.concat(F.lit(code), "lga_code"), "lga_name": F.concat(F.lit("near "), "lga_name", F.lit(end))})
    units = named("", "").unionByName(named("L", " and"))
    return pl.resolve_units(pl.all_mentions(normed(spark, sf), units), units)


@query("x5_money", "select text_id, ransom_ngn from texts left join monies using (text_id)")
def x5(spark, sf):
    return texts(spark, sf).select("text_id", tx.money("text").alias("ransom_ngn"))


@query(
    "x6_counts",
    "select text_id, v.n as victims, d.n as fatalities from texts left join victim_counts v using (text_id) left join death_counts d using (text_id)",
)
def x6(spark, sf):
    return texts(spark, sf).select("text_id", tx.victims("text").alias("victims"), tx.fatalities("text").alias("fatalities"))


@query("x7_threat", "select text_id, round(score, 6) as threat_score, terms from threat")
def x7(spark, sf):
    cut = normed(spark, sf).withColumn("w", tx.tokens(F.col("norm")))
    hit = cut.withColumn("h", tx.threat_hits(F.col("norm"), F.col("w")))
    return hit.select("text_id", r6(tx.threat_score(F.col("w"), F.col("h")), "threat_score"), F.array_join(tx.threat_terms(F.col("h")), ",").alias("terms"))


@query("x8_sentiment", "select text_id, round(sentiment, 6) as sentiment from feelings")
def x8(spark, sf):
    return normed(spark, sf).withColumn("w", tx.tokens(F.col("norm"))).select("text_id", r6(tx.sentiment(F.col("w")), "sentiment"))


@query(
    "x9_fact_bundle",
    """select t.text_id, ransom_ngn, v.n as victims, d.n as fatalities, round(score, 6) as threat_score, round(sentiment, 6) as sentiment, coalesce(codes, '') as lga_codes,
       coalesce(confidence, 0.0) as confidence, coalesce(states, '') as states
       from texts t left join monies using (text_id) left join victim_counts v using (text_id) left join death_counts d using (text_id) left join threat using (text_id) left join feelings using (text_id)
       left join (select text_id, string_agg(lga_code, ',' order by place_rank) as codes, max(confidence) as confidence from places group by all) using (text_id)
       left join (select text_id, string_agg(state_name, ',' order by state_name) as states from said_states group by all) using (text_id)""",
)
def x9(spark, sf):
    facts = pl.extract_facts(texts(spark, sf), Domain(spark, sf).registry, keep=["text_id"])
    return facts.select(
        "text_id", "ransom_ngn", "victims", "fatalities", r6("threat_score", "threat_score"), r6("sentiment", "sentiment"),
        F.array_join("lga_codes", ",").alias("lga_codes"), "confidence", F.array_join("states", ",").alias("states"),
    )


# ---------------------------------------------------------------- pages
_DROP = "html"
for _tag in ("script", "style", "nav", "footer", "header", "form", "aside"):
    _DROP = f"regexp_replace({_DROP}, '(?s)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
_PLAIN = f"regexp_replace(regexp_replace({_DROP}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_ENT = "replace(replace(replace(replace({c}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
PAGE_PARTS = {
    "anchors": "select page_id, regexp_extract(url, '^https?://[^/]+') as site, unnest(regexp_extract_all(html, '(?s)<a href=\"([^\"]*)\">(.*?)</a>', 1)) as href, "
    "unnest(regexp_extract_all(html, '(?s)<a href=\"([^\"]*)\">(.*?)</a>', 2)) as raw, unnest(range(len(regexp_extract_all(html, '(?s)<a href=\"([^\"]*)\">(.*?)</a>', 1)))) as position from pages",
    "found": f"select page_id, cast(position as integer) as position, site || href as link, {_ENT.format(c='raw')} as title from anchors where trim(raw) <> ''",
}
KEYWORDS = ("th", "ent", "ción")


@query("s6_page_text", f"select page_id, trim(regexp_replace({_ENT.format(c=_PLAIN)}, '\\s+', ' ', 'g')) as text from pages")
def s6(spark, sf):
    return pg.page_text(spread(Domain(spark, sf).table("pages")))


def s5(spark, sf):
    links = pg.page_links(spread(Domain(spark, sf).table("pages")))
    return pg.select_links(links, keywords=KEYWORDS)


QUERIES["s5_page_links"] = s5
SQL["s5_page_links"] = compose(
    "select page_id, link, arg_min(title, position) as title, min(position) as position from found where "
    + " or ".join(f"contains(lower(link || ' ' || title), '{k}')" for k in KEYWORDS)
    + " group by all",
    PAGE_PARTS,
)
