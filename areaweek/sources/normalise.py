"""Projection of feed rows onto the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import in_window, stable_id, tolerant_double, tolerant_int, wkt_point, zero_as_null
from ..operators.places import extract_facts
from ..schemas import CHATTER, DOCUMENTS, INCIDENTS, OPERATION_CLASS, OTHER_CLASS, TARGET_CLASS

# Class maps of the two event feeds.
FEED_A_CLASSES = {"1": OPERATION_CLASS, "2": TARGET_CLASS, "3": TARGET_CLASS}
FEED_A_TYPES = {"1": "state_based_conflict", "2": "non_state_conflict", "3": "one_sided_violence"}
TARGET_SUB_EVENTS = (
    "abduction/forced disappearance", "attack", "armed clash", "looting/property destruction", "sexual violence", "mob violence",
)
OPERATION_SUB_EVENTS = (
    "air/drone strike", "shelling/artillery/missile attack", "government regains territory", "non-state actor overtakes territory",
    "disrupted weapons use",
)
MILITARY_MARK = "military forces of nigeria"
SHORTEST_BODY = 120


def mapped(value: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, result in table.items():
        out = F.when(value == key, result).otherwise(out)
    return out


def feed_a_class(violence: Column) -> Column:
    return mapped(violence, FEED_A_CLASSES, OTHER_CLASS)


def feed_a_type(violence: Column) -> Column:
    return mapped(violence, FEED_A_TYPES, "unknown")


def feed_b_class(sub_event: Column, actor: Column) -> Column:
    """Operations win over target events when the acting side is the military."""
    kind = F.lower(F.trim(F.coalesce(sub_event, F.lit(""))))
    military = F.contains(F.lower(F.coalesce(actor, F.lit(""))), F.lit(MILITARY_MARK))
    return (
        F.when(kind.isin(*OPERATION_SUB_EVENTS) | military, OPERATION_CLASS).when(kind.isin(*TARGET_SUB_EVENTS), TARGET_CLASS).otherwise(OTHER_CLASS)
    )


def as_incidents(rows: DataFrame, source: str, ingested_at) -> DataFrame:
    """The stored incident columns from any feed's columns; absent ones are null, counts default to 0."""
    have = set(rows.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None)
    values: dict[str, Column] = {f.name: get(f.name).cast(f.dataType) for f in INCIDENTS.fields}
    values["source"] = F.lit(source)
    minted = stable_id(F.lit(source), get("source_event_id"), get("event_date").cast("string"))
    values["event_id"] = F.coalesce(get("event_id").cast("string"), minted)
    values["event_class"] = F.coalesce(values["event_class"], F.lit(OTHER_CLASS))
    for count in ("fatalities", "civilian_deaths"):
        values[count] = F.coalesce(values[count], F.lit(0))
    values["ingested_at"] = F.lit(ingested_at).cast("timestamp") if isinstance(ingested_at, str) else ingested_at
    values["geom_wkt"] = wkt_point(values["longitude"], values["latitude"])
    return rows.select(*[values[f.name].alias(f.name) for f in INCIDENTS.fields])


def feed_a_rows(raw: DataFrame, since, until) -> DataFrame:
    """Typed rows of the bulk feed inside the window; unparsable dates drop out."""
    day = F.try_to_date("date_start")
    located = [c for c in ("lga_code", "state_name") if c in raw.columns]
    return raw.where(in_window(day, since, until)).select(
        F.col("id").alias("source_event_id"), day.alias("event_date"),
        feed_a_class(F.col("type_of_violence")).alias("event_class"), feed_a_type(F.col("type_of_violence")).alias("event_type"),
        F.col("side_a").alias("actor_primary"), F.col("side_b").alias("actor_secondary"), F.col("dyad_name").alias("dyad"), *located,
        zero_as_null(tolerant_double("latitude")).alias("latitude"), zero_as_null(tolerant_double("longitude")).alias("longitude"),
        tolerant_int("where_prec").alias("geolocation_precision"), tolerant_int("date_prec").alias("date_precision"),
        tolerant_int("best").alias("fatalities"), tolerant_int("deaths_civilians").alias("civilian_deaths"),
        F.col("source_headline").alias("headline"), F.col("where_description").alias("description"),
    )


def feed_b_rows(raw: DataFrame, since, until) -> DataFrame:
    day = F.try_to_date("event_date")
    located = [c for c in ("lga_code",) if c in raw.columns]
    return raw.where(in_window(day, since, until)).select(
        F.col("event_id_cnty").alias("source_event_id"), day.alias("event_date"),
        feed_b_class(F.col("sub_event_type"), F.col("actor1")).alias("event_class"),
        F.nullif(F.lower(F.trim("sub_event_type")), F.lit("")).alias("event_type"),
        F.col("actor1").alias("actor_primary"), F.col("actor2").alias("actor_secondary"), *located, F.col("admin1").alias("state_name"),
        tolerant_double("latitude").alias("latitude"), tolerant_double("longitude").alias("longitude"),
        tolerant_int("geo_precision").alias("geolocation_precision"), tolerant_int("fatalities").alias("fatalities"),
        F.col("notes").alias("headline"), F.col("location").alias("description"), F.col("source").alias("source_url"),
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def assemble_documents(candidates: DataFrame) -> DataFrame:
    """Whole bodies of all candidates, with the ``reason`` why one is no report (null: it is one).

    ``candidates``: source, seq (discovery order), url, title, published, summary, page_text.
    """
    body = F.regexp_replace(F.concat_ws(" ", F.nullif("summary", F.lit("")), F.nullif("page_text", F.lit(""))), r"^\s+|\s+$", "")
    reason = F.when(F.length("body") < SHORTEST_BODY, "short body")
    return candidates.withColumn("body", body).withColumn("reason", reason).drop("summary", "page_text", "seq")


def as_documents(assembled: DataFrame, registry: DataFrame, ingested_at: str) -> DataFrame:
    """Stored documents with their whole bodies, of the rows without a reason against them. No date is invented."""
    keyed = assembled.where("reason is null").withColumn("doc_id", stable_id("source", "url"))
    facts = extract_facts(keyed.withColumn("_all", F.concat_ws(". ", "title", "body")), registry, "doc_id", "_all")
    rows = facts.select(
        "doc_id", "source", F.col("doc_type") if "doc_type" in assembled.columns else F.lit("report").alias("doc_type"), "title",
        F.col("published").alias("published_at"), "url", "body", "lga_codes", "ransom_ngn",
        F.lit(ingested_at).cast("timestamp").alias("ingested_at"), "victims", "fatalities",
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields], "victims", "fatalities")


def as_chatter(posts: DataFrame, registry: DataFrame, source: str, ingested_at: str) -> DataFrame:
    """Stored posts: first matched unit, threat and sentiment of the whole post, which is stored whole."""
    keyed = posts.withColumn("chatter_id", stable_id(F.lit(source), "url", "posted_at"))
    facts = extract_facts(keyed, registry, "chatter_id", "body")
    given = F.col("lga_code") if "lga_code" in posts.columns else F.lit(None).cast("string")
    rows = facts.select(
        "chatter_id", "platform", F.col("posted_at").cast("timestamp").alias("posted_at"), F.coalesce(given, F.get("lga_codes", F.lit(0))).alias("lga_code"),
        "body", "sentiment", "threat_score", "url", F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHATTER.fields])


def codes_from_json(text: str) -> Column:
    """Unit codes from JSON text; broken JSON gives an empty array."""
    return F.coalesce(F.from_json(F.col(text), "array<string>"), F.array().cast("array<string>"))


def metrics_from_json(text: str) -> Column:
    return F.from_json(F.col(text), "map<string,string>")
