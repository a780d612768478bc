"""Scans of landed files. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import parse_date
from .pages import visible_text

# Columns of the two event feeds, resource formats that hold documents.
FEED_A_COLUMNS = (
    "id", "date_start", "type_of_violence", "side_a", "side_b", "dyad_name", "latitude", "longitude", "where_prec",
    "date_prec", "best", "deaths_civilians", "source_headline", "where_description", "country",
)
FEED_B_COLUMNS = (
    "event_id_cnty", "event_date", "sub_event_type", "actor1", "actor2", "admin1", "location", "latitude", "longitude",
    "geo_precision", "fatalities", "notes", "source",
)
DOCUMENT_FORMATS = ("PDF", "CSV", "XLSX")


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_event_csv(spark: SparkSession, path: str, country: str, columns: Sequence[str] = FEED_A_COLUMNS, multiline: bool = False) -> DataFrame:
    """Bulk event rows of one country. ``multiline`` reads quoted line breaks, at the price of unsplittable files."""
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("escape", '"').option("multiLine", multiline)
    return reader.csv(path).where(F.col("country") == country)


def scan_event_pages(spark: SparkSession, path: str, columns: Sequence[str], multiline: bool = False) -> DataFrame:
    """Events of paged responses, from ``Result`` or ``data``. One page is one small object."""
    rows = T.ArrayType(text_schema(columns))
    schema = T.StructType([T.StructField("Result", rows), T.StructField("data", rows)])
    pages = spark.read.schema(schema).option("multiLine", multiline).json(path)
    return pages.select(F.explode(F.coalesce("Result", "data")).alias("e")).select("e.*")


def scan_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Feed items (link, title, published, summary); items without a link are left out."""
    names = ("link", "title", "published", "pubDate", "updated", "summary", "description", "content")
    items = spark.read.format("xml").option("rowTag", row_tag).schema(text_schema(names)).load(path)
    when = F.coalesce(F.nullif("published", F.lit("")), F.nullif("pubDate", F.lit("")), "updated")
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("description", F.lit("")), "content", F.lit(""))
    return items.where(F.coalesce("link", F.lit("")) != "").select(
        "link", F.coalesce("title", F.lit("")).alias("title"), parse_date(when).alias("published"), summary.alias("summary")
    )


def scan_feeds(spark: SparkSession, path: str) -> DataFrame:
    """RSS items and Atom entries of feeds (link, title, published, summary), summaries as visible text.

    A link is an item's text or an entry's address: the first alternate one (no
    relation means alternate), else the first of all. Rows without a link are left
    out. The summary, description or content is read as a page; the first that is
    not empty counts.
    """
    columns = text_schema(("title", "published", "pubDate", "updated", "summary", "description", "content"))
    schema = T.StructType([T.StructField("link", T.ArrayType(text_schema(("_VALUE", "_href", "_rel")))), *columns.fields])
    shapes = [spark.read.format("xml").option("rowTag", tag).schema(schema).load(path) for tag in ("item", "entry")]
    rows = shapes[0].unionByName(shapes[1])
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = F.filter("link", lambda x: F.coalesce(filled(x["_VALUE"]), filled(x["_href"])).isNotNull())
    first = F.coalesce(F.get(F.filter(named, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(named, F.lit(0)))
    body = F.coalesce(filled("summary"), filled("description"), filled("content"), F.lit(""))
    linked = rows.select(
        first.alias("l"), F.coalesce("title", F.lit("")).alias("title"), parse_date(F.coalesce(filled("published"), filled("pubDate"), "updated")).alias("published"), body.alias("body")
    ).where(F.col("l").isNotNull())
    return linked.select(F.coalesce(filled("l._VALUE"), filled("l._href")).alias("link"), "title", "published", visible_text(F.col("body")).alias("summary"))


def scan_catalogue(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Document resources of a data catalogue response."""
    resource = text_schema(("url", "name", "format"))
    dataset = T.StructType([T.StructField("title", T.StringType()), T.StructField("metadata_modified", T.StringType()), T.StructField("resources", T.ArrayType(resource))])
    schema = T.StructType([T.StructField("result", T.StructType([T.StructField("results", T.ArrayType(dataset))]))])
    datasets = spark.read.schema(schema).option("multiLine", multiline).json(path).select(F.explode("result.results").alias("d"))
    resources = datasets.select("d.title", "d.metadata_modified", F.explode("d.resources").alias("r"))
    return resources.where(F.upper("r.format").isin(*DOCUMENT_FORMATS)).select(
        F.col("r.url").alias("url"),
        F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("r.name", F.lit(""))).alias("title"),
        parse_date(F.substring("metadata_modified", 1, 10)).alias("published"),
    )


# Spellings of state names and the zone of each state.
STATE_ALIASES = {"Abuja Federal Capital Territory": "Federal Capital Territory", "FCT": "Federal Capital Territory"}
STATE_ZONES = {
    "Abia": "South East",
    "Adamawa": "North East",
    "Akwa Ibom": "South South",
    "Anambra": "South East",
    "Bauchi": "North East",
    "Bayelsa": "South South",
    "Benue": "North Central",
    "Borno": "North East",
    "Cross River": "South South",
    "Delta": "South South",
    "Ebonyi": "South East",
    "Edo": "South South",
    "Ekiti": "South West",
    "Enugu": "South East",
    "Federal Capital Territory": "North Central",
    "Gombe": "North East",
    "Imo": "South East",
    "Jigawa": "North West",
    "Kaduna": "North West",
    "Kano": "North West",
    "Katsina": "North West",
    "Kebbi": "North West",
    "Kogi": "North Central",
    "Kwara": "North Central",
    "Lagos": "South West",
    "Nasarawa": "North Central",
    "Niger": "North Central",
    "Ogun": "South West",
    "Ondo": "South West",
    "Osun": "South West",
    "Oyo": "South West",
    "Plateau": "North Central",
    "Rivers": "South South",
    "Sokoto": "North West",
    "Taraba": "North East",
    "Yobe": "North East",
    "Zamfara": "North West",
}


def default_zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATE_ZONES.items()), "state_name string, zone string")


def scan_boundaries(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Boundary features: unit attributes, geometry type and coordinates as text."""
    p = text_schema(("adm2_pcode", "adm2_name", "adm1_pcode", "adm1_name", "sendist_en", "area_sqkm", "center_lat", "center_lon"))
    feature = T.StructType([T.StructField("properties", p), T.StructField("geometry", text_schema(("type", "coordinates")))])
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    features = spark.read.schema(schema).option("multiLine", multiline).json(path).select(F.explode("features").alias("f"))
    state = F.trim("f.properties.adm1_name")
    known = state
    for alias, name in STATE_ALIASES.items():
        known = F.when(state == alias, name).otherwise(known)
    return features.select(
        F.col("f.properties.adm2_pcode").alias("lga_code"), F.col("f.properties.adm2_name").alias("lga_name"),
        F.col("f.properties.adm1_pcode").alias("state_code"), known.alias("state_name"),
        F.col("f.properties.sendist_en").alias("senatorial_district"),
        F.coalesce(F.col("f.properties.area_sqkm").try_cast("double"), F.lit(0.0)).alias("area_sqkm"),
        F.col("f.properties.center_lat").try_cast("double").alias("centre_lat"), F.col("f.properties.center_lon").try_cast("double").alias("centre_lon"),
        F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def boundary_edges(boundaries: DataFrame) -> DataFrame:
    """(lga_code, ring, seq, x1, y1, x2, y2): every ring of every polygon, holes included."""
    ring = "array<array<double>>"
    single = F.array(F.from_json("coordinates", f"array<{ring}>"))
    many = F.from_json("coordinates", f"array<array<{ring}>>")
    rings = boundaries.select("lga_code", F.posexplode(F.flatten(F.when(F.col("geometry_type") == "Polygon", single).otherwise(many))).alias("ring", "points"))
    segments = F.transform(
        F.sequence(F.lit(0), F.size("points") - 2),
        lambda i: F.struct(i.alias("seq"), F.get("points", i)[0].alias("x1"), F.get("points", i)[1].alias("y1"),
                           F.get("points", i + 1)[0].alias("x2"), F.get("points", i + 1)[1].alias("y2")),
    )
    return rings.where(F.size("points") > 1).select("lga_code", "ring", F.explode(segments).alias("s")).select("lga_code", "ring", "s.*")


def unmapped_states(units: DataFrame, zones: DataFrame) -> DataFrame:
    return units.select("state_name").distinct().join(zones, "state_name", "left_anti")


class UnmappedState(ValueError):
    """A state without a zone."""


def registry_from(boundaries: DataFrame, zones: DataFrame) -> DataFrame:
    """Registry rows; raises when a state has no zone."""
    missing = unmapped_states(boundaries, zones).limit(5).collect()
    if missing:
        raise UnmappedState(", ".join(str(r.state_name) for r in missing))
    return boundaries.join(zones, "state_name").select(
        "lga_code", "lga_name", "state_code", "state_name", "zone", "senatorial_district", "area_sqkm", "centre_lat", "centre_lon"
    )
