"""Scan, normalisation, contract, table and stream queries.

Raw feeds are written out from the given tables and read back, so files are as
large as the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import WEEKS, Domain, _columns
from ..functions import identity as idn
from ..operators import panel as p
from ..operators import spatial as sp
from ..schemas import EVENT_CLASSES, INCIDENTS, LGA_ADJACENCY, LGA_REGISTRY, TABLE_KEYS
from ..session import work_path
from ..sources import contracts as ct
from ..sources import normalise as nm
from ..sources import scans as sc
from ..sources import tables as tb
from ..streaming import drains as dr
from .panel_checks import CHATTER_PARTS, r6
from .sql import compose
from .text_checks import PARTS as TEXT_PARTS

QUERIES: dict = {}
SQL: dict[str, str] = {}

STAMP = "2024-02-01 00:00:00"
SINCE, UNTIL = "1996-01-01", "2000-12-31"
SUB_EVENTS = (
    "Abduction/forced disappearance", "Attack", "Armed clash", "Looting/property destruction", "Sexual violence", "Mob violence", "Air/drone strike",
    "Shelling/artillery/missile attack", "Government regains territory", "Non-state actor overtakes territory", "Disrupted weapons use", "Peaceful protest", " Attack ",
)

RAW_A_SQL = f"""
    cast(o_orderkey as string) as id,
    case when o_orderkey % 23 = 0 then 'unknown' else cast(cast(o_orderdate as date) as string) end as date_start,
    cast(1 + o_orderkey % 4 as string) as type_of_violence,
    case when o_orderkey % 9 = 0 then null else c_mktsegment end as side_a,
    concat('group_', cast(o_custkey % 7 as string)) as side_b,
    concat(c_mktsegment, ' - group') as dyad_name,
    case when o_orderkey % 17 = 0 then '0' when o_orderkey % 19 = 0 then null else cast(cast((o_orderkey * 7) % 1030 as int) as string) end as latitude,
    cast(cast(o_orderkey % 1100 as int) as string) as longitude,
    case when o_orderkey % 7 = 0 then 'n/a' else concat(cast(1 + o_orderkey % 5 as string), '.0') end as where_prec,
    cast(1 + o_orderkey % 3 as string) as date_prec,
    case when o_orderkey % 6 = 0 then null else concat(cast(o_orderkey % 5 as string), '.0') end as best,
    cast(o_orderkey % 3 as string) as deaths_civilians,
    concat('Order "', cast(o_orderkey as string), '", late') as source_headline,
    c_name as where_description,
    case when o_orderkey % 3 = 0 then 'Elsewhere' else 'Nigeria' end as country
"""
RAW_B_SQL = """
    concat('EV', cast(o_orderkey as string)) as event_id_cnty,
    case when o_orderkey % 23 = 0 then '' else cast(cast(o_orderdate as date) as string) end as event_date,
    case o_orderkey % 13 {subs} end as sub_event_type,
    case when o_orderkey % 11 = 0 then 'Military Forces of Nigeria (2015-)' else c_mktsegment end as actor1,
    case when o_orderkey % 4 = 0 then null else concat('group_', cast(o_custkey % 7 as string)) end as actor2,
    concat('State ', cast(c_nationkey as string)) as admin1,
    c_name as location,
    cast(cast((o_orderkey * 7) % 1030 as int) as string) as latitude,
    case when o_orderkey % 19 = 0 then 'west' else cast(cast(o_orderkey % 1100 as int) as string) end as longitude,
    cast(1 + o_orderkey % 3 as string) as geo_precision,
    case when o_orderkey % 6 = 0 then null else cast(o_orderkey % 5 as string) end as fatalities,
    concat('Note ', cast(o_orderkey as string)) as notes,
    'desk' as source
""".format(subs=" ".join(f"when {i} then '{s}'" for i, s in enumerate(SUB_EVENTS)))

JOINED = "from orders join customer on o_custkey = c_custkey"
SUBS_T = ", ".join(f"'{s}'" for s in nm.TARGET_SUB_EVENTS)
SUBS_O = ", ".join(f"'{s}'" for s in nm.OPERATION_SUB_EVENTS)
PARTS = {
    "raw_a": f"select {RAW_A_SQL} {JOINED}",
    "raw_b": f"select {RAW_B_SQL} {JOINED}",
    "bulk_a": "select * from raw_a where country = 'Nigeria'",
    "in_a": f"""select *, try_cast(date_start as date) as event_date, case type_of_violence when '1' then 'state_operation' when '2' then 'banditry_kidnapping' when '3' then 'banditry_kidnapping' else 'other' end as event_class,
        case type_of_violence when '1' then 'state_based_conflict' when '2' then 'non_state_conflict' when '3' then 'one_sided_violence' else 'unknown' end as event_type
        from raw_a where try_cast(date_start as date) is not null""",
    "in_b": f"""select *, try_cast(nullif(event_date, '') as date) as day, case when lower(trim(sub_event_type)) in ({SUBS_O}) or contains(lower(actor1), 'military forces of nigeria') then 'state_operation'
        when lower(trim(sub_event_type)) in ({SUBS_T}) then 'banditry_kidnapping' else 'other' end as event_class
        from raw_b where try_cast(nullif(event_date, '') as date) is not null""",
    "norm_a": """select substr(sha1('feed_a|' || id || '|' || event_date), 1, 24) as event_id, event_date, event_class, event_type, side_a as actor_primary, side_b as actor_secondary,
        nullif(cast(latitude as double), 0) as latitude, nullif(cast(longitude as double), 0) as longitude, cast(try_cast(where_prec as double) as integer) as geolocation_precision,
        coalesce(cast(cast(best as double) as integer), 0) as fatalities, cast(deaths_civilians as integer) as civilian_deaths from in_a""",
    "norm_b": """select substr(sha1('feed_b|' || event_id_cnty || '|' || day), 1, 24) as event_id, day as event_date, event_class, nullif(lower(trim(sub_event_type)), '') as event_type, actor1 as actor_primary, actor2 as actor_secondary,
        try_cast(latitude as double) as latitude, try_cast(longitude as double) as longitude, cast(geo_precision as integer) as geolocation_precision,
        coalesce(cast(fatalities as integer), 0) as fatalities, 0 as civilian_deaths from in_b""",
    "feeds": "select 'feed_a' as source, * from norm_a union all select 'feed_b', * from norm_b",
}
NORM_COLUMNS = ("event_id", "event_date", "event_class", "event_type", "actor_primary", "actor_secondary", "latitude", "longitude",
                "geolocation_precision", "fatalities", "civilian_deaths")


def query(name: str, sql: str | None = None, parts: dict[str, str] | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, {**PARTS, **(parts or {})})
        return fn

    return add


def ordered(d: Domain):
    return d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))


def raw_a(spark, sf):
    return ordered(Domain(spark, sf)).selectExpr(*_columns(RAW_A_SQL))


def raw_b(spark, sf):
    return ordered(Domain(spark, sf)).selectExpr(*_columns(RAW_B_SQL))


def feed_a(spark, sf):
    return nm.as_incidents(nm.feed_a_rows(raw_a(spark, sf), None, None), "feed_a", STAMP)


def feed_b(spark, sf):
    return nm.as_incidents(nm.feed_b_rows(raw_b(spark, sf), None, None), "feed_b", STAMP)


# ---------------------------------------------------------------- scans
@query("s1_event_csv_scan", "select * from bulk_a")
def s1(spark, sf):
    path = work_path(spark, "bulk")
    raw_a(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return sc.scan_event_csv(spark, path, "Nigeria")


@query("s2_event_page_scan", "select * from raw_b")
def s2(spark, sf):
    path = work_path(spark, "pages")
    rows = raw_b(spark, sf).withColumn("page", F.floor(F.substring("event_id_cnty", 3, 20).cast("long") / 1000))
    columns = [c for c in rows.columns if c != "page"]
    # A page holds a fixed number of events.
    rows.groupBy("page").agg(F.collect_list(F.struct(*columns)).alias("data")).select("data").write.json(path)
    return sc.scan_event_pages(spark, path, sc.FEED_B_COLUMNS)


FEED_STAMP = "case when doc_id % 3 = 0 then 'Mon, 0' || (1 + doc_id % 9) || ' Jan 2024 10:00:00 +0100' when doc_id % 3 = 1 then '2024-02-' || (10 + doc_id % 9) else '' end"
FEED_DAY = "case when doc_id % 3 = 0 then make_date(2024, 1, cast(1 + doc_id % 9 as int)) when doc_id % 3 = 1 then make_date(2024, 2, cast(10 + doc_id % 9 as int)) end"


@query("s3_feed_scan", f"select 'https://feed.example/' || doc_id as link, 'Item ' || doc_id as title, {FEED_DAY} as published, md5(text) as summary_md5 from documents")
def s3(spark, sf):
    path = work_path(spark, "feed")
    docs = Domain(spark, sf).table("documents")
    items = docs.select(
        F.concat(F.lit("https://feed.example/"), F.col("doc_id").cast("string")).alias("link"), F.concat(F.lit("Item "), F.col("doc_id").cast("string")).alias("title"),
        F.expr(FEED_STAMP).alias("pubDate"), F.col("text").alias("description"),
    )
    items.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return sc.scan_feed(spark, path).select("link", "title", "published", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


@query(
    "s3_feed_entries",
    f"""select case when doc_id % 2 = 0 then 'https://feed.example/' else 'https://atom.example/' end || doc_id as link, 'Item & ' || doc_id as title, {FEED_DAY} as published,
    md5(trim(regexp_replace('Lead: ' || text, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) as summary_md5 from documents where doc_id % 10 <> 7""",
)
def s3b(spark, sf):
    """Half of the documents as items, half as entries with several links; every tenth has no address. All summaries are HTML."""
    path = work_path(spark, "feeds")
    key, even = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<script>left out</script><p class='a'><b>Lead:</b> "), safe, F.lit("</p><nav>menu</nav>"))
    docs = Domain(spark, sf).table("documents").withColumns({"title": F.concat(F.lit("Item & "), key), "when": F.expr(FEED_STAMP), "html": html})
    linked = F.col("doc_id") % 10 != 7
    link = lambda rel, host: F.struct(F.lit(rel).alias("_rel"), F.concat(F.lit(host), key).alias("_href"))
    items = docs.where(even).select("title", F.concat(F.lit("https://feed.example/"), key).alias("link"), F.col("when").alias("pubDate"), F.col("html").alias("description"))
    entries = docs.where(~even).select(
        "title", F.when(linked, F.array(link("self", "https://own.example/"), link("alternate", "https://atom.example/"))).alias("link"), F.col("when").alias("updated"), F.col("html").alias("content")
    )
    items.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(f"{path}/rss")
    entries.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(f"{path}/atom")
    return sc.scan_feeds(spark, f"{path}/*").select("link", "title", "published", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


CAT_FORMAT = "case doc_id % 4 when 0 then 'pdf' when 1 then 'CSV' when 2 then 'Xlsx' else 'HTML' end"


@query(
    "s4_catalogue_scan",
    f"select 'https://data.example/' || doc_id as url, source || ': Resource ' || doc_id as title, date '2024-03-05' as published from documents where upper({CAT_FORMAT}) in ('PDF', 'CSV', 'XLSX')",
)
def s4(spark, sf):
    path = work_path(spark, "catalogue")
    key = F.col("doc_id").cast("string")
    resource = F.struct(F.concat(F.lit("https://data.example/"), key).alias("url"), F.concat(F.lit("Resource "), key).alias("name"), F.expr(CAT_FORMAT).alias("format"))
    # One response lists a bounded batch of datasets with a few resources each.
    docs = Domain(spark, sf).table("documents").withColumn("r", resource)
    sets = docs.groupBy("source", F.floor(F.col("doc_id") / 200).alias("batch")).agg(F.collect_list("r").alias("resources"))
    responses = sets.groupBy("batch").agg(F.collect_list(F.struct(F.col("source").alias("title"), F.lit("2024-03-05T10:00:00").alias("metadata_modified"), "resources")).alias("results"))
    responses.select(F.struct("results").alias("result")).write.json(path)
    return sc.scan_catalogue(spark, path)


@query(
    "s7_boundary_scan",
    """select lga_code, lga_name, state_code, state_name, zone, area_sqkm, centre_lat, centre_lon, 4 as n_edges, n as incidents from registry join (select lga_code, count(*) as n from incidents group by all) using (lga_code)""",
)
def s7(spark, sf):
    d = Domain(spark, sf)
    path = work_path(spark, "boundaries")
    x, y = F.col("centre_lon"), F.col("centre_lat")
    ring = F.array(*[F.array(a, b) for a, b in ((x - 1, y - 1), (x + 1, y - 1), (x + 1, y + 1), (x - 1, y + 1), (x - 1, y - 1))])
    feature = F.struct(
        F.struct(F.col("lga_code").alias("adm2_pcode"), F.col("lga_name").alias("adm2_name"), F.col("state_code").alias("adm1_pcode"),
                 F.concat(F.lit(" "), F.col("state_name")).alias("adm1_name"), "area_sqkm", y.alias("center_lat"), x.alias("center_lon")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    # One feature collection per unit: a collection is one JSON object, so it must stay small.
    d.registry.select(F.array(feature).alias("features")).write.json(path)
    boundaries = sc.scan_boundaries(spark, path, multiline=False)
    zones = d.registry.select("state_name", "zone").distinct().groupBy("state_name").agg(F.min("zone").alias("zone"))
    edges = sc.boundary_edges(boundaries).groupBy("lga_code").agg(F.count(F.lit(1)).cast("int").alias("n_edges"))
    counted = d.incidents.groupBy("lga_code").agg(F.count(F.lit(1)).alias("incidents"))
    return sc.registry_from(boundaries, zones).drop("senatorial_district", "zone").join(edges, "lga_code").join(counted, "lga_code").join(
        d.registry.select("lga_code", "zone"), "lga_code"
    )


@query("j14_unmapped_states", "select distinct state_name from registry_l where state_name not in (select n_name from nation where n_regionkey <> 2)")
def j14(spark, sf):
    d = Domain(spark, sf, large=True)
    zones = d.table("nation").where("n_regionkey <> 2").select(F.col("n_name").alias("state_name"))
    return sc.unmapped_states(d.registry, zones)


# ---------------------------------------------------------------- normalisation
@query("n1_incident_normalise", f"select {', '.join(NORM_COLUMNS)} from norm_a")
def n1(spark, sf):
    return feed_a(spark, sf).select(*NORM_COLUMNS)


@query("u3_union_feeds", f"select source, {', '.join(NORM_COLUMNS)} from feeds")
def u3(spark, sf):
    return nm.union_feeds(feed_a(spark, sf), feed_b(spark, sf)).select("source", *NORM_COLUMNS)


@query("n4_stable_id", "select o_orderkey, substr(sha1(coalesce(case when o_orderkey % 5 = 0 then null else o_orderpriority end, '') || '|' || o_orderkey || '|' || cast(o_orderdate as date)), 1, 24) as id from orders")
def n4(spark, sf):
    part = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderpriority"))
    return Domain(spark, sf).table("orders").select("o_orderkey", idn.stable_id(part, "o_orderkey", F.col("o_orderdate").cast("date")).alias("id"))


@query("n5_event_class_a", "select id, event_class, event_type from in_a")
def n5(spark, sf):
    return nm.feed_a_rows(raw_a(spark, sf), None, None).select(F.col("source_event_id").alias("id"), "event_class", "event_type")


@query("n6_event_class_b", "select event_id_cnty, event_class from in_b")
def n6(spark, sf):
    return nm.feed_b_rows(raw_b(spark, sf), None, None).select(F.col("source_event_id").alias("event_id_cnty"), "event_class")


@query("n7_date_window", f"select id from raw_a where try_cast(date_start as date) between date '{SINCE}' and date '{UNTIL}'")
def n7(spark, sf):
    return raw_a(spark, sf).where(idn.in_window(F.try_to_date("date_start"), SINCE, UNTIL)).select("id")


STAMPS = (
    "'%Y-%m-%d'", "'%d %B %Y'", "'%B %d, %Y'", "'%d/%m/%Y'", "'%Y/%m/%d'", "'%a, %d %b %Y 23:30:00 -0500'", "'%Y-%m-%dT23:30:00+0100'", "'week %W of %Y'",
)
SPARK_STAMPS = (
    "yyyy-MM-dd", "dd MMMM yyyy", "MMMM dd, yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "EEE, dd MMM yyyy", "yyyy-MM-dd", "yyyy",
)


@query("n8_date_parse", "select o_orderkey, case when o_orderkey % 8 < 7 then cast(o_orderdate as date) end as day from orders")
def n8(spark, sf):
    day = F.col("o_orderdate").cast("date")
    english = F.element_at(F.array(*[F.lit(x) for x in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")]), F.dayofweek(day))
    written = [F.date_format(day, f) for f in SPARK_STAMPS]
    written[5] = F.concat(english, F.lit(", "), F.date_format(day, "dd MMM yyyy"), F.lit(" 23:30:00 -0500"))
    written[6] = F.concat(written[6], F.lit("T23:30:00+0100"))
    written[7] = F.concat(F.lit("some time in "), written[7])
    text = F.get(F.array(*written), (F.col("o_orderkey") % 8).cast("int"))
    return Domain(spark, sf).table("orders").select("o_orderkey", idn.parse_date(text).alias("day"))


@query(
    "n9_tolerant_cast",
    "select id, cast(try_cast(where_prec as double) as integer) as precision, nullif(try_cast(latitude as double), 0) as latitude from raw_a",
)
def n9(spark, sf):
    return raw_a(spark, sf).select("id", idn.tolerant_int("where_prec").alias("precision"), idn.zero_as_null(idn.tolerant_double("latitude")).alias("latitude"))


DOC_PARTS = {
    "candidates": """select source, doc_id as seq, 'https://press.example/' || doc_id as url, 'Report ' || doc_id as title, case when doc_id % 2 = 0 then 'Lede ' || doc_id else '' end as summary, text as page_text from documents""",
    "bodies": "select source, url, title, trim(concat_ws(' ', nullif(summary, ''), nullif(page_text, ''))) as body from candidates",
}


def candidates(spark, sf):
    key = F.col("doc_id").cast("string")
    return Domain(spark, sf).table("documents").select(
        "source", F.col("doc_id").alias("seq"), F.concat(F.lit("https://press.example/"), key).alias("url"), F.concat(F.lit("Report "), key).alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Lede "), key)).otherwise("").alias("summary"), F.col("text").alias("page_text"),
        F.lit(None).cast("date").alias("published"),
    )


@query("n10_document_assembly", "select source, url, title, md5(body) as body_md5, case when length(body) < 120 then 'short body' end as reason from bodies", DOC_PARTS)
def n10(spark, sf):
    return nm.assemble_documents(candidates(spark, sf)).select("source", "url", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), "reason")


@query(
    "n2_document_normalise",
    "select substr(sha1(source || '|' || url), 1, 24) as doc_id, source, 'report' as doc_type, title, cast(null as date) as published_at, md5(body) as body_md5 from bodies where length(body) >= 120",
    DOC_PARTS,
)
def n2(spark, sf):
    stored = nm.as_documents(nm.assemble_documents(candidates(spark, sf)), Domain(spark, sf).registry, STAMP)
    return stored.select("doc_id", "source", "doc_type", "title", "published_at", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    "n3_chatter_normalise",
    """select substr(sha1('posts|https://posts.example/' || text_id || '|2024-01-05T10:00:00'), 1, 24) as chatter_id, first_unit as lga_code, length(text) as n_body, round(score, 6) as threat_score, round(sentiment, 6) as sentiment
       from texts left join (select text_id, lga_code as first_unit from places where place_rank = 1) using (text_id) join threat using (text_id) join feelings using (text_id)""",
    TEXT_PARTS,
)
def n3(spark, sf):
    d = Domain(spark, sf)
    docs = d.long_texts.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    posts = d.sentences.unionByName(docs).select(
        F.lit("forum").alias("platform"), F.lit("2024-01-05T10:00:00").alias("posted_at"), F.col("text").alias("body"),
        F.concat(F.lit("https://posts.example/"), "text_id").alias("url"),
    )
    stored = nm.as_chatter(posts, d.registry, "posts", STAMP)
    return stored.select("chatter_id", "lga_code", F.length("body").cast("long").alias("n_body"), r6("threat_score", "threat_score"), r6("sentiment", "sentiment"))


@query(
    "n11_topic_projection",
    """select event_id, strftime(event_date, '%Y-%m-%d') as event_day, case when latitude is not null and longitude is not null then 'POINT (' || cast(longitude as integer) || '.0 ' || cast(latitude as integer) || '.0)' end as geom_wkt from norm_a""",
)
def n11(spark, sf):
    return feed_a(spark, sf).select("event_id", F.col("event_date").cast("string").alias("event_day"), "geom_wkt")


CONTRACT = "select 'E' || o_orderkey as event_id, cast(cast(o_orderdate as date) as string) || ' 10:00' as event_date, case when o_orderkey % 10 = 0 then 'raid' else 'other' end as event_class, case when o_orderkey % 7 = 0 then 'many' when o_orderkey % 5 = 0 then null else cast(o_orderkey % 5 as string) end as fatalities, case when o_orderkey % 13 = 0 then null else 'orders' end as source from orders"


def contract_rows(spark, sf):
    key = F.col("o_orderkey")
    raw = Domain(spark, sf).table("orders").select(
        F.concat(F.lit("E"), key.cast("string")).alias("event_id"), F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 10:00")).alias("event_date"),
        F.when(key % 10 == 0, "raid").otherwise("other").alias("event_class"),
        F.when(key % 7 == 0, "many").when(key % 5 == 0, None).otherwise((key % 5).cast("string")).alias("fatalities"),
        F.when(key % 13 != 0, "orders").alias("source"), F.lit(STAMP).alias("ingested_at"),
    )
    return ct.check(raw, INCIDENTS, defaults={"fatalities": "0", "civilian_deaths": 0}, allowed={"event_class": EVENT_CLASSES})


@query("n12_contract_valid", f"select event_id, cast(substr(event_date, 1, 10) as date) as event_date, coalesce(cast(fatalities as integer), 0) as fatalities from ({CONTRACT}) where event_class = 'other' and coalesce(fatalities, '') <> 'many' and source is not null")
def n12(spark, sf):
    return ct.valid(contract_rows(spark, sf)).select("event_id", "event_date", "fatalities")


@query(
    "n12_contract_quarantine",
    f"""select event_id, concat_ws('; ', case when source is null then 'source: missing' end, case when event_class = 'raid' then 'event_class: not an allowed value' end,
        case when fatalities = 'many' then 'fatalities: wrong type' end) as reasons from ({CONTRACT}) where event_class = 'raid' or fatalities = 'many' or source is null""",
)
def n12b(spark, sf):
    return ct.quarantined(contract_rows(spark, sf)).select("event_id", F.array_join(ct.REASONS, "; ").alias("reasons"))


@query(
    "n13_json_columns",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, case when event_id % 5 = 0 then 0 else 2 end as n_codes from events",
)
def n13(spark, sf):
    code = F.concat(F.lit("U"), (F.col("user_id") % 25).cast("string"))
    text = F.when(F.col("event_id") % 5 == 0, "[broken").otherwise(F.to_json(F.array(code, F.lit("U1"))))
    rows = Domain(spark, sf).table("events").withColumn("codes", text)
    return rows.select("event_id", nm.metrics_from_json("props")["k"].cast("long").alias("k"), F.size(nm.codes_from_json("codes")).alias("n_codes"))


# ---------------------------------------------------------------- tables
@query("s8_panel_roundtrip", "select lga_code, week_start, events, fatalities, operations from own")
def s8(spark, sf):
    d = Domain(spark, sf)
    path = work_path(spark, "panel")
    panel = p.dense_facts([p.weekly_events(d.incidents)], d.registry, ("events", "fatalities", "operations"), WEEKS).select(
        "lga_code", "week_start", "events", "fatalities", "operations"
    )
    tb.write_panel(panel, path)
    return tb.read_panel(spark, path, panel.schema)


@query("s9_csv_sink", "select lga_code, cast(sum(events) as bigint) as events from weekly group by all")
def s9(spark, sf):
    path = work_path(spark, "coverage")
    table = p.weekly_events(Domain(spark, sf).incidents).groupBy("lga_code").agg(F.sum("events").alias("events"))
    tb.write_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


def published(spark, sf):
    """Both feeds in one topic, the second one published twice."""
    topic = work_path(spark, "topic")
    tb.publish(feed_a(spark, sf), topic, INCIDENTS, "feed_a", "2024-02-01")
    tb.publish(feed_b(spark, sf), topic, INCIDENTS, "feed_b", "2024-02-01")
    tb.publish(feed_b(spark, sf), topic, INCIDENTS, "feed_b", "2024-02-08")
    return topic


@query("s11_s12_topic_replay", "select source as producer, count(*) * any_value(case source when 'feed_b' then 2 else 1 end) as records, count(distinct event_id) as keys from feeds group by all")
def s11(spark, sf):
    rows = tb.replay(spark, published(spark, sf), INCIDENTS)
    keyed = rows.groupBy("producer", "event_id").agg(F.count(F.lit(1)).alias("n"))
    return keyed.groupBy("producer").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("keys"))


@query(
    "s13_upsert",
    """select event_id, event_date, case when fatalities = 0 then fatalities else fatalities + 1 end as fatalities from norm_a""",
)
def s13(spark, sf):
    path = work_path(spark, "incidents")
    rows = feed_a(spark, sf)
    tb.upsert(spark, path, "incidents", rows)
    # A later correction of every event with a casualty, sent twice over.
    fixed = rows.where("fatalities > 0").withColumns({"fatalities": F.col("fatalities") + 1, "ingested_at": F.lit("2024-02-09").cast("timestamp")})
    tb.upsert(spark, path, "incidents", rows.where("fatalities > 0").unionByName(fixed))
    tb.upsert(spark, path, "incidents", fixed)
    # The first rows once more: they are older, so they change nothing.
    tb.upsert(spark, path, "incidents", rows)
    return tb.read_table(spark, path, INCIDENTS).select("event_id", "event_date", "fatalities")


@query(
    "s11_publish_checked",
    """select case when fatalities = 4 then 'event_class: not an allowed value' when fatalities = 3 then 'event_date: wrong type' else 'in the topic' end as outcome,
        count(*) as n, count(distinct event_id) as keys from norm_a group by all""",
)
def s11b(spark, sf):
    """Rows of an unknown class or with a broken date go to quarantine; a refused batch and a repeated one change nothing."""
    topic = work_path(spark, "topic")
    rows = feed_a(spark, sf)
    broken = rows.withColumns({
        "event_class": F.when(F.col("fatalities") == 4, "unknown").otherwise(F.col("event_class")),
        "event_date": F.when(F.col("fatalities") == 3, "13th of Never").otherwise(F.col("event_date").cast("string")),
    })
    rule = {"event_class": EVENT_CLASSES}
    for _ in range(2):
        tb.publish(broken, topic, INCIDENTS, "feed_a", "2024-02-01", allowed=rule, batch="first")
    try:
        tb.publish(broken, topic, INCIDENTS, "feed_a", "2024-02-08", allowed=rule, strict=True)
    except ct.ContractBroken:
        pass
    good = tb.replay(spark, topic, INCIDENTS).select(F.lit("in the topic").alias("outcome"), "event_id")
    bad = tb.quarantine(spark, topic, INCIDENTS).select(F.array_join(ct.REASONS, "; ").alias("outcome"), "event_id")
    return good.unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("keys"))


@query("s14_typed_readers", "select event_id, event_date, event_class, lga_code, fatalities from incidents where event_class = 'banditry_kidnapping' and lga_code is not null")
def s14(spark, sf):
    path = work_path(spark, "incidents")
    rows = nm.as_incidents(Domain(spark, sf).incidents.drop("source"), "orders", STAMP)
    rows.write.parquet(path)
    return tb.read_incidents(spark, path, ["banditry_kidnapping"]).select("event_id", "event_date", "event_class", "lga_code", "fatalities")


@query(
    "s15_table_counts",
    """with held(table_name, n) as (select 'incidents', count(*) from incidents union all select 'documents', count(*) from docs union all select 'chatter', count(*) from chatter
        union all select 'lga_registry', count(*) from registry union all select 'lga_adjacency', count(*) from adjacency union all select 'lga_week_features', count(*) from dense)
        select table_name, coalesce(n, 0) as n from (values ('lga_registry'), ('lga_adjacency'), ('incidents'), ('documents'), ('chatter'), ('lga_week_features'), ('model_runs'),
        ('predictions'), ('prediction_drivers'), ('threat_actor_edges'), ('security_briefs'), ('alerts')) t(table_name) left join held using (table_name)""",
)
def s15(spark, sf):
    """All tables of the contract, six of them stored and six missing."""
    d = Domain(spark, sf)
    panel = p.unit_week_grid(d.registry, WEEKS)
    made = {"lga_registry": d.registry, "lga_adjacency": d.adjacency, "incidents": d.incidents, "documents": d.documents, "chatter": d.chatter, "lga_week_features": panel}
    stored = {}
    for name, frame in made.items():
        path = work_path(spark, name)
        frame.write.parquet(path)
        # No column is asked for, so the counts come from the files' footers.
        stored[name] = spark.read.schema(frame.schema).parquet(path)
    return tb.table_counts({name: stored.get(name) for name in TABLE_KEYS}, spark)


@query(
    "s17_reference_extracts",
    """with d as (select lga_code, count(*) as n from (select concat('C', lpad(cast(a.c_custkey as string), 9, '0')) as lga_code from customer a join customer b on b.c_custkey in (a.c_custkey - 1, a.c_custkey + 1)) group by all)
       select (select count(*) from registry_l) as units, cast(sum(n) as bigint) as edges, round(avg(n), 6) as mean_degree, min(n) as min_degree, max(n) as max_degree from d""",
)
def s17(spark, sf):
    d = Domain(spark, sf, large=True)
    units, links = work_path(spark, "registry"), work_path(spark, "adjacency")
    d.registry.write.parquet(units)
    d.adjacency.write.parquet(links)
    edges = spark.read.schema(LGA_ADJACENCY).parquet(links)
    counts = tb.read_table(spark, units, LGA_REGISTRY).agg(F.count(F.lit(1)).alias("units")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    return counts.crossJoin(tb.degree_summary(edges)).withColumn("mean_degree", F.round("mean_degree", 6))


@query("s18_load_window", "select case when event_date >= date '2001-07-18' then 'weekly' else 'older' end as part, count(*) as n from incidents where event_date >= date '1992-01-03' group by all")
def s18(spark, sf):
    incidents = Domain(spark, sf).incidents
    cold = tb.load_since(incidents.where(F.lit(False)), WEEKS.first, "2001-08-01", 14)
    warm = tb.load_since(incidents, WEEKS.first, "2001-08-01", 14)
    part = F.when(F.col("event_date") >= F.lit(warm).cast("date"), "weekly").otherwise("older")
    return incidents.where(F.col("event_date") >= F.lit(cold).cast("date")).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("s19_run_summary", "select p.producer, coalesce(n, 0) as records from (values ('feed_a'), ('feed_b'), ('press')) p(producer) left join (select source, count(*) as n from feeds group by all) on source = p.producer")
def s19(spark, sf):
    feeds = nm.union_feeds(feed_a(spark, sf), feed_b(spark, sf))
    names = F.explode(F.array(F.lit("feed_a"), F.lit("feed_b"), F.lit("press"))).alias("producer")
    producers = feeds.agg(F.count(F.lit(1)).alias("n")).select(names)
    return tb.run_summary(feeds, producers)


# ---------------------------------------------------------------- streams
@query("r1_topic_drain", f"select source, {', '.join(NORM_COLUMNS)} from feeds")
def r1(spark, sf):
    topic, table = published(spark, sf), work_path(spark, "drained")
    state = work_path(spark, "state")
    for _ in range(2):
        dr.drain(spark, topic, INCIDENTS, "incidents", table, state, files_per_batch=4).awaitTermination()
    return tb.read_table(spark, table, INCIDENTS).select("source", *NORM_COLUMNS)


@query("r1_deduplicated_drain", "select event_id, event_date from feeds")
def r1b(spark, sf):
    topic, table = published(spark, sf), work_path(spark, "drained")
    dr.drain(spark, topic, INCIDENTS, "incidents", table, work_path(spark, "state"), dedupe_within="1 day").awaitTermination()
    return tb.read_table(spark, table, INCIDENTS).select("event_id", "event_date")


@query("r2_weekly_chatter_stream", "select lga_code, week_start, volume, round(threat, 6) as threat from weekly_chatter", CHATTER_PARTS)
def r2(spark, sf):
    d = Domain(spark, sf)
    topic, table = work_path(spark, "posts"), work_path(spark, "weekly")
    posts = d.chatter.select("chatter_id", "posted_at", "lga_code", "threat_score")
    # Files out of time order, so later batches bring posts of weeks long past; then all batches come again.
    posts.repartition(6, F.col("chatter_id")).write.parquet(topic)
    for _ in range(2):
        stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 2).parquet(topic)
        dr.keep_weekly(stream, table, work_path(spark, "state"), writer="chatter").awaitTermination()
    return dr.read_weekly(spark, table).select("lga_code", "week_start", "volume", r6("threat", "threat"))


@query("r3_bounded_batches", "select event_id, event_class from norm_a")
def r3(spark, sf):
    topic, table = work_path(spark, "topic"), work_path(spark, "drained")
    tb.publish(feed_a(spark, sf).repartition(6), topic, INCIDENTS, "feed_a", "2024-02-01")
    dr.drain(spark, topic, INCIDENTS, "incidents", table, work_path(spark, "state"), files_per_batch=3).awaitTermination()
    return tb.read_table(spark, table, INCIDENTS).select("event_id", "event_class")


@query("located_feed", None)
def located_feed(spark, sf):
    """Bulk feed with units found from the coordinates, ready for the panel."""
    from .spatial_checks import cell_edges

    d = Domain(spark, sf)
    rows = feed_a(spark, sf).drop("lga_code", "state_name")
    points = rows.select(F.col("event_id").alias("point_id"), (F.col("longitude") / 100).alias("longitude"), (F.col("latitude") / 100).alias("latitude"))
    placed = sp.assign_units(points, cell_edges(d), d.registry).withColumnRenamed("point_id", "event_id")
    return rows.join(placed, "event_id").select("event_id", "event_date", "event_class", "lga_code", "located_by")
