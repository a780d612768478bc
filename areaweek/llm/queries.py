"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweek.llm import alignment, bpe, collocations, counts, jaccard, lines, mixing, neardup_vectors, neighbours, secrets, toxicity, urlfilter, warc
from areaweek.llm.common import table
from areaweek.session import work_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), work_path(spark, "warc"), "page_id", "url", "html")
    return warc.read(manifest).select(
        F.expr("nullif(record_id, '')").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP2_SQL = r"""
with recursive words as (
  select row_number() over () as row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select row_id, array_to_string(w[i:i + 4], ' ') as s from (select row_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from words where len(w) > 0) group by all
), sets as (
  select row_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as set_id from shingles group by row_id
), classes as (
  select set_id, any_value(row_id) as row_id, min(doc_id) as doc_id, any_value(n) as n from sets join words using (row_id) group by set_id
), tokens as (
  select set_id, n, s from classes join shingles using (row_id)
), links as (
  select a.set_id as u, b.set_id as v from tokens a join tokens b on a.s = b.s and a.set_id != b.set_id group by a.set_id, b.set_id, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach as (
  select set_id as u, set_id as v from classes union select r.u, l.v from reach r join links l on l.u = r.v
), components as (
  select r.u as set_id, min(c.doc_id) as component_id from reach r join classes c on c.set_id = r.v group by r.u
)
select w.doc_id, coalesce(s.n, 0) as n_shingles, case when s.set_id is null then w.doc_id else c.component_id end as component_id
from words w left join sets s using (row_id) left join components c using (set_id)
"""


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings")
    return neighbours.search(base, base.where("vec_id % 100 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text")).alias("both")).select("doc_id", "both.*")
    return both.select(
        "doc_id", bpe.count(F.col("ids")).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _share(n: int) -> Column:
    """Every third document by its id, the same in each batch."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(3)) == n


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents come first; the second scan meets the ledger of the first."""
    docs, ledger = table(spark, sf_dir, "documents"), work_path(spark, "ledger")
    secrets.scan(docs.where(_share(0)), ledger)
    found = secrets.scan(docs, ledger)
    spans = secrets.written(F.col("spans"))
    return found.select(
        F.col("path").alias("doc_id"), *[secrets.counted(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as three batches: a third of the documents is revised, another deleted and put back.

    Revised documents come first with half their text and another source; the last
    batch also brings stale changes, which are passed over. A repeated commit changes
    nothing. The totals are those of the table as it stands.
    """
    root, docs = work_path(spark, "counts"), table(spark, sf_dir, "documents")
    revised, dropped = _share(0), _share(1)

    def rows(of: Column, op: Column, text: Column, source: Column, seq: Column) -> DataFrame:
        """One scan for all changes of a batch."""
        return docs.where(of).select(op.alias("op"), F.col("doc_id").alias("id"), text.alias("text"), source.alias("source"), "lang", seq.alias("seq"))

    put, text, source = F.lit("put"), F.col("text"), F.col("source")
    half, early = F.expr("left(text, length(text) div 2)"), F.concat(F.lit("early-"), F.coalesce("source", F.lit("")))
    batches = {
        "load": rows(F.lit(True), put, F.when(revised, half).otherwise(text), F.when(revised, early).otherwise(source), F.lit(1)),
        "change": rows(revised | dropped, F.when(dropped, "delete").otherwise(put), F.when(revised, text), source, F.lit(2)),
        "back": rows(revised | dropped, put, F.when(dropped, text).otherwise("stale"), source, F.when(dropped, 3).otherwise(1)),
    }
    for name, changes in batches.items():
        counts.commit(changes, root, name)
    counts.commit(batches["back"], root, "back")
    return counts.totals(spark, root)


def op7_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup_vectors.link(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


OP7_SQL = """
with recursive rows as (
  select row_number() over () as row_id, vec_id, label, embedding::double[] as v from embeddings
), valid as (
  select * from rows where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x != 0)) > 0
), links as (
  select a.row_id as u, b.row_id as w from valid a join valid b on a.label = b.label and len(a.v) = len(b.v) and a.row_id != b.row_id where list_cosine_similarity(a.v, b.v) >= 0.93::double
), reach as (
  select row_id as u, row_id as w from rows union select r.u, l.w from reach r join links l on l.u = r.w
), components as (
  select r.u as row_id, min(t.vec_id) as component_id from reach r join rows t on t.row_id = r.w group by r.u
)
select r.vec_id, coalesce(n, 0) as n_links, component_id, r.vec_id is not distinct from component_id as kept
from rows r join components c using (row_id) left join (select u as row_id, count(*) as n from links group by u) l using (row_id)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards hold of each document: words, blocks, the number of shards, and a hash over the shard and place of every block."""
    draws, rows = mixing.mix(table(spark, sf_dir, "documents"))
    held = draws.groupBy("row_id", "shard").agg(F.sum("words").alias("words"), F.count("*").alias("blocks"), F.bit_xor(F.xxhash64("shard", "place", "block", "pass")).alias("mark"))
    taken = held.groupBy("row_id").agg(F.sum("words").alias("taken"), F.sum("blocks").alias("n_blocks"), F.count("*").alias("n_shards"), F.bit_xor("mark").alias("placement"))
    return rows.join(taken, "row_id", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_blocks", "n_shards", "placement")]
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
with places as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as place, unnest(string_split(text, chr(10))) as line from documents where text is not null
), firsts as (
  select line, length(line) as n, min((doc_id, place)) as first from places where length(line) >= 30 group by line
), halves as (
  select line, first, n, shift from firsts, (values (0), (1)) s(shift)
), longer as (
  select line, first, n - shift as n, left(line, (n - shift) // 2) as head, right(line, n - shift - (n - shift) // 2) as tail from halves
), met as (
  select a.line as x, a.first as fx, b.line as y, b.first as fy from firsts a join longer b on a.n = b.n and left(a.line, a.n // 2) = b.head where a.line != b.line
  union
  select a.line, a.first, b.line, b.first from firsts a join longer b on a.n = b.n and right(a.line, a.n - a.n // 2) = b.tail where a.line != b.line
), near as (
  select distinct case when fx < fy then y else x end as line from met where levenshtein(x, y) <= 1
), marked as (
  select p.doc_id, p.place, p.line, length(p.line) >= 30 and (f.first != (p.doc_id, p.place) or n.line is not null) as gone
  from places p left join firsts f on p.line = f.line left join near n on p.line = n.line
)
select d.doc_id, coalesce(m.n_lines, 0) as n_lines, coalesce(m.n_removed, 0) as n_removed,
  case when d.text is not null then sha256(coalesce(m.kept, '')) end as kept_sha256
from documents d left join (
  select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_removed, string_agg(line, chr(10) order by place) filter (not gone) as kept
  from marked group by doc_id
) m using (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return scorer.score(docs, F.col("text"), ["doc_id"]).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
  select row_number() over () as piece_id, * from (
    select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
  )
), words as (
  select lang, piece_id, generate_subscripts(w, 1) as place, unnest(w) as w1 from (select *, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces)
), runs as (
  select lang, w1, lead(w1) over p as w2, lead(w1, 2) over p as w3 from words window p as (partition by piece_id order by place)
), grams as (
  select lang, 1 as m, w1 as phrase from runs
  union all select lang, 2, w1 || ' ' || w2 from runs where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from runs where w3 is not null
), counted as (
  select lang, m, phrase, count(*) as f from grams group by lang, m, phrase
), totals as (
  select lang, count(*) as n from words group by lang
), candidates as (
  select lang, m, phrase, f as a, string_split(phrase, ' ') as w from counted where m > 1 and f >= 10
), cuts as (
  select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, m)) as k from candidates) c
  join counted x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
  join counted y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:c.m], ' ')
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
  select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as longer
  from (select *, unnest([1, 2]) as i from candidates where m = 3) group by 1, 2
), kept as (
  select b.* from best b left join inside i using (lang, phrase) where i.longer is null or 100 * i.longer < 50 * b.a
)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from kept k join totals t using (lang)
qualify rank <= 2000
"""


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "verdict string, host string, path string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


OP12_SQL = r"""
with recursive rules(verdict, site, path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), cut as (
  select *, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from (select row_number() over () as row_id, * from pages)
), fits as (
  select c.row_id, r.verdict, r.site || r.path as rule from cut c join rules r
  on (c.host = r.site or ends_with(c.host, '.' || r.site)) and starts_with(c.path, r.path)
  qualify row_number() over (partition by c.row_id order by length(r.site || r.path) desc, length(r.site) desc, r.site || r.path) = 1
), hosts as (
  select host, count(*) as pages, count(*) filter (verdict = 'allow') as allowed, count(*) filter (verdict = 'block') as blocked
  from cut left join fits using (row_id) where host != '' group by host
), seeds as (
  select case when 2 * allowed > pages then 'trust' else 'distrust' end as kind, host from hosts where 2 * allowed > pages or 2 * blocked > pages
), linked as (
  select host as src, translate(unnest(regexp_extract_all(html, 'href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<>\s]+)', 1, 'i')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst
  from cut where host != ''
), tied as (
  select h.host, u.host as above from hosts h join hosts u on ends_with(h.host, '.' || u.host)
  qualify row_number() over (partition by h.host order by length(u.host) desc) = 1
), links as (
  select src, dst, sum(n) as n from (
    select src, dst, count(*) as n from linked where src != dst group by all
    union all select host, above, 1 from tied union all select above, host, 1 from tied
  ) group by src, dst
), edges as (
  select kind, src, dst, 0.85::double * (n::double / (sum(n) over (partition by kind, src))::double) as share
  from (select 'trust' as kind, src, dst, n from links union all select 'distrust', dst, src, n from links)
), mass as (
  select 0 as round, kind, host, 1000000000::bigint as mass from seeds
  union all
  select round, kind, host, sum(mass)::bigint from (
    select m.round + 1 as round, e.kind, e.dst as host, floor(m.mass::double * e.share)::bigint as mass from mass m join edges e on e.kind = m.kind and e.src = m.host where m.round < 20
    union all
    select r.round, s.kind, s.host, floor((1.0::double - 0.85::double) * 1000000000)::bigint from seeds s, (select distinct round + 1 as round from mass where round < 20) r
  ) group by round, kind, host
), held as (
  select host, coalesce(sum(mass) filter (kind = 'trust'), 0)::bigint as trust, coalesce(sum(mass) filter (kind = 'distrust'), 0)::bigint as distrust
  from mass where round = 20 group by host
)
select c.page_id, c.host, c.path, f.rule, coalesce(h.trust, 0) as trust, coalesce(h.distrust, 0) as distrust,
  coalesce(f.verdict, case when h.distrust > h.trust and h.distrust >= 0.01::double * (1.0::double - 0.85::double) * 1000000000 then 'block' end, 'allow') as verdict
from cut c left join fits f using (row_id) left join held h on h.host = c.host
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_warc": op1_warc, "op2_jaccard": op2_jaccard, "op3_neighbours": op3_neighbours, "op4_bpe": op4_bpe, "op5_secrets": op5_secrets, "op6_token_counts": op6_token_counts, "op7_vector_neardup": op7_vector_neardup, "op8_mixing": op8_mixing, "op9_lines": op9_lines, "op10_toxicity": op10_toxicity, "op11_collocations": op11_collocations, "op12_url_filter": op12_url_filter, "op13_alignment": op13_alignment}
SQL: dict[str, str] = {"op2_jaccard": OP2_SQL, "op7_vector_neardup": OP7_SQL, "op9_lines": OP9_SQL, "op11_collocations": OP11_SQL, "op12_url_filter": OP12_SQL}
