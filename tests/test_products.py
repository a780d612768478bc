import datetime as dt
import itertools
import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaweek.functions import calendar as cf
from areaweek.functions.identity import parse_date, stable_id, tolerant_int
from areaweek.operators import actors as act
from areaweek.operators import alerts as al
from areaweek.operators import calendar as cal
from areaweek.operators import explain as ex
from areaweek.operators import model as md
from areaweek.operators import serving as sv
from areaweek.schemas import EVENT_CLASSES, INCIDENTS, TABLE_KEYS
from areaweek.session import work_path
from areaweek.sources import contracts as ct
from areaweek.sources import pages as pg
from areaweek.sources import scans as sc
from areaweek.sources import tables as tb
from areaweek.sources import versions
from areaweek.streaming import drains

# ---------------------------------------------------------------- alerts
PRED = "lga_code string, lga_name string, state_name string, risk_tier string, probability double"
HIST = "lga_code string, risk_tier string, status string, dispatched_at timestamp"
NOW = "2024-01-08 06:00:00"


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame([("A", "Aville", "Alpha", "Severe", 0.4), ("B", "Bville", "Alpha", "High", 0.2), ("C", "Cville", "Alpha", "Low", 0.01)], PRED)


def history(spark, *rows):
    return spark.createDataFrame([(u, t, s, dt.datetime.fromisoformat(at)) for u, t, s, at in rows], HIST)


def actions(spark, predictions, *rows):
    return {r.lga_code: (r.action, r.reason) for r in al.decide(predictions, history(spark, *rows), NOW).collect()}


def test_only_high_tiers_alert(spark, predictions):
    got = actions(spark, predictions)
    assert set(got) == {"A", "B"} and got["A"] == ("send", "first Severe alert within the cooldown window")


def test_cooldown_and_escalation(spark, predictions):
    got = actions(spark, predictions, ("A", "Severe", "sent", "2024-01-03 00:00:00"), ("B", "Severe", "dry_run", "2024-01-03 00:00:00"))
    assert got["A"] == ("suppress_cooldown", "already alerted at Severe on 2024-01-03") and got["B"][0] == "send"
    got = actions(spark, predictions, ("A", "High", "sent", "2024-01-03 00:00:00"), ("B", "High", "sent", "2023-12-30 00:00:00"))
    assert got["A"] == ("send", "escalated from High to Severe") and got["B"][0] == "send"


def test_blast_radius(spark):
    rows = [(f"u{i}", "n", "s", "Severe" if i < 7 else "Low", 0.5) for i in range(260)]
    few = spark.createDataFrame(rows, PRED)
    every = few.withColumn("risk_tier", F.lit("Severe"))
    none = history(spark, ("x", "Low", "sent", "2024-01-01 00:00:00"))
    for frame, action, n in ((few, "send", 7), (every, "held_blast_radius", 260)):
        out = al.hold_blast_radius(al.decide(frame, none, NOW), frame)
        assert [(r.action, r["count"]) for r in out.groupBy("action").count().collect()] == [(action, n)]


def test_audit_of_a_second_evaluation_keeps_the_first(spark, predictions):
    decided = al.decide(predictions, history(spark, ("x", "Low", "sent", "2024-01-01 00:00:00")), NOW)
    first = al.audit_rows(decided, "r", "2024-01-08", NOW, sent_status="sent")
    second = al.audit_rows(decided, "r", "2024-01-08", "2024-01-08 09:00:00")
    both = first.unionByName(second)
    assert both.select("alert_id").distinct().count() == both.count() == 4
    assert json.loads(first.where("lga_code = 'A'").first().payload)["state"] == "Alpha"


# ---------------------------------------------------------------- actors
def test_actor_bounds_and_fallback(spark):
    rows = [("e1", "2024-01-01", "A", "Civilians", " band "), ("e2", "2024-06-01", "A", "band", None), ("e3", "2024-01-01", "A", "army", "unknown"), ("e4", "2018-01-01", "A", "old", None)]
    frame = spark.createDataFrame([(e, dt.date.fromisoformat(d), u, p, s, 1) for e, d, u, p, s in rows],
                                  "event_id string, event_date date, lga_code string, actor_primary string, actor_secondary string, fatalities int")
    got = {r.event_id: (r.actor, r.recency) for r in act.recent_actor_events(frame, "2024-01-01").collect()}
    assert got == {"e1": ("band", 1.0), "e3": ("army", 1.0)}
    late = {r.event_id: r.recency for r in act.recent_actor_events(frame, "2024-01-01", bounded=False).collect()}
    assert late["e2"] == 1.0
    assert act.recency_weight(F.lit("2023-01-01").cast("date"), F.lit("2024-01-01").cast("date")) is not None


# ---------------------------------------------------------------- calendar
def test_known_holidays(spark):
    years = spark.createDataFrame([(2023,), (2024,), (2025,), (2018,), (2019,)], "year int")
    easter = {r.year: str(r.easter) for r in cal.easter_by_year(years).collect()}
    assert (easter[2023], easter[2024], easter[2025]) == ("2023-04-09", "2024-03-31", "2025-04-20")
    names = {str(r.holiday): r.holiday_name for r in cal.holiday_table(years).collect()}
    assert names["2018-05-29"] == names["2019-06-12"] == "Democracy Day" and "2019-05-29" not in names
    assert names["2024-12-25"] == "Christmas" and names["2024-03-29"] == "Good Friday"
    moon = [d for d, n in names.items() if n == "Eid al-Fitr" and d.startswith("2024")]
    assert abs((dt.date.fromisoformat(moon[0]) - dt.date(2024, 4, 10)).days) <= 1


def test_easter_over_four_centuries(spark):
    def computus(y):
        a, (b, c) = y % 19, divmod(y, 100)
        h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        w = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        m = h + w - 7 * ((a + 11 * h + 22 * w) // 451) + 114
        return dt.date(y, m // 31, m % 31 + 1)

    years = spark.range(1800, 2200).select(F.col("id").cast("int").alias("year"))
    assert all(r.easter == computus(r.year) for r in cal.easter_by_year(years).collect())


def test_festival_window_and_school_terms(spark):
    days = spark.createDataFrame([(dt.date(2024, 9, 26),), (dt.date(2024, 9, 1),), (dt.date(2024, 1, 8),), (dt.date(2024, 7, 21),)], "day date")
    holidays = cal.holiday_table(cal.years_of(days, "day"))
    got = {str(r.day): (r.cal_festival_within_horizon, r.s) for r in cal.festival_flags(days, holidays, "day").withColumn("s", cf.school_in_session(F.col("day"))).collect()}
    assert got["2024-09-26"] == (1, 1) and got["2024-09-01"][0] == 0 and got["2024-07-21"][1] == 0 and got["2024-01-08"][1] == 1


# ---------------------------------------------------------------- identity, contracts, tables
def test_identity_helpers(spark):
    row = spark.createDataFrame([("a", None, "3.7", "x")], "a string, b string, c string, d string").select(
        stable_id("a", "b", "c").alias("i"), tolerant_int("c").alias("n"), tolerant_int("d").alias("m")).first()
    import hashlib

    assert row.i == hashlib.sha1(b"a||3.7").hexdigest()[:24] and row.n == 3 and row.m is None


@pytest.mark.parametrize(("text", "day"), [
    ("2024-03-05", "2024-03-05"), ("5 March 2024", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("2024/3/5", "2024-03-05"),
    ("Tue, 05 Mar 2024 23:30:00 -0500", "2024-03-05"), ("2024-03-05T23:30:00+01:00", "2024-03-05"), ("2024-03-05T23:30:00Z", "2024-03-05"),
    ("2024-13-05", None), ("tomorrow", None), ("", None), (None, None),
])
def test_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(parse_date("t").alias("d")).first().d
    assert (None if got is None else str(got)) == day


def test_contract(spark):
    rows = spark.createDataFrame(
        [("e1", "s", "2024-01-05", "other", None), ("e2", "s", "soon", "other", "3"), (None, "s", "2024-01-05", "feud", "x")],
        "event_id string, source string, event_date string, event_class string, fatalities string",
    ).withColumn("ingested_at", F.lit("2024-01-06 00:00:00"))
    checked = ct.check(rows, INCIDENTS, {"fatalities": 0, "civilian_deaths": 0}, {"event_class": EVENT_CLASSES})
    good = ct.valid(checked).first()
    assert good.event_date == dt.date(2024, 1, 5) and good.fatalities == 0 and good.actor_primary is None
    reasons = sorted(tuple(r[0]) for r in ct.quarantined(checked).select(ct.REASONS).collect())
    assert reasons == [("event_date: wrong type",), ("event_id: missing", "event_class: not an allowed value", "fatalities: wrong type")]
    with pytest.raises(ct.ContractBroken):
        ct.require_valid(checked)


CHATTER_ROWS = "chatter_id string, body string, ingested_at timestamp"


def chatter_rows(spark, *rows):
    return spark.createDataFrame([(k, v, dt.datetime(2024, 1, d)) for k, v, d in rows], CHATTER_ROWS)


def chatter_now(spark, path):
    return sorted((r.chatter_id, r.body) for r in versions.read(spark, path).collect())


def test_upsert_last_write_wins_and_replay_is_harmless(spark):
    path = work_path(spark, "t")
    tb.upsert(spark, path, "chatter", chatter_rows(spark, ("a", "1", 1), ("b", "1", 1), ("a", "2", 2)))
    for _ in range(2):
        tb.upsert(spark, path, "chatter", chatter_rows(spark, ("b", "9", 1), ("c", "1", 1)))
    want = [("a", "2"), ("b", "9"), ("c", "1")]
    assert chatter_now(spark, path) == want
    # An older batch over newer rows changes nothing, before and after compaction.
    tb.upsert(spark, path, "chatter", chatter_rows(spark, ("a", "old", 1)))
    assert chatter_now(spark, path) == want
    versions.compact(spark, path)
    assert chatter_now(spark, path) == want
    tb.upsert(spark, path, "chatter", chatter_rows(spark, ("a", "old", 1), ("c", "3", 3), (None, "x", 1)))
    assert {(r.chatter_id, r.body) for r in versions.read(spark, path).collect()} == {("a", "2"), ("b", "9"), ("c", "3"), (None, "x")}
    assert len(TABLE_KEYS) == 12


def test_a_stop_before_the_swap_loses_nothing(spark, monkeypatch):
    path = work_path(spark, "t")
    tb.upsert(spark, path, "chatter", chatter_rows(spark, ("a", "1", 1)), batch=("w", 0))
    stop = lambda *_: (_ for _ in ()).throw(OSError("stopped"))
    with monkeypatch.context() as m:
        m.setattr(versions._Folder, "swap", stop)
        for act in (lambda: tb.upsert(spark, path, "chatter", chatter_rows(spark, ("a", "2", 2)), batch=("w", 1)), lambda: versions.compact(spark, path)):
            with pytest.raises(OSError, match="stopped"):
                act()
    assert chatter_now(spark, path) == [("a", "1")]
    assert tb.upsert(spark, path, "chatter", chatter_rows(spark, ("a", "2", 2)), batch=("w", 1))
    assert not tb.upsert(spark, path, "chatter", chatter_rows(spark, ("a", "9", 9)), batch=("w", 1))
    assert chatter_now(spark, path) == [("a", "2")]
    reader = versions.read(spark, path)  # a reader of the old parts is not disturbed by new versions
    versions.append(spark, path, chatter_rows(spark, ("b", "1", 1)), ("chatter_id",), compact_after=1)
    assert [r.body for r in reader.collect()] == ["2"] and chatter_now(spark, path) == [("a", "2"), ("b", "1")]
    versions.expire(spark, path)
    assert chatter_now(spark, path) == [("a", "2"), ("b", "1")]


def test_weekly_deltas_take_late_withdrawn_and_replayed_posts(spark):
    kinds = "lga_code string, posted_at timestamp, threat_score double, sign int"
    at = lambda day: dt.datetime(2024, 1, day)
    batches = [
        [("u", at(22), 0.2, 1), ("u", at(23), None, 1), (None, at(23), 0.9, 1), ("u", None, 0.9, 1)],
        [("u", at(1), 0.7, 1), ("u", at(22), 0.1, 1), ("v", at(8), -1.0, 1)],  # three weeks late
        [("u", at(23), None, -1), ("v", at(8), -1.0, -1)],
    ]
    topic, table = work_path(spark, "posts"), work_path(spark, "weekly")
    for part in batches:
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(topic)
    for _ in range(2):
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(topic)
        drains.keep_weekly(stream, table, work_path(spark, "state"), writer="posts", sign="sign").awaitTermination()
    got = {(r.lga_code, r.week_start.day): (r.volume, r.threat) for r in drains.read_weekly(spark, table).collect()}
    assert got == {("u", 1): (1, 0.7), ("u", 22): (2, 0.2)}


def test_unmapped_state_is_an_error(spark):
    units = spark.createDataFrame([("A", "Nowhere")], "lga_code string, state_name string")
    with pytest.raises(sc.UnmappedState, match="Nowhere"):
        sc.registry_from(units, sc.default_zones(spark))
    assert sc.default_zones(spark).count() == 37


def test_load_window(spark):
    some = spark.createDataFrame([("e",)], "event_id string")
    assert tb.load_since(None, "2013-01-07", "2024-12-30", 14) == "2010-01-08"
    assert tb.load_since(some.limit(0), "2013-01-07", "2024-12-30", 14) == "2010-01-08"
    assert tb.load_since(some, "2013-01-07", "2024-12-30", 14) == "2024-12-16"


def test_pages(spark):
    html = ("<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a href='/n'>menu</a></nav><p>One &amp; two<br>three <b>bold"
            "<form>x</form></p><a href='b.pdf'>The <i>report</i></a><a href='b.pdf'>again</a><a href='c'> </a><a>no</a><footer>f</footer></body>")
    df = spark.createDataFrame([(1, "https://e.org/x/y", html), (2, None, None)], "page_id int, url string, html string")
    text = {r.page_id: r.text for r in pg.page_text(df).collect()}
    assert text == {1: "T One & two three bold The report again no", 2: ""}
    links = pg.page_links(df)
    assert [(r.link, r.title) for r in pg.select_links(links, suffix=".pdf").collect()] == [("https://e.org/x/b.pdf", "The report")]
    assert [r.link for r in pg.select_links(links, keywords=["menu"]).collect()] == ["https://e.org/n"]


# ---------------------------------------------------------------- explanation
def test_feeds_of_both_shapes(spark, tmp_path):
    (tmp_path / "atom.xml").write_text("""<feed xmlns="http://www.w3.org/2005/Atom">
      <entry><title type="html">Raid &amp; rescue</title><link rel="self" href="http://n/self"/><link rel="alternate" href="http://n/1"/><updated>2024-01-02T10:00:00Z</updated>
        <content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">two <b>men</b> held</div></content></entry>
      <entry><link rel="enclosure" href="http://n/2"/><published>2024-01-03</published><updated>2024-01-09</updated><summary type="html">&lt;p&gt;a&amp;amp;b&lt;/p&gt;&lt;script&gt;x&lt;/script&gt;</summary><content>other</content></entry>
      <entry><title>no address</title><link rel="alternate"/></entry></feed>""")
    (tmp_path / "rss.xml").write_text("""<rss><channel><title>t</title><item><title>R</title><link>http://n/3</link><summary> </summary><description><![CDATA[<i>late</i> <nav>menu</nav>news]]></description></item>
      <item><link></link><title>empty</title></item></channel></rss>""")
    got = {r.link: (r.title, r.published, r.summary) for r in sc.scan_feeds(spark, f"{tmp_path}/*.xml").collect()}
    assert got == {
        "http://n/1": ("Raid & rescue", dt.date(2024, 1, 2), "two men held"), "http://n/2": ("", dt.date(2024, 1, 3), "a&b"), "http://n/3": ("R", None, "late news"),
    }


def test_serving_extract_writes_seven_tables(spark):
    one = lambda **values: spark.createDataFrame([tuple(values.values())], list(values))
    event = lambda n, kind, unit: (n, unit, "2024-01-02", kind, "t", "a", "b", 1, "h", "secret")
    incidents = spark.createDataFrame(
        [event("1", "banditry_kidnapping", "u"), event("2", "banditry_kidnapping", None), event("3", "other", "u")],
        "event_id string, lga_code string, event_date string, event_class string, event_type string, actor_primary string, actor_secondary string, fatalities int, headline string, description string",
    )
    tables = {
        "lga_registry": one(lga_code="u"), "model_runs": one(run_id="r"), "predictions": one(run_id="r", probability=0.5), "prediction_drivers": one(run_id="r", lga_code="u"),
        "threat_actor_edges": one(run_id="r", target_kind="lga", target="u"), "security_briefs": one(brief_id="b"), "incidents": incidents, "alerts": one(alert_id="a"),
    }
    paths = sv.serving_extract(tables, work_path(spark, "serving"))
    assert set(paths) == set(tables) - {"alerts"}
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    assert all(frame.count() == 1 for frame in read.values())
    assert len(read["incidents"].columns) == 9 and read["incidents"].first().event_id == "1"
    with pytest.raises(ValueError, match="predictions"):
        sv.serving_extract({k: v for k, v in tables.items() if k != "predictions"}, work_path(spark, "serving"))


def test_rendered_values(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (0.5,), (100.0,), (1234.56,), (0.126,), (-2.0,)], "v double")
    assert [r.s for r in df.select(ex.rendered(F.col("v")).alias("s")).collect()] == ["0", "10", "0.5", "100", "1,235", "0.13", "-2"]


def test_tree_attributions_are_shapley_values(spark):
    rows = [(f"u{i}", dt.date(2024, 1, 1), float(i % 7), float((i * 3) % 5), float((i * 5) % 11), int((i % 7 > 3) ^ ((i * 3) % 5 > 2)), "train" if i % 4 else "valid") for i in range(240)]
    frame = spark.createDataFrame(rows, "lga_code string, week_start date, a double, b double, c double, label int, fold string")
    names = ["a", "b", "c"]
    booster = md.fit_booster(frame, names, trees=4, depth=3, min_child=1, row_share=1.0, column_share=1.0)
    leaves, base = ex.ensemble_leaves(booster, names)
    some = frame.limit(12)
    margins = {r.lga_code: r.rawPrediction[1] for r in booster.transform(md.as_vectors(some, names)).select("lga_code", "rawPrediction").collect()}
    got = {}
    for r in ex.tree_attributions(booster, some, names).collect():
        got.setdefault(r.lga_code, {})[r.feature_name] = r.shap_value
    values = {r.lga_code: (r.a, r.b, r.c) for r in some.collect()}

    def game(x, known):
        total = 0.0
        for value, path in leaves:
            share = 1.0
            for f, (lo, hi, z) in path.items():
                share *= float(lo < x[f] <= hi) if f in known else z
            total += value * share
        return total

    for unit, x in values.items():
        assert base + sum(got[unit].values()) == pytest.approx(margins[unit], abs=1e-9)
        for i, name in enumerate(names):
            brute = 0.0
            others = [j for j in range(3) if j != i]
            for k in range(3):
                for s in itertools.combinations(others, k):
                    brute += math.factorial(k) * math.factorial(2 - k) / 6 * (game(x, {*s, i}) - game(x, set(s)))
            assert got[unit][name] == pytest.approx(brute, abs=1e-9)


# ---------------------------------------------------------------- topics
def test_publish_checks_stages_and_finishes(spark, monkeypatch):
    topic = work_path(spark, "topic")
    schema = T.StructType([T.StructField("k", T.StringType(), False), T.StructField("n", T.IntegerType(), True)])
    rows = spark.createDataFrame([("a", "1"), ("b", "x"), (None, "2"), ("c", None)], "k string, n string").repartition(2)
    held = lambda: sorted(r.k for r in tb.replay(spark, topic, schema).collect())
    with pytest.raises(ct.ContractBroken, match="wrong type|missing"):
        tb.publish(rows, topic, schema, "p", "2024-01-01", strict=True)
    assert not tb.path_exists(spark, f"{topic}/producer=p")
    for _ in range(2):
        tb.publish(rows, topic, schema, "p", "2024-01-01", batch="one")
    assert held() == ["a", "c"]
    bad = {(r.k, tuple(r[ct.REASONS])) for r in tb.quarantine(spark, topic, schema).collect()}
    assert bad == {("b", ("n: wrong type",)), (None, ("k: missing",))}
    # A job that fails while it writes leaves nothing; the same batch can be published afterwards.
    fails = rows.where("k is not null").withColumn("n", F.when(F.col("k") == "b", F.raise_error(F.lit("stopped"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stopped"):
        tb.publish(fails, topic, schema, "p", "2024-01-02", batch="two")
    assert held() == ["a", "c"]
    tb.publish(rows.where("k = 'a'"), topic, schema, "p", "2024-01-02", batch="two")
    assert held() == ["a", "a", "c"]


def test_rows_that_fit_are_published_without_being_sorted_into_folders(spark, monkeypatch):
    """The files of a batch in which all rows fit are those its tasks wrote, and a move that stops is finished."""
    topic = work_path(spark, "topic")
    schema = T.StructType([T.StructField("k", T.LongType(), False)])
    rows = spark.range(90).withColumnRenamed("id", "k").repartition(3)
    place = f"{topic}/producer=p/ingest_date=2024-01-01"
    moved = spark.range(1).select(F.lit(-1).cast("long").alias("k"))
    for _ in range(2):
        tb.publish(rows, topic, schema, "p", "2024-01-01", batch="one")
    assert not tb.path_exists(spark, f"{topic}/_staging/one/fits=true") and not tb.path_exists(spark, f"{topic}/_quarantine")
    assert len(spark.read.parquet(place).inputFiles()) == 3
    # One file back in the staging folder, as if the move had stopped there; the batch's rows are not written anew.
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    files = new_path(topic).getFileSystem(spark._jsc.hadoopConfiguration())
    last = new_path(spark.read.parquet(place).inputFiles()[0])
    assert files.rename(last, new_path(f"{topic}/_staging/one/every/{last.getName().removeprefix('one-')}"))
    tb.publish(moved, topic, schema, "p", "2024-01-01", batch="one")
    assert sorted(r.k for r in tb.replay(spark, topic, schema).collect()) == list(range(90))
