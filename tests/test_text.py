import unicodedata

import pytest
from pyspark.sql import functions as F

from areaweek.functions import text as tx
from areaweek.operators import places as pl


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "expected"), [
    ("a ransom of N15 million was paid", 15e6), ("they demanded ₦2.5m", 2.5e6), ("the family paid 500,000 naira", 5e5),
    ("NGN 1.2 billion in levies", 1.2e9), ("the convoy of 20 vehicles", None), ("on 12 January 2024", None),
    ("N5,000 then N40k", 40e3), (None, None), ("in 20,000 homes", 20e3),
])
def test_money(spark, text, expected):
    assert one(spark, text, tx.money("t")) == expected


@pytest.mark.parametrize(("text", "expected"), [
    ("three people were killed", 3), ("Fourteen residents were killed in the raid", 14), ("17 villagers died", 17),
    ("two herders shot dead", 2), ("the market reopened", None), ("five dead, twelve persons have been killed", 12),
])
def test_fatalities(spark, text, expected):
    assert one(spark, text, tx.fatalities("t")) == expected


def threat(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(tx.normalise("t").alias("n")).withColumn("w", tx.tokens(F.col("n")))
    df = df.withColumn("h", tx.threat_hits(F.col("n"), F.col("w")))
    return df.select(tx.threat_score(F.col("w"), F.col("h")).alias("s"), tx.threat_terms(F.col("h")).alias("d")).first()


def test_threat_score(spark):
    quiet = threat(spark, "The market reopened and traders returned to town.")
    loud = threat(spark, "Gunmen on motorcycles ambush travellers; fourteen abducted for ransom")
    assert quiet.s == 0 and loud.s > 0.5 and loud.d == ["gunmen", "motorcycles", "ambush", "abducted", "ransom"]
    assert threat(spark, "police denied that bandits attacked").s < threat(spark, "police said that bandits attacked").s
    assert threat(spark, "").s == 0
    assert threat(spark, "calm restored").s == pytest.approx((1 - 1 / 2) / 2)
    assert threat(spark, "a military operation").d == ["military operation"]


def test_sentiment(spark):
    df = spark.createDataFrame([("attack attack peace",), ("nothing",)], "t string").select(tx.sentiment(tx.tokens(F.col("t"))).alias("v"))
    assert [r.v for r in df.collect()] == [0.0, 0.0]


def test_normalise_equals_the_exact_form(spark):
    samples = ["Wasagu/Danko, Kebbi!", "ÀÉîõü ñ ß ø", "été", "ﬁne ﬂow №5 ™", "x²  \t y", "ＡＢＣ １２", None, "İstanbul ſ", "don't-stop", "𝐁𝐚𝐧𝐝𝐢𝐭𝐬 attack 5㎏ ½ ㏂"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    rows = df.select("i", tx.normalise("t").alias("a"), tx.normalise_exact("t").alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert rows[0].a == "wasagu/danko kebbi" and rows[2].a == unicodedata.normalize("NFKD", "ete")


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(
        [("K1", "Wasagu/Danko", "Kebbi"), ("K2", "Birnin-Gwari", "Kaduna"), ("O1", "Ifelodun", "Osun"), ("O2", "Ifelodun", "Kwara"),
         ("B1", "Maiduguri", "Borno"), ("N1", "Katsina North", "Katsina"), ("Q1", "Obi", "Benue")],
        "lga_code string, lga_name string, state_name string",
    )


def units(spark, registry, text):
    texts = spark.createDataFrame([("t", text)], "text_id string, text string").select("text_id", tx.normalise("text").alias("norm"))
    return {r.lga_code: r.confidence for r in pl.resolve_units(pl.all_mentions(texts, registry), registry).collect()}


def test_surfaces(registry):
    got = {(r.lga_code, r.surface) for r in pl.gazetteer(registry).collect()}
    assert {("K1", "wasagu/danko"), ("K1", "wasagu danko"), ("K1", "danko"), ("K2", "birnin gwari"), ("N1", "katsina")} <= got
    assert not any(code == "Q1" for code, _ in got)


@pytest.mark.parametrize(("text", "expected"), [
    ("Attack in Wasagu/Danko LGA", {"K1": 0.95}), ("Attack in Wasagu Danko", {"K1": 0.95}), ("near Danko.", {"K1": 0.95}),
    ("Bandits blocked the Birnin Gwari road", {"K2": 0.95}), ("Violence in Ifelodun, Kwara State", {"O2": 0.9}),
    ("Violence in Ifelodun", {"O1": 0.25, "O2": 0.25}), ("Ifelodun, between Kwara and Osun", {"O1": 0.25, "O2": 0.25}),
    ("Dankos and xMaiduguri", {}), ("Maiduguri-Danko road", {"B1": 0.95, "K1": 0.95}), ("'maiduguri'", {"B1": 0.95}), ("", {}),
    ("maiduguri", {"B1": 0.95}),
])
def test_places(spark, registry, text, expected):
    assert units(spark, registry, text) == expected


def test_mentions_equal_a_regex_search(spark, registry):
    """Word-boundary semantics against a plain regular expression, on awkward separators."""
    import itertools
    import re

    words = ["danko", "wasagu", "birnin", "gwari", "x"]
    texts = [f"{a}{s}{b}" for a, b in itertools.product(words, words) for s in (" ", "/", "-", "'", " - ", "/-")]
    df = spark.createDataFrame([(t, t) for t in texts], "text_id string, norm string")
    surfaces = [r.surface for r in pl.gazetteer(registry).select("surface").distinct().collect()] + ["danko-", "-gwari"]
    frame = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    got = {(r.text_id, r.surface) for r in pl.mentions(df, frame).collect()}
    assert got == {(t, s) for t in texts for s in surfaces if re.search(rf"\b{re.escape(s)}\b", t)}


def test_full_bundle(spark, registry):
    text = ("Armed bandits mounted a roadblock along the Birnin Gwari highway in Kaduna State and abducted at least 14 travellers. "
            "The attackers demanded a ransom of N15 million. Three people were killed in the attack.")
    r = pl.extract_facts(spark.createDataFrame([("t", text)], "text_id string, text string"), registry).first()
    assert (r.lga_codes, r.states, r.ransom_ngn, r.victims, r.fatalities) == (["K2"], ["Kaduna"], 15e6, 14, 3)
    assert r.threat_score > 0.3 and r.confidence == 0.95
    assert len(r.drivers) == 7


def test_surfaces_that_share_a_word_and_overlap(spark):
    """Every surface begins with the same word, names lie inside longer names, and a crowded table changes nothing."""
    import re

    surfaces = ["birnin", "birnin gwari", "birnin gwari road", "birnin kebbi", "gwari road", "birnin birnin"]
    texts = ["birnin " * 50 + "gwari road", "birnin gwari roads", "birnin-gwari road", "a birnin kebbi birnin gwari", "", "x" * 3000, "birnin birnin birnin"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "text_id string, norm string")
    want = {(str(i), s) for i, t in enumerate(texts) for s in surfaces if re.search(rf"\b{re.escape(s)}\b", t)}
    frame = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    whole = pl.TABLE_BITS
    try:
        for bits in (whole, 64):
            pl.TABLE_BITS = bits
            assert {(r.text_id, r.surface) for r in pl.mentions(df, frame).collect()} == want
    finally:
        pl.TABLE_BITS = whole
    assert pl.mentions(df, frame.limit(0)).count() == 0


def test_texts_are_cut_once_for_their_names(spark):
    """Spark must not move a test of the cut texts below the step that cuts them, where it cuts them again."""
    texts = spark.createDataFrame([("t", "near danko"), (None, "danko"), ("e", ""), ("n", None)], "text_id string, norm string")
    found = pl.mentions(texts, spark.createDataFrame([("danko",)], "surface string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(norm") == 2
    assert {tuple(r) for r in found.collect()} == {("t", "danko"), (None, "danko")}


def test_a_name_said_often_counts_once(spark, registry):
    said = [("a", "ifelodun")] * 3 + [("a", "kwara")] * 2 + [("b", "ifelodun")] * 2
    got = pl.resolve_units(spark.createDataFrame(said, "text_id string, surface string"), registry).collect()
    assert {(r.text_id, r.lga_code, r.confidence, r.place_rank) for r in got} == {("a", "O2", 0.9, 1), ("b", "O1", 0.25, 1), ("b", "O2", 0.25, 2)}


def test_ascii_texts_are_normalised_as_by_the_exact_form(spark):
    import itertools

    samples = ["".join(c) for c in itertools.product("aZ9 -/'.\t\x00\x7f", repeat=3)] + ["  A,  b .c  ", "x" * 500 + "! !" * 200]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select("t", tx.normalise("t").alias("n"), tx.normalise_exact("t").alias("e"))
    assert df.where("not n <=> e").count() == 0
    # The wide character table is not asked for in such texts.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("octet_length") >= 1


def test_facts_equal_the_plain_patterns(spark):
    import itertools
    import re

    starts = ["Sixteen", "six", "SIX teen", "1234", "12345", "a seven", "xone", "N", "n 5,", "NGN1.5", "₦ 20,000", "several  ", "twenty-two"]
    ends = [" villagers", " people were killed", "\tothers  shot\ndead", " Naira", ", x", " million naira", "k", " have been gunned down", " PERSONS died two dead", "killed"]
    texts = ["".join(t) for t in itertools.product(starts, ends, ["", " Four soldiers slain", ", N30m"])]
    word = lambda t: int(t) if t.isdigit() else tx.NUMBER_WORDS[t.lower()]
    count = lambda pattern, text: max((word(m) for m in re.findall(pattern, text)), default=None)

    def amount(text):
        found = []
        for pattern in tx.MONEY_PATTERNS:
            for figure, unit in re.findall(pattern, text):
                if figure.strip(",."):
                    found.append(float(figure.replace(",", "")) * tx.MULTIPLIERS.get(unit.lower(), 1.0))
        return max((f for f in found if f >= tx.SMALLEST_AMOUNT), default=None)

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.victims("t").alias("v"), tx.fatalities("t").alias("f"), tx.money("t").alias("m"))
    for r in df.collect():
        assert (r.v, r.f, r.m) == (count(tx.VICTIM_PATTERN, r.t), count(tx.FATALITY_PATTERN, r.t), amount(r.t)), r.t


def test_words_are_screened_once_for_their_mood(spark):
    import re

    df = spark.createDataFrame([(["attack", "attack", "peace", "calm"],), ([],), (None,)], "w array<string>").select(tx.sentiment(F.col("w")).alias("v"))
    assert len(re.findall(r"filter\(w#\d+", df._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert [r.v for r in df.collect()] == [1 / 3, 0.0, None]
