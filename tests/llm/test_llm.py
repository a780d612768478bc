"""Operators against plain versions on small tables with nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from areaweek.llm import bpe, counts, jaccard, lines, mixing, neardup_vectors, neighbours, queries, secrets, toxicity, warc
from areaweek.session import work_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); n_chars follows, and a column whose name an operator uses inside."""
    full = [(i, t, lang, s, None if t is None else len(t), 5) for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id int").repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 30, 60, 90, 400, 5000)]
    rows = [(i, t, "en", "abc"[i % 3]) for i, t in enumerate(base)]
    for k, t in enumerate(base[1:5]):  # near copies with one word changed, and exact copies
        words = t.split()
        words[len(words) // 2] = "changed"
        rows += [(10 + k, " ".join(words), None, None), (20 + k, t, "de", "a"), (30 + k, t.upper(), "de", "a")]
    return rows + [(40, None, "en", "b"), (41, "", None, "b"), (42, " \n\t ", "fr", None), (None, base[2], "en", "c"), (43, "one", "en", "c"), (43, "one", "en", "c")]


EMPTY = []


def test_warc_round_trip(spark):
    pages = [(i, f"http://x/{i} ä", "<p>" + "äx" * (i % 4)) for i in range(40)] + [(50, None, None), (51, "u", ""), (None, "n", "<p>"), (7, "again", "<p>" + "äx" * 3)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, payload string").repartition(2)
    manifest = warc.write(df, work_path(spark, "warc"), "page_id", "url", "html")
    want = []
    for i, _, html in pages:
        first = min((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        again = i != first
        data = (html or "").encode()
        want.append((str(i) if i is not None else "", str(first) if again else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response"))
    for split in (100, 4096, 1 << 20):
        got = warc.read(manifest, split).select("record_id", "refers_to", "payload_bytes", "payload_digest", "record_type").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    bodies = {r.record_id: bytes(r.payload) for r in warc.read(manifest).where("record_type = 'response'").collect()}
    assert bodies["0"] == b"<p>"
    alone = warc.write(df, work_path(spark, "warc"), "page_id", "url", "html", min_bytes=1 << 20)
    assert warc.read(alone).where("record_type = 'response'").count() == len(pages)
    assert warc.read(warc.write(df.limit(0), work_path(spark, "warc"), "page_id", "url", "html")).count() == 0


def test_jaccard_join(spark, sample):
    got = {}
    for r in jaccard.join(documents(spark, sample)).collect():
        got.setdefault(r.id, (r.n_shingles, r.component))
    sets = {}
    for i, t, *_ in sample:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    for i, s in sets.items():
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b, other in sets.items():
                if b not in seen and sets[a] and other and 100 * len(sets[a] & other) >= 75 * len(sets[a] | other):
                    seen.add(b)
                    todo.append(b)
        assert got[i] == (len(s), min((x for x in seen if x is not None), default=None)), i
    assert jaccard.join(documents(spark, EMPTY)).count() == 0


def test_merge_and_overlap():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(1, 12))) for _ in range(rng.randrange(1, 8))]
        need = {x: rng.randrange(1, 5) for x in range(30)}
        count = {x: sum(x in part for part in lists) for x in range(30)}
        assert jaccard.merge(lists, need) == [(x, c) for x, c in sorted(count.items()) if c and c >= need[x]]
        a, b = (np.array(sorted(rng.sample(range(900), rng.randrange(1, 800)))) for _ in range(2))
        shared = len(set(a.tolist()) & set(b.tolist()))
        assert [jaccard.overlap(a, b, k) for k in (shared, shared + 1)] == [True, False]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    close = base[:60] + rng.normal(scale=0.05, size=(60, 16))
    values = np.concatenate([base, close, base[:5], base[:3] * 2]).tolist()
    rows = [(i, v, i % 60 % 3) for i, v in enumerate(values)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 3]
    return rows + [(400 + i, v, 1) for i, v in enumerate(odd)] + [(420, values[0], None)]


def table_of(spark, vectors):
    return spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, label int, id int").repartition(3)


def test_neighbours(spark, vectors):
    df = table_of(spark, vectors)
    good = {i: np.array(v) for i, v, _ in vectors if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), k=7, centroids=8, share=0.6, least=50).collect()
    hits = 0
    asked = [q for q in good if q % 20 == 0]
    for q in asked:
        exact = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 8))
        assert [(r.score, r.id) for r in mine] == sorted((r.score, r.id) for r in mine)
        assert all(abs(r.score - dict((i, s) for s, i in exact)[r.id]) < 1e-12 for r in mine)
        hits += len({r.id for r in mine} & {i for _, i in exact[:7]})
    assert {r.query_id for r in got} == set(asked) and hits >= 0.9 * 7 * len(asked)
    assert neighbours.search(df.limit(0), df).count() == 0
    few = neighbours.search(df.where("vec_id < 3"), df.where("vec_id = 1"), k=7).collect()
    assert sorted(r.id for r in few) == [0, 2]


def test_multi_index_visits_in_order():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b, n = rng.random(6), rng.random(5), rng.integers(0, 4, (6, 5))
        seen = neighbours.visit(a, b, n, 20)
        sums = a[:, None] + b[None]
        assert sums[seen].max() <= sums[~seen].min(initial=np.inf)
        assert n[seen].sum() >= min(20, n.sum())


def test_vector_links(spark, vectors):
    got = {r.id: (r.n_links, r.component) for r in neardup_vectors.link(table_of(spark, vectors)).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, label in vectors if label is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in vectors}
    near = {i: {j for j in good if j != i and label[i] == label[j] and good[i] @ good[j] >= 0.93} for i in good}
    assert sum(map(len, near.values())) > 100
    for i, *_ in vectors:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), set()) - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(near.get(i, ())), min(seen)), i
    assert neardup_vectors.link(table_of(spark, vectors).limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 100])
def test_vector_links_off_centre(spark, block):
    """Partners at a cosine just above the cut, of vectors that share a mean direction: none is lost."""
    rng = np.random.default_rng(3)
    one = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base = one(rng.normal(size=(600, 64)) / 8 + np.eye(64)[0])
    side = rng.normal(size=base.shape)
    side = one(side - (side * base).sum(1, keepdims=True) * base)
    cosine = np.repeat([0.9301, 0.94, 0.95], 200)[:, None]
    units = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    close = units @ units.T >= 0.93
    assert np.linalg.norm(units.mean(0)) > 0.6 and close[np.arange(600), np.arange(600, 1200)].all()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(units)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.id: r.n_links for r in neardup_vectors.link(df, block=block).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate(close.sum(1))}


@pytest.fixture(scope="module")
def tokenizer():
    v = bpe.vocabulary(bpe.MULTI_50K)
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_equals_library(spark, sample, tokenizer):
    df = documents(spark, [*sample, (60, "a" * 20_000, None, None), (61, "Ünï 字 😀 don't 12  x\x1c y  \n", None, None)])
    got = df.select("text", bpe.encode(F.col("text")).alias("ids")).select("text", "ids", bpe.decode(F.col("ids")).alias("back"), bpe.count(F.col("ids")).alias("n")).collect()
    for r in got:
        want = tokenizer[1].encode_ordinary(r.text or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n == len(want) and bytes(r.back).decode() == (r.text or "")


def test_sets_that_share_too_little_leave_the_search(spark, monkeypatch):
    rng = random.Random(6)
    passage = prose(rng, 75)
    rows = [(i, " ".join([passage, *(f"{i}x{k}" for k in range(25))]), "en", "a") for i in range(60)]  # 71 of 96 shingles are common: too few for any link
    labels = []
    monkeypatch.setattr(jaccard, "stored", lambda df, label, f=jaccard.stored: labels.append(label) or f(df, label))
    got = jaccard.join(documents(spark, rows)).collect()
    assert sorted(r.id for r in got) == list(range(60)) and all(r.component == r.id for r in got)
    assert "open" in labels and "candidates" not in labels


def test_encoding_and_decoding_take_one_python_worker_a_task(spark, sample, tmp_path):
    documents(spark, sample).write.parquet(f"{tmp_path}/documents.parquet")
    stage = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    for df in (stage, queries.op4_bpe(spark, str(tmp_path))):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert all(r.exact is (r.text is not None) or r.text is None for r in stage.join(documents(spark, sample).select("doc_id", "text"), "doc_id").collect())


def test_bpe_on_every_code_point(tokenizer):
    for code in [*range(0xD800), *range(0xE000, 0x11000)]:
        text = f"a{chr(code)}b 1{chr(code)}!{chr(code)}{chr(code)} x"
        assert np.frombuffer(tokenizer[0].encode(text), "<u4").tolist() == tokenizer[1].encode_ordinary(text), hex(code)


def test_bpe_appends_and_edits(tokenizer):
    rng, parts = random.Random(1), ["a", "e", "'", "s", "v", "l", "r", " ", "  ", "\n", "1", "the", " and", "ü", "字", "!", "'ve"]
    new = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(n)))
    for _ in range(400):
        text = bpe.EditableText(tokenizer[0], new(12))
        for _ in range(3):
            start = rng.choice([len(text.text), rng.randrange(len(text.text) + 1)])
            text.edit(start, min(len(text.text), start + rng.randrange(4)), new(4))
            assert text.ids() == tokenizer[1].encode_ordinary(text.text), text.text


def test_secrets_and_ledger(spark):
    key, run = "AKIA" + "B" * 16, "0a" * 12
    rows = [(1, f"x password = 'abcdef' {key} {run}", "v", "s"), (2, f"x password = 'abcdef' {key} {run}", "v", "s"), (3, None, None, None), (4, "", "", ""), (None, "token:short API_KEY=longer99", "", ""), (6, "😀 secret=ſecret12 AKIAAKIA", "", "")]
    ledger = work_path(spark, "ledger")
    read = lambda: sorted(((r.path, r.text) for r in secrets.scan(documents(spark, rows), ledger).select("path", secrets.written(F.col("spans")).alias("text")).collect()), key=str)
    first = read()
    same = "assign:2:20,access:22:42,hex:43:67"
    assert dict(first) == {1: same, 2: same, 3: "", 4: "", None: "assign:12:28", 6: ""}
    assert secrets.read_ledger(spark, ledger).count() == 4 and read() == first and secrets.read_ledger(spark, ledger).count() == 4
    secrets.scan(documents(spark, rows), ledger, rule_version="2").count()
    assert secrets.read_ledger(spark, ledger).count() == 8
    assert secrets.scan(documents(spark, EMPTY), work_path(spark, "ledger")).count() == 0


def test_counts_follow_changes(spark, tokenizer):
    root, state = work_path(spark, "counts"), {}
    batches = [
        [("put", "1", "one two", "a", "en", 1), ("put", "2", "three", "a", None, 1), ("put", None, None, None, "en", 1), ("put", "2", "three", "a", None, 1)],
        [("put", "1", "one two three four", "b", "en", 2), ("delete", "2", None, None, None, 2), ("delete", "9", None, None, None, 2), (None, "3", "x " * 500, "b", "en", 2)],
        [("put", "1", "stale", "c", "en", 1), ("put", "2", "back again", "c", "de", 3)],
    ]
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "op string, id string, text string, source string, lang string, seq long")
        assert counts.commit(df, root, f"b{n}") and not counts.commit(df, root, f"b{n}")
        for op, i, text, source, lang, seq in batch:
            if seq > state.get(i, (0,))[0]:
                state[i] = (seq, op, text or "", source, lang)
        want = {}
        for _, op, text, source, lang in state.values():
            if op != "delete":
                for name, size in (("words-1", len(WORD.findall(text))), ("byte_bpe_multi_50k", len(tokenizer[1].encode_ordinary(text)))):
                    a, b = want.get((source, lang, name), (0, 0))
                    want[source, lang, name] = (a + 1, b + size)
        assert {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in counts.totals(spark, root).collect()} == want
    assert counts.commit(df.limit(0), root, "none")


def test_count_and_secret_queries_meet_what_they_hold(spark, tmp_path, tokenizer, monkeypatch):
    """The queries revise, delete and put back, and scan twice over one ledger; the end is a fresh count."""
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(0, 40)) + " 0a0a0a0a0a0a0a0a0a0a0a0a0a0a", ("en", None)[i % 2], ("a", "b", None)[i % 3]) for i in range(60)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    roots, seen = [], []
    monkeypatch.setattr(counts, "commit", lambda df, root, *a, f=counts.commit: roots.append(root) or f(df, root, *a))
    monkeypatch.setattr(secrets, "scan", lambda df, ledger, f=secrets.scan: (f(df, ledger), seen.append(secrets.read_ledger(spark, ledger).count()))[0])
    want = {}
    for _, text, lang, source in rows:
        for name, size in (("words-1", len(WORD.findall(text))), ("byte_bpe_multi_50k", len(tokenizer[1].encode_ordinary(text)))):
            a, b = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = (a + 1, b + size)
    got = queries.op6_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in got} == want
    minus = spark.read.parquet(f"{roots[0]}/entries/*").where("old_alive").groupBy("alive").count().collect()
    assert {r.alive for r in minus} == {True, False} and min(r["count"] for r in minus) > 10
    spans = queries.op5_secrets(spark, str(tmp_path)).collect()
    assert len(spans) == 60 and all(r.n_hex == 1 for r in spans) and 0 < seen[0] < seen[1] == 60


def test_targets_and_quotas():
    assert mixing.targets([100, 100, 100, 100]) == pytest.approx([400 * w / 13 for w in (5, 2, 1, 5)])
    assert mixing.targets([10, 1000, 0]) == [30.0, 980.0, 0.0]
    quotas = [0, 7, 1000, 13, 512]
    parts = mixing.split_quotas(quotas, 6, 3)
    assert parts.sum(0).tolist() == quotas and parts.sum(1).max() - parts.sum(1).min() <= 1 and (parts >= 0).all()


@pytest.mark.parametrize("block", [8, None])
def test_mix(spark, sample, block):
    draws, rows = mixing.mix(documents(spark, sample), block_words=block, shards=4)
    kept = rows.collect()
    taken = {r.row_id: r.taken for r in draws.groupBy("row_id").agg(F.sum("words").alias("taken")).collect()}
    assert sorted(r.size for r in kept) == sorted(len(WORD.findall(t or "")) for _, t, *_ in sample)
    for source in {r.source for r in kept}:
        mine = [r for r in kept if r.source == source]
        near = sum(taken.get(r.row_id, 0) for r in mine)
        assert abs(near - mine[0].target) <= max((r.size if block is None else block) for r in mine) / 2 + 1
    assert all(taken.get(r.row_id, 0) <= 3 * r.size for r in kept)
    again = mixing.mix(documents(spark, sample), block_words=block, shards=4)[0]
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, again.collect()))
    assert draws.groupBy("row_id", "block", "pass").count().where("count > 1").count() == 0
    assert mixing.mix(documents(spark, EMPTY))[0].count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_dedup(spark, edits):
    rng, pool = random.Random(edits), ["".join(rng.choice("abü😀") for _ in range(rng.randrange(10, 24))) for rng in [random.Random(9)] for _ in range(12)]
    rows = []
    for i in range(25):
        own = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "z", "y"])
            own.append("".join(line))
        rows.append((i, "\n".join(own), "en", "s"))
    rows += [(30, None, None, None), (31, "", None, None), (3, rows[3][1], "en", "s"), (32, "x" * 9000 + "\nshort\nshort", None, None)]
    got = lines.dedup(documents(spark, rows), min_chars=9, edits=edits).select("doc.doc_id", "n_lines", "n_removed", "kept").collect()
    places, whole = [], {i: t for i, t, *_ in rows}
    for i in sorted(whole):
        places += [(i, k, line) for k, line in enumerate((whole[i] or "").split("\n"))]
    gone = {(i, k) for n, (i, k, line) in enumerate(places) if len(line) >= 9 and any(len(o) >= 9 and abs(len(o) - len(line)) <= edits and distance(o, line) <= edits for _, _, o in places[:n])}
    assert len(got) == len(rows)
    for r in got:
        text = whole[r.doc_id]
        keep = [line for k, line in enumerate((text or "").split("\n")) if (r.doc_id, k) not in gone]
        assert r.kept == (None if text is None else "\n".join(keep)) and r.n_removed == sum(i == r.doc_id for i, _ in gone), r
    assert lines.dedup(documents(spark, EMPTY)).count() == 0


def test_crowded_lines(spark):
    """Many variants of one line share its halves, its parts and all but one character."""
    rng, line = random.Random(4), "the long line that all of these variants are made of, somewhere."
    texts = {line, line[1:], line + "."}
    while len(texts) < 150:
        own = list(line)
        for _ in range(rng.randrange(1, 4)):
            at = rng.choice([3, 3, 31, 32, 33, 60, rng.randrange(len(own))])
            own[at : at + rng.randrange(2)] = rng.choice(["", "q", "w", "x", "long", "e", "r", "t", "y", "u", "i"])
        texts.add("".join(own))
    order = rng.sample(sorted(texts), len(texts))
    got = {r.doc_id: r.n_removed for r in lines.dedup(documents(spark, [(i, t, "en", "s") for i, t in enumerate(order)])).select("doc.doc_id", "n_removed").collect()}
    assert got == {i: int(any(distance(o, t) <= 1 for o in order[:i])) for i, t in enumerate(order)}


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(rng, 40).split()
        for _ in range(4 * bad):
            words.insert(rng.randrange(40), rng.choice(["zorgful", "zorgish", "idiot"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(bad)))
    rows += [(500, None, None, None), (501, "", None, None), (502, "idiot " * 20_000, None, None), (None, "x", None, None)]
    docs, known = documents(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    scorer = toxicity.fit(toxicity.training_rows(docs, known))
    got = {r.doc_id: r.score for r in scorer.score(docs, F.col("text"), ["doc_id"]).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect() if r.doc_id < 400]
    assert len(held) > 80 and sum((got[i] >= toxicity.CUT) == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    assert toxicity.training_rows(docs, known).where(toxicity.held_out(F.col("id"))).count() == 0
    none = toxicity.fit(toxicity.training_rows(docs, known.limit(0)))
    assert {r.score for r in none.score(docs, F.col("text"), ["doc_id"]).collect()} == {0.0}
    assert toxicity.masked_words("m0ron x5 12 id!ot.") == ["moron", "idiot"]


def test_pipeline_stages(spark, sample, tmp_path):
    documents(spark, sample).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(30)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    unique = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r.doc_id for r in unique} >= {0, 1, 2, 3, 4, 5, 40, 41, 42, 43} and not {r.doc_id for r in unique} & {20, 21, 22, 23, 30, 31, 32, 33}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.exact for r in out) and len({r.doc_id for r in out}) < len(sample)


def test_documents_that_share_an_id_stay(spark):
    """Only equal or linked texts go; of a group the smallest id stays, and a null id loses."""
    rng = random.Random(6)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(7, one, "en", "a"), (7, two, "en", "a"), (7, two, "en", "a"), (9, one, "en", "a"), (None, three, "en", "a"), (None, one, "en", "a"), (8, three, "en", "a")]
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect())
    assert got == sorted([(7, one), (7, two), (8, three)])


def test_crowded_lines_of_one_character_and_longer_ones(spark):
    """Lines that differ in one character only, and longer ones beside them, by plain edit distance."""
    base = "the quick brown fox jumps over a dog"
    same = [base[:17] + chr(0x4E00 + k) + base[18:] for k in range(30)]
    longer = [same[k][:17] + c + same[k][17:] for k in (0, 7, 29) for c in "xyz"] + [same[3][:18] + "q" + same[3][18:], base + "s", base[:5] + "--" + base[5:]]
    rows = list(enumerate(longer[:4] + same + longer[4:], 1))
    got = {r.doc_id: r.n_removed for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "n_removed").collect()}
    assert got == {i: int(any(distance(a, b) <= 1 for j, b in rows if j < i)) for i, a in rows}


def test_a_batch_of_texts_is_encoded_in_runs(tokenizer, monkeypatch):
    """Few texts of a batch are Python objects at once, and what is made of them is not held twice."""
    monkeypatch.setattr(bpe, "_RUN", 3)
    texts = ["", "one", "äö 12", "x y", "ñ", "字 😀", "end"]
    for n in (7, 3, 1, 0):
        got = bpe._both(tokenizer[0], pa.array(["left out", *texts[:n]], pa.string()).slice(1)).to_pylist()
        assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [tokenizer[1].encode_ordinary(t) for t in texts[:n]]
        assert [r["decoded"].decode() for r in got] == texts[:n]
        assert bpe._mapped(str.encode, pa.array(texts[:n], pa.string())).to_pylist() == [t.encode() for t in texts[:n]]
    seen = []
    monkeypatch.setattr(pa, "py_buffer", lambda data, f=pa.py_buffer: seen.append(data) or f(data))
    bpe._mapped(str.encode, pa.array(texts))
    assert len(seen) == 2 and len(seen[1]) == sum(len(t.encode()) for t in texts)


def test_verdicts_are_kept_by_the_token_before(tokenizer, monkeypatch):
    known = bpe.Vocabulary(bpe.MULTI_50K)
    monkeypatch.setattr(bpe, "_KEEP_PAIRS", 40)
    rng = random.Random(9)
    for _ in range(30):
        text = prose(rng, 20)
        assert np.frombuffer(known.encode(text), "<u4").tolist() == tokenizer[1].encode_ordinary(text)
        assert known.after.held == sum(map(len, known.after.values()))


def test_each_batch_of_the_counts_is_one_scan(spark, sample, tmp_path, monkeypatch):
    documents(spark, sample).write.parquet(f"{tmp_path}/documents.parquet")
    scans = []
    monkeypatch.setattr(counts, "commit", lambda df, *a, f=counts.commit: scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan")) or f(df, *a))
    queries.op6_token_counts(spark, str(tmp_path))
    assert scans == [1, 1, 1, 1]
