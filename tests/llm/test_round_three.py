"""Collocations, url verdicts and token alignment against plain versions."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from areaweek.llm import alignment, collocations, mixing, urlfilter

ALPHABET = ["a", "b", "c", "é", "x'y", "Ab"]


def table(spark, rows):
    """(doc_id, text, lang) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "k", b"h") for r in rows], "doc_id long, text string, lang string, shard int, phrase string, hashes binary").repartition(3)


# --- collocations -----------------------------------------------------------------


def plain_collocations(rows, support, longest, top):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        longer = collections.Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] >= 50 * a and longer[p]:
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def word_rows(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(ALPHABET) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", " ! "]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 60)), ["en", "de", None][i % 3]) for i in range(40)]
    return rows + [(90, None, "en"), (91, "", "fr"), (92, " \t.\n", None), (93, text(3000), "en"), (5, "a b", "en"), (5, "a b", "en"), (94, "w" * 5000, "")]


@pytest.mark.parametrize(("support", "shards", "top"), [(3, 3, 1000), (4, 1, 5), (6, 5, 3)])
def test_collocations(spark, support, shards, top):
    rows = word_rows(support)
    got = collocations.mine(table(spark, rows), support=support, top=top, shards=shards)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain_collocations(rows, support, 3, top)


def test_collocation_chunks_and_windows(monkeypatch):
    """Texts that go on over chunks and windows are counted as if they were whole."""
    import pyarrow as pa

    rows = word_rows(9)
    texts = [(t or "").encode() for _, t, _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], names=["lang", "text"])

    def counted():
        total = collections.Counter()
        for chunk in collocations._chunks([batch], 3, ("lang",)):
            vocabulary = list(chunk.number)
            for _, n, keys, times in chunk.phrases():
                for key, t in zip(keys.tolist(), times.tolist(), strict=True):
                    total[tuple(vocabulary[key >> 21 * j & (1 << 21) - 1] for j in range(n - 1, -1, -1))] += t
        return total

    whole = counted()
    for words, window in ((1, 1), (2, 7), (5, 1), (50, 20)):
        monkeypatch.setattr(collocations, "CHUNK_WORDS", words)
        monkeypatch.setattr(collocations, "WINDOW", window)
        assert counted() == whole


def test_collocations_of_hash_ranges_and_a_crowded_bitmap(spark, monkeypatch):
    rows = word_rows(2)
    monkeypatch.setattr(collocations, "GROUP_HASHES", 4000)
    monkeypatch.setattr(collocations, "BITMAP_BITS", 3)
    got = collocations.mine(table(spark, rows), support=3)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 3, 3, 2000)


def test_collocations_of_an_empty_table(spark):
    assert collocations.mine(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(table(spark, []), longest=4)


# --- url verdicts -----------------------------------------------------------------


def plain_verdicts(pages, rules):
    cut = []
    for key, url, html in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(-len(h + p), -len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        cut.append((key, host, path, html, min(fits) if fits else None))
    total, by = collections.Counter(), collections.Counter()
    for _, host, _, _, rule in cut:
        if host:
            total[host] += 1
            by[host, rule and rule[3]] += 1
    links = collections.Counter()
    for _, host, _, html, _ in cut:
        for to in re.findall(r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)""", html or ""):
            if host and to.lower() != host:
                links[host, to.lower()] += 1
    for host in total:
        above = host
        while "." in above:
            above = above.split(".", 1)[1]
            if above in total:
                links[host, above] += 1
                links[above, host] += 1
                break
    mass = {}
    for kind, verdict, edges in (("trust", "allow", dict(links)), ("distrust", "block", {(b, a): n for (a, b), n in links.items()})):
        out = collections.Counter()
        for (a, _), n in edges.items():
            out[a] += n
        seeds = [h for h in total if 2 * by[h, verdict] > total[h]]
        now = dict.fromkeys(seeds, 10**9)
        for _ in range(20):
            after = collections.Counter({h: int(np.floor((1 - 0.85) * 10**9)) for h in seeds})
            for (a, b), n in edges.items():
                if a in now:
                    after[b] += int(np.floor(now[a] * (0.85 * (n / out[a]))))
            now = after
        mass[kind] = now
    rows = []
    for key, host, path, _, rule in cut:
        t, d = (mass[k].get(host, 0) for k in ("trust", "distrust"))
        method = "block" if d > t and d >= 0.01 * (1 - 0.85) * 10**9 else "allow"
        rows.append((key, host, path, rule and rule[2], rule[3] if rule else method, t, d))
    return sorted(rows, key=str)


def linked_pages():
    rng = random.Random(3)
    hosts = ["a.net", "b.a.net", "en.example.net", "good.org", "sub.good.org", "x.com", "y.com", "z.y.com", "example.com", "q.example.com", "spam.com", "deep.sub.spam.com"]
    rows = []
    for i in range(150):
        host = rng.choice(hosts)
        path = rng.choice(["", "/", "/en/1", "/de/2", "/fr/3", "/en", "?q=/en/", "#top"])
        to = [f'<a HREF = "{rng.choice(["http:", "", "HTTPS:"])}//{rng.choice(hosts).upper() if rng.random() < 0.3 else rng.choice(hosts)}/p">' for _ in range(rng.randrange(4))]
        rows.append((i, f"{rng.choice(['http', 'ftp'])}://{host.capitalize()}{path}", "<p>" + "".join(to) + '<a href="/in">'))
    return rows + [(900, None, "<a href='//x.com'>"), (901, "no host", None), (902, "http://", ""), (903, "//x.com/a", None), (None, "http://x.com/a\nb", "x" * 100_000), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]


RULE_KINDS = "verdict string, host string, path string"


@pytest.mark.parametrize("rules", [urlfilter.RULES, [("block", "spam.com", "/"), ("block", "spam.com", ""), ("allow", "good.org", ""), ("allow", "net", "/en"), ("block", "a.net", "/e")], []])
def test_url_verdicts(spark, rules):
    pages = linked_pages()
    df = spark.createDataFrame([(*p, 1, "kind") for p in pages], "page_id long, url string, html string, mass int, host string").repartition(4)
    got = urlfilter.judge(df, spark.createDataFrame(rules, RULE_KINDS)).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
    want = plain_verdicts(pages, rules)
    assert sorted(map(tuple, got.collect()), key=str) == want
    if len(rules) == 5:
        # Some hosts without a rule are reached by distrust, some by trust.
        assert {r[4] for r in want if r[3] is None and r[1]} == {"allow", "block"}


def test_url_verdicts_of_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(df, spark.createDataFrame(urlfilter.RULES, RULE_KINDS)).count() == 0


# --- token alignment --------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    return alignment._loaded(public_tokenizers.path(alignment.BYTE_LEVEL), public_tokenizers.path(alignment.PIECES))


def plain_alignment(tok, rows):
    """Whole texts, one token after the other."""
    found, count = [], collections.Counter()
    for key, text in rows:
        a, b, raw = [], [], (" " + (text or "")).encode()
        if text:
            a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
            if b"".join(tok.a_bytes[i] for i in a) != raw or b"".join(tok.b_bytes[i] for i in b) != raw:
                a, b = [], []
        ends = [list(itertools.accumulate(len(side[i]) for i in ids)) for ids, side in ((a, tok.a_bytes), (b, tok.b_bytes))]
        links, groups, start = [], [], (0, 0)
        x = y = 0
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            ex, ey = ends[0][x], ends[1][y]
            x, y = x + (ex <= ey), y + (ey <= ex)
            if ex == ey:
                groups.append((a[start[0] : x], b[start[1] : y]))
                start = (x, y)
        count.update(links)
        found.append((key, a, b, links, groups))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for key, a, b, links, groups in found:
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((key, len(a), len(b), len(groups), len(links), sum(len(g) * len(h) for g, h in groups), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return sorted(rows, key=str)


def token_rows():
    rng = random.Random(8)
    signs = ["word", " ", "  ", "   ", "\n", "\t", "é", "日本", " ", "<s>", "</s>", "<|endoftext|>", "123", "'s", "\x00", "🙂", "é", "-", "　", " "]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    return rows + [(900, None), (901, ""), (902, " "), (903, "▁ space sign"), (904, "a" * 3000), (905, "some words again " * 400), (None, "null id"), (5, "same"), (5, "same"), (906, "x  ")]


def test_alignment(spark, tokenizers, monkeypatch):
    rows = token_rows()
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, id int, pairs binary").repartition(3)
    want = plain_alignment(tokenizers, rows)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]
    for limit in (alignment.TABLE_PAIRS, 100):  # one range of pair counts, and many
        got = alignment.align(df, table_pairs=limit).select(columns)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_alignment_in_windows(tokenizers, monkeypatch):
    import pyarrow as pa

    rows = token_rows()
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["id", "text"])
    run = lambda: sorted((tuple(r.values()) for b in alignment._align(*map(public_tokenizers.path, (alignment.BYTE_LEVEL, alignment.PIECES)))([batch]) for r in b.to_pylist()), key=str)
    whole = run()
    monkeypatch.setattr(alignment, "WINDOW", 3)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 50)
    assert run() == whole


def test_pieces_are_encoded_in_runs(tokenizers, monkeypatch):
    rng = random.Random(3)
    pieces = [" " + "".join(rng.choice("abcdeéß日x'1-") for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    pieces = list(dict.fromkeys([*pieces[:700], "  two", " x\n", " ", " \u3000", " ½ﬁ", " <s>", " ▁", *pieces[700:]]))
    calls = []

    class Counted:
        def __getattr__(self, name, of=tokenizers.a):
            f = getattr(of, name)
            return lambda texts, *a, **b: calls.extend(texts) or f(texts, *a, **b)

    want = [(tokenizers.a.encode(p, add_special_tokens=False).ids, tokenizers.b.encode(p[1:])) for p in pieces]
    monkeypatch.setattr(tokenizers, "a", Counted())
    done = alignment.Aligned(tokenizers, pieces)
    for i, (p, (a, b)) in enumerate(zip(pieces, want)):
        exact = b"".join(tokenizers.a_bytes[t] for t in a) == p.encode() == b"".join(tokenizers.b_bytes[t] for t in b)
        assert done.exact[i] == exact
        got = [ids[f[i] : f[i + 1]].tolist() for ids, f in ((done.a_ids, done.a_from), (done.b_ids, done.b_from))]
        assert got == ([a, b] if exact else [[], []])
    assert len(calls) < len(pieces) / 2


def test_links_of_both_kinds(spark, tokenizers):
    rows = token_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id < 900 and doc_id != 5 or doc_id = 905")
    digest = {r.id: r for r in alignment.align(df).collect()}
    per_text = lambda found: {r.id: r.n for r in found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    overlap, shared = (per_text(alignment.links(df, shared_groups=s)) for s in (False, True))
    assert overlap == {i: r.n_links for i, r in digest.items() if r.n_links}
    assert shared == {i: r.n_shared for i, r in digest.items() if r.n_shared}


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)

    def random_csr(n, m):
        dense = rng.integers(0, 3, (n, m)) * (rng.random((n, m)) < 0.3)
        at = [np.flatnonzero(r) for r in dense]
        return alignment.Csr(np.r_[0, np.cumsum(list(map(len, at)))].astype(np.int64), np.concatenate(at), dense[dense > 0], m), dense

    for n, m, k in ((1, 1, 1), (7, 5, 9), (20, 30, 10)):
        (x, dx), (y, dy) = random_csr(n, m), random_csr(m, k)
        for entries in (1, 8, 1000):
            out = np.zeros((n, k), int)
            for rows, columns, values in x.times(y, entries):
                out[rows, columns] += values
            assert (out == dx @ dy).all()
        assert [list(c) for c in zip(*np.nonzero(dx.T), strict=True)] == [[r, c] for r in range(m) for c in x.transposed().columns[x.transposed().starts[r] : x.transposed().starts[r + 1]]]


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- mixing
def test_shards_hold_what_the_tree_dealt_them(spark):
    """Per shard and source the draws are the tree's quota; the query's columns change with the tree."""
    docs = spark.createDataFrame([(i, f"s{i % 3}", " ".join(["w"] * (1 + i % 40))) for i in range(600)], "doc_id long, source string, text string")
    draws, rows = mixing.mix(docs, block_words=4, shards=8, seed=7)
    drawn = draws.join(rows.select("row_id", "source"), "row_id")
    got = {(r["shard"], r["source"]): r["n"] for r in drawn.groupBy("shard", "source").agg(F.count("*").alias("n")).collect()}
    sources = sorted({s for _, s in got})
    totals = [sum(n for (_, s), n in got.items() if s == name) for name in sources]
    tree = mixing.split_quotas(totals, 8, 7)
    assert {(k, s): int(tree[k, j]) for k in range(8) for j, s in enumerate(sources) if tree[k, j]} == got


def test_equal_rows_are_numbered_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_TWINS", 7)
    docs = spark.createDataFrame([(1, "a", "x y z")] * 50 + [(2, "a", "q")] * 3 + [(None, None, None)] * 15, "doc_id long, source string, text string")
    draws, rows = mixing.mix(docs, shards=4)
    assert rows.count() == 68 and rows.select("row_id").distinct().count() == 68
    assert draws.agg(F.sum("words")).first()[0] == 153


def test_large_hypergeometric_counts():
    """Exact bounds, mean and spread beyond the generator's range, and its own law where both forms reach."""
    rng = np.random.default_rng(3)
    good, bad, n = 3 * 10**9, 7 * 10**9, 4 * 10**9
    drawn = np.array([mixing._share(rng, good, bad, n) for _ in range(200)], float)
    spread = (n * 0.3 * 0.7 * (good + bad - n) / (good + bad - 1)) ** 0.5
    assert abs(drawn.mean() - 0.3 * n) < 5 * spread / 200**0.5 and 0.8 < drawn.std() / spread < 1.2
    assert mixing._share(rng, 10**10, 0, 5) == 5 and mixing._share(rng, 2 * 10**9, 3, 2 * 10**9 + 3) == 2 * 10**9
    few = [mixing._share(rng, 2, 2 * 10**9, 10**9) for _ in range(400)]
    assert set(few) == {0, 1, 2} and 140 < sum(x == 1 for x in few) < 260
