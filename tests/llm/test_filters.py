"""URL filters, exact search, language identification, toxicity."""

import math
import random
import re
import zlib

import pytest
from llm_rows import LARGER, SF
from pyspark.sql import functions as F

from siltwork.llm import langid, maxscore, queries, toxicity, url_filter


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")


def test_rules_and_aliases(spark):
    canonical = '<html><head><LINK href="http://other.org/a" rel="canonical"></head>'
    rows = [
        (1, "https://www.Example.com/en/x?q#f", None), (2, "http://a.example.com/en/", None), (3, "http://x.net/es/1", None), (4, "http://x.net/es", None), (5, "http://q.org/b", '<meta http-equiv=refresh content="0; url=http://x.net/es/1">'),
        (6, "http://other.org/a/", None), (7, "http://z.org/1", canonical), (8, "http://y.net/fr/2", '<link rel=canonical href="//other.org/a">'), (9, None, canonical), (10, "no url", "x"), (11, "http://com", None), (12, "http://m.org/1", '<link rel="canonical" href="/2">'),
        (13, "http://m.org/2#top", None), (6, "http://other.org/a/", None), (None, "ftp://b.com/", None), (14, "http://k.org/x", '<link rel="canonical" href="http://x.net/es/1">'), (15, "http://ok.com/", '<link rel="canonical" href="http://k.org/x">'), (16, "http://xexample.com/en/", None),
    ]
    df = pages(spark, [(*r, "h", "r") for r in rows])
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.URL_RULES).collect()), key=str)
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows)
    assert by[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and by[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert by[3][2:] == ("net/es/", "block") and by[4] == ("x.net", "/es", None, "allow") and by[16][2:] == ("com/", "allow")
    assert by[9] == ("", "", None, "allow") and by[10] == ("", "", None, "allow") and by[11] == ("com", "", None, "allow") and by[0][3] == "allow"
    # 7 and 6 share other.org/a with the blocked 8; 5, 14 and the allowed 15 share the blocked 3, where the allow wins.
    assert by[6][2:] == (None, "block") and by[7][2:] == (None, "block") and by[12][3] == by[13][3] == "allow"
    assert by[5][3] == by[14][3] == "allow" and by[15][2:] == ("com/", "allow")


def test_links_equal_sql(spark, tmp_path):
    """The query and its SQL over pages with canonical links and refreshes: chains, relative and odd ones."""
    import duckdb

    rnd = random.Random(6)
    hosts = [*[f"h{k}.org" for k in range(40)], *["x.net"] * 8, "www.example.com", "example.com", "shop.com", "Y.Net:80"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/es/', '/fr/x', '/p', '/p/q'])}{rnd.choice(['', str(k % 9), '?a=1', '#f'])}" for k in range(120)]
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' REL=canonical>", '<meta http-equiv="refresh" content="5; url={}">', "<p>{}</p>", "<link rel=canonical href={} />"]
    link = lambda: rnd.choice([*rnd.choices(urls, k=3), "/es/1", "q", "//b.org/p", "../z", ""])
    rows = [(k, u, None if k % 11 == 0 else "<html>" + rnd.choice(forms).format(link()) + rnd.choice(forms).format(link())) for k, u in enumerate(urls)] + [(None, None, "x"), (500, "nothing", '<link rel=canonical href="/q">'), (3, urls[3], None)]
    rows += [(700, "http://q1.org/", '<link rel="canonical" href="http://z.net/fr/a/">'), (701, "http://z.net/fr/a", None), (702, "http://q2.org/b?c", '<meta http-equiv=refresh content="0;url=//q1.org">')]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = db.execute(queries.SQL["op1_url_filter"])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    got = queries.op1_url_filter(spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want
    assert {"rule", "alias", "default"} == {r.reason for r in got.collect()}


def test_redirect_table_chain_and_empty(spark):
    df = pages(spark, [(k, f"http://h{k}.org/", None, None, None) for k in range(30)] + [(99, "http://b.net/es/", None, None, None)])
    hops = spark.createDataFrame([(f"http://h{k}.org/", f"http://h{k + 1}.org/") for k in range(19)] + [("http://h0.org/", "http://b.net/es/"), (None, "http://h0.org/")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, queries.URL_RULES, redirects=hops).collect()}
    assert all(got[k] == ("block" if k < 20 else "allow") for k in range(30))
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


def brute_top(rows, k, queries=lambda i: i % 100 == 0):
    """rows: (vec_id, weights), one for each row of the table."""
    out = []
    for q, (own, v) in enumerate(rows):
        if queries(own):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for j, (i, w) in enumerate(rows) if j != q)[:k]
            out += [(own, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("high", [1, 40])
def test_maxscore_against_brute_force(spark, high):
    rnd = random.Random(high)
    data = [(i, [0.0 if rnd.random() < 0.6 else rnd.gauss(0, 1) * high / 1024 for _ in range(12)], "x") for i in range(350)]
    # Repeated ids (a query's own too), repeated rows, shorter, longer and empty vectors, and rows that take no part.
    data += [(100, data[100][1], "x"), (200, [9.0] * 12, "y"), (7, [50.0] * 12, "x"), (7, [50.0] * 12, "x"), (500, [1.5] * 5, "x"), (501, [2.5] * 20, "x"), (600, [], "x"), (-100, [0.7] * 12, None)]
    gone = [(400, None, "x"), (401, [float("nan")] * 12, "x"), (402, [None] * 12, "x"), (None, [1.0] * 12, "x"), (403, [1.0, float("inf")], "x"), (404, [float("-inf")] * 12, "x")]
    df = spark.createDataFrame(data + gone, "vec_id long, embedding array<double>, score string")
    ints = maxscore.integer_vectors(df)
    rows = [(r.vec_id, list(r.weights)) for r in ints.collect()]
    assert sorted(rows) == sorted((i, [math.floor(1024 * x) for x in v]) for i, v, _ in data)
    asked = ints.where("vec_id % 100 = 0")
    got = sorted(tuple(r) for r in maxscore.top_k(ints, asked, 10, shard_rows=64, query_rows=2).collect())
    assert got == brute_top(rows, 10)
    assert maxscore.top_k(ints.limit(0), ints.limit(0), 10).count() == 0
    few = ints.where("vec_id < 4 and vec_id >= 0")
    rows = [r for r in rows if 0 <= r[0] < 4]
    assert sorted(tuple(r) for r in maxscore.top_k(few, few.where("vec_id = 0"), 10).collect()) == brute_top(rows, 10)


def test_maxscore_sends_no_shards_to_the_driver(spark):
    """Shards are small as files; Spark must not take them for a side to broadcast, and query blocks are dealt to tasks."""
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, [rnd.gauss(0, 1) if i % 3 else 0.5] + [rnd.gauss(0, 1) for _ in range(5)]) for i in range(300)], "vec_id long, embedding array<double>")
    ints = maxscore.integer_vectors(df)
    got = maxscore.top_k(ints, ints.where("vec_id % 100 = 0"), 10, shard_rows=64, query_rows=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [part" in plan and "BroadcastHashJoin [part" not in plan
    assert sorted(tuple(r) for r in got.collect()) == brute_top([(r.vec_id, list(r.weights)) for r in ints.collect()], 10)


def test_maxscore_clamps(spark):
    """Components beyond 2**52 count as that; scores beyond a long are cut to its range."""
    df = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e300, -1e300]), (2, [1e300, 1e300])], "vec_id long, embedding array<double>")
    ints = maxscore.integer_vectors(df)
    got = [tuple(r) for r in maxscore.top_k(ints, ints.where("vec_id = 0"), 10).collect()]
    assert sorted(got) == [(0, 1, 2, 2**63 - 1), (0, 2, 1, 0)]


def test_langid(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language_id(spark, SF)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = langid.fit(odd)
    out = langid.identify(odd, model, keep=("doc_id", "score")).collect()
    assert len(out) == odd.count() and {r.lang_pred for r in out} <= {"en", "fr", "de", "und"}
    assert langid.identify(none, model).count() == 0 and langid.fit(none).langs == []
    assert langid.identify(odd, langid.fit(none)).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_langid_backs_off():
    rows = [{"token": "chat", "word": True, "by": {"fr": 5}}] + [{"token": t, "word": False, "by": b} for t, b in (("<", {"en": 1, "fr": 1}), ("ou", {"en": 9}), ("t", {"en": 2, "fr": 2}), ("o", {"en": 1, "fr": 5}), ("u", {"fr": 9}))]
    model = langid.Model.of(rows, ["en", "fr"], 4)
    found, weights = [], []
    model.backoff("out", found, weights)
    names = {v: k for k, v in model.grams.items()}
    assert [names[f] for f in found] == ["<", "o", "ou", "t"] and sum(weights) == pytest.approx(1)
    assert model.predict("chat")[0] == "fr" and model.predict("out")[0] == "en" and model.predict("123")[0] == model.predict("½ ② 3")[0] == "und"


def plain_langid(model, text):
    """Word-first backoff as said, one word at a time."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for c in text or "") or not model.langs:
        return "und", 0.0
    total = [0.0] * len(model.langs)
    for w in words:
        if w in model.words:
            share, rows = 1, [model.word_logs[model.words[w]]]
        else:
            padded, rows = f"<{w}>", []
            for end in range(1, len(padded) + 1):
                known = [padded[start:end] for start in range(max(0, end - 4), end) if padded[start:end] in model.grams]
                rows += [model.gram_logs[model.grams[known[0]]]] if known else []
            share = 1 / max(len(rows), 1)
        for row in rows:
            total = [t + share * float(x) for t, x in zip(total, row, strict=True)]
    p = [math.exp(t - max(total)) for t in total]
    return model.langs[p.index(max(p))], max(p) / sum(p)


def test_langid_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 3 = 0"))
    for table in (docs, odd):
        for r in table.join(langid.identify(table, model).withColumnsRenamed({"lang_pred": "p", "score": "s"}).select(F.col("doc_id").alias("d"), "p", "s"), F.col("doc_id") == F.col("d")).select("text", "p", "s").collect():
            lang, score = plain_langid(model, r.text)
            assert score == pytest.approx(r.s, abs=1e-4) and (lang == r.p or score < 0.51) or r.text is None
    # Counts: words and n-grams of whole words, however long they are.
    word = "ab" * 60
    got = langid.fit(spark.createDataFrame([(1, f"{word}z {word}z", "en")], "doc_id long, text string, lang string"))
    assert set(got.words) == {word + "z"} and "bz>" in got.grams and "abab" in got.grams
    many = spark.createDataFrame([(k, f"one two w{k % 5}", f"l{min(k, 40 - k):02}") for k in range(40)], "doc_id long, text string, lang string")
    assert langid.fit(many, languages=3).langs == ["l01", "l02", "l03"]


def plain_toxicity(model, text):
    """1 minus the product of 1 - p over sentences."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", sentence)
        if words:
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *["^" + w[:n] for n in (4, 5, 6) if len(w) >= n]])
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_query_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, LARGER).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want, found = plain_toxicity(model, r.text), got[r.doc_id]
        assert found.score == pytest.approx(want, abs=1e-6) and found.predicted == int(found.score >= 0.5) and found.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(g.score, marks[d]) for d, g in got.items() if g.held_out and marks.get(d) is not None]
    assert sum((s >= 0.5) == bool(m) for s, m in held) >= 0.9 * len(held)


def test_toxicity_bound_in_characters(spark):
    docs = spark.createDataFrame([(k, ("a fine day. " if k % 2 else "you moron! ") * (400 if k == 3 else 3)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, chars=6400)
    assert model.score("you moron") > 0.5 > model.score("a fine day")


def test_toxicity(spark, odd, none):
    docs = spark.createDataFrame([(k, f"a fine day number{k % 7}. you are a {'moron' if k % 3 == 0 else 'friend'}! the end of it {k}", "x") for k in range(300)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(250)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got)
    first = next(r for r in got if r.doc_id == 270)
    text = docs.where("doc_id = 270").first().text
    assert [text[s.start : s.end].strip() for s in first.offending] == ["you are a moron!"]
    out = {(r.doc_id, r.score < 0.5) for r in toxicity.score(odd, model).collect()}
    assert (3, True) in out and (4, True) in out and toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(none, labels)
    assert toxicity.fit(docs, labels.limit(0)).score("a moron") < 0.5 and blank.score(None) == 0
    kept = toxicity.clean_documents(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_clean_documents_sends_texts_once(spark):
    docs = spark.createDataFrame([(k, "you moron" if k % 3 == 0 else None if k % 3 == 1 else "a fine day", k * 0.5) for k in range(1600)], "`doc id` long, text string, `a:b` double")
    kept = toxicity.clean_documents(docs, toxicity.Model({"moron": 9.0}, -4.0))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r[0] % 3)
    sent = [line for line in kept._jdf.queryExecution().analyzed().toString().splitlines() if "Project" in line][-1]
    assert sent.count("text#") == 1
    nested = docs.select(F.struct("text").alias("body"), F.col("doc id").alias("k"))
    assert toxicity.clean_documents(nested, toxicity.Model({"moron": 9.0}, -4.0), "body.text").count() == kept.count()


def test_noisy_or():
    model = toxicity.Model({"bad": 3.0}, -1.0)
    p = model.sentence_scores("bad one. fine. so bad bad")
    assert len(p) == 3 and model.score("bad one. fine. so bad bad") == pytest.approx(1 - (1 - p[0]) * (1 - p[1]) * (1 - p[2]))
    assert model.sentence_scores("...").tolist() == []
