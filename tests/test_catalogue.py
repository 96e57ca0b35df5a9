"""Every query with SQL gives what DuckDB gives; the others give what they promise."""

import duckdb
import pytest
from given import SF
from pyspark.sql import functions as F

from siltwork.operators import lexical
from siltwork.operators.chunking import split_text
from siltwork.plans import catalogue, catalogue_columns, catalogue_files, registry  # noqa: F401


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, db, name):
    found = db.execute(registry.SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == want


def plain_chunks(text, size=500, overlap=100):
    """The splitter by its rules, on lists of words between separators."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    for mark in ("\n\n", "\n", ". ", " "):
        if mark in text:
            break
    else:
        return [text[k : k + size] for k in range(0, len(text), size - overlap)]
    groups, todo = [], text.split(mark)
    while todo:
        taken = [todo.pop(0)]
        while todo and (len(mark.join([*taken, todo[0]])) <= size or taken == [""]):
            taken = ([] if taken == [""] else taken) + [todo.pop(0)]
        whole = mark.join(taken)
        groups += plain_chunks(whole, size, overlap) if len(whole) > size else [whole] if whole else []
    out = []
    for k, g in enumerate(groups):
        before = groups[k - 1] if k else ""
        tail = before if len(before) <= overlap else before[-overlap:].partition(" ")[2]
        out.append(f"{tail.strip()} {g}".strip() if tail.strip() else g)
    return [g for g in out if g.strip()]


def test_chunks_are_those_of_the_splitter(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(plain_chunks(t) == split_text(t) for t in texts.values())
    odd = ["\n\n".join(["a" * 30, "", "", "b" * 700, "c d " * 90, ""]), ". ".join("x" * k for k in range(60)), " " + "y" * 1200, "\n\n\n" + "z w. " * 200]
    assert all(plain_chunks(t, s, o) == split_text(t, s, o) for t in odd for s, o in ((500, 100), (50, 10), (20, 0 or 5)))
    got: dict = {}
    for r in catalogue.q_chunk_split(spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.text
    assert {d: [c[k] for k in sorted(c)] for d, c in got.items()} == {d: split_text(t) for d, t in texts.items() if t.strip()}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_have_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("k", [1, 3, 10])
def test_bounds_keep_the_best(spark, k):
    """Bounds leave out pairs, never one of the k best, whether texts share rare or common words."""
    import random

    rnd = random.Random(k)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    docs = spark.createDataFrame([(d, " ".join(rnd.choices(words, k=rnd.randrange(0, 60)))) for d in range(300)] + [(900, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))) for q in range(25)] + [(50, None)], "q long, text string")
    every = lexical.bm25_scores(docs, asked, "doc_id", "q")
    some = lexical.bm25_scores(docs, asked, "doc_id", "q", k=k, pays=1.0)
    rows = lambda s: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in lexical.top(s, "doc_id", k).collect())
    assert rows(some) == rows(every) and some.count() < every.count()
    within = F.col("doc_id") % 3 == 0
    assert rows(lexical.bm25_scores(docs, asked, "doc_id", "q", within=within, k=k, pays=1.0)) == rows(lexical.bm25_scores(docs, asked, "doc_id", "q", within=within))


def test_blocks_return_the_best_alone(spark, monkeypatch):
    """Blocks give what scoring every pair gives, ties and repeated keys too, and no more than k rows a query and block."""
    import random

    rnd = random.Random(5)
    monkeypatch.setattr(lexical, "TEXTS", 50)
    monkeypatch.setattr(lexical, "QUERIES", 7)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(d, rnd.choice(["a", "b", None]), " ".join(rnd.choices(words, k=rnd.randrange(0, 40)))) for d in range(200)]
    rows += [(d + 300, "a", rows[7][2]) for d in range(20)] + [(5, "b", rows[9][2]), (5, "b", rows[5][2]), (900, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    asked = spark.createDataFrame([(q, " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))) for q in range(25)] + [(50, None)], "q long, text string")
    every = lexical.bm25_scores(docs, asked, "doc_id", "q")
    shown = lambda s, by=(): sorted((tuple(str(r[b]) for b in by), r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in lexical.top(s, "doc_id", 4, by=("query_id", *by)).collect())
    best = lexical.bm25_best(docs, asked, "doc_id", "q", 4)
    assert shown(best) == shown(every) and best.count() <= 4 * 25 * 5 < every.count()
    within = F.col("doc_id") % 3 == 0
    assert shown(lexical.bm25_best(docs, asked, "doc_id", "q", 4, within=within)) == shown(lexical.bm25_scores(docs, asked, "doc_id", "q", within=within))
    assert shown(lexical.bm25_best(docs, asked, "doc_id", "q", 4, by="lang"), ["lang"]) == shown(every.join(docs.select("doc_id", "lang"), "doc_id"), ["lang"])


def test_words_are_counted_where_texts_are_read(spark, monkeypatch):
    """Postings need neither shuffle nor hash table; with more words of queries than go to executors the result is the same."""
    plans, real = {}, lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and real(df, name))
    rows = [(d, f"w{d % 7} the w{d % 5} the", "ab"[d % 2]) for d in range(60)] + [(3, "the w1", "a"), (4, "w4 the w4 the", None), (None, "the", "a"), (70, "", "b"), (71, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "The w1 w2 w2"), (2, "w4 nowhere"), (3, "nothing"), (4, None)], "q long, text string")
    shown = lambda by=None, within=None: sorted(map(str, lexical.top(lexical.bm25_best(docs, asked, "doc_id", "q", 5, by=by, within=within), "doc_id", 5, by=("query_id", *([by] if by else []))).collect()))
    got = [shown(), shown("lang"), shown(within=F.col("lang") == "a")]
    assert got[0] == sorted(map(str, lexical.top(lexical.bm25_scores(docs, asked, "doc_id", "q"), "doc_id", 5).select(*lexical.top(lexical.bm25_best(docs, asked, "doc_id", "q", 5), "doc_id", 5).columns).collect()))
    assert "Aggregate" not in plans["postings"] and "Exchange" not in plans["postings"] and "Join" not in plans["postings"]
    monkeypatch.setattr(lexical, "WORDS", 0)
    assert [shown(), shown("lang"), shown(within=F.col("lang") == "a")] == got
