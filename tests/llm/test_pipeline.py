"""The queries against their SQL, and the pipeline against what its stages promise."""

import duckdb
import pytest
from llm_rows import SF, shingles, words
from tokenizers import Tokenizer

import corpus_pipeline
from siltwork.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns) and sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].columns == columns
    start, clean, distinct, unlike, mixed, ids = ([tuple(r) for r in d.collect()] for d in kept)
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {r[0] for r in clean}
    assert sum(marks.get(d) == 0 for d in held) >= 0.98 * sum(1 for r in start if marks.get(r[0]) == 0)
    text = columns.index("text")
    assert sorted(r[text] for r in distinct) == sorted({r[text] for r in clean})
    sets = {r[0]: shingles(r[text], 5) for r in distinct}
    stay = {r[0] for r in unlike}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in stay for b in stay if a < b)
    assert all(any(near(d, e) for e in sets if e != d) for d in sets if d not in stay)
    assert {r[0] for r in mixed} <= stay and sorted(r[0] for r in mixed) == sorted(r[0] for r in ids)
    total = sum(len(words(r[text])) for r in unlike)
    assert abs(sum(len(words(r[text])) for r in mixed) - 1.5 * total) < 0.2 * total


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Nulls in any column, repeated rows and clashing names through all stages; ids are those of the texts that stay."""
    docs = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == odd.columns, name
            assert {tuple(map(str, r)) for r in docs.collect()} <= {tuple(map(str, r)) for r in before.collect()}, name
        if name == "toxicity":
            assert docs.count() == before.count()
        if name == "exact dedup":
            assert sorted((r.text or "") for r in docs.collect()) == sorted({r.text or "" for r in before.collect()})
        if name == "near duplicates":
            assert {6, 8, 10, 13} <= {r.doc_id for r in docs.collect()} and not {7, 9, 11} & {r.doc_id for r in docs.collect()}
    library = Tokenizer.from_file(queries.VOCABULARY)
    texts = {str(r.doc_id): r.text or "" for r in before.collect()}
    rows = docs.collect()
    assert len(rows) == before.count() and all(r.ids == library.encode(texts[str(r.doc_id)], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows if r.doc_id is not None)


def test_pipeline_runs_and_bears_no_rows(spark, none, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    empty = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
