"""The registered queries over the given tables, each with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions import mail as M
from siltwork.functions import text as T
from siltwork.operators import chunking, dedup, dense, evaluate, fusion, importance, lexical, logs, mail, retrieve
from siltwork.plans.registry import QUERIES, SQL
from siltwork.plans.registry import query as _query
from siltwork.plans.registry import table as _t
from siltwork.scratch import written

__all__ = ["QUERIES", "SQL"]

# Common table expressions that several queries share.
_TOK = r"tok AS (SELECT doc_id, source, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents)"
_STAT = "st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS average FROM tok)"
_QT = r"qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL)"


def _bm25(post: str = "tok", extra: str = "") -> str:
    """Scores (query_id, doc_id, score) as table sc."""
    return f"""{_TOK}, {_STAT}, {_QT},
ps AS (SELECT doc_id, term, length, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM ps GROUP BY term),
wt AS (SELECT ps.doc_id, ps.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / average)) AS w FROM ps JOIN df USING (term) CROSS JOIN st {extra}),
sc AS (SELECT query_id, doc_id, round(sum(w * qf), 6) AS score FROM wt JOIN qt USING (term) GROUP BY ALL)"""


_LEX = "lx AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10)"


def _lexical(spark: SparkSession, sf_dir: str, within=None) -> DataFrame:
    docs, asked = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    best = lexical.top(lexical.bm25_best(docs, asked, "doc_id", "item_id", within=within), "doc_id").select("query_id", "doc_id", "score", "rank")
    return written(best, "lexical")  # k rows a query, whose size a join with the texts knows


@_query(rf"WITH {_TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY term")
def q_tokenize_terms(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return lexical.postings(docs, "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@_query(rf"WITH {_TOK}, {_STAT}, df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM tok) GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, n, round(average, 6) AS average FROM df CROSS JOIN st")
def q_bm25_stats(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return lexical.terms(docs, "doc_id").crossJoin(F.broadcast(lexical.corpus_stats(docs, "doc_id"))).select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("average", 6).alias("average"))


@_query(f"WITH {_bm25()}, {_LEX} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM lx")
def q_bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir)


@_query(f"WITH {_bm25(extra=chr(74) + 'OIN tok USING (doc_id) WHERE contains(lower(tok.source), ' + repr('src1') + ')')}, {_LEX} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM lx")
def q_bm25_filtered(spark, sf_dir):
    return _lexical(spark, sf_dir, F.contains(F.lower("source"), F.lit("src1")))


_DENSE = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), dn AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) AS score FROM v q CROSS JOIN v WHERE {cond}) QUALIFY rank <= 10)"


@_query(f"WITH {_DENSE.format(cond='q.vec_id % 100 = 0')} SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM dn")
def q_dense_topk(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    return dense.dense_topk(v, v.where("vec_id % 100 = 0"))


@_query(f"WITH {_DENSE.format(cond='q.vec_id % 100 = 0 AND v.label IN (0, 1, 2)')} SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM dn")
def q_dense_filtered(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    return dense.dense_topk(v, v.where("vec_id % 100 = 0"), within=F.col("label").isin(0, 1, 2))


_RRF = "SELECT query_id, doc_id, round(sum(1::DOUBLE / (60 + rank)), 6) AS score, min((list, rank)) AS seen FROM ({lists}) GROUP BY ALL"
_FUSED = f"{_bm25()}, {_LEX}, {_DENSE.format(cond='q.vec_id IN (SELECT item_id FROM benchmark)')}, fu AS ({_RRF.format(lists='SELECT query_id, vec_id AS doc_id, rank, 0 AS list FROM dn UNION ALL SELECT query_id, doc_id, rank, 1 FROM lx')}), hy AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM fu)"


def _hybrid(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = _t(spark, sf_dir, "embeddings")
    asked = v.join(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = dense.dense_topk(v, asked).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    words = _lexical(spark, sf_dir)
    return near, words, fusion.rrf([near, words], ["doc_id"], ["query_id"])


@_query(f"WITH {_FUSED} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM hy")
def q_rrf_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir)[2]


@_query(
    f"""WITH {_bm25()}, li AS (SELECT query_id, lang AS index_name, doc_id, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS r FROM sc JOIN documents USING (doc_id) QUALIFY r <= 10),
fu AS (SELECT *, round(1::DOUBLE / (60 + r), 6) AS score FROM li)
SELECT query_id, index_name, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_name NULLS LAST, r, doc_id)::INTEGER AS rank FROM fu"""
)
def q_rrf_multi_index(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    scores = lexical.bm25_best(docs.withColumnRenamed("lang", "index_name"), _t(spark, sf_dir, "benchmark"), "doc_id", "item_id", by="index_name")
    return fusion.rrf_of_indexes(lexical.top(scores, "doc_id", by=("query_id", "index_name")), "index_name", "doc_id", "query_id")


_RERANK = r"""pool AS (SELECT query_id, doc_id, rank, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+')) AS q, list_distinct(tok.w) AS w FROM lx JOIN benchmark b ON b.item_id = query_id JOIN tok USING (doc_id)),
rs AS (SELECT query_id, doc_id, rank AS fused_rank, round(len(list_intersect(q, w)) / greatest(len(q), 1), 6) AS score FROM pool),
rk AS (SELECT *, max(score) OVER (PARTITION BY query_id) >= 0.25 AS confident, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM rs)"""


def _reranked(spark, sf_dir, n: int = schema.TOP_N, words: DataFrame | None = None) -> DataFrame:
    docs, asked = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pool = (words if words is not None else _lexical(spark, sf_dir)).drop("score").join(docs.select("doc_id", "text", "source"), "doc_id").join(asked, "query_id")
    return fusion.rerank(pool, fusion.overlap_score(F.col("query"), F.col("text")), n, 0.25)


@_query(f"WITH {_bm25()}, {_LEX}, {_RERANK} SELECT query_id, doc_id, score, fused_rank::INTEGER AS fused_rank, rank::INTEGER AS rank, NOT confident AS weak FROM rk WHERE rank <= 3")
def q_rerank_weak_flag(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "doc_id", "score", "fused_rank", "rank", (~F.col("confident")).alias("weak"))


@_query(
    f"""WITH {_bm25()}, {_LEX}, {_RERANK}, bo AS (SELECT query_id, doc_id, rank AS old_rank, round(score * (1 + 0.5::DOUBLE * (CASE WHEN source IN ('src0', 'src1', 'src2') THEN 0.9 WHEN source = 'src3' THEN 0.0 ELSE 0.2 END)), 6) AS boosted FROM rk JOIN documents USING (doc_id))
SELECT query_id, doc_id, old_rank::INTEGER AS old_rank, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, old_rank)::INTEGER AS rank FROM bo"""
)
def q_boosted_order(spark, sf_dir):
    weight = F.when(F.col("source").isin("src0", "src1", "src2"), 0.9).when(F.col("source") == "src3", 0.0).otherwise(0.2)
    return fusion.boosted(_reranked(spark, sf_dir, 10), weight, 0.5).select("query_id", "doc_id", "old_rank", "boosted", "rank")


@_query(f"WITH {_bm25()}, {_LEX} SELECT query_id, doc_id, rank::INTEGER AS rank, round_even(1::DOUBLE / rank, 4) AS score FROM lx")
def q_unranked_scores(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "doc_id", "rank", fusion.unranked_score(F.col("rank")).alias("score"))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-03-01' AND '1996-02-29'")
def q_period_filter(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _t(spark, sf_dir, "orders").select("o_orderkey", day.alias("day")).where(retrieve.in_period(F.col("day"), "1995-03-01", "1996-02-29"))


@_query("SELECT DISTINCT p_name AS source FROM part WHERE contains(lower(nfc_normalize(p_name)), 'e')")
def q_resolve_sources(spark, sf_dir):
    return retrieve.resolve_sources(_t(spark, sf_dir, "part").withColumnRenamed("p_name", "source"), " E ")


# Quality 1 stands for relevance: a query is answered by a document of a source that it shares with its own.
@_query(
    f"""WITH {_FUSED}, {_RERANK}, modes AS (SELECT 'semantic' AS mode, query_id, doc_id, rank FROM (SELECT query_id, vec_id AS doc_id, rank FROM dn) UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM lx UNION ALL SELECT 'fused', query_id, doc_id, rank FROM hy UNION ALL SELECT 'reranked', query_id, doc_id, rank FROM rk WHERE rank <= 3),
asked AS (SELECT mode, item_id AS query_id FROM benchmark CROSS JOIN (VALUES ('semantic'), ('bm25'), ('fused'), ('reranked')) m(mode)),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), hit AS (SELECT mode, query_id, min(rank) AS hit FROM modes JOIN good USING (doc_id) WHERE rank <= 3 GROUP BY ALL)
SELECT mode, count(*) AS queries, count_if(hit = 1)::BIGINT AS hit1, count_if(hit IS NOT NULL)::BIGINT AS hit3, round(sum(coalesce(1::DOUBLE / hit, 0)) / greatest(count(*), 1), 6) AS mrr FROM asked LEFT JOIN hit USING (mode, query_id) GROUP BY mode"""
)
def q_eval_metrics(spark, sf_dir):
    near, words, fused = _hybrid(spark, sf_dir)
    every = None
    for mode, r in (("semantic", near), ("bm25", words), ("fused", fused), ("reranked", _reranked(spark, sf_dir, words=words))):
        part = r.select(F.lit(mode).alias("mode"), "query_id", "doc_id", "rank")
        every = part if every is None else every.unionByName(part)
    asked = _t(spark, sf_dir, "benchmark").select(F.explode(F.array(*[F.lit(m) for m in ("semantic", "bm25", "fused", "reranked")])).alias("mode"), F.col("item_id").alias("query_id"))
    good = _t(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return evaluate.metrics(evaluate.first_hit(every, good, asked))


@_query(
    f"""WITH {_bm25()}, {_LEX}, f AS (SELECT query_id, source, min(rank) AS seen FROM lx JOIN documents USING (doc_id) GROUP BY ALL)
SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY seen, source)::INTEGER AS rank FROM f"""
)
def q_document_order(spark, sf_dir):
    ranked = _lexical(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return evaluate.document_order(ranked, by=("query_id",))


@_query(
    f"""WITH {_bm25()}, {_LEX}, ev AS (SELECT item_id AS query_id, lower(text) AS evidence FROM benchmark)
SELECT ev.query_id, min(rank) FILTER (contains(lower(d.text), evidence))::INTEGER AS hit FROM ev LEFT JOIN lx ON ev.query_id = lx.query_id AND rank <= 3 LEFT JOIN documents d USING (doc_id) GROUP BY ev.query_id"""
)
def q_passage_rank(spark, sf_dir):
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("evidence"))
    ranked = _lexical(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(asked, "query_id")
    return evaluate.first_hit(ranked, F.contains(F.lower("text"), F.col("evidence")), asked, by=("query_id",))


_KEY = r"sha256(lower(regexp_replace(regexp_replace(coalesce(text, ''), '[\s\v\x1c-\x1f]+', ' ', 'g'), '^ | $', '', 'g')))"


@_query(f"SELECT text_key, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {_KEY} AS text_key FROM documents) GROUP BY text_key")
def q_text_key_dedup(spark, sf_dir):
    return dedup.collapse_duplicates(_t(spark, sf_dir, "documents"), "doc_id").select("text_key", "doc_id", "copies")


@_query(f"WITH k AS (SELECT doc_id, lang, {_KEY} AS text_key FROM documents) SELECT text_key, min(doc_id) AS doc_id FROM k WHERE lang <> 'en' AND text_key NOT IN (SELECT text_key FROM k WHERE lang = 'en') GROUP BY text_key")
def q_dedup_seeded(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    seen = docs.where("lang = 'en'").select(T.text_key(F.col("text")).alias("text_key"))
    return dedup.unseen(docs.where("lang <> 'en'"), seen, "doc_id").select("text_key", "doc_id")


# Two snapshots: the second has no German documents, those of src1 have changed, and Spanish ones are new.
@_query(
    """WITH a AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN source = 'src1' THEN text || '.' ELSE text END) AS digest FROM documents WHERE lang <> 'de')
SELECT path, coalesce(b.digest, a.digest) AS digest, CASE WHEN b.digest IS NULL THEN 'deleted' WHEN a.digest IS NULL THEN 'new' WHEN a.digest = b.digest THEN 'unchanged' ELSE 'changed' END AS state FROM b FULL JOIN a USING (path)"""
)
def q_manifest_diff(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    old = docs.where("lang <> 'es'").select("path", F.sha2("text", 256).alias("digest"))
    now = docs.where("lang <> 'de'").select("path", F.sha2(F.when(F.col("source") == "src1", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("digest"))
    return dedup.manifest_diff(now, old)


@_query("SELECT o_orderkey AS id, 'new' AS state FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) UNION ALL SELECT o_orderkey, 'stale' FROM orders WHERE o_totalprice > 100000 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def q_append_new_stale(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    new, stale = dedup.split_new(orders.where("o_orderstatus <> 'F'").select("id"), orders.where("o_totalprice > 100000").select("id"))
    return new.withColumn("state", F.lit("new")).unionByName(stale.withColumn("state", F.lit("stale")))


@_query("SELECT lang AS index_name, count(*) AS chunks, count(DISTINCT source) AS documents FROM documents GROUP BY lang")
def q_index_stats(spark, sf_dir):
    return retrieve.index_stats(_t(spark, sf_dir, "documents").withColumnRenamed("lang", "index_name"))


@_query("SELECT count(*) AS chunks, count(DISTINCT o_clerk) AS documents, list_slice(list_sort(list(DISTINCT o_clerk)), 1, 20)::VARCHAR AS sources, min(day) AS oldest, max(day) AS newest FROM (SELECT 'c' || o_custkey AS o_clerk, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)")
def q_base_stats(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    found = retrieve.base_stats(orders)
    return found.withColumn("sources", F.concat(F.lit("["), F.array_join("sources", ", "), F.lit("]")))


@_query(
    """WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[а-яА-ЯёЁіїєґІЇЄҐ]')) AS y, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]')) AS l, len(regexp_extract_all(coalesce(text, ''), '[가-힣]')) AS k, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CASE WHEN y + l + k = 0 THEN '' WHEN greatest(y, l, k) / (y + l + k) < 0.6 THEN 'mixed' WHEN y = greatest(y, l, k) AND regexp_matches(t, '[іїєґІЇЄҐ]') THEN 'uk' WHEN y = greatest(y, l, k) THEN 'ru' WHEN l = greatest(y, l, k) THEN 'en' ELSE 'ko' END AS lang,
CASE WHEN y > l AND y > k THEN 'cyrillic' WHEN k > l AND k > y THEN 'hangul' ELSE 'latin' END AS script FROM c"""
)
def q_lang_script(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.detect_lang(F.col("text")).alias("lang"), T.script_of(F.col("text")).alias("script"))


_STRIP = r"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\v\x1c-\x1f\x85\p{{Z}}]+|[\s\v\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
_HTML = r"""replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
'(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<head.*?</head>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|tr|li|h[1-6])>', chr(10), 'g'), '(?i)</t[dh]>', chr(9), 'g'), '(?s)<[^>]+>', '', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''')"""
_HTML_TEXT = _STRIP.format(x="PLACE").replace("PLACE", _HTML.replace("(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<head.*?</head>", "(?is)<script.*?</script>|<style.*?</style>|<head.*?</head>").replace("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(", "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(", 1))


@_query(f"SELECT page_id, {_HTML_TEXT} AS text FROM pages")
def q_html_to_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@_query(
    f"""WITH t AS (SELECT page_id, url, {_HTML_TEXT} AS x FROM pages) SELECT page_id, regexp_matches(url, '(?i)^https?://[^/]+') AS valid, url AS fetched,
CASE WHEN regexp_matches(url, '(?i)^https?://arxiv\\.org/abs/') THEN 'ABSTRACT ONLY' WHEN length(x) < 1200 THEN 'SHORT PAGE' ELSE '' END AS note, CASE WHEN length(x) <= 8000 THEN x ELSE left(x, 8000) || chr(10) || chr(10) || '[... truncated, ' || length(x) || ' characters in total]' END AS text FROM t"""
)
def q_read_url(spark, sf_dir):
    from siltwork.sources import web

    return web.read_urls(_t(spark, sf_dir, "pages"))


@_query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 400) || chr(10) || chr(10) || '[... truncated, ' || length(text) || ' characters in total]' END AS text FROM documents")
def q_truncate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), schema.SNIPPET).alias("text"))


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\v\x1c-\x1f\x85\p{{Z}}]+|[\s\v\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"


def _tail_of_sql(x: str, n: int) -> str:
    """The last n characters from the first whole word on."""
    return f"CASE WHEN {x} IS NULL THEN '' WHEN length({x}) <= {n} THEN {_strip_sql(x)} WHEN instr(right({x}, {n}), ' ') > 0 THEN {_strip_sql(f'''substr(right({x}, {n}), instr(right({x}, {n}), ' ') + 1)''')} ELSE '' END"


def _split_sql(size: int, overlap: int, levels: int = 5) -> str:
    """The splitter as a recursive query: pieces go down level by level, and tails come up again, a window for each level."""
    sep = "CASE WHEN contains(t, chr(10) || chr(10)) THEN chr(10) || chr(10) WHEN contains(t, chr(10)) THEN chr(10) WHEN contains(t, '. ') THEN '. ' WHEN contains(t, ' ') THEN ' ' ELSE '' END"
    step = f"""CASE WHEN length(CASE WHEN a.open = '' THEN x.open ELSE a.open || sep || x.open END) <= {size} THEN {{'done': a.done, 'open': CASE WHEN a.open = '' THEN x.open ELSE a.open || sep || x.open END}}
WHEN length(x.open) <= {size} THEN {{'done': CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, 'open': x.open}}
ELSE {{'done': list_append(CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, x.open), 'open': ''}} END"""
    packed = f"list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform(string_split(t, sep), lambda p: {{'done': []::VARCHAR[], 'open': p}})), lambda a, x: {step})"
    windows = f"list_transform(range(0, length(t), {size - overlap}), lambda i: substr(t, i + 1, {size}))"
    cut = f"""SELECT doc_id, path, sep, CASE WHEN sep = '' THEN {windows} ELSE list_filter(list_append(r.done, r.open), lambda c: c <> '') END AS parts FROM (SELECT *, CASE WHEN sep = '' THEN {{'done': []::VARCHAR[], 'open': ''}} ELSE {packed} END AS r FROM (SELECT *, {sep} AS sep FROM ({{source}})))"""
    # Pieces too long are cut at the next level; a hard cut's windows are final.
    rec = f"""WITH RECURSIVE docs AS (SELECT doc_id, {_strip_sql("coalesce(text, '')")} AS t FROM documents),
node(doc_id, path, t, long, hard) AS (SELECT doc_id, '', t, length(t) > {size}, false FROM docs WHERE t <> ''
UNION ALL SELECT doc_id, path || '/' || lpad(k::VARCHAR, 7, '0'), CASE WHEN length(c) > {size} THEN {_strip_sql('c')} ELSE c END, length({_strip_sql('c')}) > {size}, sep = '' FROM (SELECT doc_id, path, sep, unnest(parts) AS c, generate_subscripts(parts, 1) AS k FROM ({cut.replace('{source}', 'SELECT doc_id, path, t FROM node WHERE long')}))),
s{levels} AS (SELECT doc_id, path, hard, t FROM node WHERE NOT long)"""
    for level in range(levels - 1, -1, -1):
        # Leaves below a node of this level get the tail of the one before them there.
        depth = 8 * level
        rec += f""",
s{level} AS (SELECT doc_id, path, hard, CASE WHEN length(path) > {depth} AND tail <> '' AND NOT (hard AND length(path) = {depth + 8}) THEN {_strip_sql("tail || ' ' || t")} ELSE t END AS t FROM (SELECT *, {_tail_of_sql('before', overlap)} AS tail FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id, left(path, {depth}), length(path) > {depth} ORDER BY path) AS before FROM s{level + 1})))"""
    return rec + f""",
o AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS pos FROM s0 WHERE {_strip_sql('t')} <> '')
SELECT doc_id, sha256(text) AS digest, 1::INTEGER AS page, pos::INTEGER AS pos, o.t AS text, left(sha256(sha256(text) || ':1:' || pos), 16) AS id FROM o JOIN documents USING (doc_id)"""


@_query(_split_sql(schema.CHUNK_SIZE, schema.CHUNK_OVERLAP))
def q_chunk_split(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.lit(1).alias("page"), "text")
    return chunking.document_chunks(docs, ("doc_id", "digest", "page"))


def _pack_sql(table: str, keys: str, text: str, most: int = 4000, overlap: int = 300) -> str:
    """Rows (keys, pos, text) of paragraphs packed."""
    return f"""SELECT {keys}, unnest(range(len(parts))) AS pos, unnest(parts) AS text FROM (SELECT {keys}, CASE WHEN length({text}) <= {most} THEN [{text}]
ELSE list_filter(list_append(acc.done, acc.buf), lambda x: x <> '') END AS parts FROM (SELECT *, list_reduce(list_transform(string_split({text}, chr(10) || chr(10)), lambda p: {{'done': []::VARCHAR[], 'buf': p}}),
lambda a, x: CASE WHEN a.buf = '' THEN {{'done': a.done, 'buf': x.buf}} WHEN length(a.buf) + 2 + length(x.buf) <= {most} THEN {{'done': a.done, 'buf': a.buf || chr(10) || chr(10) || x.buf}}
ELSE {{'done': list_append(a.done, a.buf), 'buf': right(a.buf, {overlap}) || chr(10) || chr(10) || x.buf}} END) AS acc FROM {table}))"""


@_query("SELECT doc_id, pos::INTEGER AS pos, text FROM (" + _pack_sql("(SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS body FROM documents)", "doc_id", "body") + ")")
def q_para_pack(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.paragraph_chunks(docs, ("doc_id",))


@_query("WITH p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS prior FROM documents), t AS (SELECT *, right(prior, 100) AS tail FROM p) SELECT doc_id, coalesce(trim(CASE WHEN prior IS NULL THEN '' WHEN length(prior) <= 100 THEN prior WHEN instr(tail, ' ') > 0 THEN substr(tail, instr(tail, ' ') + 1) ELSE '' END, ' ' || chr(9) || chr(10) || chr(13)), '') AS tail FROM t")
def q_carry_tail(spark, sf_dir):
    order = Window.partitionBy("source").orderBy("doc_id")
    return _t(spark, sf_dir, "documents").select("doc_id", T.carry_tail(F.lag("text").over(order), schema.CHUNK_OVERLAP).alias("tail"))


# Mails made of conversations: each turn is answered below a signature, with a quotation and at times a disclaimer.
_TAIL = ("\nBest regards,\nAnn\n[cid:1]\nOn Monday, 3 May 2021, someone wrote:\n> quoted line", "\n> quoted\nsaid\nThis message is confidential\nnever read", "\n\n\n\nSent from my iPhone")


def _alternatives(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _tail_sql(k: int) -> str:
    return "'" + _TAIL[k].replace("\n", "' || chr(10) || '") + "'"


@_query(
    rf"""WITH a AS (SELECT conv_id, turn, list_filter(string_split(replace(replace(coalesce(text, '') || CASE turn % 3 WHEN 0 THEN {_tail_sql(0)} WHEN 1 THEN {_tail_sql(1)} ELSE {_tail_sql(2)} END, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '{_alternatives(M.NOISE + M.MOBILE_FOOTERS)}')) AS l FROM conversations),
b AS (SELECT *, list_min(list_filter(range(2, len(l) + 1), lambda i: regexp_matches(l[i], '{_alternatives(M.QUOTE_HEADERS)}'))) AS q FROM a),
c AS (SELECT *, CASE WHEN q IS NULL THEN l ELSE l[1:q - 1] END AS k, CASE WHEN q IS NULL THEN 0 ELSE list_sum(list_transform(l[q:], lambda x: length(x))) END AS ra FROM b),
d AS (SELECT *, list_filter(k, lambda x: NOT regexp_matches(x, '{M.QUOTED}')) AS m, ra + coalesce(list_sum(list_transform(list_filter(k, lambda x: regexp_matches(x, '{M.QUOTED}')), lambda x: length(x))), 0) AS removed FROM c),
e AS (SELECT *, list_min(list_filter(range(1, len(m) + 1), lambda i: regexp_matches(m[i], '{_alternatives(M.DISCLAIMERS)}'))) AS ds FROM d),
f AS (SELECT *, CASE WHEN ds IS NULL THEN m ELSE m[1:ds - 1] END AS n FROM e),
g AS (SELECT *, list_max(list_filter(range(greatest(1, len(n) - 14), len(n) + 1), lambda i: regexp_matches(n[i], '{_alternatives(M.SIGNATURES)}'))) AS sg FROM f)
SELECT conv_id, turn, {_STRIP.format(x="array_to_string(CASE WHEN sg IS NULL THEN n ELSE n[1:sg - 1] END, chr(10))")} AS body, removed::INTEGER AS quoted_removed_chars, sg IS NOT NULL AS signature_removed, ds IS NOT NULL AS disclaimer_removed FROM g"""
)
def q_clean_body(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAIL]), (F.col("turn") % 3 + 1).cast("int"))
    rows = _t(spark, sf_dir, "conversations").withColumn("mail", F.concat(F.coalesce("text", F.lit("")), tail))
    return M.clean_body(rows, "mail", ("conv_id", "turn"))


# Mails made of orders: a customer writes, a supplier-like address receives; ids are text.
_MSG = """msg AS (SELECT 'm' || lpad(o_orderkey::VARCHAR, 9, '0') AS message_id, 't' || (o_custkey % 500) AS thread_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, 'User' || c_custkey || '@' || lower(replace(n_name, ' ', '-')) || '.example' AS sender_email, c_name AS sender_name,
CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE 'Order ' || o_orderpriority END AS subject, ['clerk' || (o_orderkey % 97) || '@corp.example'] AS to_emails, '[{"email": "clerk' || (o_orderkey % 97) || '@corp.example"}]' AS to_json, '[]' AS cc_json,
CASE WHEN o_totalprice > 150000 THEN ['invoice-' || (o_orderkey % 7) || '.pdf'] ELSE [] END AS attachments, o_orderstatus = 'P' AS is_bulk FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    clerk = F.concat(F.lit("clerk"), F.col("o_orderkey") % 97, F.lit("@corp.example"))
    return rows.select(
        F.concat(F.lit("m"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("message_id"), F.concat(F.lit("t"), F.col("o_custkey") % 500).alias("thread_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.concat(F.lit("User"), "c_custkey", F.lit("@"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example")).alias("sender_email"), F.col("c_name").alias("sender_name"),
        F.when(F.col("o_orderpriority").startswith("5"), "").otherwise(F.concat(F.lit("Order "), "o_orderpriority")).alias("subject"), F.array(clerk).alias("to_emails"), F.concat(F.lit('[{"email": "'), clerk, F.lit('"}]')).alias("to_json"), F.lit("[]").alias("cc_json"),
        F.when(F.col("o_totalprice") > 150000, F.array(F.concat(F.lit("invoice-"), F.col("o_orderkey") % 7, F.lit(".pdf")))).otherwise(F.array().cast("array<string>")).alias("attachments"), (F.col("o_orderstatus") == "P").alias("is_bulk"),
    )


@_query(f"WITH {_MSG} SELECT message_id, thread_id, date, sender_email, coalesce(nullif(subject, ''), '(без темы)') AS subject FROM msg WHERE date >= '1995-01-01' AND date <= '1996-12-31T23:59:59' AND NOT is_bulk AND contains(lower(sender_email || ' ' || to_json || ' ' || cc_json), 'clerk1') ORDER BY date DESC, message_id LIMIT 30")
def q_list_messages(spark, sf_dir):
    return mail.list_messages(messages(spark, sf_dir), "1995-01-01", "1996-12-31", "clerk1").select("message_id", "thread_id", "date", "sender_email", "subject")


@_query(f"WITH {_MSG}, l AS (SELECT * FROM msg WHERE NOT is_bulk ORDER BY date NULLS FIRST, message_id LIMIT 500) SELECT message_id, date FROM l WHERE NOT ends_with(lower(sender_email), '@china.example')")
def q_load_all(spark, sf_dir):
    return mail.load_all(messages(spark, sf_dir), limit=500, exclude=("*@china.example",)).select("message_id", "date")


@_query(
    f"""WITH {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date DESC NULLS LAST, message_id) AS n, count(*) OVER (PARTITION BY thread_id) AS messages_in_thread FROM msg),
a AS (SELECT thread_id, f, min(n) AS n FROM (SELECT thread_id, n, unnest(attachments) AS f FROM r) GROUP BY ALL), l AS (SELECT thread_id, string_agg(f, ', ' ORDER BY n) AS files FROM a GROUP BY thread_id)
SELECT thread_id, message_id, date, messages_in_thread, coalesce(files, '') AS files FROM r LEFT JOIN l USING (thread_id) WHERE n = 1"""
)
def q_thread_collapse(spark, sf_dir):
    return mail.collapse_threads(messages(spark, sf_dir)).select("thread_id", "message_id", "date", "messages_in_thread", F.array_join("attachments", ", ").alias("files"))


# Conversations as threads: a turn is a mail, its role the sender.
_CONV = "cv AS (SELECT conv_id AS thread_id, conv_id || ':' || turn AS message_id, lpad(turn::VARCHAR, 6, '0') AS date, CASE WHEN turn > 0 THEN text ELSE '' END AS subject, text AS body, role || '@' || role || '.example' AS sender FROM conversations WHERE length(trim(text)) >= 3)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    who = F.concat("role", F.lit("@"), "role", F.lit(".example"))
    return c.select(
        F.col("conv_id").alias("thread_id"), F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("date"), F.when(F.col("turn") > 0, F.col("text")).otherwise("").alias("subject"), F.col("text").alias("body"),
        who.alias("sender"), F.array(F.lit("all@corp.example")).alias("to"), F.array().cast("array<string>").alias("cc"), F.array(who, F.lit("all@corp.example")).alias("emails"), F.array().cast("array<string>").alias("attachment_names"), F.array(F.lit("all@corp.example")).alias("to_emails"),
    )


@_query(
    f"""WITH {_CONV}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date IS NULL, date, message_id) AS idx FROM cv)
SELECT thread_id, count(*) AS messages, coalesce(arg_min(subject, idx) FILTER (subject <> ''), '') AS thread_subject, min(date) AS started_at, max(date) AS last_at, list_sort(list_distinct(list(split_part(sender, '@', 2)) || ['corp.example']))::VARCHAR AS domains, list_sort(list_distinct(list(sender) || ['all@corp.example']))::VARCHAR AS participants FROM r GROUP BY thread_id"""
)
def q_thread_build(spark, sf_dir):
    rows = mail.threads(_turns(spark, sf_dir))
    return rows.select("thread_id", "messages", "thread_subject", "started_at", "last_at", F.concat(F.lit("["), F.array_join("thread_domains", ", "), F.lit("]")).alias("domains"), F.concat(F.lit("["), F.array_join(F.sort_array("participants"), ", "), F.lit("]")).alias("participants"))


@_query(
    f"""WITH {_CONV}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date IS NULL, date, message_id) AS idx, count(*) OVER (PARTITION BY thread_id) AS messages FROM cv), s AS (SELECT thread_id, coalesce(arg_min(subject, idx) FILTER (subject <> ''), '') AS ts FROM r GROUP BY thread_id)
SELECT message_id, 'Тема: ' || coalesce(nullif(ts, ''), '(без темы)') || chr(10) || 'От: ' || sender || ' | Кому: all@corp.example' || chr(10) || 'Дата: ' || left(date, 10) || ' | Письмо ' || idx || ' из ' || messages || chr(10) || '---' || chr(10) AS header FROM r JOIN s USING (thread_id)"""
)
def q_context_header(spark, sf_dir):
    rows = mail.in_threads(_turns(spark, sf_dir))
    return rows.select("message_id", mail.context_header(F.col("thread_subject"), F.col("sender"), F.col("to"), F.col("cc"), F.col("date"), F.col("idx"), F.col("messages")).alias("header"))


@_query(
    f"""WITH {_CONV}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY date IS NULL, date, message_id) AS idx, count(*) OVER (PARTITION BY thread_id) AS messages FROM cv), s AS (SELECT thread_id, coalesce(arg_min(subject, idx) FILTER (subject <> ''), '') AS ts FROM r GROUP BY thread_id),
h AS (SELECT message_id, thread_id, idx, coalesce(nullif(ts, ''), '(без темы)') AS source, body, 'Тема: ' || coalesce(nullif(ts, ''), '(без темы)') || chr(10) || 'От: ' || sender || ' | Кому: all@corp.example' || chr(10) || 'Дата: ' || left(date, 10) || ' | Письмо ' || idx || ' из ' || messages || chr(10) || '---' || chr(10) AS header FROM r JOIN s USING (thread_id))
SELECT sha1(message_id || ':' || pos) AS id, thread_id AS path, idx::INTEGER AS page, source, header || text AS text, pos::INTEGER AS part_no FROM ({_pack_sql("h", "message_id, thread_id, idx, source, header", "body")})"""
)
def q_mail_chunks(spark, sf_dir):
    chunks = mail.mail_chunks(_turns(spark, sf_dir), ("attachment_names", "to_emails", "sender"))
    return mail.index_chunks(chunks.withColumnRenamed("thread_subject", "subject")).select("id", "path", "page", "source", "text", "part_no")


@_query(f"WITH {_MSG} SELECT DISTINCT lower(unnest(to_emails)) AS address FROM msg WHERE lower(sender_email) = 'user1@argentina.example' OR sender_name = 'Customer#000000001'")
def q_wrote_to(spark, sf_dir):
    own = messages(spark, sf_dir)
    return mail.wrote_to(own.withColumn("sender_email", F.when(F.col("sender_name") == "Customer#000000001", "user1@argentina.example").otherwise(F.col("sender_email"))), "user1@argentina.example")


RULES: importance.Rules = {
    "default_weight": 20,
    "counterparties": [{"name": "Ada", "weight": 95, "match": ["user7@*", "argentina.example"]}, {"name": "Bo", "weight": 60, "match": ["*@*an.example"]}, {"name": "Cy", "weight": 35, "match": ["user1*@*"]}],
    "noise": ["*@japan.example", "*@iraq.example"],
    "roles": [{"match": ["director"], "multiplier": 1.5}],
    "topics": [{"name": "urgent", "match": ["1-urg"], "multiplier": 1.5, "floor": 70, "overrides_noise": True}, {"name": "routine", "match": ["4-not", "3-med"], "multiplier": 0.6}],
    "tuning": {"reciprocity_bonus": 12, "attachment_bonus": 5, "search_boost": 0},
}
_SCORE = f"""{_MSG}, w AS (SELECT DISTINCT lower('User' || (o_orderkey % 97) || '@' || lower(replace(n_name, ' ', '-')) || '.example') AS address FROM orders CROSS JOIN nation WHERE n_nationkey = o_orderkey % 25 AND o_totalprice > 200000),
a AS (SELECT *, lower(sender_email) AS s, lower(subject || ' ' || array_to_string(attachments, ' ') || ' ') AS x FROM msg),
b AS (SELECT *, CASE WHEN starts_with(s, 'user7@') OR ends_with(s, '@argentina.example') THEN 'Ada' WHEN ends_with(s, 'an.example') THEN 'Bo' WHEN starts_with(s, 'user1') THEN 'Cy' ELSE '' END AS party,
  CASE WHEN regexp_matches(x, '\\b1-urg') THEN 0 WHEN regexp_matches(x, '\\b4-not') OR regexp_matches(x, '\\b3-med') THEN 1 END AS topic, ends_with(s, '@japan.example') OR ends_with(s, '@iraq.example') AS noisy, s IN (SELECT address FROM w) AS wrote FROM a),
c AS (SELECT *, CASE party WHEN 'Ada' THEN 95 WHEN 'Bo' THEN 60 WHEN 'Cy' THEN 35 ELSE 20 END::DOUBLE * CASE topic WHEN 0 THEN 1.5 WHEN 1 THEN 0.6 ELSE 1 END::DOUBLE + CASE WHEN wrote THEN 12 ELSE 0 END + CASE WHEN len(attachments) > 0 THEN 5 ELSE 0 END AS base, noisy AND NOT (party <> '' AND coalesce(topic = 0, false)) AS noise FROM b),
sc AS (SELECT message_id, sender_email, date, CASE WHEN noise THEN 0 ELSE round_even(CASE WHEN topic = 0 AND base < 70 THEN 70 ELSE base END, 0) END::BIGINT AS score, CASE WHEN noise THEN '' ELSE party END AS counterparty, noise FROM c)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "nation")
    wrote = o.where("o_totalprice > 200000").join(n, F.col("n_nationkey") == F.col("o_orderkey") % 25)
    wrote = wrote.select(F.concat(F.lit("user"), F.col("o_orderkey") % 97, F.lit("@"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example")).alias("address"))
    return importance.score(messages(spark, sf_dir).withColumn("body_preview", F.lit("")), RULES, wrote)


@_query(
    f"""WITH {_SCORE} SELECT message_id, CASE WHEN noise THEN 'in the noise list' ELSE concat_ws(' | ', CASE party WHEN 'Ada' THEN 'Ada: 95' WHEN 'Bo' THEN 'Bo: 60' WHEN 'Cy' THEN 'Cy: 35' ELSE 'unknown sender: 20' END, CASE topic WHEN 0 THEN 'topic urgent: x1.5' WHEN 1 THEN 'topic routine: x0.6' END,
CASE WHEN wrote THEN 'written to before: +12' END, CASE WHEN len(attachments) > 0 THEN 'attachments: +5' END, CASE WHEN topic = 0 AND base < 70 THEN 'floor of the topic: 70' END) END AS reasons FROM c"""
)
def q_importance_reasons(spark, sf_dir):
    return _scored(spark, sf_dir).select("message_id", F.array_join("reasons", " | ").alias("reasons"))


@_query(f"WITH {_SCORE} SELECT message_id, score, counterparty, noise FROM sc")
def q_importance_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("message_id", "score", "counterparty", "noise")


@_query(
    f"""WITH {_SCORE}, p AS (SELECT *, coalesce(nullif(counterparty, ''), nullif(sender_email, ''), '?') AS party FROM sc WHERE NOT noise), n AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY score DESC, date DESC NULLS LAST, message_id) AS nth, count(*) OVER (PARTITION BY party) AS total FROM p),
k AS (SELECT * FROM n WHERE nth <= 2 ORDER BY score DESC, date DESC NULLS LAST, message_id LIMIT 20) SELECT message_id, party, score, total - least(total, 2) AS hidden FROM k"""
)
def q_digest(spark, sf_dir):
    return importance.digest(_scored(spark, sf_dir)).select("message_id", "party", "score", "hidden")


@_query("SELECT count(*) AS messages, count(DISTINCT user_id) AS threads, sum((event_type = 'view')::INTEGER)::BIGINT AS bulk, min(ts)::VARCHAR AS oldest, max(ts)::VARCHAR AS newest FROM events")
def q_mail_stats(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.coalesce(F.col("event_type") == "view", F.lit(False)).alias("is_bulk"), F.col("ts").alias("date"))
    return mail.stats(e).withColumn("oldest", F.col("oldest").cast("string")).withColumn("newest", F.col("newest").cast("string"))


@_query(f"WITH {_MSG} SELECT lower(substr(sender_email, instr(sender_email, '@') + 1)) AS domain, count(*) AS n FROM msg WHERE sender_email LIKE '%@%' GROUP BY ALL ORDER BY n DESC, domain LIMIT 15")
def q_top_domains(spark, sf_dir):
    return mail.top_domains(messages(spark, sf_dir))


@_query("SELECT conv_id, list_has_any(list(role), ['system', 'tool']) AS wanted FROM conversations GROUP BY conv_id")
def q_label_overlap(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("labels")).select("conv_id", F.arrays_overlap("labels", F.array(F.lit("system"), F.lit("tool"))).alias("wanted"))


@_query(
    f"""WITH t AS (SELECT length(coalesce(html, '')) AS raw, length({_HTML_TEXT}) AS clean, html LIKE '%<br>%' AS s, html LIKE '%&amp;%' AS d FROM pages), r AS (SELECT *, clean / greatest(raw, 1) AS ratio FROM t)
SELECT count(*) AS n, round(100.0::DOUBLE * avg(s::INTEGER), 4) AS signature_pct, round(100.0::DOUBLE * avg(d::INTEGER), 4) AS disclaimer_pct, count_if(clean < 3)::BIGINT AS empty, count_if(ratio > 0.95)::BIGINT AS untouched, round(avg(ratio), 6) AS mean_ratio FROM r"""
)
def q_quality_report(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select(F.length(F.coalesce("html", F.lit(""))).alias("raw_chars"), F.length(T.html_to_text(F.col("html"))).alias("clean_chars"), F.contains("html", F.lit("<br>")).alias("signature_removed"), F.contains("html", F.lit("&amp;")).alias("disclaimer_removed"))
    return mail.quality_report(p)


@_query(r"WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, line_no::INTEGER AS line_no, CASE WHEN regexp_matches(line, '(?i)\blicen') THEN 'licen' WHEN regexp_matches(line, '(?i)\bapache') THEN 'apache' ELSE 'moron' END AS name FROM l WHERE regexp_matches(line, '(?i)\b(licen|apache|moron)')")
def q_name_scan(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")
    return logs.scan_names(lines, ["licen", "apache", "moron"]).drop("line")


@_query(
    """WITH r AS (SELECT *, CASE WHEN lag(role) OVER o = role THEN 0 ELSE 1 END AS change FROM conversations WHERE role <> 'system' AND trim(text) <> '' WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r) SELECT conv_id, run::BIGINT AS run, role, count(*) AS turns, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, run, role"""
)
def q_islands_merge(spark, sf_dir):
    return logs.merge_runs(_t(spark, sf_dir, "conversations"))


@_query("SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system, count_if(role <> 'system')::BIGINT AS turns FROM conversations GROUP BY conv_id")
def q_system_hoist(spark, sf_dir):
    return logs.hoist_system(_t(spark, sf_dir, "conversations"))


@_query(
    """WITH RECURSIVE d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) AS s FROM conversations),
f(conv_id, n, batch, items, chars) AS (SELECT conv_id, n, 0, 1, s FROM d WHERE n = 1 UNION ALL SELECT d.conv_id, d.n, CASE WHEN chars + s > 2000 OR items >= 4 THEN batch + 1 ELSE batch END, CASE WHEN chars + s > 2000 OR items >= 4 THEN 1 ELSE items + 1 END, CASE WHEN chars + s > 2000 OR items >= 4 THEN s ELSE chars + s END FROM f JOIN d ON d.conv_id = f.conv_id AND d.n = f.n + 1)
SELECT conv_id, batch, max(items) AS items, max(chars)::INTEGER AS chars FROM f GROUP BY conv_id, batch"""
)
def q_batch_packing(spark, sf_dir):
    return chunking.batches(_t(spark, sf_dir, "conversations").withColumn("size", F.length("text")), ("conv_id",), "turn", "size", 2000, 4)


@_query("SELECT event_type AS folder, count(*) AS messages, max(event_id) AS last_uid FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def q_stream_ingest(spark, sf_dir):
    from siltwork.streaming import ingest

    return ingest.replay(spark, sf_dir)


@_query("SELECT event_type AS folder, count_if(event_id > 500)::BIGINT AS new FROM events WHERE event_type <> 'view' GROUP BY event_type UNION ALL SELECT event_type, NULL::BIGINT FROM events WHERE event_type = 'view' GROUP BY event_type")
def q_count_new(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), F.lit(7).alias("uidvalidity"), F.col("event_id").alias("uid"))
    state = _t(spark, sf_dir, "events").select(F.col("event_type").alias("folder")).distinct().select("folder", F.when(F.col("folder") == "view", 6).otherwise(7).alias("uidvalidity"), F.lit(500).cast("bigint").alias("last_uid"))
    return logs.count_new(e, state)


@_query(
    """WITH n AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY day), c AS (SELECT day, n, n / 2.7::DOUBLE + 5 + n * 0.95::DOUBLE / 0.29::DOUBLE AS s FROM n)
SELECT day, n, round(s, 6) AS seconds, CASE WHEN s < 90 THEN greatest(5, round_even(s, 0)::INTEGER) || ' s' ELSE round_even(s / 60, 0)::INTEGER || ' min' END AS said, CASE WHEN s > 1500 THEN 'insufficient' WHEN s > 0.7::DOUBLE * 1500 THEN 'tight' ELSE 'ok' END AS verdict FROM c"""
)
def q_cost_model(spark, sf_dir):
    days = _t(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    seconds, said = logs.cost(F.col("n"))
    return days.select("day", "n", F.round(seconds, 6).alias("seconds"), said.alias("said"), logs.assess(seconds, F.lit(1500.0)).alias("verdict"))


@_query("SELECT source, count(*) AS n, round((64.0::DOUBLE * count(*) * 4 + 3 * sum(strlen(text))) / 1073741824, 9) AS gib FROM documents GROUP BY source")
def q_index_need(spark, sf_dir):
    per = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    return per.select("source", "n", F.round(logs.index_need(F.col("n"), F.lit(64.0), F.col("b")), 9).alias("gib"))


@_query(
    """SELECT n_name, date_part('year', o_orderdate)::INTEGER AS year, sum(round(l_extendedprice * (1 - l_discount), 4)::DECIMAL(18, 4))::DOUBLE AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_nationkey <> c_nationkey AND p_size < 25 GROUP BY ALL"""
)
def q_star_revenue(spark, sf_dir):
    li, o, c, n, s, p = (_t(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation", "supplier", "part"))
    rows = li.join(p.where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).where("s_nationkey <> c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")).cast("double").alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


_VOCABULARY = "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, source, unnest(w) AS term FROM tok) {where} GROUP BY term"


@_query(f"WITH {_TOK}, a AS ({_VOCABULARY.format(where='')}), b AS ({_VOCABULARY.format(where='WHERE source <> ' + repr('src1'))}) SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_first, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_second")
def q_vocabulary_copy(spark, sf_dir):
    """A copy that lacks a source tells so by its vocabulary."""
    docs = _t(spark, sf_dir, "documents")
    return lexical.same_vocabulary(lexical.terms(docs, "doc_id"), lexical.terms(docs.where("source <> 'src1'"), "doc_id"))


@_query(
    f"""WITH {_MSG}, f AS (SELECT message_id, regexp_replace(message_id, '[^\\p{{L}}\\p{{N}}_.\\-]', '_', 'g')[:80] AS folder, left(date, 10) AS mail_date FROM msg),
c AS (SELECT 'm' || lpad(o_orderkey::VARCHAR, 9, '0') AS folder, CASE WHEN o_orderkey % 3 = 0 THEN 'document' ELSE 'filesystem' END AS ds, '2001-01-01' AS d FROM orders)
SELECT CASE WHEN ds = 'filesystem' AND coalesce(mail_date, '') <> '' THEN 'mail' ELSE ds END AS date_source, count(*) AS labelled, count(mail_date) AS with_mail, min(CASE WHEN ds = 'filesystem' AND coalesce(mail_date, '') <> '' THEN mail_date ELSE d END) AS oldest FROM c LEFT JOIN f USING (folder) GROUP BY ALL"""
)
def q_relabel(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    chunks = o.select(F.concat(F.lit("m"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("folder"), F.col("o_orderkey").alias("path"))
    dates = o.select(F.col("o_orderkey").alias("path"), F.lit("2001-01-01").alias("date"), F.when(F.col("o_orderkey") % 3 == 0, "document").otherwise("filesystem").alias("date_source"))
    mails = mail.metadata_by_folder(messages(spark, sf_dir), T.attachment_folder(F.col("message_id"))).select("folder", "mail_date")
    return dedup.relabel(chunks, dates, mails).groupBy("date_source").agg(F.count("*").alias("labelled"), F.count("mail_date").alias("with_mail"), F.min("date").alias("oldest"))


@_query("SELECT role AS agent, count(*) AS calls, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY role")
def q_usage(spark, sf_dir):
    return logs.usage(_t(spark, sf_dir, "conversations").select(F.col("role").alias("agent"), F.length("text").alias("tokens")))


@_query(
    """WITH v AS (SELECT conv_id AS goal, turn AS round, CASE WHEN length(text) % 4 = 0 THEN 'APPROVE' ELSE 'REVISE' END AS verdict FROM conversations),
b AS (SELECT *, coalesce(max((verdict = 'APPROVE')::INTEGER) OVER o, 0) AS a, coalesce(sum((verdict = 'REVISE')::INTEGER) OVER o, 0) AS r FROM v WINDOW o AS (PARTITION BY goal ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT goal, round, verdict FROM b WHERE a = 0 AND r <= 2"""
)
def q_revisions(spark, sf_dir):
    v = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("goal"), F.col("turn").alias("round"), F.when(F.length("text") % 4 == 0, "APPROVE").otherwise("REVISE").alias("verdict"))
    return logs.revisions(v)


@_query("SELECT DISTINCT c_name AS name, lower(c_name) LIKE '%0000001%' OR lower(c_name) LIKE 'customer_00000000_' AS excluded FROM customer")
def q_glob_filter(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).distinct()
    return c.withColumn("excluded", T.matches_glob(F.col("name"), ["*0000001*", "CUSTOMER?00000000[0-9]"]))


@_query(f"WITH {_MSG} SELECT 'sender_email' AS field, string_agg(DISTINCT sender_email, ', ' ORDER BY sender_email) AS addresses FROM msg WHERE contains(lower(sender_email), 'r12') UNION ALL SELECT 'to_emails', string_agg(DISTINCT a, ', ' ORDER BY a) FROM (SELECT unnest(to_emails) AS a FROM msg) WHERE contains(lower(a), 'r12') HAVING count(*) > 0")
def q_resolve_correspondent(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("cc_emails", F.array().cast("array<string>"))
    return retrieve.resolve_correspondent(m, " R12 ").select("field", F.array_join("addresses", ", ").alias("addresses"))


@_query(f"WITH {_MSG} SELECT message_id FROM msg WHERE contains(lower(sender_email), 'k5') OR contains(lower(to_emails[1]), 'k5')")
def q_positions_for(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("cc_emails", F.array().cast("array<string>"))
    return m.where(retrieve.corresponds("K5")).select("message_id")


@_query(r"SELECT doc_id, regexp_replace(regexp_replace('RE: Fwd[2] : ' || replace(text, chr(10), ' '), '(?i)^(\s*(re|fwd?|fw)\s*(\[\d+\])?\s*:\s*)+', ''), '^[\s\v\x1c-\x1f\x85\p{Z}]+|[\s\v\x1c-\x1f\x85\p{Z}]+$', '', 'g') AS subject FROM documents")
def q_normalize_subject(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("RE: Fwd[2] : "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("raw"))
    return d.select("doc_id", T.normalize_subject(F.col("raw")).alias("subject"))
