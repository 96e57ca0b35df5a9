"""The opN_ queries over the given tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import bpe, exact_dedup, jaccard, langid, lm, maxscore, mixing, packing, toxicity, url_filter
from siltwork.llm.common import Scratch, crc_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The rules that op1 judges by.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = crc_of(F.col("doc_id")) % 4
    model = langid.fit(docs.where(fold != 2))
    return langid.identify(docs, model).select("doc_id", (crc_of(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), VOCABULARY, outputs=())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = crc_of(F.col("doc_id")) % 5
    model = toxicity.fit(docs, labels.where(fold != 0))
    return toxicity.score(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", "offending")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).drop("identity")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed matrices are written and read again; the rows returned are derived from the files."""
    path = Scratch(spark, "packed").path("matrices")
    packing.write_matrices(packing.pack_texts(_table(spark, sf_dir, "documents"), RANKS), path)
    return packing.digests(packing.read_matrices(spark, path))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), crc_of(F.col("doc_id")) % 5 != 1)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_maxscore": op2_maxscore,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_jaccard": op8_jaccard,
    "op9_lm": op9_lm,
    "op10_mixing": op10_mixing,
}

_NODE = r"""CASE WHEN {h} <> '' THEN {h} || regexp_replace({p}, '/$', '') || regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^?#]*(\?[^#]*)', 1) END"""
_HOST = r"""CASE WHEN coalesce(instr({u}, '://'), 0) > 0 THEN translate(regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"""
_PATH = r"""CASE WHEN coalesce(instr({u}, '://'), 0) > 0 THEN regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*(/[^?#]*)?', 1) ELSE '' END"""

SQL: dict[str, str] = {}
SQL["op1_url_filter"] = rf"""
WITH RECURSIVE rules(no, verdict, rule, host, path) AS (VALUES
    (0, 'allow', 'com/', 'com', '/'), (1, 'block', 'example.com/en/', 'example.com', '/en/'), (2, 'allow', 'www.example.com/en/', 'www.example.com', '/en/'),
    (3, 'block', 'net/es/', 'net', '/es/'), (4, 'block', 'net/fr/', 'net', '/fr/')),
p0 AS (SELECT row_number() OVER () AS r, page_id, url, html, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path FROM pages),
p AS (SELECT *, {_NODE.format(h="host", p="path", u="url")} AS node FROM p0),
f AS (SELECT r, arg_max(rules.rule, length(rule) * 1000 - no) AS rule, arg_max(rules.verdict, length(rule) * 1000 - no) AS own
    FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY r),
j AS (SELECT p.*, f.rule, f.own FROM p LEFT JOIN f USING (r)),
h AS (SELECT url, host, path, node, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*[''"]?\s*([^"''\s>;]+)', 1)]) AS href FROM p WHERE node IS NOT NULL),
a AS (SELECT node, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '^([^:/?#]*):', 1) || ':' || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^([^:/?#]*):', 1) || '://' || host || href
    ELSE regexp_extract(url, '^([^:/?#]*):', 1) || '://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS u FROM h WHERE href <> ''),
b AS (SELECT node, u, {_HOST.format(u="u")} AS bh, {_PATH.format(u="u")} AS bp FROM a),
e AS (SELECT node AS s, {_NODE.format(h="bh", p="bp", u="u")} AS d FROM b),
e2 AS (SELECT s, d FROM e WHERE d IS NOT NULL UNION SELECT d, s FROM e WHERE d IS NOT NULL),
reach(n, o) AS (SELECT s, s FROM e2 UNION SELECT e2.d, reach.o FROM reach JOIN e2 ON reach.n = e2.s),
comp AS (SELECT n, min(o) AS c FROM reach GROUP BY n),
mark AS (SELECT c, bool_or(own = 'block') AS block, coalesce(bool_or(own = 'allow'), false) AS allow FROM comp JOIN j ON comp.n = j.node GROUP BY c)
SELECT page_id, j.host, j.path, rule, coalesce(own, CASE WHEN block AND NOT allow THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN own IS NOT NULL THEN 'rule' WHEN coalesce(block AND NOT allow, false) THEN 'alias' ELSE 'default' END AS reason
FROM j LEFT JOIN comp ON j.node = comp.n LEFT JOIN mark USING (c)"""
SQL["op2_maxscore"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.w, v.w)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.r <> v.r),
r AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
SQL["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))"""
SQL["op8_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, hash(x) AS h, x FROM (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS x FROM w)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.x = b.x AND a.r < b.r GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN n na ON a = na.r JOIN n nb ON b = nb.r WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, y) AS (SELECT a, a FROM e2 UNION SELECT reach.x, e2.b FROM reach JOIN e2 ON reach.y = e2.a),
c AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = reach.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id FROM w LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""
SQL["op10_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s0),
s2 AS (SELECT *, [3, 1, 2][k % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s2)::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM s2) - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level, row_number() OVER (ORDER BY cap / weight, k) AS place
    FROM s2 WINDOW o AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(cap, coalesce((SELECT arg_min(level, place) FROM s3 WHERE cap / weight >= level) * weight, cap)) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM s4),
s6 AS (SELECT *, target - copies * source_size AS rest FROM s5),
c AS (SELECT source, h, sum(w) OVER (PARTITION BY source ORDER BY h) AS upto, w FROM (SELECT source, h, sum(size) AS w FROM d GROUP BY source, h)),
f AS (SELECT s6.source, min(h) AS h FROM s6 JOIN c ON s6.source IS NOT DISTINCT FROM c.source WHERE rest > 0 AND upto >= rest GROUP BY s6.source),
t AS (SELECT s6.*, CASE WHEN f.h IS NULL THEN 0 WHEN upto - rest < rest - (upto - w) THEN f.h + 1 ELSE f.h END AS threshold
    FROM s6 LEFT JOIN f ON s6.source IS NOT DISTINCT FROM f.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM f.source AND c.h = f.h)
SELECT doc_id, size, d.source, source_size, target, size * (copies + (h < threshold)::BIGINT) AS taken, CASE WHEN size > 0 THEN copies + (h < threshold)::BIGINT ELSE 0 END::INTEGER AS copies
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""
