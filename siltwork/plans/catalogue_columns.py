"""Queries over column functions, filters and small operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltwork import schema
from siltwork.adapters import resolve_ocr, translated
from siltwork.functions import text as T
from siltwork.operators import dedup, dense, fusion, importance, logs, mail, retrieve
from siltwork.plans.catalogue import _MSG, _SCORE, RULES, _scored, messages
from siltwork.plans.registry import query, table


@query("SELECT doc_id, CASE WHEN lang = 'es' THEN 'scores for hangul are not reliable' WHEN lang = 'de' THEN 'scores for kana are not reliable' END AS note FROM documents")
def q_unsupported_script(spark, sf_dir):
    script = F.when(F.col("lang") == "es", "hangul").when(F.col("lang") == "de", "kana").when(F.col("lang") == "fr", "cyrillic").otherwise("latin")
    return table(spark, sf_dir, "documents").select("doc_id", T.unsupported_script(script).alias("note"))


@query(
    """SELECT o_orderkey, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR lower(trim(p)) IN ('bulk', 'list', 'junk', 'auto_reply') OR (a <> '' AND lower(a) <> 'no') AS bulk
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Bulk ' WHEN 1 THEN 'normal' WHEN 2 THEN 'JUNK' ELSE '' END AS p, CASE o_orderkey % 7 WHEN 0 THEN 'auto-generated' WHEN 1 THEN 'No' ELSE '' END AS a FROM orders)"""
)
def q_is_bulk(spark, sf_dir):
    k = F.col("o_orderkey")
    header = lambda n: F.when(k % n == 0, F.lit("<x>"))
    precedence = F.when(k % 5 == 0, " Bulk ").when(k % 5 == 1, "normal").when(k % 5 == 2, "JUNK").otherwise("")
    auto = F.when(k % 7 == 0, "auto-generated").when(k % 7 == 1, "No").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.is_bulk(header(11), header(13), header(17), precedence, auto).alias("bulk"))


@query(
    r"""WITH r AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '../../etc/' || url WHEN 1 THEN url || '/' WHEN 2 THEN '  .hidden?name*.pdf. ' ELSE 'a\b:c.txt' END AS raw FROM pages),
b AS (SELECT *, replace(regexp_extract(regexp_replace(raw, '/+$', ''), '([^/]*)$', 1), '\', '_') AS base FROM r), k AS (SELECT *, regexp_replace(regexp_replace(base, '[^\p{L}\p{N}_\s.\-()\[\]«»]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS kept FROM b)
SELECT page_id, CASE WHEN kept = '' THEN 'attachment' ELSE left(kept, 150) END AS name, left(regexp_replace(raw, '[^\p{L}\p{N}_.\-]', '_', 'g'), 80) AS folder FROM k"""
)
def q_safe_names(spark, sf_dir):
    raw = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("../../etc/"), "url")).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("/"))).when(F.col("page_id") % 4 == 2, "  .hidden?name*.pdf. ").otherwise("a\\b:c.txt")
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(raw).alias("name"), T.attachment_folder(raw).alias("folder"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'report.md' WHEN turn % 3 = 1 THEN 'r' || turn || '.md' ELSE 'notes.md' END AS name FROM conversations")
def q_report_names(spark, sf_dir):
    raw = F.when(F.col("turn") % 3 == 0, "a/b/").when(F.col("turn") % 3 == 1, F.concat(F.lit("../r"), "turn")).otherwise("/tmp/notes.md")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.report_name(raw).alias("name"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'refusing to write an empty report' WHEN turn % 5 = 0 THEN '' WHEN turn % 5 = 1 THEN 'missing sections: Sources' WHEN turn % 5 = 2 THEN 'missing sections: Conclusions' ELSE 'missing sections: Conclusions, Sources' END AS error FROM conversations"""
)
def q_report_sections(spark, sf_dir):
    from siltwork.sources.tables import checked_reports

    body = F.concat(F.lit("# Title\n"), F.replace("text", F.lit("#"), F.lit("")))
    content = F.when(F.col("turn") % 5 == 0, F.concat(body, F.lit("\n## 1. Conclusions\nx\n### SOURCES\ny"))).when(F.col("turn") % 5 == 1, F.concat(body, F.lit("\n# Висновки\n"))).when(F.col("turn") % 5 == 2, F.concat(body, F.lit("\n#### References:\n"))).when(F.col("turn") % 5 == 3, F.concat(body, F.lit("\n##### Sources\nconclusions"))).otherwise("  ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("r").alias("filename"), content.alias("content"))
    told = checked_reports(rows.withColumn("filename", F.concat_ws("-", "conv_id", "turn")))
    return told.select(F.split_part("name", F.lit("-"), F.lit(1)).cast("long").alias("conv_id"), F.replace(F.split_part("name", F.lit("-"), F.lit(2)), F.lit(".md"), F.lit("")).cast("long").alias("turn"), "error")


@query("SELECT doc_id, 'INBOX/' || text || ' & more' AS name FROM documents WHERE text IS NOT NULL")
def q_modified_utf7(spark, sf_dir):
    """Whole texts coded as a folder's name and read back."""
    coded = F.replace(F.regexp_replace(F.regexp_replace(F.base64(F.encode("text", "UTF-16BE")), r"[\r\n]", ""), "=+$", ""), F.lit("/"), F.lit(","))
    name = F.concat(F.lit("INBOX/"), F.when(F.col("text") == "", "").otherwise(F.concat(F.lit("&"), coded, F.lit("-"))), F.lit(" &- more"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.decode_folder(name).alias("name"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'given' WHEN o_orderkey % 4 = 1 THEN 'r' || o_custkey WHEN o_orderkey % 4 = 2 THEN 'reply' ELSE 'm' || o_orderkey END AS root,
'<synthetic-' || left(sha256(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderstatus || '|' || o_orderpriority), 16) || '@local>' AS id FROM orders"""
)
def q_thread_roots(spark, sf_dir):
    k = F.col("o_orderkey")
    refs = F.when(k % 4 == 1, F.array(F.concat(F.lit("r"), "o_custkey"), F.lit("later"))).otherwise(F.array().cast("array<string>"))
    root = T.thread_root(F.when(k % 4 == 0, "given").otherwise(""), refs, F.when(k % 4 <= 2, "reply").otherwise(""), F.concat(F.lit("m"), k))
    return table(spark, sf_dir, "orders").select("o_orderkey", root.alias("root"), T.synthetic_id(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("id"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 5 ELSE greatest(1, least(l_partkey - 500, 10))::INTEGER END AS n FROM lineitem")
def q_clamp(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") == 3, "many").otherwise((F.col("l_partkey") - 500).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.clamp(raw, 1, 10, 5).alias("n"))


@query("SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(list_transform(embedding, lambda x: 3 * x::DOUBLE), lambda x: x * x)) / greatest(sqrt(list_sum(list_transform(list_transform(embedding, lambda x: 3 * x::DOUBLE), lambda x: x * x))), 1e-12) ** 2, 6) AS norm FROM embeddings")
def q_normalized_vectors(spark, sf_dir):
    unit = dense.normalized(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("SELECT max(len(embedding))::INTEGER AS dimension, min(len(embedding)) = max(len(embedding)) AS constant FROM embeddings")
def q_embedding_dim(spark, sf_dir):
    return dense.dimension(table(spark, sf_dir, "embeddings"))


@query("SELECT * FROM (VALUES ('explicit', 0.4::DOUBLE), ('margin', 0.235::DOUBLE), ('inverted', 0.02::DOUBLE)) t(name, threshold)")
def q_rerank_threshold(spark, sf_dir):
    told = {"explicit": fusion.rerank_threshold(0.9, 0.1, 0.4), "margin": fusion.rerank_threshold(0.8, 0.135294117647), "inverted": fusion.rerank_threshold(0.1, 0.2)}
    return spark.createDataFrame([(k, round(v, 6)) for k, v in told.items()], "name string, threshold double")


_PEOPLE = "p AS (SELECT c_custkey, [c_name || '@X.Example', '', c_mktsegment] AS e, [c_name, 'no one', ''] AS n FROM customer)"


@query(f"WITH {_PEOPLE} SELECT c_custkey, '[' || list_reduce(list_transform([1, 2, 3], lambda i: '{{\"email\":\"' || e[i] || '\",\"name\":\"' || n[i] || '\"}}'), lambda a, b: a || ',' || b) || ']' AS json, lower(e[1]) || ' ' || lower(e[3]) AS emails, n[2] AS second FROM p")
def q_address_json(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.concat("c_name", F.lit("@X.Example")), F.lit(""), "c_mktsegment").alias("e"), F.array("c_name", F.lit("no one"), F.lit("")).alias("n"))
    rows = rows.select("c_custkey", T.address_json(F.col("e"), F.col("n")).alias("json"))
    return rows.select("c_custkey", "json", F.array_join(T.emails_of(F.col("json")), " ").alias("emails"), T.addresses_of(F.col("json"))[1]["name"].alias("second"))


@query("SELECT conv_id, CASE WHEN n = 1 THEN 'docs' ELSE 'a,b ' || conv_id END AS names FROM (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM conversations GROUP BY conv_id)")
def q_index_names(spark, sf_dir):
    raw = F.when(F.col("conv_id") % 3 == 0, " , ,").otherwise(F.concat(F.lit(" a, b "), "conv_id", F.lit(",a,")))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.array_join(T.index_names(raw, "docs"), ",").alias("names"))


@query(
    """SELECT doc_id, CASE lang WHEN 'fr' THEN 'mail' WHEN 'de' THEN 'attachment' ELSE 'document' END AS kind, '[' || source || ', ' || CASE lang WHEN 'fr' THEN 'mail, message ' WHEN 'de' THEN 'attachment, p. ' ELSE 'p. ' END || doc_id || CASE WHEN lang = 'de' THEN '' ELSE ', 2024-05-06' END || '] 0.2500' AS said FROM documents"""
)
def q_citations(spark, sf_dir):
    kind = fusion.kind(F.when(F.col("lang").isin("fr", "de"), "m1"), F.when(F.col("lang") != "fr", "mail"))
    rows = table(spark, sf_dir, "documents").withColumn("kind", kind)
    return rows.select("doc_id", "kind", retrieve.citation(F.col("source"), F.col("doc_id").cast("string"), F.col("kind"), F.when(F.col("lang") == "de", "").otherwise("2024-05-06"), F.lit(0.25)).alias("said"))


@query(
    """WITH f AS (SELECT doc_id, source, lang, (contains(lower(source), 'rc1') AND coalesce(d >= '2024-01-10' AND d <= '2024-01-20', false) AND coalesce(lang IN ('en', 'de'), false) AND list_has_any(labels, ['l1', 'l2'])) AS hit
FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS d, ['l' || (doc_id % 4), 'x'] AS labels FROM documents))
SELECT count(DISTINCT source) FILTER (hit) AS matched_files, count_if(hit)::BIGINT AS matched_chunks FROM f"""
)
def q_filter_composition(spark, sf_dir):
    """All filters together, a list column's elements among them, and the flag that tells when nothing matches."""
    rows = table(spark, sf_dir, "documents").withColumn("date", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))))
    rows = rows.withColumn("labels", F.array(F.concat(F.lit("l"), F.col("doc_id") % 4), F.lit("x")))
    return retrieve.Filters("RC1", "", "2024-01-10", "2024-01-20", {"lang": ["en", "de"], "labels": ["l1", "l2"]}).matches(rows)


@query("SELECT 0::BIGINT AS matched_files, 0::BIGINT AS matched_chunks, count(*) > 0 AS any FROM documents")
def q_filter_unmatched(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return retrieve.Filters("no such source", "nobody", exact={"missing": ["x"]}).matches(rows).withColumn("any", F.lit(not rows.isEmpty()))


@query("SELECT d.doc_id, round(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)), 4) AS total FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def q_chunk_vectors(spark, sf_dir):
    """Chunks with the vectors that survive, by id."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, sf_dir, "documents").join(vectors, "doc_id").select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query(
    """WITH o AS (SELECT doc_id AS id, source AS path, text FROM documents WHERE lang <> 'es'), s AS (SELECT source AS path, CASE WHEN source = 'src3' THEN 'deleted' WHEN source IN ('src1', 'src2') THEN 'changed' ELSE 'unchanged' END AS state FROM documents GROUP BY ALL)
SELECT id, path FROM o JOIN s USING (path) WHERE state = 'unchanged' UNION ALL SELECT doc_id, source FROM documents JOIN s ON path = source WHERE lang = 'es' AND state = 'changed'"""
)
def q_merge_index(spark, sf_dir):
    """Old chunks of unchanged files and fresh ones of changed files; deleted ones lose theirs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "lang")
    state = F.when(F.col("path") == "src3", "deleted").when(F.col("path").isin("src1", "src2"), "changed").otherwise("unchanged")
    diff = docs.select("path").distinct().withColumn("state", state)
    return dedup.merge_index(docs.where("lang <> 'es'"), docs.where("lang = 'es'"), diff).select("id", "path")


@query(
    r"""WITH c AS (SELECT c_custkey, '(\HasNoChildren' || CASE c_custkey % 3 WHEN 0 THEN ' \Sent' ELSE '' END || ') "/" "' || c_name || '"' AS line FROM customer)
SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '\HasNoChildren|\Sent' ELSE '\HasNoChildren' END AS flags FROM customer"""
)
def q_folder_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    lines = c.select(F.concat(F.lit("(\\HasNoChildren"), F.when(F.col("c_custkey") % 3 == 0, " \\Sent").otherwise(""), F.lit(') "/" "'), "c_name", F.lit('"')).alias("value"))
    found = logs.folders(lines).select("name", F.array_join("flags", "|").alias("flags"))
    return found.join(c.select("c_custkey", F.col("c_name").alias("name")), "name").select("c_custkey", "name", "flags")


@query(r"SELECT * FROM (VALUES ('\Sent', 'Versand'), ('\Junk', NULL), ('INBOX', 'INBOX')) t(item, name)")
def q_resolve_folders(spark, sf_dir):
    wanted = spark.createDataFrame([("\\Sent",), ("\\Junk",), ("INBOX",)], "item string")
    known = logs.folders(spark.createDataFrame([('(\\HasNoChildren \\sent) "/" "Versand"',), ('(\\HasNoChildren) "/" INBOX',)], "value string"))
    return logs.resolve_folders(wanted, known)


@query("SELECT event_id AS uid, 'T' || user_id AS thread_id, event_type || ',\\Inbox' AS labels FROM events")
def q_fetch_meta(spark, sf_dir):
    line = F.concat(F.lit("1 (X-GM-THRID "), F.col("user_id"), F.lit(" X-GM-LABELS ("), "event_type", F.lit(' "\\Inbox") UID '), F.col("event_id"), F.lit(" RFC822 {12}"))
    m = logs.meta(line)
    return table(spark, sf_dir, "events").select(m["uid"].alias("uid"), F.concat(F.lit("T"), m["thread_id"]).alias("thread_id"), F.array_join(m["labels"], ",").alias("labels"))


@query(
    """WITH l AS (SELECT ts FROM events WHERE event_type = 'click' AND ts >= '2024-01-05 00:00:00') SELECT count(*) AS requests, count(*) * 64 AS chunks, round(count(*) * 64 / greatest(epoch(max(date_trunc('second', ts)))::BIGINT - epoch(min(date_trunc('second', ts)))::BIGINT, 1)::DOUBLE, 6) AS rate FROM l"""
)
def q_request_rate(spark, sf_dir):
    what = F.when(F.col("event_type") == "click", "POST /v1/embeddings").otherwise("GET /health")
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), what).alias("value"))
    return logs.request_rate(lines, "2024-01-05 00:00:00")


@query(
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'REVISE' END AS verdict, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'verdict: MAYBE is not one of APPROVE, REVISE' WHEN 2 THEN 'gaps: missing or of another type' ELSE 'not JSON' END AS problems FROM conversations"""
)
def q_typed_records(spark, sf_dir):
    whole = '"is_fresh": true, "is_complete": false, "is_well_structured": true, "strengths": [], "revision_requests": ["x"]'
    raw = F.when(F.col("turn") % 4 == 0, '{"verdict": "REVISE", "gaps": ["a"], ' + whole + "}").when(F.col("turn") % 4 == 1, '{"verdict": "MAYBE", "gaps": [], ' + whole + "}").when(F.col("turn") % 4 == 2, '{"verdict": "APPROVE", ' + whole + "}").otherwise("verdict: APPROVE")
    record, problems = logs.parse_record(F.col("raw"), schema.CRITIQUE, {"verdict": ("APPROVE", "REVISE")})
    return table(spark, sf_dir, "conversations").withColumn("raw", raw).select("conv_id", "turn", record["verdict"].alias("verdict"), F.array_join(problems, "; ").alias("problems"))


@query("SELECT conv_id, 'Searches:' || chr(10) || string_agg('- ' || role, chr(10) ORDER BY role) || chr(10) || chr(10) || 'Sources:' || chr(10) || '- mail' AS said FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY conv_id")
def q_plan_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    return rows.select("conv_id", logs.sections_text([("Searches", F.col("roles")), ("Gaps", F.array().cast("array<string>")), ("Sources", F.array(F.lit("mail")))]).alias("said"))


@query(f"WITH {_SCORE} SELECT DISTINCT sender_email, CASE WHEN ends_with(lower(sender_email), '@japan.example') OR ends_with(lower(sender_email), '@iraq.example') THEN 0.0 WHEN starts_with(lower(sender_email), 'user7@') OR ends_with(sender_email, '@argentina.example') THEN 0.95 WHEN ends_with(sender_email, 'an.example') THEN 0.6 WHEN starts_with(lower(sender_email), 'user1') THEN 0.35 ELSE 0.2 END::DOUBLE AS weight FROM sc")
def q_weight_of(spark, sf_dir):
    senders = messages(spark, sf_dir).select("sender_email").distinct()
    return senders.select("sender_email", importance.weight_of(F.col("sender_email"), RULES).alias("weight"))


@query(f"WITH {_SCORE} SELECT counterparty, noise, count(*) AS n, sum(score)::BIGINT AS total FROM sc GROUP BY ALL")
def q_importance_totals(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("counterparty", "noise").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(f"WITH {_MSG} SELECT split_part(date, '-', 1) AS folder, count(*) AS messages, count(DISTINCT thread_id) AS threads, sum(is_bulk::INTEGER)::BIGINT AS bulk FROM msg GROUP BY ALL")
def q_folder_stats(spark, sf_dir):
    return mail.folder_stats(messages(spark, sf_dir).withColumn("folder", F.split_part("date", F.lit("-"), F.lit(1))))


@query(
    """WITH r AS (SELECT conv_id * 1000 + turn AS id, length(replace(text, 'a', '')) / greatest(length(text), 1) AS ratio FROM conversations WHERE text IS NOT NULL),
w AS (SELECT *, row_number() OVER (ORDER BY ratio, id) AS lo, row_number() OVER (ORDER BY ratio DESC, id) AS hi FROM r)
SELECT 'worst' AS end, lo::INTEGER AS place, id, round(ratio, 9) AS ratio FROM w WHERE lo <= 5 UNION ALL SELECT 'best', hi::INTEGER, id, round(ratio, 9) FROM w WHERE hi <= 5"""
)
def q_cleaning_extremes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").alias("raw_chars"), F.length(F.replace("text", F.lit("a"), F.lit(""))).alias("clean_chars"))
    return mail.extremes(rows, "id", 5).withColumn("ratio", F.round("ratio", 9))


@query("SELECT conv_id, turn, text || chr(10) || '> quoted' || chr(10) AS raw, 8::INTEGER AS removed FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND NOT regexp_matches(text, '(?m)^\\s*>')")
def q_before_and_after(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = c.agg(F.min("conv_id").alias("conv_id"))
    rows = c.join(first, "conv_id").where(~F.col("text").rlike(r"(?m)^\s*>")).select("conv_id", "turn", F.concat("text", F.lit("\n> quoted\n")).alias("body"))
    return mail.before_and_after(rows, F.col("turn") >= 0).select("conv_id", "turn", "raw", F.col("quoted_removed_chars").alias("removed"))


@query("SELECT doc_id, list_sort(list_distinct([lang, 'x']))::VARCHAR AS asked, lang || ': ' || source AS text FROM documents")
def q_translated(spark, sf_dir):
    """Queries in the scripts that passages have, from a table."""
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.col("source").alias("query"), F.col("lang").alias("script")).distinct().withColumn("text", F.concat("script", F.lit(": "), "query"))
    said = translated(docs.select(F.col("source").alias("query")).distinct(), docs.select(F.col("lang").alias("script")), known).withColumnsRenamed({"query": "source", "script": "lang"})
    return docs.select("doc_id", "source", "lang").join(said, ["source", "lang"]).select("doc_id", F.concat(F.lit("["), F.array_join(F.sort_array(F.array("lang", F.lit("x"))), ", "), F.lit("]")).alias("asked"), "text")


@query("SELECT * FROM (VALUES ('off', 'off'), ('auto', 'tesseract'), ('vision', 'off'), ('tesseract', 'tesseract')) t(wanted, used)")
def q_ocr_backends(spark, sf_dir):
    return spark.createDataFrame([(w, resolve_ocr(w, {"tesseract"})) for w in ("off", "auto", "vision", "tesseract")], "wanted string, used string")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'plain ' || page_id ELSE 'a' || chr(10) || ' b' END AS body FROM pages")
def q_preprocess(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("plain "), "page_id")).otherwise("").alias("body_text"), F.lit("<p>a</p><head>x</head><b>b</b>").alias("body_html"))
    return rows.select("page_id", mail.body_of(F.col("body_text"), F.col("body_html")).alias("body"))


@query("SELECT event_type AS folder, event_id AS uid FROM events WHERE event_type = 'view' OR (event_type <> 'search' AND event_id > 300) OR event_type = 'search' AND event_id > 0")
def q_fresh_mails(spark, sf_dir):
    """Above the mark; all of a folder whose validity has changed, and all of one without a mark."""
    from siltwork.streaming import ingest

    mails = table(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), F.lit(7).cast("long").alias("uidvalidity"), F.col("event_id").alias("uid"), F.lit("x").alias("rfc_message_id"))
    state = mails.select("folder").distinct().where("folder <> 'search'").select("folder", F.when(F.col("folder") == "view", 6).otherwise(7).cast("long").alias("uidvalidity"), F.lit(300).cast("long").alias("last_uid"))
    return ingest.fresh(mails, state).select("folder", "uid")


@query("SELECT event_type AS folder, 7::BIGINT AS uidvalidity, greatest(max(event_id), CASE WHEN event_type = 'view' THEN 0 ELSE 300 END) AS last_uid FROM events GROUP BY event_type UNION ALL SELECT 'old', 5, 9")
def q_sync_marks(spark, sf_dir):
    from siltwork.streaming import ingest

    mails = table(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), F.lit(7).cast("long").alias("uidvalidity"), F.col("event_id").alias("uid"))
    state = mails.select("folder").distinct().select("folder", F.when(F.col("folder") == "view", 6).otherwise(7).cast("long").alias("uidvalidity"), F.lit(300).cast("long").alias("last_uid"))
    old = spark.createDataFrame([("old", 5, 9)], "folder string, uidvalidity long, last_uid long")
    return ingest.advanced(state.unionByName(old), mails)


@query("SELECT event_type AS folder, CASE WHEN event_type = 'view' THEN NULL ELSE 7 END::BIGINT AS uidvalidity, CASE WHEN event_type = 'view' THEN 0 ELSE max(event_id) END::BIGINT AS last_uid FROM events GROUP BY event_type")
def q_folder_state(spark, sf_dir):
    """Marks after an upsert, looked up for each folder; a folder without one starts at 0."""
    from siltwork.sources.tables import merge_state, state_of

    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("folder")).agg(F.max("event_id").alias("last_uid"))
    seen = e.where("folder <> 'view'").select("folder", F.lit(7).cast("long").alias("uidvalidity"), "last_uid")
    before = seen.where("folder = 'click'").select("folder", F.lit(3).cast("long").alias("uidvalidity"), F.lit(1).cast("long").alias("last_uid"))
    return state_of(e.select("folder"), merge_state(before, seen))
