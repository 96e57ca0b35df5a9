"""Queries over sources and sinks: files, mails, tables and reports that are made of the given tables, and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.plans.registry import query, table
from siltwork.scratch import shared_folder
from siltwork.sources import files, rfc822, tables


#: Mails of a dump's array, at most.
DUMP_ROWS = 10_000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/siltwork/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey::INTEGER AS key, sha256(n_name || chr(10)) AS digest, length(n_name) + 1 AS length FROM nation WHERE n_nationkey % 5 <> 0")
def q_discover(spark, sf_dir):
    """A file for each nation; those in hidden and excluded folders are not found."""
    root = _folder(spark, "files")
    place = F.when(F.col("n_nationkey") % 10 == 0, ".hidden").when(F.col("n_nationkey") % 10 == 5, "node_modules").otherwise("kept")
    # The second folder name is no column of its own: hidden folders must be below the root.
    table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("key"), place.alias("p")).write.partitionBy("key", "p").text(root)
    # Partition folders are named key=1/p=kept; the name after = decides here as a folder's name does.
    found = files.digested(files.discover(spark, root, ("p=.hidden", "p=node_modules")))
    return found.select(F.regexp_extract("path", r"key=(\d+)", 1).cast("int").alias("key"), "digest", "length")


@query("SELECT n_nationkey::INTEGER AS key, n_name || chr(10) AS text, 1::INTEGER AS page, 'filesystem' AS date_source FROM nation")
def q_read_files(spark, sf_dir):
    root = _folder(spark, "files")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("key")).write.partitionBy("key").text(root)
    found = files.discover(spark, root)
    read = files.read_documents(found).where("error is null").join(files.dated(found), "path")
    return read.select(F.regexp_extract("path", r"key=(\d+)", 1).cast("int").alias("key"), "text", "page", "date_source")


_CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dcterms="d"><dcterms:created>{day}T08:00:00Z</dcterms:created></cp:coreProperties>'
_DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>'
_BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Parts" r:id="r1"/></sheets></workbook>'
_RELS = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
_SLIDE = '<p:sld xmlns:p="p" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">{body}</p:sld>'


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(lines: list[str]) -> bytes:
    say = lambda x: f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    cells = "".join(f"<w:tc>{say(x)}</w:tc>" for x in ("total", str(len(lines))))
    return _zipped({"word/document.xml": _DOCX.format(body="".join(map(say, lines)) + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>"), "docProps/core.xml": _CORE.format(day="2020-02-03")})


def _xlsx(lines: list[str]) -> bytes:
    cell = lambda ref, x: f'<c r="{ref}" t="inlineStr"><is><t>{escape(x)}</t></is></c>'
    rows = [("name", "size"), *[(x, str(k)) for k, x in enumerate(lines, 1)]]
    # A row is left out after the header: an empty one.
    numbers = [1, *range(3, len(rows) + 2)]
    body = "".join(f'<row r="{n}">{cell(f"A{n}", a)}{cell(f"B{n}", b)}</row>' for n, (a, b) in zip(numbers, rows, strict=True))
    return _zipped({"xl/workbook.xml": _BOOK, "xl/_rels/workbook.xml.rels": _RELS, "xl/worksheets/sheet1.xml": _SHEET.format(rows=body), "docProps/core.xml": _CORE.format(day="2020-02-03")})


def _pptx(lines: list[str]) -> bytes:
    say = lambda x: f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>"
    slides = {f"ppt/slides/slide{k}.xml": _SLIDE.format(body=say(x)) for k, x in enumerate(lines, 1)}
    notes = {f"ppt/notesSlides/notesSlide{k}.xml": _SLIDE.format(body=say(f"note {k}")) for k in range(1, len(lines) + 1)}
    return _zipped(slides | notes | {"docProps/core.xml": _CORE.format(day="2020-02-03")})


def _office(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    """A file of each region: a line for each of its nations, in order."""
    make = {".docx": _docx, ".xlsx": _xlsx, ".pptx": _pptx}[suffix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [make(x) for x in batch["names"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], batch["modificationTime"], pa.array(content, pa.binary())], ["path", "modificationTime", "content"])

    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    rows = rows.select(F.concat(F.lit("/d/"), "n_regionkey", F.lit(suffix)).alias("path"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"), "names")
    return rows.mapInArrow(run, "path string, modificationTime timestamp, content binary")


def _office_text(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    made = _office(spark, sf_dir, suffix)
    return files.read_documents(made).join(files.dated(made), "path").select("path", "page", "text", "error", "date", "date_source")


@query("SELECT '/d/' || n_regionkey || '.docx' AS path, 1::INTEGER AS page, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) || 'total | ' || count(*) AS text, NULL::VARCHAR AS error, '2020-02-03' AS date, 'document' AS date_source FROM nation GROUP BY n_regionkey")
def q_docx(spark, sf_dir):
    return _office_text(spark, sf_dir, ".docx")


@query(
    """WITH r AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation)
SELECT '/d/' || n_regionkey || '.xlsx' AS path, 1::INTEGER AS page, 'Sheet: Parts' || chr(10) || 'name | size' || chr(10) || string_agg('name: ' || n_name || '; size: ' || k, chr(10) ORDER BY k) AS text, NULL::VARCHAR AS error, '2020-02-03' AS date, 'document' AS date_source FROM r GROUP BY n_regionkey"""
)
def q_xlsx(spark, sf_dir):
    return _office_text(spark, sf_dir, ".xlsx")


@query(
    """WITH r AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation)
SELECT '/d/' || n_regionkey || '.pptx' AS path, k::INTEGER AS page, n_name || chr(10) || 'Notes: note ' || k AS text, NULL::VARCHAR AS error, '2020-02-03' AS date, 'document' AS date_source FROM r"""
)
def q_pptx(spark, sf_dir):
    return _office_text(spark, sf_dir, ".pptx")


@query("SELECT '/d/' || n_regionkey || '.docx' AS path, 'BadZipFile' AS error FROM nation GROUP BY n_regionkey")
def q_bad_files(spark, sf_dir):
    """Files that can't be read have a row with their error each, and end nothing."""
    bad = _office(spark, sf_dir, ".docx").withColumn("content", F.expr("substring(content, 1, 20)"))
    return files.read_documents(bad).select("path", F.substring_index("error", ":", 1).alias("error"))


# Orders as raw mails: a customer writes to a clerk, every third mail has an html body and an attachment.
_RAW_SQL = """raw AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS rich, o_orderkey % 5 = 0 AS bulk, o_orderkey % 7 = 0 AS bare, c_name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    head = F.concat(
        F.lit("From: =?utf-8?b?"), F.base64(F.encode("c_name", "utf-8")), F.lit("?= <User@X.Example>\nTo: A <a@corp.example>, b@corp.example\nSubject: Order "), "o_orderpriority", F.lit("\nDate: "), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" -0000\n"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Message-ID: <m"), k, F.lit("@x>\n"))), F.lit("References: <r1> <r2>\n"), F.when(k % 5 == 0, "List-Id: <l>\n").otherwise(""),
    )
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\n\nbody "), k, F.lit("\n"))
    rich = F.concat(F.lit('Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>body '), k, F.lit('</p>\n--b\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="f.pdf"\nContent-Transfer-Encoding: base64\n\nQUJD\n--b--\n'))
    return o.select(k, F.concat(head, F.when(k % 3 == 0, rich).otherwise(plain)).alias("mail"))


@query(
    f"""WITH {_RAW_SQL} SELECT o_orderkey, CASE WHEN bare THEN 'synthetic' ELSE '<m' || o_orderkey || '@x>' END AS message_id, '<r1>' AS thread_id, 'Order ' || o_orderpriority AS subject, 'user@x.example' AS sender, c_name AS sender_name, 'a@corp.example b@corp.example' AS recipients,
day AS date, CASE WHEN rich THEN '<p>body ' || o_orderkey || '</p>' ELSE 'body ' || o_orderkey END AS body, CASE WHEN rich THEN 'f.pdf 3' ELSE '' END AS files, bulk FROM raw"""
)
def q_parse_mail(spark, sf_dir):
    rows = rfc822.parsed(_raw(spark, sf_dir).select(F.encode("mail", "utf-8").alias("content")))
    body = F.trim(F.translate(F.concat("body_text", "body_html"), "\n\r", ""))
    return rows.select(
        F.regexp_extract(body, r"body (\d+)", 1).cast("long").alias("o_orderkey"), F.when(F.col("message_id").startswith("<synthetic-"), "synthetic").otherwise(F.col("message_id")).alias("message_id"), "thread_id", "subject", F.col("sender.email").alias("sender"),
        F.col("sender.name").alias("sender_name"), F.array_join(F.transform("to", lambda a: a["email"]), " ").alias("recipients"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), body.alias("body"),
        F.array_join(F.transform("attachments", lambda a: F.concat_ws(" ", a["filename"], a["size_bytes"])), ",").alias("files"), F.col("is_bulk").alias("bulk"),
    )


@query(f"WITH {_RAW_SQL} SELECT o_orderkey, 'takeout:box' AS folder, 'Order ' || o_orderpriority AS subject, 'Inbox' AS labels FROM raw WHERE o_orderkey % 2 = 0 AND day >= '1995-01-01'")
def q_mbox(spark, sf_dir):
    """Mails as boxes of a hundred; those with a wanted label from a day on, lines that start with From unescaped."""
    root = _folder(spark, "boxes")
    label = F.when(F.col("o_orderkey") % 2 == 0, "X-Gmail-Labels: Inbox\nX-GM-THRID: 7\n").otherwise("X-Gmail-Labels: Spam\n")
    rows = _raw(spark, sf_dir).select((F.col("o_orderkey") % 20).alias("box"), F.concat(F.lit("From x Thu\n"), label, "mail", F.lit("\n>From here\n")).alias("value"))
    rows.repartition("box").write.partitionBy("box").text(root)
    found = rfc822.read_mbox(spark, f"{root}/*/*.txt", ["inbox", "x"], __import__("datetime").datetime(1995, 1, 1))
    key = F.regexp_extract(F.concat("body_text", "body_html"), r"body (\d+)", 1).cast("long")
    return found.select(key.alias("o_orderkey"), F.when(F.col("folder").startswith("takeout:part-"), "takeout:box").otherwise(F.col("folder")).alias("folder"), "subject", F.array_join("labels", ",").alias("labels"))


@query("SELECT 'd' || conv_id || '-' || turn AS message_id, role AS subject, CASE WHEN turn % 2 = 0 THEN '2024-05-06 07:08:09' END AS date, coalesce(text, '') AS body FROM conversations")
def q_dump(spark, sf_dir):
    """Mails as JSON arrays; fields may be missing and dates unreadable."""
    root = _folder(spark, "dump")
    c = table(spark, sf_dir, "conversations")
    one = F.struct(F.concat(F.lit("d"), "conv_id", F.lit("-"), "turn").alias("message_id"), F.col("role").alias("subject"), F.when(F.col("turn") % 2 == 0, "2024-05-06T07:08:09").otherwise("no day").alias("date"), F.coalesce("text", F.lit("")).alias("body_text"))
    part = F.floor(F.monotonically_increasing_id() / DUMP_ROWS)
    parts = c.select(part.alias("part"), one.alias("mail")).groupBy("part").agg(F.to_json(F.collect_list("mail")).alias("value"))
    parts.write.partitionBy("part").text(root)  # a file of its own for each array: a reader takes one from a file
    return rfc822.read_dump(spark, root).select("message_id", "subject", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("body_text").alias("body"))


def _chunks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("pos"), F.col("lang").alias("index_name"), F.concat(F.lit("c"), "doc_id").alias("id"), "text", "source")


@query("SELECT doc_id AS pos, lang AS index_name, 'c' || doc_id AS id, text, source FROM documents WHERE lang IN ('en', 'de', 'fr')")
def q_chunk_table(spark, sf_dir):
    """A table is written, replaced, appended to behind a check of its size, copied, and read from the copy."""
    docs = table(spark, sf_dir, "documents")
    one, two = tables.ChunkTable(spark, _folder(spark, "table")), tables.ChunkTable(spark, _folder(spark, "copy"))
    one.write(_chunks(docs.where("lang = 'es'")), {"model": "x"})
    one.write(_chunks(docs.where("lang = 'en'")), {"model": "x"})
    one.append(_chunks(docs.where("lang = 'de'")), one.open().count(), {"model": "x"})
    one.append(_chunks(docs.where("lang = 'fr'")), signature={"model": "x"})
    one.copy(two)
    return two.open().select("pos", "index_name", "id", "text", "source")


@query("SELECT * FROM (VALUES ('other model', true), ('wrong offset', true), ('good', false)) t(what, refused)")
def q_append_guards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    box = tables.ChunkTable(spark, _folder(spark, "table"))
    box.write(_chunks(docs.where("lang = 'en'")), {"model": "x"})

    def refused(**how) -> bool:
        try:
            box.append(_chunks(docs.where("lang = 'de'")), **how)
        except ValueError:
            return True
        return False

    told = [("other model", refused(signature={"model": "y"})), ("wrong offset", refused(offset=1)), ("good", refused(offset=box.open().count(), signature={"model": "x"}))]
    return spark.createDataFrame(told, "what string, refused boolean")


@query("SELECT 'r' || conv_id || '.md' AS name, content, strlen(content) AS length FROM (SELECT conv_id, '# Conclusions' || chr(10) || string_agg(coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || '# Sources' AS content FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id)")
def q_reports(spark, sf_dir):
    """Reports with all sections are written, listed and read again; the others are refused."""
    root = _folder(spark, "reports")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    ending = F.when(F.col("conv_id") % 2 == 0, "\n# Sources").otherwise("")
    tables.write_reports(rows.select(F.concat(F.lit("../r"), "conv_id").alias("filename"), F.concat(F.lit("# Conclusions\n"), "body", ending).alias("content")), root)
    return tables.list_reports(spark, root).join(tables.read_reports(spark, root), "name")


@query("SELECT query_id, query, expect, coalesce(evidence, '') AS evidence FROM (SELECT item_id AS query_id, text AS query, 'src' || item_id || '|x' AS expect, CASE WHEN item_id % 2 = 0 THEN left(text, 5) END AS evidence FROM benchmark)")
def q_labelled_queries(spark, sf_dir):
    from siltwork.operators import evaluate

    root = _folder(spark, "queries")
    b = table(spark, sf_dir, "benchmark")
    one = F.struct(F.col("item_id").alias("id"), F.col("text").alias("query"), F.array(F.concat(F.lit("src"), "item_id"), F.lit("x")).alias("expect"), F.when(F.col("item_id") % 2 == 0, F.array(F.left("text", F.lit(5)))).alias("evidence"), F.lit("n").alias("note"))
    b.agg(F.to_json(F.collect_list(one)).alias("value")).coalesce(1).write.text(root)
    found = evaluate.load_queries(spark, root)
    return found.join(b.select("item_id", F.col("text").alias("query")), "query").select(F.col("item_id").alias("query_id"), "query", F.array_join("expect", "|").alias("expect"), F.array_join("evidence", "|").alias("evidence"))


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents) SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM t) GROUP BY term")
def q_vocabulary_saved(spark, sf_dir):
    """The vocabulary with its statistics, saved and loaded again."""
    from siltwork.operators import lexical

    path = _folder(spark, "vocabulary")
    lexical.save_vocabulary(table(spark, sf_dir, "documents"), "doc_id", path)
    return lexical.load_vocabulary(spark, path)[0].select("term", "df")


@query(f"WITH {_RAW_SQL} SELECT o_orderkey, '<m' || o_orderkey || '@x>' AS message_id, '_m' || o_orderkey || '_x_/f.pdf' AS saved_path, 'ABC' AS content FROM raw WHERE rich AND NOT bare")
def q_attachments(spark, sf_dir):
    """Attachments as files under their mail's folder, with names that can't leave it."""
    raw = _raw(spark, sf_dir).where("o_orderkey % 7 <> 0").select("o_orderkey", F.encode("mail", "utf-8").alias("content"))
    found = rfc822.attachments(raw, keep=("o_orderkey",))
    return found.select("o_orderkey", "message_id", F.regexp_replace("saved_path", "@", "_").alias("saved_path"), F.decode("content", "utf-8").alias("content"))
