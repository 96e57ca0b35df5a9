"""Files, mails, tables and streams."""

import io
import zipfile
from datetime import datetime

import pytest
from given import SF, Box
from pyspark.sql import functions as F

from siltwork.adapters import HashEmbedder, check_compatible, resolve_ocr
from siltwork.operators import dedup, fusion, mail
from siltwork.operators.retrieve import Filters, Retriever
from siltwork.sources import files, rfc822, tables, web
from siltwork.streaming import ingest


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOCX = zipped(word__document_dot_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", docProps__core_dot_xml='<c><dcterms:created x="y">2020-02-03T00:00:00Z</dcterms:created></c>')
ROWS = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("AB", cells, strict=True) if v) + "</row>" for r, cells in ((2, ("Amount", "Date")), (4, ("12", "May")), (5, ("", "June"))))
XLSX = zipped(xl__workbook_dot_xml=f'<workbook {X} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Pay" r:id="r1"/></sheets></workbook>', xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', xl__worksheets__s_dot_xml=f"<worksheet {X}><sheetData>{ROWS}</sheetData></worksheet>")
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = zipped(ppt__slides__slide1_dot_xml=f"<s {A}><a:p><a:r><a:t>Title</a:t></a:r></a:p></s>", ppt__notesSlides__notesSlide1_dot_xml=f"<s {A}><a:p><a:r><a:t>say it</a:t></a:r></a:p></s>")


def test_office_readers():
    assert files.read_docx(DOCX) == [("Hi\na | b", 1)]
    assert files.read_xlsx(XLSX) == [("Sheet: Pay\nAmount | Date\nAmount: 12; Date: May\nDate: June", 1)]
    assert files.read_pptx(PPTX) == [("Title\nNotes: say it", 1)]
    assert files.sheet_lines("t", iter([["h"], *[[]] * 5, ["v"]]), blank_run=3) == ["Sheet: t", "h"]


def test_discover(spark, tmp_path):
    for name, data in {"a.md": b"# t\xff", "sub/b.docx": DOCX, ".git/x.md": b"x", "node_modules/y.md": b"y", "~$a.docx": b"z", "bad.xlsx": b"no zip", "c.bin": b"0", ".hidden.md": b"h"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = files.digested(files.discover(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1] for r in found.select("path").collect()} == {"a.md", "b.docx", "bad.xlsx"}
    assert [r.name for r in files.skipped(spark, str(tmp_path)).collect()] == ["~$a.docx"]
    pages = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_documents(found).collect()}
    assert pages["a.md"] == ("# t�", None) and pages["b.docx"][0] == "Hi\na | b" and pages["bad.xlsx"][1].startswith("BadZipFile")
    dates = {r.path.rsplit("/", 1)[1]: (r.date, r.date_source) for r in files.dated(found).collect()}
    assert dates["b.docx"] == ("2020-02-03", "document") and dates["a.md"][1] == "filesystem"


MAIL = b"""Message-ID: <1@x>\nDate: Mon, 03 May 2021 10:00:00\nFrom: =?utf-8?B?0JDQvdC90LA=?= <Anna@X.com>\nTo: b@y.com, "C, D" <c@z.com>\nSubject: =?utf-8?q?Caf=C3=A9?=\nReferences: <0@x> <q@x>\nX-Gmail-Labels: Inbox,Work\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain; charset=utf-8\n\nhello\n--B\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="f.pdf"\n\nxx\n--B--\n"""
PLAIN = b"From: l@m.com\nList-Id: <l>\nDate: broken\nSubject: s\n\nbody text\n"


def test_mail_parsing(spark, tmp_path):
    m = rfc822.parse(MAIL)
    assert m["thread_id"] == "<0@x>" and m["sender"] == {"email": "anna@x.com", "name": "Анна"} and m["subject"] == "Café" and m["to"][1] == {"email": "c@z.com", "name": "C, D"}
    assert m["body_text"].strip() == "hello" and m["attachments"][0]["filename"] == "f.pdf" and not m["is_bulk"] and m["date"] == datetime(2021, 5, 3, 10)
    p = rfc822.parse(PLAIN)
    assert p["is_bulk"] and p["date"] is None and p["message_id"] == rfc822.parse(PLAIN)["message_id"] and p["body_text"] == "body text\n"
    assert rfc822.decode_folder("&BB4EQgQ,BEAEMAQyBDsENQQ9BD0ESwQ1- &- x") == "Отправленные & x"
    (tmp_path / "box.mbox").write_bytes(b"From a Mon\n" + MAIL + b"\nFrom b Mon\n" + PLAIN)
    box = rfc822.read_mbox(spark, str(tmp_path / "box.mbox"))
    assert [(r.folder, r.uid, r.subject) for r in box.orderBy("uid").collect()] == [("takeout:box", 1, "Café"), ("takeout:box", 2, "s")]
    assert rfc822.read_mbox(spark, str(tmp_path / "box.mbox"), ["work"]).count() == 1 and rfc822.read_mbox(spark, str(tmp_path / "box.mbox"), since=datetime(2022, 1, 1)).count() == 1
    (tmp_path / "dump.json").write_text('[{"message_id": "a", "date": "2021-05-03T10:00:00"}, {"message_id": "b", "date": "never", "labels": ["x"]}]')
    assert [(r.message_id, r.date) for r in rfc822.read_dump(spark, str(tmp_path / "dump.json")).orderBy("message_id").collect()] == [("a", datetime(2021, 5, 3, 10)), ("b", None)]
    raw = rfc822.parsed(spark.createDataFrame([(bytearray(MAIL),), (bytearray(PLAIN),)], "content binary"))
    clean = mail.preprocess(raw, ("message_id",)).collect()
    assert {r.clean_subject for r in clean} == {"Café", "s"} and {r.lang for r in clean} == {"en"}


def test_chunk_table(spark, tmp_path):
    table = tables.ChunkTable(spark, str(tmp_path / "t"))
    emb = HashEmbedder(16)
    rows = spark.createDataFrame([("m", k, f"c{k}", f"text number {k} of {'invoices' if k % 2 else 'panels'}", f"doc{k % 3}", k % 2 and "a@b.com" or None) for k in range(6)], "index_name string, pos long, id string, text string, source string, sender_email string")
    assert not table.exists() and table.open().count() == 0
    table.write(rows.withColumn("vector", emb.column(F.col("text"))), emb.signature())
    with pytest.raises(ValueError, match="rows"):
        table.append(rows, offset=5)
    with pytest.raises(ValueError, match="other embeddings"):
        table.append(rows, signature={"dim": "3"})
    more = spark.createDataFrame([("n", 0, "d0", "invoices of may", "doc9", None)], "index_name string, pos long, id string, text string, source string, sender_email string")
    table.append(more.withColumn("vector", emb.column(F.col("text"))), 6, emb.signature())
    assert table.open().count() == 7 and table.copy(tables.ChunkTable(spark, str(tmp_path / "u"))) == 7
    hits = Retriever(table.open(), emb).search("invoices of may").collect()
    assert hits[0].id == "d0" and hits[0].in_bm25 and hits[0].in_semantic and hits[0].kind == "document" and not hits[0].weak
    only = Retriever(table.open(), emb).search("invoices", Filters(source="DOC1"), rerank=False).collect()
    assert {h.source for h in only} == {"doc1"} and [h.score for h in only] == [round(1 / h.rank, 4) for h in only]
    check_compatible(None, emb.signature())
    assert resolve_ocr("auto", {"tesseract"}) == "tesseract" and resolve_ocr("vision", set()) == "off"


def test_state_and_reports(spark):
    state = spark.createDataFrame([("a", 1, 5)], ingest.STATE)
    mails = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 7, "y"), ("b", 2, 1, "z")], ingest.MAIL)
    assert {r.rfc_message_id for r in ingest.fresh(mails, state).collect()} == {"y", "z"} and ingest.fresh(mails, state, True).count() == 3
    changed = spark.createDataFrame([("a", 9, 2, "q")], ingest.MAIL)
    assert {tuple(r) for r in ingest.advanced(state, mails).collect()} == {("a", 1, 7), ("b", 2, 1)} and {tuple(r) for r in ingest.advanced(state, changed).collect()} == {("a", 9, 2)}
    assert ingest.fresh(changed, state).count() == 1
    assert [tuple(r) for r in tables.state_of(spark.createDataFrame([("a",), ("z",)], "folder string"), state).orderBy("folder").collect()] == [("a", 1, 5), ("z", None, 0)]
    reports = spark.createDataFrame([("x/y", "# Conclusions\n# Sources"), ("", " "), ("r", "# Sources")], "filename string, content string")
    assert [(r.name, r.error) for r in tables.checked_reports(reports).collect()] == [("y.md", ""), ("report.md", "refusing to write an empty report"), ("r.md", "missing sections: Conclusions")]


def test_mailbox_batches_repeat_safely(spark, tmp_path):
    box = ingest.Mailbox(spark, str(tmp_path / "box"))
    first = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 3, "x")], ingest.MAIL)
    box.take(first, 0)
    assert box.mails().count() == 2 and {tuple(r) for r in box.state().collect()} == {("a", 1, 2)}
    box.take(spark.createDataFrame([("b", 1, 9, "y"), ("b", 1, 10, "w")], ingest.MAIL), 1)
    assert {r.rfc_message_id for r in box.mails().collect()} == {"x", "y", "w"}
    for _ in range(2):  # a batch that is taken again, as after a crash, replaces itself
        box.take(first, 0)
        box.take(spark.createDataFrame([("b", 1, 9, "y"), ("b", 1, 10, "w")], ingest.MAIL), 1)
        assert sorted(r.rfc_message_id for r in box.mails().collect()) == ["w", "x", "y"]
    late = spark.createDataFrame([("b", 1, 3, "late"), ("b", 1, 11, "new"), ("c", 1, 1, "other")], ingest.MAIL)
    box.take(late, 2, above=True)
    assert {r.rfc_message_id for r in box.mails().collect()} == {"x", "y", "w", "new", "other"}
    box.take(late, 3, above=True, backfill=True)
    assert {r.rfc_message_id for r in box.mails().collect()} == {"x", "y", "w", "new", "other", "late"}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """A batch whose commit is lost runs again and changes nothing; later files are taken by the next run."""
    import glob
    import os

    def follow():
        stream = spark.readStream.schema(ingest.MAIL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.Mailbox(spark, f"{tmp_path}/box").follow(stream, f"{tmp_path}/state").awaitTermination()
        return sorted(r.rfc_message_id for r in ingest.Mailbox(spark, f"{tmp_path}/box").mails().collect())

    for k, keys in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([("f", 1, 10 * k + j, x) for j, x in enumerate(keys)], ingest.MAIL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert follow() == ["a", "b", "c"]
    last = max(glob.glob(f"{tmp_path}/state/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
    os.remove(last)
    for crc in glob.glob(f"{tmp_path}/state/commits/.*.crc"):
        os.remove(crc)
    assert follow() == ["a", "b", "c"]
    spark.createDataFrame([("f", 1, 50, "d"), ("f", 1, 51, "a")], ingest.MAIL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert follow() == ["a", "b", "c", "d"]


def test_mail_server_offsets():
    reader = rfc822._Reader(Box, {"n": "7", "batch": "3"})
    end = reader.latestOffset()
    parts = lambda start, stop: [(p.folder, p.validity, p.first, p.last) for p in reader.partitions(start, stop)]
    assert end == {"INBOX": [1, 7]} and parts(reader.initialOffset(), end) == [("INBOX", 1, 1, 3), ("INBOX", 1, 4, 6), ("INBOX", 1, 7, 7)]
    assert parts({"INBOX": [1, 5]}, end) == [("INBOX", 1, 6, 7)] and parts(end, end) == [] and parts({"INBOX": [9, 6]}, end)[0] == ("INBOX", 1, 1, 3)
    assert [r[2] for p in reader.partitions({}, end) for r in reader.read(p)] == [1, 2, 3, 5, 6, 7]


def test_mail_server(spark, tmp_path):
    """Batch and stream; the stream goes on where it stopped."""
    spark.dataSource.register(rfc822.MailServer)
    source = lambda r, n: r.format("mailserver").option("box", "given:Box").option("n", n).option("batch", "2")
    rows = source(spark.read, 5).load()
    assert sorted(r.uid for r in rows.select("uid").collect()) == [1, 2, 3, 5] and rfc822.parsed(rows).count() == 4
    assert sorted(r.uid for r in source(spark.read, 5).option("since_uid", "2").load().collect()) == [3, 5]
    for n, want in ((3, 3), (6, 5)):
        stream = source(spark.readStream, n).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == want


class Imap:
    """What ImapBox asks of a server."""

    def __init__(self, host, port):
        self.asked = []

    def login(self, user, password):
        pass

    def status(self, name, what):
        return ("OK", [name.encode() + b" (UIDVALIDITY 9 UIDNEXT 12)"]) if name == '"INBOX"' else ("NO", [None])

    def select(self, name, readonly):
        self.asked.append(name)

    def uid(self, command, *args):
        self.asked.append((command, *args))
        return ("OK", [b"3 5"]) if command == "SEARCH" else ("OK", [(b"1 (UID 3 RFC822 {5}", b"three"), b")", (b"2 (UID 5 RFC822 {4}", b"five"), b")"])

    def logout(self):
        self.asked.append("bye")


def test_imap_box(monkeypatch):
    import imaplib

    monkeypatch.setattr(imaplib, "IMAP4_SSL", Imap)
    box = rfc822.ImapBox({"host": "h", "user": "u", "password": "p", "folders": "INBOX, none", "since": "1-Jan-2024"})
    assert list(box.folders()) == [("INBOX", 9, 11)] and list(box.fetch("INBOX", 3, 8)) == [(3, b"three"), (5, b"five")]
    box.close()
    assert box.server.asked == ['"INBOX"', ("SEARCH", None, "UID 3:8", "SINCE", "1-Jan-2024"), ("FETCH", "3,5", "(UID RFC822)"), "bye"]


def test_attachment_files(spark, tmp_path):
    parts = b"From: a@b\nMessage-ID: <../../m@x>\nContent-Type: multipart/mixed; boundary=b\n\n" + b"".join(b'--b\nContent-Type: text/x\nContent-Disposition: attachment; filename="../../e.txt"\n\nbody%d\n' % k for k in (1, 2)) + b"--b--\n"
    rows = spark.createDataFrame([(1, MAIL), (2, parts), (3, None), (4, b"")], "k long, content binary")
    found = rfc822.attachments(rows, keep=("k",))
    done = sorted((r.saved_path, r.size_bytes) for r in rfc822.save_attachments(found.where("k = 2"), str(tmp_path)).collect())
    assert done == [("_.._.._m_x_/1-e.txt", 5), ("_.._.._m_x_/e.txt", 5)]
    assert (tmp_path / "_.._.._m_x_" / "e.txt").read_bytes() == b"body1" and len(list(tmp_path.rglob("*.txt"))) == 2


def test_small_plans(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    query = spark.createDataFrame([(1, "the of and")], "query_id long, query string")
    assert web.search(pages, query, 99).count() <= 10
    assert fusion.rerank_threshold(1.0, 0.0) == 0.15 and fusion.rerank_threshold(0.0, 1.0) == 0.02 and fusion.rerank_threshold(1, 0, 0.5) == 0.5
    rows = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "pos long, text string")
    kept = dedup.collapse_duplicates(rows, "pos")
    assert sorted((r.pos, r.copies) for r in kept.collect()) == [(1, 2), (3, 1)] and sorted(r.pos for r in dedup.collapse_duplicates(kept.drop("copies", "text_key"), "pos").collect()) == [1, 3]
    with pytest.raises(ValueError, match="nothing"):
        dedup.clean_index(rows.withColumn("source", F.lit("x.key")), ("*.key",), "pos")


@pytest.mark.parametrize("splits", [0, 1000])
def test_mbox_in_splits(spark, tmp_path, monkeypatch, splits):
    """One file read in many splits gives the same mails and places as its text says; bytes of any charset stay."""
    monkeypatch.setattr(rfc822, "SPLITS", splits)
    mails = [b"From x Thu\nMessage-ID: <%d@x>\nContent-Type: text/plain; charset=latin-1\n\nbody %d \xe9\n>From here\n%s\n" % (k, k, b"y" * (k * 37 % 900)) for k in range(300)]
    (tmp_path / "box.mbox").write_bytes(b"".join(mails))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = sorted((r.uid, r.message_id, r.body_text.split("\n")[:2]) for r in rfc822.read_mbox(spark, str(tmp_path / "box.mbox")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k + 1, f"<{k}@x>", [f"body {k} é", "From here"]) for k in range(300)]


def test_odd_vectors(spark):
    """Vectors with nulls, NaN or another length meet no query and end nothing."""
    from siltwork.operators import dense

    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [float("nan"), 1.0]), (4, None), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (2, [0.5, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in dense.dense_topk(v, v.where("vec_id in (1, 3, 6)"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 0.5), (1, 3, 2, 0.5), (6, 1, 6, 14.0)]
    assert dense.dense_topk(v.limit(0), v, 3).count() == dense.dense_topk(v, v.limit(0), 3).count() == 0
    parts = dense.dense_topk(v.withColumn("p", F.when(F.col("vec_id") == 1, "a").otherwise("b")), v.where("vec_id = 1"), 1, by="p").collect()
    assert sorted((r.p, r.vec_id, r["rank"]) for r in parts) == [("a", 1, 1), ("b", 2, 1)]


def test_dump_keeps_every_array(spark, tmp_path, monkeypatch):
    """Arrays that one task writes don't share a file, and a mail without an id stays."""
    from siltwork.plans import catalogue_files

    monkeypatch.setattr(catalogue_files, "DUMP_ROWS", 3)
    rows = [(None if k == 7 else k // 5, k, "user", f"t{k}") for k in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.message_id, r.body) for r in catalogue_files.q_dump(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((f"d{c}-{t}" if c is not None else None, x) for c, t, _, x in rows), key=str)


def test_mails_are_read_once(spark, tmp_path, monkeypatch):
    """A mail of a box or with attachments goes through the mail parser once; one of a single part has none."""
    import email

    rich = b'Message-ID: <r@x>\nContent-Type: multipart/mixed; boundary="b"\n\n--b\n\nhi\n--b\nContent-Disposition: attachment; filename="f"\n\nABC\n--b--\n'
    read, plain = [], email.message_from_bytes
    monkeypatch.setattr(email, "message_from_bytes", lambda raw: read.append(raw) or plain(raw))
    mail = rfc822._message(rich)
    assert rfc822._parsed(mail)["attachments"][0]["size_bytes"] == 3 and read == [rich]
    raw = spark.createDataFrame([(1, rich), (2, b"Message-ID: <p@x>\nContent-Disposition: attachment\n\nx\n"), (3, None)], "k int, content binary")
    assert [(r.k, r.filename, bytes(r.content)) for r in rfc822.attachments(raw, keep=("k",)).collect()] == [(1, "f", b"ABC")]


def test_pages_without_a_full_text_are_not_shuffled(spark):
    """Only abstract pages are joined; all others have no key and would meet in one task."""
    rows = [(k, f"https://x.example/{k}", "<p>x</p>") for k in range(9)] + [(10, "https://arxiv.org/abs/1", "<p>short</p>"), (11, "https://arxiv.org/html/1", "<p>full</p>"), (12, None, None), (13, "https://arxiv.org/abs/2", "<p>own</p>")]
    found = web.read_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: (r.fetched, r.note, r.text) for r in found.collect()}
    assert len(got) == 13 and got[10] == ("https://arxiv.org/html/1", "SHORT PAGE", "full") and got[13] == ("https://arxiv.org/abs/2", "ABSTRACT ONLY", "own") and got[12][1] == "SHORT PAGE"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnotnull") >= 1 and plan.lstrip().split("\n")[0].startswith("Union")
