"""Incremental builds and the tools."""

import json

import pytest
from given import SF
from pyspark.sql import functions as F

from siltwork.plans import catalogue, ingest, tools, upkeep
from siltwork.plans.tools import Toolbox
from siltwork.settings import Settings
from siltwork.sources.tables import ChunkTable


def test_ingest(spark, tmp_path):
    root, path = tmp_path / "docs", str(tmp_path / "index")
    root.mkdir()
    (root / "a.md").write_text("one two three")
    (root / "b.md").write_text("one  two THREE")
    (root / "c.md").write_text("  ")
    (root / "d.md").write_text("four five six")
    assert ingest.ingest(spark, str(root), path) == {"new": 4, "changed": 0, "deleted": 0, "unchanged": 0, "without_text": 1}
    table = ChunkTable(spark, f"{path}/chunks")
    assert table.open().count() == 2  # b repeats a
    vectors = {r.text: r.vector for r in table.open().collect()}
    (root / "d.md").write_text("seven eight")
    (root / "c.md").unlink()
    (root / "e.md").write_text("nine")
    assert ingest.ingest(spark, str(root), path) == {"new": 1, "changed": 1, "deleted": 1, "unchanged": 2, "without_text": 0}
    rows = table.open().collect()
    assert {r.text.lower().replace("  ", " ") for r in rows} == {"one two three", "seven eight", "nine"} and len({r.pos for r in rows}) == 3
    assert all(r.vector == vectors[r.text] for r in rows if r.text in vectors)
    version = table._head()["version"]
    assert ingest.ingest(spark, str(root), path)["unchanged"] == 4 and table._head()["version"] == version
    assert ingest.clean(spark, path, ("e.*",)) == 2


def test_mail_index(spark, tmp_path):
    turns, path = catalogue._turns(spark, SF), str(tmp_path / "mail")
    some = turns.where(F.col("thread_id") % 2 == 0)
    first = ingest.index_mails(some, path)
    assert first["new"] > 0 and ingest.index_mails(some, path) == {"new": 0, "stale": 0}
    more = ingest.index_mails(turns, path)
    rows = ChunkTable(spark, f"{path}/chunks").open()
    assert more["new"] > 0 and rows.count() == first["new"] + more["new"] == rows.select("id").distinct().count() == rows.select("pos").distinct().count()
    assert ingest.index_mails(some, path)["stale"] == more["new"]


def test_tools(spark, tmp_path):
    path = str(tmp_path / "mail")
    ingest.index_mails(catalogue._turns(spark, SF), path)
    box = Toolbox(ChunkTable(spark, f"{path}/chunks").open(), catalogue.messages(spark, SF), spark.read.parquet(f"{SF}/pages.parquet"), catalogue.RULES, "user1@argentina.example", {"critic": ("read_url",)})
    assert "[" in box.dispatch("knowledge_search", '{"query": "the and of", "top_n": "many"}')
    assert len(box.dispatch("list_mail", '{"limit": 5}').splitlines()) == 5
    ranked = [int(x.split(" | ")[0]) for x in box.dispatch("list_mail", '{"rank": true, "limit": 7}').splitlines()]
    assert len(ranked) == 7 and ranked == sorted(ranked, reverse=True)
    url = box.pages.first().url
    assert box.dispatch("read_url", f'{{"url": "{url}"}}', "critic").startswith("Content of")
    for name, arguments, role in (("nope", "{}", None), ("read_url", "{", None), ("read_url", "[]", None), ("read_url", '{"x": 1}', None), ("read_url", '{"url": "ftp://x"}', None), ("list_mail", "{}", "critic")):
        assert box.dispatch(name, arguments, role).startswith("ERROR")


def test_reports_and_schemas(spark, tmp_path):
    box = tools.Toolbox(reports=str(tmp_path / "r"))
    assert box.dispatch("list_reports", "{}") == "No reports saved yet." and box.dispatch("read_report", '{"filename": "x"}').startswith("ERROR: x.md not found")
    assert "missing sections" in box.dispatch("write_report", '{"filename": "../x", "content": "# Title"}') and "empty" in box.dispatch("write_report", '{"filename": "x", "content": " "}')
    for text in ("old", "new"):
        assert "x.md" in box.dispatch("write_report", json.dumps({"filename": "../x", "content": f"# Conclusions\n{text}\n# Sources\nend"}))
    assert "x.md" in box.dispatch("list_reports", "") and "new" in box.dispatch("read_report", '{"filename": "a/x"}') and "old" not in box.dispatch("read_report", '{"filename": "x.md"}')
    told = {t["name"]: t["parameters"] for t in tools.Toolbox(chunks=0, messages=0, pages=0, reports="r").schemas()}
    assert len(told) == 7 and told["knowledge_search"]["required"] == ["query"] and told["list_mail"]["properties"]["limit"] == {"type": "integer", "minimum": 1, "maximum": 100, "default": 20}


def test_settings():
    got = Settings.read({"DATA_DIRS": " a, b ,", "RERANK_TOP_N": "7", "PREFLIGHT": "off", "IMPORTANCE_BOOST": " ", "MAIL_DB": "x", "MAIL_TABLE": "y"})
    assert (got.data_dir, got.rerank_top_n, got.preflight, got.importance_boost, got.mail_db) == (("a", "b"), 7, False, 0.0, "x")
    with pytest.raises(ValueError, match="RERANK_TOP_N"):
        Settings.read({"RERANK_TOP_N": "many"})


def test_guard_and_refresh(spark):
    needs = spark.createDataFrame([(3.0, 8.0), (3.0, 8.0)], "need double, available double")
    assert upkeep.guard(needs, Settings()) == "tight" and upkeep.guard(needs.limit(1), Settings()) == "ok" and upkeep.guard(needs.limit(0), Settings()) == "ok"
    much = needs.withColumn("need", F.lit(9.0))
    with pytest.raises(RuntimeError, match="18.0 GiB"):
        upkeep.guard(much, Settings(), lambda q: False)
    assert upkeep.guard(much, Settings(preflight_override=True)) == upkeep.guard(much, Settings(), lambda q: True) == "insufficient" and upkeep.guard(much, Settings(preflight=False)) == "ok"
    mails = spark.createDataFrame([("a", 1, 5), ("a", 1, 9), ("b", 1, 2), ("c", 2, 1)], "folder string, uidvalidity long, uid long")
    state = spark.createDataFrame([("a", 1, 5), ("b", 1, 2), ("c", 1, 7)], "folder string, uidvalidity long, last_uid long")
    done, asked = [], []
    assert upkeep.offer_refresh(mails, state, None, lambda: done.append(1)) == "nobody to ask"
    assert upkeep.offer_refresh(mails.where("folder = 'b'"), state, lambda q: True, lambda: done.append(1)) == "no new mail"
    assert upkeep.offer_refresh(mails, state, lambda q: bool(asked.append(q)), lambda: done.append(1)).endswith(": left") and not done and "1 new (a: 1), 1 folders start anew" in asked[0]
    assert upkeep.offer_refresh(mails, state, lambda q: True, lambda: done.append(1)).endswith(": taken in") and done == [1]
    assert "failed (ZeroDivisionError" in upkeep.offer_refresh(mails, state, lambda q: True, lambda: 1 / 0)


def test_abstract_pages(spark):
    from siltwork.sources import web

    rows = [(1, "https://arxiv.org/abs/1", "<p>short</p>"), (2, "https://arxiv.org/html/1", "<p>" + "long text " * 300 + "</p>"), (3, "http://arxiv.org/abs/2", "x" * 2000), (4, None, None), (5, "ftp://x/y", "x")]
    got = {r.page_id: r for r in web.read_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].fetched, got[1].note) == ("https://arxiv.org/html/1", "") and got[1].text.startswith("long text") and (got[3].fetched, got[3].note) == ("http://arxiv.org/abs/2", "ABSTRACT ONLY")
    assert not got[4].valid and not got[5].valid and got[4].note == "SHORT PAGE" and got[2].valid
