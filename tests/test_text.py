"""Golden cases of the text and mail functions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.functions.mail import clean_body
from siltwork.operators import chunking, logs


def one(spark, column, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("v"))).collect()]


def test_tokens_and_keys(spark):
    texts = ["Hello, wörld_1! Été 42", "Статут ТОВ 2020", "한국어 テスト", "", "a b"]
    assert one(spark, T.tokenize, *texts) == [re.findall(r"\w+", t.lower()) for t in texts]
    spaced = ["A  b\n\tC", " a b c ", "a b c", "", "ß x"]
    assert one(spark, T.text_key, *spaced) == [hashlib.sha256(" ".join(t.split()).lower().encode()).hexdigest() for t in spaced]


def test_subject_lang_script(spark):
    assert one(spark, T.normalize_subject, "Re: Fwd[2]: RE : Panels", "АВ: x", "Відп: Пересил: y ", "regards: z", None, "답장: q") == ["Panels", "АВ: x", "y", "regards: z", "", "q"]
    assert one(spark, T.detect_lang, "привіт світ", "привет мир", "hello", "안녕하세요", "hello привет", "123", "") == ["uk", "ru", "en", "ko", "mixed", "", ""]
    assert one(spark, T.script_of, "привіт", "hello", "안녕", "漢字漢", "カナ", "12", "ab пр") == ["cyrillic", "latin", "hangul", "han", "kana", "latin", "cyrillic"]
    assert one(spark, lambda c: T.unsupported_script(T.script_of(c)).isNull(), "hello", "안녕") == [True, False]


def test_html(spark):
    html = "<head><title>t</title></head><p>a&amp;lt;b</p><br/>x<td>1</td><td>2</td>\n\n\n\n<style>p{}</style>end&nbsp;"
    assert one(spark, T.html_to_text, html, None, "<b>q</b>") == ["a<b\n\nx1\t2\n\n end", "", "q"]


def test_names_and_globs(spark):
    assert one(spark, T.attachment_folder, "<a/b@c.d>", "x" * 100) == ["_a_b_c.d_", "x" * 80]
    assert one(spark, T.safe_name, "../../.ssh/keys", "a\\b.txt", "", " .. ", "q?*.pdf", "y" * 200) == ["ssh/keys".split("/")[1], "a_b.txt", "attachment", "attachment", "q__.pdf", "y" * 150]
    assert one(spark, T.report_name, "x/y", "", "z.md", None) == ["y.md", "report.md", "z.md", "report.md"]
    globs = ["~$*", "*.key", "id_rsa*", "[ab]?.txt", "[!x]y"]
    assert one(spark, lambda c: T.matches_glob(c, globs), "~$doc", "A.KEY", "my.key.txt", "id_rsa.pub", "b1.txt", "c1.txt", "xy", "zy", None) == [True, True, False, True, True, False, False, True, False]
    rx = lambda p: lambda c: F.coalesce(c.rlike(T.address_regex(p)), F.lit(False))
    who = ["a@corp.com", "a@x.corp.com", "a@notcorp.com", "boss@gov.ua"]
    assert one(spark, rx("corp.com"), *who) == [True, True, False, False] and one(spark, rx("*@gov.ua"), *who)[3] and one(spark, rx("*.corp.com"), *who) == [False, True, False, False]
    stem = lambda p: lambda c: c.rlike(T.stem_regex(p))
    assert one(spark, stem("test"), "latest", "Testing it", "a test") == [False, True, True] and one(spark, stem("заборгован"), "Ваша Заборгованості") == [True]
    assert one(spark, T.missing_sections, "# 1. Conclusions\n## Sources", "# Висновки", "") == [[], ["Sources"], ["Conclusions", "Sources"]]


def test_small_columns(spark):
    assert one(spark, lambda c: T.truncate(c, 3), "abc", "abcd") == ["abc", "abc\n\n[... truncated, 4 characters in total]"]
    assert one(spark, lambda c: T.clamp(c, 1, 10, 5), "3", "99", "-4", "x", None) == [3, 10, 1, 5, 5]
    assert one(spark, lambda c: T.carry_tail(c, 5), "ab cd", "hello world", "nospacehere", "x y zz", "") == ["ab cd", "", "", "y zz", ""]
    assert one(spark, lambda c: T.thread_root(F.lit(""), F.split(c, " "), F.lit("r"), F.lit("m")), "a b") == ["a"]
    bulk = spark.createDataFrame([(None, "l", None, "x", None), (None, None, None, " Bulk ", None), (None, None, None, None, "no"), (None, None, None, None, "auto"), (None,) * 5], "a string, b string, c string, d string, e string")
    assert [r[0] for r in bulk.select(T.is_bulk(*[F.col(c) for c in "abcde"])).collect()] == [True, True, False, True, False]


BODY = "EXTERNAL EMAIL: beware\nHello\n> old\nsecond\n\n\n\nthird\n-- \nAnn\nOn Monday, 3 May 2021, Bob wrote:\n> quoted\ntext below"


def test_clean_body(spark):
    cases = [BODY, "From: a\nstays", "Hi\nBest regards,\nX", None, "one\r\nDISCLAIMER: all\r\nmore", "Regards\n" + "\n".join(f"line {k}" for k in range(20)), "Привіт\nЗ повагою\nЯ", "text\nSent from my iPhone\n[cid:1]"]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, body string")
    got = [tuple(r)[1:] for r in clean_body(rows, "body", ("k",)).orderBy("k").collect()]
    header = "On Monday, 3 May 2021, Bob wrote:"
    assert got[0] == ("Hello\nsecond\n\nthird", len(header) + len("> quoted") + len("text below") + len("> old"), True, False)
    assert got[1][0] == "From: a\nstays" and got[2] == ("Hi", 0, True, False) and got[3] == ("", 0, False, False) and got[4] == ("one", 0, False, True)
    assert got[5][0].startswith("Regards") and got[6] == ("Привіт", 0, True, False) and got[7][0] == "text"


def test_splitter():
    assert [len(c) for c in chunking.split_text("x" * 900)] == [500, 500, 100]
    assert chunking.split_text("  short ") == ["short"] and chunking.split_text("   ") == []
    assert chunking.split_text("aaa bbb ccc ddd", 7, 0) == ["aaa bbb", "ccc ddd"]
    assert chunking.split_text("aaa bbb ccc ddd", 7, 4) == ["aaa bbb", "bbb ccc ddd"]
    assert chunking.split_text("one. two. three", 8, 0) == ["one. two", "three"]
    assert chunking.split_text("p1 a\n\np2 b c d e f", 8, 0) == ["p1 a", "p2 b c d", "e f"]
    assert chunking.tail_of("ab cd ef", 4) == "ef" and chunking.tail_of("abcdef", 3) == "" and chunking.tail_of("ab", 9) == "ab"


@pytest.mark.parametrize("size", [20, 50, 500])
def test_splitter_keeps_all_words(size):
    text = "\n\n".join(". ".join(" ".join(f"w{(a * b * c) % 97}" for c in range(9)) for b in range(5)) for a in range(12))
    words = [w.strip(".") for c in chunking.split_text(text, size, 0) for w in c.split()]
    assert words == [w.strip(".") for w in text.split()]


def test_packer(spark):
    def packed(text, most, overlap=0):
        return spark.createDataFrame([(text,)], "t string").select(chunking.packed_paragraphs(F.col("t"), most, overlap).alias("p")).first().p

    assert packed("a\n\nb", 10) == ["a\n\nb"] and packed(None, 10) == packed("", 10) == [""]
    assert packed("aaaa\n\nbbbb\n\ncccc", 10, 2) == ["aaaa\n\nbbbb", "bb\n\ncccc"]
    assert packed("x" * 30 + "\n\ny", 10, 3) == ["x" * 30, "xxx\n\ny"]


def test_records_and_lines(spark):
    from siltwork.schema import CRITIQUE

    good = '{"verdict": "REVISE", "is_fresh": true, "is_complete": false, "is_well_structured": true, "strengths": [], "gaps": ["g"], "revision_requests": []}'
    rows = spark.createDataFrame([(0, good), (1, good.replace("REVISE", "MAYBE")), (2, "not json"), (3, "{}")], "k int, v string")
    record, problems = logs.parse_record(F.col("v"), CRITIQUE, {"verdict": ("APPROVE", "REVISE")})
    got = [tuple(r) for r in rows.orderBy("k").select(record.isNotNull(), problems).collect()]
    assert got[0] == (True, []) and got[1] == (False, ["verdict: MAYBE is not one of APPROVE, REVISE"]) and got[2] == (False, ["not JSON"]) and len(got[3][1]) == 6
    meta = one(spark, logs.meta, '12 (X-GM-THRID 99 X-GM-LABELS ("\\\\Inbox" work) UID 7 RFC822')[0]
    assert meta["uid"] == 7 and meta["thread_id"] == "99" and "work" in meta["labels"]
    lines = spark.createDataFrame([('(\\HasNoChildren \\Sent) "/" "[Gmail]/Sent Mail"',), ('(\\All) "/" INBOX',), ("bad",)], "value string")
    known = logs.folders(lines)
    assert {r.name for r in known.collect()} == {"[Gmail]/Sent Mail", "INBOX"}
    wanted = spark.createDataFrame([("\\sent",), ("Own",), ("\\Junk",)], "item string")
    assert {r.item: r.name for r in logs.resolve_folders(wanted, known).collect()} == {"\\sent": "[Gmail]/Sent Mail", "Own": "Own", "\\Junk": None}
    log = spark.createDataFrame([(f"[2024-01-01 10:00:{s:02}] POST /v1/embeddings 200",) for s in (0, 10, 20)] + [("GET /",)], "value string")
    assert tuple(logs.request_rate(log, "2024-01-01 10:00:05").first()) == (2, 128, 12.8)
