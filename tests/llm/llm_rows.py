"""The rows of the odd fixture, and plain ways to cut words and shingles."""

import re

from pyspark.sql import types as T

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Documents with all that operators must bear: nulls in any column, empty and long texts, ties, repeated rows, and columns
#: whose names operators use themselves.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("row", T.StringType()), ("name", T.StringType()), ("score", T.StringType()), ("digest", T.StringType()), ("h", T.StringType()), ("n", T.StringType()))])
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix odd potions in the old stone tower".split()


def long_text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k * 31 + k // 5) % len(WORDS)] + str((k * seed) % 97) for k in range(n))


ROWS = [
    (1, "a b c d e f g h i j", "en", "s1"), (2, "a b c d e f g h i j", "en", "s1"), (2, "a b c d e f g h i j", "en", "s1"), (3, None, None, None), (4, "", "en", None), (5, "   \n", "fr", "s2"), (None, "no id here", None, "s2"),
    (None, None, None, None), (6, long_text(1, 400), "en", "s1"), (7, long_text(1, 400).replace("fox", "FOX") + " tail", "en", "s1"), (8, long_text(2, 6000), "de", "s3"), (9, long_text(2, 6000) + " more", "de", "s3"), (10, "x", None, "s2"),
    (11, "X", "fr", "s2"), (12, "l'été où ça ß 漢字 😀 <|endoftext|> ΑΣ", "fr", "s2"), (13, "z" * 5000, "en", "s1"), (14, long_text(3, 40), "en", "s1"), (15, long_text(3, 40), "en", "S1"),
]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text, width):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
