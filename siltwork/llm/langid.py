"""Language identification by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, hash_limit

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: A fitting sample of so many documents for each language at most, and a table of so many numbers at most.
SAMPLE, TABLE = 4000, 1_000_000
#: So many languages at most are learned, those with most documents.
LANGUAGES = 1000
SMOOTH = 0.5


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, longest: int) -> Iterator[str]:
    padded = f"<{word}>"
    for n in range(1, longest + 1):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def _counts(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], ["lang", "token", "word", "n"])

        found: Counter = Counter()
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in by.items():
                for w, n in words.items():
                    found[lang, w, True] += n
                    for g in grams_of(w, longest):
                        found[lang, g, False] += n
            if len(found) > 500_000:
                yield rows()
                found.clear()
        if found:
            yield rows()

    return run


class Model:
    """Log frequencies by language of known words and of character n-grams."""

    def __init__(self, langs: list[str], words: dict[str, int], word_logs: np.ndarray, grams: dict[str, int], gram_logs: np.ndarray, longest: int) -> None:
        self.langs, self.words, self.word_logs, self.grams, self.gram_logs, self.longest = langs, words, word_logs, grams, gram_logs, longest

    @classmethod
    def of(cls, rows: list, langs: list[str], longest: int) -> Model:
        """rows: (token, word, {lang: n}, total by lang)."""
        tables = []
        for word in (True, False):
            own = sorted((r for r in rows if r["word"] == word), key=lambda r: r["token"])
            at = {lang: k for k, lang in enumerate(langs)}
            table = np.zeros((len(own), len(langs)))
            for i, r in enumerate(own):
                for lang, n in r["by"].items():
                    table[i, at[lang]] = n
            logs = np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * (len(own) + 1)))
            tables += [{r["token"]: i for i, r in enumerate(own)}, logs.astype(np.float32)]
        return cls(langs, *tables, longest)

    def backoff(self, word: str, rows: list[int], weights: list[float]) -> None:
        """For each place of an unseen word the longest known n-gram that ends there; a word weighs 1 in all."""
        padded, grams, found = f"<{word}>", self.grams, []
        for end in range(1, len(padded) + 1):
            for n in range(min(self.longest, end), 0, -1):
                if (row := grams.get(padded[end - n : end])) is not None:
                    found.append(row)
                    break
        rows += found
        weights += [1 / len(found)] * len(found) if found else []

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        get = self.words.get
        at = np.array([get(w, -1) for w in words])
        total = self.word_logs[at[at >= 0]].sum(0, dtype=np.float64)
        rows: list[int] = []
        weights: list[float] = []
        for i in np.flatnonzero(at < 0).tolist():
            self.backoff(words[i], rows, weights)
        if rows:
            total = total + np.asarray(weights) @ self.gram_logs[rows]
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, table: int = TABLE, longest: int = LONGEST, languages: int = LANGUAGES) -> Model:
    """A Model learned from the labelled rows of docs.

    It is fitted on at most about `sample` documents a language, chosen by the hash of their key and text, and on at most
    `languages` languages, those with most documents (of equal ones the first in order). It keeps the most frequent words (seen twice at least) and n-grams: for each kind at most table / languages. So neither
    what is collected nor what is broadcast grows with the corpus. Null languages, null texts and texts without
    letters teach nothing; without any labelled row the model knows no language.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    tally = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.col("docs").desc(), "lang").limit(languages)
    sizes = {r["lang"]: r["docs"] for r in tally.collect()}
    if not sizes:
        return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32), longest)
    langs = sorted(sizes)
    shares = docs.sparkSession.createDataFrame([(name, hash_limit(sample / sizes[name])) for name in langs], "lang string, share long")
    chosen = known.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned(F.xxhash64("key", "text"), 1) <= F.col("share"))
    counts = chosen.select("lang", "text").mapInArrow(_counts(longest), "lang string, token string, word boolean, n bigint")
    counts = counts.groupBy("word", "token", "lang").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("word", "token").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("total"))
    counts = scratch.put(counts.where("not word or total > 1"), "counts")
    most = max(1, table // len(langs))
    rows = [r for word in (True, False) for r in counts.where(F.col("word") == word).orderBy(F.col("total").desc(), "token").limit(most).collect()]
    return Model.of(rows, langs, longest)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the keep columns, lang_pred and score.

    A word the model knows adds its log frequency in each language; for an unseen word every place adds the longest
    known n-gram (of four characters at most) that ends there, so that the word weighs as much as one known word.
    score is the softmax share of the best language; the first in order wins a tie. A null or empty text, or one
    without letters, is `und` with score 0. Whole texts are read, one at a time; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"kept_{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text") + ", lang_pred string, score double"
    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "lang_pred", "score")
