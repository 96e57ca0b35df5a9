"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, hash_limit

#: A word, or what ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
#: A fitting sample of so many documents for each label and so many characters in all, at most about, and so many features,
#: each seen in so many of the sample's documents at least.
SAMPLE, CHARS, FEATURES, SEEN = 4000, 1 << 26, 4096, 5
PREFIXES = (4, 5, 6)
STEPS, RATE, PENALTY = 300, 0.1, 3e-4
#: Rows that a worker returns at once.
ROWS = 500


def features_of(word: str) -> list[str]:
    """The word and the starts of it."""
    return [word, *["^" + word[:n] for n in PREFIXES if len(word) >= n]]


def sentences_of(text: str | None) -> list[list[str]]:
    """Lower-cased words by sentence; sentences without words are left out."""
    out: list[list[str]] = [[]]
    for t in TOKEN.findall(text.lower() if text else ""):
        if t in ".!?\n":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["feature", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
            words = set(TOKEN.findall((text.as_py() or "").lower())) - {".", "!", "?", "\n"}
            found.update((f, toxic) for f in {f for w in words for f in features_of(w)})
        if len(found) > 500_000:
            yield rows()
            found.clear()
    if found:
        yield rows()


def _bags(index: dict[str, int]):
    """toxic, weight, number of sentences, and distinct (sentence, feature) pairs of each document; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, pairs = [], []
            for text in batch["text"]:
                sentences = sentences_of(text.as_py())
                hits = [(k, j) for k, s in enumerate(sentences) for j in {index[f] for w in s for f in features_of(w) if f in index}]
                sizes.append(len(sentences))
                pairs.append(np.array(hits, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch["toxic"], batch["weight"], pa.array(sizes, pa.int32()), pa.array(pairs, pa.binary())], ["toxic", "weight", "sentences", "pairs"])

    return run


class Model:
    """A sentence's logit is the bias plus its features' weights; a document's score is 1 minus the product of 1 - p."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias, self.words = weights, bias, {}

    def word(self, w: str) -> float:
        """A word's weight; kept for up to 200,000 words at a time."""
        got = self.words.get(w)
        if got is None:
            if len(self.words) > 200_000:
                self.words.clear()
            get = self.weights.get
            got = self.words[w] = sum(get(f, 0.0) for f in features_of(w))
        return got

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """p of each sentence with words, in order."""
        tokens = TOKEN.findall(text.lower() if text else "")
        if not tokens:
            return np.zeros(0)
        get, word = self.words.get, self.word
        ends = np.array([t in ".!?\n" for t in tokens])
        value = np.array([0.0 if t in ".!?\n" else (x if (x := get(t)) is not None else word(t)) for t in tokens])
        place = np.cumsum(ends) - ends
        logit = np.bincount(place, value)
        some = np.bincount(place, ~ends) > 0
        return 1 / (1 + np.exp(-(self.bias + logit[some])))

    def score(self, text: str | None) -> float:
        p = self.sentence_scores(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))

    def offending(self, text: str, least: float) -> list[dict]:
        """Spans (start, end, score) of the sentences whose p is at least least."""
        if not text or not (self.sentence_scores(text) >= least).any():
            return []
        out = []
        for m in SENTENCE.finditer(text):
            p = self.sentence_scores(m[0])
            if len(p) and p.max() >= least:
                out.append({"start": m.start(), "end": m.end(), "score": float(p.max())})
        return out


def train(bags: list, features: list[str], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Gradient descent (Adam) on the documents' log loss under noisy-or.

    bags hold toxic (0 or 1), weight, the number of sentences, and pairs: (sentence, feature) as little-endian 32-bit integers.
    A document without sentences, or without known features, counts by its sentences' bias alone. Without bags the
    weights stay 0, and those of weight 0 are left out of the model.
    """
    y = np.array([b["toxic"] for b in bags], float)
    weight = np.array([b["weight"] for b in bags], float)
    weight /= max(weight.sum(), 1e-300)
    total = np.array([b["sentences"] for b in bags], float)
    pairs = [np.frombuffer(b["pairs"], "<i4").reshape(-1, 2) for b in bags]
    size = [len(p) for p in pairs]
    flat = np.concatenate([*pairs, np.zeros((0, 2), "<i4")]).astype(np.int64)
    doc = np.repeat(np.arange(len(bags)), size)
    _, place = np.unique(doc * (1 << 32) + flat[:, 0], return_inverse=True)
    n = int(place.max(initial=-1)) + 1
    owner = np.zeros(n, np.int64)
    owner[place] = doc
    feature = flat[:, 1]
    plain = total - np.bincount(owner, minlength=len(bags))  # sentences without a feature
    w, b = np.zeros(len(features)), -4.0
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(place, w[feature], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-b))
        log_no = np.bincount(owner, np.log1p(-p), minlength=len(bags)) + plain * np.log1p(-p0)
        no = np.exp(log_no)
        # d loss / d z of a sentence is p for a clean document and -p * (1 - P) / P for a toxic one.
        pull = weight * np.where(y > 0, -no / np.maximum(1 - no, 1e-9), 1.0)
        each = pull[owner] * p
        g = np.append(np.bincount(feature, each[place], minlength=len(features)) + penalty * w, each.sum() + (pull * plain).sum() * p0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({f: float(x) for f, x in zip(features, w, strict=True) if x}, float(b))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, chars: int = CHARS, seen: int = SEEN) -> Model:
    """A Model learned from labels(key, toxic) of docs.

    It is fitted on at most about `sample` labelled documents of each label, chosen by the hash of their key, and
    weighed so that the labels keep their shares. Sampled texts of more than chars / 64 characters teach nothing, and of the
    others so many are left out, by hash, that about chars characters remain: what reaches the driver is bounded in bytes. Features are the `features` words and word starts whose document
    frequencies tell the labels apart best, of those in `seen` sampled documents at least. A key with several labels counts as toxic if one says so; null keys,
    null labels and labels without a document teach nothing. With fewer than two labels the model knows nothing and
    its scores are near 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marks = labels.select(F.col(key).alias("key"), F.col(toxic).cast("int").alias("toxic")).where("key is not null and toxic is not null")
    marks = marks.groupBy("key").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, -8.0)
    share = [min(1.0, sample / sizes[k]) for k in (0, 1)]
    limit = F.when(F.col("toxic") == 1, F.lit(hash_limit(share[1]))).otherwise(F.lit(hash_limit(share[0])))
    marks = marks.where(F.shiftrightunsigned(F.xxhash64("key"), 1) <= limit).withColumn("weight", F.when(F.col("toxic") == 1, 1 / share[1]).otherwise(1 / share[0]))
    # About 2 * sample short rows: small enough to broadcast at any size of the corpus.
    bags = scratch.put(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(marks), "key").select("key", "text", "toxic", "weight"), "sample")
    bags = bags.where(F.coalesce(F.length("text"), F.lit(0)) <= chars // 64)
    held = bags.agg(F.sum(F.length("text"))).first()[0] or 0
    if held > chars:
        bags = bags.where(F.shiftrightunsigned(F.xxhash64("key", F.lit("chars")), 1) <= hash_limit(chars / held)).withColumn("weight", F.col("weight") * F.lit(held / chars))
    tally = bags.groupBy("toxic").count().collect()
    n = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in tally}
    counts = bags.select("text", "toxic").mapInArrow(_document_frequencies, "feature string, toxic int, n bigint")
    counts = counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    a, b = F.col("p") / max(n[1], 1), F.col("q") / max(n[0], 1)
    worth = F.abs(a - b) / F.sqrt(a + b + F.lit(1.0 / max(min(n.values()), 1)))
    names = sorted(r["feature"] for r in counts.where(F.col("p") + F.col("q") >= seen).withColumn("worth", worth).orderBy(F.col("worth").desc(), "feature").limit(features).collect())
    rows = bags.drop("key").mapInArrow(_bags({f: k for k, f in enumerate(names)}), "toxic int, weight double, sentences int, pairs binary").collect()
    return train(rows, names)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """One row per input row: the keep columns, score, predicted (1 if score >= 0.5) and offending.

    offending lists (start, end, score) of each sentence whose own score is at least least, in code points of the
    text. A null or empty text, or one without words, has score 0 and no offending sentence. Whole texts are read,
    one at a time; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"kept_{k}" for k in range(len(keep))]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch["text"]]
            bad = [model.offending(t.as_py(), least) if s >= least else [] for s, t in zip(scores, batch["text"], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(bad, spans)], [*names, "score", "predicted", "offending"])

    added = ["score", "predicted", "offending"]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text") + ", score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *added)


def clean_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns.

    A row goes to a worker once, its text in it, and only rows that stay come back, ROWS at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"kept_{k}" for k in range(len(docs.columns))]
    own = text in docs.columns
    at = names[docs.columns.index(text)] if own else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                clean = pa.array([model.score(t.as_py()) < 0.5 for t in some[at]], pa.bool_())
                yield some.select(names).filter(clean)

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *([] if own else [F.col(text).alias("text")]))
    found = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes if n in names))
    return found.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
