"""Texts as chunks: the recursive splitter with word-aligned overlap, and the paragraph packer of mails."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions.text import chunk_id


def tail_of(previous: str, overlap: int) -> str:
    """What a chunk hands to the next: its last characters from the first whole word on."""
    if overlap <= 0:
        return ""
    if len(previous) <= overlap:
        return previous.strip()
    _, space, rest = previous[-overlap:].partition(" ")
    return rest.strip() if space else ""


def _ends(text: str, mark: str) -> list[int]:
    """Where the parts between marks end."""
    return [*(m.start() for m in re.finditer(re.escape(mark), text)), len(text)]


def _spans(text: str, mark: str, size: int) -> Iterator[tuple[int, int]]:
    """Spans of text that start and end at marks and are as long as size allows; a part beyond size is a span by itself."""
    ends, k, begin = _ends(text, mark), 0, 0
    while k < len(ends):
        fit = bisect.bisect_right(ends, begin + size) - 1
        last = k if ends[k] == begin else max(k, fit)  # a span never starts with an empty part
        if ends[last] > begin:
            yield begin, ends[last]
        begin, k = ends[last] + len(mark), last + 1


def split_text(text: str, size: int = schema.CHUNK_SIZE, overlap: int = schema.CHUNK_OVERLAP) -> list[str]:
    """Chunks of about size characters, cut at the coarsest separator that the text has; pieces still too long are cut anew.

    Overlap is added at each level, so a chunk may be longer than size.
    """
    text = text.strip()
    mark = next((m for m in schema.SEPARATORS if m and m in text), None)
    if len(text) <= size:
        return [text] * bool(text)
    if mark is None:
        return [text[at : at + size] for at in range(0, len(text), max(1, size - overlap))]
    cut = [[text[a:b]] if b - a <= size else split_text(text[a:b], size, overlap) for a, b in _spans(text, mark, size)]
    flat = [c for level in cut for c in level]
    tails = ["", *(tail_of(c, overlap) for c in flat[:-1])]
    return [c for t, own in zip(tails, flat, strict=True) if (c := f"{t} {own}".strip() if t else own).strip()]


def packed_paragraphs(text: Column, most: int = schema.MAIL_CHUNK, overlap: int = schema.MAIL_OVERLAP) -> Column:
    """Paragraphs packed to most characters, as an array; each part starts with the last characters of the one before.

    A long paragraph stays whole. A null text is empty, and an empty one is one empty part.
    """
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, paragraph: Column) -> Column:
        bare = acc["open"] == ""
        fits = F.length(acc["open"]) + 2 + F.length(paragraph) <= most
        before = F.when(fits, acc["open"]).otherwise(F.right(acc["open"], F.lit(overlap)))
        return F.struct(F.when(fits | bare, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(bare, paragraph).otherwise(F.concat(before, F.lit("\n\n"), paragraph)).alias("open"))

    parts = F.aggregate(F.split(text, "\n\n", -1), start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(parts)


def paragraph_chunks(rows: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """keep, pos (from 0) and text of each part that paragraphs of text are packed into."""
    return rows.select(*keep, F.posexplode(packed_paragraphs(F.col(text))).alias("pos", "text"))


def _lists(cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array([cut(t.as_py() or "") for t in batch["text"]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in batch.schema.names if c != "text"], parts], [*[c for c in batch.schema.names if c != "text"], "parts"])

    return run


def chunks(docs: DataFrame, keep: tuple[str, ...], text: str = "text", cut=split_text) -> DataFrame:
    """keep, pos (from 0) and text of each chunk. Whole texts are cut in Arrow batches; nothing is shuffled."""
    rows = docs.select(*keep, F.col(text).alias("text"))
    schema_ = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text") + ", parts array<string>"
    return rows.mapInArrow(_lists(cut), schema_).select(*keep, F.posexplode("parts").alias("pos", "text"))


def document_chunks(pages: DataFrame, keep: tuple[str, ...] = ("path", "digest", "page")) -> DataFrame:
    """Chunks of pages(path, digest, page, text) with their ids."""
    return chunks(pages, keep).withColumn("id", chunk_id(F.col("digest"), F.col("page"), F.col("pos")))


def batches(sizes: DataFrame, by: tuple[str, ...], order: str, size: str, chars: int = schema.BATCH_CHARS, count: int = schema.BATCH_COUNT) -> DataFrame:
    """(by, batch, items, chars): rows of each group in order, packed until the next would pass chars or count.

    The fold needs the rows of a group in order, so by names a group of bounded size, as a file or a partition is.
    """
    listed = sizes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("int").alias("s")))).alias("rows"))
    start = F.struct(F.array().cast("array<struct<items:int,chars:int>>").alias("done"), F.lit(0).alias("items"), F.lit(0).alias("chars"))

    def step(acc, x):
        full = (acc["items"] > 0) & ((acc["chars"] + x["s"] > chars) | (acc["items"] >= count))
        closed = F.array_append(acc["done"], F.struct(acc["items"].alias("items"), acc["chars"].alias("chars")))
        return F.struct(F.when(full, closed).otherwise(acc["done"]).alias("done"), F.when(full, 1).otherwise(acc["items"] + 1).alias("items"), F.when(full, x["s"]).otherwise(acc["chars"] + x["s"]).alias("chars"))

    end = lambda acc: F.array_append(acc["done"], F.struct(acc["items"].alias("items"), acc["chars"].alias("chars")))
    return listed.select(*by, F.posexplode(F.aggregate("rows", start, step, end)).alias("batch", "b")).select(*by, "batch", "b.items", "b.chars")
