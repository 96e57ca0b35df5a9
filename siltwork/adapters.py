"""Interfaces to models and services, with offline backends that always answer alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.text import tokenize
from siltwork.operators.dense import normalized


@dataclass(frozen=True)
class HashEmbedder:
    """Words hashed to signed dimensions, at length 1. query and passage are put in front of texts, as some models want it."""

    dimensions: int = 64
    query: str = ""
    passage: str = ""

    def column(self, text: Column, is_query: bool = False) -> Column:
        words = tokenize(F.concat(F.lit(self.query if is_query else self.passage), text))
        hashed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(self.dimensions)).cast("int").alias("d"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
        dims = F.sequence(F.lit(0), F.lit(self.dimensions - 1))
        counts = F.transform(dims, lambda d: F.aggregate(F.filter(hashed, lambda h: h["d"] == d), F.lit(0.0), lambda a, h: a + h["s"]))
        return normalized(counts).cast("array<float>")

    def signature(self) -> dict[str, str]:
        return {"backend": "hash", "model": "words", "dim": str(self.dimensions), "query_prefix": self.query, "passage_prefix": self.passage}


def check_compatible(stored: dict[str, str] | None, now: dict[str, str]) -> None:
    """Vectors of different make can't be compared; a store without a signature is taken as it is."""
    if stored and (bad := sorted(k for k in {*stored, *now} if str(stored.get(k)) != str(now.get(k)))):
        raise ValueError("the index was made with other embeddings: " + ", ".join(f"{k}: {stored.get(k)} / {now.get(k)}" for k in bad))


def translated(queries: DataFrame, passages: DataFrame, table: DataFrame | None = None, translate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Each query in each script that passages have: from table(query, script, text), else by translate, else itself."""
    wanted = queries.crossJoin(F.broadcast(passages.select("script").distinct()))  # a handful of scripts
    if table is not None:
        wanted = wanted.join(table.withColumnRenamed("text", "known"), ["query", "script"], "left")
    known = F.col("known") if table is not None else F.lit(None).cast("string")
    made = translate(F.col("query"), F.col("script")) if translate else F.lit(None).cast("string")
    return wanted.select("query", "script", F.coalesce(known, made, "query").alias("text"))


def resolve_ocr(wanted: str, available: set[str]) -> str:
    """off, or the backend that will be used; auto takes the first there is."""
    if wanted in ("off", ""):
        return "off"
    if wanted == "auto":
        return next((b for b in ("vision", "tesseract") if b in available), "off")
    return wanted if wanted in available else "off"
