"""A chunk table and hybrid search over its indexes, with filters that apply before anything is scored."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltwork import schema
from siltwork.adapters import HashEmbedder
from siltwork.operators import dense, fusion, lexical


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def nfc_column(s: pd.Series) -> pd.Series:  # Spark has no function for it
    return s.str.normalize("NFC")


def resolve_sources(chunks: DataFrame, pattern: str, source: str = "source") -> DataFrame:
    """Distinct sources that hold the pattern, whatever the case and composition; none for a blank pattern."""
    needle = nfc(pattern.strip()).lower()
    found = chunks.select(source).distinct().where(F.col(source).isNotNull())
    if not needle:
        return found.limit(0)
    return found.where(F.contains(F.lower(nfc_column(F.col(source))), F.lit(needle)))


def _has(c: str, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle)), F.lit(False))


def _any_has(c: str, needle: str) -> Column:
    return F.coalesce(F.exists(F.col(c), lambda a: F.contains(F.lower(a), F.lit(needle))), F.lit(False))


def corresponds(pattern: str) -> Column:
    """Sender, recipients or copies hold the pattern, in their addresses."""
    needle = pattern.strip().lower()
    return _has("sender_email", needle) | _any_has("to_emails", needle) | _any_has("cc_emails", needle)


def resolve_correspondent(chunks: DataFrame, pattern: str) -> DataFrame:
    """(field, addresses): distinct addresses that hold the pattern, of each field that has some."""
    needle = pattern.strip().lower()
    parts = [chunks.select(F.lit(f).alias("field"), (F.col(f) if f == "sender_email" else F.explode(f)).alias("address")) for f in ("sender_email", "to_emails", "cc_emails")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.contains(F.lower("address"), F.lit(needle)))
    return every.groupBy("field").agg(F.sort_array(F.collect_set("address")).alias("addresses"))


def in_period(date: Column, since: str | None, until: str | None) -> Column:
    """The first ten characters lie in the period, both ends included; rows without a date never do."""
    day = F.left(date, F.lit(10))
    out = F.coalesce(day, F.lit("")) != ""
    if since:
        out = out & (day >= since[:10])
    if until:
        out = out & (day <= until[:10])
    return out


def any_of(c: Column, values: list, is_list: bool) -> Column:
    """The value, or any element of a list, is one of values; null never is."""
    if not values:
        return F.lit(False)
    wanted = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.arrays_overlap(c, wanted) if is_list else F.array_contains(wanted, c), F.lit(False))


@dataclass
class Filters:
    source: str = ""
    correspondent: str = ""
    since: str | None = None
    until: str | None = None
    #: Values by column; of the columns named in lists any element may be one of them.
    exact: dict[str, list] = field(default_factory=dict)
    lists: tuple[str, ...] = ("labels", "domains", "to_domains", "thread_domains", "to_emails", "cc_emails", "attachment_names")

    def column(self, columns: list[str]) -> Column:
        """All given filters together; a filter on a column that an index lacks matches nothing."""
        out = F.lit(True)
        if self.source.strip():
            out = out & F.coalesce(F.contains(F.lower(nfc_column(F.col("source"))), F.lit(nfc(self.source.strip()).lower())), F.lit(False))
        if self.correspondent.strip():
            out = out & (corresponds(self.correspondent) if "sender_email" in columns else F.lit(False))
        if self.since or self.until:
            out = out & (in_period(F.coalesce("mail_date", "date"), self.since, self.until) if "mail_date" in columns else in_period(F.col("date"), self.since, self.until))
        for c, values in self.exact.items():
            out = out & (any_of(F.col(c), values, c in self.lists) if c in columns else F.lit(False))
        return out

    def matches(self, chunks: DataFrame) -> DataFrame:
        """One row: matched_files and matched_chunks. A filter that matches nothing says so by zeros, and a search finds nothing."""
        return chunks.where(self.column(chunks.columns)).agg(F.countDistinct("source").alias("matched_files"), F.count("*").alias("matched_chunks"))


class Retriever:
    """Searches all indexes of one chunk table in one plan: dense and lexical top-k, fused in each index, then over all."""

    def __init__(self, chunks: DataFrame, embedder: HashEmbedder | None = None) -> None:
        self.chunks, self.embedder = chunks, embedder or HashEmbedder()

    def search(self, query: str, filters: Filters | None = None, top_k: int = schema.TOP_K, top_n: int = schema.TOP_N, rerank: bool = True, boost: float = 0.0, weights: DataFrame | None = None) -> DataFrame:
        """Hits of one query with rank, score, in_semantic, in_bm25, weak and kind."""
        spark: SparkSession = self.chunks.sparkSession
        asked = spark.createDataFrame([(0, query)], "qid bigint, qtext string")
        vectors = asked.select("qid", self.embedder.column(F.col("qtext")).alias("vector"))
        keep = (filters or Filters()).column(self.chunks.columns)
        near = dense.dense_topk(self.chunks, vectors, top_k, "pos", "vector", "qid", within=keep & F.col("vector").isNotNull(), by="index_name")
        words = lexical.top(lexical.bm25_scores_by(self.chunks, asked, "pos", "qid", "index_name", "text", "qtext", within=keep), "pos", top_k, by=("query_id", "index_name"))
        own = fusion.rrf([near, words], ["pos"], ["query_id", "index_name"])
        indexes = self.chunks.agg(F.countDistinct("index_name").alias("n")).first()["n"]
        fused = fusion.rrf_of_indexes(own, "index_name", "pos", "query_id").where(F.col("rank") <= max(top_k * indexes, top_n))
        flags = [x.select("index_name", "pos").distinct().withColumn(f, F.lit(True)) for x, f in ((near, "in_semantic"), (words, "in_bm25"))]
        rows = fused.drop("score").join(self.chunks, ["index_name", "pos"])
        if rerank:
            hits = fusion.rerank(rows, fusion.overlap_score(F.lit(query), F.col("text")), top_n)
        else:
            hits = rows.withColumn("score", fusion.unranked_score(F.col("rank"))).withColumn("confident", F.lit(True)).where(F.col("rank") <= top_n)
        if boost and weights is not None:
            hits = fusion.boosted(hits.join(weights, "sender_email", "left"), F.coalesce("weight", F.lit(0.0)), boost)
        for f in flags:
            hits = hits.join(f, ["index_name", "pos"], "left")
        return hits.select(
            "rank", "score", "index_name", "pos", "id", "source", "path", "page", "text", (~F.col("confident")).alias("weak"), *[F.coalesce(f, F.lit(False)).alias(f) for f in ("in_semantic", "in_bm25")],
            fusion.kind(F.col("message_id"), F.col("date_source")).alias("kind"), F.left(F.coalesce("mail_date", "date"), F.lit(10)).alias("date"), F.coalesce("date_source", F.lit("")).alias("date_source"),
        )


def citation(source: Column, page: Column, kind: Column, date: Column, score: Column) -> Column:
    """How a hit is named to its reader."""
    where = F.when(kind == "mail", F.concat(F.lit("mail, message "), page)).when(kind == "attachment", F.concat(F.lit("attachment, p. "), page)).otherwise(F.concat(F.lit("p. "), page))
    return F.concat(F.lit("["), source, F.lit(", "), where, F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit(", "), date)).otherwise(""), F.lit("] "), F.format_number(score, 4))


def index_stats(chunks: DataFrame, by: str = "index_name", source: str = "source") -> DataFrame:
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.countDistinct(source).alias("documents"))


def base_stats(chunks: DataFrame, source: str = "source", date: str | None = "date", listed: int = 20) -> DataFrame:
    """One row: chunks, documents, the first listed sources in order, the oldest and the newest date."""
    ends = [F.min(date).alias("oldest"), F.max(date).alias("newest")] if date else []
    per = chunks.groupBy(source).agg(F.count("*").alias("n"), *ends)
    names = chunks.select(source).where(F.col(source).isNotNull()).distinct().orderBy(source).limit(listed).agg(F.sort_array(F.collect_list(source)).alias("sources"))
    whole = per.agg(F.sum("n").alias("chunks"), F.count(source).alias("documents"), *([F.min("oldest").alias("oldest"), F.max("newest").alias("newest")] if date else []))
    return whole.crossJoin(names)
