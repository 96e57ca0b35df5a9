"""Rank fusion, reranking, boosts and the projection of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions.text import tokenize


def rrf(rankings: list[DataFrame], key: list[str], by: list[str], k: int = schema.RRF_K, digits: int = 6) -> DataFrame:
    """(by, key, score, rank): the sum of 1 / (k + rank) over the rankings; ties keep the order in which they were first seen."""
    every = None
    for number, r in enumerate(rankings):
        part = r.select(*by, *key, "rank", F.lit(number).alias("list"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(*by, *key).agg(F.round(F.sum(1.0 / (k + F.col("rank")).cast("double")), digits).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "seen", *key)
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def rrf_of_indexes(ranked: DataFrame, index: str, key: str, by: str, k: int = schema.RRF_K, digits: int = 6) -> DataFrame:
    """(by, index, key, score, rank) of results ranked within each of any number of indexes; ties go to the index first in order."""
    scored = ranked.select(by, index, key, F.col("rank").alias("_r"), F.round(1.0 / (k + F.col("rank")).cast("double"), digits).alias("score"))
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(index).asc_nulls_last(), "_r", key)
    return scored.withColumn("rank", F.row_number().over(order)).drop("_r")


def overlap_score(query: Column, passage: Column, digits: int = 6) -> Column:
    """An offline stand-in for a cross-encoder: the share of the query's distinct words that the passage has."""
    asked = F.array_distinct(tokenize(query))
    return F.round(F.size(F.array_intersect(asked, tokenize(passage))) / F.greatest(F.size(asked), F.lit(1)), digits)


def rerank_threshold(relevant: float, irrelevant: float, explicit: float | None = None) -> float:
    """Where a score stops being noise: a margin above what an irrelevant pair scores."""
    if explicit is not None:
        return explicit
    if relevant <= irrelevant:
        return schema.RERANK_MIN
    return irrelevant + schema.NOISE_MARGIN * (relevant - irrelevant)


def rerank(candidates: DataFrame, score: Column, n: int = schema.TOP_N, threshold: float = schema.RERANK_MIN, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The n best candidates by score, ties in their fused order; weak: none of a query's candidates reaches the threshold.

    Nothing is dropped for its score.
    """
    rows = candidates.withColumnRenamed("rank", "fused_rank").withColumn("score", score)
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("confident", F.max("score").over(whole) >= threshold)
    rows = rows.withColumn("rank", F.row_number().over(whole.orderBy(F.col("score").desc(), "fused_rank")))
    return rows.where(F.col("rank") <= n)


def unranked_score(rank: Column) -> Column:
    """What a hit's score is without a reranker."""
    return F.bround(1.0 / rank.cast("double"), 4)


def boosted(hits: DataFrame, weight: Column, boost: float, by: tuple[str, ...] = ("query_id",), digits: int = 6) -> DataFrame:
    """Hits again in order of score * (1 + boost * weight); ties keep their order."""
    value = F.round(F.col("score") * (1 + F.lit(float(boost)) * weight), digits)
    order = Window.partitionBy(*by).orderBy(F.col("boosted").desc(), "old_rank")
    return hits.withColumnRenamed("rank", "old_rank").withColumn("boosted", value).withColumn("rank", F.row_number().over(order))


def kind(message_id: Column, date_source: Column) -> Column:
    has = F.coalesce(message_id, F.lit("")) != ""
    return F.when(has & (F.coalesce(date_source, F.lit("")) != ""), "attachment").when(has, "mail").otherwise("document")
