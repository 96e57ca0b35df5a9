"""Retrieval quality: where the first right answer stands, and hit@1, hit@3 and MRR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork import schema


#: A labelled query: what is asked, names of documents that answer it, phrases that a right passage holds, and a note.
LABELLED = "query string, expect array<string>, evidence array<string>, note string"


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """The labelled queries of a JSON array (or of several files of that kind); queries without text or expectation are left out.

    Without evidence any passage of an expected document is right.
    """
    rows = spark.read.schema(LABELLED).option("multiLine", "true").json(path)
    empty = F.array().cast("array<string>")
    return rows.where((F.trim("query") != "") & (F.size("expect") > 0)).select("query", "expect", F.coalesce("evidence", empty).alias("evidence"), F.coalesce("note", F.lit("")).alias("note"))


def document_order(ranked: DataFrame, source: str = "source", by: tuple[str, ...] = ("mode", "query_id")) -> DataFrame:
    """Distinct sources in the order in which a ranking first shows them."""
    first = ranked.groupBy(*by, source).agg(F.min("rank").alias("seen"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("seen", source))).drop("seen")


def first_hit(ranked: DataFrame, right, queries: DataFrame, top: int = schema.TOP_N, by: tuple[str, ...] = ("mode", "query_id")) -> DataFrame:
    """(mode, query_id, hit): the rank of the first right row among the top, null without one; right is a condition or a table to semi-join.

    queries(mode, query_id) lists what was asked, so that queries without any row count as missed.
    """
    rows = ranked.where(F.col("rank") <= top)
    rows = rows.join(right, [c for c in right.columns if c in rows.columns], "left_semi") if isinstance(right, DataFrame) else rows.where(right)
    return queries.select(*by).distinct().join(rows.groupBy(*by).agg(F.min("rank").alias("hit")), list(by), "left")


def metrics(hits: DataFrame, by: tuple[str, ...] = ("mode",)) -> DataFrame:
    return hits.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count_if(F.col("hit") == 1).alias("hit1"), F.count_if(F.col("hit").isNotNull()).alias("hit3"), F.round(F.sum(F.coalesce(1.0 / F.col("hit").cast("double"), F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1)), 6).alias("mrr")
    )
