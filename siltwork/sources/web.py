"""Web pages: search and reading, offline over a table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions.text import html_to_text, truncate
from siltwork.operators import lexical


#: Fixed value: where an abstract page's full text is, if it is anywhere.
ABSTRACT, FULL = r"(?i)^(https?://arxiv\.org)/abs/", "$1/html/"


def read_urls(pages: DataFrame) -> DataFrame:
    """(page_id, valid, fetched, note, text): http urls only; long texts are cut, short ones noted.

    An abstract page gives the full text's page if pages hold that and it has text; else its own text, noted as an abstract.
    Rows with a null url are not valid; null html is an empty, short page. Repeated full texts count as one.
    """
    text = html_to_text(F.col("html"))
    rows = pages.select("page_id", "url", text.alias("own"), F.when(F.col("url").rlike(ABSTRACT), F.regexp_replace("url", ABSTRACT, FULL)).alias("better"))
    whole = pages.where(F.col("url").rlike(r"(?i)^https?://arxiv\.org/html/")).select(F.col("url").alias("better"), text.alias("whole")).where("whole <> ''").groupBy("better").agg(F.max("whole").alias("whole"))
    # Only abstract pages are joined: all others have no key and would meet in one task.
    joined = rows.where(F.col("better").isNotNull()).join(whole, "better", "left")
    rows = joined.unionByName(rows.where(F.col("better").isNull()).withColumn("whole", F.lit(None).cast("string"))).withColumn("x", F.coalesce("whole", "own"))
    note = F.when(F.col("better").isNotNull() & F.col("whole").isNull(), "ABSTRACT ONLY").when(F.length("x") < schema.SHORT_PAGE, "SHORT PAGE").otherwise("")
    return rows.select(
        "page_id", F.coalesce(F.col("url").rlike("(?i)^https?://[^/]+"), F.lit(False)).alias("valid"), F.when(F.col("whole").isNotNull(), F.col("better")).otherwise(F.col("url")).alias("fetched"),
        note.alias("note"), truncate(F.col("x"), schema.PAGE_CHARS).alias("text"),
    )


def search(pages: DataFrame, queries: DataFrame, results: int = 5) -> DataFrame:
    """The best pages for queries(query_id, query): rank, url and a snippet of 400 characters at most."""
    n = max(1, min(int(results), 10))
    texts = pages.select("page_id", "url", html_to_text(F.col("html")).alias("text"))
    best = lexical.top(lexical.bm25_scores(texts, queries, "page_id", "query_id", "text", "query"), "page_id", n)
    return best.join(texts, "page_id").select("query_id", "rank", "url", F.left("text", F.lit(schema.SNIPPET)).alias("snippet"))
