"""BM25 over an inverted index that Spark builds: term statistics, postings, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions.text import tokenize
from siltwork.scratch import written

#: Scores are rounded to six digits later. The share of postings up to which bounds are worth their steps.
MARGIN, PAYS = 1e-5, 0.4
#: Texts and queries that are packed into one row, about: a task holds one of either.
TEXTS, QUERIES = 4096, 256
#: Queries' words up to which these go to all executors, which then count a text's words in place; beyond, words are joined.
WORDS = 1 << 20


def lengths(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens, length)."""
    return docs.select(F.col(key), tokenize(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens"))


def corpus_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row: n texts, empty ones too, and their average length."""
    return lengths(docs, key, text).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).select("n", (F.col("total") / F.col("n")).alias("average"))


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, length)."""
    return lengths(docs, key, text).select(key, "length", F.explode("tokens").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column, variant: str = "plus") -> Column:
    """plus: always positive; okapi: without the 1 inside, as the common library has it."""
    ratio = (n - df + 0.5) / (df + 0.5)
    return F.log(ratio) if variant == "okapi" else F.log(1 + ratio)


def terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, idf) of the whole vocabulary."""
    df = lengths(docs, key, text).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(corpus_stats(docs, key, text).select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def weight(tf: Column, length: Column, average: Column, idf_: Column) -> Column:
    k1, b = schema.BM25_K1, schema.BM25_B
    norm = tf + k1 * (1 - b + b * length / F.when(average > 0, average).otherwise(1.0))
    return idf_ * tf * (k1 + 1) / norm


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term, qf): a term counts as often as the query has it."""
    return queries.select(F.col(query).alias("query_id"), F.explode(tokenize(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str, query: str, text: str = "text", query_text: str = "text", within: Column | None = None, k: int | None = None, pays: float = PAYS) -> DataFrame:
    """(query_id, key, score) of the pairs that share a term; within filters docs before they are scored, not the statistics.

    Texts are cut into tokens once: postings of the queries' terms are written, and the statistics are seen on the way.
    The queries' terms are broadcast by Spark if small, else joined by sort-merge.

    With k, pairs are left out that can't be among a query's k best. The k-th best weight of any one term bounds the k-th
    best score from below; terms whose largest weights together stay under that can't lift a text by themselves, so texts
    that have no other term of the query, as those that only share stop words, are never paired with it, and most others
    drop out by what they have so far. Where the needed terms' postings are more than the share `pays` of all, every pair
    is scored at once, which gives the same best rows sooner.
    """
    asked = query_terms(queries, query, query_text)
    seen = Observation()
    rows = lengths(docs, key, text).observe(seen, F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    own = rows.select(key, "length", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    own = written(own.groupBy(key, "term", "length").agg(F.count("*").alias("tf")), "postings")
    n = max(seen.get.get("n") or 0, 1)
    average = (seen.get.get("total") or 0) / n
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    if within is not None:
        own = own.join(docs.where(within).select(key), key, "left_semi")
    w = weight(F.col("tf"), F.col("length"), F.lit(average), idf(F.lit(n), F.col("df")))
    scored = own.join(df, "term").select(key, "term", w.alias("w"))
    if k is None:
        return scored.join(asked, "term").groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("qf")).alias("score"))
    best = Window.partitionBy("term").orderBy(F.col("w").desc())
    bounds = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("term").agg(F.max("w").alias("most"), F.max(F.when(F.col("r") == k, F.col("w"))).alias("kth"))
    of_query = Window.partitionBy("query_id")
    rated = asked.join(bounds, "term").join(df, "term").withColumn("most", F.col("most") * F.col("qf")).withColumn("floor", F.max(F.coalesce(F.col("kth") * F.col("qf"), F.lit(0.0))).over(of_query))
    upto = F.sum("most").over(of_query.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A margin for rounding, which could make a text equal to the k-th.
    rated = written(rated.withColumn("needed", upto >= F.col("floor") - MARGIN), "query-terms")
    work = rated.agg(F.sum("df").alias("all"), F.sum(F.when(F.col("needed"), F.col("df"))).alias("needed")).first()
    if (work["needed"] or 0) > pays * (work["all"] or 0):
        return scored.join(asked, "term").groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("qf")).alias("score"))
    scored = written(scored, "weights")
    partial = scored.join(rated.where("needed").select("query_id", "term", "qf"), "term").groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("qf")).alias("partial"))
    partial = written(partial, "partial")
    # The k-th best of these is a better bar; what a text lacks still can't be more than the other terms' largest weights.
    ranked = partial.withColumn("r", F.row_number().over(of_query.orderBy(F.col("partial").desc()))).where(F.col("r") <= k)
    bar = ranked.groupBy("query_id").agg(F.max(F.when(F.col("r") == k, F.col("partial"))).alias("bar"))
    rest = rated.groupBy("query_id").agg(F.sum(F.when(~F.col("needed"), F.col("most")).otherwise(0.0)).alias("rest"))
    pairs = written(partial.join(bar.join(rest, "query_id"), "query_id").where(F.col("bar").isNull() | (F.col("partial") + F.col("rest") >= F.col("bar") - MARGIN)).select("query_id", key, "partial"), "pairs")
    more = pairs.select("query_id", key).join(rated.where("not needed").select("query_id", "term", "qf"), "query_id").join(scored, [key, "term"])
    more = more.groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("qf")).alias("more"))
    return pairs.join(more, ["query_id", key], "left").select("query_id", key, (F.col("partial") + F.coalesce("more", F.lit(0.0))).alias("score"))


def bm25_scores_by(docs: DataFrame, queries: DataFrame, key: str, query: str, by: str, text: str = "text", query_text: str = "text", within: Column | None = None) -> DataFrame:
    """(query_id, by, key, score) as bm25_scores() has it, with the statistics of each value of by: many indexes in one plan."""
    asked = query_terms(queries, query, query_text)
    rows = docs.select(F.col(key), F.col(by), tokenize(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens"))
    stats = rows.groupBy(by).agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("average"))
    own = rows.select(key, by, "length", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    own = written(own.groupBy(key, by, "term", "length").agg(F.count("*").alias("tf")), "postings")
    df = own.groupBy(by, "term").agg(F.count("*").alias("df"))
    if within is not None:
        own = own.join(docs.where(within).select(key, by), [key, by], "left_semi")
    w = weight(F.col("tf"), F.col("length"), F.col("average"), idf(F.col("n"), F.col("df")))
    scored = own.join(df, [by, "term"]).join(stats, by).select(key, by, "term", w.alias("w"))
    return scored.join(asked, "term").groupBy("query_id", by, key).agg(F.sum(F.col("w") * F.col("qf")).alias("score"))


def _counted(terms: list[str], tids: list[int]):
    """(key, length, tids, tfs): how often a text has which of the terms, a row for each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, numbers = pa.array(terms, pa.string()), np.array(tids, np.int64)
        for batch in batches:
            tokens = batch["tokens"]
            sizes = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
            found = np.asarray(pc.index_in(tokens.flatten(), value_set=vocabulary).fill_null(-1), np.int64)
            held = found >= 0
            pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[held] * len(numbers) + found[held], return_counts=True)
            row, term = np.divmod(pairs, max(len(numbers), 1))
            some, counts = np.unique(row, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(counts)])
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends * x.itemsize).astype("<i4").tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(some)), batch["length"].take(pa.array(some)), binary(numbers[term]), binary(tf.astype("<i4"))], ["key", "length", "tids", "tfs"])

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (key, length, tid, tf) in the form of _counted()."""
    for batch in batches:
        spread = [pa.array([x.tobytes() for x in np.asarray(batch[c], kind)], pa.binary()) for c, kind in (("tid", "<i8"), ("tf", "<i4"))]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["length"], *spread], ["key", "length", "tids", "tfs"])


def _pack_texts(average: float):
    """A block's texts in order of their keys, and its postings (place, term, weight) in order of terms; texts of one key and length count as one."""
    k1, b = schema.BM25_K1, schema.BM25_B

    def run(key: tuple, table: pa.Table) -> pa.Table:
        coded = table["key"].combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
        place = np.empty(len(order), np.int64)
        place[np.asarray(order)] = np.arange(len(order))
        of_row = place[np.asarray(coded.indices)]
        flat = {c: [np.frombuffer(x.as_buffer(), kind) for x in table[c]] for c, kind in (("tids", "<i8"), ("tfs", "<i4"))}
        sizes = [len(x) for x in flat["tids"]]
        places, lengths_ = np.repeat(of_row, sizes), np.repeat(np.asarray(table["length"], np.int64), sizes)
        terms, tf = np.concatenate(flat["tids"]), np.concatenate(flat["tfs"]).astype(np.int64)
        by = np.lexsort((lengths_, places, terms))
        places, lengths_, terms, tf = places[by], lengths_[by], terms[by], tf[by]
        starts = np.flatnonzero(np.append(True, (np.diff(terms) != 0) | (np.diff(places) != 0) | (np.diff(lengths_) != 0)))
        places, lengths_, terms, tf = places[starts], lengths_[starts], terms[starts], np.add.reduceat(tf, starts)
        weights = 1.0 * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths_ / (average if average > 0 else 1.0)))
        packed = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((places, "<i4"), (terms, "<i8"), (weights, "<f8"))]
        keys = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(order))
        return pa.Table.from_arrays([pa.array([key[1].as_py()], table.schema.field("by").type), keys, *packed], ["by", "keys", "places", "tids", "weights"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, df) of each block."""
    for batch in batches:
        for tids in batch["tids"]:
            found, counts = np.unique(np.frombuffer(tids.as_buffer(), "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["tid", "df"])


def _pack_queries(key: tuple, table: pa.Table) -> pa.Table:
    at = np.argsort(np.asarray(table["query_no"], np.int64), kind="stable")
    packed = [pa.array([np.asarray(table[c], kind)[at].tobytes()], pa.binary()) for c, kind in (("query_no", "<i8"), ("tid", "<i8"), ("factor", "<f8"))]
    return pa.Table.from_arrays(packed, ["numbers", "asked", "factors"])


def _block_best(k: int, kind: pa.DataType, by: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: np.frombuffer(batch[c][i].as_buffer(), t) for c, t in (("places", "<i4"), ("tids", "<i8"), ("weights", "<f8"), ("numbers", "<i8"), ("asked", "<i8"), ("factors", "<f8"))}
                keys = batch["keys"][i].values
                first, last = np.searchsorted(row["tids"], row["asked"]), np.searchsorted(row["tids"], row["asked"], "right")
                starts = np.append(np.flatnonzero(np.diff(row["numbers"], prepend=-1)), len(row["numbers"]))
                queries, places, scores = [], [], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    score, met = np.zeros(len(keys)), np.zeros(len(keys), bool)
                    for f, l, factor in zip(first[a:b].tolist(), last[a:b].tolist(), row["factors"][a:b].tolist(), strict=True):
                        if f < l:
                            # A key with texts of several lengths has a posting for each.
                            np.add.at(score, row["places"][f:l], row["weights"][f:l] * factor)
                            met[row["places"][f:l]] = True
                    some = np.flatnonzero(met)
                    if len(some):
                        best = some[np.lexsort((some, -np.round(score[some], 6)))[:k]]
                        queries.append(np.full(len(best), row["numbers"][a]))
                        places.append(best)
                        scores.append(score[best])
                if queries:
                    n = sum(map(len, places))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries)), pa.array([batch["by"][i].as_py()] * n, by), keys.take(pa.array(np.concatenate(places))).cast(kind), pa.array(np.concatenate(scores))], ["query_no", "by", "key", "score"])

    return run


def bm25_best(docs: DataFrame, queries: DataFrame, key: str, query: str, k: int = schema.TOP_K, text: str = "text", query_text: str = "text", within: Column | None = None, by: str | None = None) -> DataFrame:
    """(query_id, key, score) as bm25_scores() has it, of which top() needs no more: the k best of each block of texts.

    Blocks of texts (postings of the queries' terms) meet blocks of queries where they lie, and a block returns the k best of
    each query, so no pair of a query and a text is ever a row. A text's words are counted where it is read, and
    a block's postings are never rows, so what a task holds is an Arrow batch or a block, however large the tables are. With by, the k best of each value of that column of docs
    are found, and it is returned too; a key that has rows with several values counts for each, as often as it has rows there.
    Ties go to the smaller key.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    asked = written(query_terms(queries, query, query_text), "asked")
    names = written(asked.select("query_id").distinct().withColumn("query_no", F.monotonically_increasing_id()), "query-numbers")
    words = written(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "query-words")
    seen = Observation()
    rows = lengths(docs, key, text).observe(seen, F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    kind, form = dict(rows.dtypes)[key], "length int, tids binary, tfs binary"
    if words.count() <= WORDS:
        held = [(r["term"], r["tid"]) for r in words.collect()]
        own = rows.select(F.col(key).alias("key"), "length", "tokens").mapInArrow(_counted([h[0] for h in held], [h[1] for h in held]), f"key {kind}, {form}")
    else:
        own = rows.select(F.col(key).alias("key"), "length", F.explode("tokens").alias("term")).join(words, "term")
        own = own.groupBy("key", "tid", "length").agg(F.count("*").alias("tf")).select("key", "length", "tid", "tf").mapInArrow(_single, f"key {kind}, {form}")
    own = written(own, "postings")
    n = max(seen.get.get("n") or 0, 1)
    average = (seen.get.get("total") or 0) / n
    part = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // TEXTS))))

    def pack(own: DataFrame, name: str) -> DataFrame:
        return written(own.groupBy(part.alias("part"), "by").applyInArrow(_pack_texts(average), f"by {dict(own.dtypes)['by']}, keys array<{kind}>, places binary, tids binary, weights binary"), name)

    texts = pack(own.withColumn("by", F.lit(0)), "texts")
    df = texts.select("tids").mapInArrow(_frequencies, "tid bigint, df bigint").groupBy("tid").agg(F.sum("df").alias("df"))
    factor = asked.join(words, "term").join(df, "tid").join(names, "query_id")
    factor = factor.select("query_no", "tid", (idf(F.lit(n), F.col("df")) * F.col("qf")).alias("factor"))
    if within is not None:
        own = own.join(docs.where(within).select(F.col(key).alias("key")), "key", "left_semi")
    if by is not None:
        values = written(docs.groupBy(F.col(key).alias("key"), F.col(by).alias("by")).agg(F.count(F.lit(1)).alias("times")), "values")
        own = own.join(values.select("key", "by"), "key")
    if within is not None or by is not None:
        texts = pack(own if by is not None else own.withColumn("by", F.lit(0)), "some-texts")
    kinds = dict(texts.dtypes) | {"key": kind}
    blocks = F.pmod(F.xxhash64("query_no"), F.lit(max(1, -(-names.count() // QUERIES))))
    packed = written(factor.groupBy(blocks.alias("part")).applyInArrow(_pack_queries, "numbers binary, asked binary, factors binary"), "queries")
    arrow = {"key": to_arrow_type(texts.schema["keys"].dataType.elementType), "by": to_arrow_type(texts.schema["by"].dataType)}
    found = texts.crossJoin(packed).mapInArrow(_block_best(k, arrow["key"], arrow["by"]), f"query_no bigint, by {kinds['by']}, key {kinds['key']}, score double")
    found = found.join(names, "query_no").drop("query_no")
    if by is None:
        return found.select("query_id", F.col("key").alias(key), "score")
    found = found.join(values.withColumnRenamed("key", "own").withColumnRenamed("by", "value"), (F.col("key") == F.col("own")) & F.col("by").eqNullSafe(F.col("value")))
    return found.select("query_id", F.col("by").alias(by), F.col("key").alias(key), "score", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")


def top(scores: DataFrame, key: str, k: int = schema.TOP_K, *, by: tuple[str, ...] = ("query_id",), digits: int | None = 6) -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller key. Scores are rounded first, so that ranks repeat."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    best = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(key))
    return scores.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def save_vocabulary(docs: DataFrame, key: str, path: str, text: str = "text") -> None:
    """Write the terms with their statistics, and the corpus' own, as JSON lines."""
    terms(docs, key, text).write.mode("overwrite").json(f"{path}/terms")
    corpus_stats(docs, key, text).write.mode("overwrite").json(f"{path}/corpus")


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What save_vocabulary() wrote: (term, df, idf) and one row (n, average)."""
    return spark.read.schema("term string, df long, idf double").json(f"{path}/terms"), spark.read.schema("n long, average double").json(f"{path}/corpus")


def same_vocabulary(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: how many (term, df) either side has alone. Zero and zero: the copy is good."""
    a, b = one.select("term", "df"), two.select("term", "df")
    return a.exceptAll(b).agg(F.count("*").alias("only_first")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_second")))
