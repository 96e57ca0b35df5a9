"""Exact top-k inner products by MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, parallelism

SHARD_ROWS, QUERY_ROWS = 4096, 512
_COLUMNS = ("rows", "ids", "offsets", "terms", "weights")
_PACKED = ", ".join(f"{c} binary" for c in _COLUMNS)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row numbers and ids, and the sparse rows as offsets, terms and weights; zeros hold no posting."""
    ids = np.asarray(batch["vec_id"], np.int64)
    lists = batch["weights"]
    size = np.diff(np.asarray(lists.offsets, np.int64))
    flat = np.asarray(lists.flatten(), np.int64)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    held = flat != 0
    owner = np.repeat(np.arange(len(ids)), size)[held]
    return np.asarray(batch["row"], np.int64), ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ids)))]), terms[held], flat[held]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One group of rows as one row of binaries."""
    got = [_rows(b) for b in batches if b.num_rows]
    if not got:
        return
    rows, ids, terms, weights = (np.concatenate([g[k] for g in got]) for k in (0, 1, 3, 4))
    sizes = np.concatenate([np.diff(g[2]) for g in got])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (rows, ids, offsets, terms, weights)], list(_COLUMNS))


class Shard:
    """Postings of a block of rows by term, with each term's least and largest weight (0 where a row lacks it)."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # ties go to smaller ids
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.ids, self.numbers = ids[order], numbers[order]
        rows = rank[np.repeat(np.arange(len(ids)), np.diff(offsets))]
        self.high = int(np.abs(weights).max(initial=0))
        by = np.lexsort((rows, terms))
        rows, terms, weights = rows[by], terms[by], weights[by]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        ends = np.append(starts[1:], len(terms))
        self.postings = {int(terms[a]): (rows[a:b], weights[a:b]) for a, b in zip(starts, ends, strict=True)}
        self.bounds = {}
        for t, (r, w) in self.postings.items():
            some = len(r) < len(ids)
            self.bounds[t] = (min(int(w.min()), 0) if some else int(w.min()), max(int(w.max()), 0) if some else int(w.max()))
            if 2 * len(r) >= len(ids):  # a term of most rows is a column: no row is looked up in it
                column = np.zeros(len(ids), np.int64)
                column[r] = w
                self.postings[t] = None, column

    def top(self, terms: np.ndarray, weights: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) for a query, its own row aside; ties to the smaller id. Rows under least may be left out."""
        query = [(t, q) for t, q in zip(terms.tolist(), weights.tolist(), strict=True) if t in self.postings]
        n = len(self.ids)
        whole = int if all(isinstance(q, int) for _, q in query) and self.high * sum(abs(q) for _, q in query) >= 2**62 else np.int64
        acc = np.zeros(n, object if whole is int else np.int64)
        out = self.numbers == own
        # A term's contribution lies between its two bounds; the largest spreads are the essential terms.
        part = []
        for t, q in query:
            a, b = self.bounds[t]
            low, high = (q * a, q * b) if q >= 0 else (q * b, q * a)
            part.append((high - low, high, low, t, q))
        part.sort(key=lambda x: -x[0])
        rest_high = [0] * (len(part) + 1)
        rest_low = [0] * (len(part) + 1)
        for i in range(len(part) - 1, -1, -1):
            rest_high[i], rest_low[i] = rest_high[i + 1] + part[i][1], rest_low[i + 1] + part[i][2]
        live, i = None, 0
        want = min(k, int(n - out.sum()))
        if want <= 0:
            return self.ids[:0], acc[:0]
        step = 4
        # Essential postings are traversed whole until the others' bounds leave some rows out; acc then holds the live rows alone.
        while i < len(part):
            for _, _, _, t, q in part[i : i + step]:
                rows, w = self.postings[t]
                if rows is None:
                    w = w if live is None else w.take(live)
                    acc += q * (w.astype(object) if whole is int else w)
                    continue
                w = w.astype(object) if whole is int else w
                if live is None:
                    acc[rows] += q * w
                else:  # probe for the rows that still compete
                    at = np.minimum(np.searchsorted(rows, live), len(rows) - 1)
                    acc += np.where(rows[at] == live, q * w[at], 0)
            i = min(i + step, len(part))
            if live is None and out.any():
                live = np.flatnonzero(~out)
                acc = acc[live]
            if len(acc) > want:
                floor = np.sort(acc)[-want] if whole is int else np.partition(acc, -want)[-want]
                floor = floor + rest_low[i] if least is None else max(floor + rest_low[i], least)
                keep = acc + rest_high[i] >= floor
                if live is not None or keep.mean() < 0.5:
                    live = np.flatnonzero(keep) if live is None else live[keep]
                    acc = acc[keep]
        if live is None:
            live = np.flatnonzero(~out)
            acc = acc[live]
        best = np.lexsort((live, -acc))[:want] if whole is not int else np.array(sorted(range(len(live)), key=lambda r: (-acc[r], live[r]))[:want], np.int64)
        return self.ids[live[best]], acc[best]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None  # the join brings a shard's query blocks one after another
        for batch in batches:
            for row in batch.to_pylist():
                if held != row["part"]:
                    shard, held = Shard(*[np.frombuffer(row[c], "<i8") for c in _COLUMNS]), row["part"]
                rows, ids, offsets, terms, weights = (np.frombuffer(row["q_" + c], "<i8") for c in _COLUMNS)
                least = {f["query_row"]: f["least"] for f in row["floors"] or ()}
                got = [shard.top(terms[i:j], weights[i:j], own, k, least.get(own)) for own, i, j in zip(rows.tolist(), offsets[:-1], offsets[1:], strict=True)]
                sizes, limit = [len(g[0]) for g in got], np.iinfo(np.int64)
                score = [min(max(int(s), limit.min), limit.max) for g in got for s in g[1]]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * sum(sizes), pa.int64()), pa.array(np.repeat(rows, sizes)), pa.array(np.repeat(ids, sizes), pa.int64()), pa.array(np.concatenate([g[0] for g in got]), pa.int64()), pa.array(score, pa.int64())], ["block", "query_row", "query_id", "vec_id", "score"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(row, vec_id, weights array<bigint>): floor(scale * x) of each component, and a number for each row.

    Rows without an id, with a null vector, or with a component that is null or not finite are left out. Ids may repeat: each
    row is one of its own. Vectors may differ in length, and an empty one stays. A component beyond 2**52 counts as that, so
    that it stays a long. The result is written once, as its row numbers must not change. Other columns are ignored.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * F.least(F.greatest(v, F.lit(-(2.0**52))), F.lit(2.0**52))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, whole).alias("weights")).where("weights is not null")
    return Scratch(vectors.sparkSession, "vectors").put(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "weights"), "rows")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors with the largest inner product.

    Both hold (row, vec_id, weights array<bigint>), a number of its own for each row; a dimension is a term, a component that
    is not 0 a posting, so that a vector lacks the terms beyond its length. Vectors are dealt by hash to shards of about shard_rows. In a shard, a query's terms are sorted by
    the spread between the bounds of their contributions. Postings are traversed from the largest; the others'
    summed bounds tell which rows can still reach the k-th best, and once that leaves half of them out, the other
    terms are only probed for those that compete. The first shard's k-th best is where the other shards' bar starts. Shards'
    results are merged. A query's own row is left out, but not others
    that repeat its vec_id; repeated queries are answered each. Ties go to the smaller vec_id, and fewer than k rows are all returned. Shards and query blocks are joined by
    shard in a sort-merge join, so a task holds one of either and no table of shards is on the driver.

    Empty tables give an empty result. Scores beyond a long are cut to its range.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "maxscore")
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    packed = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n))).groupBy("part")
    index = scratch.put(packed(vectors, shards).applyInArrow(_keyed, f"part bigint, {_PACKED}"), "shards")
    asked = scratch.put(packed(queries, blocks).applyInArrow(_keyed, f"part bigint, {_PACKED}"), "queries")
    asked = asked.select(F.col("part").alias("block"), *[F.col(c).alias("q_" + c) for c in _COLUMNS])
    schema = "block bigint, query_row bigint, query_id bigint, vec_id bigint, score bigint"
    none = F.lit(None).cast("array<struct<query_row:bigint,least:bigint>>").alias("floors")
    first = F.broadcast(index.where("part = 0"))  # one row of about shard_rows vectors
    dealt = asked.select("*", none).repartition(min(blocks, parallelism(spark)), "block")  # else few files hold all queries
    found = scratch.put(dealt.crossJoin(first).mapInArrow(_search(k), schema), "first")
    if shards > 1:
        # What the first shard finds bounds the k-th best of all from below, so the others prune from the start.
        floors = found.groupBy("block", "query_row").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        floors = floors.groupBy("block").agg(F.collect_list(F.struct("query_row", "least")).alias("floors"))  # query_rows of them at most
        later = asked.join(floors, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(shards - 1).cast("long"))))
        # Packed shards are small as files and large in memory: Spark would take them for a side to broadcast.
        found = found.unionByName(index.where("part > 0").hint("merge").join(later, "part").mapInArrow(_search(k), schema))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keyed(key: tuple, table: pa.Table) -> pa.Table:
    out = next(_pack(iter(table.combine_chunks().to_batches())))
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *out.columns], ["part", *out.schema.names])
