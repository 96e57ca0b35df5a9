"""Exact top-k by inner product over vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork import schema

#: Vectors that are packed into one row: queries and rows meet block by block.
BLOCK = 4096
_PACKED = "part string, size int, keys binary, matrix binary"


def normalized(v: Column) -> Column:
    """At length 1; a length under 1e-12 counts as that."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    return F.transform(x, lambda e: e / F.greatest(norm, F.lit(1e-12)))


def dimension(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: the dimension, and whether all vectors share it."""
    return vectors.agg(F.max(F.size(vector)).alias("dimension"), (F.min(F.size(vector)) == F.max(F.size(vector))).alias("constant"))


def finite(v: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    return v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK vectors of one part and dimension, as bytes."""
    held: dict[tuple, tuple[list, list]] = {}

    def block(kind: tuple) -> pa.RecordBatch:
        keys, rows = held.pop(kind)
        return pa.RecordBatch.from_arrays([pa.array([kind[0]], pa.string()), pa.array([kind[1]], pa.int32()), pa.array([np.array(keys, "<i8").tobytes()], pa.binary()), pa.array([np.concatenate(rows).astype("<f8").tobytes()], pa.binary())], ["part", "size", "keys", "matrix"])

    for batch in batches:
        for part, key, vector in zip(batch["part"].to_pylist(), batch["key"].to_pylist(), batch["vector"], strict=True):
            kind = part, len(vector)
            keys, rows = held.setdefault(kind, ([], []))
            keys.append(key)
            rows.append(np.asarray(vector.values, np.float64))
            if len(keys) == BLOCK:
                yield block(kind)
    for kind in list(held):
        yield block(kind)


def _best(k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["size"] != row["asked_size"]:
                    continue
                ids, own = np.frombuffer(row["asked_keys"], "<i8"), np.frombuffer(row["keys"], "<i8")
                asked, rows = np.frombuffer(row["asked_matrix"], "<f8").reshape(len(ids), -1), np.frombuffer(row["matrix"], "<f8").reshape(len(own), -1)
                for i in range(0, len(ids), 256):
                    score = np.round(asked[i : i + 256] @ rows.T, digits)
                    order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
                    n = order.shape[1]
                    asking = ids[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * (len(asking) * n), pa.string()), pa.array(np.repeat(asking, n)), pa.array(own[order].reshape(-1)), pa.array(np.take_along_axis(score, order, 1).reshape(-1))], ["part", "query_id", "key", "score"])

    return run


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = schema.TOP_K, key: str = "vec_id", vector: str = "embedding", query: str = "vec_id", digits: int = 6, within: Column | None = None, by: str | None = None) -> DataFrame:
    """(query_id, rank, key, score): every query against every row of vectors (of those within, filtered in the scan).

    Both sides are packed into blocks where they lie, and each block of queries meets each block of rows once, as a matrix
    product that returns the k best of each query; nothing goes to the driver. Rows and queries whose key or vector is
    null, or whose vector holds a component that is null or not finite, take no part, and rows only meet queries of their
    own dimension. Ties go to the smaller key; a key that repeats is a row each time. With by, the k best of each value of that
    column are found, and it is returned too.
    """
    rows = vectors if within is None else vectors.where(within)

    def packed(df: DataFrame, name: str, part: Column) -> DataFrame:
        some = df.select(part.cast("string").alias("part"), F.col(name).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        return some.where(F.col("key").isNotNull() & finite(F.col("vector")) & (F.size("vector") > 0)).mapInArrow(_pack, _PACKED)

    asked = packed(queries, query, F.lit(None)).select(*[F.col(c).alias(f"asked_{c}") for c in ("size", "keys", "matrix")])
    found = packed(rows, key, F.lit(None) if by is None else F.col(by)).crossJoin(asked).mapInArrow(_best(k, digits), "part string, query_id bigint, key bigint, score double")
    best = Window.partitionBy("query_id", "part").orderBy(F.col("score").desc(), F.col("key"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score", *([] if by is None else [F.col("part").alias(by)]))
