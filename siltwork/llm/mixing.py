"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import WORD, Scratch

#: The hash has 60 bits: six levels of 2**10 buckets.
BITS, LEVELS = 10, 6
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, budget: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the budget dealt by weight, none above most times its size.

    What a full source can't take is dealt again by weight until none is above its cap. The fixed point is a water
    level w: target = min(cap, w * weight). With the sources in the order of cap / weight it is the first level that
    the remaining budget gives and that the next source's cap doesn't cut. There is one row per source here.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("place", "level"))).over(everything)
    ranked = ranked.withColumn("water", first["level"])
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def _coded(docs: DataFrame, text: str, id_col: str, source: str, *more: str) -> DataFrame:
    code = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    return docs.select(
        *more, F.col(id_col).alias("_doc"), F.col(source).alias("_source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.conv(F.substring(code, 1, 15), 16, 10).cast("long").alias("_h"),
    )


def thresholds(rows: DataFrame, scratch: Scratch, budget: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """(s, source_size, target, copies, threshold) by source, from rows (_source, _size, _h)."""
    rows = rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_h").alias("h"))
    targets = scratch.put(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), budget, weights, most), "targets")

    # left: what the boundary bucket still has to give; low: where that bucket starts.
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = targets.select("source", copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("low"))
    for k in range(LEVELS):
        width = 1 << (BITS * (LEVELS - 1 - k))
        inside = rows.join(edge.where(F.col("left") > 0).select(F.col("source").alias("s"), "left", "low"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + (width << BITS)))
        sums = inside.groupBy("s", "left", F.shiftright(F.col("h"), BITS * (LEVELS - 1 - k)).alias("bucket")).agg(F.sum("size").alias("w"))
        up_to = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 2**BITS rows a source at most
        sums = sums.withColumn("sum", F.sum("w").over(up_to))
        # The first bucket whose sum reaches what is left; all before it are below the threshold.
        first = sums.where(F.col("sum") >= F.col("left")).groupBy("s").agg(F.min(F.struct("bucket", "w", "sum")).alias("f"))
        nearer = F.col("left") - (F.col("f.sum") - F.col("f.w"))
        found = edge.join(first, F.col("source").eqNullSafe(F.col("s")), "left")
        low = F.when(F.col("f").isNull(), F.col("low")).otherwise(F.col("f.bucket") * width)
        if k == LEVELS - 1:  # one hash value: take it if that is nearer
            low = F.when(F.col("f").isNull(), F.col("low")).otherwise(F.col("f.bucket") + F.when(F.col("f.sum") - F.col("left") < nearer, 1).otherwise(0))
        edge = scratch.put(found.select("source", "copies", F.when(F.col("f").isNull(), F.col("left")).otherwise(nearer).alias("left"), low.alias("low")), f"edge-{k}")
    edge = edge.select(F.col("source").alias("s"), "copies", F.col("low").alias("threshold"))
    return targets.join(edge, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "copies", "threshold")


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", budget: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken, copies.

    A document's size is its number of words. A source takes each document floor(target / source_size) times, and
    once more those whose 60-bit hash lies below the source's threshold. To find the threshold, sizes are summed by
    source and hash bucket; the running sums show the bucket in which the budget ends, and only that bucket is split
    again, down to one hash value, which is taken if that comes nearer to the target. Thresholds are nested: a larger
    budget keeps what a smaller one took. Documents are never sorted.

    The hash is md5 of the doc_id, a colon and the text (nulls: empty), so reruns agree and rows that repeat in full
    are taken or left together. Null sources are one source, the last; a null text has size 0, and a document of
    size 0 takes nothing. A source without words has target 0. An empty table gives an empty result. Other columns
    are ignored, whatever their names. Sources are joined as a table; a hot source is only summed and joined.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.put(_coded(docs, text, id_col, source), "sizes")
    known = thresholds(rows, scratch, budget, weights, most)
    out = rows.join(known, F.col("_source").eqNullSafe(F.col("s")))
    return out.select(
        F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_source").alias("source"), "source_size", "target",
        (F.col("_size") * _times()).alias("taken"), F.when(F.col("_size") > 0, _times()).otherwise(0).cast("int").alias("copies"),
    )


def mixed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", budget: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """The rows of docs that mix() takes, each as often as it is taken, with their own columns. Rows without words go."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.put(_coded(docs, text, id_col, source), "sizes")
    known = scratch.put(thresholds(rows, scratch, budget, weights, most), "thresholds")
    every = _coded(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text, id_col, source), text, id_col, source, "_row")
    taken = every.where("_size > 0").join(known, F.col("_source").eqNullSafe(F.col("s"))).withColumn("_times", _times().cast("int"))
    taken = taken.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    return taken.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def _times():
    return F.col("copies") + F.when(F.col("_h") < F.col("threshold"), 1).otherwise(0)
