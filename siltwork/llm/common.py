"""What the operators share: scratch tables, connected components and column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here counts it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: With this, the shuffle files of a write go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="siltwork-")
    return _ROOTS[app]


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Parquet tables in the shared folder. Writing one cuts the lineage and survives a lost executor.

    Tables that a result still reads live until the application ends; the others go with drop().
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.dir = spark, f"{scratch_root(spark)}/siltwork/{name}-{uuid.uuid4().hex}"
        self.labels: set[str] = set()
        atexit.register(_delete, spark, self.dir)

    def path(self, label: str) -> str:
        return f"{self.dir}/{label}"

    def put(self, df: DataFrame, label: str) -> DataFrame:
        self.labels.add(label)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # what is written is read from here on, not from its shuffles
        try:
            df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(label))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        for label in labels:
            self.labels.discard(label)
            _delete(self.spark, self.path(label))

    def keep(self, *labels: str) -> None:
        """Drop all tables but these."""
        self.drop(*(self.labels - {*labels}))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_of(c: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, comp): the smallest node that each node of edges(src, dst) can reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes. A step is one
    pre-aggregated minimum and one join that adaptive execution can split, so a hub of any degree is spread
    over tasks; the number of edges never grows. Self-loops keep a node that has no other edge.
    """
    now = edges.select(F.col("src"), F.col("dst")).where("src is not null and dst is not null")
    loops = now.where("src = dst").select(F.col("src").alias("node")).distinct()

    def put(rows: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        """The edges written, and what tells whether they have changed, seen while they are written."""
        seen = Observation()
        out = scratch.put(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), f"{label}-{k}")
        return out, (seen.get["n"], seen.get["x"])

    now, state = put(now.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), 0)
    last, k = None, 0
    while state[0] and state != last:
        last, k = state, k + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written before they are joined: only then can the join split a hub.
        least = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{label}-large")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.put(large, f"{label}-edges")
        least = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now, state = put(small, k)
        scratch.drop(f"{label}-{k - 1}")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    nodes = nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).unionByName(loops.select("node", F.col("node").alias("comp")))
    return nodes.groupBy("node").agg(F.min("comp").alias("comp"))


def hash_limit(share: float) -> int:
    """The limit that a share of all 63-bit hashes doesn't exceed."""
    return 2**63 - 1 if share >= 1 else int(share * 2**53) << 10


def bounded(df: DataFrame, bound: int, *key: str) -> DataFrame:
    """About bound rows of df (all, if fewer), chosen by the hash of their key: a bounded training sample that reruns repeat."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.shiftrightunsigned(F.xxhash64(*key), 1) < F.lit(hash_limit(bound / n)))
