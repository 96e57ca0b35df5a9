"""Chunk tables and small state: writing, appending, copying and reading back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.adapters import check_compatible
from siltwork.functions.text import missing_sections, report_name


class ChunkTable:
    """Chunks with their vectors in one Parquet table, by index_name. Writes go to a new version; the pointer moves last."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _head(self) -> dict | None:
        fs, at = self._fs("HEAD.json")
        if not fs.exists(at):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/HEAD.json", wholetext=True).first()[0])

    def _point(self, head: dict) -> None:
        fs, at = self._fs("HEAD.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(head), "utf-8"))
        out.close()

    def exists(self) -> bool:
        return self._head() is not None

    def open(self) -> DataFrame:
        head = self._head()
        if head is None:
            return self.spark.createDataFrame([], schema.CHUNK)
        return self.spark.read.schema(schema.CHUNK).parquet(*[f"{self.path}/{p}" for p in head["parts"]])

    def signature(self) -> dict | None:
        return (self._head() or {}).get("signature")

    @staticmethod
    def shaped(chunks: DataFrame) -> DataFrame:
        have = set(chunks.columns)
        return chunks.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CHUNK.fields])

    def write(self, chunks: DataFrame, signature: dict | None = None) -> None:
        """Replace all. The old version stays readable until the new one is whole."""
        head = self._head() or {"version": 0}
        part = f"v{head['version'] + 1}"
        self.shaped(chunks).write.mode("overwrite").parquet(f"{self.path}/{part}")
        self._point({"version": head["version"] + 1, "parts": [part], "signature": signature})

    def append(self, chunks: DataFrame, offset: int | None = None, signature: dict | None = None) -> None:
        """Add rows, if the table holds offset rows and its vectors are of the same make."""
        head = self._head()
        if head is None:
            return self.write(chunks, signature)
        check_compatible(head.get("signature"), signature or head.get("signature") or {})
        if offset is not None and (held := self.open().count()) != offset:
            raise ValueError(f"the table has {held} rows, not {offset}")
        part = f"v{head['version'] + 1}"
        self.shaped(chunks).write.mode("overwrite").parquet(f"{self.path}/{part}")
        self._point(head | {"version": head["version"] + 1, "parts": [*head["parts"], part]})

    def copy(self, other: ChunkTable) -> int:
        """Another table with the same rows and vectors; says how many, after counting both."""
        rows = self.open()
        other.write(rows, self.signature())
        a, b = rows.count(), other.open().count()
        if a != b:
            raise ValueError(f"{b} of {a} rows arrived")
        return a


def merge_state(state: DataFrame, seen: DataFrame) -> DataFrame:
    """(folder, uidvalidity, last_uid) with seen's rows in place of the state's."""
    return state.join(seen.select("folder"), "folder", "left_anti").unionByName(seen)


def state_of(folders: DataFrame, state: DataFrame) -> DataFrame:
    """Each folder's mark; (null, 0) where none is known."""
    return folders.join(state, "folder", "left").select("folder", "uidvalidity", F.coalesce("last_uid", F.lit(0).cast("bigint")).alias("last_uid"))


def checked_reports(reports: DataFrame) -> DataFrame:
    """reports(filename, content) with the name to write to and what speaks against it, else an empty text."""
    missing = missing_sections(F.col("content"))
    error = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "refusing to write an empty report").when(F.size(missing) > 0, F.concat(F.lit("missing sections: "), F.array_join(missing, ", "))).otherwise("")
    return reports.select(report_name(F.col("filename")).alias("name"), "content", error.alias("error"))


def write_reports(reports: DataFrame, path: str) -> DataFrame:
    """Write the reports(filename, content) that nothing speaks against, a file each; returns (name, error) of all.

    Files are written by the executors through Hadoop's file systems, one row at a time; of equal names the last in order of
    content stays, and files of earlier calls stay if no report has their name.
    """
    spark = reports.sparkSession
    checked = checked_reports(reports)
    good = checked.where("error = ''").groupBy("name").agg(F.max("content").alias("content"))
    # A folder for each name: Spark names the files in it itself.
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        good.select(F.col("content").alias("value"), "name").repartition("name").write.mode("overwrite").option("lineSep", "\u0000").partitionBy("name").text(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    return checked.select("name", "error")


def has_reports(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and any(s.isDirectory() for s in fs.listStatus(at))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the reports under path."""
    rows = spark.read.option("basePath", path).schema("value string, name string").text(f"{path}/*", wholetext=True)
    return rows.select("name", F.regexp_replace("value", "\u0000$", "").alias("content"))


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    """(name, length in bytes) of the reports under path, by name."""
    return read_reports(spark, path).select("name", F.octet_length("content").cast("long").alias("length")).orderBy("name")
