"""Incremental ingestion of mails: micro-batches, a first-copy-wins table and high-water marks by folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators.mail import store_new
from siltwork.scratch import shared_folder

MAIL = "folder string, uidvalidity bigint, uid bigint, rfc_message_id string"
STATE = "folder string, uidvalidity bigint, last_uid bigint"


def fresh(mails: DataFrame, state: DataFrame, backfill: bool = False) -> DataFrame:
    """Mails above their folder's mark; all of a folder whose validity has changed, and all in a backfill."""
    known = state.select("folder", F.col("uidvalidity").alias("_v"), F.col("last_uid").alias("_u"))
    rows = mails.join(known, "folder", "left")
    above = F.col("_u").isNull() | (F.col("_v") != F.col("uidvalidity")) | (F.col("uid") > F.col("_u"))
    return (rows if backfill else rows.where(above)).drop("_v", "_u")


def advanced(state: DataFrame, mails: DataFrame) -> DataFrame:
    """Marks after mails: the largest uid of the newest validity; a mark never moves back."""
    both = state.select("folder", "uidvalidity", "last_uid").unionByName(mails.select("folder", "uidvalidity", F.col("uid").alias("last_uid")))
    newest = both.groupBy("folder", "uidvalidity").agg(F.max("last_uid").alias("last_uid"))
    seen = mails.groupBy("folder").agg(F.max("uidvalidity").alias("_now"))
    kept = newest.join(seen, "folder", "left").where(F.col("_now").isNull() | (F.col("uidvalidity") == F.col("_now")))
    return kept.select("folder", "uidvalidity", "last_uid")


class Mailbox:
    """Mails and marks as Parquet. A batch is a folder of its own under its number, so that a repeated batch replaces itself."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}") if self._has(name) else self.spark.createDataFrame([], kind)

    def _has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def mails(self) -> DataFrame:
        return self._read("mails", MAIL)

    def state(self) -> DataFrame:
        """Marks, from all mails kept: they need no file of their own and can't disagree with the mails."""
        return advanced(self.spark.createDataFrame([], STATE), self.mails())

    def before(self, number: int) -> DataFrame:
        """The mails of earlier batches; only their folders are listed and read."""
        return self.spark.read.schema(f"{MAIL}, batch bigint").parquet(f"{self.path}/mails").where(F.col("batch") < number).drop("batch") if self._has("mails") else self.spark.createDataFrame([], MAIL)

    def take(self, batch: DataFrame, number: int, above: bool = False, backfill: bool = False) -> None:
        """Write what a batch adds to the earlier ones under its number; a batch that is taken again replaces itself.

        With above, mails under their folder's mark are left out, but for a backfill, which reads them again.
        """
        stored, rows = self.before(number), batch.select("folder", "uidvalidity", "uid", "rfc_message_id")
        if above:
            rows = fresh(rows, advanced(self.spark.createDataFrame([], STATE), stored), backfill)
        store_new(rows, stored).write.mode("overwrite").parquet(f"{self.path}/mails/batch={number}")

    def follow(self, stream: DataFrame, checkpoint: str, above: bool = False, backfill: bool = False):
        """Run over all that a stream has now, batch by batch."""
        take = lambda batch, number: self.take(batch, number, above, backfill)
        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of mails, in batches of files: (folder, messages, last_uid) after all of it."""
    root = f"{shared_folder(spark)}/siltwork/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(f"{root}/source")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/source")
    mails = stream.select(F.col("event_type").alias("folder"), F.lit(1).cast("bigint").alias("uidvalidity"), F.col("event_id").alias("uid"), F.concat(F.lit("<"), "event_id", F.lit("@events>")).alias("rfc_message_id"))
    box = Mailbox(spark, f"{root}/box")
    box.follow(mails, f"{root}/checkpoint").awaitTermination()
    kept = box.mails()
    return kept.groupBy("folder").agg(F.count("*").alias("messages"), F.max("uid").alias("last_uid"))
