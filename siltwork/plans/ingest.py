"""Incremental builds of an index: documents by content digest, mails by chunk id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.adapters import HashEmbedder, check_compatible
from siltwork.functions.text import text_key
from siltwork.operators import chunking, dedup, mail
from siltwork.scratch import written
from siltwork.sources import files
from siltwork.sources.tables import ChunkTable

MANIFEST = "path string, digest string, has_text boolean"


def _placed(chunks: DataFrame, after: int) -> DataFrame:
    """Chunks with positions above all there are; they are unique, not dense."""
    return chunks.withColumn("pos", F.monotonically_increasing_id() + F.lit(after + 1))


def _last(chunks: DataFrame) -> int:
    got = chunks.agg(F.max("pos")).first()[0]
    return -1 if got is None else got


def ingest(spark: SparkSession, root: str, path: str, name: str = "documents", embedder: HashEmbedder | None = None, rebuild: bool = False) -> dict[str, int]:
    """Bring the index at path up to what lies under root; says how many files are new, changed, deleted, unchanged or without text.

    Unchanged files are neither read nor embedded again. Changed and deleted ones lose their chunks, and texts that the
    index holds already are left out before they are embedded. An index made with other embeddings is refused. The
    chunk table moves to its new version last, the manifest after it: a run that breaks off is done again by the next.
    """
    embedder = embedder or HashEmbedder()
    table, manifest_path = ChunkTable(spark, f"{path}/chunks"), f"{path}/manifest"
    old = table.open()
    if table.exists() and not rebuild:
        check_compatible(table.signature(), embedder.signature())
        manifest = spark.read.schema(MANIFEST).parquet(manifest_path)
    else:
        old, manifest = old.limit(0), spark.createDataFrame([], MANIFEST)
    found = files.digested(files.discover(spark, root))
    diff = dedup.manifest_diff(found, manifest)
    states = {r["state"]: r["count"] for r in diff.groupBy("state").count().collect()}
    fresh = found.join(diff.where("state in ('new', 'changed')").select("path"), "path", "left_semi")
    # Files are parsed once; chunks, dates and the manifest read what that gave.
    pages = written(files.read_documents(fresh).where("error is null").select("path", "digest", "page", "text"), "pages")
    readable = written(pages.where(F.trim("text") != "").select("path").distinct().withColumn("read", F.lit(True)), "readable")
    dates = files.dated(fresh)
    chunks = chunking.document_chunks(pages).withColumn("text_key", text_key(F.col("text"))).drop("pos")
    kept = old.join(diff.where("state = 'unchanged'").select("path"), "path", "left_semi")
    chunks = dedup.unseen(chunks, kept.select("text_key"), "id").join(dates, "path", "left")
    chunks = chunks.select("id", "text", "path", "page", "date", "date_source", "text_key", F.element_at(F.split("path", "/"), -1).alias("source"), F.lit(name).alias("index_name"), embedder.column(F.col("text")).alias("vector"))
    barren = fresh.select("path").join(readable, "path", "left_anti").count()
    if rebuild or not table.exists() or any(states.get(s) for s in ("new", "changed", "deleted")):
        told = found.select("path", "digest").join(readable, "path", "left").join(manifest.select("path", "has_text"), "path", "left")
        staged = f"{manifest_path}-next"
        told.select("path", "digest", F.coalesce("read", "has_text", F.lit(False)).alias("has_text")).write.mode("overwrite").parquet(staged)
        table.write(table.shaped(kept).unionByName(table.shaped(_placed(chunks, _last(kept)))), embedder.signature())
        spark.read.schema(MANIFEST).parquet(staged).write.mode("overwrite").parquet(manifest_path)
    return {s: states.get(s, 0) for s in ("new", "changed", "deleted", "unchanged")} | {"without_text": barren}


def clean(spark: SparkSession, path: str, excluded: tuple[str, ...]) -> int:
    """Apply today's exclusions and drop repetitions in place; vectors stay as they are. Says how many chunks are left."""
    table = ChunkTable(spark, f"{path}/chunks")
    rows = dedup.clean_index(table.open().drop("text_key"), excluded, "pos").drop("copies")
    table.write(rows, table.signature())
    return table.open().count()


def index_mails(messages: DataFrame, path: str, embedder: HashEmbedder | None = None, only_new: bool = True) -> dict[str, int]:
    """Append the chunks of mails that the index lacks; says how many are new and how many are stale (told, not removed).

    messages need what operators.mail.mail_chunks needs. With only_new=False the index is written anew.
    """
    spark, embedder = messages.sparkSession, embedder or HashEmbedder()
    table = ChunkTable(spark, f"{path}/chunks")
    chunks = mail.index_chunks(mail.mail_chunks(messages, ("attachment_names", "to_emails", "sender")).withColumnRenamed("thread_subject", "subject"))
    chunks = chunks.withColumn("index_name", F.lit("mail")).withColumn("mail_date", F.left("date", F.lit(10))).drop("date")
    old = table.open()
    new, stale = dedup.split_new(chunks, old) if only_new and table.exists() else (chunks, old.limit(0))
    told = {"new": new.count(), "stale": stale.count()}
    if told["new"] or not table.exists():
        rows = _placed(new.withColumn("vector", embedder.column(F.col("text"))), _last(old) if only_new else -1)
        if only_new and table.exists():
            table.append(rows, signature=embedder.signature())
        else:
            table.write(rows, embedder.signature())
    return told
