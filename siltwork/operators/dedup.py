"""Content keys, digests and snapshots: what is new, changed, gone or a repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions.text import matches_glob, text_key


def collapse_duplicates(chunks: DataFrame, order: str, text: str = "text") -> DataFrame:
    """The first row of each distinct text in order of `order`. One pre-aggregated minimum of a key; texts don't move twice."""
    keyed = chunks.withColumn("text_key", text_key(F.col(text)))
    first = keyed.groupBy("text_key").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return keyed.join(first, ["text_key", order])


def unseen(chunks: DataFrame, seen: DataFrame, order: str, text: str = "text") -> DataFrame:
    """First rows of texts that seen(text_key) lacks."""
    return collapse_duplicates(chunks, order, text).join(seen.select("text_key").distinct(), "text_key", "left_anti")


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, digest, state): unchanged, changed, new or deleted."""
    old = manifest.select("path", F.col("digest").alias("old"))
    both = files.select("path", "digest").join(old, "path", "full_outer")
    state = F.when(F.col("digest").isNull(), "deleted").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("digest"), "unchanged").otherwise("changed")
    return both.select("path", F.coalesce("digest", "old").alias("digest"), state.alias("state"))


def merge_index(old: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """Chunks after an incremental run: those of unchanged files, then those of fresh ones. Deleted and changed files lose theirs."""
    kept = old.join(diff.where("state = 'unchanged'").select("path"), "path", "left_semi")
    return kept.unionByName(fresh.join(diff.where("state in ('new', 'changed')").select("path"), "path", "left_semi"), allowMissingColumns=True)


def split_new(fresh: DataFrame, old: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Fresh rows that old lacks, and old rows that fresh lacks (stale: told, not removed)."""
    return fresh.join(old.select(key), key, "left_anti"), old.join(fresh.select(key), key, "left_anti")


def clean_index(chunks: DataFrame, excluded: tuple[str, ...], order: str, name: str = "source", text: str = "text") -> DataFrame:
    """An index under today's exclusions and without repetitions; vectors stay. An empty result is refused."""
    out = collapse_duplicates(chunks.where(~matches_glob(F.col(name), excluded)), order, text)
    if out.isEmpty():
        raise ValueError("cleaning would leave nothing")
    return out


def relabel(chunks: DataFrame, dates: DataFrame, mail: DataFrame) -> DataFrame:
    """Chunks with the dates of files(path, date, date_source) and of mails(folder, mail_date): document, then mail, then file system."""
    rows = chunks.drop("date", "date_source").join(dates, "path", "left").join(mail, "folder", "left")
    by_mail = (F.col("date_source") == "filesystem") & (F.coalesce("mail_date", F.lit("")) != "")
    return rows.withColumn("date", F.when(by_mail, F.col("mail_date")).otherwise(F.col("date"))).withColumn("date_source", F.when(by_mail, "mail").otherwise(F.col("date_source")))
