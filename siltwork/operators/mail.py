"""Mails as rows: listings, threads, headers, chunks and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions.mail import clean_body
from siltwork.functions.text import detect_lang, domain_of, html_to_text, matches_glob, normalize_subject
from siltwork.operators import chunking


def store_new(fresh: DataFrame, stored: DataFrame, key: str = "rfc_message_id", order: str = "uid") -> DataFrame:
    """Rows of fresh to append: the first of each key, if stored lacks it."""
    first = fresh.groupBy(key).agg(F.min(F.struct(order, *[c for c in fresh.columns if c not in (key, order)])).alias("r"))
    rows = first.select(key, *[F.col("r")[c].alias(c) for c in fresh.columns if c != key]).select(*fresh.columns)
    return rows.join(stored.select(key), key, "left_anti")


def load_all(messages: DataFrame, since: str | None = None, limit: int | None = None, include_bulk: bool = False, exclude: tuple[str, ...] = schema.EXCLUDE_SENDERS) -> DataFrame:
    """Mails by date, those without first; the limit applies before senders are excluded."""
    rows = messages if include_bulk else messages.where(~F.col("is_bulk"))
    if since:
        rows = rows.where(F.col("date") >= since)
    rows = rows.orderBy(F.col("date").asc_nulls_first(), "message_id")
    return (rows.limit(limit) if limit else rows).where(~matches_glob(F.lower("sender_email"), exclude))


def list_messages(messages: DataFrame, since: str | None = None, until: str | None = None, correspondent: str = "", limit: int | None = 30, include_bulk: bool = False) -> DataFrame:
    """Mails of a period, newest first; dates are ISO text. The correspondent is looked for in the sender's address and in recipients as JSON, names too."""
    rows = messages
    if since:
        rows = rows.where(F.col("date") >= since)
    if until:
        rows = rows.where(F.col("date") <= (until if len(until) > 10 else until + "T23:59:59"))
    if not include_bulk:
        rows = rows.where(~F.col("is_bulk"))
    if correspondent.strip():
        parties = F.lower(F.concat_ws(" ", F.coalesce("sender_email", F.lit("")), F.coalesce("to_json", F.lit("")), F.coalesce("cc_json", F.lit(""))))
        rows = rows.where(F.contains(parties, F.lit(correspondent.strip().lower())))
    rows = rows.withColumn("subject", F.coalesce(F.when(F.col("subject") != "", F.col("subject")), F.lit("(без темы)")))
    return rows.orderBy(F.col("date").desc_nulls_last(), "message_id").limit(limit) if limit else rows


def collapse_threads(messages: DataFrame) -> DataFrame:
    """The newest mail of each thread, how many it has, and all its attachments, from the newest mail to the oldest, once each."""
    key = F.coalesce(F.when(F.col("thread_id") != "", F.col("thread_id")), F.col("message_id"))
    newest = F.struct(F.col("date").isNotNull().alias("dated"), F.col("date").alias("date"), F.col("message_id"))
    rows = messages.withColumn("_key", key).withColumn("_when", newest)
    # Ids of one date go up, as list_messages has them.
    head = Window.partitionBy("_key").orderBy(F.col("date").desc_nulls_last(), "message_id")
    rows = rows.withColumn("_n", F.row_number().over(head))
    names = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_n", "attachments"))), lambda x: x["attachments"])))
    per = rows.groupBy("_key").agg(F.count("*").alias("messages_in_thread"), names.alias("_names"))
    return rows.where("_n = 1").join(per, "_key").drop("attachments", "_when", "_n").withColumnRenamed("_names", "attachments").drop("_key")


def body_of(text: Column, html: Column) -> Column:
    """The plain body, or else the text of the html one."""
    return F.coalesce(F.when(text != "", text), html_to_text(html))


def preprocess(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Cleaned mails: body_text or else the text of body_html, without quotations, signatures and disclaimers; subject; language."""
    rows = raw.select(*keep, normalize_subject(F.col("subject")).alias("clean_subject"), body_of(F.col("body_text"), F.col("body_html")).alias("raw_body"))
    rows = clean_body(rows, "raw_body", (*keep, "clean_subject"))
    return rows.withColumn("lang", detect_lang(F.col("body")))


def in_threads(messages: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Mails with their place in the thread (by date, those without last), the thread's size, subject, dates and domains.

    Rows need thread_id, message_id, date, subject, body and emails (all participants). Mails with bodies under three
    characters are left out first.
    """
    rows = messages.where(F.length(F.trim("body")) >= schema.EMPTY_BODY) if drop_empty else messages
    order = F.struct(F.col("date").isNull().alias("undated"), "date", "message_id")
    place = Window.partitionBy("thread_id").orderBy(order)
    rows = rows.withColumn("idx", F.row_number().over(place))
    per = rows.groupBy("thread_id").agg(
        F.count("*").alias("messages"), F.min(F.when(F.col("subject") != "", F.struct("idx", "subject")))["subject"].alias("thread_subject"), F.min("date").alias("started_at"), F.max("date").alias("last_at"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.filter(F.transform("emails", domain_of), lambda d: d != ""))))).alias("thread_domains"),
    )
    return rows.join(per.withColumn("thread_subject", F.coalesce("thread_subject", F.lit(""))), "thread_id")


def threads(messages: DataFrame, drop_empty: bool = True) -> DataFrame:
    """One row per thread; the order to show them in is last_at, newest first, those without a date before all."""
    rows = in_threads(messages, drop_empty)
    first = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col("emails").alias("e")))), lambda x: F.transform(x["e"], F.lower))
    return rows.groupBy("thread_id", "thread_subject", "messages", "started_at", "last_at", "thread_domains").agg(F.array_distinct(F.flatten(first)).alias("participants"))


def context_header(subject: Column, sender: Column, to: Column, cc: Column, date: Column, idx: Column, messages: Column) -> Column:
    """What goes before a mail's text so that it can be found by its subject and its parties."""
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    more = F.when(F.size(some(to)) > 6, F.concat(F.lit(" и ещё "), (F.size(some(to)) - 6).cast("string"))).otherwise("")
    line = F.array_join(F.slice(some(to), 1, 6), ", ")
    copies = F.array_join(F.slice(some(cc), 1, 4), ", ")
    return F.concat(
        F.lit("Тема: "), F.when(F.coalesce(subject, F.lit("")) == "", "(без темы)").otherwise(subject), F.lit("\nОт: "), F.coalesce(sender, F.lit("unknown")), F.lit(" | Кому: "), F.when(line == "", "—").otherwise(line), more,
        F.when(copies == "", "").otherwise(F.concat(F.lit(" | Копия: "), copies)), F.lit("\nДата: "), F.coalesce(F.left(date, F.lit(10)), F.lit("?")), F.lit(" | Письмо "), idx.cast("string"), F.lit(" из "), messages.cast("string"), F.lit("\n---\n"),
    )


def mail_chunks(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of mails in threads: id, part_no, text with its header, snippet. Rows need in_threads' columns, sender, to and cc."""
    rows = in_threads(messages).withColumn("header", context_header(F.col("thread_subject"), F.col("sender"), F.col("to"), F.col("cc"), F.col("date"), F.col("idx"), F.col("messages")))
    own = ("message_id", "thread_id", "idx", "messages", "thread_subject", "thread_domains", "date", "header", *keep)
    parts = chunking.paragraph_chunks(rows, own, "body")
    return parts.select(
        F.sha1(F.concat_ws(":", "message_id", "pos").cast("binary")).alias("id"), *[c for c in own if c != "header"], F.col("pos").alias("part_no"), F.concat("header", "text").alias("text"), F.left("text", F.lit(200)).alias("snippet")
    )


def index_chunks(chunks: DataFrame) -> DataFrame:
    """Mail chunks in the common schema: subject as source, thread as path, place in the thread as page.

    A mail with hardly any text stays for its attachments, whose names are added, or for its recipients; else it goes.
    """
    body = F.trim(F.coalesce(F.get(F.split("text", "---", 2), F.lit(1)), F.lit("")))
    names, to = (F.coalesce(c, F.array().cast("array<string>")) for c in ("attachment_names", "to_emails"))
    short = F.length(body) < schema.MIN_BODY
    text = F.when(short & (F.size(names) > 0), F.concat(F.rtrim("text"), F.lit("\nВкладення: "), F.array_join(names, ", "))).otherwise(F.col("text"))
    rows = chunks.where(~(short & (F.size(names) == 0) & (F.size(to) == 0)))
    source = F.when(F.coalesce("subject", F.lit("")) == "", "(без темы)").otherwise(F.col("subject"))
    return rows.select("id", text.alias("text"), source.alias("source"), F.col("thread_id").alias("path"), F.coalesce("idx", F.lit(1)).alias("page"), *[c for c in chunks.columns if c not in ("id", "text", "subject", "thread_id", "idx", "source", "path", "page")])


def stats(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("messages"), F.countDistinct("thread_id").alias("threads"), F.sum(F.col("is_bulk").cast("int")).alias("bulk"), F.min("date").alias("oldest"), F.max("date").alias("newest"))


def top_domains(messages: DataFrame, n: int = 15) -> DataFrame:
    rows = messages.where(F.contains("sender_email", F.lit("@"))).groupBy(F.lower(F.expr("substring(sender_email, instr(sender_email, '@') + 1)")).alias("domain")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("n").desc(), "domain").limit(n)


def wrote_to(messages: DataFrame, own: str) -> DataFrame:
    """Distinct addresses that own wrote to."""
    return messages.where(F.lower("sender_email") == own.lower()).select(F.explode("to_emails").alias("address")).where("address <> ''").select(F.lower("address").alias("address")).distinct()


def quality_report(cleaned: DataFrame) -> DataFrame:
    """One row over rows with raw_chars, clean_chars, signature_removed and disclaimer_removed; zeros for an empty table."""
    ratio = F.col("clean_chars") / F.greatest(F.col("raw_chars"), F.lit(1))
    share = lambda c: F.round(100.0 * F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 4)
    return cleaned.agg(
        F.count("*").alias("n"), share(F.col("signature_removed")).alias("signature_pct"), share(F.col("disclaimer_removed")).alias("disclaimer_pct"),
        F.count_if(F.col("clean_chars") < schema.EMPTY_BODY).alias("empty"), F.count_if(ratio > 0.95).alias("untouched"), F.round(F.coalesce(F.avg(ratio), F.lit(0.0)), 6).alias("mean_ratio"),
    )


def metadata_by_folder(messages: DataFrame, folder: Column) -> DataFrame:
    """What an attachment's folder tells of its mail."""
    return messages.select(folder.alias("folder"), "message_id", "thread_id", F.left("date", F.lit(10)).alias("mail_date"), "sender_email", "subject").dropDuplicates(["folder"])


def folder_stats(messages: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, messages, threads, bulk) by folder."""
    return messages.groupBy(folder).agg(F.count("*").alias("messages"), F.countDistinct("thread_id").alias("threads"), F.coalesce(F.sum(F.col("is_bulk").cast("int")), F.lit(0)).alias("bulk"))


def extremes(cleaned: DataFrame, key: str, n: int = 10) -> DataFrame:
    """(end, place, key, ratio): the n rows of which cleaning left least, and the n of which it left most; ties by key."""
    ratio = cleaned.select(key, (F.col("clean_chars") / F.greatest(F.col("raw_chars"), F.lit(1))).alias("ratio"))
    ends = []
    for end, order in (("worst", F.col("ratio").asc()), ("best", F.col("ratio").desc())):
        top = ratio.orderBy(order, key).limit(n)  # n rows are left: their order is one small sort
        ends.append(top.select(F.lit(end).alias("end"), F.row_number().over(Window.orderBy(order, key)).alias("place"), key, "ratio"))
    return ends[0].unionByName(ends[1])


def before_and_after(messages: DataFrame, key: Column, text: str = "body") -> DataFrame:
    """What cleaning does to the messages that key holds for: raw text, cleaned text and what went."""
    rows = messages.where(key).withColumn("raw", F.col(text))
    return clean_body(rows, text, tuple(c for c in rows.columns if c != text))
