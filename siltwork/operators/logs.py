"""Conversation logs, line scans, rates, costs and checked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork import schema


def hoist_system(turns: DataFrame) -> DataFrame:
    """(conv_id, system, turns): all system texts of a conversation joined by blank lines, and how many other turns it has."""
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))), lambda x: x["text"])
    return turns.groupBy("conv_id").agg(F.array_join(texts, "\n\n").alias("system"), F.count_if(F.col("role") != "system").alias("turns"))


def merge_runs(turns: DataFrame) -> DataFrame:
    """(conv_id, run, role, turns, text): consecutive turns of one role as one, system turns and empty ones left out first."""
    rows = turns.where((F.col("role") != "system") & (F.trim("text") != ""))
    order = Window.partitionBy("conv_id").orderBy("turn")
    change = F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1))
    rows = rows.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("conv_id", "run", "role").agg(F.count("*").alias("turns"), text.alias("text"))


def scan_names(lines: DataFrame, names: list[str], line: str = "line") -> DataFrame:
    """Lines with the first name (in the list's order) that begins a word in them; others are left out."""
    found = F.lit(None).cast("string")
    for name in reversed(names):
        found = F.when(F.col(line).rlike(r"(?iuU)\b\Q" + name + r"\E"), name).otherwise(found)
    return lines.withColumn("name", found).where("name is not null")


def request_rate(log: DataFrame, since: str, batch: int = schema.BATCH_COUNT, line: str = "value") -> DataFrame:
    """One row: embedding requests of a log since a time (HH:MM:SS in brackets), the chunks they stand for, and chunks a second."""
    at = F.regexp_extract(line, r"\[?(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)", 1)
    rows = log.where(F.col(line).rlike("POST .*embed")).withColumn("at", F.to_timestamp(F.replace(at, F.lit("T"), F.lit(" ")))).where(F.col("at") >= F.lit(since).cast("timestamp"))
    n, seconds = F.count("*"), F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))
    return rows.agg(n.alias("requests"), (n * batch).alias("chunks"), F.round(n * batch / F.greatest(seconds, F.lit(1)), 6).alias("rate"))


def cost(n: Column) -> tuple[Column, Column]:
    """Seconds that n new mails take, and how to say it: seconds below 90, at least 5; else minutes."""
    seconds = n / schema.MESSAGES_A_SECOND + schema.PIPELINE_SECONDS + n * schema.CHUNKS_A_MESSAGE / schema.CHUNKS_A_SECOND
    said = F.when(seconds < 90, F.concat(F.greatest(F.lit(5), F.bround(seconds).cast("int")).cast("string"), F.lit(" s"))).otherwise(F.concat(F.bround(seconds / 60).cast("int").cast("string"), F.lit(" min")))
    return seconds, said


def index_need(n: Column, dim: Column, text_bytes: Column) -> Column:
    """GiB that an index takes."""
    return (dim * n * 4 + 3 * text_bytes) / float(1 << 30)


def assess(need: Column, available: Column, download: Column | None = None, disk: Column | None = None) -> Column:
    out = F.when(need > available, "insufficient").when(need > schema.TIGHT * available, "tight").otherwise("ok")
    return out if download is None else F.when(download > disk, "insufficient").otherwise(out)


def parse_record(c: Column, kind: T.StructType, enums: dict[str, tuple[str, ...]] | None = None) -> tuple[Column, Column]:
    """A typed record from JSON, or null, and its problems: not JSON, missing fields, values outside an enumeration (six at most)."""
    record = F.from_json(c, kind, {"mode": "PERMISSIVE"})
    raw = F.try_parse_json(c)
    problems = [F.when(raw.isNull(), "not JSON")]
    for f in kind.fields:
        problems.append(F.when(raw.isNotNull() & record[f.name].isNull(), f"{f.name}: missing or of another type"))
    for name, allowed in (enums or {}).items():
        problems.append(F.when(record[name].isNotNull() & ~record[name].isin(*allowed), F.concat(F.lit(f"{name}: "), record[name], F.lit(" is not one of " + ", ".join(allowed)))))
    told = F.slice(F.array_compact(F.array(*problems)), 1, 6)
    return F.when(F.size(told) == 0, record), told


def sections_text(pairs: list[tuple[str, Column]]) -> Column:
    """Lists under headings, those that are empty left out."""
    parts = [F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{t}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"))) for t, c in pairs]
    return F.concat_ws("\n\n", *parts)


def usage(calls: DataFrame) -> DataFrame:
    """(agent, calls, tokens)."""
    return calls.groupBy("agent").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def revisions(verdicts: DataFrame, most: int = schema.MAX_REVISIONS) -> DataFrame:
    """Rounds (goal, round, verdict) up to the first approval, or to the revision that passes the limit."""
    order = Window.partitionBy("goal").orderBy("round")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    approved = F.coalesce(F.max((F.col("verdict") == "APPROVE").cast("int")).over(before), F.lit(0))
    revised = F.coalesce(F.sum((F.col("verdict") == "REVISE").cast("int")).over(before), F.lit(0))
    return verdicts.withColumn("_a", approved).withColumn("_r", revised).where((F.col("_a") == 0) & (F.col("_r") <= most)).drop("_a", "_r")


def meta(line: Column) -> Column:
    """UID, thread id and labels of a server's answer line."""
    return F.struct(
        F.coalesce(F.regexp_extract(line, r"UID (\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("uid"), F.regexp_extract(line, r"X-GM-THRID (\d+)", 1).alias("thread_id"),
        F.filter(F.transform(F.split(F.regexp_extract(line, r"X-GM-LABELS \(([^)]*)\)", 1), r"\s+"), lambda x: F.regexp_replace(x, '^"+|"+$', "")), lambda x: x != "").alias("labels"),
    )



def folders(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name, flags) of a server's folder list."""
    pattern = r'\(([^)]*)\)\s+"[^"]*"\s+("[^"]*"|\S+)'
    rows = lines.where(F.col(line).rlike("^" + pattern))
    return rows.select(F.regexp_replace(F.regexp_extract(line, pattern, 2), '^"|"$', "").alias("name"), F.filter(F.split(F.regexp_extract(line, pattern, 1), r"\s+"), lambda x: x != "").alias("flags"))


def resolve_folders(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(item, name): a flag's folder on this server, null if none has it; other items name themselves."""
    flags = known.select(F.explode("flags").alias("flag"), F.col("name").alias("real")).select(F.lower("flag").alias("flag"), "real")
    rows = wanted.join(flags, F.lower("item") == F.col("flag"), "left")
    return rows.select("item", F.when(F.col("item").startswith("\\"), F.col("real")).otherwise(F.col("item")).alias("name"))


def count_new(mails: DataFrame, state: DataFrame) -> DataFrame:
    """(folder, new): mails(folder, uidvalidity, uid) above the folder's mark; null where the folder's validity has changed."""
    rows = mails.join(state.select("folder", F.col("uidvalidity").alias("known"), "last_uid"), "folder", "left")
    changed = F.max(F.coalesce(F.col("known") != F.col("uidvalidity"), F.lit(False)))
    return rows.groupBy("folder").agg(F.when(changed, None).otherwise(F.count_if(F.col("uid") > F.coalesce("last_uid", F.lit(0)))).alias("new"))
