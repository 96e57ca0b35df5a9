"""Importance of mails by an ordered rule book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions.text import address_regex, stem_regex

#: A rule book: default_weight; counterparties (name, weight, match); noise; roles (match, multiplier); topics (name, match, multiplier, floor, overrides_noise); tuning.
Rules = dict


def load(path: str) -> Rules:
    """Rules from a YAML or JSON file; none if there is no file. A file that can't be read is an error."""
    import json
    import os

    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def _addressed(address: Column, patterns: list) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | address.rlike(address_regex(str(p)))
    return F.coalesce(out & (address != ""), F.lit(False))


def _stemmed(text: Column, stems: list) -> Column:
    out = F.lit(False)
    for s in stems:
        if str(s).strip():
            out = out | text.rlike(stem_regex(str(s)))
    return F.coalesce(out, F.lit(False))


def _first(rules: list[dict], fits, value) -> Column:
    """value of the first rule that fits, else null: a rule book is short, so its order is one CASE."""
    out = F.lit(None)
    for r in reversed(rules):
        out = F.when(fits(r), value(r)).otherwise(out)
    return out


def counterparty(address: Column, rules: Rules) -> tuple[Column, Column]:
    known = rules.get("counterparties") or []
    fits = lambda r: _addressed(F.lower(address), r.get("match") or [])
    name = F.coalesce(_first(known, fits, lambda r: F.lit(r.get("name"))).cast("string"), F.lit(""))
    weight = F.coalesce(_first(known, fits, lambda r: F.lit(float(r.get("weight", 0)))).cast("double"), F.lit(float(rules.get("default_weight", schema.DEFAULT_WEIGHT))))
    return name, weight


def is_noise(address: Column, rules: Rules) -> Column:
    return _addressed(F.lower(F.coalesce(address, F.lit(""))), rules.get("noise") or [])


def weight_of(address: Column, rules: Rules) -> Column:
    """From 0 to 1, for boosts."""
    if not rules:
        return F.lit(0.0)
    return F.when(is_noise(address, rules), 0.0).otherwise(counterparty(address, rules)[1] / schema.WEIGHT_SCALE)


def score(messages: DataFrame, rules: Rules, written: DataFrame | None = None) -> DataFrame:
    """Messages with score, reasons, counterparty and noise. Rows need sender_email, subject, attachments and body_preview.

    The weight of the first counterparty that fits is multiplied by the first topic and the first role that fit; bonuses
    are added for senders in written(address) and for attachments; a topic's floor comes last. Noise scores 0, unless a
    known counterparty writes on a topic that overrides it. Scores round half to even.
    """
    if not rules:
        return messages.select("*", F.lit(0).cast("long").alias("score"), F.array().cast("array<string>").alias("reasons"), F.lit("").alias("counterparty"), F.lit(False).alias("noise"))
    columns = messages.columns
    sender = F.lower(F.coalesce("sender_email", F.lit("")))
    preview = F.coalesce("body_preview", F.lit(""))
    names = F.coalesce("attachments", F.array().cast("array<string>"))
    rows = messages.withColumn("_sender", sender).withColumn("_text", F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.array_join(names, " "), preview))).withColumn("_end", F.lower(F.right(preview, F.lit(schema.SIGNATURE_CHARS))))
    topics, roles, tuning = rules.get("topics") or [], rules.get("roles") or [], rules.get("tuning") or {}
    topic = _first([t | {"no": k} for k, t in enumerate(topics)], lambda t: _stemmed(F.col("_text"), t.get("match") or []), lambda t: F.lit(t["no"])).cast("int")
    role = _first(roles, lambda r: _stemmed(F.col("_end"), r.get("match") or []), lambda r: F.lit(float(r.get("multiplier", 1)))).cast("double")
    name, weight = counterparty(F.col("_sender"), rules)
    rows = rows.withColumns({"_topic": topic, "_role": role, "_name": name, "_weight": weight, "_noise": is_noise(F.col("_sender"), rules)})

    def of_topic(value, kind: str) -> Column:
        return _first([t | {"no": k} for k, t in enumerate(topics)], lambda t: F.coalesce(F.col("_topic") == t["no"], F.lit(False)), value).cast(kind)

    rows = rows.withColumns({"_times": of_topic(lambda t: F.lit(float(t.get("multiplier", 1))), "double"), "_floor": F.coalesce(of_topic(lambda t: F.lit(float(t.get("floor", 0))), "double"), F.lit(0.0)), "_over": F.coalesce(of_topic(lambda t: F.lit(bool(t.get("overrides_noise"))), "boolean"), F.lit(False)), "_title": of_topic(lambda t: F.lit(str(t.get("name", "?"))), "string")})
    if written is not None:
        rows = rows.join(written.select(F.lower("address").alias("_sender"), F.lit(True).alias("_wrote")).distinct(), "_sender", "left")
    else:
        rows = rows.withColumn("_wrote", F.lit(None).cast("boolean"))
    rows = rows.withColumn("_drop", F.col("_noise") & ~((F.col("_name") != "") & F.col("_over")))
    mutual, attached = float(tuning.get("reciprocity_bonus", 0)), float(tuning.get("attachment_bonus", 0))
    wrote, has = F.coalesce("_wrote", F.lit(False)), F.size(names) > 0
    base = F.col("_weight") * F.coalesce("_times", F.lit(1.0)) * F.coalesce("_role", F.lit(1.0)) + F.when(wrote, mutual).otherwise(0.0) + F.when(has, attached).otherwise(0.0)
    rows = rows.withColumn("_base", base)
    low = (F.col("_floor") != 0) & (F.col("_base") < F.col("_floor"))
    whole = lambda c: F.bround(c).cast("long").cast("string")
    reasons = F.array_compact(
        F.array(
            F.concat(F.when(F.col("_name") == "", "unknown sender").otherwise(F.col("_name")), F.lit(": "), whole(F.col("_weight"))), F.when(F.col("_topic").isNotNull(), F.concat(F.lit("topic "), F.col("_title"), F.lit(": x"), F.col("_times").cast("string"))),
            F.when(F.col("_role").isNotNull(), F.concat(F.lit("role in the signature: x"), F.col("_role").cast("string"))), F.when(wrote, F.lit(f"written to before: +{mutual:.0f}")), F.when(has, F.lit(f"attachments: +{attached:.0f}")),
            F.when(low, F.concat(F.lit("floor of the topic: "), whole(F.col("_floor")))),
        )
    )
    return rows.select(
        *columns, F.when(F.col("_drop"), 0).otherwise(F.bround(F.when(low, F.col("_floor")).otherwise(F.col("_base")))).cast("long").alias("score"),
        F.when(F.col("_drop"), F.array(F.lit("in the noise list"))).otherwise(reasons).alias("reasons"), F.when(F.col("_drop"), "").otherwise(F.col("_name")).alias("counterparty"), F.col("_drop").alias("noise"),
    )


def digest(scored: DataFrame, limit: int = 20, most: int = schema.PER_COUNTERPARTY) -> DataFrame:
    """The best limit rows by score, newest first among equals, at most `most` of a counterparty (of a sender, if unknown); no noise.

    hidden counts the rows of a counterparty that the cap leaves out.
    """
    key = F.when(F.col("counterparty") != "", F.col("counterparty")).otherwise(F.coalesce(F.when(F.col("sender_email") != "", F.col("sender_email")), F.lit("?")))
    order = [F.col("score").desc(), F.col("date").desc_nulls_last(), F.col("message_id")]
    rows = scored.where(~F.col("noise")).withColumn("party", key)
    own = Window.partitionBy("party").orderBy(*order)
    kept = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most).orderBy(*order).limit(limit)
    counted = rows.groupBy("party").agg(F.count("*").alias("total"))
    return kept.join(counted, "party").withColumn("hidden", F.col("total") - F.least(F.col("total"), F.lit(most))).drop("total", "nth")
