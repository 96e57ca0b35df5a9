"""Cleaning of mail bodies, line by line, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.text import collapse_blank_lines

# Lines that start a quotation, a signature or a disclaimer, and lines that are noise.
QUOTE_HEADERS = (
    r"^\s*On .{5,120}\s+wrote:\s*$",
    r"^\s*On .{5,120},\s*$",
    r"^\s*-{2,}\s*Original Message\s*-{2,}\s*$",
    r"^\s*_{5,}\s*$",
    r"^\s*From:\s*.+$",
    r"^\s*Sent:\s*.+$",
    r"^\s*\d{1,2}\s+\S+\s+\d{4}\s*г?\.?,?\s*.{0,80}(написал|писал)\(?а?\)?:?\s*$",
    r"^\s*От:\s*.+$",
    r"^\s*Отправлено:\s*.+$",
    r"^\s*-{2,}\s*Исходное сообщение\s*-{2,}\s*$",
    r"^\s*Кому:\s*.+$",
    r"^\s*Від:\s*.+$",
    r"^\s*Надіслано:\s*.+$",
    r"^\s*Кому:\s*.+$",
    r"^\s*\d{1,2}\s+\S+\s+\d{4}\s*р?\.?,?\s*.{0,80}(написав|писав)\(?ла?\)?:?\s*$",
    r"^\s*보낸\s*사람:\s*.+$",
    r"^\s*받는\s*사람:\s*.+$",
    r"^\s*보낸\s*날짜:\s*.+$",
)
SIGNATURES = (
    r"^--\s*$",
    r"^\s*--\s*$",
    r"^\s*—\s*$",
    r"^\s*Best regards,?\s*$",
    r"^\s*Kind regards,?\s*$",
    r"^\s*Yours (faithfully|sincerely),?\s*$",
    r"^\s*(Sincerely|Regards|Thanks|Thank you),?\s*$",
    r"^\s*С уважением,?\s*$",
    r"^\s*З повагою,?\s*$",
    r"^\s*Всего доброго,?\s*$",
    r"^\s*З найкращими побажаннями,?\s*$",
    r"^\s*감사합니다\.?\s*$",
)
MOBILE_FOOTERS = (
    r"^\s*Sent from my (iPhone|iPad|Android|Samsung|Galaxy).*$",
    r"^\s*Get Outlook for (iOS|Android).*$",
    r"^\s*Отправлено из мо(бильного|его) .*$",
    r"^\s*Надіслано з .*$",
)
DISCLAIMERS = (
    r"This (e-?mail|message) (and any attachments? )?(is|are) (confidential|intended)",
    r"CONFIDENTIALITY NOTICE",
    r"DISCLAIMER\s*:",
    r"The information contained in this (e-?mail|transmission)",
    r"If you (are not|have received) th(is|e) (e-?mail|message) in error",
    r"P(lease)?\.?\s*consider the environment before printing",
    r"Данное сообщение (и любые вложения )?(является|содержит) конфиденциальн",
    r"Это письмо и любые приложения к нему",
    r"Це повідомлення .{0,40}конфіденц",
    r"본\s*메일은",
)
NOISE = (
    r"^\s*\[cid:[^\]]+\]\s*$",
    r"^\s*<https?://\S+>\s*$",
    r"^\s*\[image:[^\]]*\]\s*$",
    r"^\s*ВНИМАНИЕ:\s*Это письмо пришло",
    r"^\s*CAUTION:\s*This email originated",
    r"^\s*EXTERNAL( EMAIL)?\s*:",
)
QUOTED = r"^\s*>+\s?"
SIGNATURE_LINES = 15


def _any(line: Column, patterns: tuple[str, ...]) -> Column:
    return line.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns))


def _cut(lines: Column, at: Column) -> Column:
    """Lines before place at (from 0); all where it is null."""
    return F.when(at.isNull(), lines).otherwise(F.slice(lines, F.lit(1), at))


def _places(lines: Column, patterns: tuple[str, ...]) -> Column:
    return F.filter(F.transform(lines, lambda line, i: F.when(_any(line, patterns), i)), lambda i: i.isNotNull())


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, line: n + F.length(line))


def clean_body(df, raw: str = "body", keep: tuple[str, ...] = ()):
    """keep, body, quoted_removed_chars, signature_removed and disclaimer_removed of each row.

    In this order: noise and mobile footers go; all from a quotation's header goes, unless that is the first line;
    quoted lines go; all from a disclaimer goes; all from the last signature mark in the last 15 lines goes.
    """
    step = df.select(*keep, F.split(F.replace(F.replace(F.coalesce(F.col(raw), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n").alias("_l"))
    step = step.select(*keep, F.filter("_l", lambda x: ~_any(x, NOISE + MOBILE_FOOTERS)).alias("_l"))
    step = step.select(*keep, "_l", F.array_min(F.filter(_places(F.col("_l"), QUOTE_HEADERS), lambda i: i > 0)).alias("_q"))
    step = step.select(*keep, _cut(F.col("_l"), F.col("_q")).alias("_k"), F.when(F.col("_q").isNotNull(), _chars(F.slice("_l", F.col("_q") + 1, F.size("_l") + 1))).otherwise(0).alias("_a"))
    step = step.select(*keep, F.filter("_k", lambda x: ~_any(x, (QUOTED,))).alias("_l"), (F.col("_a") + _chars(F.filter("_k", lambda x: _any(x, (QUOTED,))))).alias("_removed"))
    step = step.select(*keep, "_l", "_removed", F.array_min(_places(F.col("_l"), DISCLAIMERS)).alias("_d"))
    step = step.select(*keep, _cut(F.col("_l"), F.col("_d")).alias("_l"), "_removed", F.col("_d").isNotNull().alias("_disclaimer"))
    late = F.filter(_places(F.col("_l"), SIGNATURES), lambda i: i >= F.size("_l") - SIGNATURE_LINES)
    step = step.select(*keep, "_l", "_removed", "_disclaimer", F.array_max(late).alias("_s"))
    return step.select(*keep, collapse_blank_lines(F.array_join(_cut(F.col("_l"), F.col("_s")), "\n")).alias("body"), F.col("_removed").alias("quoted_removed_chars"), F.col("_s").isNotNull().alias("signature_removed"), F.col("_disclaimer").alias("disclaimer_removed"))
