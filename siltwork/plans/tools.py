"""Named functions over indexes and mails, called with JSON: a result as text, or an error as text."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork import schema
from siltwork.functions.text import report_name, truncate
from siltwork.operators import importance, mail
from siltwork.operators.retrieve import Filters, Retriever, citation
from siltwork.sources import tables, web


def _number(value, default: int, most: int) -> int:
    try:
        return max(1, min(int(value), most))
    except (TypeError, ValueError):
        return default


def _texts(hits: DataFrame) -> str:
    named = citation(F.col("source"), F.col("page").cast("string"), F.col("kind"), F.col("date"), F.col("score"))
    rows = hits.orderBy("rank").select(F.concat(named, F.when(F.col("weak"), " (weak)").otherwise(""), F.lit("\n"), F.col("text"))).collect()
    return "\n\n".join(r[0] for r in rows) or "Nothing found."


#: Limits of numbers, by tool and argument.
LIMITS = {("knowledge_search", "top_n"): {"minimum": 1, "maximum": 10}, ("list_mail", "limit"): {"minimum": 1, "maximum": 100}, ("web_search", "max_results"): {"minimum": 1, "maximum": 10}}


@dataclass
class Toolbox:
    """Tools over a chunk table, mails, pages and a folder of reports; a role may use some of them."""

    chunks: DataFrame | None = None
    messages: DataFrame | None = None
    pages: DataFrame | None = None
    rules: importance.Rules = field(default_factory=dict)
    own: str = ""
    roles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    reports: str | None = None

    def knowledge_search(self, query: str, top_n: int = 3, source: str = "", correspondent: str = "", since: str | None = None, until: str | None = None) -> str:
        return _texts(Retriever(self.chunks).search(query, Filters(source or "", correspondent or "", since, until), top_n=_number(top_n, 3, 10)))

    def list_mail(self, since: str | None = None, until: str | None = None, correspondent: str = "", limit: int = 20, rank: bool = False) -> str:
        n = _number(limit, 20, 100)
        rows = mail.list_messages(self.messages, since, until, correspondent or "", None if rank else n)
        if not rank:
            lines = rows.select(F.concat_ws(" | ", F.left("date", F.lit(10)), "sender_email", "subject")).collect()
            return "\n".join(r[0] for r in lines) or "No mail."
        if not self.rules:
            return "ERROR: ranking needs rules."
        written = mail.wrote_to(self.messages, self.own)
        scored = importance.score(mail.collapse_threads(rows).withColumn("body_preview", F.lit("")), self.rules, written)
        best = importance.digest(scored, n).orderBy(F.col("score").desc(), F.col("date").desc_nulls_last(), "message_id")
        return "\n".join(f"{r.score} | {(r.date or '?')[:10]} | {r.sender_email} | {r.subject} | {'; '.join(r.reasons)}" + (f" | {r.hidden} more" if r.hidden else "") for r in best.collect()) or "No mail."

    def web_search(self, query: str, max_results: int = 5) -> str:
        asked = self.pages.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
        return "\n".join(f"{r.rank}. {r.url}\n{r.snippet}" for r in web.search(self.pages, asked, _number(max_results, 5, 10)).orderBy("rank").collect()) or "Nothing found."

    def read_url(self, url: str) -> str:
        if not url.lower().startswith(("http://", "https://")):
            return f"ERROR: not an http(s) address: {url}"
        rows = web.read_urls(self.pages.where(F.col("url") == url)).collect()
        return f"Content of {rows[0].fetched}:\n\n{rows[0].text}" + (f"\n\n[{rows[0].note}]" if rows[0].note else "") if rows else f"ERROR: no page at {url}"

    def write_report(self, filename: str, content: str) -> str:
        rows = self.spark.createDataFrame([(filename, content)], "filename string, content string")
        name, error = tables.write_reports(rows, self.reports).first()
        return f"ERROR: {error}" if error else f"Report saved to {name} ({len(content)} characters)."

    def list_reports(self) -> str:
        lines = [f"- {r.name} ({r.length} bytes)" for r in tables.list_reports(self.spark, self.reports).collect()] if tables.has_reports(self.spark, self.reports) else []
        return "\n".join(["Saved reports:", *lines]) if lines else "No reports saved yet."

    def read_report(self, filename: str) -> str:
        name = self.spark.range(1).select(report_name(F.lit(filename))).first()[0]
        found = tables.read_reports(self.spark, self.reports).where(F.col("name") == name) if tables.has_reports(self.spark, self.reports) else None
        rows = found.select(truncate(F.col("content"), schema.PAGE_CHARS)).collect() if found is not None else []
        return f"Content of {name}:\n\n{rows[0][0]}" if rows else f"ERROR: {name} not found. Use list_reports to see available files."

    @property
    def spark(self):
        return SparkSession.getActiveSession()

    def schemas(self, role: str | None = None) -> list[dict]:
        """What a model is told of each tool: its name and the JSON Schema of its arguments, read from its signature."""
        kinds = {"str": "string", "int": "integer", "bool": "boolean", "str | None": "string"}
        out = []
        for name, tool in self.tools(role).items():
            given = inspect.signature(tool).parameters.values()
            properties = {p.name: {"type": kinds[str(p.annotation)]} | LIMITS.get((name, p.name), {}) | ({} if p.default in (p.empty, None, "") else {"default": p.default}) for p in given}
            out.append({"name": name, "parameters": {"type": "object", "properties": properties, "required": [p.name for p in given if p.default is p.empty]}})
        return out

    def tools(self, role: str | None = None) -> dict[str, Callable[..., str]]:
        every = {n: getattr(self, n) for n, needs in (("knowledge_search", self.chunks), ("list_mail", self.messages), ("web_search", self.pages), ("read_url", self.pages), ("write_report", self.reports), ("list_reports", self.reports), ("read_report", self.reports)) if needs is not None}
        if role is None:
            return every
        if missing := [n for n in self.roles[role] if n not in every]:
            raise KeyError(f"{role} asks for tools that there are not: {', '.join(missing)}")
        return {n: every[n] for n in self.roles[role]}

    def dispatch(self, name: str, arguments: str, role: str | None = None) -> str:
        """The tool's answer; every failure is a text that starts with ERROR."""
        tool = self.tools(role).get(name)
        if tool is None:
            return f"ERROR: unknown tool {name}"
        try:
            given = json.loads(arguments or "{}")
        except ValueError as error:
            return f"ERROR: arguments are not JSON ({error})"
        if not isinstance(given, dict):
            return "ERROR: arguments must be an object"
        try:
            return tool(**given)
        except TypeError as error:
            return f"ERROR: bad arguments for {name} ({error})"
        except Exception as error:
            return f"ERROR: {name} failed ({type(error).__name__}: {error})"
