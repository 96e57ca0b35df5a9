"""URL filters whose block decisions reach aliases over redirect and canonical-link edges. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, connected_components, lower_ascii


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a page in the graph: host, path without its last slash, and query; null without a host."""
    rest = F.concat(F.regexp_replace(path_of(url), "/$", ""), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1))
    host = host_of(url)
    return F.concat(F.when(host != "", host), rest)


def absolute(href: Column, base: Column) -> Column:
    """href as an absolute url, seen from the page base."""
    site = F.regexp_extract(base, "(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, "(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^[^:/?#]*:", 0), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href != "", F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (src, dst) between the nodes of pages and of their canonical links and meta refreshes."""
    page = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("html").rlike("(?i)canonical|http-equiv"))
    link = F.regexp_extract("html", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    meta = F.regexp_extract("html", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    targets = F.array(F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), F.regexp_extract(meta, r"(?is)\burl\s*=\s*['\"]?\s*([^\"'\s>;]+)", 1))
    found = page.select("url", F.explode(targets).alias("href")).where("href <> ''")
    found = found.select("url", absolute(F.col("href"), F.col("url")).alias("to"))
    return found.select(node_of(F.col("url")).alias("src"), node_of(F.col("to")).alias("dst")).where("src is not null and dst is not null")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule, verdict, rule_no) from (verdict, host/path) pairs."""
    if not rules:
        rules = [("allow", "")]  # fits no host
    parts = [(v, r, r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in rules]
    rows = F.array(*[F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(r).alias("rule"), F.lit(v).alias("rule_verdict"), F.lit(k).alias("rule_no")) for k, (v, r, h, p) in enumerate(parts)])
    return spark.range(1).select(F.inline(rows))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per page: the keep columns, host, path, rule, verdict, and reason (rule, alias or default).

    A rule names a host, which stands for its subdomains too, and the start of a path; the longest rule that fits
    decides (of equally long ones the first). A page that no rule fits takes part in redirect equivalence:
    canonical links and meta refreshes of html, and the urls of redirects(src, dst) if given, are edges between
    pages. Within a connected component a blocked page blocks the pages that no rule fits, unless the component
    holds an explicitly allowed page: explicit allows win, over their own page always and over their aliases'
    inherited blocks. All else is allowed.

    A null url, or one without ://, has empty host and path, fits no rule and has no alias: allow. Null html has no
    links. Repeated rows are each judged. An empty table gives an empty result. Columns besides url, html and keep
    are ignored, whatever their names. Rules may be a table of any size: distinct hosts are matched to them by
    equi-joins on host suffixes, so pages are never multiplied; a hot host or alias target is joined by
    joins that adaptive execution splits.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    page = pages.select(F.struct(*keep).alias("kept"), F.col(url).alias("url")).select("kept", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))

    hosts = page.where("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(table, "rule_host")
    fits = fits.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("long"), (-F.col("rule_no")).alias("first"), "rule", "rule_path", "rule_verdict")).alias("rules"))
    fits = scratch.put(fits, "hosts")  # a table of its own: only then can the join split a hot host
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    page = page.join(fits, "host", "left").withColumn("best", best)
    page = page.select("kept", "host", "path", "node", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("own"))

    edges = None if html is None else page_links(pages, url, html)
    if redirects is not None:
        given = redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src is not null and dst is not null")
        edges = given if edges is None else edges.unionByName(given)
    if edges is not None:
        edges = scratch.put(edges.where("src <> dst").distinct(), "edges")
    if edges is None or edges.isEmpty():
        marks = page.withColumn("block", F.lit(False)).withColumn("allow", F.lit(False))
    else:
        page = scratch.put(page, "pages")
        members = scratch.put(connected_components(edges, scratch).select("node", "comp"), "members")
        ruled = page.where("own is not null").groupBy("node").agg(F.max(F.col("own") == "block").alias("block"), F.max(F.col("own") == "allow").alias("allow"))
        comps = members.join(ruled, "node").groupBy("comp").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
        marks = page.join(members.join(comps, "comp").select("node", "block", "allow"), "node", "left")
    inherits = F.col("own").isNull() & F.coalesce(F.col("block") & ~F.col("allow"), F.lit(False))
    return marks.select(
        *[F.col("kept")[c].alias(c) for c in keep], "host", "path", "rule",
        F.coalesce("own", F.when(inherits, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(inherits, "alias").otherwise("default").alias("reason"),
    )
