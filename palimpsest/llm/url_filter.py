"""URL block lists whose decisions reach redirect and canonical aliases. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, components, cut, table

#: (verdict, host and path prefix); the list is short and goes into the plan as literals.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """A url without its fragment and its utm_ parameters, with scheme and host in lower case."""
    u = F.regexp_replace(url, r"(?s)#.*$", "")
    u = F.regexp_replace(F.regexp_replace(u, r"([?&])utm_[^&]*(?=&|$)", "$1"), r"&(?=&|$)|(?<=\?)&+|\?&*$", "")
    head = F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(ascii_lower(head), F.substring(u, F.length(head) + 1, F.length(u)))


def links_of(pages: DataFrame) -> DataFrame:
    """(a, b): canonical urls that a page declares to be one, by rel=canonical, a refresh redirect or its own url's form."""
    html = F.col("html")
    tag = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    found = F.array(
        F.when(html.contains("canonical"), F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.when(F.lower(html).contains("refresh"), F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    to = F.col("to")
    origin = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    full = F.when(to.startswith("//"), F.concat(F.regexp_extract("url", r"^([^:]*:)", 1), to)).when(to.startswith("/"), F.concat(origin, to)).when(to.contains("://"), to)
    return pages.select("url", F.explode(found).alias("to")).where("to <> ''").select(canonical(F.col("url")).alias("a"), canonical(full).alias("b")).where("a is not null and b is not null and a <> b")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and root for every row of pages(page_id, url, html).

    A url's own rule decides first, so an explicit allow stands whatever its aliases are. Urls without a rule take the
    decision of their alias group: all pages of one canonical form, and all forms that redirects and canonical links
    connect. A group is allowed if a rule allows one of its urls, else blocked if a rule blocks one, else allowed.
    links(a, b) are further pairs of aliases, say of a crawler's redirects.

    Null url, or none with ://: empty host and path, no rule, allow. Repeated rows give repeated results; other columns
    are ignored.
    """
    rules = RULES if rules is None else rules
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = links_of(p)
    if links is not None:
        edges = edges.union(links.select(canonical(F.col("a").cast("string")), canonical(F.col("b").cast("string"))).toDF("a", "b").where("a is not null and b is not null and a <> b"))
    groups = components(edges)
    judged = p.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("m", matched(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "url", canonical(F.col("url")).alias("node"), "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("own"))
    # Forms that only an edge names are judged too: a redirect to a blocked site is blocked though the site has no page.
    named = groups.select("node").select("node", matched(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"].alias("own"))
    said = judged.select("node", "own").union(named).where("own is not null").groupBy("node").agg(F.max(F.col("own") == "allow").alias("allow"))
    roots = groups.select("node", "root")
    at = F.coalesce("root", "node")
    of_group = said.join(roots, "node", "left").groupBy(at.alias("root")).agg(F.max("allow").alias("allow"))
    # A row for each form: decisions by form, through its root where it has one.
    forms = judged.where("own is null and node is not null").select("node").distinct().join(roots, "node", "left").select("node", at.alias("root"))
    decided = cut(forms.join(of_group, "root").select("node", "root", "allow"), "decided")
    out = judged.join(decided, "node", "left")
    verdict = F.coalesce("own", F.when(~F.col("allow"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("root", "node").alias("root"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("root")
