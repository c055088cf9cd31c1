"""URL filters with redirect equivalence, in SQL functions only.

A rule (host, path, verdict) fits a url whose host is the rule's host or below
it and whose path starts with the rule's; the longest fitting rule decides.
Every other url takes the decision of its aliases: urls are nodes, canonical
links (``<link rel=canonical href>``) and redirects (``<meta http-equiv=refresh
content="0; url=...">``) found in the pages are edges, and in each connected
component a url under a block rule blocks the rest, unless a url of the
component is under an allow rule.

A node is the url without scheme, fragment and tracking parameters, so the same
address written in several ways is one node.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule, is no node and is allowed; a null html has no links; relative links
resolve against their page; repeated pages and links count once; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: Query parameters that do not change the address.
TRACKING = r"(^|&)(utm_[^=&]*|gclid|fbclid|ref)=[^&]*"
TAG = r"(?i)<(?:link|meta)\s[^>]*>"
REL = r"""(?i)\srel\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def node(url: Column) -> Column:
    """Alias key of an absolute url; null where there is none."""
    host, path = split_url(url)
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, "^&", "")
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path),
                                       F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def links(html: Column) -> Column:
    """array<string>: targets of the canonical links and refresh redirects."""
    def target(tag):
        words = F.concat(*[F.regexp_extract(tag, REL, i) for i in (1, 2, 3)])
        rel = words.rlike(r"(?i)(^|\s)canonical(\s|$)")
        refresh = F.regexp_extract(tag, r"""(?i)\shttp-equiv\s*=\s*["']?\s*refresh\b""", 0) != ""
        href = F.regexp_extract(tag, r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)""", 1)
        url = F.regexp_extract(tag, r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
        return F.replace(F.when(rel, href).when(refresh, url).otherwise(F.lit("")), F.lit("&amp;"), F.lit("&"))

    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), target), lambda t: t != "")


def without_dots(url: Column) -> Column:
    """An absolute url whose path has no ``.`` and ``..`` segments."""
    root, path = (F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)([^?#]*)", i) for i in (1, 2))
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"),
                       lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1))))
                       .otherwise(F.concat(a, F.array(s))))
    end = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(root, F.array_join(kept, "/"), end, rest)).otherwise(url)


def resolve(url: Column, link: Column) -> Column:
    """``link`` as an absolute url, seen from the page ``url``; a link that only
    holds ``://`` further on is relative."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    root = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*(?:/[^?#]*)?/)[^/?#]*", 1)
    page = F.regexp_extract(url, r"^([^?#]*)", 1)
    seen = (F.when(link.startswith("/"), F.concat(root, link))
            .when(link.rlike(r"^[?#]"), F.concat(page, link))
            .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), link)))
    return (F.when(link.rlike(ABSOLUTE), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .otherwise(without_dots(seen)))


def matched(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The pages are read once: addresses, rules and link targets are written
    before the components are built.  A page whose node has no edge needs no
    join beyond its own rule."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("node"),
                       F.transform(links(F.col("html")), lambda t: node(resolve(F.col("url"), t))).alias("links"))
    rows = materialize(rows.withColumn("match", matched(F.col("host"), F.col("path"), rules)), "urls")
    edges = rows.where("node is not null").select(F.col("node").alias("a"), F.explode("links").alias("b"))
    groups = materialize(components(edges), "aliases")
    # verdicts of the nodes themselves: pages and link targets alike
    h, p = split_url(F.concat(F.lit("x://"), F.col("node")))
    by_rule = groups.withColumn("own", matched(h, p, rules)["verdict"])
    roots = by_rule.groupBy("root").agg(
        F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
    blocked = roots.where("block and not coalesce(allow, false)").select("root")
    blocked = groups.join(blocked, "root").select(F.col("node").alias("node_"), F.lit(True).alias("alias_block"))
    out = rows.drop("links").join(blocked, F.col("node") == F.col("node_"), "left")
    verdict = F.coalesce(F.col("match.verdict"), F.when(F.col("alias_block"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"))
