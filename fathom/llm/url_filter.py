"""URL filters with redirect equivalence.

A URL takes the verdict of the longest rule that fits it. Redirects (meta refresh) and canonical links found in the
pages bind URLs into aliases; connected components over these edges carry a block to aliases that no rule names. A rule
of the URL's own always wins, and an explicit allow anywhere among the aliases wins over a block.

Edge cases: a null URL, or one without ://, has an empty host and path, fits no rule and has no aliases: allow. A null
html has no links. Of rules of one length the one that sorts last wins. Pages of any length are searched whole by Spark's
own functions. Repeated rows are judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import same, staged
from .components import components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its segments . and .. carried out."""
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    whole = F.regexp_replace(path, r"(?s)(/\.\.?)$", "$1/")  # a last segment of dots is a folder
    made = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.substr(whole, F.lit(2)), "/"), F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"(?s)/\.\.?(/|$)"), made).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL without its scheme, fragment and dot segments, which lead to the same page; null if it has no host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), without_dots(path_of(url)), query_of(url)))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null. Rules are a parameter, so they are literals."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path, r.verdict)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def resolved(target: Column, url: Column) -> Column:
    """The URL, of any scheme, that a link of the page at url leads to; null for a link to the page itself."""
    base = F.concat(F.lit("x://"), host_of(url))
    folder = F.concat(base, F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)", 1))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.startswith("?"), F.concat(base, path_of(url), target))
        .otherwise(F.concat(folder, target))
    )


def _decoded(texts: pd.Series) -> pd.Series:
    """Character references as what they stand for."""
    return texts.map(entities.unescape, na_action="ignore")


def link_edges(pages: DataFrame) -> DataFrame:
    """u, v: nodes that a canonical link or a meta refresh binds. Targets are resolved against the page's URL. What stands in
    comments, scripts, styles, text areas and titles is no link."""
    html, url = F.col("html"), F.col("url")
    shown = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)", " ")
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"), 0)
    tag = F.explode(tags).alias("tag")
    value = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    decoded = F.pandas_udf(_decoded, "string")
    attr = lambda name: F.concat(*(F.regexp_extract("tag", rf"(?is)\b{name}{value}", k) for k in (1, 2, 3)))
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(url, tag)
    found = found.select(url, F.lower(attr("rel")).alias("rel"), F.lower(attr("http-equiv")).alias("equiv"), decoded(attr("href")).alias("href"), decoded(attr("content")).alias("content"))
    target = F.when(F.array_contains(F.split("rel", r"\s+"), "canonical"), F.col("href")).when(
        F.trim("equiv") == "refresh", F.regexp_extract("content", r"(?is)url\s*=\s*['\"]?([^'\"\s]*)", 1)
    )
    links = found.select(url, F.regexp_replace(target, r"^\s+|\s+$", "").alias("target"))
    return links.select(node_of(url).alias("u"), node_of(resolved(F.col("target"), url)).alias("v")).where("u is not null and v is not null")


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_root (null without aliases); one row per page."""
    fit = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    urls = staged(urls.withColumn("fit", fit).select("page_id", "host", "path", "node", "fit.rule", F.col("fit.verdict").alias("own")), "urls")
    edges = staged(link_edges(pages), "links")
    if edges.isEmpty():
        return urls.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_root"))
    alias = staged(components(edges), "aliases")
    # Targets that are no pages themselves are judged too: their rules speak for their aliases.
    host, path = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)
    of_root = alias.withColumn("own", rule_of(host, path, rules)["verdict"]).groupBy("root").agg(
        F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed")
    )
    members = staged(of_root, "of_root").join(alias, "root").select(F.col("node").alias("alias"), "root", "blocked", "allowed")
    judged = urls.join(members, same(F.col("node"), F.col("alias")), "left")
    passed = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", passed).alias("verdict"), F.col("root").alias("alias_root"))
