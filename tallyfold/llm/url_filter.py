"""URL filtering with redirect equivalence.

A rule fits its host and all subdomains where the url's path starts with the rule's; the longest rule
wins. Pages whose html redirects to another url, or names another as canonical, are aliases: the
connected components of those edges. A page that no rule fits is blocked if a rule blocks one of its
aliases, unless a rule explicitly allows one of them; a rule that fits the page itself always stands.

Edges and components stay distributed; a target that a third of all pages name is one hub, which grouped
minima handle. Null urls and urls without ``://`` have an empty host and path and no rule. Null html names
no edge. Repeated rows are judged alike; of rules of equal length that fit, the last in order of verdict, host and
path wins; long html is searched whole; only the named columns are read, so others can't clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as markup
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyfold.llm.columns import LOWER, UPPER, text_or_empty
from tallyfold.operators.components import connected_components
from tallyfold.plans.storage import write_table

#: (verdict, host, path); more than MAX_RULES are joined.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_RULES = 500
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*(?:["'][^"'>]*?\burl\s*=\s*["']?|[^"'\s>]*?\burl=["']?)([^"'\s>]+)"""
ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)(;?)(?=(=?))")


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    url = text_or_empty(url)
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null without one; a list of rules as one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def met_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, r) for the distinct places that a rule of the table (verdict, host, path) fits: ``ruled`` as joins.

    A place's host names a few hosts above it; of each, only as many beginnings of the path are looked up as its rules have lengths.
    """
    rules = write_table(rules.select("verdict", F.col("host").alias("h"), F.col("path").alias("p")).distinct(), "rules")
    lengths = write_table(rules.select("h", F.length("p").alias("n")).distinct(), "rule_lengths")
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = places.select("host", "path", F.explode(above).alias("h")).join(lengths, "h").where(F.length("path") >= F.col("n"))
    met = tried.withColumn("p", F.substring(F.col("path"), F.lit(1), F.col("n"))).join(rules, ["h", "p"])
    best = F.max(F.struct((F.length("h") + F.length("p")).alias("n"), "verdict", "h", "p")).alias("b")
    return met.groupBy("host", "path").agg(best).select("host", "path", F.struct(F.concat("b.h", "b.p").alias("rule"), F.col("b.verdict").alias("verdict")).alias("r"))


def url_key(url: Column) -> Column:
    """The same for urls that differ in scheme, case of the host or fragment alone."""
    rest = url_rest(url)
    bare = F.regexp_replace(rest, r"#[\s\S]*$", "")
    return F.concat(host_of(bare), F.regexp_replace(bare, r"^[^/?]*", ""))


def resolved(target: Column, rest: Column) -> Column:
    """A link's url in full, from where it stands."""
    folder = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*", 0), r"(?<=/)[^/]*$", "")
    folder = F.when(folder.contains("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host_of(rest), target))
        .otherwise(F.concat(F.lit("http://"), folder, target))
    )


def unescaped(value: str) -> str:
    """An attribute's value without html entities; a name without semicolon before a letter, digit or ``=`` is none."""

    def one(m: re.Match) -> str:
        name, end, equals = m.groups()
        known = name.startswith("#") or (name + end in html5 and not (equals and not end))
        return markup.unescape(m[0]) if known else m[0]

    return ENTITY.sub(one, value)


@F.pandas_udf(StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(unescaped)


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): url keys that a redirect or a canonical link makes aliases; some name a page itself."""
    page = text_or_empty(F.col(html))
    found = F.array_union(F.regexp_extract_all(page, F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all(page, F.lit(REFRESH), F.lit(1)))
    links = pages.where(F.col(url).isNotNull()).select(F.col(url).cast("string").alias("url"), F.explode(found).alias("target"))
    links = links.withColumn("target", _unescaped("target"))
    links = links.withColumn("rest", url_rest(F.col("url"))).withColumn("to", resolved(F.col("target"), F.col("rest")))
    return links.select(url_key(F.col("url")).alias("src"), url_key(F.col("to")).alias("dst"))


def with_rule(rows: DataFrame, url: str, rules: tuple | DataFrame) -> DataFrame:
    """``rows`` with host, path and r, the rule that fits ``url``. Each step is used more than once, so each stands alone.

    Up to MAX_RULES rules are an expression; more, or a table of them, are joined.
    """
    rows = rows.withColumn("__tf_rest", url_rest(F.col(url)))
    rows = rows.withColumns({"host": host_of(F.col("__tf_rest")), "path": path_of(F.col("__tf_rest"))}).drop("__tf_rest")
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_RULES:
            return rows.withColumn("r", ruled(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    rows = write_table(rows, "places")
    return rows.join(write_table(met_rules(rows.select("host", "path").distinct(), rules), "met_rules"), ["host", "path"], "left")


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules: tuple | DataFrame = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and component (the aliases' least url key, null without any)."""
    edges = write_table(alias_edges(pages, url, html), "aliases").where("src <> '' AND dst <> ''")
    parts = connected_components(edges)
    seen = with_rule(parts.withColumn("at", F.concat(F.lit("http://"), F.col("node"))), "at", rules).withColumn("v", F.col("r.verdict"))
    decided = seen.groupBy("component").agg(F.max(F.col("v") == "block").alias("blocked"), F.max(F.col("v") == "allow").alias("allowed"))
    aliases = parts.join(decided, "component").select(F.col("node").alias("key"), "component", "blocked", "allowed")
    own = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url")).withColumn("key", url_key(F.col("url")))
    own = with_rule(own, "url", rules).join(aliases, "key", "left")
    by_alias = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
    return own.select(F.col("id").alias(page_id), "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_alias).alias("verdict"), "component")
