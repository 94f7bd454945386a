"""URL filters: host and path rules, and redirect equivalence over whole page tables, in DataFrame functions only.

A page's url is judged by the longest rule that fits it. Urls that no rule fits
take the verdict of their aliases: canonical links, refresh redirects and
recorded redirects are edges between urls, connected components of these edges
are one resource, and a block decision on any member holds for all of them
unless a rule explicitly allows a member, which has precedence. A url without a
rule and without decided aliases is allowed.

Edge cases: a null url or one without ``://`` has an empty host and path, no
rule and no aliases, and is allowed; null html has no links; repeated page_ids
and urls keep their rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.components import connected_components
from weftspark.llm.shared import written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query; any others can be passed.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link tag up to its end; its attributes are read from the tag, in any order.
_LINK_TAG, _META_TAG = r"(?i)<link\s[^>]*>", r"(?i)<meta\s[^>]*>"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(_ascii_lower(after), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """A url as a node: scheme and host lower-cased, no fragment; null without ``://``."""
    scheme = _ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), url_host(url), F.when(rest == "", "/").otherwise(rest)))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Longest counts host and path; the first wins a tie."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(range(len(rules)), key=lambda i: (len(rules[i].host) + len(rules[i].path), -i))
    for i in ordered:
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.regexp_replace(found, "^[\"']|[\"']$", "")


def _absolute(target: Column, base: Column) -> Column:
    """A link's target as a full url; links relative to a folder are resolved at the page's folder."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*[^?#]*/)", 1)
    return (
        F.when(target == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder), target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (source, target) of urls from canonical links and refresh redirects in ``pages(url, html)``."""
    tagged = pages.where(F.instr("url", "://") > 0).select(
        "url",
        F.explode(
            F.concat(
                F.transform(F.when(F.col("html").rlike("(?i)canonical"), F.regexp_extract_all("html", F.lit(_LINK_TAG), 0)).otherwise(F.array().cast("array<string>")), lambda t: F.struct(F.lit("link").alias("kind"), t.alias("tag"))),
                F.transform(F.when(F.col("html").rlike("(?i)refresh"), F.regexp_extract_all("html", F.lit(_META_TAG), 0)).otherwise(F.array().cast("array<string>")), lambda t: F.struct(F.lit("meta").alias("kind"), t.alias("tag"))),
            )
        ).alias("found"),
    )
    tag = F.col("found.tag")
    canonical = F.when((F.col("found.kind") == "link") & _attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _attribute(tag, "href"))
    moved = F.when((F.col("found.kind") == "meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), F.regexp_extract(_attribute(tag, "content"), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1))
    return tagged.select(F.col("url").alias("source"), _absolute(F.trim(F.coalesce(canonical, moved, F.lit(""))), F.col("url")).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component of every row of ``pages(page_id, url, html)``.

    ``redirects(source, target)`` holds recorded redirects, if any. ``component``
    is the smallest url key of a page's aliases, null for a page without any.
    Rules are a parameter of bounded size and become one expression; the graph is
    written and joined, never collected.
    """
    own = pages.select("page_id", "url", "html")
    edges = link_edges(own)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    keyed = edges.select(url_key(F.col("source")).alias("source"), url_key(F.col("target")).alias("target"))
    keyed = written(keyed.where("source is not null and target is not null and source <> target").distinct(), "links")
    judged = own.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_key(F.col("url")).alias("key")).withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    if keyed.isEmpty():
        return judged.select("page_id", "host", "path", "hit.rule", F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    alias = connected_components(keyed, "source", "target")
    hit = matched_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"]
    decided = alias.groupBy("component").agg(F.max((hit == "allow").cast("int")).alias("allowed"), F.max((hit == "block").cast("int")).alias("blocked"))
    decided = decided.select(F.col("component").alias("group"), F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("passed"))
    named = written(alias.join(decided, alias["component"] == decided["group"]).select("node", "component", "passed"), "aliases")
    out = judged.join(named, judged["key"] == named["node"], "left")
    return out.select("page_id", "host", "path", "hit.rule", F.coalesce("hit.verdict", "passed", F.lit("allow")).alias("verdict"), "component")


def rules_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for the verdicts of pages without aliases by links."""
    by_length = sorted(range(len(rules)), key=lambda i: (-len(rules[i].host) - len(rules[i].path), i))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(rules[i])} THEN '{value(rules[i])}'" for i in by_length)
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, {case(lambda r: r.host + r.path)} END AS rule, {case(lambda r: r.verdict)} ELSE 'allow' END AS verdict, CAST(NULL AS VARCHAR) AS component
FROM parts"""
