"""Operator 8: URL filters by redirect equivalence.

Rules name a host and a path prefix; the longest that fits a URL decides it.
A URL without a rule takes the decision of its aliases: the connected
components over redirect edges (a given table, and meta refresh) and
canonical-link edges.  In a component with an allowed member its undecided
members are allowed, else with a blocked member they are blocked, else allowed.
A URL's own rule always stands, so an explicit allow is never overridden.

Edges come from every ``link`` whose ``rel`` list has the word canonical and every
``meta`` refresh; targets are resolved as references are: against the first
``base`` of the page, schemes, ``//host``, ``/path``, ``?query`` and dot segments
included.  Those with a scheme but no ``://`` (mailto and such) are no edge.

Aliases are compared without fragment and with scheme and host in small letters;
URLs that only appear as targets take part with the rules that fit them.  A null
URL or one without ``://`` has empty host and path, no rule and no alias.
Repeated rows give repeated rows; null HTML, and null sources or targets of
redirects, have no edge.  A very long page is searched whole.  Of rules that fit
with equal length the allowing one wins.  Empty tables (of pages, or of
redirects) are no special case; further columns are not carried.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, of_rows
from .components import components

Rule = tuple[str, str, str]
#: Rules become one expression; more than this many are refused.
MOST_RULES = 1000

_VALUE = r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?:\s|/?>))[^>]*>?"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
BASE = r"(?i)<base\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*" + _VALUE
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _decided(rules: list[Rule], host: Column, path: Column, value) -> Column:
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are compiled into the query")
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow")):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        found = F.when(fits, F.lit(value(rule))) if found is None else found.when(fits, F.lit(value(rule)))
    return F.lit(None).cast("string") if found is None else found


def _straight(path: Column) -> Column:
    """A path from the root without dot segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def _absolute(base: Column, href: Column) -> Column:
    """href as seen from the page base; null if it is no web address."""
    href = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    scheme = F.lower(F.regexp_extract(base, "^([^:/?#]*)://", 1))
    site = F.concat(scheme, F.lit("://"), host(base))
    own = F.when(path(base) == "", "/").otherwise(path(base))
    asked, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)", 1)
    query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    near = F.concat(site, _straight(F.when(asked.startswith("/"), asked).otherwise(F.concat(F.regexp_replace(own, "[^/]*$", ""), asked))), rest)
    same = F.concat(site, own, F.when(rest.startswith("?"), rest).otherwise(query))
    web = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
    return web.when(href.rlike(SCHEME), F.lit(None)).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(asked == "", same).otherwise(near)


def _node(url: Column) -> Column:
    """A URL's name among aliases; null without ``://``."""
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(F.lower(F.regexp_extract(url, "^([^:/?#]*)://", 1)), F.lit("://"), host(url), rest))


def edges(pages: DataFrame) -> DataFrame:
    """a, b: each page and the URLs that it names as canonical or refreshes to."""
    html, found = F.col("html"), of_rows(pages, "url", "html").where("url is not null and html is not null")
    # A plain search first: few pages have any of these tags, and patterns are dear.
    low = F.lower(html)
    found = found.where(low.contains("canonical") | low.contains("refresh"))
    value = lambda tag: F.concat(*(F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)))
    links = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), 0), lambda t: F.when(t.rlike(HREF), value(t)))
    turns = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 0), lambda t: F.nullif(F.regexp_extract(t, TARGET, 1), F.lit("")))
    based = value(F.regexp_extract(html, BASE, 0))
    found = found.select("url", F.when(based == "", F.col("url")).otherwise(F.coalesce(_absolute(F.col("url"), based), "url")).alias("base"), F.explode(F.concat(links, turns)).alias("href")).where("href is not null")
    return found.select(_node(F.col("url")).alias("a"), _node(_absolute(F.col("base"), F.col("href"))).alias("b")).where("a <> b")


def judged(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules: (allow or block, host, path); redirects: columns source and target.
    """
    found = edges(pages)
    if redirects is not None:
        found = found.unionByName(redirects.select(_node(F.col("source")).alias("a"), _node(F.col("target")).alias("b")))
    member = components(found)
    action = _decided(rules, host(F.col("node")), path(F.col("node")), lambda r: r[0])
    shared = member.groupBy("component").agg(F.max(F.coalesce(action == "allow", F.lit(False))).alias("allowed"), F.max(F.coalesce(action == "block", F.lit(False))).alias("blocked")).where("allowed or blocked")
    shared = checkpoint(member.join(shared, "component").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("alias")))
    rows = of_rows(pages, "page_id", "url").select("page_id", _node(F.col("url")).alias("node"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumns({"rule": _decided(rules, F.col("host"), F.col("path"), lambda r: r[1] + r[2]), "own": _decided(rules, F.col("host"), F.col("path"), lambda r: r[0])})
    return rows.join(shared, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"))
