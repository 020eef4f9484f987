"""URL filter: host and path rules, and redirect equivalence over redirect and canonical-link edges.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest rule that
fits wins. Urls are aliases if a page's redirect (meta refresh) or canonical link leads from one to the other, fragments
aside, directly or through others: components of that graph. Within a component a block decision spreads to every url
without a rule of its own, unless a url of the component is explicitly allowed: an explicit allow goes first. A url's own
rule always decides it; without any rule in the component the default holds.

DataFrame and SQL functions only. Urls, not pages, are the nodes, so pages of one url are one node; the components
are found by partly aggregated minima (see components), so a canonical target of a third of all pages is no hot task.

Defined cases: null urls or urls without "://" have an empty host and path, fit no rule, have no aliases and get the
default; null or empty html has no links; repeated rows return a row each; relative links hold from the
page's <base>, or else its url, with dot segments removed; links of schemes without "://" (mailto:) are ignored, and so are
tags in comments and in the text of scripts, styles and titles; null page_ids return their row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import staged

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no tags: comments, and the text of these elements.
OPAQUE = r"(?is)<!--.*?(?:-->|$)|<(script|style|title|textarea)\b[^>]*>.*?(?:</\1\s*>|$)"
#: A tag; ">" may stand in a quoted value. Possessive, so that it is matched without recursion and in one pass.
TAG = r"""(?is)<{}(?=[\s/>])(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+>"""
#: An attribute of a tag: its name, then its value with or without quotes.
ATTRIBUTE = r"""(?s)[\s"'/]([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
#: A refresh's content: seconds and a separator, then the url, with or without "url=" and quotes.
CONTENT = r"""(?is)^\s*+(?:[\d.]++\s*+(?:[;,]|(?<=\s))\s*+(?:url\s*+=\s*+)?+|[\d.]*+\s*+[;,]?+\s*+url\s*+=\s*+)(?:"([^"]*+).*|'([^']*+).*|([^"'].*))$"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def decide(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for verdict, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        value = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def node(url: Column) -> Column:
    """What identifies a url: its fragment dropped, its scheme and host in lower case."""
    whole = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(whole, F.length(head) + 1))


def without_dots(rest: Column) -> Column:
    """A path, with what follows it, whose segments "." and ".." are resolved."""
    path, more = F.regexp_extract(rest, r"(?s)^/([^?#]*)", 1), F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(path, "/")
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    step = lambda kept, part: F.when(part == "..", up(kept)).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.contains(rest, F.lit("/.")), F.concat(F.lit("/"), F.array_join(closed, "/"), more)).otherwise(rest)


def resolved(base: Column, link: Column) -> Column:
    """A link as a url: absolute, or relative to the scheme, host, path or query of base; null for schemes without "://"."""
    plain = link
    at = lambda pattern: F.regexp_extract(base, pattern, 1)
    host = at(r"(?s)^(.*?://[^/?#]*)")
    folder = F.coalesce(F.nullif(at(r"(?s)^.*?://[^/?#]*(/[^?#]*/|/)"), F.lit("")), F.lit("/"))
    return (
        F.when(F.regexp_like(plain, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), plain)
        .when(F.regexp_like(plain, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")) | (plain == ""), F.lit(None))
        .when(plain.startswith("//"), F.concat(at(r"(?s)^(.*?:)//"), plain))
        .when(plain.startswith("/"), F.concat(host, without_dots(plain)))
        .when(plain.startswith("?"), F.concat(at(r"(?s)^(.*?://[^?#]*)"), plain))
        .when(plain.startswith("#"), F.concat(at(r"(?s)^([^#]*)"), plain))
        .otherwise(F.concat(host, without_dots(F.concat(folder, plain))))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes and outer space; null without one."""
    at = F.array_position(F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), F.lower), name)
    given = F.when(at > 0, F.element_at(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2), F.greatest(at, F.lit(1)).cast("int")))
    return F.replace(F.regexp_replace(given, r"""(?s)^(["'])?\s*(.*?)\s*(["'])?$""", "$2"), F.lit("&amp;"), F.lit("&"))


def refresh_url(content: Column) -> Column:
    """Where a refresh's content leads; empty without a url."""
    return F.trim(F.concat(*[F.coalesce(F.regexp_extract(content, CONTENT, i), F.lit("")) for i in (1, 2, 3)]))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): distinct edges between nodes, from each page's url to its redirect target and its canonical link."""
    marked = pages.filter("html is not null and instr(url, '://') > 0").filter(F.regexp_like("html", F.lit(r"(?i)canonical|refresh")))
    plain = marked.select("url", F.regexp_replace("html", OPAQUE, " ").alias("html"))
    tags = lambda name: F.regexp_extract_all("html", F.lit(TAG.format(name)), 0)
    canonical = lambda t: F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+"), "canonical")
    links = F.transform(F.filter(tags("link"), canonical), lambda t: attribute(t, "href"))
    metas = F.transform(F.filter(tags("meta"), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh"), lambda t: refresh_url(attribute(t, "content")))
    based = F.get(F.filter(F.transform(tags("base"), lambda t: attribute(t, "href")), lambda h: h.isNotNull()), F.lit(0))
    base = F.coalesce(resolved(F.col("url"), based), F.col("url"))
    found = plain.select("url", base.alias("base"), F.explode(F.concat(links, metas)).alias("link"))
    ends = found.select(node(F.col("url")).alias("a"), node(resolved(F.col("base"), F.col("link"))).alias("b"))
    return ends.filter("b is not null and a <> b").distinct()


def url_verdicts(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("own", decide(F.col("host"), F.col("path"), rules))
    edges = staged(alias_edges(pages))
    members = staged(connected_components(edges))
    ruled = members.withColumn("at", F.struct(*[c.alias(n) for c, n in zip(host_and_path(F.col("id")), ("host", "path"), strict=True)]))
    ruled = ruled.select("id", "component", decide(F.col("at.host"), F.col("at.path"), rules)["verdict"].alias("own"))
    spread = ruled.groupBy("component").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    spread = spread.select(
        "component",
        F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise(default).alias("spread")
    )
    aliases = members.join(spread, "component").select(F.col("id").alias("node"), "spread")
    out = judged.withColumn("node", node(F.col("url"))).join(aliases, "node", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit(default)).alias("verdict"))
