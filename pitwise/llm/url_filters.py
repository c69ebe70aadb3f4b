"""URL filters with redirect equivalence.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; its path is the rest up to ``?`` or ``#``.  A rule
(host, path) fits its host and all subdomains if the path starts with the
rule's; the longest rule that fits wins (of two equally long, an allow rule).

Urls that no rule fits get the decision of their aliases: all canonical links
(canonical may be one of several rel values) and meta refreshes of a page are
edges between urls, with character references such as &amp; decoded.  Tags in
comments, scripts, styles, titles, text areas and templates are none; links are
relative to the page's first base.  Two urls are one node if they differ only in
scheme, fragment, an empty query, the scheme's own port, or dot segments
(host, path and rule of a page are of its url as written).  The connected components of these edges are the sets
of aliases.  A component with a url that a rule allows is allowed (explicit allow
takes precedence), else one with a blocked url is blocked, else the default
holds.  Urls that are only link targets take part with their own rules.

All steps are DataFrame operations; edges are extracted where the html is
read, so no html is shuffled.  A null url, or one without ``://``, has an empty
host and path, fits no rule and has no aliases; null or empty html has no
links; repeated rows are judged one by one.  Only page_id, url and html are
read; no rows give no rows.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.components import connected_components
from pitwise.llm.tables import let, settle

Rules = list[tuple[str, str]]  # (verdict, host + path), as ("block", "example.org/es/")

UNREAD = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|title|textarea|template)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
TAG = r"""(?is)<(?:link|meta|base)(?=[\s/])(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+>"""
VALUE = r"""("[^"]*+"|'[^']*+'|[^\s>]*+)"""
REFRESH = r"(?is)^\s*(?:[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?|[;,\s]*url\s*=\s*)(.*)$"
PIECE = r"(?is)&(?:#x[0-9a-f]{1,12}|#[0-9]{1,12}|[a-z][a-z0-9]*+);|[^&]++|&"
NAMED = "\x01".join(f"{k[:-1]}\x02{v}" for k, v in sorted(html5.items()) if k.endswith(";"))


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """path with its . and .. segments resolved."""

    def step(kept: Column, segment: Column) -> Column:
        return F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(segment == ".", kept).otherwise(
            F.concat(kept, F.array(segment)))

    segments = F.split(F.substr(path, F.lit(2)), "/")
    folder = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.concat(F.aggregate(segments, F.array().cast("array<string>"), step), folder)
    return F.when(path.rlike(r"^/(?:.*/)?\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _node(url: Column) -> Column:
    """host, path and query of an absolute url, else null: without an empty
    query, the scheme's own port, and dot segments."""
    secure = url.rlike("(?i)^https://")
    host = F.regexp_replace(host_of(url), F.when(secure, ":(?:443)?$").otherwise(":(?:80)?$"), F.lit(""))
    query = F.regexp_extract(_after(url), r"^[^/?#]*[^?#]*(\?[^#]+)?", 1)
    return F.when(host != "", F.concat(host, let(path_of(url), _without_dots), query))


def _absolute(link: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    authority = F.regexp_extract(_after(base), r"^[^/?#]*", 0)
    folder = F.regexp_extract(path_of(base), r"^(.*/)?", 0)
    return (
        F.when(link == "", None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(scheme, F.lit("://"), authority, link))
        .when(link.startswith("?"), F.concat(scheme, F.lit("://"), authority, path_of(base), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, "(?s)^[^#]*", 0), link))
        .otherwise(F.concat(scheme, F.lit("://"), authority, F.when(folder == "", "/").otherwise(folder), link))
    )


def _rule(host: Column, path: Column, rules: Rules) -> Column:
    """The longest fitting rule's text, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    out = F.lit(None).cast("string")
    for _, text in reversed(ordered):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _verdict(rule: Column, rules: Rules) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: r[0] == "allow"):
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def _unquoted(value: Column) -> Column:
    """What stands up to the closing quote of a value that begins with one."""
    return F.when(value.startswith('"'), F.regexp_extract(value, '^"([^"]*)', 1)).when(
        value.startswith("'"), F.regexp_extract(value, "^'([^']*)", 1)).otherwise(value)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, else ''; names within
    other names or values do not count."""
    others = rf"(?:[\s/]*+(?!{name}[\s=/>])[^\s=>/]++(?:\s*+=\s*+(?:{VALUE.replace('(', '(?:', 1)}))?+)*+"
    return _unquoted(F.regexp_extract(tag, rf"(?is)^<(?:link|meta|base){others}[\s/]*+{name}\s*+=\s*+{VALUE}", 1))


def _decoded(value: Column) -> Column:
    """value with its character references (named, or by number) decoded once."""
    named = F.str_to_map(F.lit(NAMED), F.lit("\x01"), F.lit("\x02"))

    def char(piece: Column) -> Column:
        body = F.regexp_extract(piece, "^&(.*);$", 1)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2))).cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        by_number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(~piece.rlike("^&.+;$"), piece).when(body.startswith("#"), by_number).otherwise(F.coalesce(F.try_element_at(named, body), piece))

    return F.when(F.instr(value, "&") > 0, F.array_join(F.transform(F.regexp_extract_all(value, F.lit(PIECE), 0), char), "")).otherwise(value)


def _link(tag: Column) -> Column:
    """The url of a canonical link or a meta refresh as written (without blanks around it), '' or null of other tags."""
    canonical = _attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    refresh = _attribute(tag, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    target = let(F.regexp_extract(_decoded(_attribute(tag, "content")), REFRESH, 1), _unquoted)
    url = F.when(tag.rlike("(?i)^<link"), F.when(canonical, _decoded(_attribute(tag, "href")))).otherwise(F.when(refresh, target))
    return _tidy(url)


def _tidy(url: Column) -> Column:
    """A url as written in a tag, without blanks around it and line ends within."""
    return F.replace(F.trim(F.translate(url, "\t\n\r\f", "")), F.lit(" "), F.lit("%20"))


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): nodes joined by a page's canonical links and meta refreshes, all of them."""
    url = F.col("url").cast("string")
    tags = pages.select(url.alias("url"), F.regexp_extract_all(F.regexp_replace(F.col("html").cast("string"), UNREAD, " "), F.lit(TAG), 0).alias("tags"))
    tags = tags.filter(F.exists("tags", lambda t: t.rlike("(?i)canonical|refresh|&")))
    bases = F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: _tidy(_decoded(_attribute(t, "href"))))
    base = F.get(F.filter(bases, lambda b: b != ""), F.lit(0))
    rows = tags.select("url", "tags", base.alias("base")).select(
        "url", F.coalesce(_absolute(F.col("base"), F.col("url")), "url").alias("base"), F.explode("tags").alias("tag"))
    found = rows.select("url", "base", _link(F.col("tag")).alias("link")).filter("link <> ''")
    # a column of its own, so that it is evaluated once
    found = found.select("url", _absolute(F.col("link"), F.col("base")).alias("target"))
    return found.select(_node(F.col("url")).alias("u"), _node(F.col("target")).alias("v")).filter("u <> v").distinct()


def judge(pages: DataFrame, rules: Rules, default: str = "allow") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict and alias (whether aliases decided)."""
    edges = settle(link_edges(pages), "url-edges")
    parts = connected_components(edges)
    bare = F.concat(F.lit("x://"), F.col("node"))
    ruled = parts.select("node", "component", _rule(host_of(bare), path_of(bare), rules).alias("rule"))
    votes = ruled.select("component", _verdict(F.col("rule"), rules).alias("v")).groupBy("component").agg(
        F.max((F.col("v") == "allow").cast("int")).alias("allow"), F.max((F.col("v") == "block").cast("int")).alias("block"))
    decided = votes.select("component", F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").alias("decision")).filter("decision is not null")
    aliases = ruled.join(decided, "component").select("node", "decision")
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), _node(url).alias("node"))
    rows = rows.select("page_id", "host", "path", "node", F.when(F.col("host") != "", _rule(F.col("host"), F.col("path"), rules)).alias("rule"))
    return rows.join(aliases, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(_verdict(F.col("rule"), rules), "decision", F.lit(default)).alias("verdict"),
        (F.col("rule").isNull() & F.col("decision").isNotNull()).alias("alias"))
