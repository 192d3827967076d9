"""URL filters with redirect equivalence, in DataFrame operations only.

A rule (action, host, path) fits its host and all subdomains if the url's path starts with the
rule's path; the longest fitting rule wins. Urls that no rule decides take the verdict of the
pages they are equivalent to: connected components over redirect (``http-equiv="refresh"``) and
canonical-link edges found in the html spread block decisions to aliases. A component is blocked if
a rule blocks one of its pages, by its url as it is written, or a url in it that no page has. An explicit allow rule
on a url always wins over what its component says; without either, a url is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
has no aliases; a null html gives no edge; of fitting rules equally long, the one with the longer
host wins, then block before allow; repeated pages are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.components import components, spread

#: A bound on the rules that are planned as expressions; larger lists are joined by host suffix.
MOST_INLINE_RULES = 200
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
# The letters whose case a host ignores.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.translate(F.regexp_extract(url, _AFTER, 1), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, _AFTER, 2)).otherwise("")


def ranked(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first; rules are (action, host, path)."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1] + r[2]))


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and action for rows with host and path; both null where no rule fits."""
    if len(rules) > MOST_INLINE_RULES:
        return _joined_rule(rows, rules)
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in reversed(ranked(rules)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, action = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(action)
    return rows.withColumn("rule", rule).withColumn("action", action)


def _joined_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Each distinct (host, path) looks up all its host suffixes; linear in the urls."""
    order = [(i, k, h, p) for i, (k, h, p) in enumerate(ranked(rules))]
    table = rows.sparkSession.createDataFrame(order, "rank int, action string, rule_host string, rule_path string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    urls = rows.select("host", "path").distinct()
    found = urls.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = found.groupBy("host", "path").agg(F.min(F.struct("rank", F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("best"))
    return rows.join(best.select("host", "path", "best.rule", "best.action"), ["host", "path"], "left")


_SITE, _QUERY = r"^([^:/?#]+://[^/?#]*)", r"^[^?#]*(\?[^#]*)"
_PATH_OF = r"^[^:/?#]+://[^/?#]*([^?#]*)"
_SPACE = r"[ \t\n\f\r]"
#: An attribute: its name, and a value in double, single or no quotes.
_ATTRIBUTE = r"""[^\s"'>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
#: What is looked at of a page: comments, which hold no tags, and link, meta and base tags, whose quoted values may hold any mark.
_TAG = r"""(?is)<!--.*?(?:-->|$)|<(?:link|meta|base)(?=[\s/>])(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
# The character references by name that urls may hold.
_NAMED = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("amp", "&")]


def normal(url: Column) -> Column:
    """One form for urls that name one page: scheme and host in lower case, no fragment, no dot segments; null without scheme and host."""
    path = F.regexp_extract(url, _PATH_OF, 1)
    path = F.when(path == "", "/").otherwise(path)
    parts = F.split(path, "/")
    walked = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.lit(""), lambda a, s: F.when(s == "..", F.regexp_replace(a, "/[^/]*$", "")).when(s == ".", a).otherwise(F.concat(a, F.lit("/"), s)))
    walked = F.concat(walked, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    site = F.translate(F.regexp_extract(url, _SITE, 1), _UPPER, _LOWER)
    return F.when(url.rlike(_SITE), F.concat(site, walked, F.regexp_extract(url, _QUERY, 1)))


def resolved(base: Column, link: Column) -> Column:
    """The url that a link on a page at ``base`` leads to; null for a link to the page itself."""
    site, path = F.regexp_extract(base, _SITE, 1), F.regexp_extract(base, _PATH_OF, 1)
    folder = F.concat(F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "[^/]+$", ""), "^/+", "")), "/+$", ""), F.lit("/"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when((link != "") & ~link.startswith("#"), F.concat(site, folder, link))
    )


def unescaped(x: Column) -> Column:
    """A value without character references: decimal and hexadecimal ones, and those by the names of ``_NAMED``; others stay."""
    marks = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?"
    code = lambda m: F.when(m.rlike("^&#[xX]"), F.conv(F.regexp_extract(m, "([0-9a-fA-F]+);?$", 1), 16, 10)).otherwise(F.regexp_extract(m, "([0-9]+)", 1)).cast("long")
    fits = lambda c: (c > 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF)
    shown = lambda m: F.coalesce(F.get(F.transform(F.array(code(m)), lambda c: F.when(fits(c), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))), F.lit(0)), m)
    numbers = F.zip_with(F.split(x, marks, -1), F.regexp_extract_all(x, F.lit(marks), 0), lambda gap, m: F.concat(gap, F.coalesce(shown(m), F.lit(""))))
    x = F.array_join(numbers, "")
    for name, mark in _NAMED:  # the mark of all others last
        x = F.replace(x, F.lit(f"&{name};"), F.lit(mark))
    return x


def _value(attributes: Column, name: str) -> Column:
    """The value, as it is written, of the first of a tag's attributes with that name; null without one."""
    own = F.get(F.filter(attributes, lambda x: F.lower(F.regexp_extract(x, r"^([^\s=]+)", 1)) == name), F.lit(0))
    return F.regexp_replace(own, r"""^[^\s=]+\s*=\s*["']?|["']$""", "")


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once whatever reads it: a generator stands between."""
    keep = rows.columns
    return rows.select(*keep, F.explode(F.array(F.struct(*columns))).alias("_new")).select(*keep, "_new.*")


def _jump(content: Column) -> Column:
    """The url of a refresh, maybe in quotes: after a number and a mark, with or without ``url=``."""
    return F.regexp_extract(content, r"(?is)^\s*+[0-9.]++\s*+[;,\s]\s*+(?:url\s*+=\s*+)?(.+)$", 1)


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(url, target)`` in normal form for each canonical link or redirect in the html.

    A page is read once, for its tags; comments are none. Relative targets are resolved against the
    first ``<base>`` with a url, if the page has one, and the page's url. ``rel`` may hold several words.
    """
    marked = pages.filter(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", "html")
    kind = lambda t: F.lower(F.substring(t, 2, 4))
    attributes = lambda t: F.regexp_extract_all(t, F.lit(_ATTRIBUTE), 0)
    trimmed = lambda x: F.regexp_replace(x, rf"^{_SPACE}+|{_SPACE}+$", "")
    found = _once(marked, F.filter(F.regexp_extract_all("html", F.lit(_TAG), 0), lambda t: ~t.startswith("<!--")).alias("tags")).drop("html")
    grounds = F.filter(F.transform(F.filter("tags", lambda t: kind(t) == "base"), lambda t: _value(attributes(t), "href")), lambda x: x.rlike(r"\S"))
    found = _once(found, F.get(grounds, F.lit(0)).alias("ground"))
    found = _once(found, trimmed(unescaped(F.col("ground"))).alias("link"))
    found = _once(found, F.coalesce(resolved(F.col("url"), F.col("link")), "url").alias("base")).select("url", "base", F.explode("tags").alias("tag"))
    tags = _once(found.filter(kind(F.col("tag")) != "base"), attributes(F.col("tag")).alias("own"))
    tags = _once(tags, *[_value(F.col("own"), n).alias(n.replace("-", "_")) for n in ("rel", "href", "http-equiv", "content")])
    names = F.array_contains(F.split(F.lower("rel"), rf"{_SPACE}+"), "canonical")
    told = F.when((kind(F.col("tag")) == "link") & names, F.col("href")).when((kind(F.col("tag")) == "meta") & (F.lower("http_equiv") == "refresh"), _jump(F.col("content")))
    links = _once(tags, unescaped(told).alias("told")).filter("told <> ''").select("url", "base", "told")
    quote = F.substring("told", 1, 1)
    bare = F.when(quote.isin('"', "'"), F.split_part(F.substring(F.col("told"), F.lit(2), F.length("told")), quote, F.lit(1))).otherwise(F.col("told"))
    links = _once(links, trimmed(bare).alias("link"))
    links = _once(links, resolved(F.col("base"), F.col("link")).alias("target")).select("url", "target")
    return links.select(normal(F.col("url")).alias("url"), normal(F.col("target")).alias("target")).filter(F.col("url") != F.col("target")).distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and whether an alias decided it.

    ``edges`` (url, target) may add redirects that a crawler has logged.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(normal(F.col("url")).alias("url"), normal(F.col("target")).alias("target")))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = with_rule(rows, rules)
    # urls that only differ in form are one node
    known = rows.withColumn("node", normal(F.col("url")))
    roots = components(links.select(F.col("url").alias("a"), F.col("target").alias("b")))
    unseen = with_rule(roots.select("node", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    bad = known.filter("action = 'block' and node is not null").select("node").unionByName(unseen.filter("action = 'block'").select("node")).distinct()
    tops = roots.join(bad, "node", "left_semi").select("root").distinct()
    aliases = spread(roots, tops, ["root"], "node", "left_semi").select("node", F.lit(True).alias("by"))
    rows = spread(known.withColumn("row", F.monotonically_increasing_id()), aliases, ["node"], "row", "left")
    by_alias = F.col("action").isNull() & F.coalesce("by", F.lit(False))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(by_alias, "block").otherwise("allow")).alias("verdict"), by_alias.alias("by_alias"))
