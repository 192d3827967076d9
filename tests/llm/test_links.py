"""Links of pages against Python's own html and url parsers."""

import itertools
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

from tidemark.llm import url_filter
from tidemark.llm.queries import RULES


class Links(HTMLParser):
    def __init__(self, url):
        super().__init__(convert_charrefs=True)
        self.base, self.found = None, []
        self.url = url

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "base" and self.base is None and a.get("href", "").strip():
            self.base = urljoin(self.url, a["href"].strip())
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href", "").strip():
            self.found.append(a["href"].strip())
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and ";" in a.get("content", ""):
            rest = a["content"].split(";", 1)[1].strip()
            rest = rest[3:].lstrip()[1:].lstrip() if rest.lower().startswith("url") else rest
            self.found.append(rest[1:].split(rest[0])[0] if rest[:1] in "'\"" else rest)

    handle_startendtag = handle_starttag


def form(url):
    s = urlsplit(urljoin(url, urlsplit(url).path or "/") if ".." in url or "/./" in url else url)
    query = urlsplit(url).query
    return urlunsplit((s.scheme.lower(), s.netloc.lower(), s.path or "/", query, ""))


def edges(url, html):
    parser = Links(url)
    parser.feed(html)
    return {(form(url), form(urljoin(parser.base or url, t))) for t in parser.found if t and not t.startswith("#")} - {(form(url), form(url))}


T = "http://l.org/p?a=1&b=2"
PAGES = [
    """<meta http-equiv="refresh" content="0;url='http://l.org/p'">""", """<META content='5; URL="http://l.org/q"' HTTP-EQUIV=Refresh>""", """<meta http-equiv=refresh content="0; http://l.org/r">""", """<link rel="nofollow canonical" href="/s">""",
    """<link href='/t' rel='Canonical alternate' />""", """<!-- <link rel="canonical" href="/no"> --><link rel=canonical href=/u>""", """<link rel="canonical" href="/v?x=1&#38;y=2&#x26;z=3&amp;w=4">""", """<link rel="stylesheet" href="canonical.css"><a rel="canonical" href="/no">""",
    """<base target="_top"><base href="/deep/er/"><base href="/other/"><link rel="canonical" href="w">""", """<link data-href="/no" rel="canonical" href="/x">""", """<link title="a > b" rel="canonical" href="/y">""", """<link rel="noncanonical" href="/no">""",
    """<link rel="canonical" href="">""", """<meta name="refresh" content="0;url=/no">""", """<!-- open <link rel="canonical" href="/no">""", """<linked rel="canonical" href="/no">""", """<link rel="canonical" href=" /z ">""", """<link rel='canonical' href="/it's">""", """<link
      rel = "canonical"
      href = "/lines">""", """<meta http-equiv="refresh" content="0">""", "<b>canonical refresh</b>", """<link rel="canonical" href="/a"><meta http-equiv="refresh" content="1;url=/b">""",
]


def test_edges_equal_those_of_an_html_parser(spark):
    rows = [(i, f"http://Site{i}.org/dir/page?q={i}#f", html) for i, html in enumerate(PAGES)] + [(98, "no url", PAGES[0]), (99, None, PAGES[0]), (97, "http://n.org/", None)]
    got = {(r["url"], r["target"]) for r in url_filter.alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r["url"]}
    assert got == {e for i, url, html in rows[: len(PAGES)] for e in edges(url, html)}


def test_blocks_reach_all_aliases_of_all_forms(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.net/es/../x", link.format("http://b.org/1")), (2, "http://b.org/1", ""), (3, "http://c.org/", link.format("http://b.org/./1#top")), (4, "http://a.net/x", ""),  # the page's own path is blocked, its node's is not
        (5, "http://d.com/", link.format("http://b.org/1")), (6, "http://e.org/", link.format("http://f.org/")), (7, "http://f.org/", ""), (8, "http://g.org/", link.format("http://unseen.net/fr/")), (8, "http://g.org/", None),
    ]
    got = {(r["page_id"], r["verdict"], r["by_alias"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert got == {(1, "block", False), (2, "block", True), (3, "block", True), (4, "block", True), (5, "allow", False), (6, "allow", False), (7, "allow", False), (8, "block", True)}


def test_values_without_references(spark):
    from pyspark.sql import functions as F

    texts = ["a&amp;b&#38;c&#x2F;&lt;", "&#0;&#xD800;&#9999999;", "&amp;lt;", "&#65", "", "plain", "&copy;"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(url_filter.unescaped(F.col("t"))).collect()]
    assert got == ["a&b&c/<", "&#0;&#xD800;&#9999999;", "&lt;", "A", "", "plain", "&copy;"]
    assert list(itertools.chain(got))
