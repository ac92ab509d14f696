"""Page extraction vs a stdlib html.parser tree walk."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from data_dirs import SF001
from vinterra.operators.pages import (
    TEXT_PATTERNS,
    TEXT_STOP_WORDS,
    breadcrumb_parents,
    extraction_stats,
    hierarchy_tree,
    region_children,
    region_name,
    region_records,
    rule_parents,
    text_pattern_parents,
    visible_text,
)
from vinterra.plans.q_pages import LINK_PREFIX, _pages

VOID = {"meta", "br", "img", "input", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def iter(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.iter()

    def strings(self):
        for c in self.children:
            if isinstance(c, Node):
                if c.tag not in ("script", "style"):
                    yield from c.strings()
            else:
                yield c

    def text(self, strip=False):
        parts = [s.strip() for s in self.strings()] if strip else list(self.strings())
        return "".join(p for p in parts if p or not strip)


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = Node("[doc]", [], None)
        self.cur = self.root
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, attrs, self.cur)
        self.cur.children.append(n)
        if tag not in VOID:
            self.cur = n

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)

    def find(self, tag):
        return next((n for n in self.root.iter() if n.tag == tag), None)


def ref_name(tree, slug):
    name = slug.replace("-", " ").title()
    t = tree.find("title")
    if t is not None:
        ct = re.sub(r"\s*\|\s*.*$", "", t.text()).strip()
        if ct and len(ct) > 2:
            name = ct
    h1 = tree.find("h1")
    if h1 is not None:
        ht = h1.text(strip=True)
        if ht and "wine" not in ht.lower() and len(ht) < 50:
            name = ht
    return name


def ref_breadcrumbs(tree, slug, prefix):
    # the given pages only carry "nav ul" containers (checked below)
    for outer, inner in (("nav", "ol"), ("nav", "ul")):
        for nav in (n for n in tree.root.iter() if n.tag == outer):
            for box in (n for n in nav.iter() if n.tag == inner):
                links = [a for a in box.iter() if a.tag == "a" and prefix in a.attrs.get("href", "")]
                if links:
                    parents = [a.text(strip=True) for a in links if a.text(strip=True) and a.text(strip=True) != slug]
                    if parents:
                        return parents
    return []


def ref_children(tree, slug, parents, prefix):
    scope = tree.find("main") or tree.find("body")
    if scope is None:
        return []
    excluded = {slug} | {p.lower().replace(" ", "-") for p in parents}
    out = []
    for a in scope.iter():
        if a.tag != "a" or prefix not in a.attrs.get("href", ""):
            continue
        child = a.attrs["href"].split(prefix)[-1].split("?")[0].split("#")[0]
        if child and child not in excluded and len(child) > 1 and "/" not in child:
            out.append(child)
            excluded.add(child)
    return list(dict.fromkeys(out))[:20]


def ref_text_parents(text, slug):
    name = slug.replace("-", " ").title()
    for pat in TEXT_PATTERNS:
        for m in re.findall(pat.replace("{name}", re.escape(name)), text, re.IGNORECASE):
            parts = [x.strip() for x in (m if isinstance(m, tuple) else (m,)) if x.strip()]
            valid = [p for p in parts if len(p) < 30 and p.lower() != name.lower() and p.lower() not in TEXT_STOP_WORDS]
            if valid:
                return valid
    return []


@pytest.fixture(scope="module")
def pages(spark):
    p = _pages(spark, SF001)
    out = p.select(
        "page_id", "slug", "html",
        region_name("html", "slug").alias("name"),
        breadcrumb_parents("html", "slug", LINK_PREFIX).alias("crumbs"),
        text_pattern_parents(visible_text("html"), "slug").alias("tparents"),
        visible_text("html").alias("text"),
    )
    out = out.withColumn("children", region_children("html", "slug", "crumbs", LINK_PREFIX))
    return out.collect()


def test_pages_have_only_nav_lists(pages):
    for r in pages:
        assert "breadcrumb" not in r.html and "<ol" not in r.html and "class=\"nav" not in r.html


def test_name_matches_parser(pages):
    for r in pages:
        assert r.name == ref_name(Tree(r.html), r.slug)


def test_breadcrumbs_match_parser(pages):
    for r in pages:
        assert list(r.crumbs) == ref_breadcrumbs(Tree(r.html), r.slug, LINK_PREFIX)


def test_children_match_parser(pages):
    for r in pages:
        assert list(r.children) == ref_children(Tree(r.html), r.slug, list(r.crumbs), LINK_PREFIX)


def test_visible_text_matches_parser(pages):
    for r in pages:
        assert r.text == Tree(r.html).root.text()


def test_text_patterns_match_python_re(pages):
    for r in pages:
        assert list(r.tparents) == ref_text_parents(r.text, r.slug)


HTML = """<html><head><title>Margaux | Wine Region</title></head><body>
<div class="breadcrumb"><a href="/wine-regions/france">France</a> &gt; <a href="/wine-regions/bordeaux">Bordeaux</a>
<a href="/wine-regions/margaux">margaux</a></div>
<h1>Margaux wines</h1><main><a href="/wine-regions/haut-medoc?x=1">HM</a><a href="/wine-regions/france">F</a>
<a href="/wine-regions/a/b">deep</a><a href="/wine-regions/x">x</a><a href="/wine-regions/haut-medoc#t">again</a></main>
<p>Margaux is an appellation in Haut-Médoc, close to the Gironde.</p></body></html>"""


def test_fixture_page(spark):
    df = spark.createDataFrame([("margaux", HTML)], "slug string, html string")
    rec = region_records(df, "html", "slug").first()
    assert rec.name == "Margaux"                     # h1 mentions wine -> title before "|"
    assert list(rec.parents) == ["France", "Bordeaux"]  # the link equal to the slug is skipped
    assert list(rec.children) == ["haut-medoc"]
    assert rec.full_hierarchy == "France > Bordeaux > Margaux" and rec.hierarchy_depth == 2


def test_text_and_rules(spark):
    df = spark.createDataFrame([("margaux", "Margaux is an appellation in Haut-Médoc, near Bordeaux."),
                                ("pomerol", "x"), ("other", "Située dans le Libournais, bordelais. France.")],
                               "slug string, text string")
    out = {r.slug: (list(r.t), list(r.r)) for r in df.select("slug", text_pattern_parents("text", "slug").alias("t"),
                                                             rule_parents("text", "slug").alias("r")).collect()}
    assert out["margaux"][0] == ["Haut-Médoc"]
    assert out["pomerol"][1] == ["France", "Bordeaux", "Libournais"]
    assert out["other"][0] == ["Libournais", "bordelais"]
    assert out["other"][1] == ["France", "Bordeaux", "Libournais"]


def test_tree_and_stats(spark):
    recs = spark.createDataFrame(
        [(1, "a", "A", ["France", "Bordeaux"], ["c1"], 2, "France > Bordeaux > A", "s"),
         (2, "a2", "A", ["France", "Bordeaux"], [], 2, "France > Bordeaux > A", "s"),
         (3, "b", "B", [], [], 0, "B", "s")],
        "ord int, slug string, name string, parents array<string>, children array<string>, hierarchy_depth int, full_hierarchy string, source string")
    tree = {r.path: r for r in hierarchy_tree(recs, "ord").collect()}
    assert set(tree) == {"France", "France > Bordeaux", "France > Bordeaux > A", "B"}
    assert tree["France > Bordeaux > A"].slug == "a2" and tree["France"].slug is None
    assert tree["France > Bordeaux > A"].parent_path == "France > Bordeaux"
    st = extraction_stats(recs.withColumn("ok", F.lit(True))).first()
    assert (st.total_regions_processed, st.success_rate, st.regions_with_parents, st.max_hierarchy_depth, st.french_regions) == (3, "100.0%", 2, 2, 2)


WILD = """<html><body><div class="nav"><div><a href=/wine-regions/france>France &amp; Co</a></div>
<a data-href="/wine-regions/no" href="/elsewhere">no</a><a href='/wine-regions/bordeaux'>Bor<!-- x -->deaux&apos;s</a></div>
<main><!-- <a href="/wine-regions/hidden">h</a> --><a href=/wine-regions/open>o</a><script>var x='<a href="/wine-regions/js">';</script>
<div><p><a href="/wine-regions/deep?x#y">d<b> e </b></a></div><a HREF="/wine-regions/last" title='a>b'>l</a></main>
<a href="/wine-regions/outside">out</a>"""


def test_links_of_wild_markup(spark):
    df = spark.createDataFrame([("s", WILD, 1), ("t", None, 2), ("u", "", 3), ("v", '<nav><ul><a href="/wine-regions/x1">X', 4)], "slug string, html string, i int")
    out = {r.i: r for r in df.select("i", breadcrumb_parents("html", "slug").alias("p"), region_children("html", "slug", F.array().cast("array<string>")).alias("c")).collect()}
    assert list(out[1].p) == ["France & Co", "Bordeaux's"]
    assert list(out[1].c) == ["open", "deep", "last"]
    assert [list(out[i].p) for i in (2, 3, 4)] == [[], [], ["X"]] and [list(out[i].c) for i in (2, 3, 4)] == [[], [], []]


def test_selector_priority_beats_page_order(spark):
    html = '<body><div class="navbar"><a href="/wine-regions/a1">A</a></div><ol class="x breadcrumb"><li><a href="/wine-regions/b1">B</a></ol>'
    df = spark.createDataFrame([("s", html), ("B", html)], "slug string, html string")
    got = {r.slug: list(r.p) for r in df.select("slug", breadcrumb_parents("html", "slug").alias("p")).collect()}
    assert got == {"s": ["B"], "B": ["A"]}  # a container with only the page itself is passed over


def test_apostrophe_entity(spark):
    df = spark.createDataFrame([("s", "<title>L&apos;Etoile &amp;apos; | x</title>")], "slug string, html string")
    assert df.select(region_name("html", "slug").alias("n")).first().n == "L'Etoile &apos;"
