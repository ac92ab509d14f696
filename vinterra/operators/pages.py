"""Region facts from crawled HTML pages.

Text rules run JVM-side on a ``(slug, html)`` table as higher-order expressions
(``transform``/``filter``/``aggregate``); entities are decoded with
commons-text via ``java_method``.  Links and the containers they stand in need
real nesting: one Arrow-batched pass of an HTML tokenizer per page
(``vinterra.functions.html_links``) returns them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinterra.functions._cols import as_col
from vinterra.functions.html_links import page_walk
from vinterra.functions.text import strip_ws, title_case

# --- fixed values (must equal the reference for identical results) ---------------------
DEFAULT_LINK_PREFIX = "/wine-regions/"
# Breadcrumb containers, in priority order (CSS selectors).
BREADCRUMB_SELECTORS = [
    ".breadcrumb",
    '[data-testid*="breadcrumb"]',
    "nav ol",
    "nav ul",
    ".navigation-path",
    '[class*="breadcrumb"]',
    '[class*="path"]',
    '[class*="nav"]',
]
# Text patterns for parents, in order ({name} is the escaped region name);
# case-insensitive.
TEXT_PATTERNS = [
    r"{name},?\s+(?:appellation|région)\s+(?:du|de|des)\s+([^,\.]+)(?:\s+(?:dans|en)\s+(?:la\s+)?(?:région\s+)?(?:de|du|des)\s+([^,\.]+))?",
    r"(?:située?|localisée?)\s+dans\s+(?:le|la|les)?\s*([^,\.]+)(?:,\s*([^,\.]+))?",
    r"appellation\s+(?:de|du|des)\s+([^,\.]+)",
    r"{name}\s+(?:is\s+)?(?:an?\s+)?(?:appellation|region|area)\s+(?:in|of|within)\s+([^,\.]+)",
    r"(?:located\s+)?(?:in|within)\s+(?:the\s+)?([^,\.]+)(?:\s+(?:region|area))?",
    r"{name},\s+([^,\.]+)",
]
TEXT_STOP_WORDS = ["wine", "region", "appellation", "area"]
TEXT_PARENT_MAX_LEN = 30
# Known hierarchies by slug.
KNOWN_HIERARCHIES = {
    "pomerol": ["France", "Bordeaux", "Libournais"],
    "lalande-de-pomerol": ["France", "Bordeaux", "Libournais"],
    "saint-emilion": ["France", "Bordeaux", "Libournais"],
    "fronsac": ["France", "Bordeaux", "Libournais"],
    "canon-fronsac": ["France", "Bordeaux", "Libournais"],
    "margaux": ["France", "Bordeaux", "Médoc", "Haut-Médoc"],
    "pauillac": ["France", "Bordeaux", "Médoc", "Haut-Médoc"],
    "saint-julien": ["France", "Bordeaux", "Médoc", "Haut-Médoc"],
    "saint-estephe": ["France", "Bordeaux", "Médoc", "Haut-Médoc"],
    "pessac-leognan": ["France", "Bordeaux", "Graves"],
    "sauternes": ["France", "Bordeaux", "Graves"],
    "chablis": ["France", "Burgundy", "Chablis"],
    "gevrey-chambertin": ["France", "Burgundy", "Côte de Nuits"],
    "nuits-saint-georges": ["France", "Burgundy", "Côte de Nuits"],
    "beaune": ["France", "Burgundy", "Côte de Beaune"],
    "meursault": ["France", "Burgundy", "Côte de Beaune"],
    "chateauneuf-du-pape": ["France", "Rhône Valley", "Southern Rhône"],
    "cote-rotie": ["France", "Rhône Valley", "Northern Rhône"],
    "hermitage": ["France", "Rhône Valley", "Northern Rhône"],
    "champagne": ["France", "Champagne"],
    "sancerre": ["France", "Loire Valley"],
    "pouilly-fume": ["France", "Loire Valley"],
    "alsace": ["France", "Alsace"],
    "ajaccio": ["France", "Corsica"],
    "patrimonio": ["France", "Corsica"],
}
# Keyword detection (lower-cased page text contains any keyword) -> label.
COUNTRY_KEYWORDS = ("France", ["france", "français"])
MAJOR_REGION_KEYWORDS = {
    "Bordeaux": ["bordeaux", "bordelais"],
    "Burgundy": ["bourgogne", "burgundy"],
    "Champagne": ["champagne"],
    "Rhône Valley": ["rhône", "rhone"],
    "Loire Valley": ["loire"],
    "Alsace": ["alsace"],
    "Languedoc": ["languedoc"],
    "Provence": ["provence"],
    "Corsica": ["corse", "corsica"],
}
SUB_REGION_KEYWORDS = {
    "Libournais": ["libournais", "libourne", "rive droite"],
    "Médoc": ["médoc", "medoc"],
    "Haut-Médoc": ["haut-médoc", "haut-medoc"],
    "Graves": ["graves"],
    "Côte De Nuits": ["côte de nuits", "cote de nuits"],
    "Côte De Beaune": ["côte de beaune", "cote de beaune"],
}
# Output order of detected labels.
HIERARCHY_ORDER = [
    "France", "Bordeaux", "Burgundy", "Champagne", "Rhône Valley", "Loire Valley", "Alsace", "Languedoc",
    "Provence", "Corsica", "Libournais", "Médoc", "Haut-Médoc", "Graves", "Côte De Nuits", "Côte De Beaune",
]
MAX_CHILDREN = 20
NAME_MAX_LEN = 50
HIERARCHY_SEPARATOR = " > "
# ---------------------------------------------------------------------------------------------



def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and apply ``body`` to it (``body`` may refer to
    it several times): a one-element array mapped by a lambda."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def unescape_html(c) -> Column:
    """HTML entity decoding (commons-text, JVM; its HTML table lacks ``&apos;``)."""
    text = F.replace(as_col(c), F.lit("&apos;"), F.lit("'"))
    return F.java_method(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text)


def _regex_quote(c) -> Column:
    return F.java_method(F.lit("java.util.regex.Pattern"), F.lit("quote"), as_col(c))


def visible_text(html) -> Column:
    """Text of a page as a parser's ``get_text()`` gives it: script, style and
    comments removed, tags removed without separator, entities decoded."""
    no_code = F.regexp_replace(as_col(html), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    return unescape_html(F.regexp_replace(no_code, r"<[^>]*>", ""))


def stripped_text(fragment) -> Column:
    """``get_text(strip=True)``: every text piece stripped, pieces joined."""
    pieces = F.split(F.regexp_replace(as_col(fragment), r"(?is)<!--.*?-->", "<>"), r"<[^>]*>")
    return F.array_join(F.transform(pieces, lambda p: strip_ws(unescape_html(p))), "")


def _element(tag: str) -> str:
    """An element's inner HTML: up to its closing tag, or to the end of the
    input when the page is truncated (a parser closes it implicitly)."""
    return rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)"


def _first_element(html, tag: str) -> Column:
    return F.regexp_extract(as_col(html), _element(tag), 1)


def _has_element(html, tag: str) -> Column:
    return as_col(html).rlike(rf"(?is)<{tag}\b[^>]*>")


# P19 ------------------------------------------------------------------------------------------
def region_name(html, slug) -> Column:
    """Name: title-cased slug, else the ``<title>`` before any ``|`` (if longer
    than 2), else the ``<h1>`` text when it is short and not about "wine".
    Title and h1 texts are each computed once."""
    default = title_case(F.regexp_replace(as_col(slug), "-", " "))
    title = strip_ws(F.regexp_replace(unescape_html(stripped_title(html)), r"\s*\|\s*.*$", ""))
    title_ok = _let(title, lambda t: F.when(F.length(t) > 2, t))
    h1 = stripped_text(_first_element(html, "h1"))
    h1_ok = _let(h1, lambda t: F.when((F.length(t) > 0) & ~F.lower(t).contains("wine") & (F.length(t) < NAME_MAX_LEN), t))
    return F.coalesce(
        F.when(_has_element(html, "h1"), h1_ok),
        F.when(_has_element(html, "title"), title_ok),
        default,
    )


def stripped_title(html) -> Column:
    raw = _first_element(html, "title")
    return F.regexp_replace(raw, r"<[^>]*>", "")


# P20 ------------------------------------------------------------------------------------------
def breadcrumb_parents(html, slug, prefix: str = DEFAULT_LINK_PREFIX, selectors: Sequence[str] = BREADCRUMB_SELECTORS) -> Column:
    """First container (selector priority, then document order) with at least
    one prefix link whose non-empty texts differ from the slug (empty if none)."""
    return page_walk(as_col(html), as_col(slug), prefix, selectors)["names"]


def _or_null(parents: Column) -> Column:
    return F.when(F.size(parents) > 0, parents)


# P21 ------------------------------------------------------------------------------------------
def _valid_groups(regex: Column, n_groups: int, name: Column, stops: Column):
    """Per match: its groups (re-matched), stripped, kept if valid."""

    def per_match(m: Column) -> Column:
        gs = F.array(*[strip_ws(F.call_function("regexp_extract", m, regex, F.lit(g))) for g in range(1, n_groups + 1)])
        return F.filter(
            gs,
            lambda p: (p != "") & (F.length(p) < TEXT_PARENT_MAX_LEN) & (F.lower(p) != F.lower(name))
            & ~F.array_contains(stops, F.lower(p)),
        )

    return per_match


def text_pattern_parents(text, slug) -> Column:
    """First pattern (in order) with a match leaving valid parts: stripped,
    non-empty, shorter than 30, not the name, not a stop word (empty if none)."""
    return F.coalesce(_text_parents_or_null(text, slug), F.array().cast("array<string>"))


def _text_parents_or_null(text, slug) -> Column:
    t = as_col(text)
    name = title_case(F.regexp_replace(as_col(slug), "-", " "))
    quoted = _regex_quote(name)
    stops = F.array(*[F.lit(w) for w in TEXT_STOP_WORDS])
    found = []
    for pat in TEXT_PATTERNS:
        pieces = [F.lit("(?iU)")]
        for i, part in enumerate(pat.split("{name}")):
            if i:
                pieces.append(quoted)
            pieces.append(F.lit(part))
        regex = F.concat(*pieces)
        n_groups = pat.count("([^")
        matches = F.regexp_extract_all(t, regex, 0)

        found.append(
            F.try_element_at(F.filter(F.transform(matches, _valid_groups(regex, n_groups, name, stops)), lambda g: F.size(g) > 0), F.lit(1))
        )
    return F.coalesce(*found)


# P22 ------------------------------------------------------------------------------------------
def rule_parents(text, slug) -> Column:
    """Known hierarchy for the slug, else labels whose keywords occur in the
    lower-cased text, in the fixed order."""
    s = as_col(slug)
    low = F.lower(as_col(text))
    known = F.create_map(*[x for k, v in KNOWN_HIERARCHIES.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    keywords = {COUNTRY_KEYWORDS[0]: COUNTRY_KEYWORDS[1], **MAJOR_REGION_KEYWORDS, **SUB_REGION_KEYWORDS}

    def hit(label: str) -> Column:
        cond = F.lit(False)
        for kw in keywords[label]:
            cond = cond | low.contains(kw)
        return F.when(cond, F.lit(label))

    detected = F.filter(F.array(*[hit(label) for label in HIERARCHY_ORDER]), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(known, s), detected)


def _rules_or_null(text, slug) -> Column:
    return _let(rule_parents(text, slug), lambda a: F.when(F.size(a) > 0, a))


# P23 ------------------------------------------------------------------------------------------
def region_parents(html, slug, prefix: str = DEFAULT_LINK_PREFIX) -> Column:
    """Breadcrumbs, else text patterns, else rules, else empty -- evaluated
    lazily: later methods run only for pages where the earlier ones fail."""
    return _parents(breadcrumb_parents(html, slug, prefix), html, slug)


def _parents(crumbs: Column, html, slug) -> Column:
    text = visible_text(html)
    return F.coalesce(
        _or_null(crumbs),
        _text_parents_or_null(text, slug),
        _rules_or_null(text, slug),
        F.array().cast("array<string>"),
    )


# P24 ------------------------------------------------------------------------------------------
def region_children(html, slug, parents, prefix: str = DEFAULT_LINK_PREFIX, limit: int = MAX_CHILDREN) -> Column:
    """Slugs after the prefix in links of ``<main>`` (else ``<body>``), query and
    fragment cut, without self/parents, longer than 1 char, no '/', first
    ``limit`` distinct in page order."""
    return _children(page_walk(as_col(html), as_col(slug), prefix, BREADCRUMB_SELECTORS)["targets"], slug, parents, prefix, limit)


def _children(targets: Column, slug, parents, prefix: str, limit: int = MAX_CHILDREN) -> Column:
    tails = F.transform(targets, lambda x: F.element_at(F.split(x, "\\Q" + prefix + "\\E"), -1))
    slugs = F.transform(tails, lambda x: F.split(F.split(x, r"\?").getItem(0), "#").getItem(0))
    excluded = F.concat(F.array(as_col(slug)), F.transform(as_col(parents), lambda p: F.regexp_replace(F.lower(p), " ", "-")))
    ok = F.filter(slugs, lambda x: (x != "") & (F.length(x) > 1) & ~x.contains("/"))
    return F.slice(F.array_except(F.array_distinct(ok), excluded), 1, limit)


# P25 ------------------------------------------------------------------------------------------
def region_records(pages: DataFrame, html: str = "html", slug: str = "slug", prefix: str = DEFAULT_LINK_PREFIX,
                   source: str = "html_pages") -> DataFrame:
    """One record per page: slug, name, parents, children, full_hierarchy, depth (links are read once)."""
    walked = pages.withColumn("_walk", page_walk(F.col(html), F.col(slug), prefix, BREADCRUMB_SELECTORS))
    named = walked.withColumns({"name": region_name(html, slug), "parents": _parents(F.col("_walk.names"), html, slug)})
    rec = named.withColumn("children", _children(F.col("_walk.targets"), slug, "parents", prefix))
    return rec.drop(html, "_walk").withColumns(
        {
            "full_hierarchy": F.array_join(F.concat("parents", F.array("name")), HIERARCHY_SEPARATOR),
            "hierarchy_depth": F.size("parents"),
            "source": F.lit(source),
        }
    )


# A10 ------------------------------------------------------------------------------------------
def hierarchy_tree(records: DataFrame, order: str) -> DataFrame:
    """Nodes of the path tree: every non-empty prefix of ``parents + [name]``;
    a node's metadata comes from the last record (by ``order``) with exactly
    that path.  Prefixes are exploded per record; grouping by path is a
    partial aggregate, so a shared root (one node for all pages) is cheap."""
    path = F.filter(F.concat("parents", F.array("name")), lambda x: x.isNotNull() & (x != ""))
    rec = records.withColumn("_path", path).where(F.size("_path") > 0)
    prefixes = rec.select(
        "*", F.explode(F.transform(F.sequence(F.lit(1), F.size("_path")), lambda i: F.slice("_path", 1, i))).alias("node")
    )
    full = F.size("node") == F.size("_path")
    meta = F.struct("slug", "children", "hierarchy_depth", "full_hierarchy", "source")
    grouped = prefixes.groupBy("node").agg(F.max_by(F.when(full, meta), F.when(full, F.col(order))).alias("meta"))
    return grouped.select(
        F.array_join("node", HIERARCHY_SEPARATOR).alias("path"),
        F.when(F.size("node") > 1, F.array_join(F.slice("node", 1, F.size("node") - 1), HIERARCHY_SEPARATOR)).alias("parent_path"),
        F.size("node").alias("depth"),
        F.col("meta.slug").alias("slug"),
        F.col("meta.children").alias("children"),
        F.col("meta.hierarchy_depth").alias("hierarchy_depth"),
        F.col("meta.full_hierarchy").alias("full_hierarchy"),
        F.col("meta.source").alias("source"),
    )


# A9 -------------------------------------------------------------------------------------------
def extraction_stats(attempts: DataFrame, ok_col: str = "ok") -> DataFrame:
    """Totals, successes, success rate text, records with parents / children,
    deepest hierarchy (0 if none) and records under "France" -- one pass."""
    ok = F.col(ok_col)
    total = F.count(F.lit(1))
    succ = F.count_if(ok)
    return attempts.agg(
        total.alias("total_regions_processed"),
        succ.alias("successful_extractions"),
        F.when(total > 0, F.format_string("%.1f%%", succ * 100.0 / total)).otherwise(F.lit("0%")).alias("success_rate"),
        F.count_if(ok & (F.size("parents") > 0)).alias("regions_with_parents"),
        F.count_if(ok & (F.size("children") > 0)).alias("regions_with_children"),
        F.coalesce(F.max(F.when(ok, F.col("hierarchy_depth"))), F.lit(0)).alias("max_hierarchy_depth"),
        F.count_if(ok & F.array_contains("parents", "France")).alias("french_regions"),
    )
