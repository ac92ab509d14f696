"""Crawl-response and region-page queries.

Pages: ``pages(page_id, url, html)``; the slug is the site word of the URL
and the link prefix is ``/`` (the given pages link to ``/<word>``).
Oracles of the link queries use that the given pages carry their links in one
``nav ul`` each (never none, so text patterns and rules are not reached there);
wild markup is in ``tests/test_pages.py``.  Text patterns need a regular
expression built from each row and have no SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vinterra.operators.pages import (
    HIERARCHY_ORDER,
    KNOWN_HIERARCHIES,
    MAX_CHILDREN,
    MAJOR_REGION_KEYWORDS,
    SUB_REGION_KEYWORDS,
    COUNTRY_KEYWORDS,
    breadcrumb_parents,
    extraction_stats,
    hierarchy_tree,
    region_children,
    region_name,
    region_parents,
    region_records,
    rule_parents,
    text_pattern_parents,
    visible_text,
)
from vinterra.functions.numbers import coerce_numeric
from vinterra.operators.rankings import concat_intervals, keep_first
from vinterra.plans import standins
from vinterra.plans.q_tables import CRAWL_INTERVALS
from vinterra.plans.registry import query, rounded, sql_str
from vinterra.sources.crawl import MATCH_FIELDS, dominant_grape, flatten_responses, request_plan
from vinterra.sources.tables import table

LINK_PREFIX = "/"
PAGE_SIZE = 25
_SLUG_RE = r"^[a-z]+://(?:www\.|m\.|blog\.)?([^./]+)"


def _pages(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", _SLUG_RE, 1).alias("slug"), "html")


_PAGES_SQL = f"pg AS (SELECT page_id, regexp_extract(url, {sql_str(_SLUG_RE)}, 1) AS slug, html FROM pages)"

_UNESCAPE = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"),
             ("&nbsp;", " "), ("&amp;", "&")]


def _unescape_sql(e: str) -> str:
    for a, b in _UNESCAPE:
        e = f"replace({e}, {sql_str(a)}, {sql_str(b)})"
    return e


def _strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


# S4 ------------------------------------------------------------------------------------------------
def _cents_text():
    """Price text from integer cents (float formatting rounds differently per engine)."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))


_CENTS_SQL = "CAST(round(o_totalprice * 100) AS BIGINT)"
_CENTS_TEXT_SQL = f"CAST({_CENTS_SQL} // 100 AS VARCHAR) || '.' || lpad(CAST({_CENTS_SQL} % 100 AS VARCHAR), 2, '0')"


def _responses(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    grape = F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))
    k = F.col("o_orderkey")
    style = F.when(F.pmod(k, F.lit(17)) == 0, F.lit("null")).otherwise(
        F.concat(F.lit('{"grapes": [{"seo_name": "'), grape, F.lit('"}]}'))
    )
    year = F.when(F.pmod(k, F.lit(13)) == 0, F.lit("null")).when(F.pmod(k, F.lit(13)) == 1, F.lit('"N.V."')).otherwise(
        F.year("o_orderdate").cast("string")
    )
    price = F.when(F.pmod(k, F.lit(11)) == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "price": {"amount": '), _cents_text(), F.lit("}"))
    )
    match = F.concat(
        F.lit('{"vintage": {"wine": {"winery": {"name": "Winery '), F.col("c_nationkey").cast("string"),
        F.lit('"}, "name": "Cuvée '), F.col("o_orderpriority"),
        F.lit('", "region": {"seo_name": "'), F.lower("c_name"), F.lit('"}, "style": '), style,
        F.lit('}, "statistics": {"ratings_average": 4.'), F.pmod(k, F.lit(10)).cast("string"),
        F.lit(', "ratings_count": '), F.col("o_custkey").cast("string"),
        F.lit(', "wine_ratings_average": 3.'), F.pmod(F.col("o_custkey"), F.lit(10)).cast("string"),
        F.lit(', "wine_ratings_count": '), (F.col("o_custkey") * 2).cast("string"),
        F.lit('}, "year": '), year, F.lit("}"), price, F.lit("}"),
    )
    m = o.join(c, o.o_custkey == c.c_custkey).select(F.floor(k / PAGE_SIZE).alias("page"), k.alias("o_orderkey"), match.alias("match"))
    total = o.select(F.count(F.lit(1))).scalar()
    # A page holds at most PAGE_SIZE matches, so collecting one page is bounded.
    grouped = m.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "match"))).alias("ms"))
    body = F.array_join(F.transform("ms", lambda x: x["match"]), ", ")
    return grouped.select(
        "page",
        F.concat(F.lit('{"explore_vintage": {"records_matched": '), total.cast("string"), F.lit(', "matches": ['), body, F.lit("]}}")).alias("response"),
    )


_GRAPE_SQL = "lower(regexp_replace(o_orderpriority, '^[0-9]-', ''))"
_RESP_SQL = f"""m AS (
  SELECT o_orderkey // {PAGE_SIZE} AS page, o_orderkey,
         '{{"vintage": {{"wine": {{"winery": {{"name": "Winery ' || CAST(c_nationkey AS VARCHAR)
         || '"}}, "name": "Cuvée ' || o_orderpriority
         || '", "region": {{"seo_name": "' || lower(c_name) || '"}}, "style": '
         || CASE WHEN o_orderkey % 17 = 0 THEN 'null' ELSE '{{"grapes": [{{"seo_name": "' || {_GRAPE_SQL} || '"}}]}}' END
         || '}}, "statistics": {{"ratings_average": 4.' || CAST(o_orderkey % 10 AS VARCHAR)
         || ', "ratings_count": ' || CAST(o_custkey AS VARCHAR)
         || ', "wine_ratings_average": 3.' || CAST(o_custkey % 10 AS VARCHAR)
         || ', "wine_ratings_count": ' || CAST(o_custkey * 2 AS VARCHAR)
         || '}}, "year": ' || CASE WHEN o_orderkey % 13 = 0 THEN 'null' WHEN o_orderkey % 13 = 1 THEN '"N.V."' ELSE CAST(year(o_orderdate) AS VARCHAR) END || '}}'
         || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ', "price": {{"amount": ' || {_CENTS_TEXT_SQL} || '}}' END
         || '}}' AS match
  FROM orders JOIN customer ON o_custkey = c_custkey),
resp AS (
  SELECT page, '{{"explore_vintage": {{"records_matched": ' || CAST((SELECT count(*) FROM orders) AS VARCHAR)
         || ', "matches": [' || string_agg(match, ', ' ORDER BY o_orderkey) || ']}}}}' AS response
  FROM m GROUP BY page),
ms AS (
  SELECT page, generate_subscripts(arr, 1) - 1 AS match_pos, unnest(arr) AS mj
  FROM (SELECT page, json_extract(response, '$.explore_vintage.matches[*]') AS arr FROM resp))"""

_PATHS = [path for _, path, _ in MATCH_FIELDS]


def _js(path: str) -> str:
    return f"json_extract_string(mj, '{path}')"


@query(
    "crawl_flatten",
    f"""WITH {_RESP_SQL}
        SELECT CAST(page AS BIGINT) AS page, CAST(match_pos AS INTEGER) AS match_pos,
               {_js('$.vintage.wine.winery.name')} AS Winery,
               coalesce({_js('$.vintage.wine.name')}, 'None') || ' ' || coalesce({_js('$.vintage.year')}, 'None') AS Wine,
               {_js('$.vintage.year')} AS vintage,
               round(TRY_CAST({_js('$.vintage.statistics.ratings_average')} AS DOUBLE), 6) AS vintage_rating,
               TRY_CAST({_js('$.vintage.statistics.ratings_count')} AS BIGINT) AS vintage_rating_count,
               round(TRY_CAST({_js('$.vintage.statistics.wine_ratings_average')} AS DOUBLE), 6) AS wine_rating,
               TRY_CAST({_js('$.vintage.statistics.wine_ratings_count')} AS BIGINT) AS wine_rating_count,
               {_js('$.vintage.wine.region.seo_name')} AS region,
               round(TRY_CAST({_js('$.price.amount')} AS DOUBLE), 6) AS price,
               {_js('$.vintage.wine.style.grapes[0].seo_name')} AS grape
        FROM ms WHERE {' AND '.join(f"json_extract(mj, '{p}') IS NOT NULL" for p in _PATHS)}""",
)
def crawl_flatten(spark, d):
    flat = flatten_responses(_responses(spark, d), "response", keep=("page",))
    out = flat.withColumn("grape", dominant_grape("cepages")).drop("cepages")
    return rounded(out.withColumn("page", F.col("page").cast("bigint")))


# S4 -> U1 -> W1 -> P7 ------------------------------------------------------------------------------
_LANDED_INTERVALS = [(0.0, 150000.0), (100000.0, 1e12)]  # stand-in price intervals that overlap


@query(
    "crawl_to_grapes",
    f"""WITH {_RESP_SQL},
        flat AS (
          SELECT page, match_pos, coalesce({_js('$.vintage.wine.name')}, 'None') || ' ' || coalesce({_js('$.vintage.year')}, 'None') AS Wine,
                 {_js('$.vintage.year')} AS vintage, TRY_CAST({_js('$.price.amount')} AS DOUBLE) AS price,
                 {_js('$.vintage.wine.style.grapes[0].seo_name')} AS grape
          FROM ms WHERE {' AND '.join(f"json_extract(mj, '{p}') IS NOT NULL" for p in _PATHS)}),
        iv AS (SELECT * FROM (VALUES {', '.join(f'({i}, {lo}, {hi})' for i, (lo, hi) in enumerate(_LANDED_INTERVALS))}) t(interval_id, lo, hi)),
        u AS (SELECT flat.*, interval_id FROM flat JOIN iv ON price >= lo AND price <= hi),
        k AS (SELECT *, row_number() OVER (PARTITION BY Wine, vintage ORDER BY interval_id, page, match_pos) AS rn FROM u)
        SELECT Wine, vintage, TRY_CAST(vintage AS DOUBLE) AS year, round(price, 6) AS price, grape, interval_id,
               CAST(page AS BIGINT) AS page, CAST(match_pos AS INTEGER) AS match_pos FROM k WHERE rn = 1""",
)
def crawl_to_grapes(spark, d):
    """Landed responses to one row per wine and vintage with its dominant grape."""
    flat = flatten_responses(_responses(spark, d), "response", keep=("page",))
    first = keep_first(concat_intervals(flat, _LANDED_INTERVALS), ["Wine", "vintage"], ["interval_id", "page", "match_pos"])
    return rounded(first.select(
        "Wine", "vintage", coerce_numeric("vintage").alias("year"), "price", dominant_grape("cepages").alias("grape"), "interval_id",
        F.col("page").cast("bigint").alias("page"), "match_pos",
    ))


# S5 ------------------------------------------------------------------------------------------------
@query(
    "crawl_plan",
    f"""WITH {standins.WINES_SQL},
        iv AS (SELECT * FROM (VALUES {', '.join(f'({i}, {float(lo)}, {float(hi)})' for i, (lo, hi) in enumerate(CRAWL_INTERVALS))}) t(interval_id, lo, hi)),
        tot AS (SELECT iv.interval_id, count(*) AS records_matched FROM wines w JOIN iv
                ON w.price / 1000.0 >= iv.lo AND w.price / 1000.0 <= iv.hi GROUP BY iv.interval_id)
        SELECT interval_id, records_matched, {PAGE_SIZE} AS per_page, CAST(p.page AS INTEGER) AS page
        FROM tot, generate_series(1, CAST(ceil(records_matched / {PAGE_SIZE}.0) AS BIGINT)) p(page)""",
)
def crawl_plan(spark, d):
    w = standins.wines(spark, d).withColumn("price", F.col("price") / F.lit(1000.0))
    totals = concat_intervals(w, CRAWL_INTERVALS).groupBy("interval_id").agg(F.count(F.lit(1)).alias("records_matched"))
    return request_plan(totals.withColumn("per_page", F.lit(PAGE_SIZE)))


# P19 -----------------------------------------------------------------------------------------------
_TITLE_RAW_SQL = "regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '<[^>]*>', '', 'g')"
_TITLE_SQL = _strip_sql(_unescape_sql(_TITLE_RAW_SQL))
_TITLE_CUT_SQL = _strip_sql("regexp_replace(" + _TITLE_SQL + ", " + sql_str(r"\s*\|\s*.*$") + ", '')")
_H1_SQL = (
    "array_to_string(list_transform(string_split_regex(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '<[^>]*>'),"
    f" lambda p: {_strip_sql(_unescape_sql('p'))}), '')"
)
_SLUG_TITLE_SQL = (
    "array_to_string(list_transform(regexp_extract_all(replace(slug, '-', ' '), '(\\p{L}+|[^\\p{L}]+)'),"
    " lambda p: CASE WHEN regexp_matches(p, '^\\p{L}') THEN upper(p[1]) || lower(p[2:]) ELSE p END), '')"
)


_NAME_SQL = f"""SELECT page_id, slug,
               CASE WHEN has_h1 AND length(h1) > 0 AND NOT contains(lower(h1), 'wine') AND length(h1) < 50 THEN h1
                    WHEN has_title AND length(title) > 2 THEN title
                    ELSE {_SLUG_TITLE_SQL} END AS name
        FROM (SELECT page_id, slug, {_TITLE_CUT_SQL} AS title, regexp_matches(html, '(?is)<title\\b[^>]*>') AS has_title,
                     {_H1_SQL} AS h1, regexp_matches(html, '(?is)<h1\\b[^>]*>') AS has_h1 FROM pg)"""


@query("page_name", f"WITH {_PAGES_SQL} {_NAME_SQL}")
def page_name(spark, d):
    p = _pages(spark, d)
    return p.select("page_id", "slug", region_name("html", "slug").alias("name"))


def _joined(c):
    return F.array_join(c, " | ")


# P20 -----------------------------------------------------------------------------------------------
_LINKS_SQL = f"""{_PAGES_SQL},
box AS (
  SELECT page_id, slug, html,
         regexp_extract_all(regexp_extract(html, '(?is)<nav\\b[^>]*>.*?<ul\\b[^>]*>(.*?)(?:</ul\\s*>|\\z)', 1),
                            '(?is)<a\\b[^>]*\\bhref="[^"]*/[^"]*"[^>]*>(.*?)</a\\s*>', 1) AS inner_html,
         regexp_extract_all(regexp_replace(regexp_extract(html, '(?is)<body\\b[^>]*>(.*)', 1), '(?s)<!--.*?-->', '', 'g'),
                            '(?is)<a\\b[^>]*\\bhref="([^"]*/[^"]*)"', 1) AS targets
  FROM pg),
par AS (
  SELECT page_id, slug, html, targets,
         [x for x in [{_strip_sql(_unescape_sql("regexp_replace(l, '<[^>]*>', '', 'g')"))} for l in inner_html] if x <> '' and x <> slug] AS parents
  FROM box)"""
_PARENTS_SQL = f"""WITH {_LINKS_SQL}
        SELECT page_id, slug, CAST(len(parents) AS INTEGER) AS n_parents, array_to_string(parents, ' | ') AS parents FROM par"""


@query("page_links", _PARENTS_SQL)
def page_links(spark, d):
    p = _pages(spark, d).withColumn("parents", breadcrumb_parents("html", "slug", LINK_PREFIX))
    return p.select("page_id", "slug", F.size("parents").alias("n_parents"), _joined("parents").alias("parents"))


# P21 -----------------------------------------------------------------------------------------------
@query("page_text_parents")
def page_text_parents(spark, d):
    p = _pages(spark, d).withColumn("parents", text_pattern_parents(visible_text("html"), "slug"))
    return p.select("page_id", "slug", F.size("parents").alias("n_parents"), _joined("parents").alias("parents"))


# P22 -----------------------------------------------------------------------------------------------
_TEXT_SQL = _unescape_sql(
    "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
)
_RULE_KEYWORDS = {COUNTRY_KEYWORDS[0]: COUNTRY_KEYWORDS[1], **MAJOR_REGION_KEYWORDS, **SUB_REGION_KEYWORDS}
_DETECTED_SQL = "list_filter([" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(low, {sql_str(k)})" for k in _RULE_KEYWORDS[label]) + f" THEN {sql_str(label)} END"
    for label in HIERARCHY_ORDER
) + "], lambda x: x IS NOT NULL)"
_KNOWN_SQL = "CASE slug " + " ".join(
    f"WHEN {sql_str(k)} THEN [{', '.join(sql_str(x) for x in v)}]" for k, v in KNOWN_HIERARCHIES.items()
) + " END"


@query(
    "page_rules",
    f"""WITH {_PAGES_SQL}, t AS (SELECT page_id, slug, lower({_TEXT_SQL}) AS low FROM pg),
        r AS (SELECT page_id, slug, coalesce({_KNOWN_SQL}, {_DETECTED_SQL}) AS parents FROM t)
        SELECT page_id, slug, CAST(len(parents) AS INTEGER) AS n_parents, array_to_string(parents, ' | ') AS parents FROM r""",
)
def page_rules(spark, d):
    p = _pages(spark, d).withColumn("parents", rule_parents(visible_text("html"), "slug"))
    return p.select("page_id", "slug", F.size("parents").alias("n_parents"), _joined("parents").alias("parents"))


# P23 -----------------------------------------------------------------------------------------------
@query("page_parents", _PARENTS_SQL)
def page_parents(spark, d):
    p = _pages(spark, d).withColumn("parents", region_parents("html", "slug", LINK_PREFIX))
    return p.select("page_id", "slug", F.size("parents").alias("n_parents"), _joined("parents").alias("parents"))


# P24 -----------------------------------------------------------------------------------------------
_CHILDREN_SQL = f"""{_LINKS_SQL},
tg AS (SELECT page_id, slug, parents, unnest(targets) AS t, unnest(range(len(targets))) AS i FROM par),
ch AS (SELECT page_id, slug, parents, i, regexp_replace(regexp_replace(string_split(t, '/')[-1], '(?s)\\?.*$', ''), '(?s)#.*$', '') AS c FROM tg),
fc AS (
  SELECT page_id, c, min(i) AS i FROM ch
  WHERE length(c) > 1 AND c <> slug AND NOT list_contains([replace(lower(x), ' ', '-') for x in parents], c) GROUP BY page_id, c),
kid AS (
  SELECT page_id, list(c ORDER BY i) AS children
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM fc) WHERE k <= {MAX_CHILDREN} GROUP BY page_id),
pc AS (SELECT par.*, coalesce(children, []) AS children FROM par LEFT JOIN kid USING (page_id))"""


@query(
    "page_children",
    f"""WITH {_CHILDREN_SQL}
        SELECT page_id, slug, CAST(len(children) AS INTEGER) AS n_children, array_to_string(children, ' | ') AS children FROM pc""",
)
def page_children(spark, d):
    p = _pages(spark, d).withColumn("parents", region_parents("html", "slug", LINK_PREFIX))
    p = p.withColumn("children", region_children("html", "slug", "parents", LINK_PREFIX))
    return p.select("page_id", "slug", F.size("children").alias("n_children"), _joined("children").alias("children"))


# P25 -----------------------------------------------------------------------------------------------
def _records(spark, d):
    return region_records(_pages(spark, d), "html", "slug", LINK_PREFIX)


_RECORDS_SQL = f"""{_CHILDREN_SQL},
nm AS ({_NAME_SQL}),
rec AS (SELECT pc.*, name, list_append(parents, name) AS path FROM pc JOIN (SELECT page_id, name FROM nm) USING (page_id))"""


@query(
    "region_record",
    f"""WITH {_RECORDS_SQL}
        SELECT page_id, slug, name, array_to_string(parents, ' | ') AS parents, array_to_string(children, ' | ') AS children,
               array_to_string(path, ' > ') AS full_hierarchy, CAST(len(parents) AS INTEGER) AS hierarchy_depth, 'html_pages' AS source
        FROM rec""",
)
def region_record(spark, d):
    r = _records(spark, d)
    return r.select(
        "page_id", "slug", "name", _joined("parents").alias("parents"), _joined("children").alias("children"),
        "full_hierarchy", "hierarchy_depth", "source",
    )


# A10 -----------------------------------------------------------------------------------------------
@query(
    "region_tree",
    f"""WITH {_RECORDS_SQL},
        nd AS (SELECT *, [x for x in path if x <> ''] AS full_path FROM rec),
        pre AS (SELECT *, full_path[1:i] AS node FROM (SELECT *, unnest(range(1, len(full_path) + 1)) AS i FROM nd)),
        g AS (SELECT node, arg_max(struct_pack(s := slug, c := children, d := len(parents)), page_id) FILTER (len(node) = len(full_path)) AS meta
              FROM pre GROUP BY node)
        SELECT array_to_string(node, ' > ') AS path, CASE WHEN len(node) > 1 THEN array_to_string(node[:-2], ' > ') END AS parent_path,
               CAST(len(node) AS INTEGER) AS depth, meta.s AS slug, array_to_string(meta.c, ' | ') AS children,
               CAST(meta.d AS INTEGER) AS hierarchy_depth FROM g""",
)
def region_tree(spark, d):
    t = hierarchy_tree(_records(spark, d), order="page_id")
    return t.select("path", "parent_path", "depth", "slug", _joined("children").alias("children"), "hierarchy_depth")


# A9 ------------------------------------------------------------------------------------------------
@query(
    "extraction_stats",
    f"""WITH {_RECORDS_SQL}
        SELECT count(*) AS total_regions_processed, count(name) AS successful_extractions,
               printf('%.1f%%', count(name) * 100.0 / count(*)) AS success_rate,
               count(*) FILTER (len(parents) > 0) AS regions_with_parents, count(*) FILTER (len(children) > 0) AS regions_with_children,
               CAST(max(len(parents)) AS INTEGER) AS max_hierarchy_depth,
               count(*) FILTER (list_contains(parents, 'France')) AS french_regions FROM rec""",
)
def extraction_stats_q(spark, d):
    r = _records(spark, d).withColumn("ok", F.col("name").isNotNull())
    return extraction_stats(r)
