"""Landed crawl responses -> rating rows (S4) and the request work-list.

Responses are parsed once into VARIANT.  ``variant_get(v, path, 'variant')``
is NULL when the path is *missing* but a (non-NULL) variant holding JSON null
when the leaf is present-but-null -- exactly the rule of the crawl: a match
missing any path is skipped, a present null leaf is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinterra.functions._cols import as_col

# --- fixed values: response paths of one match -> output column (and type) ----------------
MATCH_FIELDS = [
    ("Winery", "$.vintage.wine.winery.name", "string"),
    ("wine_name", "$.vintage.wine.name", "string"),
    ("vintage", "$.vintage.year", "string"),
    ("vintage_rating", "$.vintage.statistics.ratings_average", "double"),
    ("vintage_rating_count", "$.vintage.statistics.ratings_count", "bigint"),
    ("wine_rating", "$.vintage.statistics.wine_ratings_average", "double"),
    ("wine_rating_count", "$.vintage.statistics.wine_ratings_count", "bigint"),
    ("region", "$.vintage.wine.region.seo_name", "string"),
    ("price", "$.price.amount", "double"),
    ("cepages", "$.vintage.wine.style.grapes", "variant"),
]
MATCHES_PATH = "$.explore_vintage.matches"
TOTAL_PATH = "$.explore_vintage.records_matched"
# ---------------------------------------------------------------------------------------------


def _as_text(c: Column) -> Column:
    """Python's f-string rendering of a value: missing/null -> 'None'."""
    return F.coalesce(c, F.lit("None"))


def flatten_responses(responses: DataFrame, json_col: str = "response", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per match; ``Wine = name + ' ' + year``; the grape list stays a
    VARIANT array (``dominant_grape`` reads its first ``seo_name``).  The vintage
    stays text (``N.V.`` is one; P6 makes numbers of it later); a response whose
    matches are no list has no rows."""
    parsed = responses.select(*keep, F.try_parse_json(as_col(json_col)).alias("_v"))
    matches = parsed.select(
        *keep, F.posexplode(F.try_variant_get("_v", MATCHES_PATH, "array<variant>")).alias("match_pos", "_m")
    )
    present = F.lit(True)
    for _, path, _ in MATCH_FIELDS:
        present = present & F.variant_get("_m", path, "variant").isNotNull()
    cols = {name: F.try_variant_get("_m", path, typ) for name, path, typ in MATCH_FIELDS}
    wine = F.concat(
        _as_text(F.try_variant_get("_m", "$.vintage.wine.name", "string")),
        F.lit(" "),
        _as_text(F.try_variant_get("_m", "$.vintage.year", "string")),
    )
    out = matches.where(present).select(*keep, "match_pos", *[c.alias(n) for n, c in cols.items()], wine.alias("Wine"))
    return out.select(*keep, "match_pos", "Winery", "Wine", *[n for n, _, _ in MATCH_FIELDS if n not in ("Winery", "wine_name")])


def dominant_grape(grapes: str = "cepages", key: str = "seo_name") -> Column:
    """P7 on a grape array: first element's ``key``, NULL if absent."""
    return F.try_variant_get(F.col(grapes), f"$[0].{key}", "string")


def request_plan(totals: DataFrame, total_col: str = "records_matched", per_page_col: str = "per_page") -> DataFrame:
    """One request row per page: pages = ceil(total / per_page)."""
    pages = F.ceil(F.col(total_col) / F.col(per_page_col)).cast("int")
    return totals.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest(pages, F.lit(1))))).where(
        F.col(total_col) > 0
    )
