"""Coordinate and crawl-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinterra.functions.text import WS_CLASS, normalize_text
from vinterra.operators.coords import attach_coords, barycentres, coverage, inject_centroids, map_points
from vinterra.operators.encode import consecutive_index
from vinterra.operators.merge import prepare_ratings
from vinterra.operators.rankings import concat_intervals, histogram, keep_first, top_share, value_counts
from vinterra.plans import standins
from vinterra.plans.q_text import _normalize_sql
from vinterra.plans.q_weather import MAX_KM, _MERGE_SQL_CTES
from vinterra.plans.registry import query, rounded, sql_str
from vinterra.sources.tables import table

# --- fixed values: the eight overlapping price intervals of the crawl (EUR) ---------
CRAWL_INTERVALS = [
    (0, 50000), (15, 500000), (21.8, 500000), (30.1, 500000),
    (42.1, 500000), (62.1, 500000), (107.1, 500000), (288.1, 500000),
]
# Share of rows covered by the "top regions" report.
TOP_SHARE = 0.9
# Bins of the distance histogram.
HIST_BINS = 50
# ---------------------------------------------------------------------------------------

_EDGE = sql_str("^[" + WS_CLASS + "]+|[" + WS_CLASS + "]+$")


def _light_sql(e: str) -> str:
    return f"replace(lower(regexp_replace({e}, {_EDGE}, '', 'g')), '-', ' ')"


# stand-ins: wines with raw coordinates, appellation centroids, corrections ------------------
def _viv(spark, d):
    w = standins.wines(spark, d)
    r = standins.regions(spark, d)
    jitter = (F.pmod(F.col("wine_id"), F.lit(7)) - 3).cast("double") / F.lit(1000.0)
    missing = F.pmod(F.col("wine_id"), F.lit(4)) == 0
    return w.join(r, "region").select(
        "wine_id", "Wine", "vintage", "region", "price",
        normalize_text("region", null_as_empty=False).alias("region_clean"),
        F.when(missing, F.lit(None).cast("double")).otherwise(F.col("latitude") + jitter).alias("latitude"),
        F.when(missing, F.lit(None).cast("double")).otherwise(F.col("longitude") + jitter).alias("longitude"),
    )


_VIV_SQL = f"""{standins.REGIONS_SQL},
{standins.WINES_SQL},
viv AS (
  SELECT wine_id, Wine, vintage, region, price, {_normalize_sql('region', null_as_empty=False)} AS region_clean,
         CASE WHEN wine_id % 4 = 0 THEN NULL ELSE latitude + CAST(wine_id % 7 - 3 AS DOUBLE) / 1000.0 END AS latitude,
         CASE WHEN wine_id % 4 = 0 THEN NULL ELSE longitude + CAST(wine_id % 7 - 3 AS DOUBLE) / 1000.0 END AS longitude
  FROM wines JOIN regions USING (region))"""


def _aoc(spark, d):
    r = standins.regions(spark, d, extra=("c_custkey",)).where(F.pmod(F.col("c_custkey"), F.lit(2)) == 0)
    return r.select(
        normalize_text("region").alias("denom_clean"),
        (F.col("latitude") + F.lit(0.5)).alias("lat"),
        (F.col("longitude") - F.lit(0.5)).alias("lon"),
    )


_AOC_SQL = f"""aoc AS (
  SELECT {_normalize_sql('r.region')} AS denom_clean, r.latitude + 0.5 AS lat, r.longitude - 0.5 AS lon
  FROM customer c JOIN regions r ON c.c_name = r.region WHERE c.c_custkey % 2 = 0)"""


def _corrections(spark, d):
    """Correction file: shouted, padded keys; dirty longitudes (en-dash minus,
    narrow no-break space); some unusable rows; some keys corrected twice."""
    base = standins.regions(spark, d, extra=("c_custkey",)).where(F.pmod(F.col("c_custkey"), F.lit(3)) == 0)
    lon_txt = F.when(
        F.col("longitude") < 0, F.concat(F.lit("–"), F.format_string("%.4f", F.abs(F.col("longitude"))))
    ).otherwise(F.concat(F.format_string("%.4f", F.col("longitude")), F.lit(" ")))
    first = base.select(
        F.concat(F.lit("  "), F.upper(F.col("region"))).alias("region_clean"),
        F.when(F.pmod(F.col("c_custkey"), F.lit(9)) == 0, F.lit("n/a"))
        .otherwise(F.format_string("%.4f", F.col("latitude") + F.lit(0.25))).alias("lat_mean"),
        lon_txt.alias("lon_mean"),
    )
    second = base.where(F.pmod(F.col("c_custkey"), F.lit(30)) == 0).select(
        F.col("region").alias("region_clean"),
        F.format_string("%.4f", F.col("latitude") + F.lit(0.3)).alias("lat_mean"),
        F.format_string("%.4f", F.col("longitude")).alias("lon_mean"),
    )
    return first.unionByName(second)


def _num_sql(e: str) -> str:
    kept = f"regexp_replace(replace(replace({e}, '–', '-'), '−', '-'), '[^\\p{{Nd}}.\\-]+', '', 'g')"
    return f"CASE WHEN regexp_full_match({kept}, '[+-]?(\\p{{Nd}}+\\.?\\p{{Nd}}*|\\.\\p{{Nd}}+)') THEN TRY_CAST({kept} AS DOUBLE) END"


_CORR_SQL = f"""corr_raw AS (
  SELECT '  ' || upper(r.region) AS region_clean,
         CASE WHEN c.c_custkey % 9 = 0 THEN 'n/a' ELSE printf('%.4f', r.latitude + 0.25) END AS lat_mean,
         CASE WHEN r.longitude < 0 THEN '–' || printf('%.4f', abs(r.longitude)) ELSE printf('%.4f', r.longitude) || ' ' END AS lon_mean
  FROM customer c JOIN regions r ON c.c_name = r.region WHERE c.c_custkey % 3 = 0
  UNION ALL
  SELECT r.region, printf('%.4f', r.latitude + 0.3), printf('%.4f', r.longitude)
  FROM customer c JOIN regions r ON c.c_name = r.region WHERE c.c_custkey % 3 = 0 AND c.c_custkey % 30 = 0),
corr AS (
  SELECT * FROM (SELECT {_light_sql('region_clean')} AS region_clean, {_num_sql('lat_mean')} AS lat_corr,
                        {_num_sql('lon_mean')} AS lon_corr FROM corr_raw)
  WHERE region_clean IS NOT NULL AND lat_corr IS NOT NULL AND lon_corr IS NOT NULL)"""

_FILLED_SQL = f"""filled AS (
  SELECT v.wine_id, v.Wine, v.region, coalesce(v.latitude, a.lat) AS latitude, coalesce(v.longitude, a.lon) AS longitude
  FROM viv v LEFT JOIN aoc a ON v.region_clean = a.denom_clean)"""


def _filled(spark, d):
    return attach_coords(_viv(spark, d), _aoc(spark, d))


# J1 -------------------------------------------------------------------------------------------
@query(
    "coord_fill",
    f"""WITH {_VIV_SQL}, {_AOC_SQL}, {_FILLED_SQL}
        SELECT wine_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM filled""",
)
def coord_fill(spark, d):
    return rounded(_filled(spark, d).select("wine_id", "latitude", "longitude"))


# J2 -------------------------------------------------------------------------------------------
_OVERRIDE_SQL = f"""{_VIV_SQL}, {_AOC_SQL}, {_FILLED_SQL}, {_CORR_SQL},
over AS (
  SELECT f.wine_id, f.Wine, coalesce(c.lat_corr, f.latitude) AS latitude, coalesce(c.lon_corr, f.longitude) AS longitude
  FROM filled f LEFT JOIN corr c ON {_light_sql('f.region')} = c.region_clean)"""


def _override(spark, d):
    return inject_centroids(_filled(spark, d), _corrections(spark, d))


@query(
    "coord_override",
    f"""WITH {_OVERRIDE_SQL}
        SELECT wine_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM over""",
)
def coord_override(spark, d):
    return rounded(_override(spark, d).select("wine_id", "latitude", "longitude"))


# A1 -------------------------------------------------------------------------------------------
@query(
    "barycentre",
    f"""WITH {_VIV_SQL}
        SELECT region_clean, round(avg(latitude), 6) AS cent_lat, round(avg(longitude), 6) AS cent_lon
        FROM viv WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND region_clean IS NOT NULL
        GROUP BY region_clean""",
)
def barycentre(spark, d):
    return rounded(barycentres(_viv(spark, d)))


# A6 -------------------------------------------------------------------------------------------
@query(
    "coverage",
    f"""WITH {_VIV_SQL}, {_AOC_SQL}, {_FILLED_SQL}
        SELECT count(*) AS n_total, count(latitude) AS n_with_coords FROM filled""",
)
def coverage_q(spark, d):
    return coverage(_filled(spark, d))


# S11 ------------------------------------------------------------------------------------------
@query(
    "map_points",
    f"""WITH {_OVERRIDE_SQL}
        SELECT Wine, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
        FROM over WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
)
def map_points_q(spark, d):
    return rounded(map_points(_override(spark, d)))


# A11 ------------------------------------------------------------------------------------------
@query(
    "dist_histogram",
    f"""WITH {_MERGE_SQL_CTES.replace('__R__', str(MAX_KM))},
        s AS (SELECT min(dist_km) AS lo, max(dist_km) AS hi FROM merged),
        b AS (SELECT CAST(CASE WHEN s.hi - s.lo > 0
                               THEN least(floor((m.dist_km - s.lo) / (s.hi - s.lo) * {HIST_BINS}), {HIST_BINS - 1})
                               ELSE 0 END AS INTEGER) AS bin, count(*) AS n
              FROM merged m, s WHERE m.dist_km IS NOT NULL GROUP BY 1),
        g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({HIST_BINS}))
        SELECT g.bin, round(s.lo + (s.hi - s.lo) * g.bin / {HIST_BINS}, 6) AS bin_lo,
               round(s.lo + (s.hi - s.lo) * (g.bin + 1) / {HIST_BINS}, 6) AS bin_hi, coalesce(b.n, 0) AS n
        FROM g CROSS JOIN s LEFT JOIN b ON g.bin = b.bin WHERE s.hi IS NOT NULL""",
)
def dist_histogram(spark, d):
    from vinterra.plans.q_weather import merged_table

    return rounded(histogram(merged_table(spark, d), "dist_km", HIST_BINS))


# A8 -------------------------------------------------------------------------------------------
_VIVP_SQL = f"""{standins.WINES_SQL},
vivp AS (
  SELECT wine_id, Wine, vintage, region, price / 1000.0 AS price, {standins.DOMINANT_SQL} AS cepages,
         CAST(CASE WHEN regexp_full_match(vintage, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')
                   THEN TRY_CAST(trim(vintage) AS DOUBLE) END AS INTEGER) AS year
  FROM wines WHERE {standins.DOMINANT_SQL} IS NOT NULL)"""


def _vivp(spark, d):
    w = standins.wines(spark, d).withColumn("price", F.col("price") / F.lit(1000.0))
    return prepare_ratings(w)


@query(
    "vintage_counts",
    f"""WITH {_VIVP_SQL} SELECT year, count(*) AS n FROM vivp WHERE year IS NOT NULL GROUP BY year""",
)
def vintage_counts(spark, d):
    return value_counts(_vivp(spark, d), "year", sort="key")


# W3 -------------------------------------------------------------------------------------------
@query(
    "top_share",
    f"""WITH {_VIVP_SQL},
        c AS (SELECT region, count(*) AS n FROM vivp WHERE region IS NOT NULL GROUP BY region),
        r AS (SELECT region, n, sum(n) OVER (ORDER BY n DESC, region ROWS UNBOUNDED PRECEDING) AS cum_n,
                     sum(n) OVER () AS total FROM c)
        SELECT region, n, CAST(cum_n AS BIGINT) AS cum_n, round(cum_n / total, 6) AS cum_share
        FROM r WHERE cum_n / total <= {TOP_SHARE}""",
)
def top_share_q(spark, d):
    return rounded(top_share(_vivp(spark, d), "region", TOP_SHARE))


# U1 + W1 --------------------------------------------------------------------------------------
def _crawl(spark, d):
    w = standins.wines(spark, d).withColumn("price", F.col("price") / F.lit(1000.0))
    return concat_intervals(w, CRAWL_INTERVALS)


def _dedup(spark, d):
    return keep_first(_crawl(spark, d), ["Wine", "vintage"], ["interval_id", "price", "wine_id"])


_INTERVALS_SQL = "(VALUES " + ", ".join(f"({i}, {float(lo)}, {float(hi)})" for i, (lo, hi) in enumerate(CRAWL_INTERVALS)) + ") iv(interval_id, lo, hi)"
_DEDUP_SQL = f"""{standins.WINES_SQL},
crawl AS (
  SELECT w.wine_id, w.Winery, w.Wine, w.vintage, w.region, w.price / 1000.0 AS price, w.cepages, iv.interval_id
  FROM wines w JOIN {_INTERVALS_SQL} ON w.price / 1000.0 >= iv.lo AND w.price / 1000.0 <= iv.hi),
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY Wine, vintage ORDER BY interval_id, price, wine_id) AS rn FROM crawl)
  WHERE rn = 1)"""


@query(
    "dedupe_first",
    f"""WITH {_DEDUP_SQL}
        SELECT wine_id, Winery, Wine, vintage, region, round(price, 6) AS price, cepages, interval_id FROM dedup""",
)
def dedupe_first(spark, d):
    return rounded(_dedup(spark, d))


# W2 -------------------------------------------------------------------------------------------
@query(
    "price_sort",
    f"""WITH {_DEDUP_SQL}
        SELECT Wine, vintage, round(price, 6) AS price,
               CAST(row_number() OVER (ORDER BY price NULLS LAST, Wine, vintage) - 1 AS BIGINT) AS pos
        FROM dedup""",
)
def price_sort(spark, d):
    dd = _dedup(spark, d).select("Wine", "vintage", "price")
    ordered = consecutive_index(dd, [F.col("price").asc_nulls_last(), F.col("Wine"), F.col("vintage")], "pos")
    return rounded(ordered.select("Wine", "vintage", "price", "pos"))
