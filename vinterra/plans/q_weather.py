"""Climate, nearest-station and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinterra.functions.features import add_engineered_features, drop_numeric_columns
from vinterra.functions.geo import haversine_sql
from vinterra.operators.climate import CLIMATE_COLUMNS
from vinterra.operators.encode import dense_codes
from vinterra.operators.merge import merge_ratings_with_weather, prepare_ratings, region_weather
from vinterra.operators.nearest import attach_nearest, expand_years
from vinterra.plans import standins
from vinterra.plans.registry import query, rounded

MAX_KM = 40.0
WIDE_KM = 150.0
Y0, Y1 = standins.YEAR_RANGE

_MET = list(CLIMATE_COLUMNS)
_MET_SQL = ", ".join(f"round({c}, 6) AS {c}" if c not in ("hot_days", "rainy_days_summer", "frost_days_Apr") else c for c in _MET)

_BASE_CTES = f"""{standins.REGIONS_SQL},
{standins.WEATHER_SQL},
ry AS (SELECT r.region, r.latitude, r.longitude, CAST(y.year AS INTEGER) AS year
       FROM regions r, range({Y0}, {Y1}) y(year))"""


def _nearest_cte(left: str, keys: str) -> str:
    """Brute-force nearest station per left row (ties -> smallest station)."""
    dist = haversine_sql("l.latitude", "l.longitude", "w.latitude", "w.longitude")
    return f"""cand AS (
  SELECT {keys}, w.station AS n_station, {dist} AS n_dist,
         row_number() OVER (PARTITION BY {keys} ORDER BY {dist}, w.station) AS rn
  FROM {left} l JOIN weather w ON l.year = w.year
  WHERE l.latitude IS NOT NULL AND l.longitude IS NOT NULL),
best AS (SELECT * FROM cand WHERE rn = 1)"""


# A15 / S3 ----------------------------------------------------------------------------------
@query(
    "climate_year",
    f"""WITH {standins.WEATHER_SQL}
        SELECT station, year, latitude, longitude, {_MET_SQL} FROM weather""",
)
def climate_year(spark, d):
    return rounded(standins.weather(spark, d))


# J3 ------------------------------------------------------------------------------------------
@query(
    "region_years",
    f"""WITH {_BASE_CTES} SELECT region, latitude, longitude, year FROM ry""",
)
def region_years(spark, d):
    return expand_years(standins.regions(spark, d), Y0, Y1)


# Soft radius, all metrics ----------------------------------------------------------
_SOFT_SELECT = ", ".join(
    ["CASE WHEN n_dist <= {r} THEN n_station END AS station"]
    + [
        f"CASE WHEN n_dist <= {{r}} THEN {('round(w.' + c + ', 6)') if c not in ('hot_days', 'rainy_days_summer', 'frost_days_Apr') else 'w.' + c} END AS {c}"
        for c in _MET
    ]
)


@query(
    "nearest_soft",
    f"""WITH {_BASE_CTES}, {_nearest_cte('ry', 'l.region, l.year, l.latitude, l.longitude')}
        SELECT b.region, b.year, b.latitude, b.longitude, {_SOFT_SELECT.format(r=MAX_KM)}, round(b.n_dist, 6) AS dist_km
        FROM best b JOIN weather w ON w.year = b.year AND w.station = b.n_station""",
)
def nearest_soft(spark, d):
    rw = region_weather(standins.regions(spark, d), standins.weather(spark, d), max_km=MAX_KM, year_range=(Y0, Y1))
    return rounded(rw)


# Hard radius, all metrics -------------------------------------------------------------
@query(
    "nearest_hard",
    f"""WITH {_BASE_CTES}, {_nearest_cte('ry', 'l.region, l.year, l.latitude, l.longitude')}
        SELECT b.region, b.year, b.latitude, b.longitude, b.n_station AS station,
               {', '.join(('round(w.' + c + ', 6)' if c not in ('hot_days', 'rainy_days_summer', 'frost_days_Apr') else 'w.' + c) + ' AS ' + c for c in _MET)},
               round(b.n_dist, 6) AS dist_km
        FROM best b JOIN weather w ON w.year = b.year AND w.station = b.n_station
        WHERE b.n_dist <= {MAX_KM}""",
)
def nearest_hard(spark, d):
    ry = expand_years(standins.regions(spark, d), Y0, Y1)
    return rounded(attach_nearest(ry, standins.weather(spark, d), max_km=MAX_KM, mode="drop", payload="all"))


# Station id + distance for each wine -----------------------------------------------------
_WINE_POINTS_SQL = f"""{standins.WINES_SQL},
wp AS (
  SELECT w.wine_id, CAST(TRY_CAST(w.vintage AS DOUBLE) AS INTEGER) AS year, r.latitude, r.longitude
  FROM wines w JOIN regions r USING (region)
  WHERE {standins.DOMINANT_SQL.replace('cepages', 'w.cepages')} IS NOT NULL
    AND regexp_full_match(w.vintage, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*'))"""


def _wine_points(spark, d):
    viv = prepare_ratings(standins.wines(spark, d))
    return viv.join(standins.regions(spark, d).hint("merge"), "region").select("wine_id", "year", "latitude", "longitude")


@query(
    "nearest_station_id",
    f"""WITH {standins.REGIONS_SQL}, {standins.WEATHER_SQL}, {_WINE_POINTS_SQL},
        {_nearest_cte('wp', 'l.wine_id, l.year')}
        SELECT wine_id, year, n_station AS wx_station, round(n_dist, 6) AS wx_dist_km
        FROM best WHERE n_dist <= {MAX_KM}""",
)
def nearest_station_id(spark, d):
    out = attach_nearest(
        _wine_points(spark, d), standins.weather(spark, d), max_km=MAX_KM, mode="drop", payload="station",
        station_out="wx_station", dist_col="wx_dist_km",
    )
    return rounded(out.select("wine_id", "year", "wx_station", "wx_dist_km"))


# Grid search with a wide radius (several cells per point) ------------------------------------------
@query(
    "nearest_grid",
    f"""WITH {_BASE_CTES}, {_nearest_cte('ry', 'l.region, l.year')}
        SELECT region, year, n_station AS station, round(n_dist, 6) AS dist_km
        FROM best WHERE n_dist <= {WIDE_KM}""",
)
def nearest_grid(spark, d):
    ry = expand_years(standins.regions(spark, d), Y0, Y1)
    out = attach_nearest(ry, standins.weather(spark, d), max_km=WIDE_KM, mode="drop", payload="station")
    return rounded(out.select("region", "year", "station", "dist_km"))


# J4 flagship: ratings x regional climate -------------------------------------------------------------
_MERGE_SQL_CTES = f"""{_BASE_CTES}, {_nearest_cte('ry', 'l.region, l.year, l.latitude, l.longitude')},
rw AS (
  SELECT b.region, b.year, b.latitude, b.longitude, b.n_station AS station, w.GDD, w.TM_summer, w.TX_summer,
         w.temp_amp_summer, w.hot_days, w.rainy_days_summer, w.rain_June, w.rain_SepOct, w.frost_days_Apr,
         w.avg_TM_Apr, b.n_dist AS dist_km
  FROM best b JOIN weather w ON w.year = b.year AND w.station = b.n_station WHERE b.n_dist <= __R__),
{standins.WINES_SQL},
viv AS (
  SELECT wine_id, Winery, Wine, vintage, region, price, {standins.DOMINANT_SQL} AS cepages,
         CAST(CASE WHEN regexp_full_match(vintage, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')
                   THEN TRY_CAST(trim(vintage) AS DOUBLE) END AS INTEGER) AS year
  FROM wines),
merged AS (
  SELECT v.*, rw.latitude, rw.longitude, rw.station, rw.GDD, rw.TM_summer, rw.TX_summer, rw.temp_amp_summer,
         rw.hot_days, rw.rainy_days_summer, rw.rain_June, rw.rain_SepOct, rw.frost_days_Apr, rw.avg_TM_Apr, rw.dist_km
  FROM viv v LEFT JOIN rw ON v.region = rw.region AND v.year = rw.year
  WHERE v.cepages IS NOT NULL AND v.year IS NOT NULL AND rw.hot_days IS NOT NULL)"""

_MERGE_COLS = (
    "wine_id, region, year, cepages, price, station, round(dist_km, 6) AS dist_km, "
    + ", ".join(("round(" + c + ", 6) AS " + c) if c not in ("hot_days", "rainy_days_summer", "frost_days_Apr") else c for c in _MET)
)


def merged_table(spark, d, max_km: float = MAX_KM):
    return merge_ratings_with_weather(
        standins.wines(spark, d), standins.regions(spark, d), standins.weather(spark, d),
        max_km=max_km, year_range=(Y0, Y1),
    )


def _merge_view(df):
    return rounded(df.select("wine_id", "region", "year", "cepages", "price", "station", "dist_km", *_MET))


@query("rating_climate_merge", f"WITH {_MERGE_SQL_CTES.replace('__R__', str(MAX_KM))} SELECT {_MERGE_COLS} FROM merged")
def rating_climate_merge(spark, d):
    return _merge_view(merged_table(spark, d))


# Numeric features on the merged table -----------------------------------------------------------
_FEATURE_IDS = ["A", "B", "C", "D", "E", "I", "Z"]  # "Z" is in no registry and is ignored


@query(
    "feature_numeric",
    f"""WITH {_MERGE_SQL_CTES.replace('__R__', str(MAX_KM))}
        SELECT wine_id,
               round(CASE WHEN rain_June + rain_SepOct + 1.0 <> 0 THEN GDD / (rain_June + rain_SepOct + 1.0) END, 6) AS heat_to_rain_ratio,
               round(TX_summer - TM_summer, 6) AS diurnal_range_summer,
               round(CASE WHEN TX_summer + 1.0 <> 0 THEN hot_days / (TX_summer + 1.0) END, 6) AS hot_day_intensity,
               round(CASE WHEN avg_TM_Apr + 1.0 <> 0 THEN frost_days_Apr / (avg_TM_Apr + 1.0) END, 6) AS frost_risk_index,
               round(CASE WHEN GDD + 1.0 <> 0 THEN price / (GDD + 1.0) END, 6) AS price_per_heat_unit,
               round(CASE WHEN price > -1 THEN ln(1 + price) END, 6) AS log_price
        FROM merged""",
)
def feature_numeric(spark, d):
    m = merged_table(spark, d)
    out, num_cols, _ = add_engineered_features(m, [], [], _FEATURE_IDS)
    return rounded(out.select("wine_id", *num_cols))


# Categorical feature J on integer codes (sorted-value codes, W5) ---------------------------------------
@query(
    "feature_categorical",
    f"""WITH {_MERGE_SQL_CTES.replace('__R__', str(MAX_KM))},
        rc AS (SELECT region AS v, CAST(row_number() OVER (ORDER BY region) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT region FROM merged)),
        sc AS (SELECT station AS v, CAST(row_number() OVER (ORDER BY station) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT station FROM merged))
        SELECT m.wine_id, rc.code AS region, sc.code AS station, rc.code * 1000 + sc.code AS region_station_id
        FROM merged m JOIN rc ON m.region = rc.v JOIN sc ON m.station = sc.v""",
)
def feature_categorical(spark, d):
    m = merged_table(spark, d)
    rc = dense_codes(m.select(F.col("region").alias("value")), ["value"]).withColumnRenamed("code", "region_code")
    sc = dense_codes(m.select(F.col("station").alias("value")), ["value"]).withColumnRenamed("code", "station_code")
    coded = (
        m.join(rc.hint("merge"), m.region == rc.value).drop("value")
        .join(sc.hint("merge"), m.station == sc.value).drop("value")
        .select("wine_id", F.col("region_code").alias("region"), F.col("station_code").alias("station"))
    )
    out, _, cat_cols = add_engineered_features(coded, [], ["region", "station"], ["J"])
    return out.select("wine_id", *cat_cols)


# Drop numeric columns ------------------------------------------------------------------------------------
_KEEP = [c for c in _MET if c not in ("GDD", "rain_June")]


@query(
    "feature_drop",
    f"""WITH {_MERGE_SQL_CTES.replace('__R__', str(MAX_KM))}
        SELECT wine_id, {', '.join(('round(' + c + ', 6) AS ' + c) if c not in ('hot_days', 'rainy_days_summer', 'frost_days_Apr') else c for c in _KEEP)}
        FROM merged""",
)
def feature_drop(spark, d):
    m = merged_table(spark, d).select("wine_id", *_MET)
    out, _ = drop_numeric_columns(m, _MET, ["GDD", "rain_June", "not_a_column"])
    return rounded(out)
