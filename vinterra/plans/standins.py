"""Stand-in tables derived by Spark from the given TPC-H-like tables.

Each concept of the domain (regions, weather stations, daily observations,
rated wines) is derived from a given table so that every job's work grows with
the input.  Every builder has its SQL twin used by the DuckDB oracles; the two
are kept next to each other on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinterra.operators.climate import station_year_climate
from vinterra.sources.tables import table

# --- stand-in coordinate rules (ours) -------------------------------------------
REGION_LAT_MULT, REGION_LON_MULT = 7919, 104729
STATION_LAT_MULT, STATION_LON_MULT = 6007, 15485863
LAT_BASE, LAT_SPAN = 42.0, 8000
LON_BASE, LON_SPAN = -4.0, 12000
# Years expanded for every region: 1994 has no weather at all (missing-year rule).
YEAR_RANGE = (1994, 2002)
# ----------------------------------------------------------------------------------


def _coord(key: str, mult: int, base: float, span: int):
    return F.lit(base) + F.pmod(F.col(key) * F.lit(mult), F.lit(span)).cast("double") / F.lit(1000.0)


def _coord_sql(key: str, mult: int, base: float, span: int) -> str:
    return f"({base} + CAST(({key} * {mult}) % {span} AS DOUBLE) / 1000.0)"


# regions -------------------------------------------------------------------------
def regions(spark: SparkSession, d: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Regions from ``customer``; ``extra`` keeps customer columns alongside
    (so callers never join the regions back to their source)."""
    return table(spark, d, "customer").select(
        *extra,
        F.col("c_name").alias("region"),
        _coord("c_custkey", REGION_LAT_MULT, LAT_BASE, LAT_SPAN).alias("latitude"),
        _coord("c_custkey", REGION_LON_MULT, LON_BASE, LON_SPAN).alias("longitude"),
    )


REGIONS_SQL = f"""regions AS (
  SELECT c_name AS region,
         {_coord_sql('c_custkey', REGION_LAT_MULT, LAT_BASE, LAT_SPAN)} AS latitude,
         {_coord_sql('c_custkey', REGION_LON_MULT, LON_BASE, LON_SPAN)} AS longitude
  FROM customer)"""


# stations --------------------------------------------------------------------------
def station_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("station_key"),
        F.col("s_name").alias("station"),
        _coord("s_suppkey", STATION_LAT_MULT, LAT_BASE, LAT_SPAN).alias("latitude"),
        _coord("s_suppkey", STATION_LON_MULT, LON_BASE, LON_SPAN).alias("longitude"),
    )


STATIONS_SQL = f"""stations AS (
  SELECT s_suppkey AS station_key, s_name AS station,
         {_coord_sql('s_suppkey', STATION_LAT_MULT, LAT_BASE, LAT_SPAN)} AS latitude,
         {_coord_sql('s_suppkey', STATION_LON_MULT, LON_BASE, LON_SPAN)} AS longitude
  FROM supplier)"""


# weather: climate per station-year with coordinates ---------------------------------
def weather(spark: SparkSession, d: str) -> DataFrame:
    """Yearly weather table: ``station, year, latitude, longitude`` + climate columns.

    Aggregates the observations first (partial aggregation), then attaches the
    station dimension -- never the other way round.  Stations grow too: no broadcast by their file size."""
    obs = table(spark, d, "lineitem")
    clim = station_year_climate(obs, "l_suppkey", "l_shipdate", "l_quantity", "l_tax")
    return clim.join(station_points(spark, d).hint("merge"), "station_key").select(
        "station", "year", "latitude", "longitude",
        "GDD", "TM_summer", "TX_summer", "temp_amp_summer", "hot_days", "rainy_days_summer",
        "rain_June", "rain_SepOct", "frost_days_Apr", "avg_TM_Apr",
    )


CLIMATE_SQL = """climate AS (
  SELECT l_suppkey AS station_key, CAST(year(l_shipdate) AS INTEGER) AS year,
         sum(CASE WHEN month(l_shipdate) BETWEEN 4 AND 10 THEN greatest(l_quantity - 10.0, 0.0) END) AS GDD,
         avg(CASE WHEN month(l_shipdate) BETWEEN 6 AND 8 THEN l_quantity END) AS TM_summer,
         max(CASE WHEN month(l_shipdate) BETWEEN 6 AND 8 THEN l_quantity END) AS TX_summer,
         CAST(count_if(month(l_shipdate) BETWEEN 6 AND 8 AND l_quantity >= 35.0) AS BIGINT) AS hot_days,
         CAST(count_if(month(l_shipdate) BETWEEN 6 AND 8 AND l_tax >= 0.05) AS BIGINT) AS rainy_days_summer,
         sum(CASE WHEN month(l_shipdate) = 6 THEN l_tax END) AS rain_June,
         sum(CASE WHEN month(l_shipdate) BETWEEN 9 AND 10 THEN l_tax END) AS rain_SepOct,
         CAST(count_if(month(l_shipdate) = 4 AND l_quantity < 5.0) AS BIGINT) AS frost_days_Apr,
         avg(CASE WHEN month(l_shipdate) = 4 THEN l_quantity END) AS avg_TM_Apr
  FROM lineitem GROUP BY 1, 2)"""

WEATHER_SQL = f"""{STATIONS_SQL},
{CLIMATE_SQL},
weather AS (
  SELECT s.station, c.year, s.latitude, s.longitude, c.GDD, c.TM_summer, c.TX_summer,
         c.TX_summer - c.TM_summer AS temp_amp_summer, c.hot_days, c.rainy_days_summer,
         c.rain_June, c.rain_SepOct, c.frost_days_Apr, c.avg_TM_Apr
  FROM climate c JOIN stations s USING (station_key))"""


# wines (rated products): orders x customer ----------------------------------------------
def _grape():
    return F.lower(F.regexp_replace(F.col("o_orderpriority"), "^[0-9]-", ""))


def wines(spark: SparkSession, d: str) -> DataFrame:
    """Crawled wine table: ``wine_id, Winery, Wine, vintage (text), region, price, cepages``.

    ``cepages`` is a Python-literal list as the crawl stores it: two grapes for
    finished orders, one for open ones, and empty / malformed / missing values
    for pending ones.  ``vintage`` is text with some non-vintage ``N.V.`` rows."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    year_txt = F.year("o_orderdate").cast("string")
    g = _grape()
    cep = (
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("[{'seo_name': '"), g, F.lit("', 'is_main': True}, {'seo_name': 'merlot', 'is_main': False}]")),
        )
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("[{'seo_name': '"), g, F.lit("', 'share': None}]")))
        .when(F.pmod(F.col("o_orderkey"), F.lit(3)) == 0, F.lit("[]"))
        .when(F.pmod(F.col("o_orderkey"), F.lit(3)) == 1, F.lit("[{'wrong_key': 'nope'}]"))
    )
    return o.join(c.hint("merge"), o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("wine_id"),
        F.concat(F.lit("Winery "), F.col("c_nationkey").cast("string")).alias("Winery"),
        F.concat(F.lit("Cuvée "), F.col("o_orderpriority"), F.lit(" "), year_txt).alias("Wine"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(23)) == 0, F.lit("N.V.")).otherwise(year_txt).alias("vintage"),
        F.col("c_name").alias("region"),
        F.col("o_totalprice").alias("price"),
        cep.alias("cepages"),
    )


_GRAPE_SQL = "lower(regexp_replace(o_orderpriority, '^[0-9]-', ''))"
WINES_SQL = f"""wines AS (
  SELECT o_orderkey AS wine_id,
         'Winery ' || CAST(c_nationkey AS VARCHAR) AS Winery,
         'Cuvée ' || o_orderpriority || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS Wine,
         CASE WHEN o_orderkey % 23 = 0 THEN 'N.V.' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS vintage,
         c_name AS region,
         o_totalprice AS price,
         CASE WHEN o_orderstatus = 'F'
                THEN '[{{''seo_name'': ''' || {_GRAPE_SQL} || ''', ''is_main'': True}}, {{''seo_name'': ''merlot'', ''is_main'': False}}]'
              WHEN o_orderstatus = 'O'
                THEN '[{{''seo_name'': ''' || {_GRAPE_SQL} || ''', ''share'': None}}]'
              WHEN o_orderkey % 3 = 0 THEN '[]'
              WHEN o_orderkey % 3 = 1 THEN '[{{''wrong_key'': ''nope''}}]'
         END AS cepages
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# Oracle-side extraction of the first grape from the literal format generated above.
DOMINANT_SQL = (
    "NULLIF(regexp_extract(cepages, '^\\s*\\[\\s*\\{[^{}]*''seo_name''\\s*:\\s*''([^'']*)''', 1), '')"
)
