"""Ratings x regional weather merge (J3 + J6 + J4, P6, P7, P10).

``merge_ratings_with_weather`` is the end-to-end job: parse the dominant grape,
coerce the vintage, expand every region over the year range, attach the
nearest station's climate per region-year, and join the wines on
``(region, year)`` keeping rows with a climate value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinterra.functions.grapes import dominant_item_any
from vinterra.functions.numbers import coerce_numeric
from vinterra.operators.nearest import attach_nearest, expand_years
from vinterra.session import as_table
from vinterra.sources.io import weather_of_years


def prepare_ratings(wines: DataFrame, grape_col: str = "cepages", vintage_col: str = "vintage") -> DataFrame:
    """Dominant grape replaces the list (rows without one are removed); ``year``
    is the numeric vintage (NULL for ``N.V.``; a non-integral value can never
    match a year and is also NULL)."""
    v = coerce_numeric(vintage_col)
    return (
        wines.withColumn(grape_col, dominant_item_any(wines.schema, grape_col))
        .where(F.col(grape_col).isNotNull())
        .withColumn("year", F.when(v == F.floor(v), v.cast("int")))
    )


def region_weather(
    regions: DataFrame, weather: DataFrame, *, max_km: float, year_range: tuple[int, int], mode: str = "null"
) -> DataFrame:
    """J3 + J6: regions x years with the nearest station's climate (soft radius)."""
    return attach_nearest(expand_years(regions, *year_range), weather, max_km=max_km, mode=mode, payload="all")


def merge_ratings_with_weather(
    wines: DataFrame,
    regions: DataFrame,
    weather: DataFrame,
    *,
    max_km: float = 40.0,
    year_range: tuple[int, int] = (2010, 2025),
    required: str = "hot_days",
) -> DataFrame:
    """Wines LEFT JOIN region-weather ON (region, year), then rows lacking
    the grape, the year or ``required`` are dropped -- an inner join in effect,
    which Catalyst derives itself (EliminateOuterJoin).

    The region-weather side is computed with the hard radius: a row beyond the
    radius carries NULL climate in the soft variant and is removed by the
    ``required`` filter anyway, so both give the same rows and values, and the
    hard variant needs no search beyond the radius.
    """
    viv = prepare_ratings(wines)
    rw = region_weather(regions, weather, max_km=max_km, year_range=year_range, mode="drop")
    merged = viv.join(rw.hint("merge"), ["region", "year"], "left")  # both sides grow: no broadcast
    return merged.where(F.col("cepages").isNotNull() & F.col("year").isNotNull() & F.col(required).isNotNull())


def merge_ratings_with_yearly_weather(
    wines: DataFrame, regions: DataFrame, weather: DataFrame, *, max_km: float = 40.0, year_range: tuple[int, int] = (2010, 2025)
) -> DataFrame:
    """S3 + J4 over yearly tables: only the years in which a rated wine of ``year_range`` was made are read
    (``weather`` from ``read_weather`` on a ``year=`` layout).  Same rows as ``merge_ratings_with_weather``.

    The years are written first: a few rows, read once by the pruning and by the search."""
    start, end = year_range
    made = prepare_ratings(wines).select("year").where((F.col("year") >= start) & (F.col("year") < end)).distinct()
    years = as_table(made, "vintage-years")
    return merge_ratings_with_weather(wines, regions, weather_of_years(weather, years), max_km=max_km, year_range=year_range)
