"""Readers and writers.

Writers never funnel data through one task: CSV and parquet are written as
directories of part files, GeoJSON as newline-delimited features (one line
per polygon part), reports as JSON lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------------------------
WEATHER_FILE_YEAR = r"weather_cleaned_(\d{4})\.parquet$"   # year of a yearly weather file
COORD_RENAMES = {"lat": "latitude", "lon": "longitude"}
# ------------------------------------------------------------------------------------------------


# S1 -------------------------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV with an explicit schema (inference only when none is given)."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


# S3 -------------------------------------------------------------------------------------------
def read_weather(
    spark: SparkSession, path: str, years: Sequence[int] | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """Yearly weather tables as one DataFrame with ``year``.

    ``path`` is either a ``year=YYYY`` partitioned directory (partition pruning
    and dynamic pruning from a join on ``year`` come for free) or a folder of
    ``weather_cleaned_YYYY.parquet`` files (year parsed from the file name).
    ``lat``/``lon`` count as ``latitude``/``longitude`` and become DOUBLE; files
    with different columns or spellings are merged, for which the footer of every
    file is read; with ``schema`` (all columns, ``year`` too) none is."""
    df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.option("mergeSchema", True).parquet(path)
    if "year" not in df.columns:
        df = df.withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), WEATHER_FILE_YEAR, 1).cast("int"))
    # files of both spellings may be mixed: a row has one of the two names
    coords = {}
    for short, full in COORD_RENAMES.items():
        names = [c for c in (full, short) if c in df.columns]
        coords[full] = F.coalesce(*[F.col(c).cast("double") for c in names])
    df = df.withColumns(coords).drop(*COORD_RENAMES)
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    return df


def weather_of_years(weather: DataFrame, left: DataFrame, year: str = "year") -> DataFrame:
    """Rows of ``weather`` of the years that occur in ``left[year]``.

    Over a ``year=YYYY`` layout the years found at run time prune the folders (dynamic partition
    pruning): files of other years are not opened.  Years have at most four digits, so the
    broadcast holds at most 10,000 of them; NULL and other years match nothing."""
    wanted = left.select(F.col(year).cast("int").alias("_wanted")).where(F.col("_wanted").between(0, 9999)).distinct()
    return weather.join(F.broadcast(wanted), weather["year"] == wanted["_wanted"], "left_semi")


# S7 / S8 --------------------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# S9 -------------------------------------------------------------------------------------------
def geojson_features(parts: DataFrame, props: Sequence[str], rings: str = "rings", keep: Sequence[str] = ()) -> DataFrame:
    """One GeoJSON Feature (text ``value``) per polygon row, WGS84 coordinates; ``keep``: columns beside it."""
    coords = F.transform(F.col(rings), lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(c) for c in props]).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
    )
    return parts.select(*keep, F.to_json(feature).alias("value"))


def write_geojson_lines(parts: DataFrame, path: str, props: Sequence[str], rings: str = "rings") -> None:
    """Newline-delimited GeoJSON features (readers group parts by property)."""
    geojson_features(parts, props, rings).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# S11 ------------------------------------------------------------------------------------------
def write_map_points(points: DataFrame, path: str) -> bool:
    """Points with both coordinates as GeoJSON point features; nothing is
    written for an empty table.  Returns whether anything was written."""
    if points.isEmpty():
        return False
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("Wine").alias("Wine")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
    )
    points.select(F.to_json(feat).alias("value")).write.mode("overwrite").text(path)
    return True
