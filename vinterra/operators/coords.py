"""Coordinate fill, override and barycentres.

Lookups against the appellation-centroid and correction tables are plain
left equi-joins.  No broadcast is forced: both tables are dimensions and AQE
broadcasts them from their measured runtime size; if they ever grow past the
threshold the join stays a shuffled hash/sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinterra.functions.numbers import parse_dirty_number
from vinterra.functions.text import light_key


def attach_coords(
    viv: DataFrame, aoc: DataFrame, key: str = "region_clean", aoc_key: str = "denom_clean",
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """J1 + P9: left join on the cleaned name; keep existing coordinates, else
    take the appellation centroid."""
    a = aoc.select(F.col(aoc_key).alias("_aoc_key"), F.col("lat").alias("_lat_aoc"), F.col("lon").alias("_lon_aoc"))
    j = viv.join(a, viv[key] == a["_aoc_key"], "left")
    return j.withColumns(
        {lat: F.coalesce(F.col(lat), F.col("_lat_aoc")), lon: F.coalesce(F.col(lon), F.col("_lon_aoc"))}
    ).drop("_aoc_key", "_lat_aoc", "_lon_aoc")


def cast_coords(df: DataFrame, lat: str = "latitude", lon: str = "longitude", strict: bool = False) -> DataFrame:
    """Non-strict (NULL on failure) or strict cast to DOUBLE."""
    if strict:
        return df.withColumns({lat: F.col(lat).cast("double"), lon: F.col(lon).cast("double")})
    return df.withColumns({lat: F.col(lat).try_cast("double"), lon: F.col(lon).try_cast("double")})


def barycentres(df: DataFrame, key: str = "region_clean", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A1: mean latitude/longitude per key over rows having all three values."""
    clean = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(key).isNotNull())
    return clean.groupBy(key).agg(F.avg(lat).alias("cent_lat"), F.avg(lon).alias("cent_lon"))


def prepare_corrections(corr: DataFrame, key: str = "region_clean", lat_text: str = "lat_mean",
                        lon_text: str = "lon_mean", strict_numbers: bool = False) -> DataFrame:
    """P3 on the key, P5 on the dirty coordinate text; incomplete rows removed."""
    out = corr.select(
        light_key(F.col(key).cast("string")).alias("region_clean"),
        parse_dirty_number(lat_text, strict=strict_numbers).alias("lat_corr"),
        parse_dirty_number(lon_text, strict=strict_numbers).alias("lon_corr"),
    )
    return out.dropna(subset=["region_clean", "lat_corr", "lon_corr"])


def inject_centroids(viv: DataFrame, corr: DataFrame, region: str = "region", lat: str = "latitude",
                     lon: str = "longitude", strict_numbers: bool = False) -> DataFrame:
    """Corrected coordinates override existing ones.  The left join fans
    out when a key is corrected twice, as in the reference."""
    keyed = viv.withColumn("region_clean", light_key(region))
    c = prepare_corrections(corr, strict_numbers=strict_numbers)
    j = keyed.join(c, "region_clean", "left")
    return j.withColumns(
        {lat: F.coalesce(F.col("lat_corr"), F.col(lat)), lon: F.coalesce(F.col("lon_corr"), F.col(lon))}
    ).drop("lat_corr", "lon_corr", "region_clean")


def coverage(df: DataFrame, lat: str = "latitude") -> DataFrame:
    """Total rows and rows with a latitude, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.count(lat).alias("n_with_coords"))


def map_points(df: DataFrame, name: str = "Wine", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The rows a map can draw."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(name, lat, lon)
