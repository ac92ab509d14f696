"""S1, S3, S4, S5, S7-S9, S11 and the streaming ingestion."""

import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vinterra.sources.crawl import dominant_grape, flatten_responses, request_plan
from vinterra.sources.io import (
    geojson_features,
    read_csv,
    read_weather,
    write_csv,
    write_geojson_lines,
    write_map_points,
    write_parquet,
)
from vinterra.streaming.crawl_ingest import start_ingest

MATCH_OK = {"vintage": {"wine": {"winery": {"name": "W"}, "name": "Cuvée", "region": {"seo_name": "r"},
                                 "style": {"grapes": [{"seo_name": "merlot"}, {"seo_name": "syrah"}]}},
                        "statistics": {"ratings_average": 4.1, "ratings_count": 3, "wine_ratings_average": 4.0,
                                       "wine_ratings_count": 9}, "year": 2019}, "price": {"amount": 12.5}}


def _resp(*matches):
    return json.dumps({"explore_vintage": {"records_matched": 3, "matches": list(matches)}})


def test_flatten_missing_vs_null(spark):
    null_year = json.loads(json.dumps(MATCH_OK)); null_year["vintage"]["year"] = None
    no_price = json.loads(json.dumps(MATCH_OK)); del no_price["price"]
    null_style = json.loads(json.dumps(MATCH_OK)); null_style["vintage"]["wine"]["style"] = None
    df = spark.createDataFrame([(_resp(MATCH_OK, null_year, no_price, null_style),)], "response string")
    out = flatten_responses(df).withColumn("grape", dominant_grape()).orderBy("match_pos").collect()
    assert [r.match_pos for r in out] == [0, 1]          # missing price / null style path -> skipped
    assert out[0].Wine == "Cuvée 2019" and out[0].grape == "merlot" and out[0].price == 12.5
    assert out[1].Wine == "Cuvée None" and out[1].vintage is None  # present-but-null leaf kept


def test_request_plan(spark):
    t = spark.createDataFrame([(0, 51, 25), (1, 25, 25), (2, 0, 25)], "interval_id int, records_matched int, per_page int")
    pages = sorted((r.interval_id, r.page) for r in request_plan(t).collect())
    assert pages == [(0, 1), (0, 2), (0, 3), (1, 1)]


def test_csv_parquet_round_trip(spark, tmp_out):
    df = spark.createDataFrame([(1, "a", 2020), (2, "b", 2021)], "id int, name string, year int")
    write_csv(df, os.path.join(tmp_out, "c"))
    back = read_csv(spark, os.path.join(tmp_out, "c"), "id int, name string, year int")
    assert sorted(map(tuple, back.collect())) == [(1, "a", 2020), (2, "b", 2021)]
    write_parquet(df, os.path.join(tmp_out, "p"), ["year"])
    assert {"year=2020", "year=2021"} <= set(os.listdir(os.path.join(tmp_out, "p")))
    part = spark.read.parquet(os.path.join(tmp_out, "p")).where("year = 2021")
    assert "PartitionFilters: [isnotnull(year" in part._jdf.queryExecution().executedPlan().toString() or part.count() == 1


def test_read_yearly_weather_files(spark, tmp_out):
    d = os.path.join(tmp_out, "wx")
    os.makedirs(d)
    pd.DataFrame({"station": ["A"], "lat": ["45.0"], "lon": [1], "hot_days": [3]}).to_parquet(os.path.join(d, "weather_cleaned_2020.parquet"))
    pd.DataFrame({"station": ["B"], "lat": ["46.0"], "lon": [2], "hot_days": [4], "GDD": [1.0]}).to_parquet(os.path.join(d, "weather_cleaned_2021.parquet"))
    w = read_weather(spark, d)
    rows = sorted((r.station, r.year, r.latitude, r.longitude) for r in w.collect())
    assert rows == [("A", 2020, 45.0, 1.0), ("B", 2021, 46.0, 2.0)] and "GDD" in w.columns
    assert read_weather(spark, d, years=[2021]).count() == 1


def test_geojson_and_points(spark, tmp_out):
    parts = spark.createDataFrame([("x", [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]])],
                                  "app string, rings array<array<struct<x:double,y:double>>>")
    f = json.loads(geojson_features(parts, ["app"]).first().value)
    assert f["geometry"]["coordinates"][0][1] == [1.0, 0.0] and f["properties"] == {"app": "x"}
    write_geojson_lines(parts, os.path.join(tmp_out, "g"), ["app"])
    pts = spark.createDataFrame([("w", 45.0, 1.0), ("v", None, 2.0)], "Wine string, latitude double, longitude double")
    assert write_map_points(pts.where("latitude IS NOT NULL"), os.path.join(tmp_out, "m"))
    assert not write_map_points(pts.where("latitude > 90"), os.path.join(tmp_out, "m2"))


def test_streaming_ingest_exactly_once(spark, tmp_out):
    land, out = os.path.join(tmp_out, "land"), os.path.join(tmp_out, "out")
    os.makedirs(land)
    with open(os.path.join(land, "p1.json"), "w") as fh:
        fh.write(_resp(MATCH_OK, MATCH_OK) + "\n")
    start_ingest(spark, land, out, name="t1").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    with open(os.path.join(land, "p2.json"), "w") as fh:
        fh.write(_resp(MATCH_OK) + "\n")
    start_ingest(spark, land, out, name="t1").awaitTermination()   # restart: only the new file
    assert spark.read.parquet(out).count() == 3


def test_flatten_keeps_text_vintages_and_survives_other_shapes(spark):
    nv = json.loads(json.dumps(MATCH_OK))
    nv["vintage"]["year"] = "N.V."
    rows = [(_resp(nv),), (json.dumps({"explore_vintage": {"matches": 7}}),), ("{broken",), (None,), ("[]",)]
    out = flatten_responses(spark.createDataFrame(rows, "response string")).collect()
    assert [(r.Wine, r.vintage) for r in out] == [("Cuvée N.V.", "N.V.")]


def test_keep_first_takes_flattened_rows(spark):
    from vinterra.operators.rankings import keep_first

    cheap = json.loads(json.dumps(MATCH_OK))
    cheap["price"]["amount"] = 3
    df = flatten_responses(spark.createDataFrame([(_resp(MATCH_OK, cheap, MATCH_OK),)], "response string"))
    got = keep_first(df, ["Wine", "vintage"], ["price"]).withColumn("grape", dominant_grape()).collect()
    assert [(r.price, r.match_pos, r.grape) for r in got] == [(3.0, 1, "merlot")]


def test_weather_files_of_both_spellings(spark, tmp_out):
    d = os.path.join(tmp_out, "wx")
    os.makedirs(d)
    pd.DataFrame({"station": ["A"], "lat": ["45.0"], "lon": ["1"]}).to_parquet(os.path.join(d, "weather_cleaned_2020.parquet"))
    pd.DataFrame({"station": ["B"], "latitude": ["46.0"], "longitude": ["2"]}).to_parquet(os.path.join(d, "weather_cleaned_2021.parquet"))
    w = read_weather(spark, d)
    assert sorted((r.station, r.year, r.latitude, r.longitude) for r in w.collect()) == [("A", 2020, 45.0, 1.0), ("B", 2021, 46.0, 2.0)]
    assert set(w.columns) == {"station", "year", "latitude", "longitude"}


def test_polygons_round_trip_through_geojson_lines(spark, tmp_out):
    from vinterra.operators.polygons import read_geojson, with_clean_name

    rows = [("Côte X", "AOC", [[{"x": 0.0, "y": 0.5}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.5}]]), (None, "IGP", [[{"x": 5.0, "y": 0.0}]])]
    parts = spark.createDataFrame(rows, "denom string, signe string, rings array<array<struct<x:double,y:double>>>")
    write_geojson_lines(parts, os.path.join(tmp_out, "g"), ["denom", "signe"])
    back = read_geojson(spark, os.path.join(tmp_out, "g"), lines=True, props=["denom", "signe"])
    assert sorted(map(tuple, back.select("denom", "signe", "rings").collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)
    assert sorted(r.denom_clean for r in with_clean_name(back).collect() if r.denom_clean) == ["côte x"]
