"""J1, J2, A1, A6, J4, P13-P16 fixtures."""

import pytest
from pyspark.sql import functions as F

from vinterra.functions.features import add_engineered_features, categorical_feature, drop_numeric_columns, numeric_feature
from vinterra.operators.coords import attach_coords, barycentres, coverage, inject_centroids
from vinterra.operators.merge import merge_ratings_with_weather, merge_ratings_with_yearly_weather
from vinterra.sources.io import read_weather, weather_of_years, write_parquet


def test_attach_coords_fixture(spark):
    wines = spark.createDataFrame([("a", None, None), ("b", 40.0, 3.0)], "region_clean string, latitude double, longitude double")
    aoc = spark.createDataFrame([("a", 45.0, 1.0), ("b", 50.0, 2.0)], "denom_clean string, lat double, lon double")
    out = {r.region_clean: r for r in attach_coords(wines, aoc).collect()}
    assert out["a"].latitude == 45.0 and out["b"].latitude == 40.0


def test_barycentres_fixture(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 3.0, 4.0), ("y", 10.0, 20.0)], "region_clean string, latitude double, longitude double")
    out = barycentres(df)
    assert out.columns == ["region_clean", "cent_lat", "cent_lon"]
    assert {r.region_clean: r.cent_lat for r in out.collect()}["x"] == 2.0


def test_inject_centroids_fixture(spark):
    wines = spark.createDataFrame([("bordeaux", 45.0, 0.0)], "region string, latitude double, longitude double")
    corr = spark.createDataFrame([("bordeaux", "47.0", "2.0")], "region_clean string, lat_mean string, lon_mean string")
    r = inject_centroids(wines, corr).first()
    assert (r.latitude, r.longitude) == (47.0, 2.0) and "region_clean" not in r.asDict()


def test_inject_centroids_dirty_and_duplicates(spark):
    wines = spark.createDataFrame([("Haut-Médoc", 45.0, 0.0), ("other", 1.0, 1.0)], "region string, latitude double, longitude double")
    corr = spark.createDataFrame(
        [(" haut médoc ", "45.2", "–0.7"), ("haut médoc", "45.3", "-0.8"), ("other", "n/a", "1")],
        "region_clean string, lat_mean string, lon_mean string")
    out = sorted((r.region, r.latitude, r.longitude) for r in inject_centroids(wines, corr).collect())
    assert out == [("Haut-Médoc", 45.2, -0.7), ("Haut-Médoc", 45.3, -0.8), ("other", 1.0, 1.0)]


def test_coverage(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "latitude double")
    assert tuple(coverage(df).first()) == (3, 2)


def _weather(spark):
    return spark.createDataFrame(
        [("S1", y, 45.0, 1.0, 5, 100.0, 10.0) for y in (2020, 2021)],
        "station string, year int, latitude double, longitude double, hot_days long, GDD double, rain_June double")


def test_merge_fixture(spark):
    regions = spark.createDataFrame([("R1", 45.05, 1.0), ("R2", 45.0, 1.05)], "region string, latitude double, longitude double")
    wines = spark.createDataFrame([("R1", "2020", "[{'seo_name': 'merlot'}]", 10.0), ("R2", "2021", "[{'seo_name': 'syrah'}]", 20.0)],
                                  "region string, vintage string, cepages string, price double")
    out = merge_ratings_with_weather(wines, regions, _weather(spark), max_km=40, year_range=(2020, 2022))
    rows = sorted((r.region, r.year, r.hot_days, r.cepages) for r in out.collect())
    assert rows == [("R1", 2020, 5, "merlot"), ("R2", 2021, 5, "syrah")]
    assert {"region", "year", "hot_days", "station", "dist_km"} <= set(out.columns)


def test_merge_missing_grape_gives_empty(spark):
    regions = spark.createDataFrame([("R1", 45.0, 1.0)], "region string, latitude double, longitude double")
    wines = spark.createDataFrame([("R1", "2020", None, 10.0)], "region string, vintage string, cepages string, price double")
    assert merge_ratings_with_weather(wines, regions, _weather(spark), max_km=40, year_range=(2020, 2022)).count() == 0


_ROW = dict(GDD=100.0, rain_June=10.0, rain_SepOct=5.0, TX_summer=25.0, TM_summer=20.0, hot_days=5.0,
            frost_days_Apr=3.0, avg_TM_Apr=1.0, price=200.0, region=4, station=7)


def test_numeric_features_fixture(spark):
    df = spark.createDataFrame([_ROW])
    r = df.select(numeric_feature("A"), numeric_feature("B"), numeric_feature("I")).first()
    assert r[0] == 6.25 and r[1] == 5.0 and r[2] == pytest.approx(5.303304908059076)
    with pytest.raises(ValueError):
        numeric_feature("Z")


def test_categorical_feature_fixture(spark):
    assert spark.createDataFrame([_ROW]).select(categorical_feature("J")).first()[0] == 4007
    with pytest.raises(ValueError):
        categorical_feature("Q")


def test_feature_registry_and_drop(spark):
    df = spark.createDataFrame([_ROW, _ROW])
    nums = ["GDD", "rain_June", "rain_SepOct", "TX_summer", "TM_summer"]
    out, n2, c2 = add_engineered_features(df, nums, ["region", "station"], ["A", "B", "J", "unknown"])
    assert n2 == nums + ["heat_to_rain_ratio", "diurnal_range_summer"] and c2 == ["region", "station", "region_station_id"]
    same, n3, c3 = add_engineered_features(df, nums, [], [])
    assert same.columns == df.columns and n3 == nums
    dropped, n4 = drop_numeric_columns(out, n2, ["GDD"])
    assert "GDD" not in dropped.columns and n4 == n2[1:]


def test_division_by_zero_is_null(spark):
    row = dict(_ROW, avg_TM_Apr=-1.0)
    assert spark.createDataFrame([row]).select(numeric_feature("D")).first()[0] is None


def _yearly(spark, path, years):
    rows = [(f"S{i}", y, 45.0 + i / 10, 1.0, i + y) for y in years for i in range(3)]
    wx = spark.createDataFrame(rows, "station string, year int, latitude double, longitude double, hot_days int")
    write_parquet(wx, path, ["year"])
    return wx


def test_only_the_years_of_the_left_side_are_opened(spark, tmp_out):
    path = tmp_out + "/weather"
    wx = _yearly(spark, path, range(2010, 2016))
    # a file that cannot be read in a year nobody asks for
    with open(f"{path}/year=2015/part-x.parquet", "wb") as f:
        f.write(b"not a parquet file")
    left = spark.createDataFrame([(2011,), (2013,), (2013,), (None,), (1990,), (123456,)], "year int")
    out = weather_of_years(read_weather(spark, path, schema=wx.schema), left)
    assert sorted({r.year for r in out.collect()}) == [2011, 2013] and out.count() == 6
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString().lower()


def test_merge_over_yearly_files_equals_the_merge_in_memory(spark, tmp_out):
    path = tmp_out + "/weather"
    wx = _yearly(spark, path, range(2010, 2016))
    with open(f"{path}/year=2014/part-x.parquet", "wb") as f:
        f.write(b"not a parquet file")
    wines = spark.createDataFrame(
        [(1, "a", "[{'seo_name': 'merlot'}]", "2011"), (2, "a", "[{'seo_name': 'merlot'}]", "2013"), (3, "b", "[{'seo_name': 'merlot'}]", "N.V."), (4, "b", "[{'seo_name': 'merlot'}]", "2015"), (5, "b", None, "2014")],
        "wine_id int, region string, cepages string, vintage string",
    )
    regions = spark.createDataFrame([("a", 45.01, 1.0), ("b", 45.21, 1.0)], "region string, latitude double, longitude double")
    cols = ["wine_id", "year", "station", "hot_days"]
    got = merge_ratings_with_yearly_weather(wines, regions, read_weather(spark, path, schema=wx.schema), year_range=(2010, 2015)).select(*cols)
    want = merge_ratings_with_weather(wines, regions, wx, year_range=(2010, 2015)).select(*cols)
    assert sorted(got.collect()) == sorted(want.collect()) == [(1, 2011, "S0", 2011), (2, 2013, "S0", 2013)]


def test_growing_sides_are_merged_not_broadcast(spark, tmp_out):
    # compressed files look small to the planner, and rows are multiplied by years and cells after it has looked
    def stored(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_out}/{name}")
        return spark.read.parquet(f"{tmp_out}/{name}")

    wines = stored([(i, "2020", f"R{i % 4}", "[{'seo_name': 'gamay'}]") for i in range(12)] + [(12, "N.V.", "R1", "[]")],
                   "wine_id int, vintage string, region string, cepages string", "wines")
    regions = stored([(f"R{i}", 45.0 + i, 1.0) for i in range(4)], "region string, latitude double, longitude double", "regions")
    weather = stored([(f"S{i}", 2020, 45.01 + i, 1.0, 5 + i) for i in range(3)],
                     "station string, year int, latitude double, longitude double, hot_days int", "weather")
    out = merge_ratings_with_weather(wines, regions, weather, max_km=40.0, year_range=(2019, 2022))
    assert sorted((r.wine_id, r.station, r.hot_days) for r in out.collect()) == [(i, f"S{i % 4}", 5 + i % 4) for i in range(12) if i % 4 < 3]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    # per-partition offsets and the distinct years are bounded
    broadcast = [x for x in plan if "BroadcastHashJoin" in x and "_pid" not in x and "LeftSemi" not in x]
    assert not broadcast and sum("SortMergeJoin" in x for x in plan) >= 4
