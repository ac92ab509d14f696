"""Nearest station per year (fixture + brute force)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from data_dirs import SF001
from vinterra.operators.nearest import LEAF, attach_nearest, candidate_pairs, expand_years
from vinterra.functions.geo import km_to_chord
from vinterra.plans import standins


def _hav(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(a, 1.0)))


def test_fixture_station_and_distance(spark):
    wx = spark.createDataFrame([("A1", 2020, 45.0, 1.0), ("A2", 2020, 47.0, 3.0)], "station string, year int, latitude double, longitude double")
    left = spark.createDataFrame([(2020, 45.1, 1.1)], "year int, latitude double, longitude double")
    out = attach_nearest(left, wx, max_km=500, mode="drop", payload="station", station_out="wx_station", dist_col="wx_dist_km").collect()
    assert len(out) == 1 and out[0]["wx_station"] == "A1"
    assert out[0]["wx_dist_km"] == pytest.approx(13.614577, abs=1e-6)


def test_expand_years(spark):
    r = spark.createDataFrame([("a", 1.0, 2.0)], "region string, latitude double, longitude double")
    assert sorted(x.year for x in expand_years(r, 2010, 2013).collect()) == [2010, 2011, 2012]


def _brute(left_rows, st_rows):
    best = {}
    for key, y, la, lo in left_rows:
        c = [(_hav(la, lo, sla, slo), s) for s, sy, sla, slo in st_rows if sy == y]
        if c:
            best[key] = min(c)
    return best


@pytest.mark.parametrize("max_km", [40.0, 150.0])
def test_soft_radius_matches_brute_force(spark, max_km):
    regions = standins.regions(spark, SF001)
    weather = standins.weather(spark, SF001)
    ry = expand_years(regions, 1994, 2002)
    out = attach_nearest(ry, weather, max_km=max_km, mode="null", payload="all").collect()
    left = [(r.region + str(r.year), r.year, r.latitude, r.longitude) for r in ry.collect()]
    st = [(r.station, r.year, r.latitude, r.longitude) for r in weather.select("station", "year", "latitude", "longitude").collect()]
    truth = _brute(left, st)
    got = {r.region + str(r.year): r for r in out}
    assert set(got) == set(truth)  # 1994 has no weather: those rows vanish
    for k, (d, s) in truth.items():
        assert got[k].dist_km == pytest.approx(d, abs=1e-9)
        if d <= max_km:
            assert got[k].station == s and got[k].hot_days is not None
        else:
            assert got[k].station is None and got[k].GDD is None


def test_hard_radius_drops_far_rows(spark):
    regions = standins.regions(spark, SF001)
    weather = standins.weather(spark, SF001)
    ry = expand_years(regions, 1995, 1997)
    hard = attach_nearest(ry, weather, max_km=150.0, mode="drop", payload="all")
    soft = attach_nearest(ry, weather, max_km=150.0, mode="null", payload="all")
    assert hard.count() == soft.where(F.col("dist_km") <= 150.0).count()
    assert hard.agg(F.max("dist_km")).first()[0] <= 150.0


def test_null_coordinates_never_match(spark):
    wx = spark.createDataFrame([("A", 2020, 45.0, 1.0), ("B", 2020, None, 1.0)], "station string, year int, latitude double, longitude double")
    left = spark.createDataFrame([(1, 2020, 45.0, 1.0), (2, 2020, None, None), (3, None, 45.0, 1.0)], "id int, year int, latitude double, longitude double")
    out = attach_nearest(left, wx, max_km=10, mode="null").collect()
    assert [(r.id, r.station) for r in out] == [(1, "A")]


def test_ties_go_to_smallest_station(spark):
    wx = spark.createDataFrame([("B", 2020, 45.0, 1.0), ("A", 2020, 45.0, 1.0)], "station string, year int, latitude double, longitude double")
    left = spark.createDataFrame([(2020, 45.0, 1.0)], "year int, latitude double, longitude double")
    assert attach_nearest(left, wx, max_km=1, payload="station").first()["station"] == "A"


def test_far_station_found_in_soft_mode(spark):
    # nearest station ~1100 km away: found by widening the cells, distance kept, metrics NULL
    wx = spark.createDataFrame([("F", 2020, 55.0, 1.0, 7.0)], "station string, year int, latitude double, longitude double, m double")
    left = spark.createDataFrame([(2020, 45.0, 1.0)], "year int, latitude double, longitude double")
    r = attach_nearest(left, wx, max_km=40, mode="null").first()
    assert r.station is None and r.m is None and r.dist_km == pytest.approx(_hav(45, 1, 55, 1), abs=1e-9)


@pytest.mark.parametrize("mode", ["drop", "null"])
def test_shuffled_path_matches_broadcast(spark, mode):
    regions = standins.regions(spark, SF001)
    weather = standins.weather(spark, SF001)
    ry = expand_years(regions, 1995, 1998)
    cols = ["region", "year", "station", "dist_km", "hot_days"]
    bc = sorted(tuple(r) for r in attach_nearest(ry, weather, max_km=150.0, mode=mode).select(*cols).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = attach_nearest(ry, weather, max_km=150.0, mode=mode)
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
        rows = sorted(tuple(r) for r in shuffled.select(*cols).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == bc and len(rows) > 0
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan or mode == "null"  # the cell join is shuffled


def test_one_station_row_per_left_row(spark):
    # two rows of one station and year at different places: the nearer one alone is attached
    schema = "station string, year int, latitude double, longitude double, m double"
    wx = spark.createDataFrame([("A", 2020, 45.0, 1.0, 1.0), ("A", 2020, 45.3, 1.0, 2.0), ("A", 2021, 45.0, 1.0, 3.0), ("A", 2020, 45.0, 1.0, 1.0)], schema)
    left = spark.createDataFrame([(1, 2020, 45.01, 1.0), (2, 2020, 45.29, 1.0), (2, 2020, 45.29, 1.0)], "id int, year int, latitude double, longitude double")
    for mode in ("drop", "null"):
        out = attach_nearest(left, wx, max_km=100, mode=mode).collect()
        assert sorted((r.id, r.m) for r in out) == [(1, 1.0), (2, 2.0), (2, 2.0)]


def test_station_without_an_id_is_a_station(spark):
    schema = "station string, year int, latitude double, longitude double, m double"
    wx = spark.createDataFrame([(None, 2020, 45.0, 1.0, 1.0), ("B", 2020, 45.2, 1.0, 2.0), ("C", 2020, 46.0, 1.0, 3.0), (None, 2020, 46.0, 1.0, 4.0)], schema)
    left = spark.createDataFrame([(1, 2020, 45.0, 1.0), (2, 2020, 46.0, 1.0)], "id int, year int, latitude double, longitude double")
    for mode in ("drop", "null"):
        out = {r.id: (r.station, r.m) for r in attach_nearest(left, wx, max_km=100, mode=mode).collect()}
        assert out == {1: (None, 1.0), 2: ("C", 3.0)}  # an id wins a tie


def test_points_are_reduced_before_the_exchange_and_hashed(spark):
    wx = spark.createDataFrame([("A", 2020, 45.0, 1.0)], "station string, year int, latitude double, longitude double")
    left = spark.createDataFrame([(2020, 45.0, 1.0)] * 3, "year int, latitude double, longitude double")
    out = attach_nearest(left, wx, max_km=10, payload="station")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortAggregate" not in plan and "partial_min" in plan
    lines = plan.splitlines()
    distinct = [i for i, x in enumerate(lines) if "HashAggregate(keys=[_year" in x and "functions=[]" in x]
    assert len(distinct) >= 2 and any("Exchange hashpartitioning" in x for x in lines[distinct[0] : distinct[1]])


def _crowded(n: int, n_points: int):
    """Half of ``n`` stations within a kilometre, the others over some hundred; points inside, at the edge of and far from the crowd."""
    rnd = random.Random(7)
    st = [(f"S{i:06d}", 2020, 45.0 + rnd.gauss(0, 0.003), 1.0 + rnd.gauss(0, 0.003)) for i in range(n // 2)]
    st += [(f"S{i:06d}", 2020, 45.0 + rnd.uniform(-2, 2), 1.0 + rnd.uniform(-2, 2)) for i in range(n // 2, n)]
    st += [("T", 2020, *st[0][2:]), ("T", 2021, 45.0, 1.0)]  # a second station at one place, another year
    pts = [(i, 2020, 45.0 + rnd.gauss(0, s), 1.0 + rnd.gauss(0, s)) for i, s in zip(range(n_points), [0.002, 0.02, 0.2, 1.0] * n_points)]
    pts += [(n_points, 2021, 45.1, 1.1), (n_points + 1, 2020, *st[0][2:]), (n_points + 2, 2020, 45.0, 9.0)]
    return st, pts


@pytest.mark.parametrize("mode", ["drop", "null"])
def test_crowded_cell_matches_brute_force(spark, mode):
    st, pts = _crowded(4000, 120)
    wx = spark.createDataFrame(st, "station string, year int, latitude double, longitude double").withColumn("m", F.col("latitude"))
    left = spark.createDataFrame(pts, "id int, year int, latitude double, longitude double")
    got = {r.id: r for r in attach_nearest(left, wx, max_km=40.0, mode=mode).collect()}
    truth = _brute([(i, y, la, lo) for i, y, la, lo in pts], st)
    assert set(got) == {k for k, (d, _) in truth.items() if mode == "null" or d <= 40.0}
    for k, r in got.items():
        d, s = truth[k]
        assert r.dist_km == pytest.approx(d, abs=1e-9) and r.station == (s if d <= 40.0 else None)


def test_pairs_of_a_point_do_not_grow_with_the_stations_of_a_cell(spark):
    most, mean = {}, {}
    for n in (4000, 40000):
        st, pts = _crowded(n, 120)
        stations = spark.createDataFrame(st, "_s string, _year int, _s_lat double, _s_lon double").where("_year = 2020")
        stations = stations.select("_year", F.monotonically_increasing_id().alias("_sid"), "_s_lat", "_s_lon")
        points = spark.createDataFrame(pts, "id int, _year int, _lat double, _lon double").drop("id").distinct()
        # only the crowd: the others get denser with n as well
        crowd = stations.where("abs(_s_lat - 45) < 0.02 and abs(_s_lon - 1) < 0.02")
        pairs = candidate_pairs(points, crowd, km_to_chord(40.0)).groupBy("_year", "_lat", "_lon").count()
        most[n], mean[n] = pairs.agg(F.max("count"), F.avg("count")).first()
    assert most[40000] <= 16 * LEAF and mean[40000] <= 2 * mean[4000] + LEAF, (most, mean)
