"""Projection, centroids, dissolve, simplification."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vinterra.functions.geo import from_lambert93, to_lambert93
from vinterra.operators.polygons import (
    dissolve,
    mean_centroid,
    name_column,
    polygon_centroids,
    read_geojson,
    simplify_polygons,
    simplify_ring_xy,
    with_clean_name,
)

RINGS = "rings array<array<struct<x:double,y:double>>>"


def _square(cx, cy, h):
    return [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h), (cx - h, cy - h)]


def _poly(spark, rows):
    data = [(i, name, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for i, name, rings in rows]
    return spark.createDataFrame(data, f"poly_id int, denom string, {RINGS}")


def test_lambert_paris(spark):
    df = spark.createDataFrame([(48.8566, 2.3522)], "lat double, lon double")
    x, y = to_lambert93("lat", "lon")
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == pytest.approx((652469.02, 6862035.26), abs=0.01)
    la, lo = from_lambert93(F.lit(r.x), F.lit(r.y))
    back = df.select(la, lo).first()
    assert tuple(back) == pytest.approx((48.8566, 2.3522), abs=1e-10)


def test_centroids(spark):
    sq = _square(2.0, 46.0, 0.1)
    hole = _square(2.0, 46.0, 0.02)[::-1]
    off_hole = _square(2.05, 46.05, 0.02)
    pts = [(1.0, 45.0)] * 5
    df = _poly(spark, [(1, "a", [sq]), (2, "a", [sq, hole]), (3, "b", [sq, off_hole]), (4, "c", [pts])])
    c = {r.poly_id: (r.lat, r.lon) for r in polygon_centroids(df).collect()}
    # a square in lon/lat is not a square in metres: the centroid sits close to, not on, the centre
    assert c[1] == pytest.approx((46.0, 2.0), abs=2e-4)
    assert c[2] == pytest.approx(c[1], abs=1e-5)       # a centred hole barely moves it (projection asymmetry only)
    assert c[3][0] < c[1][0] and c[3][1] < c[1][1]     # hole in the NE corner pulls the centroid SW
    assert c[4] == pytest.approx((45.0, 1.0), abs=1e-9)  # zero area -> vertex mean


def test_dissolve_and_mean(spark):
    df = _poly(spark, [(1, "x", [_square(2.0, 46.0, 0.1)]), (2, "x", [_square(2.4, 46.0, 0.1)]), (3, "y", [_square(0.0, 44.0, 0.1)])])
    df = df.withColumn("app", F.col("denom")).withColumn("type_prod", F.concat(F.lit("t"), F.col("poly_id").cast("string"))).withColumn("categorie", F.lit("c"))
    parts, attrs = dissolve(df)
    a = {r.app: r for r in attrs.collect()}
    assert a["x"].n_parts == 2 and a["x"].type_prod == "t1" and parts.count() == 3
    assert a["x"].lon == pytest.approx(2.2, abs=1e-3) and a["x"].lat == pytest.approx(46.0, abs=1e-3)
    m = {r.denom_clean: r for r in mean_centroid(polygon_centroids(with_clean_name(df))).collect()}
    assert m["x"].lon == pytest.approx(2.2, abs=1e-3)


def test_name_sniffing():
    assert name_column(["a", "denominatio"]) == "denominatio"
    assert name_column(["denom", "denominatio"]) == "denom"
    assert name_column(["first", "other"]) == "first"


def test_simplify_ring_invariants():
    rng = np.random.default_rng(3)
    t = np.linspace(0, 2 * np.pi, 200)
    xs = 1000 * np.cos(t) + rng.normal(0, 5, t.size)
    ys = 1000 * np.sin(t) + rng.normal(0, 5, t.size)
    xs[-1], ys[-1] = xs[0], ys[0]
    keep = simplify_ring_xy(xs, ys, 40.0)
    assert keep[0] and keep[-1] and 4 <= keep.sum() < 200
    kx, ky = xs[keep], ys[keep]
    idx = np.nonzero(keep)[0]
    for a, b in zip(idx[:-1], idx[1:]):  # every dropped vertex is within tolerance of its segment
        for k in range(a + 1, b):
            dx, dy = xs[b] - xs[a], ys[b] - ys[a]
            d = abs(dx * (ys[k] - ys[a]) - dy * (xs[k] - xs[a])) / math.hypot(dx, dy)
            assert d <= 40.0 + 1e-9


def test_simplify_is_dealt_over_the_parallelism(spark):
    # one small file is one partition: the Python step still gets as many tasks as are configured
    square = [(0.0, 45.0), (0.0, 45.1), (0.1, 45.1), (0.1, 45.0), (0.0, 45.0)]
    df = spark.createDataFrame([(i, [square]) for i in range(64)], "id int, rings array<array<struct<x:double,y:double>>>").coalesce(1)
    out = simplify_polygons(df).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in out}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.id for r in out) == list(range(64)) and all(len(r.simple[0]) == 5 for r in out)


def test_simplify_polygons(spark):
    ring = [(2.0, 46.0), (2.05, 46.00001), (2.1, 46.0), (2.1, 46.1), (2.0, 46.1), (2.0, 46.0)]
    df = _poly(spark, [(1, "a", [ring])])
    simple = simplify_polygons(df).first().simple
    assert len(simple[0]) == 5 and (simple[0][1].x, simple[0][1].y) == (2.1, 46.0)


def test_read_geojson(spark, tmp_out):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"denom": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"denom": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [
            [[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
    ]}
    path = os.path.join(tmp_out, "p.geojson")
    with open(path, "w") as fh:
        json.dump(fc, fh)
    df = read_geojson(spark, path)
    assert sorted((r.denom, r.part) for r in df.collect()) == [("a", 0), ("b", 0), ("b", 1)]
    assert df.where("denom = 'a'").first().rings[0][1].x == 1.0


def _meets(p, q, r, s):
    """Whether segments pq and rs meet (exact on whole numbers)."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    boxes = all(max(a[k], b[k]) >= min(c[k], d[k]) for k in (0, 1) for a, b, c, d in ((p, q, r, s), (r, s, p, q)))
    return boxes and side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0


def _clean(rings):
    edges = [(a, b) for ring in rings for a, b in zip(ring, ring[1:])]
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            if not {a, b} & {c, d} and _meets(a, b, c, d):
                return False
    return True


def _star(rng, n, low, high):
    """A ring around the origin whose angles rise: it never meets itself."""
    import math

    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(round(math.cos(t) * r), round(math.sin(t) * r)) for t in turns for r in [rng.randrange(low, high)]]
    return [*ring, ring[0]]


def test_simplified_rings_do_not_meet_where_they_did_not_before():
    import random

    import numpy as np

    from vinterra.operators.polygons import simplify_ring_xy, simplify_rings_xy

    rng, tried, plain_bad = random.Random(11), 0, 0
    for _ in range(120):
        rings = [_star(rng, rng.randrange(12, 60), 400, 2000), _star(rng, rng.randrange(6, 25), 200, 390)]
        if not _clean(rings) or any(len(set(r)) < len(r) - 1 for r in rings):
            continue
        xs, ys = (np.array([p[k] for r in rings for p in r], float) for k in (0, 1))
        sizes, tol = [len(r) for r in rings], rng.choice([400, 1500, 1500])
        shapes = []
        for keep in (simplify_rings_xy(xs, ys, sizes, tol), np.concatenate([simplify_ring_xy(np.array(r)[:, 0] * 1.0, np.array(r)[:, 1] * 1.0, tol) for r in rings])):
            kept, at = [], 0
            for r in rings:
                kept.append([p for p, k in zip(r, keep[at : at + len(r)]) if k])
                at += len(r)
            shapes.append(kept)
        tried += 1
        plain_bad += not _clean(shapes[1])
        assert _clean(shapes[0]) and all(len(r) >= 4 and r[0] == r[-1] for r in shapes[0])
        if _clean(shapes[1]):
            assert len(sum(shapes[0], [])) >= len(sum(shapes[1], []))
    assert tried > 60 and plain_bad > 8


def test_a_hole_stays_inside_its_shell():
    import numpy as np

    from vinterra.operators.polygons import _contains, simplify_rings_xy

    shell = [(0, 0), (100, 0), (100, 100), (60, 100), (50, 130), (40, 100), (0, 100), (0, 0)]
    hole = [(49, 110), (51, 110), (50, 115), (49, 110)]
    xs, ys = (np.array([p[k] for p in shell + hole], float) for k in (0, 1))
    keep = simplify_rings_xy(xs, ys, [len(shell), len(hole)], 40.0)
    kept = np.flatnonzero(keep[: len(shell)])
    assert _contains(xs[kept], ys[kept], 49, 110) and keep[4]
    assert not simplify_rings_xy(xs[: len(shell)], ys[: len(shell)], [len(shell)], 40.0)[4]


def test_what_meets_itself_already_stays():
    import numpy as np

    from vinterra.operators.polygons import simplify_rings_xy

    bow = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]
    xs, ys = (np.array([p[k] for p in bow], float) for k in (0, 1))
    assert simplify_rings_xy(xs, ys, [5], 1.0).all()
    assert simplify_rings_xy(np.zeros(0), np.zeros(0), [], 1.0).size == 0
