"""A4: the union's boundary against a raster of the same polygons, and its rings."""

import math
import random

import pytest

from vinterra.operators import overlay as O

SCHEMA = "app string, poly_id long, rings array<array<struct<x: double, y: double>>>"


def box(x, y, w, h, turned=False):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return [(float(a), float(b)) for a, b in (ring[::-1] if turned else ring)]


def frame(spark, rows):
    return spark.createDataFrame([(g, i, r) for i, (g, r) in enumerate(rows)], SCHEMA).repartition(4)


def rings_of(df):
    out = {}
    for r in df.orderBy("app", "ring", "pos").collect():
        out.setdefault((r.app, r.ring), []).append((r.x, r.y))
    return out


def signed_area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def raster(boxes, holes=()):
    """Area and perimeter of a union of integer boxes, by unit cells; each box may have a hole of its own."""
    cells = set()
    for k, (x, y, w, h) in enumerate(boxes):
        own = {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
        if k < len(holes) and holes[k]:
            a, b, c, d = holes[k]
            own -= {(i, j) for i in range(a, a + c) for j in range(b, b + d)}
        cells |= own
    return len(cells), sum((i + a, j + b) not in cells for i, j in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))


@pytest.mark.parametrize("seed", range(2))
def test_boxes_against_a_raster(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for g in ("a", "b", None):
        boxes = [(rng.randrange(20), rng.randrange(20), rng.randrange(3, 9), rng.randrange(3, 9)) for _ in range(rng.choice([1, 8, 20]))]
        holes = [(x + 1, y + 1, w - 2, h - 2) if rng.random() < 0.4 else None for x, y, w, h in boxes]
        boxes += [boxes[0], (boxes[0][0] + boxes[0][2], boxes[0][1], 4, boxes[0][3])]  # a copy, and a neighbour with a shared side
        holes += [holes[0], None]
        rows += [(g, [box(*b, turned=rng.random() < 0.5), *([box(*h)] if h else [])]) for b, h in zip(boxes, holes)]
        expected[g] = raster(boxes, holes)
    rows.append(("a", [[(3.0, 3.0)] * 5]))  # no area
    rng.shuffle(rows)
    df = frame(spark, rows)
    got = {r.app: (r.area, r.perimeter) for r in O.dissolve_measures(df, "app", "poly_id").collect()}
    assert got == {g: pytest.approx(v) for g, v in expected.items()}
    areas = dict.fromkeys(expected, 0.0)
    for (g, _), ring in rings_of(O.dissolve_rings(df, "app", "poly_id")).items():
        assert len(ring) == len(set(ring)) >= 4  # rings touch at most at corners
        areas[g] += signed_area(ring)
    assert areas == {g: pytest.approx(v[0]) for g, v in expected.items()}


def test_inclusion_and_exclusion_of_two_slanted_polygons(spark):
    # a diamond over a square: four corners stick out
    diamond = [(2.0, -1.0), (5.0, 2.0), (2.0, 5.0), (-1.0, 2.0), (2.0, -1.0)]
    df = frame(spark, [("g", [box(0, 0, 4, 4)]), ("g", [diamond])])
    r = O.dissolve_measures(df, "app", "poly_id").first()
    # the diamond's corners beyond each side are triangles of base 2 and height 1
    assert r.area == pytest.approx(16 + 4 * 1.0) and (r.cx, r.cy) == (pytest.approx(2.0), pytest.approx(2.0))
    assert r.perimeter == pytest.approx(4 * 2 + 8 * math.sqrt(2))
    (ring,) = rings_of(O.dissolve_rings(df, "app", "poly_id")).values()
    assert len(ring) == 16 and signed_area(ring) == pytest.approx(20)


def test_polygons_that_touch_at_a_corner_stay_two_rings(spark):
    df = frame(spark, [("g", [box(0, 0, 2, 2)]), ("g", [box(2, 2, 2, 2)])])
    assert sorted(signed_area(r) for r in rings_of(O.dissolve_rings(df, "app", "poly_id")).values()) == [4, 4]


def test_a_ring_of_boxes_leaves_a_hole_and_an_inner_box_goes(spark):
    df = frame(spark, [("g", [box(0, 0, 9, 3)]), ("g", [box(0, 6, 9, 3)]), ("g", [box(0, 0, 3, 9)]), ("g", [box(6, 0, 3, 9)]), ("g", [box(1, 1, 1, 1)])])
    assert sorted(signed_area(r) for r in rings_of(O.dissolve_rings(df, "app", "poly_id")).values()) == [-9, 81]


def test_no_polygons(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert not O.dissolve_measures(df, "app", "poly_id").count() and not O.dissolve_rings(df, "app", "poly_id").count()


def _scattered(rng, n, span):
    return [box(round(rng.uniform(0, span), 3), round(rng.uniform(0, span), 3), round(rng.uniform(4, 9), 3), round(rng.uniform(4, 9), 3)) for _ in range(n)]


def test_rounds_give_the_rings_of_one_round(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("a", i, [r]) for i, r in enumerate(_scattered(rng, 14, 20))]
    rows += [("b", i % 5, [r]) for i, r in enumerate(_scattered(rng, 7, 10))]  # keys of several rows
    rows += [(None, None if i == 2 else i, [r]) for i, r in enumerate(_scattered(rng, 5, 10))]  # a null key
    df = spark.createDataFrame(rows, SCHEMA)
    found = []
    for fan in (4, 1000):
        monkeypatch.setattr(O, "FAN", fan)
        found.append(sorted(((str(g), sorted(ring)) for (g, _), ring in rings_of(O.dissolve_rings(df, "app", "poly_id")).items()), key=str))
    assert found[0] == found[1]


def test_deep_piles_do_not_cross_all_pairs(spark, monkeypatch):
    rows = {}
    monkeypatch.setattr(O, "as_table", lambda df, name, *p, write=O.as_table: rows.setdefault(name, []).append(out := write(df, name, *p)) or out)
    piled = _scattered(random.Random(5), 240, 6)
    measured = O.dissolve_measures(frame(spark, [("g", [b]) for b in piled]), "app", "poly_id").first()
    lines = sum(t.count() for t in rows["overlay-lines"])
    assert lines < 20 * 4 * len(piled)  # of all crossings there are more than that
    assert len(rows["overlay-lines"]) == 2 and measured.area > 0
