"""Nearest-station join per year.

Plan
----
Left rows are first reduced to their distinct ``(year, lat, lon)`` points: the
partial aggregate runs before the exchange, so a hot point is one row per task.
Station rows get a consecutive number in id order; the search carries only
that number, the year and the coordinates, and metrics are attached by number
at the end, so two rows of one station and year never multiply left rows.

Points and stations are placed on the unit sphere and bucketed into cube cells
of side ``h / 2`` (``h`` a chord length).  Each station is replicated into the
5x5x5 cells around its own, so an equi-join on ``(year, cell)`` hands every
point all stations of its block.  A station outside the block is more than
``h`` away from the point (one coordinate alone differs by more than ``h``), hence:

* a best candidate at chord distance <= h is the exact nearest station, so
  candidates farther than h are cut inside the join (a cheap squared-chord
  test on unit vectors) before any trigonometry or aggregation;
* **drop** mode (hard radius) needs one level with ``h = chord(max_km)``;
* **null** mode (soft radius: every point needs the true nearest distance)
  grows ``h`` fourfold for the points still unresolved until ``h >= 2`` (the
  whole sphere), cutting lineage between levels with a reliable checkpoint.

Dense cells.  Stations at one place of a year are searched once, under their
smallest number.  A cell with more than ``LEAF`` places is not handed to its
neighbours place by place: it is a node with the bounding box of its places, cut
into 4x4x4 cells while a cell holds more than ``LEAF``.  Points descend level by
level: a node farther than the radius, or than the far corner of the point's
best node, is dropped before its children are joined.  So the pairs of a point
follow from the geometry around it, not from how many stations a cell holds;
without a dense cell the search is the one join above.

The best candidate is the minimum of one decimal, distance in steps of
``1 / _STEPS`` km followed by the station number, so the aggregate is a hash
aggregate.  Joins of tables that grow with the input are hinted to be merged: the
size the planner sees is that of compressed files, before rows are multiplied by
years and cells, and a broadcast picked by it would pass through the driver.  AQE
still splits a hot cell.

Ties (distances that differ by less than a nanometre) go to the smallest
station id, a NULL id last (the reference picks arbitrarily).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinterra.functions.geo import haversine_km, km_to_chord, unit_xyz
from vinterra.operators.encode import consecutive_index
from vinterra.session import cut_lineage

# Cells of side h / CELL_SPLIT with a (2 * CELL_SPLIT + 1)^3 neighbourhood: any
# station outside it differs from the point by more than h in one coordinate.
# 2 covers ~30% less sphere surface per point than 1 (27 cells of side h).
CELL_SPLIT = 2
_OFFSETS = list(itertools.product(range(-CELL_SPLIT, CELL_SPLIT + 1), repeat=3))
# relative slack on the chord pre-filter so float rounding never drops a
# candidate that the exact great-circle test would accept
_CHORD_SLACK = 1e-9
# distances are compared in steps of 1 / _STEPS km; station numbers stay below _NUMBERS
_STEPS = 2.0**40
_NUMBERS = 10**13
# places a cell may hold before it is cut, and cuts at most (cells of 40 km end below 10 cm)
LEAF = 64
_CUT = 4
_MAX_CUTS = 10
# slack when two chords are compared: far above rounding, far below a millimetre
_REL, _ABS = 1e-9, 1e-14
# search radius growth per level for points still unresolved (soft radius)
_GROWTH = 4.0


def expand_years(regions: DataFrame, start: int, end: int, year_col: str = "year") -> DataFrame:
    """Every region row once per year in ``[start, end)`` (a generator, no join)."""
    return regions.withColumn(year_col, F.explode(F.sequence(F.lit(start), F.lit(end - 1))))


def _cells(xyz: tuple[Column, Column, Column], cell: float) -> list[Column]:
    return [F.floor(c / F.lit(cell)).cast("long") for c in xyz]


def _around(cells: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Rows once per cell of their neighbourhood ``_cx, _cy, _cz``, from their own ``_ox, _oy, _oz``.  The
    offsets are one constant array (folded to a literal), added after the
    explode -- a per-offset computed struct array would outgrow codegen."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dx, dy, dz in _OFFSETS])
    return cells.select("*", F.explode(offsets).alias("_o")).select(
        *kept,
        (F.col("_ox") + F.col("_o.dx")).alias("_cx"), (F.col("_oy") + F.col("_o.dy")).alias("_cy"),
        (F.col("_oz") + F.col("_o.dz")).alias("_cz"),
    )


_POINT = ["_year", "_lat", "_lon"]
_PXYZ = ["_px", "_py", "_pz"]
_OWN = ["_ox", "_oy", "_oz"]
_CELL = ["_cx", "_cy", "_cz"]
_PLACE = ["_year", "_sid", "_s_lat", "_s_lon", "_sx", "_sy", "_sz"]
_BOX = ["_x0", "_x1", "_y0", "_y1", "_z0", "_z1"]


def _places(stations: DataFrame, h: float) -> DataFrame:
    """One row per year and place with its smallest number, unit vector and own cell."""
    sx, sy, sz = unit_xyz("_s_lat", "_s_lon")
    cx, cy, cz = _cells((F.col("_sx"), F.col("_sy"), F.col("_sz")), h / CELL_SPLIT)
    return (
        stations.groupBy("_year", "_s_lat", "_s_lon").agg(F.min("_sid").alias("_sid"))
        .withColumns({"_sx": sx, "_sy": sy, "_sz": sz}).withColumns({"_ox": cx, "_oy": cy, "_oz": cz})
    )


def _nodes(places: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Cells with the number ``_n`` and the bounding box of their places."""
    box = [f(f"_s{a}").alias(f"_{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))]
    return places.groupBy("_year", *_OWN, *extra).agg(F.count(F.lit(1)).alias("_n"), *box)


def _within_reach(pairs: DataFrame) -> DataFrame:
    """Pairs of a point and a node that can still hold its nearest place: ``_reach`` (a chord) shrinks to the far
    corner of the point's best box, and boxes beyond it are dropped."""
    near2, far2 = F.lit(0.0), F.lit(0.0)
    for a in "xyz":
        p, lo, hi = F.col(f"_p{a}"), F.col(f"_{a}0"), F.col(f"_{a}1")
        near2 = near2 + F.pow(F.greatest(lo - p, p - hi, F.lit(0.0)), 2)
        far2 = far2 + F.pow(F.greatest(F.abs(p - lo), F.abs(p - hi)), 2)
    pairs = pairs.withColumns({"_near": F.sqrt(near2), "_far": F.sqrt(far2) * F.lit(1 + _REL) + F.lit(_ABS)}).drop(*_BOX)
    pairs = pairs.where(F.col("_near") <= F.col("_reach"))
    best = F.min("_far").over(Window.partitionBy(*_POINT))
    return pairs.withColumn("_reach", F.least("_reach", best)).where(F.col("_near") <= F.col("_reach")).drop("_near", "_far")


def _descend(points: DataFrame, places: DataFrame, dense: DataFrame, h: float) -> list[DataFrame]:
    """Pairs of points and the places of dense cells that can be nearest, one DataFrame per level of leaves."""
    out = []
    around = _around(dense, ["_year", *_OWN, *_BOX])
    pairs = points.join(around.hint("merge"), ["_year", *_CELL]).drop(*_CELL).withColumn("_reach", F.lit(h * (1 + _CHORD_SLACK)))
    pairs = cut_lineage(_within_reach(pairs))
    inside = places.join(dense.select("_year", *_OWN).hint("merge"), ["_year", *_OWN], "left_semi")
    side = h / CELL_SPLIT
    for cut in range(1, _MAX_CUTS + 1):
        side /= _CUT  # a power of two, so a cell of this side lies in one cell of the side before
        finer = _cells((F.col("_sx"), F.col("_sy"), F.col("_sz")), side)
        parent = {f"_u{a}": F.col(f"_o{a}") for a in "xyz"}
        inside = cut_lineage(inside.withColumns(parent).withColumns(dict(zip(_OWN, finer))))
        nodes = _nodes(inside, list(parent))
        pairs = pairs.withColumnsRenamed({f"_o{a}": f"_u{a}" for a in "xyz"}).join(nodes.hint("merge"), ["_year", *parent]).drop(*parent)
        pairs = cut_lineage(_within_reach(pairs))
        inside = inside.drop(*parent)
        leaf = F.col("_n") <= F.lit(LEAF) if cut < _MAX_CUTS else F.lit(True)
        out.append(pairs.where(leaf).drop("_n", "_reach").join(inside.hint("merge"), ["_year", *_OWN]).select(*_POINT, "_sid", "_s_lat", "_s_lon"))
        pairs = pairs.where(~leaf)
        if pairs.isEmpty():
            break
        inside = inside.join(pairs.select("_year", *_OWN).distinct().hint("merge"), ["_year", *_OWN], "left_semi")
        pairs = pairs.drop("_n")
    return out


def candidate_pairs(points: DataFrame, stations: DataFrame, h: float) -> DataFrame:
    """``(_year, _lat, _lon, _sid, _s_lat, _s_lon)``: for every distinct point the places that can be its nearest
    within chord distance ``h``; the nearest is among them."""
    px, py, pz = unit_xyz("_lat", "_lon")
    cx, cy, cz = _cells((px, py, pz), h / CELL_SPLIT)
    pts = points.select(*_POINT, *[c.alias(n) for c, n in zip((px, py, pz, cx, cy, cz), _PXYZ + _CELL)])
    places = _places(stations, h)
    dense = cut_lineage(_nodes(places).where(F.col("_n") > F.lit(LEAF)).drop("_n"))
    some_dense = not dense.isEmpty()
    if some_dense:
        places = cut_lineage(places)
    sparse = places.join(dense.select("_year", *_OWN).hint("merge"), ["_year", *_OWN], "left_anti") if some_dense else places
    st = _around(sparse, _PLACE)
    chord2 = (F.pow(pts["_px"] - st["_sx"], 2) + F.pow(pts["_py"] - st["_sy"], 2) + F.pow(pts["_pz"] - st["_sz"], 2))
    cond = (
        (pts["_year"] == st["_year"]) & (pts["_cx"] == st["_cx"]) & (pts["_cy"] == st["_cy"]) & (pts["_cz"] == st["_cz"])
        & (chord2 <= F.lit(h * h * (1 + _CHORD_SLACK)))
    )
    cand = pts.join(st.hint("merge"), cond).select(pts["_year"], "_lat", "_lon", "_sid", "_s_lat", "_s_lon")
    for part in _descend(pts, places, dense, h) if some_dense else []:
        cand = cand.unionByName(part)
    return cand


def _best_at_level(points: DataFrame, stations: DataFrame, h: float, outer: bool) -> DataFrame:
    """Per point: the nearest station number ``_sid`` and its distance (to 1 / _STEPS km) among the
    stations within chord distance ``h`` (``outer``: NULL if none; else such points may be missing)."""
    cand = candidate_pairs(points, stations, h)
    steps = F.floor(haversine_km("_lat", "_lon", "_s_lat", "_s_lon") * F.lit(_STEPS)).cast("decimal(17,0)")
    ranked = steps * F.lit(_NUMBERS).cast("decimal(14,0)") + F.col("_sid").cast("decimal(14,0)")
    best = cand.groupBy(*_POINT).agg(F.min(ranked).alias("_best"))
    if outer:
        best = points.select(*_POINT).join(best.hint("merge"), _POINT, "left")
    return best.select(
        "_year", "_lat", "_lon", (F.col("_best") % F.lit(_NUMBERS)).cast("long").alias("_sid"),
        (F.floor(F.col("_best") / F.lit(_NUMBERS)).cast("double") / F.lit(_STEPS)).alias("_near"),
    )


def nearest_points(points: DataFrame, stations: DataFrame, max_km: float, exact_beyond_radius: bool) -> DataFrame:
    """Nearest station for distinct points ``(_year, _lat, _lon)``; ``stations`` is
    ``(_year, _sid, _s_lat, _s_lon)``.

    Returns ``(_year, _lat, _lon, _sid)``.  Without ``exact_beyond_radius`` only points with a
    station within about ``max_km`` are returned (callers compare the exact distance); with it
    every point of a year that has stations is returned.
    """
    h = km_to_chord(max_km)
    if not exact_beyond_radius:
        return _best_at_level(points, stations, h, outer=False).drop("_near")

    resolved: list[DataFrame] = []
    pending = points
    while True:
        whole_sphere = h >= 2.0
        best = cut_lineage(_best_at_level(pending, stations, h, outer=True))
        reach_km = math.inf if whole_sphere else 2.0 * 6371.0 * math.asin(h / 2.0)
        found = F.col("_sid").isNotNull() & (F.col("_near") <= F.lit(reach_km))
        resolved.append(best.where(found).drop("_near"))
        if whole_sphere:
            break
        pending = best.where(F.col("_sid").isNull() | ~found).select("_year", "_lat", "_lon")
        if pending.isEmpty():
            break
        h = min(_GROWTH * h, 2.0)
    out = resolved[0]
    for part in resolved[1:]:
        out = out.unionByName(part)
    return out


def attach_nearest(
    left: DataFrame,
    stations: DataFrame,
    *,
    max_km: float = 40.0,
    mode: str = "drop",
    payload: str = "all",
    lat: str = "latitude",
    lon: str = "longitude",
    year: str = "year",
    station_lat: str = "latitude",
    station_lon: str = "longitude",
    station_col: str = "station",
    dist_col: str = "dist_km",
    station_out: str | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Attach the nearest station of the same year to every left row.

    mode ``drop``  -- rows whose nearest station is farther than ``max_km`` are
                      removed (J5, J7).
    mode ``null``  -- such rows stay with NULL station/metrics but the true
                      nearest distance (J6).
    payload ``station`` -- add only station id and distance (J5);
            ``all``     -- add every station column except coordinates and year
                           (J6, J7).
    Rows with NULL coordinates or year never match (and are removed); years
    without any station vanish (Q9).
    """
    if mode not in ("drop", "null"):
        raise ValueError(f"mode must be 'drop' or 'null', got {mode!r}")
    station_out = station_out or station_col

    metric_cols = list(metrics) if metrics is not None else [
        c for c in stations.columns if c not in (station_lat, station_lon, year, station_col)
    ]
    # numbered in id order and checkpointed: the number is stable, and ties go to the smallest id
    st = consecutive_index(
        stations.where(
            F.col(station_lat).isNotNull() & F.col(station_lon).isNotNull() & F.col(year).isNotNull()
            & ~F.isnan(station_lat) & ~F.isnan(station_lon)
        ).select(
            F.col(year).cast("int").alias("_year"),
            F.col(station_col).alias("_station"),
            F.col(station_lat).cast("double").alias("_s_lat"),
            F.col(station_lon).cast("double").alias("_s_lon"),
            *metric_cols,
        ),
        [F.col("_station").asc_nulls_last(), "_year", "_s_lat", "_s_lon", *[F.col(f"`{c}`") for c in metric_cols]],
        "_sid",
    )
    st_keys = st.select("_year", "_sid", "_s_lat", "_s_lon")

    lft = left.where(
        F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(year).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    )
    # distinct points, then spread over the configured parallelism: the fan-out of the cell join is
    # much larger than the points' bytes suggest, so the count is not left to size-based coalescing
    n_parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = lft.select(
        F.col(year).cast("int").alias("_year"),
        F.col(lat).cast("double").alias("_lat"),
        F.col(lon).cast("double").alias("_lon"),
    ).distinct().repartition(n_parts, "_year", "_lat", "_lon")
    # points of a year without any station can never match (they vanish, Q9): dropped before searching
    points = points.join(st_keys.select("_year").distinct(), "_year", "left_semi")
    best = nearest_points(points, st_keys, max_km, exact_beyond_radius=(mode == "null"))
    best = best.join(st.drop("_year").hint("merge"), "_sid").withColumn("_dist", haversine_km("_lat", "_lon", "_s_lat", "_s_lon"))
    within = F.col("_dist") <= F.lit(max_km)
    if mode == "drop":
        best = best.where(within)

    if payload == "station":
        found = best.select("_year", "_lat", "_lon", F.col("_station").alias(station_out), F.col("_dist").alias(dist_col))
    elif payload == "all":
        keep = [F.when(within, F.col("_station")).alias(station_out)] + [F.when(within, F.col(c)).alias(c) for c in metric_cols]
        found = best.select("_year", "_lat", "_lon", *keep, F.col("_dist").alias(dist_col))
    else:
        raise ValueError(f"payload must be 'station' or 'all', got {payload!r}")

    keyed = lft.withColumns(
        {"_year": F.col(year).cast("int"), "_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")}
    )
    return keyed.join(found.hint("merge"), ["_year", "_lat", "_lon"], "inner").drop("_year", "_lat", "_lon")
