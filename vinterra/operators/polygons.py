"""Polygon layer jobs.

Geometry is plain columns: a polygon is ``rings ARRAY<ARRAY<STRUCT<x, y>>>``
(ring 0 the shell, then holes; closed rings, WGS84 lon/lat).  Centroids are
computed in Lambert-93 metres with shoelace sums written as higher-order
functions (one row = one polygon, no shuffle).  A dissolved multi-part
geometry stays one row per part; its centroid comes from the parts' area
sums with a grouped (partially aggregated) sum, so no geometry is ever
collected into one row.  Only ring simplification (Douglas-Peucker) needs
Python, as a vectorised UDF over ring arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinterra.functions.geo import from_lambert93, to_lambert93
from vinterra.functions.text import normalize_text
from vinterra.sources.geojson import read_features

# --- fixed values -------------------------------------------------------------------------
NAME_COLUMNS = ("denom", "denominatio")     # polygon name column, in order of preference
SIMPLIFY_TOLERANCE_M = 40.0
# ------------------------------------------------------------------------------------------------

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
RINGS = T.ArrayType(RING)


# S6 -------------------------------------------------------------------------------------------
def name_column(columns: Sequence[str]) -> str:
    """``denom``, else ``denominatio``, else the first column."""
    for c in NAME_COLUMNS:
        if c in columns:
            return c
    return columns[0]


def with_clean_name(polys: DataFrame, out: str = "denom_clean") -> DataFrame:
    """P1 on the sniffed name column; a missing name stays NULL (and can never
    match), rather than becoming the text "none"."""
    named = [c for c in NAME_COLUMNS if c in polys.columns]
    col = F.coalesce(*[F.col(c).cast("string") for c in named]) if "properties" in polys.columns else F.col(name_column(polys.columns))
    return polys.withColumn(out, F.when(col.isNotNull(), normalize_text(col.cast("string"))))


def read_geojson(spark, path: str, lines: bool = False, props: Sequence[str] | None = None) -> DataFrame:
    """GeoJSON (Multi)Polygons -> one row per polygon part with ``rings``, the
    wanted properties (as text) and ``properties``, a map of all of them.

    ``lines=False``: FeatureCollections, whose features are cut out of the text;
    ``lines=True``: one Feature per line, as ``write_geojson_lines`` writes them.
    Files of both kinds are split between tasks.
    ``props``: properties that get a column; by default those of a name column
    (``denom``, ``denominatio``).

    ``properties`` and ``geometry`` are read as raw JSON text (an explicit
    schema: inference would merge 3- and 4-level coordinate arrays into
    strings); the geometry is parsed by its type."""
    if lines:
        feats = spark.read.schema("properties string, geometry string").json(path)
    else:
        feats = read_features(spark, path)
    keys = NAME_COLUMNS if props is None else props
    typ = F.get_json_object("geometry", "$.type")
    coords = F.get_json_object("geometry", "$.coordinates")
    poly_rings = F.from_json(coords, "array<array<array<double>>>")
    multi_rings = F.from_json(coords, "array<array<array<array<double>>>>")
    parts = F.when(typ == "Polygon", F.array(poly_rings)).when(typ == "MultiPolygon", multi_rings)
    every = F.from_json("properties", "map<string,string>")
    props = feats.select(*[F.element_at(every, k).alias(k) for k in keys], every.alias("properties"),
                         F.posexplode(parts).alias("part", "_r"))
    as_struct = F.transform("_r", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return props.withColumn("rings", as_struct).drop("_r")


# P18 ------------------------------------------------------------------------------------------
def project_rings(rings: Column) -> Column:
    """Every vertex to Lambert-93 (x, y metres)."""

    def proj(p: Column) -> Column:
        x, y = to_lambert93(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda ring: F.transform(ring, proj))


# A3 -------------------------------------------------------------------------------------------
def _ring_sums(ring: Column) -> Column:
    """Signed shoelace sums of one closed ring: (2A, sum cx, sum cy, n, sum x, sum y)."""
    idx = F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))

    def edge(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        cross = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct(cross.alias("c"), ((a["x"] + b["x"]) * cross).alias("cx"), ((a["y"] + b["y"]) * cross).alias("cy"))

    edges = F.filter(F.transform(idx, edge), lambda e: e.isNotNull() & e["c"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    return F.aggregate(
        edges, zero,
        lambda acc, e: F.struct((acc["a2"] + e["c"]).alias("a2"), (acc["cx"] + e["cx"]).alias("cx"), (acc["cy"] + e["cy"]).alias("cy")),
    )


_MOMENT_FIELDS = ("area", "mx", "my", "n", "sx", "sy")


def with_area_moments(df: DataFrame, rings: str = "rings", out: str = "_m") -> DataFrame:
    """Polygon area moments in projected metres as struct column ``out``:
    (area, mx, my, n, sx, sy).  Shell area counts positive, holes negative
    whatever their orientation; n/sx/sy are vertex sums for the zero-area
    fallback.  Shoelace terms are taken relative to the polygon's first vertex
    (no cancellation between large coordinates), then moved back.

    Each stage is its own column: higher-order functions are interpreted, and
    staging stops the projected rings or the ring sums from being recomputed
    for every reference (Catalyst does not inline expensive expressions twice)."""
    staged = df.withColumn("_proj", project_rings(F.col(rings)))
    staged = staged.withColumn("_o", F.element_at(F.element_at("_proj", 1), 1))
    staged = staged.withColumn(
        "_local",
        F.transform("_proj", lambda ring: F.transform(
            ring, lambda p: F.struct((p["x"] - F.col("_o.x")).alias("x"), (p["y"] - F.col("_o.y")).alias("y")))),
    )
    staged = staged.withColumn(
        "_rings",
        F.transform(
            "_local",
            lambda ring, i: F.struct(
                _ring_sums(ring).alias("s"), F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("role"),
                F.size(ring).alias("n"),
                F.aggregate(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0.0), lambda a, p: a + p["x"]).alias("sx"),
                F.aggregate(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0.0), lambda a, p: a + p["y"]).alias("sy"),
            ),
        ),
    )

    def signed(r: Column, what: str) -> Column:
        # |A_r| * centroid_r = sign(2A) * role * (sum c*) / 6 ; area = role * |2A| / 2
        if what == "area":
            return r["role"] * F.abs(r["s"]["a2"]) / 2.0
        return r["role"] * F.signum(r["s"]["a2"]) * r["s"][what] / 6.0

    zero = F.struct(*[F.lit(0.0).alias(k) for k in _MOMENT_FIELDS])
    staged = staged.withColumn(
        "_rel",
        F.aggregate(
            "_rings", zero,
            lambda acc, r: F.struct(
                (acc["area"] + signed(r, "area")).alias("area"),
                (acc["mx"] + signed(r, "cx")).alias("mx"),
                (acc["my"] + signed(r, "cy")).alias("my"),
                (acc["n"] + F.greatest(r["n"] - 1, F.lit(1)).cast("double")).alias("n"),
                (acc["sx"] + r["sx"]).alias("sx"),
                (acc["sy"] + r["sy"]).alias("sy"),
            ),
        ),
    )
    x0, y0, rel = F.col("_o.x"), F.col("_o.y"), F.col("_rel")
    moments = F.struct(
        rel["area"].alias("area"),
        (rel["mx"] + x0 * rel["area"]).alias("mx"),
        (rel["my"] + y0 * rel["area"]).alias("my"),
        rel["n"].alias("n"),
        (rel["sx"] + x0 * rel["n"]).alias("sx"),
        (rel["sy"] + y0 * rel["n"]).alias("sy"),
    )
    return staged.withColumn(out, moments).drop("_proj", "_o", "_local", "_rings", "_rel")


def centroid_from_moments(area: Column, mx: Column, my: Column, n: Column, sx: Column, sy: Column) -> tuple[Column, Column]:
    """Lambert-93 centroid (area-weighted, vertex mean when the area is 0) back to lat/lon."""
    x = F.when(area != 0, mx / area).otherwise(sx / n)
    y = F.when(area != 0, my / area).otherwise(sy / n)
    return from_lambert93(x, y)


def polygon_centroids(polys: DataFrame, rings: str = "rings") -> DataFrame:
    """A3 + P18: area centroid in Lambert-93, returned as ``lat``/``lon`` (WGS84)."""
    m = with_area_moments(polys, rings, "_m")
    xy = m.withColumn("_xy", F.struct(
        F.when(F.col("_m.area") != 0, F.col("_m.mx") / F.col("_m.area")).otherwise(F.col("_m.sx") / F.col("_m.n")).alias("x"),
        F.when(F.col("_m.area") != 0, F.col("_m.my") / F.col("_m.area")).otherwise(F.col("_m.sy") / F.col("_m.n")).alias("y")))
    lat, lon = from_lambert93(F.col("_xy.x"), F.col("_xy.y"))
    return xy.withColumns({"lat": lat, "lon": lon}).drop("_m", "_xy")


# A2 -------------------------------------------------------------------------------------------
def mean_centroid(centroids: DataFrame, key: str = "denom_clean") -> DataFrame:
    """Unweighted mean centroid per cleaned name."""
    return centroids.groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


# P12 + A4 -------------------------------------------------------------------------------------
def filter_and_select(polys: DataFrame, signe: str = "AOC", keep: Sequence[str] = ("app", "type_prod", "categorie")) -> DataFrame:
    """``signe == 'AOC'`` and the name/attribute columns plus geometry."""
    return polys.where(F.col("signe") == signe).select(*keep, "rings", *[c for c in ("poly_id",) if c in polys.columns])


def dissolve(polys: DataFrame, by: str = "app", order: str = "poly_id", attrs: Sequence[str] = ("type_prod", "categorie")) -> tuple[DataFrame, DataFrame]:
    """A4: multi-part geometry per ``by`` -- parts stay rows ``(by, part, rings)``
    -- and one attribute row per ``by`` (attributes of the first polygon in
    ``order``, area moments summed over the parts, part count)."""
    parts = polys.select(by, F.col(order).alias("part"), "rings")
    mom = with_area_moments(polys, "rings", "_m")
    attributes = mom.groupBy(by).agg(
        *[F.min_by(a, order).alias(a) for a in attrs],
        F.count(F.lit(1)).alias("n_parts"),
        *[F.sum(f"_m.{k}").alias(f"_{k}") for k in ("area", "mx", "my", "n", "sx", "sy")],
    )
    lat, lon = centroid_from_moments(*(F.col(f"_{k}") for k in ("area", "mx", "my", "n", "sx", "sy")))
    attributes = attributes.withColumns({"lat": lat, "lon": lon}).drop(*[f"_{k}" for k in ("area", "mx", "my", "n", "sx", "sy")])
    return parts, attributes


# A5 -------------------------------------------------------------------------------------------
def _douglas_peucker(xs: np.ndarray, ys: np.ndarray, tol: float) -> np.ndarray:
    """Indices kept by Douglas-Peucker (iterative; endpoints always kept)."""
    n = len(xs)
    keep = np.zeros(n, dtype=bool)
    if n <= 2:
        keep[:] = True
        return keep
    keep[0] = keep[-1] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        seg = np.hypot(dx, dy)
        px, py = xs[a + 1 : b] - xs[a], ys[a + 1 : b] - ys[a]
        if seg == 0:
            dist = np.hypot(px, py)
        else:
            dist = np.abs(dx * py - dy * px) / seg
        k = int(np.argmax(dist))
        if dist[k] > tol:
            mid = a + 1 + k
            keep[mid] = True
            stack.append((a, mid))
            stack.append((mid, b))
    return keep


def simplify_ring_xy(xs: np.ndarray, ys: np.ndarray, tol: float) -> np.ndarray:
    """Keep-mask for one closed ring; never fewer than 4 vertices (a closed
    triangle), so a ring cannot collapse -- the topology-preserving guard."""
    keep = _douglas_peucker(xs, ys, tol)
    if keep.sum() < 4 and len(xs) >= 4:
        # keep the vertices farthest from the closing point until a triangle remains
        far = np.argsort(-np.hypot(xs - xs[0], ys - ys[0]))
        for idx in far:
            if keep.sum() >= 4:
                break
            keep[idx] = True
    return keep


def _touching_segments(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Mask of the segments ``(x, y)[u] - (x, y)[v]`` that meet another one elsewhere than in a common end.

    A sweep along x: a segment is compared with those that begin before it ends, in bounded pieces."""
    order = np.argsort(np.minimum(x[u], x[v]), kind="stable")
    u, v = u[order], v[order]
    low, high = np.minimum(x[u], x[v]), np.maximum(x[u], x[v])
    last = np.searchsorted(low, high, "right")
    bad = np.zeros(len(u), bool)
    cross = lambda o, p, q: (x[p] - x[o]) * (y[q] - y[o]) - (y[p] - y[o]) * (x[q] - x[o])
    same = lambda p, q: (x[p] == x[q]) & (y[p] == y[q])
    start = 0
    while start < len(u):
        ends = np.cumsum(last[start:] - np.arange(start, len(u)) - 1)
        stop = start + max(1, int(np.searchsorted(ends, 1_000_000, "right")))
        n = last[start:stop] - np.arange(start, stop) - 1
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = (np.maximum(y[u[i]], y[v[i]]) >= np.minimum(y[u[j]], y[v[j]])) & (np.maximum(y[u[j]], y[v[j]]) >= np.minimum(y[u[i]], y[v[i]]))
        i, j = i[near], j[near]
        a, b, c, d = u[i], v[i], u[j], v[j]
        meets = (cross(a, b, c) * cross(a, b, d) <= 0) & (cross(c, d, a) * cross(c, d, b) <= 0)
        # segments with a common end meet there; they are in each other's way if they run back over themselves
        for p, q, r in ((a, b, d), (b, a, d), (a, b, c), (b, a, c)):
            other = np.where(r == d, c, d)
            common = same(p, other)
            back = (cross(p, q, r) == 0) & ((x[q] - x[p]) * (x[r] - x[p]) + (y[q] - y[p]) * (y[r] - y[p]) > 0)
            meets &= ~common | back
        bad[i[meets]] = bad[j[meets]] = True
        start = stop
    out = np.zeros(len(u), bool)
    out[order] = bad
    return out


def _contains(x: np.ndarray, y: np.ndarray, px: float, py: float) -> bool:
    """Whether a closed ring surrounds a point (parity of the edges to its right)."""
    passes = (y[:-1] <= py) != (y[1:] <= py)
    x1, y1, x2, y2 = x[:-1][passes], y[:-1][passes], x[1:][passes], y[1:][passes]
    return bool(np.count_nonzero(x1 + (py - y1) / (y2 - y1) * (x2 - x1) > px) % 2)


def simplify_rings_xy(xs: np.ndarray, ys: np.ndarray, sizes: Sequence[int], tol: float) -> np.ndarray:
    """Keep-mask of a polygon's rings (one after the other): Douglas-Peucker on each, then vertices come
    back where the result would meet itself, or where a ring would change sides of another one.

    A segment in the way of another gets back the vertex farthest from it; every round adds vertices, so
    it ends at the latest with the input's own segments, and what meets itself there stays as it was."""
    bounds = np.cumsum([0, *sizes])
    rings = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
    keep = np.concatenate([simplify_ring_xy(xs[r], ys[r], tol) for r in rings]) if rings else np.zeros(0, bool)
    boxes = [(xs[r].min(), xs[r].max(), ys[r].min(), ys[r].max()) if r.stop > r.start else None for r in rings]

    def restore(u: int, v: int) -> bool:
        if v <= u + 1:
            return False
        px, py, dx, dy = xs[u + 1 : v] - xs[u], ys[u + 1 : v] - ys[u], xs[v] - xs[u], ys[v] - ys[u]
        length = np.hypot(dx, dy)
        far = np.abs(dx * py - dy * px) / length if length else np.hypot(px, py)
        keep[u + 1 + int(np.argmax(far))] = True
        return True

    while True:
        held = [r.start + np.flatnonzero(keep[r]) for r in rings]
        u = np.concatenate([h[:-1] for h in held]) if held else np.zeros(0, int)
        v = np.concatenate([h[1:] for h in held]) if held else np.zeros(0, int)
        long = (xs[u] != xs[v]) | (ys[u] != ys[v])
        u, v = u[long], v[long]
        again = [restore(a, b) for a, b in zip(*(w[_touching_segments(xs, ys, u, v)].tolist() for w in (u, v)))]
        if any(again):
            continue
        # nothing meets: a ring as a whole may still have changed sides
        moved = False
        for k, r in enumerate(rings):
            for m, s in enumerate(rings):
                if k == m or boxes[k] is None or boxes[m] is None or not keep[s].size:
                    continue
                px, py = xs[r.start], ys[r.start]
                if not (boxes[m][0] <= px <= boxes[m][1] and boxes[m][2] <= py <= boxes[m][3]) or keep[s].all():
                    continue
                if _contains(xs[s], ys[s], px, py) != _contains(xs[held[m]], ys[held[m]], px, py):
                    moved |= any([restore(a, b) for a, b in zip(held[m][:-1].tolist(), held[m][1:].tolist())])
        if not moved:
            return keep


def simplify_polygons(df: DataFrame, rings: str = "rings", out: str = "simple",
                      tolerance_m: float = SIMPLIFY_TOLERANCE_M) -> DataFrame:
    """A5: topology-preserving Douglas-Peucker in Lambert-93 metres: rings that did not meet
    themselves or each other do not afterwards; the kept vertices are returned in WGS84 in ``out``.  The UDF sees each polygon as
    flat ``xs``/``ys`` arrays plus ring sizes (Arrow-friendly, vectorised
    batches) and returns a flat keep-mask; rings are rebuilt JVM-side.

    A small file holds many polygons, and a polygon costs about a millisecond of Python: rows are
    dealt evenly over the configured parallelism, as bytes say little about the work."""
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def keep_mask(xs: pd.Series, ys: pd.Series, sizes: pd.Series) -> pd.Series:
        res = []
        for x, y, n in zip(xs, ys, sizes):
            x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
            mask = simplify_rings_xy(x, y, n, tolerance_m)
            res.append(mask)
        return pd.Series(res, dtype=object)

    proj = project_rings(F.col(rings))
    xs = F.flatten(F.transform(proj, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(proj, lambda r: F.transform(r, lambda p: p["y"])))
    sizes = F.transform(F.col(rings), lambda r: F.size(r))
    with_mask = df.withColumn("_mask", keep_mask(xs, ys, sizes)).withColumn("_sizes", sizes)
    starts = F.transform("_sizes", lambda _, i: F.aggregate(F.slice("_sizes", 1, i), F.lit(0), lambda a, b: a + b))
    rebuilt = F.transform(
        F.col(rings),
        lambda ring, r: F.filter(ring, lambda _, i: F.element_at(F.col("_mask"), F.element_at(starts, r + 1) + i + 1)),
    )
    return with_mask.withColumn(out, rebuilt).drop("_mask", "_sizes")
