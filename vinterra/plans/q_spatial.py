"""Polygon and fuzzy-match queries.

Polygons: one per customer, a box around its region point with edge
midpoints (jittered by up to ~20 m), a hole in every 7th, a zero-area
"point" polygon in every 11th.  Names come from ``part`` (every 13th from the
customer's nation, every 97th missing).  Wine names for the fuzzy match are
variants of part names (exact with brand, case-changed, first letter dropped,
vowels shifted, spaces removed).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vinterra.functions.geo import lambert93_inverse_sql, lambert93_sql, to_lambert93, from_lambert93
from vinterra.operators.fuzzy import DEFAULT_THRESHOLD, fuzzy_matches, fuzzy_semi_join
from vinterra.operators.overlay import dissolve_measures, dissolve_rings
from vinterra.operators.polygons import (
    dissolve,
    filter_and_select,
    mean_centroid,
    polygon_centroids,
    simplify_polygons,
    with_clean_name,
)
from vinterra.plans import standins
from vinterra.plans.q_text import _normalize_sql
from vinterra.plans.registry import query, rounded
from vinterra.sources.tables import table

_AOC_SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY")


def polygons(spark, d):
    c = standins.regions(spark, d, extra=("c_custkey", "c_nationkey", "c_mktsegment"))
    p = table(spark, d, "part").select("p_partkey", "p_name")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    base = c.join(p.hint("merge"), c.c_custkey == p.p_partkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    k = F.col("c_custkey")
    h = F.lit(0.01) + F.pmod(k, F.lit(5)).cast("double") * 0.005
    j = F.pmod(k, F.lit(3)).cast("double") * 0.0001
    lat, lon = F.col("latitude"), F.col("longitude")

    def pt(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    shell = F.array(
        pt(lon - h, lat - h), pt(lon, lat - h + j), pt(lon + h, lat - h), pt(lon + h + j, lat),
        pt(lon + h, lat + h), pt(lon, lat + h + j), pt(lon - h, lat + h), pt(lon - h + j, lat), pt(lon - h, lat - h),
    )
    g = h / 3
    hole = F.array(pt(lon - g, lat - g), pt(lon - g, lat + g), pt(lon + g, lat + g), pt(lon + g, lat - g), pt(lon - g, lat - g))
    point = F.array(*[pt(lon, lat)] * 5)
    rings = (
        F.when(F.pmod(k, F.lit(11)) == 0, F.array(point))
        .when(F.pmod(k, F.lit(7)) == 0, F.array(shell, hole))
        .otherwise(F.array(shell))
    )
    denom = (
        F.when(F.pmod(k, F.lit(97)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(k, F.lit(13)) == 0, F.col("n_name"))
        .otherwise(F.col("p_name"))
    )
    return base.select(
        k.alias("poly_id"), denom.alias("denom"), denom.alias("app"),
        F.when(F.col("c_mktsegment").isin(*_AOC_SEGMENTS), "AOC").otherwise("IGP").alias("signe"),
        F.col("c_mktsegment").alias("type_prod"),
        F.concat(F.lit("cat"), F.pmod(F.col("c_nationkey"), F.lit(3)).cast("string")).alias("categorie"),
        rings.alias("rings"),
    )


def _pt_sql(x: str, y: str) -> str:
    return f"{{'x': CAST({x} AS DOUBLE), 'y': CAST({y} AS DOUBLE)}}"


_H = "(0.01 + CAST(c.c_custkey % 5 AS DOUBLE) * 0.005)"
_J = "(CAST(c.c_custkey % 3 AS DOUBLE) * 0.0001)"
_G = f"({_H} / 3)"
_SHELL = "[" + ", ".join(_pt_sql(x, y) for x, y in [
    (f"r.longitude - {_H}", f"r.latitude - {_H}"), ("r.longitude", f"r.latitude - {_H} + {_J}"),
    (f"r.longitude + {_H}", f"r.latitude - {_H}"), (f"r.longitude + {_H} + {_J}", "r.latitude"),
    (f"r.longitude + {_H}", f"r.latitude + {_H}"), ("r.longitude", f"r.latitude + {_H} + {_J}"),
    (f"r.longitude - {_H}", f"r.latitude + {_H}"), (f"r.longitude - {_H} + {_J}", "r.latitude"),
    (f"r.longitude - {_H}", f"r.latitude - {_H}"),
]) + "]"
_HOLE = "[" + ", ".join(_pt_sql(x, y) for x, y in [
    (f"r.longitude - {_G}", f"r.latitude - {_G}"), (f"r.longitude - {_G}", f"r.latitude + {_G}"),
    (f"r.longitude + {_G}", f"r.latitude + {_G}"), (f"r.longitude + {_G}", f"r.latitude - {_G}"),
    (f"r.longitude - {_G}", f"r.latitude - {_G}"),
]) + "]"
_POINT = "[" + ", ".join([_pt_sql("r.longitude", "r.latitude")] * 5) + "]"

_POLYS_SQL = f"""{standins.REGIONS_SQL},
polys AS (
  SELECT c.c_custkey AS poly_id,
         CASE WHEN c.c_custkey % 97 = 0 THEN NULL WHEN c.c_custkey % 13 = 0 THEN n.n_name ELSE p.p_name END AS denom,
         CASE WHEN c.c_custkey % 97 = 0 THEN NULL WHEN c.c_custkey % 13 = 0 THEN n.n_name ELSE p.p_name END AS app,
         CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'AOC' ELSE 'IGP' END AS signe,
         c.c_mktsegment AS type_prod, 'cat' || CAST(c.c_nationkey % 3 AS VARCHAR) AS categorie,
         CASE WHEN c.c_custkey % 11 = 0 THEN [{_POINT}]
              WHEN c.c_custkey % 7 = 0 THEN [{_SHELL}, {_HOLE}]
              ELSE [{_SHELL}] END AS rings
  FROM customer c LEFT JOIN part p ON c.c_custkey = p.p_partkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN regions r ON r.region = c.c_name)"""

_LX, _LY = lambert93_sql("v.y", "v.x")
_MOMENTS_SQL = f"""rr AS (SELECT poly_id, generate_subscripts(rings, 1) AS r, unnest(rings) AS ring FROM polys),
vv AS (SELECT poly_id, r, len(ring) AS nr, generate_subscripts(ring, 1) AS i, unnest(ring) AS v FROM rr),
pa AS (SELECT poly_id, r, nr, i, {_LX} AS x, {_LY} AS y FROM vv),
o AS (SELECT poly_id, x AS x0, y AS y0 FROM pa WHERE r = 1 AND i = 1),
pv AS (SELECT pa.poly_id, r, nr, i, x - x0 AS x, y - y0 AS y FROM pa JOIN o USING (poly_id)),
ed AS (SELECT a.poly_id, a.r, a.x * b.y - b.x * a.y AS c, (a.x + b.x) * (a.x * b.y - b.x * a.y) AS cx,
              (a.y + b.y) * (a.x * b.y - b.x * a.y) AS cy
       FROM pv a JOIN pv b ON a.poly_id = b.poly_id AND a.r = b.r AND b.i = a.i + 1),
rs AS (SELECT e.poly_id, e.r, sum(c) AS a2, sum(cx) AS scx, sum(cy) AS scy FROM ed e GROUP BY 1, 2),
rv AS (SELECT poly_id, r, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM pv WHERE i < nr GROUP BY 1, 2),
rel AS (
  SELECT rs.poly_id,
         sum(CASE WHEN rs.r = 1 THEN 1.0 ELSE -1.0 END * abs(a2) / 2.0) AS area,
         sum(CASE WHEN rs.r = 1 THEN 1.0 ELSE -1.0 END * sign(a2) * scx / 6.0) AS mx,
         sum(CASE WHEN rs.r = 1 THEN 1.0 ELSE -1.0 END * sign(a2) * scy / 6.0) AS my,
         sum(rv.n) AS n, sum(rv.sx) AS sx, sum(rv.sy) AS sy
  FROM rs JOIN rv USING (poly_id, r) GROUP BY rs.poly_id),
mom AS (SELECT poly_id, area, mx + x0 * area AS mx, my + y0 * area AS my, n, sx + x0 * n AS sx, sy + y0 * n AS sy
        FROM rel JOIN o USING (poly_id))"""


def _centroid_sql(prefix: str = "") -> tuple[str, str]:
    x = f"CASE WHEN {prefix}area <> 0 THEN {prefix}mx / {prefix}area ELSE {prefix}sx / {prefix}n END"
    y = f"CASE WHEN {prefix}area <> 0 THEN {prefix}my / {prefix}area ELSE {prefix}sy / {prefix}n END"
    return lambert93_inverse_sql(x, y)


_CLAT, _CLON = _centroid_sql()


# P18 ------------------------------------------------------------------------------------------
_RX, _RY = lambert93_sql("latitude", "longitude")
_ILAT, _ILON = lambert93_inverse_sql("x", "y")


@query(
    "lambert93",
    f"""WITH {standins.REGIONS_SQL}, p AS (SELECT region, latitude, longitude, {_RX} AS x, {_RY} AS y FROM regions)
        SELECT region, round(floor(x * 1000.0 + 0.5) / 1000.0, 6) AS x, round(floor(y * 1000.0 + 0.5) / 1000.0, 6) AS y,
               round({_ILAT}, 6) AS lat_back, round({_ILON}, 6) AS lon_back FROM p""",
)
def lambert93(spark, d):
    r = standins.regions(spark, d)
    x, y = to_lambert93("latitude", "longitude")
    p = r.select("region", x.alias("x"), y.alias("y"))
    lat, lon = from_lambert93("x", "y")
    mm = {c: F.floor(F.col(c) * 1000.0 + 0.5) / 1000.0 for c in ("x", "y")}
    return rounded(p.select("region", lat.alias("lat_back"), lon.alias("lon_back"), "x", "y").withColumns(mm))


# A3 -------------------------------------------------------------------------------------------
@query(
    "polygon_centroid",
    f"""WITH {_POLYS_SQL}, {_MOMENTS_SQL}
        SELECT poly_id, round({_CLAT}, 6) AS lat, round({_CLON}, 6) AS lon FROM mom""",
)
def polygon_centroid(spark, d):
    return rounded(polygon_centroids(polygons(spark, d)).select("poly_id", "lat", "lon"))


# P12 + A4 -------------------------------------------------------------------------------------
_DLAT, _DLON = _centroid_sql("g.")


@query(
    "polygon_filter_dissolve",
    f"""WITH {_POLYS_SQL}, {_MOMENTS_SQL},
        g AS (SELECT p.app, arg_min(p.type_prod, p.poly_id) AS type_prod, arg_min(p.categorie, p.poly_id) AS categorie,
                     count(*) AS n_parts, sum(m.area) AS area, sum(m.mx) AS mx, sum(m.my) AS my, sum(m.n) AS n,
                     sum(m.sx) AS sx, sum(m.sy) AS sy
              FROM polys p JOIN mom m USING (poly_id) WHERE p.signe = 'AOC' GROUP BY p.app)
        SELECT app, type_prod, categorie, n_parts, round({_DLAT}, 6) AS lat, round({_DLON}, 6) AS lon FROM g""",
)
def polygon_filter_dissolve(spark, d):
    kept = filter_and_select(polygons(spark, d))
    _, attrs = dissolve(kept)
    return rounded(attrs.select("app", "type_prod", "categorie", "n_parts", "lat", "lon"))


# A4, overlaps counted once -----------------------------------------------------------------------
_PLAN = 120  # side of the square in which every customer has a box, every fifth with a hole


def overlapping_boxes(spark, d):
    """One axis-parallel box with whole-number corners per customer; the boxes of a nation overlap."""
    k = F.col("c_custkey")
    at = lambda prime: F.pmod(k * prime, F.lit(_PLAN)).cast("double")
    c = table(spark, d, "customer").select(
        k.alias("poly_id"), F.col("c_nationkey").alias("nation"), at(7919).alias("x"), at(104729).alias("y"),
        (F.pmod(k, F.lit(17)) + 4).cast("double").alias("w"), (F.pmod(k, F.lit(13)) + 4).cast("double").alias("h"),
    )

    def ring(inset):
        x0, y0 = F.col("x") + inset, F.col("y") + inset
        x1, y1 = F.col("x") + F.col("w") - inset, F.col("y") + F.col("h") - inset
        return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])

    holed = F.pmod(F.col("poly_id"), F.lit(5)) == 0
    return c.select("poly_id", "nation", F.when(holed, F.array(ring(0.0), ring(1.0))).otherwise(F.array(ring(0.0))).alias("rings"))


@query(
    "polygon_union",
    f"""WITH b AS (
          SELECT c_custkey AS k, c_nationkey AS nation, c_custkey * 7919 % {_PLAN} AS x, c_custkey * 104729 % {_PLAN} AS y,
                 c_custkey % 17 + 4 AS w, c_custkey % 13 + 4 AS h FROM customer),
        ci AS (SELECT *, unnest(range(x, x + w)) AS i FROM b),
        ij AS (SELECT *, unnest(range(y, y + h)) AS j FROM ci),
        u AS (SELECT DISTINCT nation, i, j FROM ij
              WHERE NOT (k % 5 = 0 AND i > x AND i < x + w - 1 AND j > y AND j < y + h - 1)),
        s AS (SELECT nation, i + di AS i, j + dj AS j FROM u, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(di, dj)),
        p AS (SELECT nation, count(*) AS perimeter FROM s ANTI JOIN u USING (nation, i, j) GROUP BY nation)
        SELECT nation, count(*)::DOUBLE AS area, any_value(perimeter)::DOUBLE AS perimeter,
               round(avg(i + 0.5), 6) AS cx, round(avg(j + 0.5), 6) AS cy FROM u JOIN p USING (nation) GROUP BY nation""",
)
def polygon_union(spark, d):
    """Area, perimeter and centroid of the union of every nation's boxes (SQL counts unit cells)."""
    return rounded(dissolve_measures(overlapping_boxes(spark, d), "nation", "poly_id"))


@query("polygon_union_rings")
def polygon_union_rings(spark, d):
    """Every ring of the unions: its vertices and signed area (holes are negative)."""
    v = dissolve_rings(overlapping_boxes(spark, d), "nation", "poly_id")
    turn = Window.partitionBy("nation", "ring").orderBy("pos")
    nx, ny = (F.coalesce(F.lead(c).over(turn), F.first(c).over(turn)) for c in ("x", "y"))
    cross = v.withColumn("cross", F.col("x") * ny - nx * F.col("y"))
    return rounded(cross.groupBy("nation", "ring").agg(F.count(F.lit(1)).alias("n_vertices"), (F.sum("cross") / 2).alias("area")).drop("ring"))


# A2 -------------------------------------------------------------------------------------------
@query(
    "polygon_mean",
    f"""WITH {_POLYS_SQL}, {_MOMENTS_SQL},
        c AS (SELECT p.poly_id, {_normalize_sql('p.denom', null_as_empty=False)} AS denom_clean, {_CLAT} AS lat, {_CLON} AS lon
              FROM polys p JOIN mom USING (poly_id) WHERE p.denom IS NOT NULL)
        SELECT denom_clean, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM c GROUP BY denom_clean""",
)
def polygon_mean(spark, d):
    c = polygon_centroids(with_clean_name(polygons(spark, d))).where(F.col("denom_clean").isNotNull())
    return rounded(mean_centroid(c))


# A5 -------------------------------------------------------------------------------------------
@query(
    "ring_simplify",
    f"""WITH {_POLYS_SQL},
        kept AS (
          SELECT poly_id, list_sum([len(r) for r in rings]) AS n,
                 CASE WHEN poly_id % 11 = 0 THEN rings[1][1:4]
                      ELSE list_concat([rings[1][i] for i in [1, 3, 5, 7, 9]], coalesce(rings[2], [])) END AS k FROM polys)
        SELECT poly_id, CAST(n AS INTEGER) AS n_vertices, CAST(len(k) AS INTEGER) AS n_simplified,
               round(list_sum([v.x for v in k]), 6) AS sum_x, round(list_sum([v.y for v in k]), 6) AS sum_y FROM kept""",
)
def ring_simplify(spark, d):
    """The jitter of the edge midpoints is below the tolerance, so boxes keep their corners; rings of
    one place keep the four vertices of the smallest closed ring."""
    p = simplify_polygons(polygons(spark, d), "rings", "simple")
    kept = F.flatten("simple")
    total = lambda axis: F.aggregate(kept, F.lit(0.0), lambda a, v: a + v[axis])
    return rounded(p.select("poly_id", F.size(F.flatten("rings")).alias("n_vertices"), F.size(kept).alias("n_simplified"),
                            total("x").alias("sum_x"), total("y").alias("sum_y")))


# J8 + S6 + P1 + A3 + A2: appellations matched to wine names ----------------------------------------
def wine_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    k = F.pmod(F.col("p_partkey"), F.lit(5))
    name = (
        F.when(k == 0, F.concat_ws(" ", "p_name", "p_brand"))
        .when(k == 1, F.initcap("p_name"))
        .when(k == 2, F.expr("substring(p_name, 2)"))
        .when(k == 3, F.translate("p_name", "aeiou", "eioua"))
        .otherwise(F.regexp_replace("p_name", " ", ""))
    )
    return p.select(name.alias("Wine"))


@query("fuzzy_semi")
def fuzzy_semi(spark, d):
    polys = with_clean_name(polygons(spark, d))
    matched = fuzzy_semi_join(polys.where(F.col("denom_clean").isNotNull()), "denom_clean", wine_names(spark, d), "Wine", DEFAULT_THRESHOLD)
    return rounded(mean_centroid(polygon_centroids(matched)))


_WINE_NAMES_SQL = """SELECT CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || p_brand
       WHEN 1 THEN array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ')
       WHEN 2 THEN p_name[2:] WHEN 3 THEN translate(p_name, 'aeiou', 'eioua') ELSE replace(p_name, ' ', '') END AS Wine FROM part"""
_POLY_NAMES_SQL = f"SELECT DISTINCT {_normalize_sql('CAST(denom AS VARCHAR)')} AS n FROM polys WHERE denom IS NOT NULL"


@query(
    "fuzzy_pairs",
    f"""WITH {_POLYS_SQL}, nd AS ({_POLY_NAMES_SQL}), hs AS (SELECT DISTINCT Wine AS h FROM ({_WINE_NAMES_SQL}))
        SELECT n, h FROM nd, hs WHERE (contains(h, n) AND n <> '') OR (contains(n, h) AND h <> '') OR n = h""",
)
def fuzzy_pairs(spark, d):
    """Matching pairs above 99: for names of up to 50 characters no edit is left, so one contains the other."""
    polys = with_clean_name(polygons(spark, d)).where(F.col("denom_clean").isNotNull())
    return fuzzy_matches(polys, "denom_clean", wine_names(spark, d), "Wine", 99)
