"""True dissolve (A4): the boundary of the union of polygons, as distributed joins.

No polygon, group or ring is ever held by one task; all steps are joins and grouped aggregates of edges.

1. Rings become directed edges with the polygon's interior on their left (shells counter-clockwise,
   holes clockwise).
2. Polygons of a group are united in batches of ``FAN`` neighbours (by the Z-order of their boxes), the
   unions again in batches, until one is left: what lies inside a union takes no part in the next round,
   so polygons that lie ``d`` deep do not cost ``d`` crossings each.  Steps 3 and 4 are one round.
3. Edges are split where edges of other polygons of their batch cross or touch them; candidates meet in
   the cells of a grid.
4. Of pieces that coincide, one stays; if they run in both directions, there is interior on both sides
   and none stays.  A piece also goes if its midpoint is inside another polygon of the batch, which is
   the parity of that polygon's edges to its right, counted in strips of the grid.
5. What is left at last is the boundary.  Area, moments and perimeter are sums over it.  Rings come from
   pointer doubling: each piece is followed by the outgoing piece that turns most to the left, and knows
   after ``k`` rounds the smallest piece among the next ``2**k``, and how far away it is.

Coordinates are plain numbers in one plane (project first).  Crossings are rounded to ``digits``
decimals, so nearly parallel edges can shift by that much.  Rings without an area (points, lines) have
no part in a union.  A null group is a group.  A polygon is known by its key; a group in which a key is null
or that of several rows is united in one round, as such polygons have no interior of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinterra.operators.encode import consecutive_index
from vinterra.operators.polygons import _ring_sums
from vinterra.session import as_table

DIGITS = 6
XY = ("x1", "y1", "x2", "y2")
FAN = 16          # polygons or unions that are united in one batch
Z_BITS = 16       # bits of a coordinate in the Z-order


def ring_edges(polys: DataFrame, by: str, key: str, rings: str = "rings") -> DataFrame:
    """``grp, poly, row, x1, y1, x2, y2``: directed edges, interior on the left; ``grp`` is never null."""
    group = F.coalesce(F.concat(F.lit("v"), F.col(by).cast("string")), F.lit("n"))
    ring = polys.select(group.alias("grp"), F.col(key).alias("poly"), F.monotonically_increasing_id().alias("row"), rings)
    ring = ring.select("grp", "poly", "row", F.posexplode(rings).alias("r", "ring"))
    ring = ring.where(F.size("ring") > 3).withColumn("area", _ring_sums(F.col("ring"))["a2"])
    turned = F.when(F.col("r") == 0, F.col("area") < 0).otherwise(F.col("area") > 0)
    ends = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", i + 1).alias("b")))
    edges = ring.where("area != 0").withColumn("turned", turned).withColumn("ends", ends).select("grp", "poly", "row", "turned", F.explode("ends").alias("e"))
    pick = lambda one, two: F.when(F.col("turned"), F.col(two)).otherwise(F.col(one))
    out = edges.select("grp", "poly", "row", pick("e.a.x", "e.b.x").alias("x1"), pick("e.a.y", "e.b.y").alias("y1"), pick("e.b.x", "e.a.x").alias("x2"), pick("e.b.y", "e.a.y").alias("y2"))
    return out.where("x1 != x2 or y1 != y2")


def cell_size(edges: DataFrame) -> float:
    """Twice the mean extent of an edge: a few cells per edge, and few edges per cell."""
    mean = edges.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0]
    return 2 * mean if mean else 1.0


def _span(a: Column, b: Column, cell: float) -> Column:
    at = lambda v: F.floor(v / F.lit(cell)).cast("long")
    return F.explode(F.sequence(at(F.least(a, b)), at(F.greatest(a, b))))


def _touching_points(digits: int) -> Column:
    """Array of the points at which edges ``a`` and ``b`` cross, touch or begin to overlap."""
    ax, ay, bx, by = (F.col(f"a.{c}") for c in XY)
    cx, cy, dx, dy = (F.col(f"b.{c}") for c in XY)
    cross = lambda ox, oy, px, py, qx, qy: (px - ox) * (qy - oy) - (py - oy) * (qx - ox)
    c_side, d_side = cross(ax, ay, bx, by, cx, cy), cross(ax, ay, bx, by, dx, dy)
    a_side, b_side = cross(cx, cy, dx, dy, ax, ay), cross(cx, cy, dx, dy, bx, by)
    length = lambda x1, y1, x2, y2: F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))
    near_ab, near_cd = length(ax, ay, bx, by) * 10.0**-digits, length(cx, cy, dx, dy) * 10.0**-digits
    within = lambda px, py, x1, y1, x2, y2: px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    t = c_side / (c_side - d_side)
    proper = (F.abs(c_side) > near_ab) & (F.abs(d_side) > near_ab) & (F.abs(a_side) > near_cd) & (F.abs(b_side) > near_cd)
    crossing = proper & (F.signum(c_side) != F.signum(d_side)) & (F.signum(a_side) != F.signum(b_side))
    found = [
        F.when(crossing, point(F.round(cx + t * (dx - cx), digits), F.round(cy + t * (dy - cy), digits))),
        F.when((F.abs(c_side) <= near_ab) & within(cx, cy, ax, ay, bx, by), point(cx, cy)),
        F.when((F.abs(d_side) <= near_ab) & within(dx, dy, ax, ay, bx, by), point(dx, dy)),
        F.when((F.abs(a_side) <= near_cd) & within(ax, ay, cx, cy, dx, dy), point(ax, ay)),
        F.when((F.abs(b_side) <= near_cd) & within(bx, by, cx, cy, dx, dy), point(bx, by)),
    ]
    return F.array_compact(F.array(*found))


def split_edges(edges: DataFrame, cell: float, digits: int = DIGITS) -> DataFrame:
    """Edges (with ``id``) cut at all crossings with other polygons of their group: ``grp, poly, x1, y1, x2, y2``."""
    placed = edges.withColumn("cx", _span(F.col("x1"), F.col("x2"), cell)).withColumn("cy", _span(F.col("y1"), F.col("y2"), cell))
    one, two = (placed.select("grp", "cx", "cy", F.struct("id", "poly", *XY).alias(n)) for n in ("a", "b"))
    low = lambda e, *c: F.least(*(F.col(f"{e}.{x}") for x in c))
    high = lambda e, *c: F.greatest(*(F.col(f"{e}.{x}") for x in c))
    near = F.lit(True)
    for cx, c in (("cx", ("x1", "x2")), ("cy", ("y1", "y2"))):
        # boxes meet, and this is the first cell that both reach
        near &= (low("a", *c) <= high("b", *c)) & (low("b", *c) <= high("a", *c))
        near &= F.floor(F.greatest(low("a", *c), low("b", *c)) / F.lit(cell)).cast("long") == F.col(cx)
    pairs = one.join(two, ["grp", "cx", "cy"]).where("a.id < b.id and a.poly != b.poly").where(near)
    points = pairs.select("grp", "a", "b", F.explode(_touching_points(digits)).alias("p"))
    # a crossing is worked out once and given to both edges
    cuts = points.select("grp", F.explode(F.array("a", "b")).alias("e"), "p").select("grp", "e.*", "p.x", "p.y")
    ends = [edges.select("grp", "id", "poly", *XY, F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y2"))]
    marks = cuts.select("grp", "id", "poly", *XY, "x", "y").unionByName(ends[0]).unionByName(ends[1]).distinct()
    place = (F.col("x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    along = Window.partitionBy("grp", "id").orderBy(place, "x", "y")
    pieces = marks.select("grp", "poly", F.col("x").alias("px"), F.col("y").alias("py"), F.lead("x").over(along).alias("qx"), F.lead("y").over(along).alias("qy"))
    return pieces.where("qx is not null").select("grp", "poly", *[F.col(c).alias(n) for c, n in zip(("px", "py", "qx", "qy"), XY)])


def _z_order(x: Column, y: Column) -> Column:
    """Bits of two whole numbers below ``2**Z_BITS`` in turn: neighbours in the plane get near numbers."""
    bit = lambda v, i: F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 2 * i)
    spread = lambda v: reduce(Column.bitwiseOR, (bit(v, i) for i in range(Z_BITS)))
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def placed_polygons(edges: DataFrame) -> DataFrame:
    """``grp, poly, place, last``: the group's polygons numbered from 0 in Z-order, and the last number.  In a
    group in which a key is null or that of several rows, all are 0."""
    extent = edges.agg(*[f(F.least(*c) if f is F.min else F.greatest(*c)).alias(n) for n, f, c in (
        ("x", F.min, ("x1", "x2")), ("y", F.min, ("y1", "y2")), ("x_to", F.max, ("x1", "x2")), ("y_to", F.max, ("y1", "y2")))]).first()
    # edges of a closed ring start at all of its vertices
    box = edges.groupBy("grp", "poly").agg(
        ((F.min("x1") + F.max("x1")) / 2).alias("x"), ((F.min("y1") + F.max("y1")) / 2).alias("y"),
        (F.col("poly").isNull() | (F.min("row") != F.max("row"))).alias("odd"),
    )
    steps = float((1 << Z_BITS) - 1)

    def whole(c: str) -> Column:
        low, high = extent[c] or 0.0, extent[f"{c}_to"] or 0.0
        share = (F.col(c) - F.lit(low)) / F.lit(high - low if high > low else 1.0)
        return F.least(F.greatest(F.floor(share * steps), F.lit(0)), F.lit(int(steps))).cast("long")

    numbered = consecutive_index(box.withColumn("z", _z_order(whole("x"), whole("y"))), ["grp", "z", "poly"], "at")
    groups = as_table(numbered.groupBy("grp").agg(F.min("at").alias("first"), F.max("at").alias("final"), F.max("odd").alias("odd")), "overlay-groups")
    place = lambda at: F.when(F.col("odd"), F.lit(0)).otherwise(F.col(at) - F.col("first")).cast("long")
    return numbered.drop("odd").join(groups, "grp").select("grp", "poly", place("at").alias("place"), place("final").alias("last"))


def boundary(polys: DataFrame, by: str, key: str, rings: str = "rings", digits: int = DIGITS) -> DataFrame:
    """``grp, id, x1, y1, x2, y2``: the boundary of the union of each group's polygons, interior on the left."""
    edges = as_table(ring_edges(polys, by, key, rings), "overlay-rings")
    placed = placed_polygons(edges).withColumnsRenamed({"grp": "g", "poly": "p"})
    edges = edges.join(placed, (F.col("grp") == F.col("g")) & F.col("poly").eqNullSafe(F.col("p")))
    edges = as_table(edges.select("grp", "poly", "place", "last", *XY, F.monotonically_increasing_id().alias("id")), "overlay-edges")
    done = []
    while True:
        edges = _united(edges, digits)
        done.append(edges.where("last = 0").select("grp", "id", *XY))
        edges = edges.where("last > 0")
        if edges.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _united(edges: DataFrame, digits: int) -> DataFrame:
    """One round: the boundaries of the unions of ``FAN`` polygons at consecutive places of a group, with the
    place of each union (also its ``poly``)."""
    edges = edges.withColumn("grp", F.struct("grp", F.floor(F.col("place") / FAN).cast("long").alias("place"), F.floor(F.col("last") / FAN).cast("long").alias("last")))
    cell = cell_size(edges)
    pieces = split_edges(edges, cell, digits)
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y2"))]
    lines = pieces.groupBy("grp", F.least(*ends).alias("low"), F.greatest(*ends).alias("high")).agg(F.min(forward).alias("all_forward"), F.max(forward).alias("any_forward"), F.collect_set("poly").alias("polys"))
    lines = lines.where(F.col("all_forward") == F.col("any_forward"))  # the polygons of one line: those that share it
    lines = as_table(lines.select("grp", "low", "high", F.col("any_forward").alias("forward"), "polys", F.monotonically_increasing_id().alias("id")), "overlay-lines")
    mid = lines.select("grp", "id", "polys", ((F.col("low.x") + F.col("high.x")) / 2).alias("mx"), ((F.col("low.y") + F.col("high.y")) / 2).alias("my"))
    mid = mid.withColumn("strip", F.floor(F.col("my") / F.lit(cell)).cast("long"))
    strips = edges.select("grp", "poly", *XY, _span(F.col("y1"), F.col("y2"), cell).alias("strip"))
    right = F.col("x1") + (F.col("my") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")) > F.col("mx")
    passes = (F.col("y1") <= F.col("my")) != (F.col("y2") <= F.col("my"))
    crossed = mid.join(strips, ["grp", "strip"]).where(passes & ~F.array_contains("polys", F.col("poly"))).where(right)
    inside = crossed.groupBy("grp", "id", "poly").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("grp", "id").distinct()
    kept = lines.join(inside, ["grp", "id"], "left_anti")
    directed = kept.select("grp.*", F.col("grp.place").alias("poly"), "id", *[F.when(F.col("forward"), F.col(end)).otherwise(F.col(other)).alias(n) for n, end, other in (("start", "low", "high"), ("end", "high", "low"))])
    ends = [F.col(c).alias(n) for c, n in zip(("start.x", "start.y", "end.x", "end.y"), XY)]
    return as_table(directed.select("grp", "poly", "place", "last", *ends, "id"), "overlay-boundary")


def boundary_rings(lines: DataFrame) -> DataFrame:
    """Boundary pieces with their ``ring`` (the smallest ``id`` on it) and ``pos``, the place on it from 0."""
    angle = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    a = lines.select("grp", "id", F.col("x2").alias("vx"), F.col("y2").alias("vy"), angle.alias("incoming"))
    b = lines.select("grp", F.col("id").alias("follower"), F.col("x1").alias("vx"), F.col("y1").alias("vy"), angle.alias("outgoing"))
    # clockwise from the way back: the first outgoing piece is the sharpest turn to the left
    full = F.lit(6.283185307179586)
    turn = F.pmod(F.col("incoming") + full / 2 - F.col("outgoing"), full)
    turn = F.when(turn < 1e-12, full).otherwise(turn)
    nxt = a.join(b, ["grp", "vx", "vy"]).groupBy("grp", "id").agg(F.min_by("follower", F.struct(turn, "follower")).alias("nxt"))
    held = as_table(nxt.select("grp", "id", "nxt", F.col("id").alias("ring"), F.lit(0).cast("long").alias("steps")), "overlay-next")
    span, changed = 1, True
    while changed:
        ahead = held.select("grp", F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("ring").alias("ring2"), F.col("steps").alias("steps2"))
        nearer = F.col("ring") <= F.col("ring2")
        new = held.join(ahead, ["grp", "nxt"]).select(
            "grp", "id", F.col("nxt2").alias("nxt"), F.least("ring", "ring2").alias("ring"),
            F.when(nearer, F.col("steps")).otherwise(F.col("steps2") + span).alias("steps"), (~nearer).alias("moved"),
        )
        new = as_table(new, "overlay-next")
        changed = bool(new.where("moved").take(1))
        held, span = new.drop("moved"), 2 * span
    # steps lead to the ring's first piece, so the piece after it has the most
    length = held.groupBy("grp", "ring").agg(F.count(F.lit(1)).alias("n"))
    out = held.join(length, ["grp", "ring"]).select("grp", "id", "ring", ((F.col("n") - F.col("steps")) % F.col("n")).alias("pos"))
    return lines.join(out, ["grp", "id"])


def _group_value(by: str, schema: DataFrame) -> Column:
    return F.when(F.col("grp") != "n", F.expr("substring(grp, 2)")).cast(schema.schema[by].dataType).alias(by)


def dissolve_measures(polys: DataFrame, by: str, key: str, rings: str = "rings", digits: int = DIGITS) -> DataFrame:
    """``by, area, perimeter, cx, cy``: of the union of each group's polygons, overlaps counted once."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    lines = boundary(polys, by, key, rings, digits)
    sums = lines.groupBy("grp").agg(
        (F.sum(cross) / 2).alias("area"),
        F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"),
        (F.sum((F.col("x1") + F.col("x2")) * cross) / 6).alias("mx"),
        (F.sum((F.col("y1") + F.col("y2")) * cross) / 6).alias("my"),
    )
    return sums.select(_group_value(by, polys), "area", "perimeter", (F.col("mx") / F.col("area")).alias("cx"), (F.col("my") / F.col("area")).alias("cy"))


def dissolve_rings(polys: DataFrame, by: str, key: str, rings: str = "rings", digits: int = DIGITS) -> DataFrame:
    """``by, ring, pos, x, y``: vertices of the union's rings in order; shells run counter-clockwise, holes clockwise."""
    lines = boundary_rings(boundary(polys, by, key, rings, digits))
    return lines.select(_group_value(by, polys), "ring", "pos", F.col("x1").alias("x"), F.col("y1").alias("y"))
