"""Geometry as Column expressions: distances, areas, volumes, containment, segment intersection.

Points are structs with x, y and perhaps z.  All functions stay in the JVM.
Null coordinates give null; see each function for NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
_EPSILON = 2.0**-52


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(add, terms)


def sub(a: Column, b: Column, dim: int) -> list[Column]:
    return [a[n] - b[n] for n in AXES[:dim]]


def cross(u: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    """Vector product in three dimensions; a single number in two."""
    if len(u) == 2:
        return [u[0] * v[1] - u[1] * v[0]]
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def dot(u: Sequence[Column], v: Sequence[Column]) -> Column:
    return _sum([a * b for a, b in zip(u, v)])


def _let(values: dict[str, Column], body) -> Column:
    """``body`` over a struct of ``values``, each of which is computed once and stands once in the plan."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), F.lit(0))


# -- distances, areas, volumes ----------------------------------------------------


def squared_distance(a: Column, b: Column, dim: int) -> Column:
    d = sub(a, b, dim)
    return dot(d, d)


def distance(a: Column, b: Column, dim: int) -> Column:
    return F.sqrt(squared_distance(a, b, dim))


def triangle_area_signed(a: Column, b: Column, c: Column) -> Column:
    """Area in the plane, positive where a, b, c turn left."""
    return cross(sub(b, a, 2), sub(c, a, 2))[0] / 2


def triangle_area(a: Column, b: Column, c: Column, dim: int) -> Column:
    if dim == 2:
        return F.abs(triangle_area_signed(a, b, c))
    n = cross(sub(b, a, 3), sub(c, a, 3))
    return F.sqrt(dot(n, n)) / 2


def quad_area_signed(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Half of the product of the diagonals."""
    return cross(sub(c, a, 2), sub(d, b, 2))[0] / 2


def quad_area(a: Column, b: Column, c: Column, d: Column, dim: int) -> Column:
    """In space the area of the two triangles on the diagonal a-c."""
    if dim == 2:
        return F.abs(quad_area_signed(a, b, c, d))
    return triangle_area(a, b, c, 3) + triangle_area(a, c, d, 3)


def polygon_area_signed(points: Column) -> Column:
    """Area in the plane of a polygon given as an array of points, positive if it turns left; 0 below three points."""
    n = F.size(points)
    after = lambda i: F.get(points, F.when(i == n - 1, 0).otherwise(i + 1))
    at = lambda i: F.get(points, i)
    term = lambda i: at(i)["x"] * after(i)["y"] - after(i)["x"] * at(i)["y"]
    return F.when(n < 3, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i)) / 2)


def tetra_volume_signed(a: Column, b: Column, c: Column, d: Column) -> Column:
    return dot(cross(sub(b, a, 3), sub(c, a, 3)), sub(d, a, 3)) / 6


# -- boxes and balls --------------------------------------------------------------


def in_box(xs: Sequence[Column], lo: Sequence[float], hi: Sequence[float]) -> Column:
    """lo <= x < hi on every axis; a NaN is on no axis outside."""
    outside = [~F.isnan(x) & ((x < F.lit(float(a))) | (x >= F.lit(float(b)))) for x, a, b in zip(xs, lo, hi)]
    return ~reduce(lambda p, q: p | q, outside)


def in_ball(xs: Sequence[Column], centre: Sequence[float], r: float) -> Column:
    """Nearer to the centre than ``r``; false for NaN."""
    d2 = _sum([(x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c in zip(xs, centre)])
    return ~F.isnan(d2) & (d2 < F.lit(float(r) * float(r)))


def aabb(points: Column, dim: int) -> Column:
    """Struct of the smallest and largest coordinates of an array of points."""
    axis = lambda n: F.transform(points, lambda p: p[n])
    return F.struct(*[F.array_min(axis(n)).alias(f"{n}_min") for n in AXES[:dim]], *[F.array_max(axis(n)).alias(f"{n}_max") for n in AXES[:dim]])


def centroid(points: Column, dim: int) -> list[Column]:
    """Mean of the nodes, one Column an axis; null if a coordinate is."""
    total = lambda n: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[n])
    return [F.when(F.size(points) > 0, total(n) / F.size(points)) for n in AXES[:dim]]


# -- polygons ------------------------------------------------------------------------


def _crosses(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Whether the ray from (px, py) towards growing x meets the edge a-b; of an edge's ends the upper one does not count."""
    at = a["x"] + (py - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"])
    return F.when((a["y"] > py) != (b["y"] > py), px < at).otherwise(F.lit(False))


def _edges(corners: Column, test) -> Column:
    """How many edges of the closed polygon satisfy ``test(i, from, to)``."""
    n = F.size(corners)
    hit = lambda i: test(i, F.get(corners, i), F.get(corners, F.when(i == n - 1, 0).otherwise(i + 1)))
    return F.size(F.filter(F.sequence(F.lit(0), n - 1), hit))


def in_polygon(px: Column, py: Column, corners: Column) -> Column:
    """Even-odd rule over an array of corners; fewer than three hold nothing."""
    inside = _edges(corners, lambda i, a, b: _crosses(px, py, a, b)) % 2 == 1
    return F.when(F.size(corners) < 3, F.lit(False)).otherwise(inside)


def _side(px: Column, py: Column, a: Column, b: Column) -> Column:
    return (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])


def _in_curved(px: Column, py: Column, points: Column, between) -> Column:
    """Corners first, then one control point an edge: the straight polygon, with each edge's piece between chord and curve added or taken away."""
    n = F.floor(F.size(points) / 2).cast("int")
    corners = F.slice(points, F.lit(1), n)
    straight = _edges(corners, lambda i, a, b: _crosses(px, py, a, b))
    pieces = _edges(corners, lambda i, a, b: between(a, F.get(points, i + n), b))
    odd = F.raise_error(F.lit("a curved polygon needs as many control points as corners")).cast("boolean")
    return F.when(F.size(points) % 2 == 1, odd).when(n < 1, F.lit(False)).otherwise((straight + pieces) % 2 == 1)


def in_arc_polygon(px: Column, py: Column, points: Column) -> Column:
    """A polygon whose edges are arcs of circles: corners, then a point on the arc of each edge.

    An arc whose three points lie in a line is that line.  A point counts for an
    arc's piece if it is in the circle and on the arc's side of the chord.
    """

    def between(a: Column, q: Column, b: Column) -> Column:
        # Relative to a: the chord c, the arc's point m, the point p; and from them the circle's centre u.
        flat = {"cx": b["x"] - a["x"], "cy": b["y"] - a["y"], "mx": q["x"] - a["x"], "my": q["y"] - a["y"], "px": px - a["x"], "py": py - a["y"]}

        def test(v: Column) -> Column:
            cc, mm = v["cx"] * v["cx"] + v["cy"] * v["cy"], v["mx"] * v["mx"] + v["my"] * v["my"]
            bulge = v["cx"] * v["my"] - v["cy"] * v["mx"]
            centre = {"ux": (v["my"] * cc - v["cy"] * mm) / (2 * bulge), "uy": (v["cx"] * mm - v["mx"] * cc) / (2 * bulge)}

            def held(u: Column) -> Column:
                dx, dy = v["px"] - u["ux"], v["py"] - u["uy"]
                return (dx * dx + dy * dy < u["ux"] * u["ux"] + u["uy"] * u["uy"]) & ((v["cx"] * v["py"] - v["cy"] * v["px"]) * bulge > 0)

            return F.when(2 * F.abs(bulge) < 1e-14, F.lit(False)).otherwise(_let(centre, held))

        return _let(flat, test)

    return _in_curved(px, py, points, between)


def in_bezier_polygon(px: Column, py: Column, points: Column) -> Column:
    """A polygon whose edges are quadratic Bezier curves: corners, then a control point of each edge.

    With u, v, w the barycentric coordinates in the triangle of corner, control point and next
    corner, the curve is v * v = 4 * u * w (Loop and Blinn 2005), and the piece below it v * v < 4 * u * w.
    """

    def between(a: Column, q: Column, b: Column) -> Column:
        sides = {"whole": _side(q["x"], q["y"], a, b), "v": _side(px, py, a, b), "u": _side(px, py, b, q)}

        def test(s: Column) -> Column:
            part = {"u": s["u"] / s["whole"], "v": s["v"] / s["whole"]}
            below = lambda t: (t["v"] > 0) & (t["v"] * t["v"] < 4 * t["u"] * (1 - t["u"] - t["v"]))
            return F.when(s["whole"] == 0, F.lit(False)).otherwise(_let(part, below))

        return _let(sides, test)

    return _in_curved(px, py, points, between)


def in_polyhedron(p: Column, faces: Column) -> Column:
    """Even-odd rule over faces (arrays of points, cut into fans), by a ray towards growing x.

    In the y-z plane each triangle takes the half-open edge rule, so that a
    ray through an edge that two triangles share meets one of them; faces below three points are passed over.
    """

    def hit(a: Column, b: Column, c: Column) -> Column:
        flat = lambda t: F.struct(t["y"].alias("x"), t["z"].alias("y"))
        fa, fb, fc = flat(a), flat(b), flat(c)
        crossings = sum((_crosses(p["y"], p["z"], s, t).cast("int") for s, t in ((fb, fc), (fc, fa))), _crosses(p["y"], p["z"], fa, fb).cast("int"))
        n = cross(sub(b, a, 3), sub(c, a, 3))
        at = a["x"] - (n[1] * (p["y"] - a["y"]) + n[2] * (p["z"] - a["z"])) / n[0]
        return F.when((crossings % 2 == 1) & (n[0] != 0), at > p["x"]).otherwise(F.lit(False))

    def hits(face: Column) -> Column:
        fan = F.when(F.size(face) > 2, F.sequence(F.lit(1), F.size(face) - 2)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(fan, lambda i: hit(F.get(face, F.lit(0)), F.get(face, i), F.get(face, i + 1))))

    return F.aggregate(faces, F.lit(0), lambda s, face: s + hits(face)) % 2 == 1


def split_faces(conn: Column, end: int) -> Column:
    """Node ids of each face of a polyhedron's connectivity, whose faces end with ``end``."""
    start = F.array(F.array().cast("array<bigint>"))
    grow = lambda acc, n: F.when(n == end, F.concat(acc, start)).otherwise(
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(n))))
    )
    return F.filter(F.aggregate(conn, start, grow), lambda face: F.size(face) > 0)


# -- segments -------------------------------------------------------------------------


def on_segment(p: Column, a: Column, b: Column, eps: float = 64 * _EPSILON) -> Column:
    """Whether p lies on a-b, its ends included, up to ``eps`` times the squared scale."""
    ab, ap = sub(b, a, 2), sub(p, a, 2)
    scale = F.greatest(F.abs(ab[0]), F.abs(ab[1]), F.lit(1.0))
    along = dot(ap, ab)
    return (F.abs(cross(ap, ab)[0]) <= eps * scale * scale) & (along >= 0) & (along <= dot(ab, ab))


def directed_edge(a: Column, b: Column) -> Column:
    return F.struct(a.alias("from"), b.alias("to"))


def undirected_edge(a: Column, b: Column) -> Column:
    """The same for a-b and b-a."""
    return F.struct(F.least(a, b).alias("from"), F.greatest(a, b).alias("to"))


def segment_intersection(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Where p1-p2 and p3-p4 meet: struct (kind, a, b, x, y).

    kind is ``none``; ``end`` (they meet at end ``a``, 1 to 4, the first that is close); ``new`` (at x, y, an end of
    neither); or ``overlap`` (they share the piece from end ``a`` to end ``b``, along p1-p2).
    Segments of no length meet nothing.  Tolerances grow with the longer
    segment.  Colinear segments are ordered on the axis along which p1-p2 is longer.
    """
    d1, d2, d3 = sub(p2, p1, 2), sub(p4, p3, 2), sub(p3, p1, 2)
    scale = F.greatest(*[F.abs(c) for c in [*d1, *d2]], F.lit(1.0))
    facts = {
        "eps": F.lit(64.0 * _EPSILON) * scale,
        "c12": cross(d1, d2)[0],
        "c31": cross(d3, d1)[0],
        "c32": cross(d3, d2)[0],
        "short": F.least(dot(d1, d1), dot(d2, d2)),
        "wide": F.abs(d1[0]) >= F.abs(d1[1]),
    }
    number = lambda c: (F.lit(None) if c is None else F.lit(c) if isinstance(c, int) else c).cast("int")
    out = lambda kind, a=None, b=None, px=None, py=None: F.struct(
        F.lit(kind).alias("kind"),
        number(a).alias("a"),
        number(b).alias("b"),
        (F.lit(None).cast("double") if px is None else px).alias("x"),
        (F.lit(None).cast("double") if py is None else py).alias("y"),
    )

    def single(f: Column) -> Column:
        def at(m: Column) -> Column:
            near = lambda p: (p["x"] - m["x"]) * (p["x"] - m["x"]) + (p["y"] - m["y"]) * (p["y"] - m["y"]) < f["eps"]
            apart = ~(m["t"].between(0, 1) & m["u"].between(0, 1))
            return F.when(apart, out("none")).when(near(p1), out("end", 1)).when(near(p2), out("end", 2)).when(near(p3), out("end", 3)).when(near(p4), out("end", 4)).otherwise(out("new", px=m["x"], py=m["y"]))

        t = f["c32"] / f["c12"]
        return _let({"t": t, "u": f["c31"] / f["c12"], "x": p1["x"] + t * d1[0], "y": p1["y"] + t * d1[1]}, at)

    def colinear(f: Column) -> Column:
        place = lambda p: F.when(f["wide"], (p["x"] - p1["x"]) / d1[0]).otherwise((p["y"] - p1["y"]) / d1[1])

        def along(m: Column) -> Column:
            first, last = F.least(m["t3"], m["t4"]), F.greatest(m["t3"], m["t4"])
            lower, upper = F.when(m["t3"] <= m["t4"], 3).otherwise(4), F.when(m["t3"] <= m["t4"], 4).otherwise(3)
            begin, end = F.when(first > 0, lower).otherwise(1), F.when(last < 1, upper).otherwise(2)
            return F.when((first > 1) | (last < 0), out("none")).when(first == 1, out("end", 2)).when(last == 0, out("end", 1)).otherwise(out("overlap", begin, end))

        return _let({"t3": place(p3), "t4": place(p4)}, along)

    def decide(f: Column) -> Column:
        parallel = F.abs(f["c12"]) < f["eps"]
        nothing = (f["short"] < f["eps"]) | (parallel & (F.abs(f["c31"]) > f["eps"]))
        return F.when(nothing, out("none")).when(parallel, colinear(f)).otherwise(single(f))

    return _let(facts, decide)
