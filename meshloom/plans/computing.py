"""Queries of the field expressions and the geometry kernels, over the whole mesh tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.functions.fields import Field
from meshloom.plans.tables import EL, POINTS, Plans, space, sql_thousandths, thousandths, whole

plans = Plans()
_ALL = ("temperature", "pressure", "quality")
_T, _P, _Q = Field("temperature"), Field("pressure"), Field("quality")

# -- expressions ------------------------------------------------------------------------


def _evaluated(key: str, make: Field, sql: str, dim: int | None = None) -> None:
    """A query that evaluates ``make`` over one dimension (the highest: 3), and its SQL over t, p, q."""
    where = 3 if dim is None else dim
    cols = "temperature as t, pressure as p, quality as q"
    text = f"with {EL}, v as (select etype, elem_id, {sql} as v from (select etype, elem_id, {cols} from el where dim = {where})) select etype, elem_id, {sql_thousandths('v')} as value from v"

    @plans.add(key, text)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = whole(spark, sf_dir, tuple(sorted(make.names))).eval(make, dim)
        return out.select("etype", "elem_id", thousandths(F.col("value")).alias("value"))


def _div(a: str, b: str) -> str:
    return f"case when {b} = 0 then case when isnan({a}) or {a} = 0 then 'nan'::double else sign({a}) * 'inf'::double end else {a} / {b} end"


def _log(f: str, x: str) -> str:
    return f"case when {x} > 0 then {f}({x}) when {x} = 0 then '-inf'::double when {x} is not null then 'nan'::double end"


_evaluated("exp_01", _T, "t")
_evaluated("exp_02", Field.constant(2.5), "2.5::double", 1)
_evaluated("exp_03", 1 + _T + _P, "1::double + t + p")
_evaluated("exp_04", 100 - (_T - _P), "100::double - (t - p)")
_evaluated("exp_05", 2 * _T * _Q, "2::double * t * q")
_evaluated("exp_06", 1 / (_T / _P - _T / _P) + _T / (_P - 50) + 3 / _Q, f"({_div('1::double', '(' + _div('t', 'p') + ' - ' + _div('t', 'p') + ')')}) + ({_div('t', '(p - 50)')}) + ({_div('3::double', 'q')})")
_evaluated("exp_07", _Q.pow(1.5) + (_Q / _Q).pow(_T), f"pow(q, 1.5) + case when ({_div('q', 'q')}) = 1 then case when t is null then null else 1 end else pow({_div('q', 'q')}, t) end")
_finite = lambda f, x: f"case when isnan({x}) or isinf({x}) then 'nan'::double else {f}({x}) end"
_evaluated("exp_08", _T.sin() + _P.cos() + (_Q / 10).tan(), f"{_finite('sin', 't')} + {_finite('cos', 'p')} + {_finite('tan', '(q / 10)')}")
_evaluated("exp_09", _T.sqrt(), "case when t < 0 then 'nan'::double else sqrt(t) end")
_evaluated("exp_10", _P.square(), "p * p", 2)
_evaluated("exp_11", (_T / 500).exp(), "exp(t / 500)")
_evaluated("exp_12", _T.ln() + (_P - 40).log10(), f"({_log('ln', 't')}) + ({_log('log10', '(p - 40)')})")
_evaluated("exp_13", (_T - 50).abs(), "abs(t - 50)")
_evaluated("exp_16", _T * _Q.square() / (_Q + 1), f"({_div('(t * (q * q))', '(q + 1)')})", 2)
_evaluated("exp_18", _T.mapv(lambda s: s.clip(10, 60)), "case when isnan(t) then 'nan'::double when t is null then null else greatest(10, least(60, t)) end")


@plans.add("exp_14", f"with {EL}, v as (select etype, elem_id, pressure * 2 + 1 as v from el where dim = 3) select etype, elem_id, {sql_thousandths('v')} as value from v")
def exp_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component of a vector field."""
    both = Field.from_column(F.array("temperature", "pressure"), rank=1)
    out = whole(spark, sf_dir, ("temperature", "pressure")).eval((both * [1.0, 2.0] + 1)[1])
    return out.select("etype", "elem_id", thousandths(F.col("value")).alias("value"))


@plans.add(
    "exp_15",
    f"with {POINTS}, v as (select etype, elem_id, cx + 2 * cy as v from e2 left join c2 using (etype, elem_id) where dim = 2 union all select etype, elem_id, cx - cy + cz as v from e3 left join c3 using (etype, elem_id) where dim = 3) select etype, elem_id, {sql_thousandths('v')} as value from v",
)
def exp_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of centroids in expressions, in both spaces."""
    flat = space(spark, sf_dir, 2).eval(Field.x() + 2 * Field.y(), 2)
    deep = space(spark, sf_dir, 3).eval(Field.centroids()[0] - Field.y() + Field.z(), 3)
    return flat.unionByName(deep).select("etype", "elem_id", thousandths(F.col("value")).alias("value"))


@plans.add("exp_17", f"with {EL}, v as (select etype, elem_id, case when dim = 3 then pressure * quality + 1 end as v from el) select etype, elem_id, {sql_thousandths('v')} as value from v")
def exp_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = whole(spark, sf_dir, ("pressure", "quality")).with_field("energy", _P * _Q + 1, 3)
    return mesh.elements.select("etype", "elem_id", thousandths(F.col("energy")).alias("value"))


@plans.add(
    "exp_19",
    f"with {EL}, n as (select count(*) as n from el) select * from (values ('list by element', true), ('missing field', true), ('number indexed', true), ('scalar with vector', false)) c(test, refused), n",
)
def exp_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which expressions are refused when they are lowered, over all elements."""
    mesh = whole(spark, sf_dir, _ALL)
    rows = []
    for test, make in (("list by element", _T + [1.0, 2.0]), ("missing field", Field("none") + 1), ("number indexed", _T[0]), ("scalar with vector", Field.constant([1.0, 2.0]) * 2)):
        try:
            mesh.eval(make, 3)
            rows.append((test, False))
        except ValueError:
            rows.append((test, True))
    return spark.createDataFrame(rows, "test string, refused boolean").withColumn("n", F.lit(mesh.num_elements()).cast("long"))


@plans.add("exp_20", f"with {EL}, s as (select etype, count(*) as n, count(temperature) as t, count(pressure) as p from el group by etype) select etype, n, 1 as rank, t > 0 as has_temperature, p > 0 as has_pressure from s")
def exp_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of fields by type: a field is a column, so that there is nothing to convert."""
    mesh = whole(spark, sf_dir, ("temperature", "pressure"))
    return mesh.elements.groupBy("etype").agg(F.count("*").alias("n"), F.lit(1).alias("rank"), (F.count("temperature") > 0).alias("has_temperature"), (F.count("pressure") > 0).alias("has_pressure"))


# -- geometry ------------------------------------------------------------------------------


def _pt(k: int):
    return F.get("points", F.lit(k))


def _kernel(key: str, dim: int, etypes: tuple[str, ...], make, sql: str, kind: str = "number") -> None:
    """A query of a kernel over the points of elements of some types, and its SQL over lists xs, ys, zs."""
    names = ", ".join(f"'{t}'" for t in etypes)
    value = sql_thousandths("v") if kind == "number" else "v"
    text = f"with {POINTS}, v as (select e.etype, e.elem_id, {sql} as v from e{dim} e left join p{dim} using (etype, elem_id) where e.etype in ({names})) select etype, elem_id, {value} as value from v"

    @plans.add(key, text)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        mesh = space(spark, sf_dir, dim)
        rows = mesh.with_points(mesh.elements.where(F.col("etype").isin(list(etypes))))
        v = make()
        return rows.select("etype", "elem_id", (thousandths(v) if kind == "number" else v).alias("value"))


def _len(i: int, j: int, axes: str = "xyz") -> str:
    return "sqrt(" + " + ".join(f"({a}s[{i}] - {a}s[{j}]) * ({a}s[{i}] - {a}s[{j}])" for a in axes) + ")"


def sql_det(a: int, b: int, c: int, d: int) -> str:
    """Six times the signed volume of the tetrahedron of four places, from 0."""
    v = lambda q, n: f"({n}s[{q + 1}] - {n}s[{a + 1}])"
    x, y, z = (lambda q: v(q, "x")), (lambda q: v(q, "y")), (lambda q: v(q, "z"))
    return f"(({y(b)} * {z(c)} - {z(b)} * {y(c)}) * {x(d)} + ({z(b)} * {x(c)} - {x(b)} * {z(c)}) * {y(d)} + ({x(b)} * {y(c)} - {y(b)} * {x(c)}) * {z(d)})"


def sql_area3(a: int, b: int, c: int) -> str:
    v = lambda q, n: f"({n}s[{q + 1}] - {n}s[{a + 1}])"
    n = [f"({v(b, p)} * {v(c, q)} - {v(b, q)} * {v(c, p)})" for p, q in ("yz", "zx", "xy")]
    return "sqrt(" + " + ".join(f"{m} * {m}" for m in n) + ") / 2"


_kernel("geo_01", 3, ("SEG2",), lambda: g.distance(_pt(0), _pt(1), 3) + g.squared_distance(_pt(0), _pt(1), 3), f"{_len(1, 2)} + {_len(1, 2)} * {_len(1, 2)}")
_kernel("geo_02", 2, ("TRI3",), lambda: g.triangle_area_signed(_pt(0), _pt(1), _pt(2)), "((xs[2] - xs[1]) * (ys[3] - ys[1]) - (ys[2] - ys[1]) * (xs[3] - xs[1])) / 2")
_kernel("geo_03", 3, ("TRI3",), lambda: g.triangle_area(_pt(0), _pt(1), _pt(2), 3), sql_area3(0, 1, 2))
_kernel("geo_04", 2, ("QUAD4",), lambda: g.quad_area_signed(_pt(0), _pt(1), _pt(2), _pt(3)), "((xs[3] - xs[1]) * (ys[4] - ys[2]) - (ys[3] - ys[1]) * (xs[4] - xs[2])) / 2")
_kernel("geo_05", 3, ("TET4",), lambda: g.tetra_volume_signed(*[_pt(k) for k in range(4)]), f"{sql_det(0, 1, 2, 3)} / 6")
_CX, _CY = "list_sum(xs) / n", "list_sum(ys) / n"


def _edges(corners: str, test: str) -> str:
    """How many edges of the polygon, of ``corners`` corners, satisfy ``test`` over a and b (places from 1)."""
    t = test.replace("@a", "[i]").replace("@b", f"[i % {corners} + 1]").replace("@q", f"[i + {corners}]")
    return f"len(list_filter(range(1, {corners} + 1), lambda i: coalesce({t}, false)))"


def _ray(px: str, py: str) -> str:
    return f"((ys@a > {py}) <> (ys@b > {py})) and {px} < xs@a + ({py} - ys@a) / (ys@b - ys@a) * (xs@b - xs@a)"


def _known(sql: str) -> str:
    return f"case when len(list_filter(xs, lambda v: v is null)) = 0 and len(list_filter(ys, lambda v: v is null)) = 0 then {sql} end"


def _middle():
    c = g.centroid(F.col("points"), 2)
    return F.struct(c[0].alias("x"), c[1].alias("y"))


_kernel("geo_08", 2, ("PGON",), lambda: F.when(_middle()["x"].isNotNull() & _middle()["y"].isNotNull(), g.in_polygon(_middle()["x"], _middle()["y"], F.col("points"))), _known(f"{_edges('n', _ray(_CX, _CY))} % 2 = 1"), "flag")
_kernel("geo_14", 2, ("TRI3", "QUAD4"), lambda: F.when(_middle()["x"].isNotNull() & _middle()["y"].isNotNull(), g.in_polygon(_middle()["x"] + 0.3, _middle()["y"], F.col("points"))), _known(f"{_edges('n', _ray(f'({_CX} + 0.3)', _CY))} % 2 = 1"), "flag")


@plans.add("geo_06", f"with {EL} select node_id from n2 where x * 1 is not null and (x - 200) * (x - 200) + (y - 200) * (y - 200) < 14400 and not isnan(x) and not isnan(y) union all select node_id from n3 where (x - 150) * (x - 150) + (y - 120) * (y - 120) + (z - 3) * (z - 3) < 8100 and not isnan(x) and not isnan(y) and not isnan(z)")
def geo_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = space(spark, sf_dir, 2).nodes.where(g.in_ball([F.col("x"), F.col("y")], (200, 200), 120))
    deep = space(spark, sf_dir, 3).nodes.where(g.in_ball([F.col("x"), F.col("y"), F.col("z")], (150, 120, 3), 90))
    return flat.select("node_id").unionByName(deep.select("node_id"))


@plans.add("geo_07", f"with {EL} select node_id from n3 where x is not null and y is not null and z is not null and (isnan(x) or (x >= 70 and x < 400)) and (isnan(y) or (y >= 60 and y < 250)) and (isnan(z) or (z >= 1 and z < 5.5))")
def geo_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space(spark, sf_dir, 3).nodes.where(g.in_box([F.col("x"), F.col("y"), F.col("z")], (70, 60, 1), (400, 250, 5.5))).select("node_id")


# Curved polygons: triangles of six nodes, whose last three lie on the edges, pushed out so that edges bend.
_PUSH = 1.25


def _curved(rows: DataFrame) -> DataFrame:
    """With m, the middle, bent, the triangle, and p, a point just outside of a straight edge, inside of the bent one."""
    rows = rows.withColumn("m", _middle())
    push = lambda p, by: F.struct(*[(F.col("m")[a] + (p[a] - F.col("m")[a]) * by).alias(a) for a in "xy"])
    bent = F.transform("points", lambda p, i: F.when(i < 3, p).otherwise(push(p, _PUSH)))
    return rows.select("etype", "elem_id", bent.alias("bent"), push(_pt(3), 1.05).alias("p"))


_BENT = f"""{POINTS}, m as (select etype, elem_id, xs, ys, {_CX} as mx, {_CY} as my from p2 where etype = 'TRI6' and len(list_filter(xs, lambda v: v is null)) = 0 and len(list_filter(ys, lambda v: v is null)) = 0),
    w as (select etype, elem_id, mx + (xs[4] - mx) * 1.05 as px, my + (ys[4] - my) * 1.05 as py, unnest([xs[1], xs[2], xs[3]]) as ax, unnest([ys[1], ys[2], ys[3]]) as ay,
        unnest([xs[2], xs[3], xs[1]]) as bx, unnest([ys[2], ys[3], ys[1]]) as by_, mx + (unnest([xs[4], xs[5], xs[6]]) - mx) * {_PUSH} as qx, my + (unnest([ys[4], ys[5], ys[6]]) - my) * {_PUSH} as qy from m),
    s as (select *, (bx - ax) * (py - ay) - (by_ - ay) * (px - ax) as sp, (bx - ax) * (qy - ay) - (by_ - ay) * (qx - ax) as sq,
        case when (ay > py) <> (by_ > py) then px < ax + (py - ay) / (by_ - ay) * (bx - ax) else false end as ray from w),"""
_CURVED_SQL = "select etype, elem_id, value from (select etype, elem_id, (count(*) filter (where ray) + count(*) filter (where piece)) % 2 = 1 as value from k group by etype, elem_id) union all select etype, elem_id, null from e2 where etype = 'TRI6' and elem_id not in (select elem_id from m)"


def _triangles(spark: SparkSession, sf_dir: str, test) -> DataFrame:
    mesh = space(spark, sf_dir, 2)
    p = F.col("p")
    value = F.when(p["x"].isNotNull() & p["y"].isNotNull(), test(p["x"], p["y"], F.col("bent")))
    return _curved(mesh.with_points(mesh.block("TRI6"))).select("etype", "elem_id", value.alias("value"))


@plans.add(
    "geo_09",
    f"""with {_BENT}
    o as (select *, 2 * ((qx - ax) * (by_ - ay) - (qy - ay) * (bx - ax)) as d, (qx - ax) * (qx - ax) + (qy - ay) * (qy - ay) as qq, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) as bb from s),
    r as (select *, ((by_ - ay) * qq - (qy - ay) * bb) / d as ux, ((qx - ax) * bb - (bx - ax) * qq) / d as uy from o),
    k as (select *, abs(d) >= 1e-14 and (px - ax - ux) * (px - ax - ux) + (py - ay - uy) * (py - ay - uy) < ux * ux + uy * uy and sp * sq > 0 as piece from r)
    {_CURVED_SQL}""",
)
def geo_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points near the bent edges of triangles, with edges as arcs of circles."""
    return _triangles(spark, sf_dir, g.in_arc_polygon)


@plans.add(
    "geo_10",
    f"""with {_BENT}
    o as (select *, sp / sq as v, ((qx - bx) * (py - by_) - (qy - by_) * (px - bx)) / sq as u from s),
    k as (select *, sq <> 0 and v > 0 and v * v < 4 * u * (1 - u - v) as piece from o)
    {_CURVED_SQL}""",
)
def geo_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with edges as Bezier curves."""
    return _triangles(spark, sf_dir, g.in_bezier_polygon)


@plans.add(
    "geo_11",
    f"""with {POINTS}, ok as (select etype, elem_id from p3 where etype = 'HEX8' and len(list_filter(xs, lambda v: v is null or isnan(v))) + len(list_filter(ys, lambda v: v is null or isnan(v))) + len(list_filter(zs, lambda v: v is null or isnan(v))) = 0)
    select elem_id, true as middle, false as beyond from ok""",
)
def geo_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each hexahedron lies in its six faces, a point beyond a corner does not."""
    from meshloom.etypes import SUBENTITIES, places

    mesh = space(spark, sf_dir, 3)
    rows = mesh.with_points(mesh.block("HEX8")).where(F.col("points").isNotNull() & F.forall("points", lambda p: (p["x"] + p["y"] + p["z"]).isNotNull() & ~F.isnan(p["x"] + p["y"] + p["z"])))
    c = g.centroid(F.col("points"), 3)
    faces = F.array(*[F.array(*[_pt(k) for k in place]) for place in places(SUBENTITIES[("HEX8", 1)][1])])
    inner = F.struct(*[v.alias(a) for v, a in zip(c, g.AXES)])
    outer = F.struct(*[(_pt(0)[a] + (_pt(0)[a] - v) * 0.5).alias(a) for v, a in zip(c, g.AXES)])
    return rows.select("elem_id", faces.alias("f"), inner.alias("m"), outer.alias("o")).select("elem_id", g.in_polyhedron(F.col("m"), F.col("f")).alias("middle"), g.in_polyhedron(F.col("o"), F.col("f")).alias("beyond"))


@plans.add(
    "geo_12",
    f"""with {POINTS}, k as (select elem_id, xs, ys from p2 where etype = 'QUAD4' and len(list_filter(xs, lambda v: v is null or isnan(v))) + len(list_filter(ys, lambda v: v is null or isnan(v))) = 0),
    d as (select *, xs[3] - xs[1] as v1x, ys[3] - ys[1] as v1y, xs[4] - xs[2] as v2x, ys[4] - ys[2] as v2y from k),
    t as (select *, ((xs[2] - xs[1]) * v2y - (ys[2] - ys[1]) * v2x) / (v1x * v2y - v1y * v2x) as t, ((xs[2] - xs[1]) * v1y - (ys[2] - ys[1]) * v1x) / (v1x * v2y - v1y * v2x) as u from d)
    select elem_id, case when t between 0 and 1 and u between 0 and 1 then 'new' else 'none' end as diagonals,
        case when t between 0 and 1 and u between 0 and 1 then floor((xs[1] + t * v1x) * 1000 + 0.1237)::bigint::varchar end as x, 'end2' as adjacent, 'overlap14' as along from t""",
)
def geo_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagonals of each quadrangle, two adjacent edges, and an edge (moved to the origin) against a piece of its line from before its start to its middle."""
    mesh = space(spark, sf_dir, 2)
    ok = F.forall("points", lambda p: (p["x"] + p["y"]).isNotNull() & ~F.isnan(p["x"] + p["y"]))
    rows = mesh.with_points(mesh.block("QUAD4")).where(F.col("points").isNotNull() & ok)
    at = lambda f: F.struct((f * (_pt(1)["x"] - _pt(0)["x"])).alias("x"), (f * (_pt(1)["y"] - _pt(0)["y"])).alias("y"))
    crossed, beside = g.segment_intersection(_pt(0), _pt(2), _pt(1), _pt(3)), g.segment_intersection(_pt(0), _pt(1), _pt(1), _pt(2))
    cut = rows.select("elem_id", crossed.alias("d"), beside.alias("a"), g.segment_intersection(at(F.lit(0.0)), at(F.lit(1.0)), at(F.lit(-1.0)), at(F.lit(0.5))).alias("o"))
    return cut.select("elem_id", F.col("d.kind").alias("diagonals"), thousandths(F.col("d.x")).alias("x"), F.concat("a.kind", F.col("a.a").cast("string")).alias("adjacent"), F.concat("o.kind", F.col("o.a").cast("string"), F.col("o.b").cast("string")).alias("along"))


_kernel(
    "geo_13",
    2,
    ("SEG2",),
    lambda: g.on_segment(F.struct(((_pt(0)["x"] + _pt(1)["x"]) / 2).alias("x"), ((_pt(0)["y"] + _pt(1)["y"]) / 2).alias("y")), _pt(0), _pt(1), 1e-9) & ~g.on_segment(F.struct(_pt(0)["x"].alias("x"), (_pt(0)["y"] + 1).alias("y")), _pt(0), _pt(1), 1e-9),
    "case when xs[1] is not null and xs[2] is not null and ys[1] is not null and ys[2] is not null then not isnan(xs[1] + xs[2] + ys[1] + ys[2]) and not (abs(xs[2] - xs[1]) <= 1e-9 * greatest(abs(xs[2] - xs[1]), abs(ys[2] - ys[1]), 1) * greatest(abs(xs[2] - xs[1]), abs(ys[2] - ys[1]), 1) and ys[2] - ys[1] >= 0 and ys[2] - ys[1] <= (xs[2] - xs[1]) * (xs[2] - xs[1]) + (ys[2] - ys[1]) * (ys[2] - ys[1])) end",
    "flag",
)


@plans.add("geo_15", f"with {EL} select distinct least(conn[1], conn[2]) as node_a, greatest(conn[1], conn[2]) as node_b from el where etype = 'SEG2'")
def geo_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without direction, each once."""
    seg = whole(spark, sf_dir).block("SEG2").select(g.undirected_edge(F.col("conn")[0], F.col("conn")[1]).alias("e")).distinct()
    return seg.select(F.col("e.from").alias("node_a"), F.col("e.to").alias("node_b"))


QUERIES, SQL = plans.QUERIES, plans.SQL
