"""Queries of joins, topology, aggregations and changes of geometry, over the whole mesh tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.etypes import SIMPLEXES, places
from meshloom.functions import selection as sel
from meshloom.mesh import Mesh
from meshloom.operators import extrude as ex
from meshloom.operators import graph, spatial, topology
from meshloom.operators.nearby import finite, near_pairs
from meshloom.plans.computing import sql_area3, sql_det
from meshloom.plans.tables import EL, POINTS, Plans, joined, space, sql_subs, sql_thousandths, thousandths, whole
from meshloom.runtime import table

plans = Plans()
#: The distance at which nodes are near each other.
NEAR = 0.01


def _conn(mesh: Mesh) -> DataFrame:
    return mesh.elements.select("etype", "elem_id", joined(F.col("conn")).alias("nodes"))


# -- sub-entities -------------------------------------------------------------------------


@plans.add("agg_01", f"with {EL}, {sql_subs(1, 3)}, {sql_subs(1, 2, name='sub2')}, {sql_subs(1, 1, name='sub1')}, a as (select * from sub union all select * from sub2 union all select * from sub1) select etype, elem_id, pos::int as pos, sub_etype, array_to_string(sub_conn, ',') as nodes from a")
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of solids, edges of faces, ends of edges."""
    mesh = whole(spark, sf_dir)
    parts = [topology.subentities(mesh, d).select("etype", "elem_id", "pos", "sub_etype", joined(F.col("sub_conn")).alias("nodes")) for d in (3, 2, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _owned(codim: int, dim: int, having: str = "true") -> str:
    """CTE own: distinct sub-entities with their first occurrence and number of owners, numbered in their type."""
    return f"""{EL}, {sql_subs(codim, dim)},
    own as (select list_sort(sub_conn) as s, count(*) as n, min((etype_ord, elem_id, pos)) as f, arg_min(sub_conn, (etype_ord, elem_id, pos)) as conn, arg_min(sub_etype, (etype_ord, elem_id, pos)) as sub_etype
        from sub group by list_sort(sub_conn) having {having}),
    num as (select *, row_number() over (partition by sub_etype order by f) - 1 as id from own)"""


_NUM = "select sub_etype as etype, id as elem_id, array_to_string(conn, ',') as nodes from num"


@plans.add("agg_02", f"with {_owned(1, 2)} {_NUM}")
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all plane elements."""
    return _conn(topology.descend(whole(spark, sf_dir), 2))


@plans.add("agg_03", f"with {_owned(1, 3)}, k as (select 'kept' as side, etype, elem_id, array_to_string(conn, ',') as nodes from el where dim <> 2 union all select 'kept', sub_etype, id, array_to_string(conn, ',') from num union all select 'replaced', etype, elem_id, array_to_string(conn, ',') from el where dim = 2) select * from k")
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of solids in place of all elements of dimension 2."""
    kept, replaced = topology.descend_update(whole(spark, sf_dir), 3)
    return _conn(kept).withColumn("side", F.lit("kept")).unionByName(_conn(replaced).withColumn("side", F.lit("replaced")))


@plans.add("agg_04", f"with {_owned(1, 3, 'count(*) = 2')} {_NUM}")
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces between exactly two solids."""
    return _conn(topology.with_n_neighbours(whole(spark, sf_dir), 2))


@plans.add("agg_05", f"with {_owned(1, 3, 'count(*) = 1')} {_NUM}")
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conn(topology.boundaries(whole(spark, sf_dir)))


@plans.add("agg_05_edges", f"with {_owned(2, 3, 'count(*) = 1')} {_NUM}")
def agg_05_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a single solid."""
    return _conn(topology.boundaries(whole(spark, sf_dir), 3, 1))


@plans.add("agg_06", f"with {_owned(1, 2, 'count(*) = 1')}, k as (select etype, elem_id, array_to_string(conn, ',') as nodes from el where dim <> 1 union all {_NUM}) select * from k")
def agg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conn(topology.boundaries_update(whole(spark, sf_dir), 2)[0])


@plans.add("agg_07", f"with {_owned(2, 2)} select distinct num.sub_etype, num.id as sub_id, sub.etype, sub.elem_id from sub join num on list_sort(sub.sub_conn) = num.s")
def agg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of plane elements, each with its elements."""
    return topology.incidence(whole(spark, sf_dir), 2, 0)[1]


@plans.add("agg_08", f"with {EL}, {sql_subs(1, 3)} select distinct array_to_string(list_sort(sub_conn), ',') as nodes, etype, elem_id from sub")
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.incidence_by_nodes(whole(spark, sf_dir)).select(joined(F.col("node_set")).alias("nodes"), "etype", "elem_id")


_PAIRS = "k as (select distinct list_sort(sub_conn) as s, etype_ord, etype, elem_id from sub), pr as (select a.s, a.etype as src_etype, a.elem_id as src_id, b.etype as dst_etype, b.elem_id as dst_id from k a join k b on a.s = b.s and (a.etype_ord, a.elem_id) < (b.etype_ord, b.elem_id))"


@plans.add("agg_09", f"with {_owned(1, 3)}, {_PAIRS} select src_etype, src_id, dst_etype, dst_id, min(num.id) as via from pr join num using (s) group by all")
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solids that share a face, and the smallest id of such a face."""
    return graph.neighbours(whole(spark, sf_dir))[1]


@plans.add("agg_10", f"with {EL}, {sql_subs(1, 2)}, {_PAIRS} select src_etype, src_id, dst_etype, dst_id, array_to_string(min(s), ',') as via from pr group by all")
def agg_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane elements that share an edge, and its nodes."""
    return graph.neighbours_by_nodes(whole(spark, sf_dir), 2).withColumn("via", joined(F.col("via")))


@plans.add("agg_11", f"with {EL}, {sql_subs(2, 3)}, {_PAIRS} select distinct src_etype, src_id, dst_etype, dst_id from pr")
def agg_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solids that share an edge, without saying which."""
    return graph.neighbour_pairs(whole(spark, sf_dir), 3, 1)


@plans.add(
    "agg_12",
    f"""with recursive {EL}, {sql_subs(1, 3)}, k as (select distinct list_sort(sub_conn) as s, etype_ord::bigint * 1000000000000 + elem_id as v from sub), h as (select s, min(v) as u from k group by s),
    m as (select distinct h.u, k.v from k join h using (s) where h.u <> k.v), e as (select u as a, v as b from m union select v, u from m),
    r as (select v, v as seen from (select distinct v from k) union select r.v, e.b from r join e on r.seen = e.a),
    g as (select v, min(seen) as root from r group by v)
    select a.etype, a.elem_id, c.etype as component_etype, c.elem_id as component_id from g join el a on g.v = a.etype_ord::bigint * 1000000000000 + a.elem_id join el c on g.root = c.etype_ord::bigint * 1000000000000 + c.elem_id""",
)
def agg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solids linked through faces."""
    return graph.connected_components(whole(spark, sf_dir))


@plans.add(
    "agg_13",
    f"""with {EL}, t as (select distinct elem_id, etype, unnest(conn) as node_id from el where dim = 3),
    d as (select node_id, count(*) as n from t group by node_id)
    select 'nodes' as what, (select count(*) from (select distinct node_id from nd)) + (select sum(n - 1)::bigint from d where node_id in (select node_id from nd)) as n
    union all select 'elements', count(*) from el union all select 'shared', 0""",
)
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut along all faces, every solid has nodes of its own."""
    mesh = whole(spark, sf_dir)
    out = graph.crack(mesh, topology.descend(mesh), check=False)
    used = out.of_dim(3).select("etype", "elem_id", F.explode("conn").alias("node_id")).distinct().groupBy("node_id").agg(F.count("*").alias("n"))
    count = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count("nodes", out.nodes).unionByName(count("elements", out.elements)).unionByName(count("shared", used.where("n > 1")))


# -- measures -------------------------------------------------------------------------------


def _sum_abs(name: str) -> str:
    return "(" + " + ".join(f"abs({sql_det(*p)} / 6)" for p in places(SIMPLEXES[name][1])) + ")"


_SHOELACE = "abs(list_sum(list_transform(range(1, n + 1), lambda i: xs[i] * ys[i % n + 1] - xs[i % n + 1] * ys[i])) / 2)"
_M2 = f"case etype when 'VERTEX' then 0 when 'SEG2' then sqrt((xs[1] - xs[2]) * (xs[1] - xs[2]) + (ys[1] - ys[2]) * (ys[1] - ys[2])) when 'TRI3' then abs(((xs[2] - xs[1]) * (ys[3] - ys[1]) - (ys[2] - ys[1]) * (xs[3] - xs[1])) / 2) when 'QUAD4' then abs(((xs[3] - xs[1]) * (ys[4] - ys[2]) - (ys[3] - ys[1]) * (xs[4] - xs[2])) / 2) when 'PGON' then {_SHOELACE} end"
_M3 = f"case etype when 'TET4' then {_sum_abs('TET4')} when 'HEX8' then {_sum_abs('HEX8')} end"


_FULL2 = "len(list_filter(xs, lambda v: v is null)) + len(list_filter(ys, lambda v: v is null)) = 0"


@plans.add(
    "agg_14",
    f"""with {POINTS}, v as (select e.etype, elem_id, case when e.etype = 'VERTEX' or {_FULL2} then {_M2.replace('case etype', 'case e.etype')} end as v from e2 e left join p2 using (etype, elem_id) where e.dim = 2
    union all select e.etype, elem_id, {_M3.replace('case etype', 'case e.etype')} as v from e3 e left join p3 using (etype, elem_id) where e.dim = 3
    union all select e.etype, elem_id, case when e.etype = 'TRI3' then {sql_area3(0, 1, 2)} when e.etype = 'QUAD4' then ({sql_area3(0, 1, 2)}) + ({sql_area3(0, 2, 3)}) end from e3 e left join p3 using (etype, elem_id) where e.dim = 2)
    select etype, elem_id, {sql_thousandths('v')} as value from v""",
)
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas in the plane, volumes in space, and areas in space."""
    flat, deep = space(spark, sf_dir, 2), space(spark, sf_dir, 3)
    out = spatial.measure_update(flat, "Measure", 2).field("Measure", 2)
    out = (spatial.measure(flat, 2) if out is None else out).unionByName(spatial.measure(deep, 3)).unionByName(spatial.measure(deep, 2))
    return out.select("etype", "elem_id", thousandths(F.col("value")).alias("value"))


@plans.add("agg_15", f"with {POINTS} select etype, elem_id, {sql_thousandths('cx')} as x, {sql_thousandths('cy')} as y, {sql_thousandths('cz')} as z from e3 left join c3 using (etype, elem_id)")
def agg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.centroids(space(spark, sf_dir, 3)).select("etype", "elem_id", *[thousandths(F.col(a)).alias(a) for a in "xyz"])


@plans.add(
    "agg_16",
    f"with {POINTS} select etype, elem_id, {', '.join(sql_thousandths(f'list_{m}({a}s)') + f' as {a}_{m}' for m in ('min', 'max') for a in 'xyz')} from e3 left join p3 using (etype, elem_id)",
)
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bounding_boxes(space(spark, sf_dir, 3)).select("etype", "elem_id", *[thousandths(F.col(f"{a}_{m}")).alias(f"{a}_{m}") for m in ("min", "max") for a in "xyz"])


_CUT = ("SEG2", "SEG3", "TRI3", "TRI6", "QUAD4", "TET4", "HEX8")


@plans.add(
    "agg_17",
    f"with {EL} "
    + " union all ".join(
        f"select etype, elem_id, unnest(range({len(places(p))}))::int as pos, '{s}' as simplex, array_to_string(unnest([{', '.join('[' + ', '.join(f'conn[{k + 1}]' for k in c) + ']' for c in places(p))}]), ',') as nodes from el where etype = '{t}'"
        for t, (s, p) in SIMPLEXES.items()
        if t in _CUT
    ),
)
def agg_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = whole(spark, sf_dir).select(sel.types(*_CUT))
    return topology.simplexes(mesh).select("etype", "elem_id", "pos", "simplex", joined(F.col("conn")).alias("nodes"))


# Nodes in space that an element uses, with cells of their own size, for SQL's near pairs.
_NEAR = f"""{EL}, us as (select node_id, x, y, z, floor(x / 0.08) as kx, floor(y / 0.08) as ky from n3 where node_id in (select unnest(conn) from e3) and isfinite(x) and isfinite(y) and isfinite(z)),
    of as (select unnest([-1, 0, 1]) as o), d as (select p.o as dx, q.o as dy from of p, of q),
    pr as (select a.node_id as id_a, b.node_id as id_b from us a, d, us b where a.kx + dx = b.kx and a.ky + dy = b.ky and a.node_id < b.node_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.01::double * 0.01::double)"""
_LINKED = f"""with recursive {_NEAR}, e as (select id_a as a, id_b as b from pr union select id_b, id_a from pr), r as (select distinct a as v, a as seen from e union select r.v, e.b from r join e on r.seen = e.a), g as (select v as node_id, min(seen) as kept_id from r group by v)"""


@plans.add("agg_18", f"{_LINKED} select node_id, kept_id from g")
def agg_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near nodes, chains included."""
    return spatial.duplicates(space(spark, sf_dir, 3), NEAR, strategy="component")


@plans.add(
    "agg_18_greedy",
    f"""with recursive {_NEAR}, sm as (select id_b as node_id, list(id_a) as smaller from pr group by id_b), al as (select id_a as node_id from pr union select id_b from pr),
    od as (select node_id, coalesce(smaller, []::bigint[]) as smaller, row_number() over (order by node_id) as k from al left join sm using (node_id)),
    st as (select 0::bigint as k, []::bigint[] as kept union all select od.k, case when list_has_any(st.kept, od.smaller) then st.kept else list_append(st.kept, od.node_id) end from st join od on od.k = st.k + 1),
    la as (select kept from st order by k desc limit 1),
    g as (select node_id, case when list_contains(kept, node_id) then node_id else list_min(list_filter(smaller, lambda i: list_contains(kept, i))) end as kept_id from od, la)
    select node_id, kept_id from g where kept_id in (select kept_id from g where kept_id <> node_id)""",
)
def agg_18_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.duplicates(space(spark, sf_dir, 3), NEAR)


# -- joins -----------------------------------------------------------------------------------


@plans.add("jon_01", f"with {POINTS} select etype, elem_id, case when n is null then null else n end::int as n_points, {sql_thousandths('xs[n] + ys[1]')} as value from e2 left join p2 using (etype, elem_id)")
def jon_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each element, in order."""
    rows = space(spark, sf_dir, 2).with_points()
    n = F.when(F.col("points").isNotNull(), F.size("points"))
    return rows.select("etype", "elem_id", n.alias("n_points"), thousandths(F.get("points", n - 1)["x"] + F.get("points", F.lit(0))["y"]).alias("value"))


@plans.add("jon_02", f"with {EL}, f as (select dim, list_sort(conn) as s, arg_min(etype, (etype_ord, elem_id)) as found_etype, arg_min(elem_id, (etype_ord, elem_id)) as found_id from el group by dim, list_sort(conn)) select etype, elem_id, found_etype, found_id from el join f on el.dim = f.dim and list_sort(el.conn) = f.s where el.dim = 2")
def jon_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first element with the nodes of each plane element."""
    mesh = whole(spark, sf_dir)
    return graph.find_equals(mesh, mesh.select(sel.dims(2)))


@plans.add("jon_03", f"with {EL}, {sql_subs(1, 2)}, {_PAIRS} select distinct src_etype, src_id, dst_etype, dst_id from pr")
def jon_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbour_pairs(whole(spark, sf_dir), 2)


@plans.add("jon_04", f"with {_NEAR} select id_a, id_b from pr")
def jon_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = space(spark, sf_dir, 3)
    return near_pairs(mesh.nodes.join(mesh.used_nodes(), "node_id", "left_semi"), NEAR, scope=None).select("id_a", "id_b")


def _shifted(mesh: Mesh) -> Mesh:
    """The same mesh a little aside, with ids of its own."""
    return Mesh(mesh.nodes.withColumn("x", F.col("x") + 0.004), mesh.elements, mesh.groups)


_SNAP = f"""{_NEAR}, al as (select a.node_id, b.node_id as ref_id, (a.x - (b.x + 0.004)) * (a.x - (b.x + 0.004)) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2, b.x + 0.004 as rx, b.y as ry, b.z as rz
        from us a, d, us b where a.kx + dx = b.kx and a.ky + dy = b.ky),
    sn as (select node_id, arg_min(ref_id, (d2, ref_id)) as ref_id, arg_min(rx, (d2, ref_id)) as rx, arg_min(ry, (d2, ref_id)) as ry, arg_min(rz, (d2, ref_id)) as rz from al where d2 <= 0.01::double * 0.01::double group by node_id)"""


@plans.add("jon_05", f"with {_SNAP} select node_id, ref_id from sn")
def jon_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = space(spark, sf_dir, 3)
    return spatial.snap_pairs(mesh, _shifted(mesh), NEAR).select("node_id", "ref_id")


@plans.add("jon_06", f"with {EL} select etype, elem_id, array_to_string(conn, ',') as nodes from el where elem_id in (select o_orderkey from orders)")
def jon_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of any type whose id is that of an order."""
    mesh = whole(spark, sf_dir)
    ids = mesh.elements.select("etype", "elem_id").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("elem_id")), "elem_id", "left_semi")
    return _conn(mesh.extract(ids))


@plans.add("jon_07", f"with {EL} select distinct unnest(conn) as node_id, etype, elem_id from el")
def jon_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_to_elements(whole(spark, sf_dir))


@plans.add("jon_08", f"with {EL}, v as (select distinct unnest(conn) as v from el where (etype, family) in (select (etype, family) from mesh_groups where group_name = 'core')) select conn[1] as a, conn[2] as b from el where etype = 'SEG2' and conn[1] in (select v from v) and conn[2] in (select v from v)")
def jon_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with both ends among the nodes of group core."""
    mesh = whole(spark, sf_dir)
    edges = mesh.block("SEG2").select(F.col("conn")[0].alias("a"), F.col("conn")[1].alias("b"))
    return graph.induced_edges(edges, mesh.select(sel.group("core")).used_nodes().withColumnRenamed("node_id", "v"))


@plans.add(
    "jon_09",
    f"""with {POINTS}, s as (select elem_id, xs[1] as ax, ys[1] as ay, xs[2] as bx, ys[2] as by_ from p2 where etype = 'SEG2' and isfinite(xs[1]) and isfinite(xs[2]) and isfinite(ys[1]) and isfinite(ys[2])),
    q as (select a.elem_id as id_a, b.elem_id as id_b, a.ax, a.ay, a.bx as cx, a.by_ as cy, b.ax as ex, b.ay as ey, b.bx as fx, b.by_ as fy, a.bx - a.ax as ux, a.by_ - a.ay as uy, b.bx - b.ax as vx, b.by_ - b.ay as vy, b.ax - a.ax as wx, b.ay - a.ay as wy
        from s a join s b on a.elem_id < b.elem_id and least(a.ax, a.bx) <= greatest(b.ax, b.bx) and least(b.ax, b.bx) <= greatest(a.ax, a.bx) and least(a.ay, a.by_) <= greatest(b.ay, b.by_) and least(b.ay, b.by_) <= greatest(a.ay, a.by_)),
    o as (select *, ux * vy - uy * vx as d, 64 * pow(2::double, -52) * greatest(abs(ux), abs(uy), abs(vx), abs(vy), 1) as eps from q),
    t as (select *, (wx * vy - wy * vx) / d as t, (wx * uy - wy * ux) / d as u from o where abs(d) >= eps and ux * ux + uy * uy >= eps and vx * vx + vy * vy >= eps),
    m as (select *, ax + t * ux as mx, ay + t * uy as my from t where t between 0 and 1 and u between 0 and 1)
    select id_a, id_b from m where (ax - mx) * (ax - mx) + (ay - my) * (ay - my) >= eps and (cx - mx) * (cx - mx) + (cy - my) * (cy - my) >= eps
        and (ex - mx) * (ex - mx) + (ey - my) * (ey - my) >= eps and (fx - mx) * (fx - mx) + (fy - my) * (fy - my) >= eps""",
)
def jon_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in the plane that cross in a point of neither's ends."""
    return spatial.segment_crossings(space(spark, sf_dir, 2)).where("kind = 'new'").select("id_a", "id_b")


# -- changes of geometry -----------------------------------------------------------------------


@plans.add("gtr_01", f"with {_SNAP} select n3.node_id, {sql_thousandths('coalesce(rx, x)')} as x, {sql_thousandths('coalesce(ry, y)')} as y, {sql_thousandths('coalesce(rz, z)')} as z from n3 left join sn using (node_id)")
def gtr_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = space(spark, sf_dir, 3)
    return spatial.snap(mesh, _shifted(mesh), NEAR).nodes.select("node_id", *[thousandths(F.col(a)).alias(a) for a in "xyz"])


@plans.add("gtr_02", f"{_LINKED}, u as (select etype, elem_id, unnest(conn) as node_id, generate_subscripts(conn, 1) as i from e3) select etype, elem_id, string_agg(coalesce(kept_id, node_id)::varchar, ',' order by i) as nodes from u left join g using (node_id) group by etype, elem_id")
def gtr_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conn(spatial.merge_nodes(space(spark, sf_dir, 3), NEAR, strategy="component"))


_PLAIN = ("VERTEX", "SEG2", "QUAD4")
_EXTRUDED = f"""{EL}, st as (select etype, max(elem_id) + 1 as stride from e2 where etype in ('VERTEX', 'SEG2', 'QUAD4') group by etype), mx as (select max(node_id) + 1 as step from n2),
    ly as (select unnest(range(2)) as k), xt as (select case etype when 'VERTEX' then 'SEG2' when 'SEG2' then 'QUAD4' else 'HEX8' end as etype, elem_id + k * stride as elem_id,
        list_transform(conn, lambda c: c + k * step) || case when etype = 'SEG2' then list_reverse(list_transform(conn, lambda c: c + (k + 1) * step)) else list_transform(conn, lambda c: c + (k + 1) * step) end as conn
        from (select * from e2 join st using (etype), mx, ly))"""


@plans.add("gtr_03", f"with {_EXTRUDED} select etype, elem_id, array_to_string(conn, ',') as nodes from xt")
def gtr_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conn(ex.extrude(space(spark, sf_dir, 2).select(sel.types(*_PLAIN)), [0.0, 1.5, 2.0]))


_LINE = [(5.0, 7.0, 1.0), (5.5, 7.0, 2.0), (6.5, 6.0, 4.0)]


@plans.add("gtr_04", f"with {EL}, mx as (select max(node_id) + 1 as step from n2), pl(k, ox, oy, oz) as (values (0, 0.0, 0.0, 1.0), (1, 0.5, 0.0, 2.0), (2, 1.5, -1.0, 4.0)), v as (select node_id + k * step as node_id, x + ox as x, y + oy as y, oz::double as z from n2, mx, pl) select node_id, {sql_thousandths('x')} as x, {sql_thousandths('y')} as y, {sql_thousandths('z')} as z from v")
def gtr_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = ex.extrude_parallel(space(spark, sf_dir, 2).select(sel.types(*_PLAIN)), _LINE)
    return mesh.nodes.select("node_id", *[thousandths(F.col(a)).alias(a) for a in "xyz"])


_S = "sqrt(0.5::double)"


@plans.add(
    "gtr_05",
    f"""with {EL}, f as (select * from n2 where isfinite(x) and isfinite(y)), mx as (select max(node_id) + 1 as step, avg(x) as mx from f),
    v as (select node_id + k * step as node_id, x, y, k, mx from f, mx, (select unnest(range(3)) as k)),
    w as (select node_id, case k when 0 then x when 1 then mx + (x - mx) * {_S} else mx + 1 end as x, y, case k when 0 then 0 when 1 then 1 - (x - mx) * {_S} else 1 - (x - mx) end as z from v)
    select node_id, {sql_thousandths('x')} as x, {sql_thousandths('y')} as y, {sql_thousandths('z')} as z from w""",
)
def gtr_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes that turn from upright to lying, around a corner."""
    mesh = space(spark, sf_dir, 2)
    ok = Mesh(mesh.nodes.where(finite(F.col("x"), F.col("y"))), mesh.elements, mesh.groups).select(sel.types(*_PLAIN))
    out = ex.extrude_curv(ok, [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 1.0)])
    return out.nodes.select("node_id", *[thousandths(F.col(a)).alias(a) for a in "xyz"])


QUERIES, SQL = plans.QUERIES, plans.SQL
