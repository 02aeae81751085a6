"""Queries of the selection language and of id sets, over the whole mesh tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import selection as sel
from meshloom.functions.fields import Field
from meshloom.mesh import Mesh
from meshloom.operators import sets
from meshloom.plans.tables import EL, POINTS, Plans, space, whole

plans = Plans()

LO2, HI2, C2, R2 = (90.0, 90.0), (300.0, 310.0), (200.0, 200.0), 120.0
LO3, HI3, C3, R3 = (70.0, 60.0, 1.0), (400.0, 250.0, 5.5), (150.0, 120.0, 3.0), 90.0


def _chosen(key: str, make: sel.Selection, sql: str, dim: int | None = None, fields: tuple[str, ...] = ()) -> None:
    """A query that selects by ``make``, and its SQL: a condition over rows e, in ``dim`` dimensions with c, the centroids, and p, the coordinates."""
    if dim is None:
        text = f"with {EL} select etype, elem_id from el e where coalesce({sql}, false)"
    else:
        text = f"with {POINTS} select e.etype, e.elem_id from e{dim} e left join c{dim} c using (etype, elem_id) left join p{dim} p using (etype, elem_id) where coalesce({sql}, false)"

    @plans.add(key, text)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        mesh = whole(spark, sf_dir, fields) if dim is None else space(spark, sf_dir, dim, fields)
        return mesh.select_ids(make)


def _in_box(names: list[str], lo, hi) -> str:
    known = " and ".join(f"{n} is not null" for n in names)
    inside = " and ".join(f"(isnan({n}) or ({n} >= {a} and {n} < {b}))" for n, a, b in zip(names, lo, hi))
    return f"({known} and {inside})"


def _in_ball(names: list[str], c, r) -> str:
    d2 = " + ".join(f"({n} - {a}) * ({n} - {a})" for n, a in zip(names, c))
    return f"(not isnan({d2}) and {d2} < {r * r})"


def _nodes(test: str, every: bool) -> str:
    n = f"len(list_filter(range(1, p.n + 1), lambda i: coalesce({test}, false)))"
    return f"{n} = p.n" if every else f"{n} > 0"


_X2, _X3 = ["c.cx", "c.cy"], ["c.cx", "c.cy", "c.cz"]
_N2, _N3 = ["p.xs[i]", "p.ys[i]"], ["p.xs[i]", "p.ys[i]", "p.zs[i]"]

_chosen("sel_01", sel.types("TRI3", "PGON", "SEG2"), "etype in ('TRI3', 'PGON', 'SEG2')")
_chosen("sel_02", sel.dims(1, 3), "dim in (1, 3)")
_chosen("sel_04", sel.bbox(LO3, HI3), _in_box(_X3, LO3, HI3), 3)
_chosen("sel_05", sel.rect(LO2, HI2), _in_box(_X2, LO2, HI2), 2)
_chosen("sel_06", sel.sphere(C3, R3), _in_ball(_X3, C3, R3), 3)
_chosen("sel_07", sel.circle(C2, R2), _in_ball(_X2, C2, R2), 2)
_chosen("sel_08", sel.nbbox(LO3, HI3, True), _nodes(_in_box(_N3, LO3, HI3), True), 3)
_chosen("sel_09", sel.nrect(LO2, HI2, False), _nodes(_in_box(_N2, LO2, HI2), False), 2)
_chosen("sel_10", sel.nsphere(C3, R3, False), _nodes(_in_ball(_N3, C3, R3), False), 3)
_chosen("sel_11", sel.ncircle(C2, R2, True), _nodes(_in_ball(_N2, C2, R2), True), 2)


@plans.add(
    "sel_03",
    f"""with {EL}, l as (select distinct 'QUAD4' as etype, o_orderkey as elem_id from orders)
    select etype, elem_id from el where (etype, elem_id) in (select etype, elem_id from l) or (etype = 'TET4' and elem_id in (1, 2, 3, 14768)) """,
)
def sel_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as a table, and a short one written out."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("QUAD4").alias("etype"), F.col("o_orderkey").alias("elem_id"))
    return whole(spark, sf_dir).select_ids(sel.ids(orders) | sel.ids({"TET4": [1, 2, 3, 14768]}))


@plans.add(
    "sel_12",
    f"""with {EL}, l as (select distinct p_partkey as node_id from part),
    u as (select etype, elem_id, unnest(conn) as node_id from el),
    a as (select etype, elem_id, count(*) as n, count(l.node_id) as hit from u left join l using (node_id) group by etype, elem_id)
    select etype, elem_id from a join el using (etype, elem_id) where hit = n or list_has_any(conn, [3000, 3001, 3002, 5000])""",
)
def sel_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes in a table of ids, or any in a short list."""
    listed = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node_id"))
    return whole(spark, sf_dir).select_ids(sel.nids(listed, all=True) | sel.nids([3000, 3001, 3002, 5000], all=False))


_GROUP = "(etype, family) in (select (etype, family) from mesh_groups where group_name = '{}')"
_chosen("sel_13", sel.group("inlet") | (sel.not_group("core") & sel.dims(2)), f"{_GROUP.format('inlet')} or (not {_GROUP.format('core')} and dim = 2)")
_chosen("sel_14", sel.family(7) | (sel.not_family(0) & sel.types("HEX8")), "family = 7 or (family <> 0 and etype = 'HEX8')")


def _cmp(a: str, op: str, b: str) -> str:
    return f"coalesce(case when isnan({a}) or isnan({b}) then {'true' if op == '<>' else 'false'} else {a} {op} {b} end, false)"


_T, _P, _Q = Field("temperature"), Field("pressure"), Field("quality")
_ALL = ("temperature", "pressure", "quality")
_chosen(
    "sel_15",
    ((_T > 60) | (_P < 15)) & (_Q >= 0.1) & (_Q <= 2.0) & (_T != _P) | (_T == 20.0),
    f"dim = 3 and ((({_cmp('temperature', '>', '60')} or {_cmp('pressure', '<', '15')}) and {_cmp('quality', '>=', '0.1')} and {_cmp('quality', '<=', '2')} and {_cmp('temperature', '<>', 'pressure')}) or {_cmp('temperature', '=', '20')})",
    fields=_ALL,
)
_HOT = f"(dim = 3 and {_cmp('temperature', '>', '50')})"
_chosen("sel_16", sel.sphere(C3, R3) & (_T > 50) & sel.types("HEX8"), f"{_in_ball(_X3, C3, R3)} and {_HOT} and etype = 'HEX8'", 3, ("temperature",))
_chosen("sel_17", sel.bbox(LO3, HI3) | (_T > 50), f"{_in_box(_X3, LO3, HI3)} or {_HOT}", 3, ("temperature",))
_chosen("sel_18", sel.bbox(LO3, HI3) ^ sel.nsphere(C3, R3, True), f"coalesce({_in_box(_X3, LO3, HI3)}, false) <> coalesce({_nodes(_in_ball(_N3, C3, R3), True)}, false)", 3)
_chosen("sel_19", sel.bbox(LO3, HI3) - sel.group("core"), f"{_in_box(_X3, LO3, HI3)} and not {_GROUP.format('core')}", 3)
_chosen("sel_20", ~(_T > 50), f"not {_HOT}", None, ("temperature",))
_chosen("sel_21", sel.rect((-sel.INFINITE, 50.0), (sel.INFINITE, 200.0)) & sel.dims(2), "c.cx is not null and c.cy is not null and (isnan(c.cy) or (c.cy >= 50 and c.cy < 200)) and dim = 2", 2)


@plans.add("sel_22", f"with {EL} select etype, row_number() over (partition by etype order by elem_id) - 1 as elem_id, elem_id as orig_elem_id, temperature, family from el where {_HOT}")
def sel_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected mesh, numbered anew."""
    mesh = whole(spark, sf_dir, ("temperature",)).select(_T > 50, renumber=True)
    return mesh.elements.select("etype", "elem_id", "orig_elem_id", "temperature", "family")


# -- sets of ids ---------------------------------------------------------------------


def _two(spark: SparkSession, sf_dir: str) -> tuple[Mesh, DataFrame, DataFrame]:
    mesh = whole(spark, sf_dir)
    return mesh, mesh.select_ids(sel.group("monitored") | sel.types("VERTEX")), mesh.select_ids(sel.group("core") & ~sel.types("HEX8"))


_SETS = f"""with {EL},
    a as (select etype, elem_id from el where {_GROUP.format('monitored')} or etype = 'VERTEX'),
    b as (select etype, elem_id from el where {_GROUP.format('core')} and etype <> 'HEX8')"""
for _key, _op, _sql in (
    ("set_01", sets.union, "select * from a union select * from b"),
    ("set_02", sets.intersection, "select * from a intersect select * from b"),
    ("set_03", sets.difference, "select * from a except select * from b"),
    ("set_04", sets.symmetric_difference, "(select * from a except select * from b) union (select * from b except select * from a)"),
):

    @plans.add(_key, f"{_SETS} {_sql}")
    def _set_query(spark: SparkSession, sf_dir: str, op=_op) -> DataFrame:
        _, a, b = _two(spark, sf_dir)
        return op(a, b)


@plans.add("set_05", f"{_SETS}, c as (select * from a union select 'QUAD4', -1), d as (select * from c where etype <> 'TRI3') select etype, count(*) as n from d group by etype")
def set_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id added, a type taken out, an absent id removed, and the sizes."""
    _, a, _ = _two(spark, sf_dir)
    return sets.sizes(sets.remove(sets.without_type(sets.add(a, "QUAD4", -1), "TRI3"), "HEX8", -5))


QUERIES, SQL = plans.QUERIES, plans.SQL
