"""Meshes from the test tables, and the same tables in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.etypes import SUBENTITIES, TYPES, places
from meshloom.mesh import Mesh
from meshloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries with their SQL, by key."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.QUERIES[key] = query
            if sql is not None:
                self.SQL[key] = sql
            return query

        return register


def whole(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ()) -> Mesh:
    """All meshes of the tables as one; z of flat meshes means nothing here."""
    return Mesh.clean(*[table(spark, sf_dir, t) for t in ("mesh_nodes", "mesh_elements", "mesh_groups")], fields=fields)


def space(spark: SparkSession, sf_dir: str, dim: int, fields: tuple[str, ...] = ()) -> Mesh:
    """The meshes that lie in ``dim`` dimensions as one."""
    meshes = table(spark, sf_dir, "meshes").where(F.col("space_dim") == dim).select("mesh_id").distinct()
    nodes, elements = (table(spark, sf_dir, t).join(meshes, "mesh_id", "left_semi") for t in ("mesh_nodes", "mesh_elements"))
    return Mesh.clean(nodes, elements, table(spark, sf_dir, "mesh_groups"), fields=fields, axes=("x", "y", "z")[:dim])


def joined(conn: Column) -> Column:
    return F.array_join(conn.cast("array<string>"), ",")


def thousandths(v: Column) -> Column:
    """A number as text, cut to thousandths at a place where no value lies, so that two engines agree in spite of the last bit."""
    finite = F.floor(v * 1000 + 0.1237).cast("string")
    return F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(finite)


def sql_thousandths(v: str) -> str:
    return f"case when {v} is null then null when isnan({v}) then 'nan' when {v} = 'inf'::double then 'inf' when {v} = '-inf'::double then '-inf' else floor(({v}) * 1000 + 0.1237)::bigint::varchar end"


# -- SQL ------------------------------------------------------------------------------

_SIZES = " ".join(f"when '{t.name}' then {t.n_nodes}" for t in TYPES.values() if t.n_nodes)

#: Elements as cleaned; then those of flat meshes and of meshes in space.
EL = f"""
    el as (
        select distinct elem_id, mesh_id, etype, etype_ord, dim, conn, coalesce(family, 0) as family, temperature, pressure, quality from mesh_elements
        where etype is not null and elem_id is not null and conn is not null and len(conn) > 0 and len(list_filter(conn, lambda x: x is null)) = 0
        and coalesce(len(conn) = case etype {_SIZES} end, true)),
    e2 as (select * from el where mesh_id in (select mesh_id from meshes where space_dim = 2)),
    e3 as (select * from el where mesh_id in (select mesh_id from meshes where space_dim = 3)),
    nd as (select distinct node_id, mesh_id, x, y, z from mesh_nodes where node_id is not null),
    n2 as (select node_id, x, y from nd where mesh_id in (select mesh_id from meshes where space_dim = 2)),
    n3 as (select node_id, x, y, z from nd where mesh_id in (select mesh_id from meshes where space_dim = 3))"""

#: Coordinates by element, in order, and centroids; null where a node is unknown.
POINTS = (
    EL
    + """,
    i2 as (select etype, elem_id, len(conn) as n, unnest(conn) as node_id, generate_subscripts(conn, 1) as i from e2),
    p2 as (select etype, elem_id, any_value(n) as n, list(x order by i) as xs, list(y order by i) as ys from i2 join n2 using (node_id) group by etype, elem_id having count(*) = any_value(n)),
    c2 as (select etype, elem_id, case when len(list_filter(xs, lambda v: v is null)) = 0 then list_sum(xs) / n end as cx, case when len(list_filter(ys, lambda v: v is null)) = 0 then list_sum(ys) / n end as cy from p2),
    i3 as (select etype, elem_id, len(conn) as n, unnest(conn) as node_id, generate_subscripts(conn, 1) as i from e3),
    p3 as (select etype, elem_id, any_value(n) as n, list(x order by i) as xs, list(y order by i) as ys, list(z order by i) as zs from i3 join n3 using (node_id) group by etype, elem_id having count(*) = any_value(n)),
    c3 as (select etype, elem_id, case when len(list_filter(xs, lambda v: v is null)) = 0 then list_sum(xs) / n end as cx, case when len(list_filter(ys, lambda v: v is null)) = 0 then list_sum(ys) / n end as cy,
        case when len(list_filter(zs, lambda v: v is null)) = 0 then list_sum(zs) / n end as cz from p3)"""
)

#: Whole meshes with nodes and elements numbered densely, as files hold them.
DENSE = (
    EL
    + """,
    rk as (select node_id, row_number() over (order by node_id) - 1 as pos from (select distinct node_id from nd)),
    un as (select etype, elem_id, len(conn) as n, unnest(conn) as node_id, generate_subscripts(conn, 1) as i from el),
    dn as (select etype, elem_id, list(pos order by i) as conn from un join rk using (node_id) group by etype, elem_id having count(*) = any_value(n)),
    de as (select etype, row_number() over (partition by etype order by elem_id) - 1 as elem_id, conn from dn)"""
)


def sql_subs(codim: int, dim: int, source: str = "el", name: str = "sub") -> str:
    """CTE (etype, etype_ord, elem_id, pos, sub_etype, sub_conn) of the sub-entities of elements of ``dim``."""
    parts = []
    for (etype, c), (sub, pattern) in SUBENTITIES.items():
        if c == codim and TYPES[etype].dim == dim:
            lists = ", ".join("[" + ", ".join(f"conn[{k + 1}]" for k in place) + "]" for place in places(pattern))
            n = len(places(pattern))
            parts.append(f"select etype, etype_ord, elem_id, unnest(range({n})) as pos, '{sub}' as sub_etype, unnest([{lists}]) as sub_conn from {source} where etype = '{etype}'")
    if dim == 2 and codim == 1:
        parts.append(f"select etype, etype_ord, elem_id, unnest(range(len(conn))) as pos, 'SEG2' as sub_etype, unnest(list_transform(range(len(conn)), lambda i: [conn[i + 1], conn[(i + 1) % len(conn) + 1]])) as sub_conn from {source} where etype = 'PGON'")
    if dim == 2 and codim == 2:
        parts.append(f"select etype, etype_ord, elem_id, unnest(range(len(conn))) as pos, 'VERTEX' as sub_etype, unnest(list_transform(conn, lambda k: [k])) as sub_conn from {source} where etype = 'PGON'")
    return f"{name} as ({' union all '.join(parts)})"
