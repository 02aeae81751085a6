"""Queries of sources, sinks and scans, over the whole mesh tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom import etypes
from meshloom.functions import selection as sel
from meshloom.functions.fields import Field
from meshloom.mesh import Mesh, running_sum, same_connectivity, same_node_set
from meshloom.operators.numbering import number_within_groups
from meshloom.plans.tables import DENSE, EL, Plans, joined, whole
from meshloom.runtime import Scratch, table
from meshloom.sources import arrays, builders, files

plans = Plans()
_VTK = ("VERTEX", "SEG2", "TRI3", "PGON", "QUAD4", "TET4", "HEX8")


def _conn(df: DataFrame) -> DataFrame:
    return df.select("etype", "elem_id", joined(F.col("conn")).alias("nodes"))


# -- builders ----------------------------------------------------------------------------


@plans.add("src_01", "select mesh_id, count(distinct node_id) as n_nodes, 0 as n_elements from mesh_nodes where node_id is not null group by mesh_id")
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meshes without elements, over the nodes."""
    nodes = table(spark, sf_dir, "mesh_nodes").where("node_id is not null").select("node_id", "mesh_id", "x", "y", "z").distinct()
    mesh = Mesh(nodes)
    return mesh.nodes.groupBy("mesh_id").agg(F.count("*").alias("n_nodes"), F.lit(mesh.num_elements()).alias("n_elements"))


@plans.add("src_02", f"with {EL} select etype, elem_id, array_to_string(conn, ',') as nodes, case when etype = 'TRI3' then temperature end as temperature from el where etype in ('TRI3', 'QUAD4', 'HEX8')")
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three types, one with a field; a second block of a type leaves the first as it is."""
    src = whole(spark, sf_dir, ("temperature",))
    mesh = Mesh(src.nodes)
    for t in ("QUAD4", "HEX8"):
        mesh = mesh.add_block(t, src.block(t).select("elem_id", "conn"))
    mesh = mesh.add_block("TRI3", src.block("TRI3").select("elem_id", "conn", "temperature"))
    mesh = mesh.add_block("TRI3", src.block("TRI3").limit(1).select("elem_id", "conn"), mode="keep")
    return mesh.elements.select("etype", "elem_id", joined(F.col("conn")).alias("nodes"), "temperature")


@plans.add("src_03", f"with {EL} select 'PGON' as etype, row_number() over (order by elem_id) - 1 as elem_id, array_to_string(conn, ',') as nodes from el where etype = 'PGON'")
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons from one flat array of nodes and the ends of the elements in it."""
    src = whole(spark, sf_dir)
    numbered = number_within_groups(src.block("PGON").select("elem_id", "conn"), [], ["elem_id"], "new", scratch=Scratch(spark, "polygons"))
    rows = running_sum(numbered.select(F.col("new").alias("elem_id"), "conn"), "elem_id", F.size("conn"), "end")
    flat = rows.select((F.col("end") - F.size("conn")).alias("start"), F.posexplode("conn").alias("at", "node_id"))
    data = flat.select((F.col("start") + F.col("at")).alias("pos"), "node_id")
    return _conn(Mesh(src.nodes).add_poly_block("PGON", data, rows.select("elem_id", "end")).elements)


@plans.add("src_04", f"with {EL} select 'SEG2' as etype, count(*) + 1 as n_elements, max(elem_id) + 1 as elem_id, '11,12' as nodes, 7 as family from el where etype = 'SEG2'")
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh, (etype, new) = whole(spark, sf_dir).add_element("SEG2", [11, 12], family=7)
    assert mesh.element(etype, new).count() == 1
    last = [F.max("elem_id").alias("elem_id"), F.max_by(joined(F.col("conn")), "elem_id").alias("nodes"), F.max_by("family", "elem_id").alias("family")]
    return mesh.block(etype).groupBy("etype").agg(F.count("*").alias("n_elements"), *last)


@plans.add("src_05", "with n as (select count(distinct node_id) as n, max(node_id) as m from mesh_nodes) select n + 2 as n_nodes, m + 2 as last_id from n")
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = whole(spark, sf_dir).add_nodes([(0.0, 0.0, 0.0), (1.0, 0.5, 0.25)])
    return mesh.nodes.select("node_id").distinct().agg(F.count("*").alias("n_nodes"), F.max("node_id").alias("last_id"))


_GRID_Y = "(select ceil(count(*) / 50.0)::bigint as ny from orders)"


@plans.add(
    "src_06",
    f"""with g as {_GRID_Y}, c as (select unnest(range(50 * ny)) as id from g)
    select 'QUAD4' as etype, id as elem_id, concat_ws(',', (id // 50) * 51 + id % 50, (id // 50) * 51 + id % 50 + 1, (id // 50 + 1) * 51 + id % 50 + 1, (id // 50 + 1) * 51 + id % 50) as nodes from c""",
)
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of a cell an order."""
    return _conn(_orders_grid(spark, sf_dir).elements)


def _orders_grid(spark: SparkSession, sf_dir: str) -> Mesh:
    n = table(spark, sf_dir, "orders").count()
    return builders.GridBuilder(spark).add_axis(range(51)).add_axis(range(-(-n // 50) + 1)).build()


def orders_grid(spark: SparkSession, sf_dir: str) -> Mesh:
    """The same grid with the order's price as a field, and its priority as a group."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("elem_id"), F.col("o_totalprice").alias("price"))
    grid = _orders_grid(spark, sf_dir)
    return Mesh(grid.nodes, grid.elements.join(orders, "elem_id", "left").select(*grid.elements.columns, "price"))


@plans.add("entry_grid", "select 'QUAD4' as etype, o_orderkey as elem_id from orders where o_orderkey % 50 + 0.5 >= 10 and o_orderkey % 50 + 0.5 < 40 and o_orderkey // 50 + 0.5 >= 2 and o_orderkey // 50 + 0.5 < 200 and o_totalprice > 100000")
def entry_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the grid of orders in a rectangle, with a price above a limit."""
    return orders_grid(spark, sf_dir).select_ids(sel.rect((10.0, 2.0), (40.0, 200.0)) & (Field("price") > 100_000))


_READ = f"with {DENSE} select etype, elem_id, array_to_string(conn, ',') as nodes from de"
_READ_VTK = _READ + " where etype not in ('SEG3', 'TRI6')"


def _round_trip(spark: SparkSession, sf_dir: str, name: str, fields: tuple[str, ...] = (), types: tuple[str, ...] | None = None) -> Mesh:
    """All meshes written to one file and read back."""
    mesh = whole(spark, sf_dir, fields)
    mesh = mesh if types is None else mesh.select(sel.types(*types))
    path = Scratch(spark, "file").path(name)
    files.write(mesh, path)
    return files.read(spark, path)


@plans.add("src_07", f"with {EL} select etype, elem_id, array_to_string(conn, ',') as nodes, temperature, pressure, family from el")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the extension, in any case: here a folder of Parquet, as data of any size is kept."""
    e = _round_trip(spark, sf_dir, "whole.MESH", ("temperature", "pressure")).elements
    return e.select("etype", "elem_id", joined(F.col("conn")).alias("nodes"), "temperature", "pressure", "family")


for _key, _name, _types in (("src_08", "m.json", None), ("src_09", "m.yml", None), ("src_10", "m.vtu", _VTK), ("src_10_legacy", "m.vtk", _VTK), ("src_11", "m.vtkhdf", _VTK)):

    @plans.add(_key, _READ if _types is None else _READ_VTK)
    def _read_back(spark: SparkSession, sf_dir: str, name=_name, types=_types) -> DataFrame:
        return _conn(_round_trip(spark, sf_dir, name, types=types).elements)


@plans.add("src_12", f"with {EL} select etype, elem_id, temperature, family from el")
def src_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh shared keeps its fields and families."""
    return whole(spark, sf_dir, ("temperature",)).to_shared().elements.select("etype", "elem_id", "temperature", "family")


@plans.add("src_13", "select * from (values ('TRI3', 0, '0,1,2'), ('TRI3', 1, '1,2,3'), ('TRI3', 2, '2,3,4'), ('QUAD4', 0, '0,1,2,3'), ('QUAD4', 1, '4,5,6,7'), ('HEX8', 0, '0,1,2,3,4,5,6,7')) t(etype, elem_id, nodes)")
def src_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conn(builders.sample_mixed(spark).elements)


# -- sinks ---------------------------------------------------------------------------------

_SUMMARY = "select etype, count(*) as n_elements, sum(len(conn)) as n_ids, sum(list_sum(conn))::bigint as sum_ids from de"


def _summary(spark: SparkSession, parts: dict[str, tuple[int, np.ndarray]]) -> DataFrame:
    """Of each type: elements, ids in the connectivity and their sum, as a file or library holds them."""
    rows = [(t, int(n), len(ids), int(np.sum(ids))) for t, (n, ids) in parts.items()]
    return spark.createDataFrame(rows, "etype string, n_elements bigint, n_ids bigint, sum_ids bigint")


def _held(mesh: Mesh) -> DataFrame:
    """Of each type: elements, ids in the connectivity and their sum, as a file that was read holds them."""
    total = F.sum(F.aggregate("conn", F.lit(0).cast("long"), lambda s, n: s + n))
    return mesh.elements.groupBy("etype").agg(F.count("*").alias("n_elements"), F.sum(F.size("conn")).cast("long").alias("n_ids"), total.alias("sum_ids"))


def _written(name: str, types: tuple[str, ...] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _held(_round_trip(spark, sf_dir, name, types=types))


plans.add("snk_02", f"with {DENSE} {_SUMMARY} group by etype")(_written("m.json"))
plans.add("snk_03", f"with {DENSE} {_SUMMARY} group by etype")(_written("m.yaml"))


@plans.add("snk_01", f"with {EL} select etype, count(*) as n_elements, sum(len(conn)) as n_ids, sum(list_sum(conn))::bigint as sum_ids from el group by etype")
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the extension: a folder of Parquet, counted as it lies there."""
    path = Scratch(spark, "file").path("whole.mesh")
    files.write(whole(spark, sf_dir), path)
    e = spark.read.parquet(f"{path}/elements")
    return e.groupBy("etype").agg(F.count("*").alias("n_elements"), F.sum(F.size("conn")).cast("long").alias("n_ids"), F.sum(F.aggregate("conn", F.lit(0).cast("long"), lambda s, n: s + n)).alias("sum_ids"))


plans.add("snk_04", f"with {DENSE} {_SUMMARY} where etype not in ('SEG3', 'TRI6') group by etype")(_written("m.vtu", _VTK))
plans.add("snk_05", f"with {DENSE} {_SUMMARY} where etype not in ('SEG3', 'TRI6') group by etype")(_written("m.vtkhdf", _VTK))


@plans.add("snk_06", f"with {DENSE} {_SUMMARY} group by etype")
def snk_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text in one line, which a file takes, since no program need hold it."""
    path = Scratch(spark, "file").path("m.json")
    files.write_json(whole(spark, sf_dir), path, pretty=False)
    return _held(files.read(spark, path))


@plans.add("snk_07", f"with {DENSE} {_SUMMARY} group by etype")
def snk_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = files.blocks(whole(spark, sf_dir))
    return _summary(spark, {t: (len(b[1]), b[0]) if isinstance(b, tuple) else (len(b), b.ravel()) for t, b in blocks.items()})


@plans.add("snk_08", f"with {DENSE} {_SUMMARY} where etype <> 'PGON' group by etype")
def snk_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as meshio takes them."""
    mesh = whole(spark, sf_dir).select(~sel.types("PGON"))
    names = {m: t for t, m in etypes.MESHIO_NAMES.items()}
    return _summary(spark, {names[m]: (len(c), c.ravel()) for m, c in arrays.meshio_cells(arrays.to_arrays(mesh, False))})


@plans.add("snk_09", f"with {DENSE}, m as (select *, case etype when 'TET4' then 14 when 'HEX8' then 18 end as code from de where etype in ('TET4', 'HEX8')) select count(*) as n_elements, sum(len(conn) + 1)::bigint as n_ids, sum(list_sum(conn) + code)::bigint as sum_ids, sum(len(conn) + 1)::bigint as last_end from m")
def snk_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solids as medcoupling takes them, the end of the last included."""
    conn, starts = arrays.med_cells(arrays.to_arrays(whole(spark, sf_dir).select(sel.dims(3)), False))
    return spark.createDataFrame([(len(starts) - 1, len(conn), int(conn.sum()), int(starts[-1]))], "n_elements bigint, n_ids bigint, sum_ids bigint, last_end bigint")


@plans.add("snk_10", f"with {DENSE}, f as (select count(*) filter (where not isnan(temperature)) as known from el join (select etype, elem_id from dn) using (etype, elem_id)) select (select count(*) from de) as n_cells, (select sum(len(conn) + 1)::bigint from de) as n_numbers, known from f")
def snk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells with their temperature, as pyvista takes them."""
    rows = arrays.vtk_rows(whole(spark, sf_dir, ("temperature",)), ("temperature",))
    return rows.agg(F.count("code").alias("n_cells"), F.coalesce(F.sum(F.size("cell")), F.lit(0)).cast("long").alias("n_numbers"), F.count_if(~F.isnan("temperature")).alias("known"))


@plans.add("snk_11", f"with {EL} select '  ' || etype || ' (dimension ' || any_value(dim) || '): ' || count(*) || ' elements' as line from el group by etype union all select 'Mesh in 3 dimensions, ' || count(*) || ' nodes' from nd")
def snk_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [x for x in whole(spark, sf_dir).describe().splitlines() if not x.startswith("    ")]
    return spark.createDataFrame([(x,) for x in lines], "line string")


# -- scans -------------------------------------------------------------------------------------


@plans.add("scn_01", f"with {EL} select etype, elem_id, array_to_string(conn, ',') as nodes from el")
def scn_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conn(whole(spark, sf_dir).elements.orderBy("etype_ord", "elem_id"))


@plans.add("scn_02", f"with {EL} select etype, elem_id from el where dim = 2")
def scn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(spark, sf_dir).of_dim(2).select("etype", "elem_id")


@plans.add("scn_03", f"with {EL} select etype, elem_id from el where etype = 'TET4' union all select distinct etype, -1 from el")
def scn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block, and the types of all."""
    mesh = whole(spark, sf_dir)
    kinds = spark.createDataFrame([(t, -1) for t in mesh.block_types()], "etype string, elem_id bigint")
    return mesh.block("TET4").select("etype", "elem_id").unionByName(kinds)


@plans.add("scn_04", f"with {EL}, k as (select max(elem_id) as m from el where etype = 'HEX8') select etype, elem_id, array_to_string(conn, ',') as nodes from el, k where etype = 'HEX8' and elem_id = m")
def scn_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = whole(spark, sf_dir)
    return _conn(mesh.element("HEX8", mesh.block("HEX8").agg(F.max("elem_id")).first()[0]))


@plans.add("scn_05", f"with {EL} select etype, etype_ord, dim, count(*) as n_elements from el group by all")
def scn_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(spark, sf_dir).counts()


@plans.add("scn_06", f"with {EL} select 3 as space_dim, max(dim)::int as topological_dim from el")
def scn_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = whole(spark, sf_dir)
    return spark.createDataFrame([(mesh.space_dim, mesh.topological_dim)], "space_dim int, topological_dim int")


@plans.add("scn_07", f"with {EL} select distinct unnest(conn) as node_id from el")
def scn_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(spark, sf_dir).used_nodes()


@plans.add("scn_08", f"""with {EL} select etype, elem_id, array_to_string(conn, ',') as nodes, (sum(len(conn)) over (order by elem_id))::bigint as "end" from el where etype = 'PGON' union all select etype, elem_id, array_to_string(conn, ','), null from el where etype = 'QUAD4'""")
def scn_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = whole(spark, sf_dir)
    poly = mesh.poly_connectivity("PGON").select(F.lit("PGON").alias("etype"), "elem_id", joined(F.col("conn")).alias("nodes"), "end")
    regular = mesh.regular_connectivity("QUAD4").select(F.lit("QUAD4").alias("etype"), "elem_id", joined(F.col("conn")).alias("nodes"), F.lit(None).cast("long").alias("end"))
    return poly.unionByName(regular)


@plans.add("scn_09", f"with {EL} select etype, elem_id, temperature as value from el where dim = 3 union all select 'no pressure at 1', null, null")
def scn_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the highest dimension; one that a dimension lacks is none."""
    mesh = whole(spark, sf_dir, ("temperature", "pressure"))
    lacking = mesh.field("pressure", 1) is None
    mark = spark.createDataFrame([("no pressure at 1" if lacking else "pressure at 1", None, None)], "etype string, elem_id bigint, value double")
    return mesh.field("temperature").unionByName(mark)


@plans.add("scn_10", f"with {EL} select etype, elem_id, case when dim = 2 then temperature * 2 end as doubled from el")
def scn_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field set for one dimension, another dropped."""
    mesh = whole(spark, sf_dir, ("temperature",)).with_field("doubled", Field("temperature") * 2, 2).drop_field("temperature")
    return mesh.elements.select("etype", "elem_id", *mesh.field_names())


@plans.add("scn_11", f"with {EL} select etype, elem_id, group_name from el join (select distinct etype, family, group_name from mesh_groups) using (etype, family)")
def scn_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(spark, sf_dir).element_groups()


@plans.add("scn_12", f"with {EL}, k as (select * from el where family = 7) select etype, row_number() over (partition by etype order by elem_id) - 1 as elem_id, elem_id as orig_elem_id, array_to_string(conn, ',') as nodes, temperature from k")
def scn_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of elements extracted, all types and fields, numbered anew."""
    mesh = whole(spark, sf_dir, ("temperature",))
    out = mesh.extract(mesh.elements.where("family = 7").select("etype", "elem_id"), renumber=True)
    return out.elements.select("etype", "elem_id", "orig_elem_id", joined(F.col("conn")).alias("nodes"), "temperature")


@plans.add("scn_13", f"with {EL} select etype, elem_id, array_to_string(case when etype = 'QUAD4' and family = 7 then list_reverse(conn) else conn end, ',') as nodes, case when etype = 'QUAD4' and family = 7 then 70 else family end as family from el")
def scn_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some quadrangles turned over."""
    mesh = whole(spark, sf_dir)
    some = mesh.block("QUAD4").where("family = 7")
    turned = Mesh(mesh.nodes, some.withColumn("conn", F.reverse("conn")).withColumn("family", F.lit(70).cast("long")))
    out = mesh.replace(some.select("etype", "elem_id", F.col("elem_id").alias("new_id")), turned)
    return out.elements.select("etype", "elem_id", joined(F.col("conn")).alias("nodes"), "family")


@plans.add("scn_14", f"with {EL} select etype, elem_id, 'kept' as side from el where dim <> 2 or etype = 'TRI3' union all select etype, elem_id, 'replaced' from el where dim = 2")
def scn_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles in place of all plane elements."""
    mesh = whole(spark, sf_dir)
    new, old = mesh.update(mesh.select(sel.types("TRI3")))
    side = lambda m, s: m.elements.select("etype", "elem_id", F.lit(s).alias("side"))
    return side(new, "kept").unionByName(side(old, "replaced"))


@plans.add("scn_15", f"with {EL} select etype, elem_id from el where family <> 7")
def scn_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = whole(spark, sf_dir)
    return mesh.remove(mesh.elements.where("family = 7").select("etype", "elem_id")).elements.select("etype", "elem_id")


@plans.add("scn_16", f"with {EL}, q as (select conn, list_sort(list_distinct(conn)) as s, elem_id from el where etype = 'TRI3') select a.elem_id as id_a, b.elem_id as id_b, a.conn = b.conn as equal from q a join q b on a.s = b.s and a.elem_id < b.elem_id")
def scn_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the same nodes, and whether in the same order."""
    t = whole(spark, sf_dir).block("TRI3").select("elem_id", "conn", F.array_sort(F.array_distinct("conn")).alias("s"))
    a, b = t.select("s", F.col("elem_id").alias("id_a"), F.col("conn").alias("ca")), t.select("s", F.col("elem_id").alias("id_b"), F.col("conn").alias("cb"))
    both = a.join(b, "s").where("id_a < id_b").where(same_node_set(F.col("ca"), F.col("cb")))
    return both.select("id_a", "id_b", same_connectivity(F.col("ca"), F.col("cb")).alias("equal"))


@plans.add("scn_17", f"with {EL} select elem_id, unnest(range(len(conn)))::int as pos, unnest(conn) as node_id from el where etype = 'PGON'")
def scn_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows, one entry a row."""
    return whole(spark, sf_dir).block("PGON").select("elem_id", F.posexplode("conn").alias("pos", "node_id"))


@plans.add("scn_18", f"with {EL} select etype, elem_id, dim, len(conn)::int as n_nodes, etype in ('PGON', 'SPLINE', 'PHED') as is_poly from el")
def scn_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = etypes.type_table(spark).select("etype", "n_nodes", "is_poly")
    e = whole(spark, sf_dir).elements.join(F.broadcast(kinds), "etype")  # 17 rows
    return e.select("etype", "elem_id", "dim", F.coalesce("n_nodes", F.size("conn")).alias("n_nodes"), "is_poly")


@plans.add("scn_19", f"with {EL} select etype, elem_id, case when dim > 0 then dim - 1 end::tinyint as below, case when dim < 3 then dim + 1 end::tinyint as above from el")
def scn_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimensions below and above; none outside of 0 to 3."""
    steps = []
    for d in range(4):
        near = []
        for by in (-1, 1):
            try:
                near.append(etypes.step_dim(d, by))
            except ValueError:
                near.append(None)
        steps.append((d, *near))
    table_of = spark.createDataFrame(steps, "dim tinyint, below tinyint, above tinyint")
    return whole(spark, sf_dir).elements.join(F.broadcast(table_of), "dim").select("etype", "elem_id", "below", "above")  # four rows


@plans.add(
    "stream_select",
    f"with {EL} select distinct etype, elem_id, case when temperature is null then null when isnan(temperature) or isinf(temperature) then 'other' else floor(temperature * 2 * 1000 + 0.1237)::bigint::varchar end as doubled from el where (etype, family) in (select (etype, family) from mesh_groups where group_name in ('inlet', 'core')) and coalesce(not isnan(temperature) and temperature > 20, false) and dim = 3",
)
def stream_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements as a stream, selected and computed as they come, written, and read when all are through."""
    from meshloom.streaming import eval_stream, select_stream

    scratch = Scratch(spark, "stream")
    src = table(spark, sf_dir, "mesh_elements")
    groups = table(spark, sf_dir, "mesh_groups")
    # A pattern, since the table may be a single file, while a stream reads folders.
    stream = spark.readStream.schema(src.schema).parquet(f"{sf_dir}/mesh_elements.parque[t]")
    chosen = select_stream(stream, (sel.group("inlet") | sel.group("core")) & (Field("temperature") > 20), top_dim=3, groups=groups)
    out = eval_stream(chosen, "doubled", Field("temperature") * 2)
    writer = out.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(out.schema).parquet(scratch.path("out"))
    mesh = Mesh.clean(table(spark, sf_dir, "mesh_nodes"), rows, fields=["doubled"])
    d = F.col("doubled")
    value = F.when(F.isnan(d) | (F.abs(d) == float("inf")), "other").otherwise(F.floor(d * 1000 + 0.1237).cast("string"))
    return mesh.elements.select("etype", "elem_id", value.alias("doubled"))


QUERIES, SQL = plans.QUERIES, plans.SQL
