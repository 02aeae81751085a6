"""The core's queries over the mesh tables at scale, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.nearby import near_pairs, points_in_regions
from meshloom.operators.numbering import number_within_groups
from meshloom.runtime import Scratch, small, table

NEAR = 0.01


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "mesh_elements").where("etype is not null").select("mesh_id", "etype", "observed_at", "elem_id")
    # Redelivered rows are equal in these columns; distinct() combines them before its shuffle.
    return number_within_groups(elements.distinct(), ["mesh_id", "etype"], ["observed_at", "elem_id"], "block_pos")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).where("block_pos % 100 = 0").select("mesh_id", "etype", "block_pos", "elem_id")


def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each block: a count needs no numbers, only partial sums."""
    elements = table(spark, sf_dir, "mesh_elements").where("etype is not null").select("mesh_id", "etype", "elem_id").distinct()
    return elements.groupBy("mesh_id", "etype").agg(F.count("*").alias("n_elements"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "nearby")
    nodes = table(spark, sf_dir, "mesh_nodes")
    # Rows of one node agree in all but loaded_at.
    unique = scratch.save(nodes.select("node_id", "mesh_id", "x", "y", "z").distinct(), "nodes")
    zones = points_in_regions(unique, table(spark, sf_dir, "zones").dropDuplicates(["zone_id"]))
    dims = small(table(spark, sf_dir, "meshes").select("mesh_id", "space_dim").distinct())
    # A flat mesh has no third coordinate: its nodes all get 0.
    space = unique.join(dims, "mesh_id").where("space_dim in (2, 3)").withColumn("z", F.expr("if(space_dim = 3, z, 0D)"))
    near = near_pairs(space, NEAR)
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(zones.select(F.lit("zone").alias("kind"), F.col("zone_id").alias("id_a"), F.col("node_id").alias("id_b")))


QUERIES = {"p3_found": p3_found, "p3_blocks": p3_blocks, "p5_found": p5_found}

SQL = {
    "p3_found": """
        with e as (select distinct mesh_id, etype, observed_at, elem_id from mesh_elements where etype is not null),
        n as (select mesh_id, etype, elem_id, row_number() over (partition by mesh_id, etype order by observed_at nulls first, elem_id) - 1 as block_pos from e)
        select mesh_id, etype, block_pos, elem_id from n where block_pos % 100 = 0""",
    "p3_blocks": "select mesh_id, etype, count(distinct elem_id) as n_elements from mesh_elements where etype is not null group by mesh_id, etype",
    "p5_found": """
        with n as (select distinct node_id, mesh_id, x, y, z from mesh_nodes where x is not null and y is not null and not isnan(x) and not isnan(y)),
        s as (select n.node_id, n.mesh_id, n.x, n.y, case when m.space_dim = 3 then n.z else 0 end as z from n join meshes m using (mesh_id) where m.space_dim in (2, 3)),
        k as (select *, floor(x / 0.08) as kx, floor(y / 0.08) as ky from s where z is not null and not isnan(z)),
        near as (select a.node_id as id_a, b.node_id as id_b from k a, (values (-1), (0), (1)) dx(dx), (values (-1), (0), (1)) dy(dy), k b
            where a.mesh_id = b.mesh_id and a.kx + dx.dx = b.kx and a.ky + dy.dy = b.ky and a.node_id < b.node_id
            and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.01::double * 0.01::double),
        c as (select zone_id, n.node_id, n.x, n.y, unnest(xs) as px, unnest(ys) as py, unnest(list_append(xs[2:], xs[1])) as qx, unnest(list_append(ys[2:], ys[1])) as qy
            from zones z join n on z.shape = 'poly' and n.x between list_min(xs) and list_max(xs) and n.y between list_min(ys) and list_max(ys)),
        poly as (select zone_id as id_a, node_id as id_b from c group by zone_id, node_id
            having count(*) filter (where (py > y) <> (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px) % 2 = 1),
        box as (select zone_id as id_a, node_id as id_b from zones z join n on z.shape = 'box'
            and n.x between least(xs[1], xs[2]) and greatest(xs[1], xs[2]) and n.y between least(ys[1], ys[2]) and greatest(ys[1], ys[2])),
        disc as (select zone_id as id_a, node_id as id_b from zones z join n on z.shape = 'disc'
            and (n.x - xs[1]) * (n.x - xs[1]) + (n.y - ys[1]) * (n.y - ys[1]) <= radius * radius)
        select 'near' as kind, id_a, id_b from near union all select 'zone', id_a, id_b from box
        union all select 'zone', id_a, id_b from disc union all select 'zone', id_a, id_b from poly""",
}
