"""Measures and boxes of elements; nodes snapped to others, found near each other, and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom import etypes
from meshloom.functions import geometry as g
from meshloom.mesh import FIXED, KEY, Mesh
from meshloom.operators.graph import star_components
from meshloom.operators.nearby import finite, near_join, near_pairs
from meshloom.runtime import Scratch

#: The default distance of snapping and merging.
EPS = 1e-12


# -- measures -----------------------------------------------------------------------


def _measure(etype: Column, points: Column, dim: int) -> Column:
    p = [F.get(points, F.lit(k)) for k in range(8)]
    out = F.when(etype == "VERTEX", F.lit(0.0)).when(etype == "SEG2", g.distance(p[0], p[1], dim))
    if dim >= 2:
        out = out.when(etype == "TRI3", g.triangle_area(p[0], p[1], p[2], dim)).when(etype == "QUAD4", g.quad_area(p[0], p[1], p[2], p[3], dim))
    if dim == 2:
        out = out.when(etype == "PGON", F.abs(g.polygon_area_signed(points)))
    if dim == 3:
        parts = [g.tetra_volume_signed(*[p[k] for k in place]) for place in etypes.places(etypes.SIMPLEXES["HEX8"][1])]
        out = out.when(etype == "TET4", F.abs(g.tetra_volume_signed(p[0], p[1], p[2], p[3])))
        out = out.when(etype == "HEX8", sum((F.abs(v) for v in parts[1:]), F.abs(parts[0])))
    return F.when(points.isNotNull(), out)


def measure(mesh: Mesh, dim: int | None = None) -> DataFrame:
    """(etype, elem_id, value): length, area or volume of the elements of one dimension, by default the highest.

    For VERTEX (0), SEG2, TRI3, QUAD4, polygons in the plane, and TET4 and HEX8 in
    space (a hexahedron as its five tetrahedra); null for other types and for elements with an unknown node.  NaN coordinates give NaN.
    """
    d = mesh._dim(dim)
    rows = mesh.with_points(mesh.elements.select(*FIXED).where(etypes.has_dim(F.col("etype"), d)))
    return rows.select(*KEY, _measure(F.col("etype"), F.col("points"), mesh.space_dim).alias("value"))


def measure_update(mesh: Mesh, name: str = "Measure", dim: int | None = None) -> Mesh:
    """The mesh with :func:`measure` as a field."""
    return mesh.with_field(name, measure(mesh, dim), dim)


def centroids(mesh: Mesh) -> DataFrame:
    """(etype, elem_id, x, ...): the mean of each element's nodes."""
    rows = mesh.with_points()
    return rows.select(*KEY, *[c.alias(a) for c, a in zip(g.centroid(F.col("points"), mesh.space_dim), mesh.axes)])


def bounding_boxes(mesh: Mesh) -> DataFrame:
    """(etype, elem_id, x_min, ..., x_max, ...)."""
    return mesh.with_points().select(*KEY, g.aabb(F.col("points"), mesh.space_dim).alias("b")).select(*KEY, "b.*")


# -- near nodes --------------------------------------------------------------------


def _used(mesh: Mesh) -> DataFrame:
    return mesh.nodes.join(mesh.used_nodes(), "node_id", "left_semi").select("node_id", *mesh.axes)


def snap_pairs(subject: Mesh, reference: Mesh, eps: float = EPS) -> DataFrame:
    """(node_id, ref_id, d2): each used node of ``subject`` with the nearest used one of ``reference`` within ``eps``; of equally near ones the smallest id."""
    if subject.space_dim != reference.space_dim:
        raise ValueError("the meshes lie in spaces of different dimensions")
    found = near_join(_used(subject), _used(reference), eps, axes=subject.axes)
    return found.groupBy("id_a").agg(F.min(F.struct("d2", "id_b")).alias("best")).select(F.col("id_a").alias("node_id"), F.col("best.id_b").alias("ref_id"), F.col("best.d2").alias("d2"))


def snap(subject: Mesh, reference: Mesh, eps: float = EPS) -> Mesh:
    """``subject`` with its used nodes moved to the nearest used node of ``reference`` within ``eps``."""
    to = reference.nodes.select(F.col("node_id").alias("ref_id"), *[F.col(a).alias(f"__{a}") for a in subject.axes])
    moved = snap_pairs(subject, reference, eps).join(to, "ref_id").select("node_id", *[f"__{a}" for a in subject.axes])
    cols = [F.coalesce(f"__{c}", c).alias(c) if c in subject.axes else F.col(c) for c in subject.nodes.columns]
    return Mesh(subject.nodes.join(moved, "node_id", "left").select(*cols), subject.elements, subject.groups)


def _greedy(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node_id, kept_id): nodes in ascending order each take the nodes near them that no smaller one took.

    A node stays unless a smaller one near it does.  That is settled in rounds over all nodes at once:
    one without an undecided smaller neighbour stays, and its larger neighbours do not.
    Then each of those goes to the smallest one near it that stays.  Well
    separated clusters need one round; a chain in order of its ids one for every two nodes.
    """
    spark = pairs.sparkSession
    near = scratch.save(pairs.select("id_a", "id_b"), "near-0")
    left, k = near, 0
    while not left.isEmpty():
        k += 1
        nodes = left.select(F.col("id_a").alias("n")).unionByName(left.select(F.col("id_b").alias("n"))).distinct()
        kept = scratch.save(nodes.join(left.select(F.col("id_b").alias("n")), "n", "left_anti"), f"kept-{k}")
        out = kept.unionByName(left.join(kept.withColumnRenamed("n", "id_a"), "id_a").select(F.col("id_b").alias("n"))).distinct()
        rest = left.join(out.withColumnRenamed("n", "id_a"), "id_a", "left_anti").join(out.withColumnRenamed("n", "id_b"), "id_b", "left_anti")
        # A node may be left without a pair: all near it are taken, and it stays as far as it ever took part.
        alone = nodes.join(out, "n", "left_anti").join(rest.select(F.col("id_a").alias("n")).unionByName(rest.select(F.col("id_b").alias("n"))), "n", "left_anti")
        scratch.save(alone, f"alone-{k}")
        before, left = k - 1, scratch.save(rest.select("id_a", "id_b"), f"near-{k}")
        if before:
            scratch.drop(f"near-{before}")
    if not k:
        return spark.createDataFrame([], "node_id bigint, kept_id bigint")
    stay = spark.read.schema("n bigint").parquet(*[scratch.path(f"{name}-{i + 1}") for i in range(k) for name in ("kept", "alone")])
    taken = near.join(stay.withColumnRenamed("n", "id_a"), "id_a").join(stay.withColumnRenamed("n", "id_b"), "id_b", "left_anti")
    gone = taken.groupBy("id_b").agg(F.min("id_a").alias("kept_id")).select(F.col("id_b").alias("node_id"), "kept_id")
    return gone.unionByName(stay.select(F.col("n").alias("node_id"), F.col("n").alias("kept_id")))


def duplicates(mesh: Mesh, eps: float = EPS, strategy: str = "greedy") -> DataFrame:
    """(node_id, kept_id): every used node that has another within ``eps``, with the one that stands for its group (itself for that one).

    ``greedy``: in ascending order of ids, each node takes all nodes within ``eps`` that
    are not taken yet; groups of one are left out.  ``component``: all nodes linked by
    steps of at most ``eps`` make one group.  They differ on chains only.
    """
    scratch = Scratch(mesh.spark, "duplicates")
    pairs = near_pairs(_used(mesh), eps, scope=None, axes=mesh.axes).select("id_a", "id_b")
    if strategy == "component":
        return star_components(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")), scratch).select(F.col("v").alias("node_id"), F.col("root").alias("kept_id"))
    if strategy != "greedy":
        raise ValueError("strategy is greedy or component")
    found = _greedy(pairs, scratch)
    several = found.where("node_id <> kept_id").select("kept_id").distinct()
    return found.join(several, "kept_id", "left_semi").select("node_id", "kept_id")


def merge_nodes(mesh: Mesh, eps: float = EPS, strategy: str = "greedy") -> Mesh:
    """The mesh whose elements use, of each group of :func:`duplicates`, its smallest node; no node is removed."""
    moved = duplicates(mesh, eps, strategy).where("node_id <> kept_id")
    one = mesh.elements.select(*KEY, F.explode("conn").alias("node_id")).distinct()
    own = one.join(moved, "node_id").groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "kept_id"))).alias("__moved"))  # an element's own nodes
    conn = F.when(F.col("__moved").isNull(), F.col("conn")).otherwise(F.transform("conn", lambda n: F.coalesce(F.try_element_at("__moved", n), n)))
    rows = mesh.elements.join(own, KEY, "left").select(*[conn.alias(c) if c == "conn" else F.col(c) for c in mesh.elements.columns])
    return Mesh(mesh.nodes, rows, mesh.groups)


# -- crossings of segments -----------------------------------------------------------


def segment_crossings(mesh: Mesh, width: float | None = None) -> DataFrame:
    """(id_a, id_b, kind, a, b, x, y): every two SEG2 elements, id_a < id_b, of a plane mesh that meet; see :func:`geometry.segment_intersection`.

    Each segment goes to the cells of a grid that its box touches; a pair is tested in
    the first cell that both share, and only there.  ``width`` of the cells is by default twice the
    mean size of the boxes.  Segments with unknown, null or infinite nodes meet nothing.
    """
    if mesh.space_dim != 2:
        raise ValueError("the mesh must lie in two dimensions")
    scratch = Scratch(mesh.spark, "crossings")
    p, q = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    ends = mesh.with_points(mesh.block("SEG2").select(*FIXED)).select("elem_id", p.alias("p"), q.alias("q"))
    known = [F.col(f"{e}.{a}") for e in "pq" for a in "xy"]
    box = [F.least("p.x", "q.x").alias("x0"), F.greatest("p.x", "q.x").alias("x1"), F.least("p.y", "q.y").alias("y0"), F.greatest("p.y", "q.y").alias("y1")]
    s = scratch.save(ends.where(finite(*known)).select("elem_id", "p", "q", *box), "segments")
    if width is None:
        mean = s.agg(F.avg((F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / 2)).first()[0]
        width = 2 * mean if mean else 1.0
    cell = lambda c: F.floor(F.col(c) / width)
    cells = s.withColumn("kx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("ky", F.explode(F.sequence(cell("y0"), cell("y1"))))
    a = cells.select("kx", "ky", *[F.col(c).alias(f"{c}_a") for c in ("elem_id", "p", "q", "x0", "x1", "y0", "y1")])
    b = cells.select("kx", "ky", *[F.col(c).alias(f"{c}_b") for c in ("elem_id", "p", "q", "x0", "x1", "y0", "y1")])
    both = a.join(b, ["kx", "ky"]).where("elem_id_a < elem_id_b and x0_a <= x1_b and x0_b <= x1_a and y0_a <= y1_b and y0_b <= y1_a")
    here = (F.col("kx") == F.floor(F.greatest("x0_a", "x0_b") / width)) & (F.col("ky") == F.floor(F.greatest("y0_a", "y0_b") / width))
    met = both.where(here).select(F.col("elem_id_a").alias("id_a"), F.col("elem_id_b").alias("id_b"), g.segment_intersection(F.col("p_a"), F.col("q_a"), F.col("p_b"), F.col("q_b")).alias("m"))
    return met.select("id_a", "id_b", "m.*").where("kind <> 'none'")
