"""Sub-entities of elements, and who owns them: one explode and one aggregation by node set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom import etypes
from meshloom.functions.geometry import split_faces
from meshloom.mesh import Mesh
from meshloom.operators.numbering import number_within_groups
from meshloom.runtime import Scratch

_SUBS = "array<array<bigint>>"


def element_key(ord_col: Column, elem_id: Column) -> Column:
    """One bigint for (type, id), ordered by type, then id; ids below 2**58."""
    return F.shiftleft(ord_col.cast("long"), 58) + elem_id


def key_parts(key: Column) -> tuple[Column, Column]:
    """Type and id of an element key."""
    number = F.shiftright(key, 58)
    names = F.array(*[F.lit(t) for t in etypes.TYPES])
    return F.get(names, number.cast("int")), key - F.shiftleft(number, 58)


def _dims(mesh: Mesh, src_dim: int | None, target_dim: int | None) -> tuple[int, int]:
    src = mesh.topological_dim if src_dim is None else etypes.step_dim(int(src_dim), 0)
    if src is None:
        src = 1  # no element at all: any dimension gives no rows
    target = src - 1 if target_dim is None else int(target_dim)
    if not 0 <= target < src:
        raise ValueError(f"elements of dimension {src} have no sub-entities of dimension {target}")
    return src, target


def _patterns(codim: int, conn: Column, etype: Column, dim: int) -> tuple[Column, Column]:
    """The array of sub-entities of a row, and their type."""
    n = F.size(conn)
    subs: dict[str, tuple[Column, str]] = {}
    for (name, c), (sub, pattern) in etypes.SUBENTITIES.items():
        if c == codim and etypes.TYPES[name].dim == dim:
            subs[name] = (F.array(*[F.array(*[F.get(conn, F.lit(k)) for k in place]) for place in etypes.places(pattern)]), sub)
    if dim == 2 and codim == 1:
        after = lambda i: F.get(conn, F.when(i == n - 1, 0).otherwise(i + 1))
        subs["PGON"] = (F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get(conn, i), after(i))), "SEG2")
    if dim == 2 and codim == 2:
        subs["PGON"] = (F.transform(conn, lambda k: F.array(k)), "VERTEX")
    if dim == 3 and codim == 1:
        subs["PHED"] = (split_faces(conn, etypes.FACE_END), "PGON")
    missing = F.raise_error(F.concat(F.lit(f"no sub-entities of codimension {codim} for "), etype))
    arrays, names = missing.cast(_SUBS), F.lit(None).cast("string")
    for name, (array, sub) in subs.items():
        arrays = F.when(etype == name, array).otherwise(arrays)
        names = F.when(etype == name, F.lit(sub)).otherwise(names)
    return arrays, names


def subentities(mesh: Mesh, src_dim: int | None = None, target_dim: int | None = None) -> DataFrame:
    """(elem_key, etype, elem_id, pos, sub_etype, sub_conn, node_set): the sub-entities of each element, in their local order.

    From one dimension (by default the highest) to a lower one (by default the next).
    Types without a table of sub-entities fail when they are read.
    """
    src, target = _dims(mesh, src_dim, target_dim)
    arrays, names = _patterns(src - target, F.col("conn"), F.col("etype"), src)
    e = mesh.of_dim(src)
    one = e.select(element_key(F.col("etype_ord"), F.col("elem_id")).alias("elem_key"), "etype", "elem_id", names.alias("sub_etype"), F.posexplode(arrays).alias("pos", "sub_conn"))
    return one.withColumn("node_set", F.array_sort("sub_conn"))


def owners(mesh: Mesh, src_dim: int | None = None, target_dim: int | None = None) -> DataFrame:
    """(node_set, n_owners, elem_key, pos, sub_etype, sub_conn): the distinct sub-entities, as they first occur, and how often they do.

    Identity is the set of nodes; the first occurrence, by type, id and local place, gives
    the orientation.  Counts are combined before the one shuffle.
    """
    first = F.min(F.struct("elem_key", "pos", "sub_etype", "sub_conn")).alias("f")
    return subentities(mesh, src_dim, target_dim).groupBy("node_set").agg(F.count("*").alias("n_owners"), first).select("node_set", "n_owners", "f.*")


def _numbered(found: DataFrame) -> DataFrame:
    """With ``elem_id``: dense in each type, by first occurrence."""
    return number_within_groups(found.withColumnRenamed("sub_etype", "etype"), ["etype"], ["elem_key", "pos"], "elem_id", scratch=Scratch(found.sparkSession, "subentities"))


def _as_mesh(mesh: Mesh, numbered: DataFrame) -> Mesh:
    kind = F.col("etype")
    rows = numbered.select("etype", etypes.ord_of(kind).alias("etype_ord"), etypes.dim_of(kind).alias("dim"), F.col("elem_id").cast("long").alias("elem_id"), F.col("sub_conn").alias("conn"), F.lit(0).cast("long").alias("family"))
    return Mesh(mesh.nodes, rows)


def descend(mesh: Mesh, src_dim: int | None = None, target_dim: int | None = None) -> Mesh:
    """The mesh of the distinct sub-entities; it shares the nodes."""
    return _as_mesh(mesh, _numbered(owners(mesh, src_dim, target_dim)))


def with_n_neighbours(mesh: Mesh, n: int, src_dim: int | None = None, target_dim: int | None = None) -> Mesh:
    """The sub-entities that occur exactly ``n`` times."""
    return _as_mesh(mesh, _numbered(owners(mesh, src_dim, target_dim).where(F.col("n_owners") == int(n))))


def boundaries(mesh: Mesh, src_dim: int | None = None, target_dim: int | None = None) -> Mesh:
    """The sub-entities of exactly one element.

    Two dimensions below the elements these are the edges of a single volume, not the edges of the boundary faces.
    """
    return with_n_neighbours(mesh, 1, src_dim, target_dim)


def descend_update(mesh: Mesh, src_dim: int | None = None, target_dim: int | None = None) -> tuple[Mesh, Mesh]:
    """:func:`descend`, set into the mesh in place of its elements of that dimension, which come out too."""
    return mesh.update(descend(mesh, src_dim, target_dim))


def boundaries_update(mesh: Mesh, src_dim: int | None = None, target_dim: int | None = None) -> tuple[Mesh, Mesh]:
    return mesh.update(boundaries(mesh, src_dim, target_dim))


def incidence_by_nodes(mesh: Mesh, src_dim: int | None = None, target_dim: int | None = None) -> DataFrame:
    """(node_set, etype, elem_id): each sub-entity, by its nodes, with each of its elements, one a row: no list grows with the owners."""
    return subentities(mesh, src_dim, target_dim).select("node_set", "etype", "elem_id").distinct()


def incidence(mesh: Mesh, src_dim: int | None = None, target_dim: int | None = None) -> tuple[Mesh, DataFrame]:
    """:func:`descend`, and (sub_etype, sub_id, etype, elem_id): each sub-entity with each of its elements."""
    numbered = _numbered(owners(mesh, src_dim, target_dim))
    rows = incidence_by_nodes(mesh, src_dim, target_dim).join(numbered.select("node_set", F.col("etype").alias("sub_etype"), F.col("elem_id").alias("sub_id")), "node_set")
    return _as_mesh(mesh, numbered), rows.select("sub_etype", "sub_id", "etype", "elem_id")


def simplexes(mesh: Mesh) -> DataFrame:
    """(etype, elem_id, pos, simplex, conn): each element cut into segments, triangles or tetrahedra, high-order types by their corners.

    Polygons, polyhedra and splines have no table and fail when they are read.
    """
    conn, etype = F.col("conn"), F.col("etype")
    arrays = F.raise_error(F.concat(F.lit("no simplexes for "), etype)).cast(_SUBS)
    names = F.lit(None).cast("string")
    for name, (sub, pattern) in etypes.SIMPLEXES.items():
        arrays = F.when(etype == name, F.array(*[F.array(*[F.get(conn, F.lit(k)) for k in place]) for place in etypes.places(pattern)])).otherwise(arrays)
        names = F.when(etype == name, F.lit(sub)).otherwise(names)
    return mesh.elements.select("etype", "elem_id", names.alias("simplex"), F.posexplode(arrays).alias("pos", "conn"))
