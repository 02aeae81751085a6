"""A mesh as numpy arrays on the driver, for formats and libraries that take a whole mesh, and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom import etypes
from meshloom.functions.geometry import AXES
from meshloom.mesh import FIXED, KEY, Mesh
from meshloom.operators.numbering import number_within_groups
from meshloom.operators.topology import element_key
from meshloom.runtime import Scratch


def dense(mesh: Mesh) -> Mesh:
    """The mesh with nodes numbered from 0 in order of their ids, and elements in each type likewise.

    An element with an unknown node is left out, as no file can hold it.  The old ids of elements are in ``orig_elem_id``.
    """
    scratch = Scratch(mesh.spark, "dense")
    nodes = number_within_groups(mesh.nodes, [], ["node_id"], "__dense", scratch=Scratch(mesh.spark, "dense-nodes"))
    e = mesh.elements
    # An element's type and id in one number, and a node's place with the size of its element in another, to shuffle less.
    key, place = element_key(etypes.ord_of(F.col("etype")), F.col("elem_id")), F.shiftleft(F.col("__at").cast("long"), 32) + F.col("__n")
    one = e.select(key.alias("__key"), F.size("conn").alias("__n"), F.posexplode("conn").alias("__at", "node_id")).select("__key", place.alias("__place"), "node_id")
    ends = one.where(F.col("node_id") == etypes.FACE_END).select("__key", "__place", F.lit(etypes.FACE_END).cast("long").alias("__dense"))
    known = one.join(nodes.select("node_id", "__dense"), "node_id").select("__key", "__place", "__dense").unionByName(ends)
    conn = known.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__place", "__dense"))).alias("__c"))
    conn = conn.where(F.size("__c") == F.col("__c")[0]["__place"].bitwiseAND((1 << 32) - 1)).select("__key", F.transform("__c", lambda s: s["__dense"]).alias("conn"))
    moved = e.drop("conn").withColumn("__key", key).join(conn, "__key")
    rows = number_within_groups(moved.select(*e.columns), ["etype"], ["elem_id"], "__new", scratch=scratch)
    mesh.spark.sparkContext._jvm.System.gc()  # the cleaner removes shuffle files when the driver's garbage is collected
    rows = rows.withColumnRenamed("elem_id", "orig_elem_id").withColumnRenamed("__new", "elem_id")
    fresh = nodes.drop("node_id").withColumnRenamed("__dense", "node_id").select(*mesh.nodes.columns)
    return Mesh(fresh, rows, mesh.groups)


@dataclass
class Block:
    conn: np.ndarray  # flat
    sizes: np.ndarray
    families: np.ndarray
    fields: dict[str, np.ndarray] = field(default_factory=dict)
    groups: dict[str, list[int]] = field(default_factory=dict)

    def matrix(self) -> np.ndarray:
        return self.conn.reshape(len(self.sizes), -1) if len(self.sizes) else self.conn.reshape(0, 0)

    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)


@dataclass
class Arrays:
    coords: np.ndarray
    blocks: dict[str, Block]

    def matrix3(self) -> np.ndarray:
        """Coordinates in space, missing axes 0."""
        return np.hstack([self.coords, np.zeros((len(self.coords), 3 - self.coords.shape[1]))])


def to_arrays(mesh: Mesh, fields: Sequence[str] | bool = True, is_dense: bool = False) -> Arrays:
    """The whole mesh in the driver's memory: nodes and elements in dense order; see :func:`dense`."""
    m = mesh if is_dense else dense(mesh)
    names = m.field_names() if fields is True else [] if fields is False else list(fields)
    n = m.nodes.orderBy("node_id").select(*[F.col(a).cast("double").alias(a) for a in m.axes]).toArrow()
    coords = np.column_stack([n[a].to_numpy(zero_copy_only=False) for a in m.axes]) if n.num_rows else np.zeros((0, m.space_dim))
    groups: dict[str, dict[str, list[int]]] = {}
    for r in m.groups.select("etype", "group_name", "family").distinct().orderBy("etype", "group_name", "family").collect():  # names, not elements
        groups.setdefault(r[0], {}).setdefault(r[1], []).append(r[2])
    blocks = {}
    for t in m.block_types():
        rows = m.block(t).orderBy("elem_id").select("conn", "family", *names).toArrow()
        conn = rows["conn"].combine_chunks()
        sizes = conn.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        own = {}
        for f in names:
            col = rows[f].combine_chunks()
            if col.null_count == len(col):
                continue
            is_list = pa.types.is_list(col.type)
            own[f] = np.stack(col.to_pylist()) if is_list else col.to_numpy(zero_copy_only=False).astype(float)
        blocks[t] = Block(conn.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes, rows["family"].to_numpy(zero_copy_only=False).astype(np.int64), own, groups.get(t, {}))
    return Arrays(coords, blocks)


@dataclass
class Kind:
    """What a block holds: elements, ids in their connectivity, and the fields with a value, by the length of their vectors (0: plain numbers)."""

    n: int
    n_ids: int
    fields: dict[str, int]
    groups: dict[str, list[int]] = field(default_factory=dict)


def kinds(m: Mesh, names: Sequence[str]) -> dict[str, Kind]:
    """The blocks of a dense mesh, in order of their types, counted by tasks."""
    types = dict(m.elements.dtypes)
    vectors = [f for f in names if types[f].startswith("array")]
    length = [c for f in vectors for c in (F.min(F.size(f)).alias(f"__min_{f}"), F.max(F.size(f)).alias(f"__max_{f}"))]
    rows = m.elements.groupBy("etype").agg(F.count("*").alias("__n"), F.sum(F.size("conn")).alias("__ids"), *[F.count(f).alias(f"__of_{f}") for f in names], *length).collect()  # 17 at most
    found = {r["etype"]: r for r in rows}
    out = {}
    for t in (t for t in etypes.TYPES if t in found):
        r, own = found[t], {}
        for f in names:
            if not r[f"__of_{f}"]:
                continue
            if f in vectors and (r[f"__of_{f}"] < r["__n"] or r[f"__min_{f}"] != r[f"__max_{f}"]):
                raise ValueError(f"the vectors of {f} in {t} differ in length")
            own[f] = r[f"__max_{f}"] if f in vectors else 0
        out[t] = Kind(r["__n"], r["__ids"], own)
    for r in m.groups.select("etype", "group_name", "family").distinct().orderBy("etype", "group_name", "family").collect():  # names, not elements
        if r[0] in out:
            out[r[0]].groups.setdefault(r[1], []).append(r[2])
    return out


def from_arrays(spark: SparkSession, arrays: Arrays) -> Mesh:
    """A mesh of arrays; elements of each type are numbered from 0."""
    dim = arrays.coords.shape[1]
    if not 1 <= dim <= 3:
        raise ValueError("points have one to three coordinates")
    nodes = pa.table({"node_id": np.arange(len(arrays.coords), dtype=np.int64), **{a: np.ascontiguousarray(arrays.coords[:, k], dtype=float) for k, a in enumerate(AXES[:dim])}})
    mesh = Mesh(spark.createDataFrame(nodes))
    elements: DataFrame | None = None
    groups = []
    for t, b in arrays.blocks.items():
        kind = etypes.etype(t)
        if kind.n_nodes is not None and len(b.sizes) and set(b.sizes.tolist()) != {kind.n_nodes}:
            raise ValueError(f"an element of {t} has {kind.n_nodes} nodes")
        n = len(b.sizes)
        conn = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(b.sizes)].astype(np.int32)), pa.array(b.conn.astype(np.int64)))
        cols = {"etype": pa.array([t] * n, pa.string()), "elem_id": pa.array(np.arange(n, dtype=np.int64)), "conn": conn, "family": pa.array(b.families.astype(np.int64))}
        for f, v in b.fields.items():
            if f in FIXED:
                raise ValueError(f"{f!r} is no name of a field")
            cols[f] = pa.array(v.astype(float)) if v.ndim == 1 else pa.array(v.reshape(n, -1).astype(float).tolist(), pa.list_(pa.float64()))
        rows = spark.createDataFrame(pa.table(cols)).select("etype", etypes.ord_of(F.col("etype")).alias("etype_ord"), etypes.dim_of(F.col("etype")).alias("dim"), "elem_id", "conn", "family", *b.fields)
        elements = rows if elements is None else elements.unionByName(rows, allowMissingColumns=True)
        groups += [(t, name, int(f)) for name, families in b.groups.items() for f in families]
    return Mesh(mesh.nodes, elements, spark.createDataFrame(groups, "etype string, group_name string, family bigint") if groups else None)


# -- exports to other libraries ------------------------------------------------------


def _chosen(arrays: Arrays, dim: int | str | None) -> dict[str, Block]:
    kinds = [t for t in etypes.TYPES if t in arrays.blocks]
    if dim is None:
        dim = max((etypes.TYPES[t].dim for t in kinds), default=0)
    return {t: arrays.blocks[t] for t in kinds if dim == "all" or etypes.TYPES[t].dim == int(dim)}


def _code(table: dict[str, int], etype: str, target: str) -> int:
    if etype not in table:
        raise ValueError(f"{target} has no cells like {etype}")
    return table[etype]


def _prefixed(b: Block, heads: np.ndarray) -> np.ndarray:
    """The flat connectivity with a number before each element."""
    return np.insert(b.conn, np.r_[0, b.ends()[:-1]] if len(b.sizes) else np.zeros(0, int), heads)


def vtk_cells(arrays: Arrays, dim: int | str | None = None, fields: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(cells, each with its size before it; cell codes; points in space; fields as NaN-filled columns)."""
    chosen = _chosen(arrays, dim)
    codes = {**{t: c for t, c in etypes.VTK_CODES.items() if t != "PHED"}, **etypes.QUADRATIC_CODES}
    kinds = [np.full(len(b.sizes), _code(codes, t, "VTK")) for t, b in chosen.items()]
    cells = [_prefixed(b, b.sizes) for b in chosen.values()]
    names = sorted({f for b in chosen.values() for f, v in b.fields.items() if v.ndim == 1}) if fields else []
    data = {f: np.concatenate([b.fields.get(f, np.full(len(b.sizes), np.nan)) for b in chosen.values()]) for f in names}
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return join(cells), join(kinds), arrays.matrix3(), data


def vtk_rows(mesh: Mesh, fields: Sequence[str] = ()) -> DataFrame:
    """(etype, elem_id, code, cell, fields): what :func:`vtk_cells` gives of all dimensions, a row a cell, without a driver that holds it."""
    m = dense(mesh)
    codes = {**{t: c for t, c in etypes.VTK_CODES.items() if t != "PHED"}, **etypes.QUADRATIC_CODES}
    own = {t: _code(codes, t, "VTK") for t in m.block_types()}
    code = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col("etype")] if own else F.lit(None).cast("int")
    cell = F.concat(F.array(F.size("conn").cast("long")), F.col("conn"))
    return m.elements.select("etype", "elem_id", code.alias("code"), cell.alias("cell"), *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f) for f in fields])


def med_cells(arrays: Arrays, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(flat connectivity, each element with its type's code before it; starts of the elements, and the end)."""
    chosen = _chosen(arrays, dim)
    conn = [_prefixed(b, np.full(len(b.sizes), _code(etypes.MED_CODES, t, "MED"))) for t, b in chosen.items()]
    sizes = np.concatenate([b.sizes + 1 for b in chosen.values()]) if chosen else np.zeros(0, np.int64)
    return (np.concatenate(conn) if conn else np.zeros(0, np.int64)), np.r_[0, np.cumsum(sizes)]


def meshio_cells(arrays: Arrays) -> list[tuple[str, np.ndarray]]:
    """(name, matrix of nodes) a type."""
    return [(etypes.MESHIO_NAMES[t], b.matrix()) for t, b in arrays.blocks.items() if _code(etypes.VTK_CODES | etypes.QUADRATIC_CODES, t, "meshio") and t in etypes.MESHIO_NAMES]


def to_pyvista(mesh: Mesh, dim: int | str | None = None, with_fields: Sequence[str] | bool = True):
    """A pyvista.UnstructuredGrid; pyvista must be installed."""
    import pyvista as pv

    cells, kinds, points, data = vtk_cells(to_arrays(mesh, with_fields), dim)
    out = pv.UnstructuredGrid(cells, kinds, points)
    for name, values in data.items():
        out.cell_data[name] = values
    return out


def to_meshio(mesh: Mesh):
    """A meshio.Mesh without fields; meshio must be installed."""
    import meshio

    arrays = to_arrays(mesh, False)
    return meshio.Mesh(arrays.coords, meshio_cells(arrays))


def to_medcoupling(mesh: Mesh, dim: int | None = None):
    """A MEDCouplingUMesh of one dimension; medcoupling must be installed."""
    import medcoupling as mc

    arrays = to_arrays(mesh, False)
    conn, starts = med_cells(arrays, dim)
    out = mc.MEDCouplingUMesh()
    out.setCoords(mc.DataArrayDouble(arrays.coords))
    out.setConnectivity(mc.DataArrayInt(conn), mc.DataArrayInt(starts))
    out.setName("mesh")
    return out
