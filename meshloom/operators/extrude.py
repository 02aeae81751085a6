"""Meshes of one dimension more: copies of the nodes along a line, joined by elements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom import etypes
from meshloom.functions.geometry import AXES
from meshloom.mesh import Mesh

#: Planes written into the plan; more are joined.
INLINE_AXIS = 4_096

# The type that each type becomes.
BECOMES = {"VERTEX": "SEG2", "SEG2": "QUAD4", "QUAD4": "HEX8"}


def _axis(mesh: Mesh) -> str:
    if mesh.space_dim == 3:
        raise ValueError("a mesh in three dimensions has no further axis")
    return AXES[mesh.space_dim]


def _copies(mesh: Mesh, rows: Sequence[tuple[float, ...]], coords: Callable[[Callable[[int], Column]], list[Column]]) -> DataFrame:
    """The nodes once a plane, with k, its number; ``coords`` makes the coordinates from the values of its row."""
    n = mesh.nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))))
    if len(rows) <= INLINE_AXIS:
        at = lambda c: F.get(F.array(*[F.lit(float(r[c])) for r in rows]), F.col("k"))
    else:
        names = ", ".join(f"__v{c} double" for c in range(len(rows[0])))
        n = n.join(mesh.spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], f"k int, {names}"), "k")
        at = lambda c: F.col(f"__v{c}")
    spare = [c for c in mesh.nodes.columns if c not in ("node_id", *mesh.axes)]
    return n.select("node_id", "k", *[c.alias(a) for a, c in zip(AXES, coords(at))], *spare)


def _planes(mesh: Mesh, rows: Sequence[tuple[float, ...]], coords: Callable[[Callable[[int], Column]], list[Column]]) -> Mesh:
    """The mesh between copies of the nodes, one a row; with a single row the flat mesh."""
    count, copies = len(rows), _copies(mesh, rows, coords)
    if count == 1:
        return Mesh(copies.drop("k"), mesh.elements, mesh.groups)
    top = mesh.nodes.agg(F.max("node_id")).first()[0]
    step = 0 if top is None else top + 1
    per_type = mesh.elements.groupBy("etype").agg(F.max("elem_id")).collect()  # 17 rows at most
    n = copies.withColumn("node_id", F.col("node_id") + F.col("k") * step).drop("k")

    kind = F.col("etype")
    stride = F.lit(0).cast("long")
    for r in per_type:
        stride = F.when(kind == r[0], F.lit(r[1] + 1)).otherwise(stride)
    new = F.raise_error(F.concat(F.lit("no extrusion of "), kind))
    for a, b in BECOMES.items():
        new = F.when(kind == a, F.lit(b)).otherwise(new)
    # An edge's upper side runs back, so that the quadrangle goes round.
    lower = F.transform("conn", lambda i: i + F.col("k") * step)
    upper = F.transform("conn", lambda i: i + (F.col("k") + 1) * step)
    conn = F.concat(lower, F.when(kind == "SEG2", F.reverse(upper)).otherwise(upper))
    layers = F.explode(F.sequence(F.lit(0), F.lit(count - 2)))
    e = mesh.elements.select("etype", "elem_id", "conn", "family", layers.alias("k")).select(new.alias("etype"), (F.col("elem_id") + F.col("k") * stride).alias("elem_id"), conn.alias("conn"), "family")
    kind = F.col("etype")
    return Mesh(n, e.select("etype", etypes.ord_of(kind).alias("etype_ord"), etypes.dim_of(kind).alias("dim"), "elem_id", "conn", "family"))


def extrude(mesh: Mesh, along: Sequence[float]) -> Mesh:
    """Along a new axis, a copy of the nodes at each value: VERTEX becomes SEG2, SEG2 QUAD4, QUAD4 HEX8; other types fail when read.

    Fields and groups are dropped, families kept.  No values give the mesh as it is; one value gives the flat mesh with the new axis.
    """
    axis = _axis(mesh)
    if not len(along):
        return mesh
    return _planes(mesh, [(v,) for v in along], lambda at: [F.col(a) for a in mesh.axes] + [at(0).alias(axis)])


def extrude_parallel(mesh: Mesh, along: Sequence[Sequence[float]]) -> Mesh:
    """Planes moved by the line, relative to its first point on the old axes; the last coordinate of each point is the plane's place on the new axis."""
    _axis(mesh)
    d = mesh.space_dim + 1
    line = np.asarray(along, dtype=float).reshape(-1, d)
    if not len(line):
        return mesh
    rows = [(*(p - line[0])[:-1], p[-1]) for p in line]
    return _planes(mesh, rows, lambda at: [F.col(a) + at(i) for i, a in enumerate(mesh.axes)] + [at(d - 1)])


def rotation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shortest rotation that takes direction ``a`` to ``b``; a half turn if they are opposite."""
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    c = float(a @ b)
    if c > 0.999999:
        return np.eye(3)
    if c < -0.999999:
        u = np.cross(a, np.eye(3)[int(np.argmin(np.abs(a)))])
        u /= np.linalg.norm(u)
        return 2 * np.outer(u, u) - np.eye(3)
    v = np.cross(a, b)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def extrude_curv(mesh: Mesh, along: Sequence[Sequence[float]]) -> Mesh:
    """Planes that follow a line in space and turn with its direction, about the mean of the nodes.

    A turn about the mean leaves the mean in place, so every plane is one affine map of
    the first: only the mean is read from the nodes.  The direction at a point
    is that between its neighbours on the line.  One point gives the flat mesh.
    """
    if mesh.space_dim != 2:
        raise ValueError("the mesh must lie in two dimensions")
    line = np.asarray(along, dtype=float).reshape(-1, 3)
    if not len(line):
        return mesh
    mean = mesh.nodes.agg(F.avg("x"), F.avg("y")).first()
    centre = np.array([mean[0] or 0.0, mean[1] or 0.0, line[0, 2]])
    ahead = np.vstack([line[1:], line[-1:]]) - np.vstack([line[:1], line[:-1]])
    before, turn, rows = np.array([0.0, 0.0, 1.0]), np.eye(3), []
    for k, p in enumerate(line):
        if len(line) > 1:
            turn = rotation(before, ahead[k]) @ turn
            before = ahead[k]
        shift = centre + (p - line[0]) - turn @ centre
        rows.append((*turn.ravel(), *shift))
    old = [F.col("x"), F.col("y"), F.lit(float(line[0, 2]))]
    return _planes(mesh, rows, lambda at: [at(3 * i) * old[0] + at(3 * i + 1) * old[1] + at(3 * i + 2) * old[2] + at(9 + i) for i in range(3)])
