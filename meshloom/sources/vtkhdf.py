"""Unstructured grids in VTKHDF files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from meshloom.mesh import Mesh
from meshloom.sources import files, hdf5, parts


def write(mesh: Mesh, path: str) -> None:
    """One piece of an unstructured grid, without fields; types that VTK lacks here are refused."""
    c = files._Cells(mesh)
    one = lambda n: np.array([n], dtype=np.int64)
    raw = lambda kind: lambda v: np.ascontiguousarray(v).astype(kind).tobytes()

    def offsets(sink: parts.Sink) -> None:
        sink.put(bytes(8))
        c.ends(sink, raw("<i8"))

    later = lambda shape, kind, how: hdf5.Later(shape, np.dtype(kind), how)
    grid = hdf5.Group(
        {
            "NumberOfPoints": one(c.n_nodes),
            "NumberOfCells": one(c.n),
            "NumberOfConnectivityIds": one(c.n_ids),
            "Points": later((c.n_nodes, 3), "<f8", lambda s: c.points(s, raw("<f8"))),
            "Types": later((c.n,), "u1", lambda s: c.codes(s, raw("u1"))),
            "Offsets": later((c.n + 1,), "<i8", offsets),
            "Connectivity": later((c.n_ids,), "<i8", lambda s: c.conn(s, raw("<i8"))),
        },
        {"Version": np.array([2, 0], dtype=np.int64), "Type": "UnstructuredGrid"},
    )
    with parts.Sink(mesh.spark, path) as sink:
        for piece in hdf5.pieces(hdf5.Group({"VTKHDF": grid})):
            if isinstance(piece, hdf5.Later):
                piece.write(sink)
            else:
                sink.put(piece)


def _grid(g: hdf5.Group) -> hdf5.Group | None:
    """The group itself if it is an unstructured grid, or the first such member."""
    if g.attributes.get("Type") == "UnstructuredGrid":
        return g
    for name in sorted(g.members):
        if isinstance(g.members[name], hdf5.Group) and (found := _grid(g.members[name])):
            return found
    return None


def read(spark: SparkSession, path: str) -> Mesh:
    """The first unstructured grid of the file, its first piece; fields are not read."""
    top = hdf5.far(spark, path).members.get("VTKHDF")
    grid = _grid(top) if isinstance(top, hdf5.Group) else None
    if grid is None:
        raise ValueError("the file holds no unstructured grid")
    m = grid.members
    n, cells, ids = (int(m[k][0]) for k in ("NumberOfPoints", "NumberOfCells", "NumberOfConnectivityIds"))
    points, codes, offsets, conn = (_numbers(m[k]) for k in ("Points", "Types", "Offsets", "Connectivity"))
    return files.from_cells(spark, points, n, codes, cells, lambda i, j: offsets.part(i, j + 1, np.int64), conn, ids)


def _numbers(v: np.ndarray | hdf5.Far) -> parts.Numbers:
    if isinstance(v, hdf5.Far):
        return v.numbers
    out = parts.Numbers()
    out.add(v.ravel().tolist())
    return out


def datasets(data: bytes) -> dict[str, np.ndarray]:
    """Arrays by path, as they lie in the file."""
    out: dict[str, np.ndarray] = {}

    def walk(g: hdf5.Group, at: str) -> None:
        for name, v in g.members.items():
            if isinstance(v, hdf5.Group):
                walk(v, f"{at}{name}/")
            else:
                out[at + name] = v

    walk(hdf5.load(data), "")
    return out
