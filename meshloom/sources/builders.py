"""Structured grids, computed by arithmetic on the row number, without a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from meshloom import etypes
from meshloom.functions.geometry import AXES
from meshloom.mesh import Mesh

_GRIDS = {1: "SEG2", 2: "QUAD4", 3: "HEX8"}


#: Values of an axis written into the plan; a longer axis is joined.
INLINE_AXIS = 4_096


def _lookup(values: Sequence[float], at: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), at.cast("int"))


def grid(spark: SparkSession, *axes: Sequence[float]) -> Mesh:
    """Segments, quadrangles or hexahedra on the product of one to three lists of coordinates; x runs fastest.

    A list of fewer than two values has no cell.
    """
    if not 1 <= len(axes) <= 3:
        raise ValueError("a grid has one to three axes")
    n = [len(a) for a in axes]
    nodes, cells = 1, 1
    for k in n:
        nodes, cells = nodes * k, cells * max(k - 1, 0)
    strides, cell_strides, s, c = [], [], 1, 1
    for k in n:
        strides.append(s)
        cell_strides.append(c)
        s, c = s * k, c * max(k - 1, 1)
    i = F.col("id")
    place = lambda step, size: F.expr(f"(id div {step}) % {size}")
    points, coords = spark.range(nodes), []
    for d, a in enumerate(axes):
        at = place(strides[d], n[d])
        if n[d] <= INLINE_AXIS:
            coords.append(_lookup(a, at).alias(AXES[d]))
        else:
            values = spark.createDataFrame([(k, float(v)) for k, v in enumerate(a)], f"__k{d} bigint, {AXES[d]} double")
            points = points.join(values, at == F.col(f"__k{d}"))
            coords.append(F.col(AXES[d]))
    points = points.select(i.alias("node_id"), *coords)
    corner = sum((place(cell_strides[d], max(n[d] - 1, 1)) * strides[d] for d in range(1, len(axes))), place(1, max(n[0] - 1, 1)))
    face = [0, 1] if len(axes) == 1 else [0, 1, 1 + n[0], n[0]]
    ends = face if len(axes) < 3 else face + [k + strides[2] for k in face]
    kind = etypes.etype(_GRIDS[len(axes)])
    rows = spark.range(cells).select(
        F.lit(kind.name).alias("etype"),
        F.lit(kind.ord).cast("tinyint").alias("etype_ord"),
        F.lit(kind.dim).cast("tinyint").alias("dim"),
        i.alias("elem_id"),
        F.array(*[corner + F.lit(k).cast("long") for k in ends]).alias("conn"),
        F.lit(0).cast("long").alias("family"),
    )
    return Mesh(points, rows)


class GridBuilder:
    """``GridBuilder(spark).add_axis([0, 1]).add_axis([0, 1]).build()``."""

    def __init__(self, spark: SparkSession, axes: tuple[tuple[float, ...], ...] = ()):
        self.spark, self.axes = spark, axes

    def add_axis(self, values: Sequence[float]) -> GridBuilder:
        if len(self.axes) == 3:
            raise ValueError("a grid has one to three axes")
        return GridBuilder(self.spark, (*self.axes, tuple(values)))

    def build(self) -> Mesh:
        return grid(self.spark, *self.axes)


def sample_mixed(spark: SparkSession) -> Mesh:
    """Ten nodes in space with triangles, quadrangles and a hexahedron."""
    m = Mesh.from_coords(spark, [(3 * k, 3 * k + 1, 3 * k + 2) for k in range(10)])
    block = lambda conns: spark.createDataFrame(list(enumerate(conns)), "elem_id bigint, conn array<bigint>")
    m = m.add_block("TRI3", block([[0, 1, 2], [1, 2, 3], [2, 3, 4]]))
    m = m.add_block("QUAD4", block([[0, 1, 2, 3], [4, 5, 6, 7]]))
    return m.add_block("HEX8", block([list(range(8))]))


def sample_grid(spark: SparkSession, dim: int = 2, points: int = 5) -> Mesh:
    """A regular grid of the unit square or cube."""
    axis = [k / (points - 1) for k in range(points)]
    return grid(spark, *[axis] * dim)
