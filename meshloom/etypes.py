"""The closed set of element types and their fixed tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends each face but the last in the connectivity of a PHED.
FACE_END = -1


@dataclass(frozen=True)
class ElementType:
    name: str
    ord: int
    dim: int
    n_nodes: int | None  # None: as many as the row has

    @property
    def is_poly(self) -> bool:
        return self.n_nodes is None


# Type, topological dimension, nodes (None for poly types), in their order.
_TYPES = [
    ("VERTEX", 0, 1),
    ("SEG2", 1, 2),
    ("SEG3", 1, 3),
    ("SEG4", 1, 4),
    ("SPLINE", 1, None),
    ("TRI3", 2, 3),
    ("TRI6", 2, 6),
    ("TRI7", 2, 7),
    ("QUAD4", 2, 4),
    ("QUAD8", 2, 8),
    ("QUAD9", 2, 9),
    ("PGON", 2, None),
    ("TET4", 3, 4),
    ("TET10", 3, 10),
    ("HEX8", 3, 8),
    ("HEX21", 3, 21),
    ("PHED", 3, None),
]
TYPES = {name: ElementType(name, k, dim, n) for k, (name, dim, n) in enumerate(_TYPES)}

# Sub-entities by (type, codimension): their type, and the places of their nodes in the element.
SUBENTITIES = {
    ("SEG2", 1): ("VERTEX", "0 1"),
    ("SEG3", 1): ("VERTEX", "0 1"),
    ("SEG4", 1): ("VERTEX", "0 1"),
    ("TRI3", 1): ("SEG2", "01 12 20"),
    ("TRI3", 2): ("VERTEX", "0 1 2"),
    ("TRI6", 1): ("SEG3", "013 124 205"),
    ("TRI6", 2): ("VERTEX", "0 1 2"),
    ("TRI7", 1): ("SEG3", "013 124 205"),
    ("TRI7", 2): ("VERTEX", "0 1 2"),
    ("QUAD4", 1): ("SEG2", "01 12 23 30"),
    ("QUAD4", 2): ("VERTEX", "0 1 2 3"),
    ("TET4", 1): ("TRI3", "012 123 230 301"),
    ("TET4", 2): ("SEG2", "01 02 03 12 13 23"),
    ("TET4", 3): ("VERTEX", "0 1 2 3"),
    ("HEX8", 1): ("QUAD4", "0123 0374 0451 1562 2673 4765"),
    ("HEX8", 2): ("SEG2", "01 03 04 12 15 23 26 37 45 47 56 67"),
    ("HEX8", 3): ("VERTEX", "0 1 2 3 4 5 6 7"),
}

# Simplexes of a type, high-order types by their corners.
SIMPLEXES = {
    "SEG2": ("SEG2", "01"),
    "SEG3": ("SEG2", "01"),
    "SEG4": ("SEG2", "01"),
    "TRI3": ("TRI3", "012"),
    "TRI6": ("TRI3", "012"),
    "TRI7": ("TRI3", "012"),
    "QUAD4": ("TRI3", "013 231"),
    "QUAD8": ("TRI3", "013 231"),
    "QUAD9": ("TRI3", "013 231"),
    "TET4": ("TET4", "0123"),
    "TET10": ("TET4", "0123"),
    "HEX8": ("TET4", "0134 2316 7643 5461 4631"),
    "HEX21": ("TET4", "0134 2316 7643 5461 4631"),
    "VERTEX": ("VERTEX", "0"),
}

# Cell codes of file formats and names in other libraries.
VTK_CODES = {"VERTEX": 1, "SEG2": 3, "TRI3": 5, "PGON": 7, "QUAD4": 9, "TET4": 10, "HEX8": 12, "PHED": 42}
MED_CODES = {"VERTEX": 0, "SEG2": 1, "SEG3": 2, "TRI3": 3, "TRI6": 6, "QUAD4": 4, "QUAD8": 8, "TET4": 14, "TET10": 20, "HEX8": 18}
MESHIO_NAMES = {"VERTEX": "vertex", "SEG2": "line", "SEG3": "line3", "TRI3": "triangle", "TRI6": "triangle6", "QUAD4": "quad", "QUAD8": "quad8", "TET4": "tetra", "TET10": "tetra10", "HEX8": "hexahedron"}
# Codes of cells with nodes inside their edges, which only an export to memory takes.
QUADRATIC_CODES = {"SEG3": 21, "TRI6": 22, "QUAD8": 23, "TET10": 24}


def places(pattern: str) -> list[list[int]]:
    return [[int(c) for c in word] for word in pattern.split()]


def etype(name: str) -> ElementType:
    if name not in TYPES:
        raise ValueError(f"{name!r} is no element type; there are {', '.join(TYPES)}")
    return TYPES[name]


def _pick(value, column: Column) -> Column:
    """``value(type)`` by the type that ``column`` names; null for a name that is no type, or for a None."""
    known = [(t.name, value(t)) for t in TYPES.values()]
    cases = [(n, v) for n, v in known if v is not None]
    return reduce(lambda c, nv: c.when(column == nv[0], F.lit(nv[1])), cases[1:], F.when(column == cases[0][0], F.lit(cases[0][1])))


def ord_of(column: Column) -> Column:
    return _pick(lambda t: t.ord, column).cast("tinyint")


def dim_of(column: Column) -> Column:
    return _pick(lambda t: t.dim, column).cast("tinyint")


def has_dim(column: Column, *dims: int) -> Column:
    """Whether the type has one of the dimensions: a list of types, which a scan can use to skip files and row groups."""
    return column.isin([t.name for t in TYPES.values() if t.dim in dims])


def size_of(column: Column) -> Column:
    """Nodes of a regular type; null for a poly type."""
    return _pick(lambda t: t.n_nodes, column)


def is_poly(column: Column) -> Column:
    return column.isin([t.name for t in TYPES.values() if t.is_poly])


def type_table(spark: SparkSession) -> DataFrame:
    """(etype, etype_ord, dim, n_nodes, is_poly): the 17 types."""
    rows = [(t.name, t.ord, t.dim, t.n_nodes, t.is_poly) for t in TYPES.values()]
    return spark.createDataFrame(rows, "etype string, etype_ord tinyint, dim tinyint, n_nodes int, is_poly boolean")


def node_ids(etype_col: Column, conn: Column) -> Column:
    """``conn`` without the face ends of a PHED."""
    return F.when(etype_col == "PHED", F.filter(conn, lambda n: n != FACE_END)).otherwise(conn)


def step_dim(dim: int, by: int) -> int:
    """A topological dimension ``by`` above (or, negative, below) ``dim``; outside 0 to 3 it is refused."""
    if not (0 <= dim <= 3 and 0 <= dim + by <= 3):
        raise ValueError(f"there is no topological dimension {dim + by}")
    return dim + by
