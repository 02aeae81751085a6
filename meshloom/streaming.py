"""Selections and field expressions on streams of elements: row by row, without state.

What needs more than the row itself is asked for: the highest dimension, the families of
groups as a static table, and for shapes a column of node coordinates.  Topology and
measures look at all elements together and stay with tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import geometry
from meshloom.functions.fields import Field, Scope
from meshloom.functions.selection import Facts, Group, Ids, NodeIds, Selection


def _facts(elements: DataFrame, points: str | None, top_dim: int, groups: dict[str, Column] | None = None, needed: bool = False) -> Facts:
    dim, centre = 0, None
    if points is not None:
        fields = elements.schema[points].dataType.elementType.names
        dim = len(fields)
        centre = tuple(geometry.centroid(F.col(points), dim))
    elif needed:
        raise ValueError("shapes and coordinates need a column of points in the stream")
    return Facts(Scope(elements.schema, centre), top_dim, dim, None if points is None else F.col(points), {}, groups or {})


def select_stream(elements: DataFrame, expr: Selection, top_dim: int, groups: DataFrame | None = None, points: str | None = None) -> DataFrame:
    """The elements of a stream (or table) that satisfy ``expr``, as they come; rows delivered twice come out twice.

    ``top_dim`` is the dimension that comparisons of fields hold for.  ``groups`` (etype, group_name, family) is static.
    ``points`` names an array of (x, y[, z]) structs.  Lists of ids must be written out, not tables.
    """
    leaves = list(expr.walk())
    if any(isinstance(leaf, (Ids, NodeIds)) and leaf.table is not None for leaf in leaves):
        raise ValueError("ids in a table are for meshes; join the stream with it instead")
    columns, names, flags = elements.columns, sorted({leaf.name for leaf in leaves if isinstance(leaf, Group)}), {}
    if names:
        if groups is None:
            raise ValueError("the selection needs groups")
        marks = groups.where(F.col("group_name").isin(names)).groupBy("etype", "family").agg(*[F.bool_or(F.col("group_name") == n).alias(f"__g{k}") for k, n in enumerate(names)])
        elements = elements.join(marks, ["etype", "family"], "left")
        flags = {n: F.col(f"__g{k}") for k, n in enumerate(names)}
    facts = _facts(elements, points, top_dim, flags, any(leaf.needs_points for leaf in leaves))
    return elements.where(reduce(lambda a, b: a & b, [p.keep(facts) for p in expr.conjuncts()])).select(*columns)


def eval_stream(elements: DataFrame, name: str, expr: Field, points: str | None = None) -> DataFrame:
    """The elements with a column ``name`` of the expression."""
    return elements.withColumn(name, expr.column(_facts(elements, points, -1, needed=expr.needs_points).scope))
