"""Selections of elements: predicates that combine by ``& | ^ - ~`` and lower to one boolean Column.

Each leaf is a test of one row, never null, so that the algebra is that of sets.
What a tree needs beyond the columns of the elements (node coordinates, families of
groups, long lists of ids) is found by walking it, and joined once.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.etypes import FACE_END, etype, has_dim
from meshloom.functions import geometry
from meshloom.functions.fields import Field, Scope, compare

#: Ids written into the plan; longer lists are joined.
INLINE_IDS = 1_000


@dataclass(frozen=True)
class Facts:
    """What predicates may use of a row."""

    scope: Scope
    top_dim: int
    space_dim: int
    #: (x, y, z) structs of the nodes in order, if asked for.
    points: Column | None = None
    #: Marks by a joined list of ids.
    marks: dict[int, Column] = field(default_factory=dict)
    #: Families by group, as a condition on the row.
    groups: dict[str, Column] = field(default_factory=dict)


class Selection(ABC):
    #: Whether node coordinates are read.
    needs_points = False
    needs_top = False

    @abstractmethod
    def test(self, facts: Facts) -> Column:
        """A boolean Column, never null."""

    def keep(self, facts: Facts) -> Column:
        """The same as a filter, which takes null for false: plain comparisons, that a scan can be given."""
        return self.test(facts)

    def parts(self) -> tuple[Selection, ...]:
        return ()

    def walk(self) -> Iterator[Selection]:
        yield self
        for p in self.parts():
            yield from p.walk()

    def conjuncts(self) -> list[Selection]:
        return [self]

    def __and__(self, o: Selection) -> Selection:
        return And(self, o)

    def __or__(self, o: Selection) -> Selection:
        return Or(self, o)

    def __xor__(self, o: Selection) -> Selection:
        return Xor(self, o)

    def __sub__(self, o: Selection) -> Selection:
        return And(self, Not(o))

    def __invert__(self) -> Selection:
        return Not(self)


# -- leaves ------------------------------------------------------------------------


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True, eq=False)
class Types(Selection):
    names: tuple[str, ...]

    def test(self, facts: Facts) -> Column:
        return _sure(self.keep(facts))

    def keep(self, facts: Facts) -> Column:
        return F.col("etype").isin(list(self.names))


@dataclass(frozen=True, eq=False)
class Dims(Selection):
    dims: tuple[int, ...]

    def test(self, facts: Facts) -> Column:
        return _sure(self.keep(facts))

    def keep(self, facts: Facts) -> Column:
        return has_dim(F.col("etype"), *self.dims)


@dataclass(frozen=True, eq=False)
class Ids(Selection):
    """Ids by type, or a DataFrame (etype, elem_id), which is joined."""

    by_type: dict[str, list[int]] | None = None
    table: DataFrame | None = None

    def test(self, facts: Facts) -> Column:
        return _sure(self.keep(facts))

    def keep(self, facts: Facts) -> Column:
        if id(self) in facts.marks:
            return facts.marks[id(self)]
        lists = [(F.col("etype") == name) & F.col("elem_id").isin([int(i) for i in ids]) for name, ids in (self.by_type or {}).items()]
        return reduce(lambda a, b: a | b, lists) if lists else F.lit(False)


@dataclass(frozen=True, eq=False)
class Shape(Selection):
    """A box or ball, of 2 or 3 axes, tested on the centroid, or on any or all of the nodes."""

    kind: str
    args: tuple
    axes: int
    nodes: str | None = None  # None: centroid
    needs_points = True

    def _inside(self, xs: list[Column]) -> Column:
        if self.kind == "box":
            return geometry.in_box(xs, *self.args)
        return geometry.in_ball(xs, *self.args)

    def test(self, facts: Facts) -> Column:
        if facts.space_dim != self.axes:
            raise ValueError(f"the shape has {self.axes} axes, but the space of the mesh has {facts.space_dim} dimensions")
        if self.nodes is None:
            assert facts.scope.centroid is not None
            return _sure(self._inside(list(facts.scope.centroid)))
        names = ["x", "y", "z"][: self.axes]
        each = lambda p: _sure(self._inside([p[n] for n in names]))
        if self.nodes == "all":
            return _sure((F.size(facts.points) > 0) & F.forall(facts.points, each))
        return _sure(F.exists(facts.points, each))


@dataclass(frozen=True, eq=False)
class NodeIds(Selection):
    """Any or all nodes of the element in a list, or in a DataFrame (node_id), which is joined."""

    all_of: bool
    ids: tuple[int, ...] | None = None
    table: DataFrame | None = None

    def test(self, facts: Facts) -> Column:
        if id(self) in facts.marks:
            return _sure(facts.marks[id(self)])
        conn = F.col("conn")
        ids = F.array(*[F.lit(int(i)).cast("long") for i in self.ids]) if self.ids else F.array().cast("array<bigint>")
        if self.all_of:
            return _sure((F.size(conn) > 0) & F.forall(conn, lambda n: (n == FACE_END) & (F.col("etype") == "PHED") | F.array_contains(ids, n)))
        return _sure(F.exists(conn, lambda n: F.array_contains(ids, n)))


@dataclass(frozen=True, eq=False)
class Group(Selection):
    name: str

    def test(self, facts: Facts) -> Column:
        return _sure(facts.groups[self.name])


@dataclass(frozen=True, eq=False)
class Family(Selection):
    number: int

    def test(self, facts: Facts) -> Column:
        return _sure(self.keep(facts))

    def keep(self, facts: Facts) -> Column:
        return F.col("family") == self.number


class FieldCompare(Selection):
    """A comparison of field expressions, over elements of the highest dimension alone."""

    needs_top = True

    def __init__(self, op: str, a: Field, b: Field):
        self.op, self.a, self.b = op, a, b
        self.needs_points = a.needs_points or b.needs_points

    def test(self, facts: Facts) -> Column:
        return _sure(self.keep(facts))

    def keep(self, facts: Facts) -> Column:
        return has_dim(F.col("etype"), facts.top_dim) & compare(self.op, self.a.lower(facts.scope), self.b.lower(facts.scope))


# -- algebra -----------------------------------------------------------------------


class _Two(Selection):
    def __init__(self, a: Selection, b: Selection):
        self.a, self.b = a, b

    def parts(self) -> tuple[Selection, ...]:
        return (self.a, self.b)


class And(_Two):
    def test(self, facts: Facts) -> Column:
        return self.a.test(facts) & self.b.test(facts)

    def keep(self, facts: Facts) -> Column:
        return self.a.keep(facts) & self.b.keep(facts)

    def conjuncts(self) -> list[Selection]:
        return [*self.a.conjuncts(), *self.b.conjuncts()]


class Or(_Two):
    def test(self, facts: Facts) -> Column:
        return self.a.test(facts) | self.b.test(facts)

    def keep(self, facts: Facts) -> Column:
        return self.a.keep(facts) | self.b.keep(facts)


class Xor(_Two):
    def test(self, facts: Facts) -> Column:
        return self.a.test(facts) != self.b.test(facts)


class Not(Selection):
    """All elements, of whatever dimension, that ``a`` leaves out."""

    def __init__(self, a: Selection):
        self.a = a

    def parts(self) -> tuple[Selection, ...]:
        return (self.a,)

    def test(self, facts: Facts) -> Column:
        return ~self.a.test(facts)


# -- constructors --------------------------------------------------------------------


def types(*names: str) -> Selection:
    """Elements of one of the types."""
    return Types(tuple(etype(n).name for n in names))


def dims(*numbers: int) -> Selection:
    """Elements of one of the topological dimensions."""
    return Dims(tuple(int(d) for d in numbers))


def ids(chosen: dict[str, list[int]] | DataFrame) -> Selection:
    """Elements by id: lists by type, or a DataFrame (etype, elem_id) of any size."""
    if isinstance(chosen, DataFrame):
        return Ids(table=chosen)
    return Ids(by_type={etype(t).name: [int(i) for i in v] for t, v in chosen.items()})


def _box(lo, hi, axes: int, nodes: str | None = None) -> Selection:
    if len(lo) != axes or len(hi) != axes:
        raise ValueError(f"the corners need {axes} coordinates")
    return Shape("box", (tuple(map(float, lo)), tuple(map(float, hi))), axes, nodes)


def _ball(centre, r: float, axes: int, nodes: str | None = None) -> Selection:
    if len(centre) != axes:
        raise ValueError(f"the centre needs {axes} coordinates")
    if not r >= 0:
        raise ValueError("the radius must be 0 or more")
    return Shape("ball", (tuple(map(float, centre)), float(r)), axes, nodes)


def bbox(lo, hi) -> Selection:
    """Centroid in the box, its lower faces included, its upper ones not; NaN counts as inside, null as outside."""
    return _box(lo, hi, 3)


def rect(lo, hi) -> Selection:
    """:func:`bbox` in two dimensions."""
    return _box(lo, hi, 2)


def sphere(centre, r: float) -> Selection:
    """Centroid nearer to the centre than ``r``."""
    return _ball(centre, r, 3)


def circle(centre, r: float) -> Selection:
    """:func:`sphere` in two dimensions."""
    return _ball(centre, r, 2)


def _mode(all: bool) -> str:  # noqa: A002
    return "all" if all else "any"


def nbbox(lo, hi, all: bool) -> Selection:  # noqa: A002
    """All nodes, or any, in the box."""
    return _box(lo, hi, 3, _mode(all))


def nrect(lo, hi, all: bool) -> Selection:  # noqa: A002
    return _box(lo, hi, 2, _mode(all))


def nsphere(centre, r: float, all: bool) -> Selection:  # noqa: A002
    return _ball(centre, r, 3, _mode(all))


def ncircle(centre, r: float, all: bool) -> Selection:  # noqa: A002
    return _ball(centre, r, 2, _mode(all))


def nids(nodes: list[int] | DataFrame, all: bool) -> Selection:  # noqa: A002
    """Elements with all nodes, or any, among the ids: a list, or a DataFrame (node_id) of any size."""
    if isinstance(nodes, DataFrame):
        return NodeIds(bool(all), table=nodes)
    return NodeIds(bool(all), ids=tuple(int(n) for n in nodes))


def group(name: str) -> Selection:
    """Elements whose family belongs to the group, for their type."""
    return Group(name)


def not_group(name: str) -> Selection:
    return Not(Group(name))


def family(number: int) -> Selection:
    return Family(int(number))


def not_family(number: int) -> Selection:
    return Not(Family(int(number)))


INFINITE = math.inf
