"""Expressions over the fields of elements, lowered to Columns with the semantics of IEEE 754.

An expression is a function from a :class:`Scope` (what the elements offer) to a
:class:`Value` (a Column, and whether it is a vector).  So a whole tree becomes one
Column, which Catalyst folds and compiles into one loop.  Spark's own operators
differ from IEEE in division by zero, logarithms and comparisons with NaN; the
``ieee_`` functions here do not.  A null operand makes the result null, and a
comparison with it false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INF, _NAN = float("inf"), float("nan")


# -- scalar kernels -------------------------------------------------------------


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b, where a zero divisor gives an infinity, or NaN for 0 / 0 and NaN / 0."""
    sign = F.signum(a) * F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)  # no comparison tells 0.0 from -0.0
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(_NAN)).otherwise(sign * F.lit(_INF))
    return F.when(b == 0, by_zero).otherwise(a / b)


def ieee_log(log: Callable[[Column], Column], x: Column) -> Column:
    """``log`` of ``x``: minus infinity at 0, NaN below."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x > 0, log(x)).when(x == 0, F.lit(-_INF)).otherwise(F.lit(_NAN))


def ieee_pow(a: Column, b: Column) -> Column:
    """a to the power b; 1 to any power, and -1 to an infinite one, is 1."""
    one = (a == 1) & b.isNotNull() | (F.abs(a) == 1) & (F.abs(b) == _INF)
    return F.when(one, F.lit(1.0)).otherwise(F.pow(a, b))


def ieee_compare(op: str, a: Column, b: Column) -> Column:
    """a op b for ``> >= < <= == !=``: NaN differs from everything, itself included; false where an operand is null."""
    known = ~F.isnan(a) & ~F.isnan(b)
    test = {
        ">": lambda: known & (a > b),
        ">=": lambda: known & (a >= b),
        "<": lambda: known & (a < b),
        "<=": lambda: known & (a <= b),
        "==": lambda: known & (a == b),
        "!=": lambda: ~known | (a != b),
    }[op]()
    return F.coalesce(test, F.lit(False))


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": ieee_divide,
    "pow": ieee_pow,
}
_UNARY: dict[str, Callable[[Column], Column]] = {
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "sqrt": F.sqrt,
    "square": lambda x: x * x,
    "exp": F.exp,
    "ln": lambda x: ieee_log(F.ln, x),
    "log10": lambda x: ieee_log(F.log10, x),
    "abs": F.abs,
}


# -- expressions ------------------------------------------------------------------


@dataclass(frozen=True)
class Value:
    column: Column
    rank: int = 0  # 0: a number, 1: a vector
    fixed: bool = False  # the same for all elements


@dataclass(frozen=True)
class Scope:
    """What an expression may use: the schema of the elements, and the coordinates of the centroid if they were asked for."""

    schema: T.StructType
    centroid: tuple[Column, ...] | None = None


class Field:
    """``Field("T") * 2 + Field.x()``: arithmetic by operators, functions as methods, comparisons give selections."""

    def __init__(self, name: str | None = None, *, _lower: Callable[[Scope], Value] | None = None, _needs_points: bool = False, _names: frozenset[str] = frozenset()):
        if (name is None) == (_lower is None):
            raise ValueError("a field needs a name")
        self._lower = _lower or (lambda scope: _named(scope, name))
        self.needs_points = _needs_points
        #: The fields that the expression reads.
        self.names = _names if name is None else frozenset([name])

    # construction

    @classmethod
    def constant(cls, value: float | list[float]) -> Field:
        if isinstance(value, (list, tuple)):
            return cls(_lower=lambda _: Value(F.array(*[F.lit(float(v)) for v in value]), 1, True))
        return cls(_lower=lambda _: Value(F.lit(float(value)), 0, True))

    @classmethod
    def from_column(cls, column: Column, rank: int = 0, names: Sequence[str] = ()) -> Field:
        """Any Column over the elements, a ``pandas_udf`` included; ``rank`` 1 for an array, ``names`` the fields it reads."""
        return cls(_lower=lambda _: Value(column, rank), _names=frozenset(names))

    @classmethod
    def _axis(cls, k: int) -> Field:
        return cls(_lower=lambda scope: Value(_centroid(scope, k)), _needs_points=True)

    @classmethod
    def x(cls) -> Field:
        """First coordinate of the element's centroid."""
        return cls._axis(0)

    @classmethod
    def y(cls) -> Field:
        return cls._axis(1)

    @classmethod
    def z(cls) -> Field:
        return cls._axis(2)

    @classmethod
    def centroids(cls) -> Field:
        return cls(_lower=lambda scope: Value(F.array(*[_centroid(scope, k) for k in range(len(scope.centroid or ()))]), 1), _needs_points=True)

    # lowering

    def lower(self, scope: Scope) -> Value:
        return self._lower(scope)

    def column(self, scope: Scope) -> Column:
        return self._lower(scope).column

    # operators

    def _binary(self, other: Any, op: str, swapped: bool = False) -> Field:
        o = _as_field(other)
        a, b = (o, self) if swapped else (self, o)
        return Field(_lower=lambda scope: _broadcast(_BINARY[op], a.lower(scope), b.lower(scope)), _needs_points=a.needs_points or b.needs_points, _names=a.names | b.names)

    def _unary(self, op: str) -> Field:
        return self._map(_UNARY[op])

    def _map(self, f: Callable[[Column], Column]) -> Field:
        def lower(scope: Scope) -> Value:
            v = self.lower(scope)
            return Value(F.transform(v.column, f) if v.rank else f(v.column), v.rank, v.fixed)

        return Field(_lower=lower, _needs_points=self.needs_points, _names=self.names)

    def __add__(self, o):
        return self._binary(o, "+")

    def __radd__(self, o):
        return self._binary(o, "+", True)

    def __sub__(self, o):
        return self._binary(o, "-")

    def __rsub__(self, o):
        return self._binary(o, "-", True)

    def __mul__(self, o):
        return self._binary(o, "*")

    def __rmul__(self, o):
        return self._binary(o, "*", True)

    def __truediv__(self, o):
        return self._binary(o, "/")

    def __rtruediv__(self, o):
        return self._binary(o, "/", True)

    def __pow__(self, o):
        return self._binary(o, "pow")

    def pow(self, o):
        return self._binary(o, "pow")

    def __neg__(self):
        return self._map(lambda c: -c)

    def __abs__(self):
        return self._unary("abs")

    def sin(self):
        return self._unary("sin")

    def cos(self):
        return self._unary("cos")

    def tan(self):
        return self._unary("tan")

    def sqrt(self):
        return self._unary("sqrt")

    def square(self):
        return self._unary("square")

    def exp(self):
        return self._unary("exp")

    def ln(self):
        return self._unary("ln")

    def log10(self):
        return self._unary("log10")

    def abs(self):
        return self._unary("abs")

    def __getitem__(self, i: int) -> Field:
        """Component ``i`` of a vector, null beyond its end."""

        def lower(scope: Scope) -> Value:
            v = self.lower(scope)
            if not v.rank:
                raise ValueError("only a vector has components")
            return Value(F.get(v.column, F.lit(i)), 0, v.fixed)

        return Field(_lower=lower, _needs_points=self.needs_points, _names=self.names)

    def mapv(self, f: Callable[[pd.Series], pd.Series]) -> Field:
        """``f`` over the numbers, in Arrow batches in Python; prefer the built-in functions, which stay in the JVM.  Null stays null."""
        udf = F.arrow_udf(_keeping_nulls(f), T.DoubleType())
        return Field(_lower=lambda scope: Value(udf(_number(self.lower(scope)))), _needs_points=self.needs_points, _names=self.names)

    def map_zip(self, other: Any, f: Callable[[pd.Series, pd.Series], pd.Series]) -> Field:
        """:meth:`mapv` over two expressions; null where one is null."""
        o = _as_field(other)

        udf = F.arrow_udf(_keeping_nulls_of_two(f), T.DoubleType())
        return Field(_lower=lambda scope: Value(udf(_number(self.lower(scope)), _number(o.lower(scope)))), _needs_points=self.needs_points or o.needs_points, _names=self.names | o.names)

    # comparisons: selections of elements

    def _compare(self, op: str, other: Any):
        from meshloom.functions.selection import FieldCompare

        return FieldCompare(op, self, _as_field(other))

    def __gt__(self, o):
        return self._compare(">", o)

    def __ge__(self, o):
        return self._compare(">=", o)

    def __lt__(self, o):
        return self._compare("<", o)

    def __le__(self, o):
        return self._compare("<=", o)

    def __eq__(self, o):  # type: ignore[override]
        return self._compare("==", o)

    def __ne__(self, o):  # type: ignore[override]
        return self._compare("!=", o)

    __hash__ = object.__hash__


def _masked(values: pd.Series, *inputs: pa.Array) -> pa.Array:
    """The values as Arrow, where NaN is a number, and null only what was null."""
    import numpy as np

    gone = np.zeros(len(values), dtype=bool)
    for i in inputs:
        gone |= i.is_null().to_numpy(zero_copy_only=False)
    return pa.array(np.asarray(values, dtype=float), mask=gone)


def _keeping_nulls(f: Callable) -> Callable:
    def values(a: pa.Array) -> pa.Array:
        return _masked(f(a.to_pandas()), a)

    return values


def _keeping_nulls_of_two(f: Callable) -> Callable:
    def values(a: pa.Array, b: pa.Array) -> pa.Array:
        return _masked(f(a.to_pandas(), b.to_pandas()), a, b)

    return values


def compare(op: str, a: Value, b: Value) -> Column:
    """The comparison; of vectors all components must satisfy it, for ``!=`` too."""
    v = _broadcast(lambda x, y: ieee_compare(op, x, y), a, b)
    return F.coalesce(F.forall(v.column, lambda ok: ok), F.lit(False)) if v.rank else v.column


def _as_field(value: Any) -> Field:
    if isinstance(value, Field):
        return value
    if isinstance(value, Column):
        return Field.from_column(value)
    if hasattr(value, "tolist"):  # numpy scalars and arrays
        value = value.tolist()
    return Field.constant(value)


def _named(scope: Scope, name: str) -> Value:
    if name not in scope.schema.names:
        raise ValueError(f"the elements have no field {name!r}")
    kind = scope.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return Value(F.col(f"`{name}`"), 1)
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{name!r} is no field, it holds {kind.simpleString()}")
    return Value(F.col(f"`{name}`").cast("double"))


def _centroid(scope: Scope, k: int) -> Column:
    if scope.centroid is None or k >= len(scope.centroid):
        raise ValueError(f"the mesh has no coordinate {k}")
    return scope.centroid[k]


def _number(v: Value) -> Column:
    if v.rank:
        raise ValueError("the function takes numbers, not vectors")
    return v.column


def _broadcast(f: Callable[[Column, Column], Column], a: Value, b: Value) -> Value:
    fixed = a.fixed and b.fixed
    if not a.rank and not b.rank:
        return Value(f(a.column, b.column), 0, fixed)
    for vector, number in ((a, b), (b, a)):
        if vector.rank and vector.fixed and not number.rank and not number.fixed:
            raise ValueError("a list of numbers has no place for each element: join it as a field first")
    if a.rank and b.rank:
        same = F.size(a.column) == F.size(b.column)
        wrong = F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")
        return Value(F.when(same, F.zip_with(a.column, b.column, f)).when(~same, wrong), 1, fixed) if not fixed else Value(F.zip_with(a.column, b.column, f), 1, True)
    if a.rank:
        return Value(F.transform(a.column, lambda x: f(x, b.column)), 1, fixed)
    return Value(F.transform(b.column, lambda y: f(a.column, y)), 1, fixed)
