"""The mesh: nodes, elements and groups as DataFrames, and what is read from them row by row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom import etypes
from meshloom.functions import geometry
from meshloom.functions.fields import Field, Scope
from meshloom.functions.selection import INLINE_IDS, Facts, Group, Ids, NodeIds, Selection
from meshloom.operators.numbering import number_within_groups
from meshloom.runtime import Scratch, partitions_for

#: Columns of an element that are no fields.
FIXED = ("etype", "etype_ord", "dim", "elem_id", "conn", "family")
KEY = ["etype", "elem_id"]
_ELEMENTS = "etype string, etype_ord tinyint, dim tinyint, elem_id bigint, conn array<bigint>, family bigint"
_GROUPS = "etype string, group_name string, family bigint"
#: Rows that a driver-side export, or a printed mesh, may hold.
SHOWN = 5


def _conn_ok(conn: Column, etype: Column) -> Column:
    size = etypes.size_of(etype)
    whole = conn.isNotNull() & ~F.exists(conn, lambda n: n.isNull())
    return etype.isin(list(etypes.TYPES)) & whole & (size.isNull() & (F.size(conn) > 0) | (F.size(conn) == size))


class Mesh:
    """An immutable, lazy mesh; every operator returns a new one.

    ``nodes``: node_id, x, and y and z as far as the space has them.
    ``elements``: etype, etype_ord, dim, elem_id, conn, family, and any further
    columns: numbers and arrays of numbers are fields, others are kept along.
    ``groups``: etype, group_name, family; an element is in a group that has its
    type and family.  (etype, elem_id) is the key of an element.  Several
    meshes whose ids are disjoint may share one object and are treated as one.

    Rows are taken as they are; ``clean`` brings dirty tables to this form.
    """

    def __init__(self, nodes: DataFrame, elements: DataFrame | None = None, groups: DataFrame | None = None):
        self.spark: SparkSession = nodes.sparkSession
        if "node_id" not in nodes.columns or "x" not in nodes.columns:
            raise ValueError("nodes need the columns node_id and x")
        self.nodes = nodes
        self.elements = self.spark.createDataFrame([], _ELEMENTS) if elements is None else elements
        self.groups = self.spark.createDataFrame([], _GROUPS) if groups is None else groups
        if missing := set(FIXED) - set(self.elements.columns):
            raise ValueError(f"elements lack the columns {sorted(missing)}")
        self._top: int | None = None

    def _with(self, nodes: DataFrame | None = None, elements: DataFrame | None = None, groups: DataFrame | None = None) -> Mesh:
        return Mesh(self.nodes if nodes is None else nodes, self.elements if elements is None else elements, self.groups if groups is None else groups)

    # -- sources ----------------------------------------------------------------------

    @classmethod
    def from_coords(cls, spark: SparkSession, coords: Sequence[Sequence[float]]) -> Mesh:
        """A mesh without elements over a list of points, whose places are their ids."""
        dim = len(coords[0]) if len(coords) else 2
        if not 1 <= dim <= 3:
            raise ValueError("points have one to three coordinates")
        schema = "node_id bigint, " + ", ".join(f"{a} double" for a in geometry.AXES[:dim])
        return cls(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(coords)], schema))

    @classmethod
    def clean(cls, nodes: DataFrame, elements: DataFrame, groups: DataFrame | None = None, fields: Sequence[str] = (), keep: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z")) -> Mesh:
        """A mesh from delivered tables: rows delivered again count once; elements that are none are left out.

        Left out: a null or unknown type, a null id, a null or empty ``conn``, one that holds a
        null, or one whose length is not that of the type.  Unknown node ids stay: such elements have no
        coordinates.  A null family is 0.  ``fields`` and ``keep`` name the columns to take along; the rows
        of one id must agree in them.  Rows are combined before they are shuffled.
        """
        e = elements.where(F.col("elem_id").isNotNull() & _conn_ok(F.col("conn"), F.col("etype")))
        kept = e.select(
            "etype",
            etypes.ord_of(F.col("etype")).alias("etype_ord"),
            etypes.dim_of(F.col("etype")).alias("dim"),
            F.col("elem_id").cast("long").alias("elem_id"),
            F.col("conn").cast("array<bigint>").alias("conn"),
            F.coalesce(F.col("family").cast("long"), F.lit(0)).alias("family"),
            *fields,
            *keep,
        ).distinct()
        n = nodes.where("node_id is not null").select("node_id", *axes, *[c for c in keep if c in nodes.columns]).distinct()
        g = None if groups is None else groups.select("etype", "group_name", "family").distinct()
        return cls(n, kept, g)

    def _block(self, etype: str, rows: DataFrame, mode: str) -> Mesh:
        kind = etypes.etype(etype)
        if mode not in ("error", "keep", "replace", "append"):
            raise ValueError("mode is error, keep, replace or append")
        there = not self.block(etype).isEmpty()
        if there and mode == "error":
            raise ValueError(f"the mesh has a block of {etype}; give a mode")
        if there and mode == "keep":
            return self
        fixed = {"etype": F.lit(kind.name), "etype_ord": F.lit(kind.ord).cast("tinyint"), "dim": F.lit(kind.dim).cast("tinyint")}
        family = F.col("family").cast("long") if "family" in rows.columns else F.lit(0).cast("long")
        extra = [c for c in rows.columns if c not in FIXED]
        size = kind.n_nodes
        conn = F.col("conn").cast("array<bigint>")
        if size is not None:
            conn = F.when(F.size(conn) == size, conn).otherwise(F.raise_error(F.lit(f"an element of {etype} has {size} nodes")).cast("array<bigint>"))
        new = rows.select(*[v.alias(k) for k, v in fixed.items()], F.col("elem_id").cast("long").alias("elem_id"), conn.alias("conn"), family.alias("family"), *extra)
        old = self.elements if mode == "append" or not there else self.elements.where(F.col("etype") != kind.name)
        return self._with(elements=old.unionByName(new, allowMissingColumns=True))

    def add_block(self, etype: str, rows: DataFrame, mode: str = "error") -> Mesh:
        """Elements of one type: ``rows`` has elem_id, conn, perhaps family, and fields.

        An existing block of the type is an error, unless ``mode`` says to ``keep``
        it (and leave the new one out), ``replace`` it, or ``append`` to it.  A conn of the wrong
        length fails when it is read.
        """
        return self._block(etype, rows, mode)

    def add_poly_block(self, etype: str, data: DataFrame, offsets: DataFrame, mode: str = "error") -> Mesh:
        """A block of variable size from flat arrays: ``data`` (pos, node_id) and ``offsets`` (elem_id, end), the end of each element in ``data``.

        The elements' ids are dense, from 0, in order of their ends.
        """
        if not etypes.etype(etype).is_poly:
            raise ValueError(f"{etype} is no poly type")
        before = offsets.select((F.col("elem_id") + 1).alias("elem_id"), F.col("end").alias("start"))
        spans = offsets.join(before, "elem_id", "left").select("elem_id", F.coalesce("start", F.lit(0)).alias("start"), "end")
        # Each place of data belongs to the element of the next end: a row of ends spreads over its places.
        places = spans.where("end > start").select("elem_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
        ordered = F.array_sort(F.collect_list(F.struct("pos", "node_id")))  # an element's own nodes
        rows = places.join(data, "pos").groupBy("elem_id").agg(F.transform(ordered, lambda s: s["node_id"]).alias("conn"))
        return self._block(etype, rows, mode)

    def add_element(self, etype: str, conn: Sequence[int], family: int = 0, fields: dict[str, float] | None = None) -> tuple[Mesh, tuple[str, int]]:
        """One more element, and its key; its id follows the largest of its type.  Prefer :meth:`add_block` for many."""
        kind = etypes.etype(etype)
        if kind.n_nodes is not None and len(conn) != kind.n_nodes:
            raise ValueError(f"an element of {etype} has {kind.n_nodes} nodes")
        last = self.block(etype).agg(F.max("elem_id")).first()[0]
        new = 0 if last is None else last + 1
        own = fields or {}
        if unknown := set(own) - set(self.fields()):
            raise ValueError(f"the elements have no fields {sorted(unknown)}")
        row = self.spark.createDataFrame([(new, [int(n) for n in conn], int(family), *map(float, own.values()))], ", ".join(["elem_id bigint, conn array<bigint>, family bigint", *[f"{c} double" for c in own]]))
        return self._block(etype, row, "append"), (etype, new)

    def add_nodes(self, coords: DataFrame | Sequence[Sequence[float]]) -> Mesh:
        """More nodes: a list of points, whose ids follow the largest one, or a DataFrame with node_id and coordinates."""
        if not isinstance(coords, DataFrame):
            dim = self.space_dim
            if any(len(p) != dim for p in coords):
                raise ValueError(f"the space of the mesh has {dim} dimensions")
            last = self.nodes.agg(F.max("node_id")).first()[0]
            first = 0 if last is None else last + 1
            schema = "node_id bigint, " + ", ".join(f"{a} double" for a in geometry.AXES[:dim])
            coords = self.spark.createDataFrame([(first + k, *map(float, p)) for k, p in enumerate(coords)], schema)
        return self._with(nodes=self.nodes.unionByName(coords, allowMissingColumns=True))

    # -- facts --------------------------------------------------------------------------

    @property
    def space_dim(self) -> int:
        return sum(a in self.nodes.columns for a in geometry.AXES)

    @property
    def axes(self) -> tuple[str, ...]:
        return geometry.AXES[: self.space_dim]

    @property
    def topological_dim(self) -> int | None:
        """Highest dimension of an element; None without elements.  Read once."""
        if self._top is None:
            top = self.elements.agg(F.max("dim")).first()[0]
            self._top = None if top is None else int(top)
        return self._top

    def _dim(self, dim: int | None) -> int:
        if dim is None:
            top = self.topological_dim
            return -1 if top is None else top
        return etypes.step_dim(int(dim), 0)

    def of_dim(self, dim: int) -> DataFrame:
        return self.elements.where(etypes.has_dim(F.col("etype"), etypes.step_dim(int(dim), 0)))

    def block(self, etype: str) -> DataFrame:
        return self.elements.where(F.col("etype") == etypes.etype(etype).name)

    def block_types(self) -> list[str]:
        found = {r[0] for r in self.elements.select("etype").distinct().collect()}  # 17 at most
        return [t for t in etypes.TYPES if t in found]

    def element(self, etype: str, elem_id: int) -> DataFrame:
        return self.block(etype).where(F.col("elem_id") == int(elem_id))

    def counts(self) -> DataFrame:
        """(etype, etype_ord, dim, n_elements) of the blocks."""
        return self.elements.groupBy("etype", "etype_ord", "dim").agg(F.count("*").alias("n_elements"))

    def num_elements(self, dim: int | None = None) -> int:
        return (self.elements if dim is None else self.of_dim(dim)).count()

    def incidences(self) -> DataFrame:
        """(etype, etype_ord, dim, elem_id, pos, node_id): the nodes of the elements, one a row; face ends are left out."""
        return self.elements.select("etype", "etype_ord", "dim", "elem_id", F.posexplode("conn").alias("pos", "node_id")).where(F.col("node_id") != etypes.FACE_END)

    def used_nodes(self) -> DataFrame:
        """(node_id): each node of an element once."""
        return self.incidences().select("node_id").distinct()

    def regular_connectivity(self, etype: str) -> DataFrame:
        """(elem_id, conn) of a type of fixed size."""
        if etypes.etype(etype).is_poly:
            raise ValueError(f"{etype} has no fixed size")
        return self.block(etype).select("elem_id", "conn")

    def poly_connectivity(self, etype: str) -> DataFrame:
        """(elem_id, conn, end): with the place where each element ends in the flat array, the elements in order of their ids.

        The running sum over the elements is taken a range of ids at a time, not in one task.
        """
        if not etypes.etype(etype).is_poly:
            raise ValueError(f"{etype} has a fixed size")
        rows = self.block(etype).select("elem_id", "conn")
        return running_sum(rows, "elem_id", F.size("conn"), "end")

    def field_names(self) -> list[str]:
        kinds = (T.NumericType, T.ArrayType)
        return [f.name for f in self.elements.schema.fields if f.name not in FIXED and isinstance(f.dataType, kinds) and not isinstance(f.dataType, T.IntegralType)]

    fields = field_names

    def field(self, name: str, dim: int | None = None) -> DataFrame | None:
        """(etype, elem_id, value) over one dimension, by default the highest; None unless every block of it has the field.

        A block has a field if any of its values is not null.
        """
        d = self._dim(dim)
        if name not in self.elements.columns:
            return None
        of = self.elements.where(etypes.has_dim(F.col("etype"), d))
        lacking = of.groupBy("etype").agg(F.count(name).alias("n")).where("n = 0")
        if not lacking.isEmpty():
            return None
        return of.select("etype", "elem_id", F.col(name).alias("value"))

    def with_field(self, name: str, value: Field | DataFrame, dim: int | None = None) -> Mesh:
        """A field set over one dimension, by default the highest: an expression, or a DataFrame (etype, elem_id, value).  Other dimensions keep what they have."""
        if name in FIXED:
            raise ValueError(f"{name!r} is no name of a field")
        d = self._dim(dim)
        there = name in self.elements.columns
        if isinstance(value, DataFrame):
            src = value.select(*KEY, F.col("value").alias("__value"))
            rows, new = self.elements.join(src, KEY, "left"), F.col("__value")
        else:
            rows, facts = self._facts(self.elements, value.needs_points, top=d)
            new = value.column(facts.scope)
        old = F.col(f"`{name}`") if there else F.lit(None)
        out = F.when(F.col("dim") == d, new).otherwise(old)
        return self._with(elements=rows.select(*[c for c in self.elements.columns if c != name], out.alias(name)))

    def drop_field(self, name: str) -> Mesh:
        if name in FIXED or name not in self.elements.columns:
            raise ValueError(f"the elements have no field {name!r}")
        return self._with(elements=self.elements.drop(name))

    def element_groups(self) -> DataFrame:
        """(etype, elem_id, group_name): each group of each element."""
        return self.elements.select("etype", "elem_id", "family").join(self.groups.select("etype", "family", "group_name").distinct(), ["etype", "family"]).select(*KEY, "group_name")

    # -- geometry of elements -----------------------------------------------------------

    def with_points(self, elements: DataFrame | None = None, name: str = "points") -> DataFrame:
        """``elements`` (all with their fixed columns, if not given) with an array of (x, y, z) structs, the nodes in order; null if a node is unknown.

        Nodes are looked up one a row and brought together by element again.  A node
        with a third of all rows is split by Spark's adaptive skew join.
        """
        e = self.elements.select(*FIXED) if elements is None else elements
        if name in e.columns:
            raise ValueError(f"the elements have a column {name!r} already")
        xyz = F.struct(*[F.col(a).cast("double").alias(a) for a in self.axes])
        one = e.select(*KEY, F.size("conn").alias("__n"), F.posexplode("conn").alias("__pos", "node_id"))
        known = self.nodes.select("node_id", xyz.alias("__p"))
        gathered = one.join(known, "node_id").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("__pos", "__p"))).alias("__ps"), F.first("__n").alias("__n"))
        points = F.when(F.size("__ps") == F.col("__n"), F.transform("__ps", lambda s: s["__p"]))
        return e.join(gathered.select(*KEY, points.alias(name)), KEY, "left")

    def _facts(self, rows: DataFrame, points: bool, top: int | None = None) -> tuple[DataFrame, Facts]:
        schema = self.elements.schema
        d = -1 if top is None else top
        if not points:
            return rows, Facts(Scope(schema), d, self.space_dim)
        centre = geometry.centroid(F.col("__points"), self.space_dim)
        joined = self.with_points(rows, "__points")
        cols = joined.select("*", *[c.alias(f"__c{k}") for k, c in enumerate(centre)])
        c = tuple(F.col(f"__c{k}") for k in range(self.space_dim))
        return cols, Facts(Scope(schema, c), d, self.space_dim, F.col("__points"))

    # -- expressions --------------------------------------------------------------------

    def eval(self, expr: Field, dim: int | None = None) -> DataFrame:
        """(etype, elem_id, value) of an expression over one dimension, by default the highest."""
        d = self._dim(dim)
        rows, facts = self._facts(self.elements.where(etypes.has_dim(F.col("etype"), d)), expr.needs_points, top=d)
        return rows.select("etype", "elem_id", expr.column(facts.scope).alias("value"))

    # -- selection ----------------------------------------------------------------------

    def _selected(self, rows: DataFrame, parts: list[Selection], top: int) -> DataFrame:
        if not parts:
            return rows
        leaves = [leaf for p in parts for leaf in p.walk()]
        columns = rows.columns
        marks: dict[int, Column] = {}
        for k, leaf in enumerate(leaves):
            if isinstance(leaf, Ids) and (leaf.table is not None or sum(map(len, (leaf.by_type or {}).values())) > INLINE_IDS):
                mark = f"__ids{k}"
                listed = leaf.table if leaf.table is not None else self.spark.createDataFrame([(t, i) for t, v in leaf.by_type.items() for i in v], "etype string, elem_id bigint")
                rows = rows.join(listed.select(*KEY).distinct().withColumn(mark, F.lit(True)), KEY, "left")
                marks[id(leaf)] = F.col(mark)
            if isinstance(leaf, NodeIds) and (leaf.table is not None or len(leaf.ids or ()) > INLINE_IDS):
                mark = f"__nids{k}"
                listed = leaf.table if leaf.table is not None else self.spark.createDataFrame([(n,) for n in leaf.ids], "node_id bigint")
                hit = listed.select("node_id").distinct().withColumn("__hit", F.lit(1))
                one = rows.select(*KEY, F.explode("conn").alias("node_id")).where(F.col("node_id") != etypes.FACE_END)
                if leaf.all_of:
                    marked = one.join(hit, "node_id", "left").groupBy(*KEY).agg((F.count("*") == F.count("__hit")).alias(mark))
                else:
                    marked = one.join(hit, "node_id").select(*KEY).distinct().withColumn(mark, F.lit(True))
                rows = rows.join(marked, KEY, "left")
                marks[id(leaf)] = F.col(mark)
        names = sorted({leaf.name for leaf in leaves if isinstance(leaf, Group)})
        groups: dict[str, Column] = {}
        if names:
            flags = self.groups.where(F.col("group_name").isin(names)).groupBy("etype", "family").agg(*[F.bool_or(F.col("group_name") == n).alias(f"__g{k}") for k, n in enumerate(names)])
            rows = rows.join(flags, ["etype", "family"], "left")
            groups = {n: F.col(f"__g{k}") for k, n in enumerate(names)}
        rows, facts = self._facts(rows, any(leaf.needs_points for leaf in leaves), top)
        facts = Facts(facts.scope, facts.top_dim, facts.space_dim, facts.points, marks, groups)
        return rows.where(reduce(lambda a, b: a & b, [p.keep(facts) for p in parts])).select(*columns)

    def select_rows(self, expr: Selection) -> DataFrame:
        """The elements that satisfy ``expr``.

        Parts joined by ``&`` that need no coordinates are tested first, so that nodes are looked up for the rest alone.
        """
        parts = expr.conjuncts()
        top = self._dim(None) if any(leaf.needs_top for leaf in expr.walk()) else -1
        far = [p for p in parts if any(leaf.needs_points for leaf in p.walk())]
        near = [p for p in parts if p not in far]
        return self._selected(self._selected(self.elements, near, top), far, top)

    def select_ids(self, expr: Selection) -> DataFrame:
        """(etype, elem_id) of the elements that satisfy ``expr``; order them by type and id where order matters."""
        return self.select_rows(expr).select(*KEY)

    def select(self, expr: Selection, with_fields: bool = True, renumber: bool = False) -> Mesh:
        """The mesh of the elements that satisfy ``expr``; it shares the nodes."""
        return self._extracted(self.select_rows(expr), with_fields, renumber)

    def extract(self, ids: DataFrame, with_fields: bool = True, renumber: bool = False) -> Mesh:
        """The mesh of the listed elements (etype, elem_id); families, groups and all types are kept.

        With ``renumber`` ids are dense in each type, in the old order, and ``orig_elem_id`` holds the old ones.
        """
        return self._extracted(self.elements.join(ids.select(*KEY), KEY, "left_semi").select(*self.elements.columns), with_fields, renumber)

    def _extracted(self, rows: DataFrame, with_fields: bool, renumber: bool) -> Mesh:
        if not with_fields:
            rows = rows.drop(*self.field_names())
        if renumber:
            numbered = number_within_groups(rows, ["etype"], ["elem_id"], "__new", scratch=Scratch(self.spark, "renumber"))
            rows = numbered.withColumnRenamed("elem_id", "orig_elem_id").withColumnRenamed("__new", "elem_id")
        return self._with(elements=rows)

    # -- changes --------------------------------------------------------------------------

    def replace(self, ids: DataFrame, other: Mesh) -> Mesh:
        """The listed elements (etype, elem_id, and new_id, the id in ``other``) take the connectivity and family of ``other``."""
        new = ids.select(*KEY, "new_id").join(other.elements.select("etype", F.col("elem_id").alias("new_id"), F.col("conn").alias("__conn"), F.col("family").alias("__family")), ["etype", "new_id"])
        rows = self.elements.join(new.drop("new_id"), KEY, "left")
        cols = [F.coalesce(f"__{c}", c).alias(c) if c in ("conn", "family") else F.col(c) for c in self.elements.columns]
        return self._with(elements=rows.select(*cols))

    def update(self, other: Mesh) -> tuple[Mesh, Mesh]:
        """This mesh with ``other``'s elements in place of all of their dimensions, and the mesh of those replaced."""
        dims = [r[0] for r in other.elements.select("dim").distinct().collect()]  # four at most
        gone = F.col("dim").isin(dims) if dims else F.lit(False)
        kept = self.elements.where(~gone).unionByName(other.elements, allowMissingColumns=True)
        return self._with(elements=kept), self._with(elements=self.elements.where(gone))

    def remove(self, ids: DataFrame) -> Mesh:
        """Without the listed elements (etype, elem_id)."""
        return self._with(elements=self.elements.join(ids.select(*KEY), KEY, "left_anti").select(*self.elements.columns))

    def to_shared(self) -> Mesh:
        """The mesh itself: it is immutable, so a view and an owned mesh are one; fields, families and groups stay."""
        return self

    def __repr__(self) -> str:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.elements.schema.fields if f.name not in FIXED)
        return f"Mesh(space_dim={self.space_dim}, columns=[{kinds}])"

    def describe(self) -> str:
        """Counts and the first rows, for people."""
        lines = [f"Mesh in {self.space_dim} dimensions, {self.nodes.count()} nodes"]
        for r in sorted(self.counts().collect(), key=lambda r: r.etype_ord):  # 17 at most
            lines.append(f"  {r.etype} (dimension {r.dim}): {r.n_elements} elements")
            lines += [f"    {e.elem_id}: {list(e.conn)}" for e in self.block(r.etype).orderBy("elem_id").limit(SHOWN).collect()]
        return "\n".join(lines)


# -- equality of connectivity -----------------------------------------------------------


def same_connectivity(a: Column, b: Column) -> Column:
    return a == b


def same_node_set(a: Column, b: Column) -> Column:
    """Whether two connectivities name the same nodes, in whatever order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def running_sum(rows: DataFrame, order: str, value: Column, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row, by ``order``, which must be unique.

    Rows are range partitioned; sums within a partition are made there, and
    the sum before each partition comes from one row a partition.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "sums")
    n = partitions_for(rows)
    cut = rows.withColumn("__v", value.cast("long")).repartitionByRange(n, order).withColumn("__part", F.spark_partition_id())
    saved = scratch.save(cut, "cut")
    sums = saved.groupBy("__part").agg(F.sum("__v").alias("s")).collect()  # one row a partition
    before, total = [], 0
    for r in sorted(sums, key=lambda r: r[0]):
        before.append((r[0], total))
        total += r[1]
    carry = F.broadcast(spark.createDataFrame(before, "__part int, __before long"))
    inside = F.sum("__v").over(Window.partitionBy("__part").orderBy(order))
    return saved.join(carry, "__part").withColumn(name, (inside + F.col("__before")).cast("long")).drop("__v", "__part", "__before")
