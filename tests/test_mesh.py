"""The mesh, its builders, selections and expressions: small facts, algebra, dirty tables, refusals."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshloom import etypes
from meshloom.functions import selection as sel
from meshloom.functions.fields import Field
from meshloom.mesh import Mesh, running_sum, same_node_set
from meshloom.operators import sets, spatial
from meshloom.sources.builders import GridBuilder, grid, sample_grid, sample_mixed

ELEMENTS = "elem_id bigint, etype string, conn array<bigint>, family bigint, temperature double, loaded int"


@pytest.fixture(scope="module")
def spark(session):
    return session


def keys(df):
    return sorted((r.etype, r.elem_id) for r in df.collect())


def values(df):
    return {r.elem_id: r.value for r in df.collect()}


def test_fixed_tables():
    assert [t.ord for t in etypes.TYPES.values()] == list(range(17))
    for (name, codim), (sub, pattern) in etypes.SUBENTITIES.items():
        kind, low = etypes.TYPES[name], etypes.TYPES[sub]
        assert low.dim == kind.dim - codim
        assert all(len(p) == low.n_nodes and max(p) < kind.n_nodes for p in etypes.places(pattern))
    for name, (sub, pattern) in etypes.SIMPLEXES.items():
        assert etypes.TYPES[sub].dim == etypes.TYPES[name].dim and all(len(p) == etypes.TYPES[sub].n_nodes for p in etypes.places(pattern))
    assert etypes.step_dim(2, 1) == 3
    with pytest.raises(ValueError):
        etypes.step_dim(3, 1)
    with pytest.raises(ValueError):
        etypes.etype("PRISM")


def test_grid_layout(spark):
    quad = {r.elem_id: list(r.conn) for r in grid(spark, range(3), range(3)).elements.collect()}
    assert quad == {0: [0, 1, 4, 3], 1: [1, 2, 5, 4], 2: [3, 4, 7, 6], 3: [4, 5, 8, 7]}
    hexa = GridBuilder(spark).add_axis([0, 1]).add_axis([0, 1]).add_axis([0, 2]).build()
    assert list(hexa.elements.first().conn) == [0, 1, 3, 2, 4, 5, 7, 6] and hexa.nodes.count() == 8
    assert [list(r.conn) for r in grid(spark, [0.0, 1.0, 3.0]).elements.orderBy("elem_id").collect()] == [[0, 1], [1, 2]]
    assert grid(spark, [0.0]).num_elements() == 0
    assert sample_grid(spark, 3, 3).num_elements() == 8
    with pytest.raises(ValueError):
        grid(spark, [0], [0], [0], [0])


def test_a_long_axis_is_joined(spark, monkeypatch):
    from meshloom.sources import builders

    axis = [k * 0.5 for k in range(7)]
    want = grid(spark, axis, [0, 1]).nodes.orderBy("node_id").collect()
    monkeypatch.setattr(builders, "INLINE_AXIS", 3)
    assert grid(spark, axis, [0, 1]).nodes.orderBy("node_id").collect() == want


def test_graded_grid(spark):
    axis = [k * k / 100 for k in range(11)]
    mesh = spatial.measure_update(grid(spark, axis, axis), "M")
    assert mesh.select_ids(2 * Field("M") > 0.01).count() == 62
    assert mesh.select(~(2 * Field("M") > 0.01)).num_elements() == 38


def test_blocks_and_refusals(spark):
    mesh = sample_mixed(spark)
    assert mesh.block_types() == ["TRI3", "QUAD4", "HEX8"] and (mesh.space_dim, mesh.topological_dim) == (3, 3)
    assert (mesh.num_elements(), mesh.num_elements(2)) == (6, 5)
    more = spark.createDataFrame([(7, [0, 1, 2])], "elem_id bigint, conn array<bigint>")
    with pytest.raises(ValueError):
        mesh.add_block("TRI3", more)
    assert mesh.add_block("TRI3", more, mode="keep").block("TRI3").count() == 3
    assert mesh.add_block("TRI3", more, mode="replace").block("TRI3").count() == 1
    assert mesh.add_block("TRI3", more, mode="append").block("TRI3").count() == 4
    with pytest.raises(Exception, match="4 nodes"):
        mesh.add_block("QUAD4", more, mode="append").elements.collect()
    with pytest.raises(ValueError):
        mesh.add_element("TRI3", [1, 2])
    one, key = mesh.add_element("TRI3", [1, 2, 9], family=4)
    assert key == ("TRI3", 3) and one.element(*key).first().family == 4
    with pytest.raises(ValueError):
        mesh.regular_connectivity("PGON")
    with pytest.raises(ValueError):
        mesh.poly_connectivity("TRI3")
    assert mesh.add_nodes([(1, 2, 3)]).nodes.agg(F.max("node_id")).first()[0] == 10
    with pytest.raises(ValueError):
        mesh.add_nodes([(1, 2)])
    assert "TRI3 (dimension 2): 3 elements" in mesh.describe() and "space_dim=3" in repr(mesh)


def test_poly_block(spark):
    data = spark.createDataFrame([(k, 10 + k) for k in range(9)], "pos bigint, node_id bigint")
    ends = spark.createDataFrame([(0, 4), (1, 9)], "elem_id bigint, end bigint")
    mesh = Mesh.from_coords(spark, [(0.0, 0.0)]).add_poly_block("PGON", data, ends)
    assert {r.elem_id: list(r.conn) for r in mesh.elements.collect()} == {0: [10, 11, 12, 13], 1: [14, 15, 16, 17, 18]}
    assert {r.elem_id: r.end for r in mesh.poly_connectivity("PGON").collect()} == {0: 4, 1: 9}
    with pytest.raises(ValueError):
        mesh.add_poly_block("TRI3", data, ends)


def test_clean_leaves_out_what_is_no_element(spark):
    rows = [(1, "TRI3", [0, 1, 2], 5, 1.0, 1), (1, "TRI3", [0, 1, 2], 5, 1.0, 2), (2, None, [0], 0, 1.0, 1), (3, "TRI3", None, 0, 1.0, 1), (4, "TRI3", [0, None, 2], 0, 1.0, 1)]
    rows += [(5, "TRI3", [0, 1], 0, 1.0, 1), (6, "PGON", [], 0, 1.0, 1), (7, "PGON", [0, 1, 2, 99], None, None, 1), (8, "BLOB", [1], 0, 1.0, 1), (None, "TRI3", [0, 1, 2], 0, 1.0, 1), (9, "VERTEX", [2], 0, math.nan, 1)]
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 1), (0, 0.0, 0.0, 2), (1, 1.0, 0.0, 1), (2, None, 1.0, 1), (None, 1.0, 1.0, 1)], "node_id bigint, x double, y double, loaded int")
    mesh = Mesh.clean(nodes, spark.createDataFrame(rows, ELEMENTS), fields=["temperature"], axes=("x", "y"))
    assert keys(mesh.elements) == [("PGON", 7), ("TRI3", 1), ("VERTEX", 9)]
    assert mesh.nodes.count() == 3 and mesh.elements.where("elem_id = 7").first().family == 0
    # An unknown node leaves no points, a null coordinate no centroid, and neither satisfies a shape.
    assert mesh.select_ids(sel.rect((-9, -9), (9, 9))).count() == 0
    assert keys(mesh.select_ids(sel.nrect((-9, -9), (9, 9), all=False))) == [("TRI3", 1)]
    assert keys(mesh.select_ids(~sel.rect((-9, -9), (9, 9)))) == keys(mesh.elements)
    empty = Mesh.clean(nodes.limit(0), spark.createDataFrame([], ELEMENTS), fields=["temperature"], axes=("x", "y"))
    assert empty.topological_dim is None and empty.select_ids((Field("temperature") > 0) | sel.rect((0, 0), (1, 1))).count() == 0
    assert spatial.measure(empty).count() == 0 and empty.block_types() == []


def unit(spark):
    """Quads 0..3 on [0, 2] x [0, 2], segment 0, with a field of special values on the quads."""
    mesh = grid(spark, range(3), range(3))
    field = spark.createDataFrame([("QUAD4", 0, 1.0), ("QUAD4", 1, math.nan), ("QUAD4", 2, math.inf), ("QUAD4", 3, None)], "etype string, elem_id bigint, value double")
    mesh = mesh.with_field("T", field)
    return mesh.add_block("SEG2", spark.createDataFrame([(0, [0, 1], 50.0)], "elem_id bigint, conn array<bigint>, T double"))


def test_comparisons_follow_ieee(spark):
    mesh = unit(spark)
    t = Field("T")
    got = {op: [i for _, i in keys(mesh.select_ids(e))] for op, e in {">": t > 0, ">=": t >= 1, "<": t < 2, "<=": t <= math.inf, "==": t == t, "!=": t != t}.items()}
    assert got == {">": [0, 2], ">=": [0, 2], "<": [0], "<=": [0, 2], "==": [0, 2], "!=": [1]}
    assert ("SEG2", 0) in keys(mesh.select_ids(~(t > 0)))  # elements of lower dimension never match, so the complement has them


def test_shapes(spark):
    mesh = unit(spark)
    assert keys(mesh.select_ids(sel.rect((0.5, 0.5), (1.5, 1.5)))) == [("QUAD4", 0)]  # lower sides in, upper sides out
    assert keys(mesh.select_ids(sel.circle((0.5, 0.5), 1.0))) == [("QUAD4", 0), ("SEG2", 0)]  # strictly nearer
    assert mesh.select_ids(sel.circle((0.5, 0.5), 0.0)).count() == 0
    assert keys(mesh.select_ids(sel.nrect((0, 0), (1.5, 1.5), all=True))) == [("QUAD4", 0), ("SEG2", 0)]
    assert len(keys(mesh.select_ids(sel.ncircle((1, 1), 0.1, all=False)))) == 4
    with pytest.raises(ValueError):
        mesh.select_ids(sel.sphere((0, 0, 0), 1.0))
    with pytest.raises(ValueError):
        sel.circle((0, 0), -1.0)
    with pytest.raises(ValueError):
        sel.rect((0, 0, 0), (1, 1))
    nan = Mesh(spark.createDataFrame([(0, math.nan, 0.0)], "node_id bigint, x double, y double"), mesh.elements.limit(0)).add_block("VERTEX", spark.createDataFrame([(0, [0])], "elem_id bigint, conn array<bigint>"))
    assert nan.select_ids(sel.rect((0, 0), (1, 1))).count() == 1 and nan.select_ids(sel.circle((0, 0), 1)).count() == 0


def test_long_lists_are_joined(spark, monkeypatch):
    mesh = unit(spark)
    short = [sel.ids({"QUAD4": [1, 3], "SEG2": [0]}), sel.nids([0, 1, 3, 4], all=True), sel.nids([8], all=False)]
    want = [keys(mesh.select_ids(s)) for s in short]
    assert want == [[("QUAD4", 1), ("QUAD4", 3), ("SEG2", 0)], [("QUAD4", 0), ("SEG2", 0)], [("QUAD4", 3)]]
    monkeypatch.setattr("meshloom.mesh.INLINE_IDS", 0)
    assert [keys(mesh.select_ids(s)) for s in short] == want
    ids = spark.createDataFrame([("QUAD4", 1), ("QUAD4", 1), ("SEG2", 7)], "etype string, elem_id bigint")
    assert keys(mesh.select_ids(~sel.ids(ids))) == [("QUAD4", 0), ("QUAD4", 2), ("QUAD4", 3), ("SEG2", 0)]
    assert mesh.select_ids(sel.nids([], all=True)).count() == 0


def test_groups_and_families(spark):
    mesh = unit(spark)
    fam = mesh.elements.withColumn("family", F.when(F.col("etype") == "SEG2", 3).otherwise(F.col("elem_id")))
    groups = spark.createDataFrame([("QUAD4", "a", 1), ("QUAD4", "a", 2), ("QUAD4", "a", 2), ("QUAD4", "b", 2), ("TRI3", "a", 3)], "etype string, group_name string, family bigint")
    mesh = Mesh(mesh.nodes, fam, groups)
    assert keys(mesh.select_ids(sel.group("a"))) == [("QUAD4", 1), ("QUAD4", 2)]  # family 3 means something for triangles only
    assert keys(mesh.select_ids(sel.group("a") - sel.group("b"))) == [("QUAD4", 1)]
    assert len(keys(mesh.select_ids(sel.not_group("a")))) == 3 and mesh.select_ids(sel.group("none")).count() == 0
    assert keys(mesh.select_ids(sel.family(3))) == [("QUAD4", 3), ("SEG2", 0)] and len(keys(mesh.select_ids(sel.not_family(3)))) == 3
    assert sorted((r.elem_id, r.group_name) for r in mesh.element_groups().collect()) == [(1, "a"), (2, "a"), (2, "b")]


_LEAVES = [sel.types("QUAD4"), sel.dims(1), sel.rect((0, 0), (1, 2)), sel.ncircle((1, 1), 1.2, all=True), Field("T") > 0, sel.ids({"QUAD4": [0, 3]}), sel.nids([4], all=False)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(range(len(_LEAVES))), min_size=3, max_size=3))
def test_algebra_of_selections(spark, picks):
    mesh = unit(spark)
    a, b, c = (_LEAVES[k] for k in picks)
    each = lambda e: set(keys(mesh.select_ids(e)))
    everything, sa, sb, sc = set(keys(mesh.elements)), each(a), each(b), each(c)
    assert each(~(a & b)) == each(~a | ~b) == everything - (sa & sb)
    assert each((a ^ b) - c) == (sa ^ sb) - sc


def test_sets(spark):
    df = lambda rows: spark.createDataFrame(rows, "etype string, elem_id bigint")
    a, b = df([("TRI3", 1), ("TRI3", 2), ("TRI3", 2)]), df([("TRI3", 2), ("TRI3", 3), ("QUAD4", 4)])
    assert len(keys(sets.union(a, b))) == 4 and keys(sets.intersection(a, b)) == [("TRI3", 2)] and keys(sets.difference(a, b)) == [("TRI3", 1)]
    assert keys(sets.symmetric_difference(a, b)) == [("QUAD4", 4), ("TRI3", 1), ("TRI3", 3)]
    assert sets.contains(a, "TRI3", 1) and not sets.contains(a, "QUAD4", 1)
    assert keys(sets.remove(sets.add(a, "SEG2", 0), "TRI3", 1)) == [("SEG2", 0), ("TRI3", 2)]
    assert {r.etype: r.n for r in sets.sizes(a).collect()} == {"TRI3": 2} and sets.without_type(b, "TRI3").count() == 1


SPECIAL = [0.0, -0.0, 1.0, -1.0, 2.5, math.inf, -math.inf, math.nan, -8.0]


def test_arithmetic_follows_ieee(spark):
    pairs = [(a, b) for a in SPECIAL for b in SPECIAL]
    rows = spark.createDataFrame([("VERTEX", 0, 0, k, [0], 0, a, b) for k, (a, b) in enumerate(pairs)], "etype string, etype_ord tinyint, dim tinyint, elem_id bigint, conn array<bigint>, family bigint, a double, b double")
    mesh = Mesh(spark.createDataFrame([(0, 1.0)], "node_id bigint, x double"), rows)
    a, b = Field("a"), Field("b")
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    with np.errstate(all="ignore"):
        want = {"+": x + y, "-": x - y, "*": x * y, "/": x / y, "pow": np.power(x, y), "ln": np.log(x), "log10": np.log10(x), "sqrt": np.sqrt(x), "abs": np.abs(x), "square": x * x, "exp": np.exp(x), "sin": np.sin(x), "neg": -x}
    got = {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "pow": a.pow(b), "ln": a.ln(), "log10": a.log10(), "sqrt": a.sqrt(), "abs": abs(a), "square": a.square(), "exp": a.exp(), "sin": a.sin(), "neg": -a}
    for name, e in got.items():
        v = values(mesh.eval(e))
        np.testing.assert_allclose([v[k] for k in range(len(pairs))], want[name], rtol=1e-14, err_msg=name)
    with np.errstate(all="ignore"):
        zero = [math.copysign(1, v) for v in (1.0 / y[:2])]
    assert [math.copysign(1, values(mesh.eval(1 / b))[k]) for k in range(2)] == zero  # the sign of zero counts


def test_expressions(spark):
    mesh = unit(spark)
    t = Field("T")
    assert values(mesh.eval(t + 1))[3] is None and values(mesh.eval(t + 1))[0] == 2.0
    assert values(mesh.eval(Field.x() + 10 * Field.y())) == {0: 5.5, 1: 6.5, 2: 15.5, 3: 16.5}
    assert values(mesh.eval(Field.centroids()[1])) == {0: 0.5, 1: 0.5, 2: 1.5, 3: 1.5}
    assert values(mesh.eval((2 - t) * 3, dim=1)) == {0: -144.0}
    v = mesh.with_field("v", Field.centroids())
    assert v.eval(Field("v") * [1.0, 2.0] + 1).where("elem_id = 3").first().value == [2.5, 4.0]
    assert keys(v.select_ids(Field("v") > 1)) == [("QUAD4", 3)]  # all components
    assert values(mesh.eval(t.mapv(lambda s: s.fillna(7.0))))[1] == 7.0 and values(mesh.eval(t.mapv(lambda s: s * 2)))[3] is None
    assert values(mesh.eval(Field.x().map_zip(Field.y(), np.maximum)))[2] == 1.5
    for wrong in (t + [1.0, 2.0], Field("none"), t[0], Field.z()):
        with pytest.raises(ValueError):
            mesh.eval(wrong)
    with pytest.raises(Exception, match="different lengths"):
        v.eval(Field("v") + Field.constant([1.0, 2.0, 3.0])).collect()


def test_fields(spark):
    mesh = unit(spark)
    assert mesh.field("T").count() == 4 and mesh.field("T", 1).count() == 1 and mesh.field("none") is None and mesh.field_names() == ["T"]
    two = mesh.add_block("TRI3", spark.createDataFrame([(0, [0, 1, 4])], "elem_id bigint, conn array<bigint>"))
    assert two.field("T") is None  # not every block of the dimension has it
    new = mesh.with_field("U", Field("T") * 2, 1)
    assert {r.etype for r in new.elements.where("U is not null").collect()} == {"SEG2"}
    assert new.drop_field("T").field_names() == ["U"]
    with pytest.raises(ValueError):
        mesh.drop_field("conn")
    with pytest.raises(ValueError):
        mesh.with_field("conn", Field("T"))


def test_extract_replace_update_remove(spark):
    mesh = unit(spark)
    some = mesh.select(sel.ids({"QUAD4": [1, 3]}), with_fields=False, renumber=True)
    assert sorted((r.elem_id, r.orig_elem_id) for r in some.elements.collect()) == [(0, 1), (1, 3)] and some.field_names() == []
    ids = spark.createDataFrame([("QUAD4", 2, 0)], "etype string, elem_id bigint, new_id bigint")
    other = Mesh(mesh.nodes).add_block("QUAD4", spark.createDataFrame([(0, [8, 7, 6, 5], 9)], "elem_id bigint, conn array<bigint>, family bigint"))
    got = mesh.replace(ids, other).element("QUAD4", 2).first()
    assert list(got.conn) == [8, 7, 6, 5] and got.family == 9 and got["T"] == math.inf
    new, old = mesh.update(other)
    assert new.num_elements() == 2 and old.num_elements() == 4
    assert mesh.remove(ids).num_elements() == 4
    assert mesh.to_shared() is mesh


def test_running_sum_and_node_sets(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(100)], "k long, v long")
    total = np.cumsum([k % 5 for k in range(100)])
    assert {r.k: r.s for r in running_sum(df, "k", F.col("v"), "s").collect()} == dict(enumerate(total.tolist()))
    same = spark.createDataFrame([([1, 2, 2], [2, 1])], "a array<long>, b array<long>").select(same_node_set(F.col("a"), F.col("b"))).first()[0]
    assert same
