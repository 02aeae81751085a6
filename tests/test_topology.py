"""Sub-entities, neighbours, components, cracks, measures and near nodes against closed forms and brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshloom import runtime
from meshloom.functions import geometry as g
from meshloom.functions import selection as sel
from meshloom.mesh import Mesh
from meshloom.operators import extrude as ex
from meshloom.operators import graph, nearby, spatial, topology
from meshloom.sources.builders import grid, sample_mixed


@pytest.fixture(scope="module")
def spark(session):
    return session


def block(spark, conns):
    return spark.createDataFrame(list(enumerate(conns)), "elem_id bigint, conn array<bigint>")


def conns(mesh, etype):
    return {r.elem_id: list(r.conn) for r in mesh.block(etype).collect()}


# -- sub-entities ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 4])
def test_hexahedral_grid(spark, n):
    mesh = grid(spark, *[range(n + 1)] * 3)
    assert topology.descend(mesh).num_elements() == 3 * n * n * (n + 1)
    assert topology.boundaries(mesh).num_elements() == 6 * n * n
    assert topology.descend(mesh, target_dim=1).num_elements() == 3 * n * (n + 1) ** 2
    assert topology.boundaries(mesh, target_dim=1).num_elements() == 12 * n
    assert topology.with_n_neighbours(mesh, 2).num_elements() == 3 * n * n * (n - 1)
    # Through the faces or at once: the same edges.
    sides = lambda m: {frozenset(c) for c in conns(m, "SEG2").values()}
    assert sides(topology.descend(topology.descend(mesh))) == sides(topology.descend(mesh, target_dim=1))
    v, e, f = (topology.descend(mesh, target_dim=d).num_elements() for d in (0, 1, 2))
    assert v - e + f - mesh.num_elements() == 1  # Euler


def test_first_occurrence_gives_orientation_and_number(spark):
    mesh = grid(spark, [0, 1, 2], [0, 1])
    assert conns(topology.descend(mesh), "SEG2") == {0: [0, 1], 1: [1, 4], 2: [4, 3], 3: [3, 0], 4: [1, 2], 5: [2, 5], 6: [5, 4]}
    both, replaced = topology.boundaries_update(mesh)
    assert both.num_elements() == 8 and replaced.num_elements() == 0


def test_kinds_of_subentities(spark):
    m = Mesh.from_coords(spark, [(0.0, 0.0)])
    m = m.add_block("PGON", block(spark, [[0, 1, 2, 3, 4]])).add_block("TRI6", block(spark, [[10, 11, 12, 13, 14, 15]]))
    got = topology.descend(m)
    assert conns(got, "SEG2") == {0: [0, 1], 1: [1, 2], 2: [2, 3], 3: [3, 4], 4: [4, 0]}
    assert conns(got, "SEG3") == {0: [10, 11, 13], 1: [11, 12, 14], 2: [12, 10, 15]}
    assert topology.descend(m, target_dim=0).num_elements() == 8
    phed = Mesh.from_coords(spark, [(0.0, 0.0)]).add_block("PHED", block(spark, [[0, 1, 2, -1, 0, 1, 3, -1, 1, 2, 3, -1, 0, 2, 3]]))
    assert sorted(conns(topology.descend(phed), "PGON").values()) == [[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]]
    assert phed.used_nodes().count() == 4
    with pytest.raises(Exception, match="QUAD8"):
        topology.descend(Mesh.from_coords(spark, [(0.0, 0.0)]).add_block("QUAD8", block(spark, [list(range(8))]))).num_elements()
    with pytest.raises(ValueError):
        topology.descend(m, 2, 2)
    assert topology.descend(Mesh.from_coords(spark, [(0.0, 0.0)])).num_elements() == 0


def test_repeated_and_degenerate_elements(spark):
    m = Mesh.from_coords(spark, [(0.0, 0.0)]).add_block("TRI3", block(spark, [[0, 1, 2], [2, 1, 0], [5, 5, 6]]))
    owners = {tuple(r.node_set): r.n_owners for r in topology.owners(m).collect()}
    assert owners == {(0, 1): 2, (1, 2): 2, (0, 2): 2, (5, 5): 1, (5, 6): 2}
    assert [(r.src_id, r.dst_id) for r in graph.neighbour_pairs(m).collect()] == [(0, 1)]  # none with itself


def test_neighbours_and_incidence(spark):
    mesh = grid(spark, range(4), range(3))
    want = {(a, b) for a, b in itertools.combinations(range(6), 2) if abs(a % 3 - b % 3) + abs(a // 3 - b // 3) == 1}
    sub, pairs = graph.neighbours(mesh)
    rows = pairs.collect()
    assert {(r.src_id, r.dst_id) for r in rows} == want
    quads, edges = conns(mesh, "QUAD4"), conns(sub, "SEG2")
    assert all(set(edges[r.via]) == set(quads[r.src_id]) & set(quads[r.dst_id]) for r in rows)
    assert {(r.src_id, r.dst_id): list(r.via) for r in graph.neighbours_by_nodes(mesh).collect()} == {(r.src_id, r.dst_id): sorted(edges[r.via]) for r in rows}
    incidence = defaultdict(set)
    for r in topology.incidence(mesh)[1].collect():
        incidence[r.sub_id].add(r.elem_id)
    assert all(incidence[k] == {q for q, c in quads.items() if set(e) <= set(c)} for k, e in edges.items())


def test_three_quads_linked_by_edge_or_node(spark):
    mesh = Mesh(grid(spark, range(5), range(5)).nodes).add_block("QUAD4", block(spark, [[0, 1, 6, 5], [6, 7, 12, 11], [11, 12, 17, 16]]))
    parts = lambda d: len({(r.component_etype, r.component_id) for r in graph.connected_components(mesh, link_dim=d).collect()})
    assert (parts(None), parts(0)) == (2, 1)
    assert [m.num_elements() for m in graph.component_meshes(mesh)] == [1, 2]
    with pytest.raises(ValueError):
        graph.component_meshes(mesh, most=1)


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted((v, find(v)) for v in list(up))


@pytest.mark.parametrize(
    "edges",
    [[], [(1, 1), (None, 2)], [(k, k + 1) for k in range(70)], [(k + 1, k) for k in range(40)] + [(9, 9)], [(99, k) for k in range(60)] + [(200, 99), (201, 202)], [(a, b) for a in range(12) for b in range(a)]],
)
@pytest.mark.parametrize("hot", [200_000, 6])
def test_star_components(spark, edges, hot, monkeypatch):
    for module in (runtime, graph):
        monkeypatch.setattr(module, "HOT_ROWS", hot)
    got = graph.star_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.v, r.root) for r in got) == roots(edges)


def test_lookup_join_takes_the_heaviest_keys(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 2)
    monkeypatch.setattr(runtime, "HOT_PARTS", 3)
    big = spark.createDataFrame([(k % 5, k) for k in range(50)] + [(None, 50), (7, 51)], "k long, v long")
    lookup = spark.createDataFrame([(k, f"n{k}", 10) for k in range(6)], "k long, name string, w long")
    for how, extra in (("inner", []), ("left", [(None, 50, None), (7, 51, None)])):
        got = runtime.lookup_join(big, lookup, "k", "w", 12, how).collect()  # a total far too small
        assert Counter((r.k, r.v, r.name) for r in got) == Counter([(k % 5, k, f"n{k % 5}") for k in range(50)] + extra)


# -- crack and merge ---------------------------------------------------------------------


def test_crack_all_faces_and_merge(spark):
    mesh = grid(spark, [0, 1], [0, 1, 2], [0, 1, 2])
    assert mesh.nodes.count() == 18
    cracked = graph.crack(mesh, topology.descend(mesh))
    assert cracked.nodes.count() == 32 and len({r.component_id for r in graph.connected_components(cracked).collect()}) == 4
    assert spatial.measure(cracked).agg(F.sum("value")).first()[0] == pytest.approx(4.0)
    merged = spatial.merge_nodes(cracked, 1e-9)
    assert len({r.component_id for r in graph.connected_components(merged).collect()}) == 1 and merged.nodes.count() == 32


def test_crack_a_line(spark):
    mesh = grid(spark, range(5), range(3))
    inner = {2 + 5 * k for k in range(3)}
    cut = Mesh(mesh.nodes).add_block("SEG2", block(spark, [[2, 7], [12, 7]]))
    out = graph.crack(mesh, cut)
    assert out.nodes.count() == mesh.nodes.count() + 3 and {r.component_id for r in graph.connected_components(out).collect()} == {0, 2}
    left = {n for r in out.block("QUAD4").where("elem_id % 4 < 2").collect() for n in r.conn}
    assert inner <= left  # the side of the first element keeps the nodes
    half = graph.crack(mesh, Mesh(mesh.nodes).add_block("SEG2", block(spark, [[2, 7]])))
    assert half.nodes.count() == mesh.nodes.count() + 1  # the tip stays whole
    stray = Mesh(mesh.nodes).add_block("SEG2", block(spark, [[0, 14]]))
    with pytest.raises(ValueError):
        graph.crack(mesh, stray)
    assert graph.crack(mesh, stray, check=False).nodes.count() == mesh.nodes.count()
    lower = mesh.add_block("VERTEX", block(spark, [[7]]))
    assert conns(graph.crack(lower, cut), "VERTEX") == {0: [7]}


def test_spheres_cracked_out(spark):
    n = 8
    mesh = grid(spark, *[[k / n for k in range(n + 1)]] * 3)
    inner = topology.boundaries(mesh.select(sel.sphere((0.3, 0.3, 0.3), 0.2) | sel.sphere((0.75, 0.75, 0.75), 0.15)))
    assert len({r.component_id for r in graph.connected_components(graph.crack(mesh, inner)).collect()}) == 3


def test_find_equals_and_joins(spark):
    mesh = sample_mixed(spark)
    part = Mesh(mesh.nodes).add_block("TRI3", block(spark, [[2, 1, 0], [7, 8, 9]]))
    assert {r.elem_id: (r.found_etype, r.found_id) for r in graph.find_equals(mesh, part).collect()} == {0: ("TRI3", 0), 1: (None, None)}
    assert graph.node_to_elements(mesh).where("node_id = 2").count() == 5
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9)], "a long, b long")
    assert [tuple(r) for r in graph.induced_edges(edges, spark.createDataFrame([(1,), (2,), (3,), (3,)], "v long")).orderBy("a").collect()] == [(1, 2), (2, 3)]


# -- measures ----------------------------------------------------------------------------


def test_measures(spark):
    m = Mesh.from_coords(spark, [(0, 0), (1, 0), (0, 1), (1, 1), (1.5, 0.5)])
    m = m.add_block("QUAD4", block(spark, [[0, 1, 3, 2], [0, 2, 3, 1]])).add_block("PGON", block(spark, [[0, 1, 4, 3, 2]])).add_block("TRI3", block(spark, [[0, 1, 77]])).add_block("TRI6", block(spark, [[0, 1, 2, 3, 4, 0]]))
    got = {(r.etype, r.elem_id): r.value for r in spatial.measure(m).collect()}
    assert got == {("QUAD4", 0): 1.0, ("QUAD4", 1): 1.0, ("PGON", 0): 1.25, ("TRI3", 0): None, ("TRI6", 0): None}
    line = grid(spark, [0.0, 1.0, 3.0])
    assert sorted(r.value for r in spatial.measure(line).collect()) == [1.0, 2.0]
    tet = Mesh.from_coords(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]).add_block("TET4", block(spark, [[0, 1, 2, 3]])).add_block("TRI3", block(spark, [[1, 2, 3]])).add_block("VERTEX", block(spark, [[1]]))
    assert spatial.measure(tet).first().value == pytest.approx(1 / 6)
    assert spatial.measure(tet, 2).first().value == pytest.approx(math.sqrt(3) / 2)
    assert spatial.measure(tet, 0).first().value == 0.0
    assert spatial.centroids(tet).where("etype = 'TET4'").select("x", "y", "z").first() == (0.25, 0.25, 0.25)
    box = spatial.bounding_boxes(tet).where("etype = 'TRI3'").first()
    assert (box.x_min, box.y_max, box.z_min, box.z_max) == (0.0, 1.0, 0.0, 1.0)
    hexa = grid(spark, [0, 2], [0, 3], [0, 1])
    assert spatial.measure(hexa).first().value == pytest.approx(6.0)
    parts = [tuple(r.conn) for r in topology.simplexes(hexa).collect()]
    xyz = {r.node_id: np.array([r.x, r.y, r.z]) for r in hexa.nodes.collect()}
    assert sum(abs(np.linalg.det([xyz[p[k]] - xyz[p[0]] for k in (1, 2, 3)])) / 6 for p in parts) == pytest.approx(6.0)


# -- near nodes ----------------------------------------------------------------------------


def greedy(points, eps):
    left, out = dict(points), {}
    for i in sorted(points):
        if i in left:
            near = [j for j in left if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) <= eps * eps]
            for j in near:
                del left[j]
                if len(near) > 1:
                    out[j] = i
    return out


def cloud(spark, points):
    n = len(next(iter(points.values())))
    nodes = spark.createDataFrame([(i, *p) for i, p in points.items()], "node_id long, " + ", ".join(f"{a} double" for a in "xyz"[:n]))
    return Mesh(nodes).add_block("VERTEX", block(spark, [[i] for i in points]))


@pytest.mark.parametrize("points", [{k: (0.3 * k, 0.0) for k in range(9)}, {k: (0.3 * (k * 5 % 9), 0.0) for k in range(9)}, {7: (0.0, 0.0), 3: (0.0, 0.0), 5: (0.2, 0.1), 1: (9.0, 9.0)}, {1: (0.0, 0.0), 2: (0.3, 0.0), 3: (0.6, 0.0), 4: (1.2, 0.0), 5: (0.9, 0.0)}])
def test_duplicates(spark, points):
    mesh = cloud(spark, points)
    assert {r.node_id: r.kept_id for r in spatial.duplicates(mesh, 0.4).collect()} == greedy(points, 0.4)
    pairs = [(a, b) for a, b in itertools.combinations(sorted(points), 2) if math.dist(points[a], points[b]) <= 0.4]
    assert sorted((r.node_id, r.kept_id) for r in spatial.duplicates(mesh, 0.4, "component").collect()) == roots(pairs)


@pytest.mark.parametrize("seed", [8, 9, 10])
def test_random_duplicates_and_merge(spark, seed):
    rng = random.Random(seed)
    points = {k: (rng.random(), rng.random(), 0.2 * rng.random()) for k in rng.sample(range(1000), 150)}
    mesh = cloud(spark, points)
    want = greedy(points, 0.12)
    assert {r.node_id: r.kept_id for r in spatial.duplicates(mesh, 0.12).collect()} == want
    assert conns(spatial.merge_nodes(mesh, 0.12), "VERTEX") == {k: [want.get(i, i)] for k, i in enumerate(points)}
    unused = Mesh(mesh.nodes)
    assert spatial.duplicates(unused, 0.12).count() == 0
    with pytest.raises(ValueError):
        spatial.duplicates(mesh, 0.1, "other")


def test_snap(spark):
    subject = Mesh.from_coords(spark, [(0, 0), (1.01, 0), (0, 1.01), (5, 5)]).add_block("SEG2", block(spark, [[0, 1], [1, 2]]))
    reference = Mesh.from_coords(spark, [(0, 0), (1, 0), (1.005, 0), (5, 5.001)]).add_block("SEG2", block(spark, [[0, 1]]))
    got = {r.node_id: (r.x, r.y) for r in spatial.snap(subject, reference, 0.02).nodes.collect()}
    assert got == {0: (0.0, 0.0), 1: (1.0, 0.0), 2: (0.0, 1.01), 3: (5.0, 5.0)}  # unused nodes neither move nor attract
    with pytest.raises(ValueError):
        spatial.snap(subject, sample_mixed(spark))


@pytest.mark.parametrize("limit", [4096, 3])
@pytest.mark.parametrize("eps", [0.0, 0.03, 0.5])
def test_near_points_where_dense(spark, eps, limit, monkeypatch):
    """Tiles with many points are cut finer, next to others that are not."""
    monkeypatch.setattr(nearby, "TILE_POINTS", limit)
    monkeypatch.setattr(nearby, "TILE", 2)
    rng = random.Random(6)
    points = [(k, rng.gauss(0, 0.2), rng.gauss(0, 0.2)) for k in range(120)] + [(200 + k, rng.uniform(-40, 40), rng.uniform(-40, 40)) for k in range(80)] + [(400, 0.1, 0.1), (401, 0.1, 0.1), (402, 1e9, -1e9)]
    want = sorted((p[0], q[0]) for p, q in itertools.combinations(points, 2) if sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])) <= eps * eps)
    df = spark.createDataFrame(points, "node_id long, x double, y double")
    assert sorted((r.id_a, r.id_b) for r in nearby.near_pairs(df, eps, scope=None, axes=("x", "y")).collect()) == want
    both = nearby.near_join(df, df, eps, axes=("x", "y")).collect()
    assert sorted((r.id_a, r.id_b) for r in both if r.id_a < r.id_b) == want and sum(r.id_a == r.id_b for r in both) == len(points)


# -- extrusion -------------------------------------------------------------------------------


def test_extrusions(spark):
    quad = grid(spark, [0, 1], [0, 1])
    out = ex.extrude(quad, [0.0, 2.0, 3.0])
    assert conns(out, "HEX8") == {0: [0, 1, 3, 2, 4, 5, 7, 6], 1: [4, 5, 7, 6, 8, 9, 11, 10]} and out.space_dim == 3
    assert spatial.measure(out).agg(F.sum("value")).first()[0] == pytest.approx(3.0)
    line = ex.extrude(grid(spark, [0, 1]), [0, 1])
    assert conns(line, "QUAD4") == {0: [0, 1, 3, 2]} and line.space_dim == 2
    point = Mesh.from_coords(spark, [(0.0,)]).add_block("VERTEX", block(spark, [[0]]))
    assert conns(ex.extrude(point, [0, 1]), "SEG2") == {0: [0, 1]}
    assert ex.extrude(quad, []) is quad
    flat = ex.extrude(quad, [4.0])
    assert flat.block_types() == ["QUAD4"] and {r.z for r in flat.nodes.collect()} == {4.0}
    with pytest.raises(ValueError):
        ex.extrude(out, [0, 1])
    with pytest.raises(Exception, match="TRI3"):
        ex.extrude(Mesh(quad.nodes).add_block("TRI3", block(spark, [[0, 1, 2]])), [0, 1]).elements.collect()
    par = {r.node_id: (r.x, r.y, r.z) for r in ex.extrude_parallel(quad, [(5, 5, 1), (6, 4, 3)]).nodes.collect()}
    assert par[0] == (0.0, 0.0, 1.0) and par[4] == (1.0, -1.0, 3.0) and par[7] == (2.0, 0.0, 3.0)


def test_curved_extrusion(spark):
    t = np.linspace(0, np.pi, 12)
    line = np.column_stack([1 - np.cos(t), 0 * t, np.sin(t)])
    out = ex.extrude_curv(grid(spark, [-0.1, 0.1], [-0.1, 0.1]), line)
    xyz = np.array([(r.x, r.y, r.z) for r in out.nodes.orderBy("node_id").collect()]).reshape(12, 4, 3)
    np.testing.assert_allclose(xyz.mean(axis=1) - line, 0, atol=1e-12)  # the planes follow the line
    sides = np.linalg.norm(xyz[:, 1] - xyz[:, 0], axis=1)
    np.testing.assert_allclose(sides, 0.2, atol=1e-12)  # and keep their form
    normal = np.cross(xyz[:, 1] - xyz[:, 0], xyz[:, 2] - xyz[:, 0])
    np.testing.assert_allclose(normal[-1] / np.linalg.norm(normal[-1]), (line[-1] - line[-2]) / np.linalg.norm(line[-1] - line[-2]), atol=1e-9)
    back = ex.rotation(np.array([0.0, 0.0, 1.0]), np.array([0.0, 0.0, -2.0]))
    np.testing.assert_allclose(back @ [0, 0, 1], [0, 0, -1], atol=1e-12)
    assert np.linalg.det(back) == pytest.approx(1)
    assert ex.extrude_curv(grid(spark, [0, 1], [0, 1]), [(0, 0, 2.0)]).block_types() == ["QUAD4"]


# -- kernels -----------------------------------------------------------------------------------


def points_of(df, name):
    return F.transform(F.col(name), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def test_curved_polygons(spark):
    r = math.sqrt(0.5)
    arcs = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0], [r, r], [-r, r], [-r, -r], [r, -r]]  # the unit circle
    half = [[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 2.0]]  # a line there, a parabola back
    rng = random.Random(1)
    rows = [(rng.uniform(-1.2, 2.2), rng.uniform(-1.2, 2.2)) for _ in range(600)]
    df = spark.createDataFrame([(x, y, arcs, half) for x, y in rows], "px double, py double, arcs array<array<double>>, half array<array<double>>")
    got = df.select(g.in_arc_polygon(F.col("px"), F.col("py"), points_of(df, "arcs")).alias("a"), g.in_bezier_polygon(F.col("px"), F.col("py"), points_of(df, "half")).alias("b"), g.in_polygon(F.col("px"), F.col("py"), points_of(df, "arcs")).alias("c")).collect()
    assert [r.a for r in got] == [x * x + y * y < 1 for x, y in rows]
    assert [r.b for r in got] == [0 < y < x * (2 - x) for x, y in rows]
    with pytest.raises(Exception, match="control points"):
        df.select(g.in_arc_polygon(F.col("px"), F.col("py"), F.slice(points_of(df, "arcs"), 1, 7))).collect()


def test_polyhedra(spark):
    corners = list(itertools.product([0.0, 1.0], repeat=3))
    faces = [[c for c in corners if c[k] == s] for k in range(3) for s in (0.0, 1.0)]
    around = lambda f: [f[0], f[1], f[3], f[2]]
    rng = random.Random(2)
    rows = [tuple(rng.uniform(-0.4, 1.4) for _ in range(3)) for _ in range(300)] + [(0.5, 0.5, 0.5), (0.25, 0.5, 0.5), (-1.0, 0.5, 0.5)]  # the last ones meet the diagonals of faces
    df = spark.createDataFrame([(*p, [around(f) for f in faces]) for p in rows], "x double, y double, z double, faces array<array<array<double>>>")
    as_points = F.transform("faces", lambda f: F.transform(f, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))))
    got = df.select(g.in_polyhedron(F.struct("x", "y", "z"), as_points).alias("v")).collect()
    assert [r.v for r in got] == [all(0 < c < 1 for c in p) for p in rows]


def meet(spark, segments):
    df = spark.createDataFrame([tuple(float(c) for c in s) for s in segments], ", ".join(f"c{k} double" for k in range(8)))
    p = [F.struct(F.col(f"c{2 * k}").alias("x"), F.col(f"c{2 * k + 1}").alias("y")) for k in range(4)]
    return [tuple(r.m) for r in df.select(g.segment_intersection(*p).alias("m")).collect()]


def test_segments(spark):
    cases = {
        (0, 0, 2, 2, 0, 2, 2, 0): ("new", None, None, 1.0, 1.0),
        (0, 0, 1, 0, 0, 1, 1, 1): ("none", None, None, None, None),
        (0, 0, 1, 0, 1, 0, 1, 1): ("end", 2, None, None, None),
        (0, 0, 2, 0, 1, 0, 1, 1): ("end", 3, None, None, None),
        (0, 0, 2, 0, 1, 0, 3, 0): ("overlap", 3, 2, None, None),
        (0, 0, 1, 0, -1, 0, 3, 0): ("overlap", 1, 2, None, None),  # strictly inside of the second
        (2, 0, 0, 0, 1, 0, -1, 0): ("overlap", 3, 2, None, None),  # leftwards
        (0, 3, 0, 0, 0, 1, 0, 2): ("overlap", 4, 3, None, None),  # downwards
        (0, 0, 1, 0, 1, 0, 2, 0): ("end", 2, None, None, None),
        (0, 0, 1, 0, 2, 0, 3, 0): ("none", None, None, None, None),
        (0, 0, 0, 0, 0, 0, 1, 1): ("none", None, None, None, None),
    }
    assert dict(zip(cases, meet(spark, list(cases)))) == cases


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 8), min_size=40, max_size=40))
def test_segments_either_way_round(spark, segments):
    one, other = meet(spark, segments), meet(spark, [s[4:] + s[:4] for s in segments])
    swap = {1: 3, 2: 4, 3: 1, 4: 2}
    for s, a, b in zip(segments, one, other):
        assert (a[0] == "overlap") == (b[0] == "overlap") and (a[0] == "none") == (b[0] == "none")
        at = lambda i: s[2 * (i - 1) : 2 * i]  # noqa: B023, E731
        if a[0] == "end":
            assert b[0] == "end" and at(a[1]) == at(swap[b[1]])
        if a[0] == "new":
            assert a[3] == pytest.approx(b[3], abs=1e-9) and a[4] == pytest.approx(b[4], abs=1e-9)
        if a[0] == "overlap":
            assert {at(a[1]), at(a[2])} == {at(swap[b[1]]), at(swap[b[2]])}


def test_segment_crossings(spark):
    rng = random.Random(3)
    xy = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(60)]
    mesh = Mesh.from_coords(spark, xy).add_block("SEG2", block(spark, [[2 * k, 2 * k + 1] for k in range(30)] + [[0, 999]]))
    want = set()
    for a, b in itertools.combinations(range(30), 2):
        p, q, r, s = (np.array(xy[k]) for k in (2 * a, 2 * a + 1, 2 * b, 2 * b + 1))
        side = lambda u, v, w: np.sign(np.cross(np.append(v - u, 0), np.append(w - u, 0))[2])
        if side(p, q, r) != side(p, q, s) and side(r, s, p) != side(r, s, q):
            want.add((a, b))
    for width in (None, 0.7, 50.0):
        assert {(r.id_a, r.id_b) for r in spatial.segment_crossings(mesh, width).collect()} == want


def test_fields_may_have_any_name(spark):
    mesh = grid(spark, [0, 1], [0, 1]).with_field("points", spark.createDataFrame([("QUAD4", 0, 2.0)], "etype string, elem_id bigint, value double"))
    mesh = mesh.with_field("value", spark.createDataFrame([("QUAD4", 0, 3.0)], "etype string, elem_id bigint, value double"))
    assert spatial.measure(mesh).first().value == 1.0 and spatial.centroids(mesh).first().x == 0.5
    assert mesh.select_ids(sel.rect((0, 0), (1, 1))).count() == 1 and topology.descend(mesh).num_elements() == 4
    named = spatial.measure_update(mesh, "points")
    assert named.elements.first().points == 1.0 and named.elements.first().value == 3.0
    with pytest.raises(ValueError):
        mesh.with_points(mesh.elements)
