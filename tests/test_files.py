"""Round trips through every format, and what cannot be written or read."""

import json

import numpy as np
import pytest

from meshloom.mesh import Mesh
from meshloom.runtime import Scratch, scratch_tables
from meshloom.sources import arrays, files, hdf5
from meshloom.sources.builders import grid, sample_mixed


@pytest.fixture(scope="module")
def spark(session):
    return session


def mixed(spark):
    block = lambda rows: spark.createDataFrame(rows, "elem_id bigint, conn array<bigint>, family bigint, T double")
    mesh = Mesh.from_coords(spark, [(0, 0), (1, 0), (0, 1), (1, 1), (1.5, 0.5)])
    mesh = mesh.add_block("SEG2", block([(0, [0, 1], 1, 1.5), (1, [1, 3], 2, 2.5)])).add_block("QUAD4", block([(0, [0, 1, 3, 2], 0, 3.5)])).add_block("PGON", block([(0, [0, 1, 4, 3, 2], 5, 4.5), (1, [0, 1, 2], 5, 5.5)]))
    return Mesh(mesh.nodes, mesh.elements, spark.createDataFrame([("SEG2", "wall", 1), ("SEG2", "wall", 2), ("PGON", "p", 5)], "etype string, group_name string, family bigint"))


def content(mesh, more=()):
    return sorted((r.etype, r.elem_id, list(r.conn), *[r[c] for c in more]) for r in mesh.elements.collect())


@pytest.mark.parametrize("name", ["a.mesh", "a.JSON", "a.yaml", "a.yml"])
def test_whole_meshes(spark, name):
    mesh, path = mixed(spark), Scratch(spark, "t").path(name)
    files.write(mesh, path)
    back = files.read(spark, path)
    assert content(back, ("family", "T")) == content(mesh, ("family", "T"))
    assert sorted(map(tuple, back.groups.collect())) == sorted(map(tuple, mesh.groups.collect()))
    assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, mesh.nodes.collect()))


@pytest.mark.parametrize("name", ["a.vtk", "a.vtu", "a.vtkhdf", "a.h5", "a.HDF5"])
def test_grids_of_cells(spark, name):
    mesh, path = mixed(spark), Scratch(spark, "t").path(name)
    files.write(mesh, path)
    back = files.read(spark, path)
    assert content(back) == content(mesh) and back.space_dim == 3
    assert sorted((r.x, r.y, r.z) for r in back.nodes.collect()) == sorted((r.x, r.y, 0.0) for r in mesh.nodes.collect())


def test_polyhedra_in_json(spark):
    mesh = Mesh.from_coords(spark, [(0.0, 0.0, 0.0)] * 4).add_block("PHED", spark.createDataFrame([(0, [0, 1, 2, -1, 0, 1, 3])], "elem_id bigint, conn array<bigint>"))
    text = files.to_json(mesh)
    assert "18446744073709551615" in text
    assert content(files.from_document(spark, json.loads(text))) == content(mesh)
    with pytest.raises(ValueError):
        files.write(mesh, Scratch(spark, "t").path("a.vtu"))


def test_what_has_no_place(spark):
    with pytest.raises(ValueError, match="extension"):
        files.read(spark, "x.stl")
    six = Mesh.from_coords(spark, [(0.0, 0.0)] * 6).add_block("TRI6", spark.createDataFrame([(0, list(range(6)))], "elem_id bigint, conn array<bigint>"))
    with pytest.raises(ValueError, match="TRI6"):
        files.write(six, Scratch(spark, "t").path("a.vtk"))
    with pytest.raises(ValueError):
        hdf5.load(b"nothing of the kind")


def test_sparse_ids_become_dense(spark):
    nodes = spark.createDataFrame([(10, 0.0), (30, 1.0), (20, 0.5)], "node_id bigint, x double")
    mesh = Mesh(nodes).add_block("SEG2", spark.createDataFrame([(7, [30, 20]), (5, [10, 20]), (6, [10, 99])], "elem_id bigint, conn array<bigint>"))
    a = arrays.to_arrays(mesh)
    assert a.coords.ravel().tolist() == [0.0, 0.5, 1.0] and a.blocks["SEG2"].matrix().tolist() == [[0, 1], [2, 1]]  # an unknown node has no place


def test_empty_mesh(spark):
    empty = Mesh.from_coords(spark, [(0.0, 1.0)])
    for name in ("a.json", "a.vtk", "a.vtu", "a.vtkhdf"):
        path = Scratch(spark, "t").path(name)
        files.write(empty, path)
        assert files.read(spark, path).num_elements() == 0


def test_exports(spark):
    a = arrays.to_arrays(mixed(spark))
    cells, kinds, points, data = arrays.vtk_cells(a)
    assert cells.tolist() == [4, 0, 1, 3, 2, 5, 0, 1, 4, 3, 2, 3, 0, 1, 2] and kinds.tolist() == [9, 7, 7] and points.shape == (5, 3) and data["T"].tolist() == [3.5, 4.5, 5.5]
    assert arrays.vtk_cells(a, "all")[1].tolist() == [3, 3, 9, 7, 7] and arrays.vtk_cells(a, 1, fields=False)[3] == {}
    conn, starts = arrays.med_cells(a, 1)
    assert conn.tolist() == [1, 0, 1, 1, 1, 3] and starts.tolist() == [0, 3, 6]
    with pytest.raises(ValueError):
        arrays.med_cells(a, 2)
    assert [(n, c.tolist()) for n, c in arrays.meshio_cells(arrays.to_arrays(sample_mixed(spark)))][1] == ("quad", [[0, 1, 2, 3], [4, 5, 6, 7]])
    shapes = {t: v.shape for t, v in files.blocks(grid(spark, [0, 1], [0, 1, 2])).items()}
    assert shapes == {"QUAD4": (2, 4)} and files.coords(grid(spark, [0, 1])).shape == (2, 1)
    assert files.fields(mixed(spark))[("T", 1)]["SEG2"].tolist() == [1.5, 2.5]


def test_vectors_as_fields(spark):
    mesh = grid(spark, [0, 1], [0, 1])
    from meshloom.functions.fields import Field

    with_v = mesh.with_field("v", Field.centroids())
    path = Scratch(spark, "t").path("v.json")
    files.write(with_v, path)
    assert files.read(spark, path).elements.first().v == [0.5, 0.5]


def test_binary_vtu(spark):
    import base64

    def coded(v):
        raw = v.tobytes()
        return base64.b64encode(np.array([len(raw)], dtype="<u4").tobytes() + raw).decode()

    text = f"""<VTKFile type="UnstructuredGrid" byte_order="LittleEndian"><UnstructuredGrid><Piece NumberOfPoints="2" NumberOfCells="1">
    <Points><DataArray type="Float32" NumberOfComponents="3" format="binary">{coded(np.array([0, 0, 0, 1, 2, 3], "<f4"))}</DataArray></Points>
    <Cells><DataArray type="Int32" Name="connectivity" format="binary">{coded(np.array([1, 0], "<i4"))}</DataArray>
    <DataArray type="Int32" Name="offsets" format="ascii">2</DataArray><DataArray type="UInt8" Name="types" format="ascii">3</DataArray></Cells></Piece></UnstructuredGrid></VTKFile>"""
    path = Scratch(spark, "t").path("b.vtu")
    files.save_bytes(spark, path, text.encode())
    mesh = files.read(spark, path)
    assert content(mesh) == [("SEG2", 0, [1, 0])] and mesh.nodes.agg({"z": "max"}).first()[0] == 3.0


def test_hdf5_values():
    root = hdf5.Group({"g": hdf5.Group({"a": np.arange(6, dtype=np.int32).reshape(2, 3), "b": np.array([1.5, -2.0]), "none": np.zeros(0)}, {"Type": "text", "n": np.array([2, 0])})})
    back = hdf5.load(hdf5.dump(root)).members["g"]
    assert back.members["a"].tolist() == [[0, 1, 2], [3, 4, 5]] and back.members["b"].tolist() == [1.5, -2.0] and len(back.members["none"]) == 0
    assert back.attributes["Type"] == "text" and back.attributes["n"].tolist() == [2, 0]


def test_tables_go_with_their_block(spark):
    import os

    with scratch_tables():
        s = Scratch(spark, "gone")
        s.save(spark.range(3).toDF("id"), "t")
        at = s.root.removeprefix("file://")
        assert os.path.isdir(at)
    assert not os.path.exists(at)


@pytest.mark.parametrize("name", ["a.yaml", "a.json", "a.vtu", "a.vtk", "a.vtkhdf"])
def test_the_driver_holds_no_array(spark, name, monkeypatch):
    def refuse(*_):
        raise AssertionError("the whole mesh in the driver")

    for what in ("to_arrays", "from_arrays", "load_bytes", "save_bytes"):
        monkeypatch.setattr(files, what, refuse)
    mesh = grid(spark, [k / 7 for k in range(61)], [float(k) for k in range(501)])
    some = mesh.elements.where("elem_id % 3 = 0").select("elem_id", "conn").withColumn("conn", mesh.elements.conn)
    mesh = mesh.add_block("PGON", some)
    path = Scratch(spark, "t").path(name)
    files.write(mesh, path)
    back = files.read(spark, path)
    assert back.nodes.count() == 61 * 501 and back.elements.count() == 40_000
    differ = back.elements.where("etype = 'QUAD4'").select("elem_id", "conn").exceptAll(mesh.elements.where("etype = 'QUAD4'").select("elem_id", "conn"))
    assert differ.isEmpty()
    polygons = mesh.elements.where("etype = 'PGON'").selectExpr("elem_id div 3", "conn")
    assert back.elements.where("etype = 'PGON'").select("elem_id", "conn").exceptAll(polygons).isEmpty()
    assert back.nodes.select("node_id", "x", "y").exceptAll(mesh.nodes.select("node_id", "x", "y")).isEmpty()


def test_packed_chunks_are_read_by_slices(tmp_path):
    import zlib

    from meshloom.sources.parts import Numbers

    v, at = np.arange(-50, 50, dtype="<i8"), tmp_path / "chunks"
    packed = [zlib.compress(np.frombuffer(v[k : k + 40].tobytes(), np.uint8).reshape(-1, 8).T.tobytes()) for k in (0, 40)]
    at.write_bytes(b"head" + b"".join(packed) + v[80:].tobytes())
    numbers, p = Numbers(f"file:{at}", raw="<i8"), 4
    for c in packed:
        numbers.add((p, p + len(c), 40, [2, 1]))
        p += len(c)
    numbers.add((p, p + 160, 20))
    assert numbers.part(0, 100, np.int64).tolist() == v.tolist() and numbers.part(35, 85, np.int64).tolist() == v[35:85].tolist()
    with pytest.raises(ValueError):
        numbers.part(0, 101)
