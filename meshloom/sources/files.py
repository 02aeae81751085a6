"""Meshes in files: Parquet folders for data of any size, and single-file formats for exchange.

A folder is read and written by all executors, with elements partitioned by type.
JSON, YAML, VTK, VTU and VTKHDF hold one mesh in one file; its arrays are read and
written by tasks, see :mod:`meshloom.sources.parts`.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom import etypes
from meshloom.functions.geometry import AXES
from meshloom.mesh import FIXED, Mesh
from meshloom.sources import parts
from meshloom.sources.arrays import Arrays, Block, Kind, dense, from_arrays, kinds, to_arrays
from meshloom.sources.parts import FILE_FACE_END, Numbers

#: Bytes handed to the file system at a time.
PIECE = 16 << 20


# -- Parquet -------------------------------------------------------------------------


def write_folder(mesh: Mesh, path: str, mode: str = "errorifexists") -> None:
    """nodes, elements (partitioned by type, so that a selection of types reads those alone) and groups as Parquet."""
    mesh.nodes.write.mode(mode).parquet(f"{path}/nodes")
    mesh.elements.write.mode(mode).partitionBy("etype").parquet(f"{path}/elements")
    mesh.groups.write.mode(mode).parquet(f"{path}/groups")


def read_folder(spark: SparkSession, path: str) -> Mesh:
    elements = spark.read.parquet(f"{path}/elements")
    front = [c for c in ("etype", "etype_ord", "dim", "elem_id", "conn", "family") if c in elements.columns]
    e = elements.select(*front, *[c for c in elements.columns if c not in front])
    return Mesh(spark.read.parquet(f"{path}/nodes"), e, spark.read.parquet(f"{path}/groups"))


# -- JSON and YAML -------------------------------------------------------------------


def _array(v: np.ndarray) -> dict:
    data = [None if isinstance(x, float) and not np.isfinite(x) else x for x in v.ravel().tolist()]
    return {"v": 1, "dim": list(v.shape), "data": data}


def _ids(v: np.ndarray) -> dict:
    data = [FILE_FACE_END if x == etypes.FACE_END else x for x in v.ravel().tolist()]
    return {"v": 1, "dim": list(v.shape), "data": data}


def to_document(mesh: Mesh) -> dict:
    """The mesh as nested dictionaries and lists; values that are not finite become null."""
    a = to_arrays(mesh)
    blocks = {}
    for t, b in a.blocks.items():
        if etypes.etype(t).is_poly:
            conn = {"Poly": {"data": _ids(b.conn), "offsets": _array(b.ends())}}
        else:
            conn = {"Regular": _ids(b.matrix())}
        blocks[t] = {"cell_type": t, "connectivity": conn, "fields": {f: _array(v) for f, v in b.fields.items()}, "families": _array(b.families), "groups": b.groups}
    return {"coords": _array(a.coords), "element_blocks": blocks}


def _back(d: dict, kind=float) -> np.ndarray:
    data = [np.nan if x is None else etypes.FACE_END if x == FILE_FACE_END else x for x in d["data"]]
    return np.array(data, dtype=kind).reshape(d["dim"])


def from_document(spark: SparkSession, doc: dict) -> Mesh:
    blocks = {}
    for t, b in doc["element_blocks"].items():
        (form, c), families = next(iter(b["connectivity"].items())), _back(b["families"], np.int64)
        if form == "Regular":
            m = _back(c, np.int64)
            conn, sizes = m.ravel(), np.full(m.shape[0], m.shape[1], dtype=np.int64)
        elif form == "Poly":
            conn, ends = _back(c["data"], np.int64), _back(c["offsets"], np.int64)
            sizes = np.diff(np.r_[0, ends])
        else:
            raise ValueError(f"unknown connectivity {form!r}")
        blocks[t] = Block(conn, sizes, families[: len(sizes)], {f: _back(v) for f, v in b.get("fields", {}).items()}, b.get("groups", {}))
    return from_arrays(spark, Arrays(_back(doc["coords"]), blocks))


def to_json(mesh: Mesh, pretty: bool = False) -> str:
    return json.dumps(to_document(mesh), indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def save_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file by Spark's file systems, so that ``path`` may lie in any store that the cluster reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    try:
        for k in range(0, len(data), PIECE):
            out.write(bytearray(data[k : k + PIECE]))
    finally:
        out.close()


def load_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _plain(v: np.ndarray) -> list[str]:
    """Numbers as texts that both JSON and YAML read as such; those that are not finite are null."""
    if v.dtype.kind != "f":
        return list(map(str, v.tolist()))
    return ["null" if not np.isfinite(x) else r.replace("e", ".0e") if "e" in (r := repr(x)) and "." not in r else r for x in v.tolist()]


def _lines(words: list[str], width: int) -> str:
    """``width`` numbers a line."""
    if width == 1:
        return ",\n".join(",".join(words[k : k + 16]) for k in range(0, len(words), 16))
    return ",\n".join(",".join(words[k : k + width]) for k in range(0, len(words), width))


def _listed(n: int, width: int, words: Callable[[int, pa.Table], list[str]], more: str) -> Callable[[int, pa.Table], bytes]:
    """Rows as the middle of a list of numbers."""

    def render(first: int, t: pa.Table) -> bytes:
        end = "," if first + t.num_rows < n else ""
        return f"{_lines(words(first, t), width)}{end}{more}".encode()

    return render


def _id_words(v: np.ndarray) -> list[str]:
    return [str(FILE_FACE_END) if x == etypes.FACE_END else str(x) for x in v.tolist()]


def _ends_before(rows: DataFrame) -> dict[int, int]:
    """Nodes of the elements before each part."""
    sums = rows.groupBy(F.floor(F.col("elem_id") / parts.ROWS).alias("k")).agg(F.sum(F.size("conn")).alias("n")).collect()  # a row a part
    total, out = 0, {}
    for r in sorted(sums, key=lambda r: r["k"]):
        out[r["k"]] = total
        total += r["n"]
    return out


class _Document:
    """Writes a nested document, whose long lists come from tasks, as JSON or YAML."""

    def __init__(self, sink: parts.Sink, form: str):
        self.sink, self.form, self.depth, self.first = sink, form, 0, True
        self.break_ = "" if form == "compact" else "\n"

    def _key(self, name: str) -> None:
        key = self.scalar(name)
        if self.form == "yaml":
            self.sink.put(f"{'' if self.first and not self.depth else chr(10)}{'  ' * self.depth}{key}: ")
        else:
            gap = "" if self.form == "compact" else "\n" + "  " * (self.depth + 1)
            self.sink.put(f"{'' if self.first else ','}{gap}{key}:{'' if self.form == 'compact' else ' '}")
        self.first = False

    def scalar(self, v) -> str:
        if self.form != "yaml":
            return json.dumps(v, separators=(",", ":"))
        import yaml

        return yaml.safe_dump(v, default_flow_style=True, default_style='"' if isinstance(v, str) else None, width=float("inf"), allow_unicode=True).removesuffix("...\n").strip()

    def value(self, name: str, v) -> None:
        self._key(name)
        self.sink.put(self.scalar(v))

    @contextmanager
    def inside(self, name: str = "") -> Iterator[None]:
        if name:
            self._key(name)
            self.depth += 1
        if self.form != "yaml":
            self.sink.put("{")
        self.first = True
        yield
        if self.form != "yaml":
            self.sink.put(("" if self.first or self.form == "compact" else "\n" + "  " * self.depth) + "}")
        elif self.first:
            self.sink.put("{}")
        if name:
            self.depth -= 1
        self.first = False

    def numbers(self, name: str, dim: list[int], df: DataFrame, pos: str, words: Callable[[int, pa.Table], list[str]]) -> None:
        with self.inside(name):
            self.value("v", 1)
            self.value("dim", dim)
            self._key("data")
            self.sink.put("[")
            self.sink.rows(df, pos, dim[0], _listed(dim[0], int(np.prod(dim[1:])), words, self.break_))
            self.sink.put("]")


def _column(name: str, width: int = 0) -> Callable[[int, pa.Table], list[str]]:
    def words(_: int, t: pa.Table) -> list[str]:
        return _plain(parts.flat(t[name]).astype(float) if width else t[name].to_numpy().astype(float))

    return words


def _write_document(mesh: Mesh, path: str, form: str) -> None:
    """The document of :func:`to_document` as JSON (``pretty`` or ``compact``) or ``yaml``, its arrays written by tasks."""
    m = dense(mesh)
    names = m.field_names()
    axes = list(m.axes)
    n_nodes = m.nodes.count()
    with parts.Sink(mesh.spark, path) as sink:
        doc = _Document(sink, form)
        with doc.inside():
            doc.numbers("coords", [n_nodes, len(axes)], m.nodes.select("node_id", *[F.col(a).cast("double").alias(a) for a in axes]), "node_id", lambda _, t: _plain(np.column_stack([t[a].to_numpy() for a in axes]).ravel()))
            with doc.inside("element_blocks"):
                for t, k in kinds(m, names).items():
                    with doc.inside(t):
                        _write_block(doc, m.block(t), t, k)
        sink.put("\n")


def _write_block(doc: _Document, rows: DataFrame, t: str, k: Kind) -> None:
    doc.value("cell_type", t)
    at = lambda *c: rows.select("elem_id", *c)
    ids = lambda _, r: _id_words(parts.flat(r["conn"]))
    with doc.inside("connectivity"):
        if etypes.etype(t).is_poly:
            before = _ends_before(rows)
            with doc.inside("Poly"):
                with doc.inside("data"):
                    doc.value("v", 1)
                    doc.value("dim", [k.n_ids])
                    doc._key("data")
                    doc.sink.put("[")
                    doc.sink.rows(at("conn"), "elem_id", k.n, _listed(k.n, 16, ids, doc.break_))
                    doc.sink.put("]")
                doc.numbers("offsets", [k.n], at(F.size("conn").alias("n")), "elem_id", lambda first, r: list(map(str, (before[first // parts.ROWS] + np.cumsum(r["n"].to_numpy().astype(np.int64))).tolist())))
        else:
            doc.numbers("Regular", [k.n, k.n_ids // k.n], at("conn"), "elem_id", ids)
    with doc.inside("fields"):
        for f, width in k.fields.items():
            doc.numbers(f, [k.n, width] if width else [k.n], at(f), "elem_id", _column(f, width))
    doc.numbers("families", [k.n], at("family"), "elem_id", lambda _, r: list(map(str, r["family"].to_pylist())))
    doc.value("groups", k.groups)


_SPAN = "__span__"


def _numbers(uri: str, data: list) -> Numbers:
    out = Numbers(uri)
    for x in data:
        out.add(tuple(x[_SPAN]) if isinstance(x, dict) else [x])
    return out


def _read_document(spark: SparkSession, path: str, load: Callable) -> Mesh:
    """The mesh of a document, whose long lists tasks read; what is not laid out in such lists, the driver reads."""
    uri, text = parts.skeleton(spark, path, ",", '{{"' + _SPAN + '":[{},{},{}]}},')
    try:
        doc = load(text)
    except ValueError:
        doc = None
    if doc is None:  # a stretch of numbers within a text
        return from_document(spark, load(load_bytes(spark, path)))
    text = ""
    array = lambda d: (_numbers(uri, d["data"]), d["dim"])
    coords, (n, dim) = array(doc["coords"])
    if not 1 <= dim <= 3:
        raise ValueError("points have one to three coordinates")
    nodes = from_numbers(spark, coords, n, dim)
    elements, groups = None, []
    for t, b in doc["element_blocks"].items():
        rows = _block_rows(spark, t, b, array)
        elements = rows if elements is None else elements.unionByName(rows, allowMissingColumns=True)
        groups += [(t, name, int(f)) for name, families in b.get("groups", {}).items() for f in families]
    return Mesh(nodes, elements, spark.createDataFrame(groups, "etype string, group_name string, family bigint") if groups else None)


def _block_rows(spark: SparkSession, t: str, b: dict, array: Callable) -> DataFrame:
    (form, c), kind = next(iter(b["connectivity"].items())), etypes.etype(t)
    families, _ = array(b["families"])
    fields = {f: array(v) for f, v in b.get("fields", {}).items()}
    if clash := set(fields) & set(FIXED):
        raise ValueError(f"{sorted(clash)[0]!r} is no name of a field")
    if form == "Regular":
        conn, (n, width) = array(c)
        if len(conn) != n * width:
            raise ValueError(f"the connectivity of {t} has another length than its dimensions say")
        ends = None
    elif form == "Poly":
        (conn, _), (ends, _) = array(c["data"]), array(c["offsets"])
        n = len(ends)
        width = max(1, len(conn) // max(1, n))
    else:
        raise ValueError(f"unknown connectivity {form!r}")
    if kind.n_nodes is not None and n and ends is None and width != kind.n_nodes:
        raise ValueError(f"an element of {t} has {kind.n_nodes} nodes")
    widths = {f: int(np.prod(dim[1:])) if len(dim) > 1 else 0 for f, (_, dim) in fields.items()}

    def make(i: int, j: int) -> pa.Table:
        if ends is None:
            ids, sizes = conn.part(i * width, j * width, np.int64), np.full(j - i, width, np.int64)
        else:
            e = ends.part(max(i - 1, 0), j, np.int64)
            e = e if i else np.r_[0, e]
            ids, sizes = conn.part(int(e[0]), int(e[-1]), np.int64), np.diff(e)
            if kind.n_nodes is not None and (sizes != kind.n_nodes).any():
                raise ValueError(f"an element of {t} has {kind.n_nodes} nodes")
        cols = {"elem_id": np.arange(i, j, dtype=np.int64), "conn": parts.lists(ids, sizes), "family": families.part(i, j, np.int64)}
        for f, (v, _) in fields.items():
            w = widths[f]
            cols[f] = pa.array(v.part(i, j)) if not w else parts.lists(v.part(i * w, j * w), np.full(j - i, w))
        return pa.table(cols)

    kinds_of = ", ".join(["elem_id bigint, conn array<bigint>, family bigint", *[f"`{f}` {'array<double>' if w else 'double'}" for f, w in widths.items()]])
    return _named(parts.mapped(spark, parts.even(n, width), make, kinds_of).withColumn("etype", F.lit(t)), list(fields))


def _named(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select("etype", etypes.ord_of(F.col("etype")).alias("etype_ord"), etypes.dim_of(F.col("etype")).alias("dim"), "elem_id", "conn", "family", *[F.col(f"`{f}`") for f in fields])


def from_numbers(spark: SparkSession, coords: Numbers, n: int, dim: int) -> DataFrame:
    """Nodes with their place as id."""
    axes = AXES[:dim]

    def make(i: int, j: int) -> pa.Table:
        v = coords.part(i * dim, j * dim).reshape(-1, dim)
        return pa.table({"node_id": np.arange(i, j, dtype=np.int64), **{a: np.ascontiguousarray(v[:, k]) for k, a in enumerate(axes)}})

    return parts.mapped(spark, parts.even(n, dim), make, "node_id bigint, " + ", ".join(f"{a} double" for a in axes))


def write_json(mesh: Mesh, path: str, pretty: bool = True) -> None:
    """One file of JSON, its arrays written by tasks."""
    _write_document(mesh, path, "pretty" if pretty else "compact")


def _read_json(spark: SparkSession, path: str) -> Mesh:
    return _read_document(spark, path, json.loads)


def _write_yaml(mesh: Mesh, path: str) -> None:
    _write_document(mesh, path, "yaml")


def _yaml(text: str | bytes) -> dict:
    import yaml

    try:
        return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def _read_yaml(spark: SparkSession, path: str) -> Mesh:
    return _read_document(spark, path, _yaml)


# -- VTK -----------------------------------------------------------------------------


class _Cells:
    """The cells of a mesh in order of type and id, whose arrays tasks write to a sink; ``form`` turns numbers into bytes."""

    def __init__(self, mesh: Mesh):
        self.m = dense(mesh)
        self.kinds = kinds(self.m, [])
        for t in self.kinds:
            if t not in etypes.VTK_CODES or t == "PHED":
                raise ValueError(f"this format has no cells like {t} here")
        self.n_nodes = self.m.nodes.count()
        self.n, self.n_ids = sum(k.n for k in self.kinds.values()), sum(k.n_ids for k in self.kinds.values())

    def points(self, sink: parts.Sink, form: Callable[[np.ndarray], bytes]) -> None:
        axes = list(self.m.axes)

        def render(_: int, t: pa.Table) -> bytes:
            v = np.zeros((t.num_rows, 3))
            for k, a in enumerate(axes):
                v[:, k] = t[a].to_numpy()
            return form(v.ravel())

        sink.rows(self.m.nodes.select("node_id", *[F.col(a).cast("double").alias(a) for a in axes]), "node_id", self.n_nodes, render)

    def conn(self, sink: parts.Sink, form: Callable[[np.ndarray], bytes], sized: bool = False) -> None:
        """Nodes; ``sized``: each cell's number of them before."""

        def render(_: int, t: pa.Table) -> bytes:
            v, sizes = parts.flat(t["conn"]), parts.sizes_of(t["conn"])
            return form(np.insert(v, np.r_[0, np.cumsum(sizes)[:-1]], sizes) if sized else v)

        for t, k in self.kinds.items():
            sink.rows(self.m.block(t).select("elem_id", "conn"), "elem_id", k.n, render)

    def ends(self, sink: parts.Sink, form: Callable[[np.ndarray], bytes]) -> None:
        base = 0
        for t, k in self.kinds.items():
            rows = self.m.block(t)
            if etypes.etype(t).is_poly:
                before = _ends_before(rows)
                render = lambda first, r, base=base, before=before: form(base + before[first // parts.ROWS] + np.cumsum(r["n"].to_numpy().astype(np.int64)))
            else:
                width = k.n_ids // k.n
                render = lambda first, r, base=base, width=width: form(base + (first + 1 + np.arange(r.num_rows)) * width)
            sink.rows(rows.select("elem_id", F.size("conn").alias("n")), "elem_id", k.n, render)
            base += k.n_ids

    def codes(self, sink: parts.Sink, form: Callable[[np.ndarray], bytes]) -> None:
        for t, k in self.kinds.items():
            sink.rows(self.m.block(t).select("elem_id"), "elem_id", k.n, lambda _, r, code=etypes.VTK_CODES[t]: form(np.full(r.num_rows, code)))


def _cell_counts(spark: SparkSession, cuts: list[tuple], codes: Numbers) -> tuple[list[dict[int, int]], dict[int, int]]:
    """For each cut the cells of each code before it, and those of all."""

    def make(i: int, j: int, *_) -> pa.Table:
        c, n = np.unique(codes.part(i, j, np.int64), return_counts=True)
        return pa.table({"i": np.full(len(c), i, np.int64), "code": c, "n": n.astype(np.int64)})

    rows = parts.mapped(spark, cuts, make, "i bigint, code bigint, n bigint").collect()  # a few a cut
    own: dict[int, dict[int, int]] = {}
    for r in rows:
        own.setdefault(r["i"], {})[r["code"]] = r["n"]
    before, total = [], {}
    for i, *_ in cuts:
        before.append(dict(total))
        for c, n in own.get(i, {}).items():
            total[c] = total.get(c, 0) + n
    return before, total


def from_cells(spark: SparkSession, points: Numbers, n_nodes: int, codes: Numbers, n: int, ends: Callable[[int, int], np.ndarray], conn: Numbers, n_ids: int) -> Mesh:
    """A mesh of arrays that tasks read; ``ends`` of cells i to j - 1, and that before."""

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        e = ends(i, j)
        return conn.part(int(e[0]), int(e[-1]), np.int64), np.diff(e)

    return _from_cuts(spark, points, n_nodes, codes, parts.even(n, max(1, n_ids // max(1, n))), cells)


def _from_cuts(spark: SparkSession, points: Numbers, n_nodes: int, codes: Numbers, cuts: list[tuple], cells: Callable[..., tuple[np.ndarray, np.ndarray]]) -> Mesh:
    names = {c: t for t, c in etypes.VTK_CODES.items() if t != "PHED"}
    before, total = _cell_counts(spark, cuts, codes)
    if unknown := set(total) - set(names):
        raise ValueError(f"cells with the codes {sorted(unknown)} cannot be read")
    sizes_by = {c: etypes.etype(t).n_nodes for c, t in names.items()}
    at = {cut[0]: b for cut, b in zip(cuts, before)}

    def make(i: int, j: int, *more) -> pa.Table:
        own, (ids, sizes) = codes.part(i, j, np.int64), cells(i, j, *more)
        number = np.empty(j - i, np.int64)
        for c in np.unique(own).tolist():
            mine = own == c
            number[mine] = at[i].get(c, 0) + np.arange(int(mine.sum()))
            if sizes_by[c] is not None and (sizes[mine] != sizes_by[c]).any():
                raise ValueError(f"an element of {names[c]} has {sizes_by[c]} nodes")
        return pa.table({"etype": pa.array([names[c] for c in own.tolist()], pa.string()), "elem_id": number, "conn": parts.lists(ids, sizes)})

    rows = parts.mapped(spark, cuts, make, "etype string, elem_id bigint, conn array<bigint>").withColumn("family", F.lit(0).cast("long"))
    return Mesh(from_numbers(spark, points, n_nodes, 3), _named(rows, []))


def _text(v: np.ndarray) -> bytes:
    return (" ".join(map(repr, v.tolist())) + "\n").encode()


def _write_vtu(mesh: Mesh, path: str) -> None:
    c = _Cells(mesh)
    with parts.Sink(mesh.spark, path) as sink:
        sink.put("<?xml version='1.0' encoding='utf-8'?>\n" + '<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64"><UnstructuredGrid>')
        sink.put(f'<Piece NumberOfPoints="{c.n_nodes}" NumberOfCells="{c.n}"><Points><DataArray type="Float64" Name="Points" NumberOfComponents="3" format="ascii">\n')
        c.points(sink, _text)
        sink.put("</DataArray></Points><Cells>")
        for name, kind, how in (("connectivity", "Int64", c.conn), ("offsets", "Int64", c.ends), ("types", "UInt8", c.codes)):
            sink.put(f'<DataArray type="{kind}" Name="{name}" format="ascii">\n')
            how(sink, _text)
            sink.put("</DataArray>")
        sink.put("</Cells></Piece></UnstructuredGrid></VTKFile>")


_VTU_TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}


def _data_array(node, root) -> np.ndarray:
    form, kind = node.get("format", "ascii"), _VTU_TYPES[node.get("type")]
    if form == "ascii":
        return np.array((node.text or "").split(), dtype=kind)
    if form != "binary" or root.get("compressor"):
        raise ValueError("only ascii and plain inline binary data can be read")
    order = "<" if root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
    raw = base64.b64decode("".join((node.text or "").split()))
    head = 8 if root.get("header_type") == "UInt64" else 4
    return np.frombuffer(raw[head:], dtype=order + kind)


_MARK = "\n@{}:{}:{}@\n"


def _words(uri: str, words: list[str], kind=float) -> Numbers:
    """The numbers that words and marks of stretches stand for."""
    out = Numbers(uri, " ")
    for w in words:
        out.add(tuple(map(int, w[1:-1].split(":"))) if w.startswith("@") else [kind(w)])
    return out


def _read_vtu(spark: SparkSession, path: str) -> Mesh:
    uri, text = parts.skeleton(spark, path, " ", _MARK)
    root = ElementTree.fromstring(text.encode())
    piece = root.find("./UnstructuredGrid/Piece")  # the first alone
    if piece is None:
        raise ValueError("the file holds no unstructured grid")

    def numbers(node, kind) -> Numbers:
        if node.get("format", "ascii") == "ascii":
            return _words(uri, (node.text or "").split(), kind)
        out = Numbers()
        out.add(_data_array(node, root).astype(kind).tolist())
        return out

    named = {d.get("Name"): numbers(d, int) for d in piece.findall("./Cells/DataArray")}
    points = numbers(piece.find("./Points/DataArray"), float)
    offsets, codes, conn = named["offsets"], named["types"], named["connectivity"]
    return from_cells(spark, points, len(points) // 3, codes, len(codes), lambda i, j: offsets.part(i - 1, j, np.int64) if i else np.r_[0, offsets.part(0, j, np.int64)], conn, len(conn))


def _write_vtk(mesh: Mesh, path: str) -> None:
    c = _Cells(mesh)
    with parts.Sink(mesh.spark, path) as sink:
        sink.put(f"# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {c.n_nodes} double\n")
        c.points(sink, _text)
        sink.put(f"CELLS {c.n} {c.n + c.n_ids}\n")
        c.conn(sink, _text, sized=True)
        sink.put(f"CELL_TYPES {c.n}\n")
        c.codes(sink, _text)


#: Cells of a legacy file that one task reads.
CELLS = 1 << 17


def _cell_places(spark: SparkSession, flat: Numbers, skip: int, n: int) -> list[tuple[int, int, int, int]]:
    """(first cell, end, first number, end) of every ``CELLS`` cells.

    Where a cell begins only the one before says, so that a single task walks through them, some numbers at a time.
    """

    def make(_: int) -> pa.Table:
        out, cell, at, total = [(0, skip)], 0, skip, len(flat)
        for a in range(skip, total, parts.NUMBERS):
            b = min(a + parts.NUMBERS, total)
            v = flat.part(a, b, np.int64).tolist()
            while at < b and cell < n:
                if v[at - a] < 0:
                    raise ValueError("a cell with less than no nodes")
                at, cell = at + v[at - a] + 1, cell + 1
                if cell % CELLS == 0 or cell == n:
                    out.append((cell, at))
            if cell == n:
                break
        if cell < n or at > total:
            raise ValueError("the file has less cells than it says")
        return pa.table({"cell": [c for c, _ in out], "at": [p for _, p in out]})

    rows = sorted(tuple(r) for r in parts.mapped(spark, [(0,)], make, "cell bigint, at bigint").collect())
    return [(c, d, a, b) for (c, a), (d, b) in zip(rows, rows[1:])]


def _read_vtk(spark: SparkSession, path: str) -> Mesh:
    uri, text = parts.skeleton(spark, path, " ", _MARK)
    if not text.startswith("# vtk") or not re.search(r"^ASCII\s*$", text, re.M):
        raise ValueError("only legacy files in ASCII can be read")

    def section(name: str) -> list[str]:
        m = re.search(rf"^{name}[ \t\n]", text, re.M)
        if not m:
            raise ValueError(f"the file has no {name}")
        return re.split(r"^[A-Z_]{4,}\b", text[m.end() :], maxsplit=1, flags=re.M)[0].split()

    # A stretch of numbers may hold the first ones of a section too, which say how many follow.
    n, _, *words = section("POINTS")
    points, flat, kinds_of = _words(uri, words), _words(uri, section("CELLS"), int), _words(uri, section("CELL_TYPES"), int)
    m = int(flat.part(0, 1, np.int64)[0])
    first = int(kinds_of.part(0, 1, np.int64)[0])
    if first < m:
        raise ValueError("the file has less types than cells")
    cuts = _cell_places(spark, flat, 2, m) if m else []
    codes = kinds_of.after(1)

    def cells(i: int, j: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        v, heads, at = flat.part(a, b, np.int64), [], 0
        listed = v.tolist()
        for _ in range(j - i):
            heads.append(at)
            at += listed[at] + 1
        return np.delete(v, heads), v[heads]

    return _from_cuts(spark, points, int(n), codes, cuts, cells)


# -- by extension --------------------------------------------------------------------


def _hdf(name: str) -> Callable:
    def call(*args):
        from meshloom.sources import vtkhdf

        return getattr(vtkhdf, name)(*args)

    return call


_READERS: dict[str, Callable] = {"json": _read_json, "yaml": _read_yaml, "yml": _read_yaml, "vtk": _read_vtk, "vtu": _read_vtu, "vtkhdf": _hdf("read"), "h5": _hdf("read"), "hdf5": _hdf("read"), "mesh": read_folder}
_WRITERS: dict[str, Callable] = {"json": write_json, "yaml": _write_yaml, "yml": _write_yaml, "vtk": _write_vtk, "vtu": _write_vtu, "vtkhdf": _hdf("write"), "h5": _hdf("write"), "hdf5": _hdf("write"), "mesh": write_folder}


def _by_extension(table: dict[str, Callable], path: str) -> tuple[Callable, str]:
    ext = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if ext not in table:
        raise ValueError(f"no format has the extension {ext!r}; there are {', '.join(table)}")
    return table[ext], path


def read(spark: SparkSession, path: str) -> Mesh:
    """The mesh in a file, by its extension in any case; ``.mesh`` is a folder of Parquet."""
    how, at = _by_extension(_READERS, path)
    return how(spark, at)


def write(mesh: Mesh, path: str) -> None:
    """Writes the mesh by the extension; see :func:`read`.  Elements with unknown nodes are left out of single files."""
    how, at = _by_extension(_WRITERS, path)
    how(mesh, at)


def blocks(mesh: Mesh) -> dict[str, np.ndarray]:
    """Connectivity by type as numpy arrays; of a poly type (flat, ends)."""
    a = to_arrays(mesh, False)
    return {t: (b.conn, b.ends()) if etypes.etype(t).is_poly else b.matrix() for t, b in a.blocks.items()}


def coords(mesh: Mesh) -> np.ndarray:
    return to_arrays(mesh, False).coords


def fields(mesh: Mesh) -> dict[tuple[str, int], dict[str, np.ndarray]]:
    """Fields by name and dimension, then type."""
    out: dict[tuple[str, int], dict[str, np.ndarray]] = {}
    for t, b in to_arrays(mesh).blocks.items():
        for f, v in b.fields.items():
            out.setdefault((f, etypes.etype(t).dim), {})[t] = v
    return out


