"""Single files of any size: written and read by tasks a part at a time, so that the driver holds no array.

A file is written in order.  The driver puts short texts; each long array is rendered by tasks into
part files of the scratch folder, which are appended by Hadoop's streams and removed.
A file is read through :class:`Numbers`: arrays that know where in the file their numbers
lie, of which tasks parse the slices that they need.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.runtime import Scratch

#: Rows of an array in one part, and numbers that one task reads at least.
ROWS = 1 << 17
NUMBERS = 1 << 20
#: Bytes that a task looks through at a time, bytes of a span of numbers at most, and at least.
LOOKED, SPAN, SHORT = 16 << 20, 512 << 10, 4 << 10
#: What stands for the end of a face in files, where numbers have no sign.
FILE_FACE_END = 2**64 - 1


# -- writing ---------------------------------------------------------------------------


class Sink:
    """One file, written in order by Spark's file systems, in any store that the cluster reaches.

    Texts and arrays are named in order; all arrays are rendered by one job, and the file is put together at the end.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._items: list[bytes | int] = []  # an array by its place in _arrays
        self._arrays: list[tuple[DataFrame, int]] = []

    def __enter__(self) -> Sink:
        return self

    def __exit__(self, failed, *_) -> None:
        if failed is None:
            self._finish()

    def put(self, text: str | bytes) -> None:
        self._items.append(text.encode() if isinstance(text, str) else text)

    def rows(self, df: DataFrame, pos: str, n: int, render: Callable[[int, pa.Table], bytes]) -> None:
        """``render`` of the rows in order of ``pos``, which counts from 0 to ``n`` - 1; it gets the place of its first row, and ``ROWS`` rows."""
        if not n:
            return
        count, last, mine = -(-n // ROWS), n, len(self._arrays)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                t = pa.Table.from_batches(held)
                first = t[pos][0].as_py()
                if t.num_rows != min(ROWS, last - first):
                    raise ValueError("the rows are not numbered densely")
                yield pa.RecordBatch.from_arrays([pa.array([mine], pa.int32()), pa.array([render(first, t)], pa.binary())], ["array", "part"])

        cut = df.repartitionById(count, F.floor(F.col(pos) / ROWS).cast("int")).sortWithinPartitions(pos)
        self._arrays.append((cut.mapInArrow(work, "array int, part binary").select("array", F.col("part").cast("string")), count))
        self._items.append(mine)

    def _finish(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        scratch = Scratch(self.spark, "parts")
        if self._arrays:
            every = reduce(DataFrame.union, [df for df, _ in self._arrays])
            # A row a file, whose end of line is left out below; bytes pass as they are.
            every.write.partitionBy("array").option("compression", "none").text(scratch.path("rows"))
        at = path(self.path)
        out = at.getFileSystem(conf).create(at, True)
        try:
            for item in self._items:
                if isinstance(item, bytes):
                    out.write(bytearray(item))
                    continue
                folder = path(scratch.path(f"rows/array={item}"))
                fs = folder.getFileSystem(conf)
                found = sorted((int(m.group(1)), s.getPath(), s.getLen()) for s in fs.listStatus(folder) if (m := re.match(r"part-(\d+)", s.getPath().getName())))
                if len(found) != self._arrays[item][1]:
                    raise ValueError(f"{len(found)} parts of {self._arrays[item][1]} were written")
                for _, part, size in found:
                    data = fs.open(part)
                    try:
                        jvm.org.apache.commons.io.IOUtils.copyLarge(data, out, 0, size - 1)
                    finally:
                        data.close()
                    fs.delete(part, False)
        finally:
            out.close()
        scratch.close()


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """The values of a column of lists, one after the other."""
    c = column.combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False)


def sizes_of(column: pa.ChunkedArray) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.list_value_length(column).to_numpy().astype(np.int64)


# -- reading -----------------------------------------------------------------------------


def located(spark: SparkSession, path: str) -> tuple[str, int]:
    """The full name of a file, and its length."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    status = fs.getFileStatus(at)
    return status.getPath().toString(), status.getLen()


def opened(uri: str):
    """A file opened for reading at any place, in a task or the driver."""
    if uri.startswith("file:"):
        from urllib.parse import unquote, urlparse

        at = urlparse(uri).path
        import os

        return open(uri[5:] if os.path.exists(uri[5:]) else at if os.path.exists(at) else unquote(at), "rb")  # noqa: SIM115 - closed by the caller
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
    return system.open_input_file(at)


def _parse(raw: bytes, sep: str, dtype) -> np.ndarray:
    integer = np.dtype(dtype).kind in "iu"
    if b"l" in raw:
        raw = raw.replace(b"null", b"nan")
    if integer and b"18446744073709551615" in raw:
        raw = raw.replace(b"18446744073709551615", b"-1")
    raw = raw.strip(b", \t\r\n")
    words = (raw.replace(b",", b" ") if sep == "," else raw).split()
    if integer and (b"." in raw or b"e" in raw or b"E" in raw):
        return np.array([float(w) for w in words]).astype(dtype)
    return np.array(words).astype(dtype) if raw else np.zeros(0, dtype)


@dataclass
class Numbers:
    """An array of numbers, of which each segment is a list, a span (from, to, count) of a text file or of raw values, or a packed one with its filters at the end."""

    uri: str = ""
    sep: str = ","
    raw: str = ""  # the type of raw values
    segments: list = field(default_factory=list)
    starts: list[int] = field(default_factory=lambda: [0])

    def add(self, segment: list | tuple) -> None:
        if isinstance(segment, list) and self.segments and isinstance(self.segments[-1], list):
            self.segments[-1].extend(segment)
            self.starts[-1] += len(segment)
        elif isinstance(segment, tuple) or segment:
            self.segments.append(segment)
            self.starts.append(self.starts[-1] + (segment[2] if isinstance(segment, tuple) else len(segment)))

    def __len__(self) -> int:
        return self.starts[-1]

    def after(self, k: int) -> After:
        return After(self, k)

    def part(self, i: int, j: int, dtype=np.float64) -> np.ndarray:
        """The numbers from ``i`` to before ``j``, read where they lie."""
        out, k = [], bisect_right(self.starts, i) - 1
        if i < 0 or j > len(self):
            raise ValueError("an array is shorter than the file says")
        f = None
        try:
            while i < j:
                first, end, seg = self.starts[k], self.starts[k + 1], self.segments[k]
                a, b = i - first, min(j, end) - first
                if isinstance(seg, list):
                    v = _values(seg[a:b], dtype)
                else:
                    f = f or opened(self.uri)
                    size = np.dtype(self.raw).itemsize if self.raw else 0
                    f.seek(seg[0] + (a * size if len(seg) == 3 else 0))
                    if len(seg) > 3:
                        v = np.frombuffer(unpacked(f.read(seg[1] - seg[0]), seg[3], size), self.raw)[a:b].astype(dtype)
                    elif size:
                        v = np.frombuffer(f.read((b - a) * size), self.raw).astype(dtype)
                        v = v if len(v) == b - a else v[:0]
                    else:
                        v = _parse(f.read(seg[1] - seg[0]), self.sep, dtype)
                        v = v[a:b] if len(v) == seg[2] else v[:0]
                    if len(v) != b - a:
                        raise ValueError("numbers cannot be read")
                out.append(v)
                i, k = first + b, k + 1
        finally:
            if f:
                f.close()
        return np.concatenate(out) if out else np.zeros(0, dtype)


@dataclass
class After:
    """An array without its first numbers."""

    whole: Numbers
    skip: int

    def __len__(self) -> int:
        return len(self.whole) - self.skip

    def part(self, i: int, j: int, dtype=np.float64) -> np.ndarray:
        return self.whole.part(i + self.skip, j + self.skip, dtype)


def _values(v: list, dtype) -> np.ndarray:
    if np.dtype(dtype).kind == "f":
        return np.array([np.nan if x is None else x for x in v], dtype=dtype)
    return np.array([-1 if x == FILE_FACE_END else x for x in v]).astype(dtype) if v else np.zeros(0, dtype)


def unpacked(raw: bytes, filters: list[int], size: int) -> bytes:
    """A chunk of an HDF5 file as it was before its filters, which are given in the order in which they were applied."""
    for code in reversed(filters):
        if code == 1:
            raw = zlib.decompress(raw)
        elif code == 2:
            raw = np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes()
        else:
            raw = raw[:-4]
    return raw


_NUMERIC = np.zeros(256, bool)
_NUMERIC[list(b"0123456789+-.eE, \t\r\nnulaNif")] = True  # with null, nan and inf
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


def _aligned(f, at: int, size: int) -> int:
    """The first place from ``at`` on that follows a comma or blank."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    p = at - 1
    while p < size:
        f.seek(p)
        block = f.read(64 << 10)
        if m := re.search(rb"[, \t\r\n]", block):
            return p + m.end()
        p += len(block)
    return size


def _spans(data: bytes, sep: str) -> Iterator[tuple[int, int, int]]:
    """(from, to, count) of the stretches of ``data`` that hold nothing but numbers, each ended by its separator."""
    codes = np.frombuffer(data, np.uint8)
    other = np.flatnonzero(~_NUMERIC[codes])
    edges = np.r_[-1, other, len(codes)]
    for g in np.flatnonzero(np.diff(edges) > SHORT):
        a, b = int(edges[g]) + 1, int(edges[g + 1])
        ends = np.flatnonzero(codes[a:b] == ord(",") if sep == "," else _BLANK[codes[a:b]]) + a
        if sep != ",":
            ends = ends[np.r_[True, np.diff(ends) > 1]] if len(ends) else ends  # one for a run of blanks
        if len(ends) < 3 or (ends[-1] - ends[0]) / (len(ends) - 1) > 400:
            continue
        lo = int(ends[0]) + 1
        cuts = np.unique(np.r_[np.searchsorted(ends, np.arange(lo + SPAN, int(ends[-1]), SPAN)), len(ends) - 1])
        before = 0
        for c in cuts[cuts > 0]:
            yield lo, int(ends[c]) + 1, int(c) - before
            lo, before = int(ends[c]) + 1, int(c)


def skeleton(spark: SparkSession, path: str, sep: str, mark: str) -> tuple[str, str]:
    """The full name of a text file, and its text with long stretches of numbers replaced by ``mark`` of their (from, to, count).

    The stretches are found by tasks; what is left is held by the driver.
    """
    uri, size = located(spark, path)
    n = max(1, -(-size // LOOKED))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                f = opened(uri)
                try:
                    a, b = _aligned(f, k * LOOKED, size), _aligned(f, (k + 1) * LOOKED, size)
                    f.seek(a)
                    data = f.read(max(0, b - a))
                finally:
                    f.close()
                out, at = [], 0
                for lo, hi, count in _spans(data, sep):
                    out += [data[at:lo], mark.format(lo + a, hi + a, count).encode()]
                    at = hi
                out.append(data[at:])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([b"".join(out)], pa.binary())], ["k", "text"])

    found = spark.range(0, n, 1, n).mapInArrow(work, "k bigint, text binary").collect()
    return uri, b"".join(bytes(r["text"]) for r in sorted(found, key=lambda r: r["k"])).decode(errors="replace")


def ranges(spark: SparkSession, cuts: list[tuple]) -> DataFrame:
    """A task for each of ``cuts``, in column ``k`` its place."""
    return spark.range(0, len(cuts), 1, max(1, len(cuts)))


def even(n: int, width: int) -> list[tuple[int, int]]:
    """Ranges of rows with about ``NUMBERS`` numbers each."""
    step = max(1, NUMBERS // max(1, width))
    return [(a, min(a + step, n)) for a in range(0, n, step)]


def mapped(spark: SparkSession, cuts: list[tuple], make: Callable[..., pa.Table | None], schema: str) -> DataFrame:
    """The rows that ``make`` gives for each of ``cuts``, read anew when they are needed."""
    if not cuts:
        return spark.createDataFrame([], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                t = make(*cuts[k])
                if t is not None:
                    yield from t.to_batches(max_chunksize=16384)

    return ranges(spark, cuts).mapInArrow(work, schema)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
