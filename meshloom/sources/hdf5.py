"""A small part of the HDF5 file format (the public specification, version 3): enough for files of a few datasets.

Written are plain groups, and datasets in one piece.  Read are also files of
newer versions, datasets in chunks, and those packed by deflate and shuffle;
groups so large that their links lie in a separate heap cannot be read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from meshloom.sources.parts import Numbers, located, opened, unpacked

_UNDEFINED = 2**64 - 1
# Fixed values of the format.
_SIGNATURE = b"\x89HDF\r\n\x1a\n"
_DATASPACE, _DATATYPE, _FILL, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _CONTINUED, _SYMBOLS = 0x01, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
_LEAF_K, _INNER_K = 4, 16


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 8)


# -- writing --------------------------------------------------------------------------


@dataclass
class Later:
    """An array that is written when its turn comes: ``write`` gives the sink all of its bytes."""

    shape: tuple[int, ...]
    dtype: np.dtype
    write: Callable


@dataclass
class Far:
    """An array that stays in its file until it is read."""

    shape: tuple[int, ...]
    numbers: Numbers

    def __getitem__(self, k: int):
        return self.numbers.part(k, k + 1, np.dtype(self.numbers.raw))[0]


@dataclass
class Group:
    """Members by name (groups and arrays, at most 8), and attributes (arrays of numbers, or texts)."""

    members: dict[str, Group | np.ndarray | Later | Far] = field(default_factory=dict)
    attributes: dict[str, np.ndarray | str] = field(default_factory=dict)


def _datatype(v: np.ndarray | Later | str) -> bytes:
    if isinstance(v, str):
        return struct.pack("<BBBBI", 0x13, 1, 0, 0, max(len(v.encode()), 1))
    size = v.dtype.itemsize
    if v.dtype.kind == "f":
        exponent, mantissa, bias = {8: (11, 52, 1023), 4: (8, 23, 127)}[size]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, mantissa, exponent, 0, mantissa, bias)
    return struct.pack("<BBBBIHH", 0x10, 8 if v.dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)


def _dataspace(shape: tuple[int, ...]) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)


def _message(kind: int, body: bytes) -> bytes:
    body = _pad(body)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def _header(messages: list[bytes]) -> bytes:
    body = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def _attribute(name: str, v: np.ndarray | str) -> bytes:
    key, kind = name.encode() + b"\0", _datatype(v)
    space = _dataspace(() if isinstance(v, str) else v.shape)
    data = v.encode() if isinstance(v, str) else v.astype(v.dtype.newbyteorder("<")).tobytes()
    return _message(_ATTRIBUTE, struct.pack("<BxHHH", 1, len(key), len(kind), len(space)) + _pad(key) + _pad(kind) + _pad(space) + data)


class _Writer:
    def __init__(self) -> None:
        self.parts: list[bytes | Later] = []
        self.at = 96  # the superblock comes first

    def put(self, b: bytes) -> int:
        here = self.at
        b = _pad(b)
        self.parts.append(b)
        self.at += len(b)
        return here

    def array(self, v: np.ndarray | Later) -> int:
        if isinstance(v, Later):
            where, length = self.at, int(np.prod(v.shape, dtype=np.int64)) * v.dtype.itemsize
            self.parts += [v, bytes(-length % 8)]
            self.at += length + -length % 8
            where = where if length else _UNDEFINED
        else:
            data = np.ascontiguousarray(v).astype(v.dtype.newbyteorder("<")).tobytes()
            where, length = self.put(data) if data else _UNDEFINED, len(data)
        fill = struct.pack("<BBBB", 2, 2, 2, 0)
        layout = struct.pack("<BBQQ", 3, 1, where, length)
        return self.put(_header([_message(_DATASPACE, _dataspace(v.shape)), _message(_DATATYPE, _datatype(v)), _message(_FILL, fill), _message(_LAYOUT, layout)]))

    def group(self, g: Group) -> int:
        if len(g.members) > 2 * _LEAF_K:
            raise ValueError("too many members in a group")
        entries, names = [], bytearray(8)
        for name in sorted(g.members):
            v = g.members[name]
            where = self.group(v) if isinstance(v, Group) else self.array(v)
            entries.append(struct.pack("<QQI4x16x", len(names), where, 0))
            names += _pad(name.encode() + b"\0")
            last = entries[-1][:8]
        heap_data = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, heap_data))
        leaf = self.put(b"SNOD" + struct.pack("<BxH", 1, len(entries)) + b"".join(entries) + bytes(40 * (2 * _LEAF_K - len(entries))))
        keys = struct.pack("<QQ", 0, leaf) + last if entries else b""
        size = 8 * (2 * 2 * _INNER_K + 1)
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1 if entries else 0, _UNDEFINED, _UNDEFINED) + keys + bytes(size - len(keys)))
        return self.put(_header([_message(_SYMBOLS, struct.pack("<QQ", tree, heap)), *[_attribute(k, v) for k, v in g.attributes.items()]]))


def pieces(root: Group) -> list[bytes | Later]:
    """A file in order."""
    w = _Writer()
    at = w.group(root)
    front = _SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", _LEAF_K, _INNER_K, 0) + struct.pack("<QQQQ", 0, _UNDEFINED, w.at, _UNDEFINED) + struct.pack("<QQI4x16x", 0, at, 0)
    return [front, *w.parts]


def dump(root: Group) -> bytes:
    """The bytes of a file."""
    return b"".join(pieces(root))


# -- reading ----------------------------------------------------------------------------


class _Window:
    """A file as if it were bytes; a block of it is held."""

    BLOCK = 64 << 10

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def __getitem__(self, k: int | slice):
        if not isinstance(k, slice):
            return self[k : k + 1][0]
        a, b = k.start or 0, min(self.size if k.stop is None else k.stop, self.size)
        if b <= a:
            return b""
        if a < self.at or b > self.at + len(self.held):
            self.file.seek(a)
            self.at, self.held = a, self.file.read(max(b - a, self.BLOCK))
        return self.held[a - self.at : b - self.at]

    def startswith(self, head: bytes) -> bool:
        return self[: len(head)] == head

    def index(self, what: bytes, start: int) -> int:
        n = 64
        while (at := self[start : start + n].find(what)) < 0:
            if start + n >= self.size:
                raise ValueError("a name in the file does not end")
            n *= 4
        return start + at


class _Reader:
    def __init__(self, data: bytes | _Window, uri: str = ""):
        self.d, self.uri = data, uri  # with a name, arrays stay in the file
        if not data.startswith(_SIGNATURE):
            raise ValueError("this is no HDF5 file")
        version = data[8]
        if version < 2:
            skip = 4 if version == 1 else 0
            if data[13] != 8 or data[14] != 8:
                raise ValueError("only files with addresses of eight bytes can be read")
            self.root = self.u(24 + skip + 32 + 8, 8)
        else:
            self.root = self.u(8 + 4 + 24, 8)

    def u(self, at: int, n: int) -> int:
        return int.from_bytes(self.d[at : at + n], "little")

    def messages(self, at: int) -> list[tuple[int, bytes]]:
        if self.d[at : at + 4] == b"OHDR":
            return self._messages2(at)
        left, out = self.u(at + 2, 2), []
        spans = [(at + 16, self.u(at + 8, 4))]
        while spans and left:
            p, size = spans.pop(0)
            end = p + size
            while p + 8 <= end and left:
                kind, n = self.u(p, 2), self.u(p + 2, 2)
                body = self.d[p + 8 : p + 8 + n]
                p, left = p + 8 + n, left - 1
                if kind == _CONTINUED:
                    spans.append(struct.unpack("<QQ", body[:16]))
                else:
                    out.append((kind, body))
        return out

    def _messages2(self, at: int) -> list[tuple[int, bytes]]:
        flags = self.d[at + 5]
        p = at + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
        n = 1 << (flags & 3)
        spans, out = [(p + n, self.u(p, n))], []
        head = 6 if flags & 0x04 else 4
        while spans:
            p, size = spans.pop(0)
            end = p + size
            while p + head <= end:
                kind, n = self.d[p], self.u(p + 1, 2)
                body = self.d[p + head : p + head + n]
                p += head + n
                if kind == _CONTINUED:
                    a, s = struct.unpack("<QQ", body[:16])
                    spans.append((a + 4, s - 8))  # between its signature and its checksum
                elif kind:
                    out.append((kind, body))
        return out

    def links(self, messages: list[tuple[int, bytes]]) -> dict[str, int]:
        out: dict[str, int] = {}
        for kind, body in messages:
            if kind == _SYMBOLS:
                tree, heap = struct.unpack("<QQ", body[:16])
                self._symbols(tree, self.u(heap + 24, 8), out)
            elif kind == _LINK:
                flags, p = body[1], 2
                hard = True
                if flags & 0x08:
                    hard, p = body[p] == 0, p + 1
                p += (8 if flags & 0x04 else 0) + (1 if flags & 0x10 else 0)
                n = 1 << (flags & 3)
                size = int.from_bytes(body[p : p + n], "little")
                name = body[p + n : p + n + size].decode()
                if hard:
                    out[name] = int.from_bytes(body[p + n + size : p + n + size + 8], "little")
        return out

    def _symbols(self, at: int, names: int, out: dict[str, int]) -> None:
        level, used = self.d[at + 5], self.u(at + 6, 2)
        for k in range(used):
            child = self.u(at + 24 + 8 + 16 * k, 8)
            if level:
                self._symbols(child, names, out)
                continue
            for e in range(self.u(child + 6, 2)):
                p = child + 8 + 40 * e
                name = names + self.u(p, 8)
                out[self.d[name : self.d.index(b"\0", name)].decode()] = self.u(p + 8, 8)

    # values

    def dtype(self, b: bytes) -> np.dtype:
        kind, size = b[0] & 15, int.from_bytes(b[4:8], "little")
        order = ">" if b[1] & 1 else "<"
        if kind == 0:
            return np.dtype(f"{order}{'i' if b[1] & 8 else 'u'}{size}")
        if kind == 1:
            return np.dtype(f"{order}f{size}")
        if kind == 3:
            return np.dtype(f"S{size}")
        raise ValueError("only numbers and texts of fixed size can be read")

    def shape(self, b: bytes) -> tuple[int, ...]:
        first = 8 if b[0] == 1 else 4
        return tuple(int.from_bytes(b[first + 8 * k : first + 8 * k + 8], "little") for k in range(b[1]))

    def array(self, messages: list[tuple[int, bytes]]) -> np.ndarray:
        got = dict(messages)
        dtype, shape, b = self.dtype(got[_DATATYPE]), self.shape(got[_DATASPACE]), got[_LAYOUT]
        count = int(np.prod(shape, dtype=np.int64))
        if b[0] == 3 and b[1] == 0:
            raw = b[4 : 4 + int.from_bytes(b[2:4], "little")]
        elif b[0] in (3, 4) and b[1] == 1:
            at = int.from_bytes(b[2:10], "little")
            if self.uri and at != _UNDEFINED and dtype.kind in "iuf":
                return Far(shape, Numbers(self.uri, raw=dtype.str, segments=[(at, at + count * dtype.itemsize, count)], starts=[0, count]))
            raw = b"" if at == _UNDEFINED else self.d[at : at + count * dtype.itemsize]
        elif b[0] == 3 and b[1] == 2:
            return self._chunks(b, dtype, shape, self._filters(got.get(_FILTERS)))
        else:
            raise ValueError("a dataset is laid out in a way that cannot be read")
        return np.frombuffer(raw, dtype=dtype, count=count).reshape(shape) if raw else np.zeros(shape, dtype)

    def _filters(self, b: bytes | None) -> list[int]:
        if not b:
            return []
        out, p = [], 8 if b[0] == 1 else 2
        for _ in range(b[1]):
            code = int.from_bytes(b[p : p + 2], "little")
            p += 2
            named = b[0] == 1 or code >= 256
            length = int.from_bytes(b[p : p + 2], "little") if named else 0
            p += 2 if named else 0
            values = int.from_bytes(b[p + 2 : p + 4], "little")
            p += 4 + (length + (-length % 8 if b[0] == 1 else 0)) + 4 * values + (4 if b[0] == 1 and values % 2 else 0)
            if code not in (1, 2, 3):
                raise ValueError("a dataset is packed in a way that cannot be read")
            out.append(code)
        return out

    def _chunks(self, b: bytes, dtype: np.dtype, shape: tuple[int, ...], filters: list[int]) -> np.ndarray:
        rank = b[2]
        tree = int.from_bytes(b[3:11], "little")
        chunk = [int.from_bytes(b[11 + 4 * k : 15 + 4 * k], "little") for k in range(rank - 1)]
        whole = self.uri and shape and tree != _UNDEFINED and tuple(chunk[1:]) == shape[1:] and dtype.kind in "iuf"
        found: list[tuple[int, int, int, list[int]]] = []  # of chunks that hold whole rows: first row, place, bytes, filters
        out = np.zeros(0 if whole else shape, dtype)

        def visit(at: int) -> None:
            level, used, key = self.d[at + 5], self.u(at + 6, 2), 8 + 8 * rank
            for k in range(used):
                p = at + 24 + k * (key + 8)
                child = self.u(p + key, 8)
                if level:
                    visit(child)
                    continue
                size, skipped = self.u(p, 4), self.u(p + 4, 4)
                used_ = [code for i, code in enumerate(filters) if not skipped >> i & 1]
                if whole:
                    found.append((self.u(p + 8, 8), child, size, used_))
                    continue
                raw = unpacked(self.d[child : child + size], used_, dtype.itemsize)
                start = [self.u(p + 8 + 8 * j, 8) for j in range(rank - 1)]
                block = np.frombuffer(raw, dtype, count=int(np.prod(chunk))).reshape(chunk)
                into = tuple(slice(s, min(s + c, n)) for s, c, n in zip(start, chunk, shape))
                out[into] = block[tuple(slice(0, i.stop - i.start) for i in into)]

        if tree != _UNDEFINED:
            visit(tree)
        if not whole:
            return out
        numbers, width, row = Numbers(self.uri, raw=dtype.str), int(np.prod(shape[1:], dtype=np.int64)), 0
        for first, at, size, used_ in [*sorted(found), (shape[0], 0, 0, [])]:
            if first > row:  # a chunk that was never written holds zeros
                numbers.add([0] * ((first - row) * width))
            row = min(first + chunk[0], shape[0])
            if row > first:
                numbers.add((at, at + size, (row - first) * width, used_))
        return Far(shape, numbers)

    def attributes(self, messages: list[tuple[int, bytes]]) -> dict[str, np.ndarray | str]:
        out: dict[str, np.ndarray | str] = {}
        for kind, b in messages:
            if kind != _ATTRIBUTE:
                continue
            version = b[0]
            n, t, s = struct.unpack("<HHH", b[2:8])
            p = 9 if version == 3 else 8
            step = (lambda k: k + -k % 8) if version == 1 else (lambda k: k)
            name = b[p : p + n].rstrip(b"\0").decode()
            p += step(n)
            try:
                dtype = self.dtype(b[p : p + t])
            except ValueError:
                continue
            p += step(t)
            shape = self.shape(b[p : p + s]) if s else ()
            p += step(s)
            v = np.frombuffer(b, dtype, count=int(np.prod(shape, dtype=np.int64)), offset=p).reshape(shape)
            out[name] = v.ravel()[0].decode() if dtype.kind == "S" else v
        return out


def load(data: bytes) -> Group:
    """The root group of a file, with all arrays read."""
    return _root(_Reader(data))


def far(spark: SparkSession, path: str) -> Group:
    """The root group of a file, whose arrays stay there: in one piece, or in chunks of whole rows; others are read."""
    uri, size = located(spark, path)
    with opened(uri) as f:
        return _root(_Reader(_Window(f, size), uri))


def _root(r: _Reader) -> Group:
    def group(messages: list[tuple[int, bytes]]) -> Group:
        g = Group({}, r.attributes(messages))
        for name, at in r.links(messages).items():
            own = r.messages(at)
            g.members[name] = r.array(own) if _LAYOUT in dict(own) else group(own)
        return g

    return group(r.messages(r.root))
