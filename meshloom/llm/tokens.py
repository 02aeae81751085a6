"""Token ids of texts by byte-level BPE, the merges made by DuckDB recursion within each partition.

A text is cut into pieces by the vocabulary's pattern.  The distinct pieces of a
partition that were not seen before go to DuckDB as rows of bytes; each step of the recursion merges, in
every piece at once, all places of its pair that comes first in the merge table.
A piece is done when it holds no pair of the table.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Characters of text that are cut into pieces at a time.
HELD = 2_000_000
#: Bytes of pieces in one recursion, and the most pieces remembered in a Python worker.
AT_ONCE = 200_000
REMEMBERED = 300_000

_MERGE = """
    with recursive s as (
        select p, 0 as n, i, tok from start
        union all
        select p, n + 1, i, case when take then id else tok end
        from (
            select *, coalesce(lag(take) over (partition by p order by i), false) as gone
            from (
                select *, hit and row_number() over (partition by p, hit, run order by i) % 2 = 1 as take  -- aaa: its first pair
                from (
                    select *, row_number() over (partition by p order by i) - row_number() over (partition by p, hit order by i) as run
                    from (
                        select *, coalesce(rank = first, false) as hit
                        from (
                            select a.*, m.rank, m.id, min(m.rank) over (partition by p) as first
                            from (select *, lead(tok) over (partition by p order by i) as next from s) a left join merges m on m.l = a.tok and m.r = a.next)
                        where first is not null))))
        where not gone)
    select p, list(tok order by i) as ids from s join (select p, max(n) as n from s group by p) using (p, n) group by p"""


def _bytes_written() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merger:
    """Ids of pieces by the vocabulary's merge table, remembered for pieces that come again."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import duckdb
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.first = [ids[c] for c in _bytes_written()]
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = pa.table({"l": [ids[a] for a, _ in pairs], "r": [ids[b] for _, b in pairs], "rank": range(len(pairs)), "id": [ids[a + b] for a, b in pairs]})
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.con.register("given", merges)
        self.con.execute("create table merges as select l::int as l, r::int as r, rank::int as rank, id::int as id from given")
        self.known: dict[str, array] = {}

    def _merge(self, pieces: list[str]) -> None:
        p, i, tok = array("i"), array("i"), array("i")
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            p.extend([k] * len(raw))
            i.extend(range(len(raw)))
            tok.extend([self.first[b] for b in raw])
        start = pa.table({name: pa.array(memoryview(v), type=pa.int32()) for name, v in (("p", p), ("i", i), ("tok", tok))})
        self.con.register("start", start)
        for k, ids in self.con.execute(_MERGE).fetchall():
            self.known[pieces[k]] = array("i", ids)
        self.con.unregister("start")

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        held, size = [], 0
        for piece in sorted(pieces - self.known.keys(), key=len):  # pieces of like length end after like numbers of steps
            held.append(piece)
            size += len(piece.encode())
            if size >= AT_ONCE:
                self._merge(held)
                held, size = [], 0
        if held:
            self._merge(held)

    def encode(self, texts: list[str | None]) -> list[array]:
        cut = [self.pieces(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        of = self.known.__getitem__
        return [array("i", chain.from_iterable(map(of, c))) for c in cut]


_merger: Merger | None = None


def merger() -> Merger:
    global _merger
    if _merger is None:
        _merger = Merger()
    return _merger


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for b, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= HELD or b == len(texts):
            yield a, b
            a, size = b, 0


def token_ids(documents: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document: special tokens' strings are ordinary text; empty and null texts have an empty list."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            for lo, hi in _chunks(texts):
                got = merger().encode(texts[lo:hi])
                offsets, flat = array("i", [0]), array("i")
                for ids in got:
                    flat.extend(ids)
                    offsets.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(memoryview(offsets), type=pa.int32()), pa.array(memoryview(flat), type=pa.int32()))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, hi - lo), lists], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>")
