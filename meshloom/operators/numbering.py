"""Numbering the rows of groups of very different size without a task per group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.runtime import Scratch, partitions_for

#: Columns that the operator adds while it works; inputs may not have them.
_PART, _RUN, _POS, _EDGE = "__part", "__run", "__pos", "__edge"


def _changed(now: pa.Array, before: pa.Array) -> pa.Array:
    """Where two columns differ; null equals null and NaN equals NaN."""
    same = pc.fill_null(pc.equal(now, before), False)
    same = pc.or_(same, pc.and_(pc.is_null(now), pc.is_null(before)))
    if pa.types.is_floating(now.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(before)), False))
    return pc.invert(same)


def _runs(keys: list[str]):
    """A function over the sorted batches of one partition: each row's run of equal keys, its place in the run, and whether it is the partition's first (1), last (2) or both (3)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None
        run, place, held, first = -1, 0, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, dtype=bool)
            for k in keys:
                col = batch.column(k)
                if n > 1:
                    starts[1:] |= np.asarray(_changed(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False), dtype=bool)
                starts[0] |= last is None or bool(_changed(col.slice(0, 1), last.column(k))[0].as_py())
            if last is None:
                starts[0] = True
            runs = run + np.cumsum(starts)
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            pos = np.where(begin >= 0, at - begin, at + place)
            edge = np.zeros(n, dtype=np.int8)
            edge[0] |= first
            first = False
            run, place, last = int(runs[-1]), int(pos[-1]) + 1, batch.slice(n - 1, 1)
            if held is not None:
                yield _with(held)
            held = (batch, part, runs, pos, edge)
        if held is not None:
            held[4][-1] |= 2
            yield _with(held)

    def _with(held) -> pa.RecordBatch:
        batch, part, runs, pos, edge = held
        more = [pa.repeat(pa.scalar(part, pa.int32()), batch.num_rows), pa.array(runs, pa.int64()), pa.array(pos, pa.int64()), pa.array(edge, pa.int8())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, _PART, _RUN, _POS, _EDGE])

    return work


def number_within_groups(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", partitions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with column ``name``: each row's number, from 0, within its group of equal ``keys`` by ``order``.

    The rows are range partitioned on keys and order together, by quantiles
    that Spark samples, so a group of any size is spread over as many partitions
    as its share of the rows asks for.  Each partition numbers its runs; the one
    state that crosses a boundary (how many rows of the partition's first group
    lie in earlier partitions) is stitched on the driver from two rows a
    partition, and added to that first run alone.

    Null is a key and an order value like any other, and comes first; NaN equals
    NaN.  Rows equal in keys and order all lie in one partition and are numbered
    in an arbitrary order: drop exact duplicates before.  Other columns are kept.
    An empty table gives an empty one.  ``partitions`` defaults to
    what the size of the tables read asks for, ``spark.sql.shuffle.partitions`` at least.
    """
    spark = df.sparkSession
    if clash := {_PART, _RUN, _POS, _EDGE, name} & set(df.columns):
        raise ValueError(f"the table already has columns {sorted(clash)}")
    if name in (_PART, _RUN, _POS, _EDGE):
        raise ValueError(f"{name!r} is taken")
    scratch = scratch or Scratch(spark, "numbering")
    n = partitions or partitions_for(df)
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    schema = T.StructType([*df.schema.fields, T.StructField(_PART, T.IntegerType()), T.StructField(_RUN, T.LongType()), T.StructField(_POS, T.LongType()), T.StructField(_EDGE, T.ByteType())])
    numbered = scratch.save(df.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_runs(keys), schema), "numbered")

    edges = numbered.where(F.col(_EDGE) > 0).select(*keys, _PART, _RUN, _POS, _EDGE).collect()  # two rows a partition at most
    ends: dict[int, dict] = {}
    for r in edges:
        ends.setdefault(r[_PART], {}).update({bit: r for bit in (1, 2) if r[_EDGE] & bit})
    key = lambda r: tuple(repr(r[k]) for k in keys)
    carry, open_key, open_rows = [], None, 0
    for part, own in sorted(ends.items()):
        goes_on = key(own[1]) == open_key
        if goes_on:
            carry.append((part, open_rows))
        rows = own[2][_POS] + 1
        open_rows = open_rows + rows if goes_on and own[2][_RUN] == 0 else rows
        open_key = key(own[2])
    plain = numbered.drop(_EDGE)
    if not carry:
        return plain.withColumn(name, F.col(_POS)).drop(_PART, _RUN, _POS)
    add = F.broadcast(spark.createDataFrame(carry, f"{_PART} int, __carry long"))  # a row a partition at most
    more = F.when(F.col(_RUN) == 0, F.coalesce(F.col("__carry"), F.lit(0))).otherwise(F.lit(0))
    return plain.join(add, _PART, "left").withColumn(name, F.col(_POS) + more).select(*df.columns, name)
