"""Percentiles of large columns from merging centroid digests, with a certified rank error.

After Dunning and Ertl, "Computing extremely accurate quantiles using
t-digests" (2019).  Values are sorted and cut into clusters whose share of the
values shrinks towards both ends: between two cuts the scale
k(q) = delta / (2 pi) * asin(2 q - 1) grows by one at most.  Digests of
partitions, days or weeks merge by sorting their centroids together and
clustering them again.  A second pass over the values counts how many lie below
and at each estimate, so that the error in rank is known, not presumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meshloom.runtime import Scratch, small

#: A digest has about half as many clusters; one cluster holds about pi / DELTA of the values at most, in the middle.
DELTA = 1000
#: How many times as fine a digest is made where an estimate could not be certified.
FINER = 8
#: Partitions whose digests are merged in one task.
FAN_IN = 64
#: Values held in a Python worker before they are turned into digests.
HELD = 2_000_000


def _cluster(group, mean, weight, delta: float):
    """Clusters sorted centroids (by group, then mean); arrays in, arrays out."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    total = np.add.reduceat(weight, starts)
    sizes = np.diff(np.r_[starts, len(group)])
    before = np.cumsum(weight) - weight
    before -= np.repeat(before[starts], sizes)
    all_of = np.repeat(total, sizes)
    # The mid-rank of each centroid decides its cluster; one that is alone beyond the size limit stays alone.
    q = np.clip((before + weight / 2) / all_of, 0, 1)
    k = np.floor(delta / (2 * np.pi) * np.arcsin(2 * q - 1))
    new = np.r_[True, (group[1:] != group[:-1]) | (k[1:] != k[:-1])] if len(group) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    w = np.add.reduceat(weight, at)
    m = np.add.reduceat(mean * weight, at) / w
    alone = np.diff(np.r_[at, len(group)]) == 1
    m[alone] = mean[at][alone]  # no rounding where nothing was merged
    return group[at], m, w


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], T.StructField("mean", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("part", T.LongType())])


def _digester(keys: list[str], value: str, delta: float, held_rows: int, schema: pa.Schema):
    def flush(held: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        import numpy as np

        t = pa.Table.from_batches(held)
        flat = lambda name: pa.concat_arrays(t[name].chunks)
        codes, cols = np.zeros(t.num_rows, dtype=np.int64), {}
        for k in keys:
            cols[k] = flat(k)
            e = cols[k].dictionary_encode(null_encoding="encode")
            codes = np.unique(codes * (len(e.dictionary) + 1) + e.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        v = flat(value).to_numpy(zero_copy_only=False)
        order = np.lexsort((v, codes))
        g, m, n = _cluster(codes[order], v[order], np.ones(len(v)), delta)
        at = pa.array(np.unique(codes, return_index=True)[1][g])
        return pa.RecordBatch.from_arrays([*[cols[k].take(at) for k in keys], pa.array(m), pa.array(n), pa.array(np.full(len(g), part, dtype=np.int64))], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, rows, part = [], 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= held_rows:
                yield flush(held, part)
                held, rows, part = [], 0, part + 1
        if held:
            yield flush(held, part)

    return work


def digest(df: DataFrame, keys: list[str], value: str, delta: float = DELTA, held_rows: int = HELD) -> DataFrame:
    """(keys, mean, weight, part): digests of the finite values of each group, one a group and input partition.

    Works where the rows lie, without a shuffle: only centroids leave a partition.
    Null, NaN and infinite values are left out; a group without
    a finite value has no digest; null is a key like any other.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, v.alias(value))
    schema = _schema(df, keys)
    return rows.mapInArrow(_digester(keys, value, delta, held_rows, to_arrow_schema(schema)), schema)


def merge_digests(digests: DataFrame, keys: list[str], delta: float = DELTA, fan_in: int = FAN_IN) -> DataFrame:
    """One digest a group (``part`` 0) of all of its digests, those of several days or weeks included.

    Digests are merged in two steps, the first over those of ``fan_in`` partitions: so a
    group whose values fill most partitions is not brought to one task at once.
    """
    schema = _schema(digests, keys)
    arrow = to_arrow_schema(schema)

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        def work(t: pa.Table) -> pa.Table:
            import numpy as np

            m, w = t["mean"].to_numpy(), t["weight"].to_numpy()
            order = np.argsort(m, kind="stable")
            _, mean, weight = _cluster(np.zeros(len(m), dtype=np.int64), m[order], w[order], delta)
            same = pa.array(np.zeros(len(mean), dtype=np.int64))
            part = t["__salt"][0].as_py() if "__salt" in by else 0
            return pa.Table.from_arrays([*[t[k].take(same) for k in keys], pa.array(mean), pa.array(weight), pa.array(np.full(len(mean), part, dtype=np.int64))], schema=arrow)

        return df.groupBy(*by).applyInArrow(work, schema)

    salted = digests.withColumn("__salt", F.floor(F.shiftright("part", 32) / fan_in))
    return merged(merged(salted, [*keys, "__salt"]), keys)


def quantiles(digests: DataFrame, keys: list[str], wanted: DataFrame, on: list[str], q: str = "q") -> DataFrame:
    """For each row of ``wanted`` (columns ``on`` and ``q`` from 0 to 1) and each merged digest that agrees in ``on``: the estimate and ``total``, the values of the group.

    Between the centroids around a rank the value is interpolated; a centroid of
    one value is that value.
    """
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("mean", "weight")
    c = digests.select(
        *keys,
        "mean",
        "weight",
        (F.sum("weight").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")).alias("__from"),
        F.sum("weight").over(whole).alias("total"),
        F.lead("mean").over(ordered).alias("__next"),
        F.lag("mean").over(ordered).alias("__prev"),
    )
    rank = F.greatest(F.lit(1.0), F.ceil(F.round(F.col(q) * F.col("total"), 6)).cast("double"))
    hit = c.join(small(wanted), on).where((F.col("__from") < rank) & (rank <= F.col("__from") + F.col("weight")))
    # A cluster's values are taken to lie evenly about its mean, half of it towards either neighbour.
    place = (rank - 0.5 - F.col("__from")) / F.col("weight") - 0.5
    reach = F.when(place < 0, F.col("mean") - F.coalesce(F.col("__prev"), F.col("mean"))).otherwise(F.coalesce(F.col("__next"), F.col("mean")) - F.col("mean"))
    estimate = F.when(F.col("weight") == 1, F.col("mean")).otherwise(F.col("mean") + place * reach)
    return hit.select(*dict.fromkeys([*keys, *wanted.columns]), estimate.alias("estimate"), F.col("total").cast("long").alias("total"))


def certify(values: DataFrame, estimates: DataFrame, on: list[str], value: str, q: str = "q", limit: Column | None = None) -> DataFrame:
    """The second pass: ``estimates`` with ``below`` and ``at_or_below`` (values of the group that are so to the estimate), ``snapped`` and ``lifted`` (its largest value at or below it, its smallest at or above it), and ``rank_error``.

    ``rank_error`` is the distance, as a share of the values, from the wanted rank to the ranks that
    the estimate holds.  ``on`` names the group in both tables.  With ``limit``, a column of
    ``estimates``, also ``within``: the values at or below it.  The estimates are broadcast up to a checked
    number of rows (beyond, a group of any size is split by Spark's adaptive skew join); the counts are combined before they are shuffled.
    """
    v = F.col(value)
    counts = [
        F.sum(F.when(v < F.col("estimate"), 1).otherwise(0)).alias("below"),
        F.sum(F.when(v <= F.col("estimate"), 1).otherwise(0)).alias("at_or_below"),
        F.max(F.when(v <= F.col("estimate"), v)).alias("snapped"),
        F.min(F.when(v >= F.col("estimate"), v)).alias("lifted"),
    ]
    if limit is not None:
        counts.append(F.sum(F.when(v <= limit, 1).otherwise(0)).alias("within"))
    by = estimates.columns
    out = values.join(small(estimates), on).groupBy(*by).agg(*counts)
    want = F.col(q) * F.col("total")
    return out.withColumn("rank_error", F.greatest(F.lit(0.0), F.col("below") - want, want - F.col("at_or_below")) / F.col("total"))


def settle(values: DataFrame, estimates: DataFrame, keys: list[str], value: str, tolerance: float, q: str = "q", limit: Column | None = None, delta: float = DELTA, scratch: Scratch | None = None) -> DataFrame:
    """:func:`certify`, until no row has a ``rank_error`` above ``tolerance``.

    An estimate that is too far off moves to the value next to it on the side of the wanted
    rank, which settles ties; if that is not enough, its group gets a
    digest FINER times as fine; each time the values are counted again.  A digest so fine
    that every value stays alone is exact, so this ends.  ``estimates`` must be cheap to read.
    """
    scratch = scratch or Scratch(values.sparkSession, "settle")
    tag = f"{len(keys)}-{'-'.join(keys)}"
    finite = values.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    seen, sure, step = certify(finite, estimates, keys, value, q, limit), [], 0
    while True:
        seen = scratch.save(seen, f"seen-{tag}-{step}")
        sure.append(seen.where(F.col("rank_error") <= tolerance))
        left = seen.where(F.col("rank_error") > tolerance)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, sure)
        step += 1
        if step % 2:
            beside = F.when(F.col(q) * F.col("total") > F.col("at_or_below"), F.col("lifted")).otherwise(F.col("snapped"))
            again = left.withColumn("estimate", F.coalesce(beside, F.col("estimate"))).select(*estimates.columns)
        else:
            delta *= FINER
            groups = left.select(*keys).distinct()
            fine = merge_digests(digest(values.join(small(groups), keys, "left_semi"), keys, value, delta), keys, delta)
            again = quantiles(fine, keys, left.select([c for c in estimates.columns if c not in ("estimate", "total")]), keys, q).select(*estimates.columns)
        seen = certify(finite, scratch.save(again, f"again-{tag}-{step}"), keys, value, q, limit)


def certified_quantiles(
    values: DataFrame,
    keys: list[str],
    value: str,
    wanted: DataFrame,
    on: list[str],
    q: str = "q",
    limit: Column | None = None,
    least: int = 1,
    delta: float = DELTA,
    tolerance: float = 1.0,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Digest, merge, estimate and certify, for groups of at least ``least`` values; no row has a ``rank_error`` above ``tolerance``, see :func:`settle`."""
    scratch = scratch or Scratch(values.sparkSession, "digests")
    merged = merge_digests(digest(values, keys, value, delta), keys, delta)
    estimates = scratch.save(quantiles(merged, keys, wanted, on, q).where(F.col("total") >= least), "estimates")
    return settle(values, estimates, keys, value, tolerance, q, limit, delta, scratch)
