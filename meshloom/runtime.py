"""Session-level helpers: shared scratch tables, size-checked broadcasts, hot-key joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has at least 1/HOT_PARTS of the rows and HOT_ROWS of them; so there are at most HOT_PARTS hot keys.
HOT_PARTS = 64
HOT_ROWS = 200_000
#: Most rows of a table that may be broadcast, and most bytes of them.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Bytes read (packed, as in Parquet) for each partition of a whole shuffle, and most such partitions.
PARTITION_BYTES = 64 << 20
MOST_PARTITIONS = 100_000
#: Presumed bytes of a value, by type; WIDE for texts, arrays and structs.
_WIDTH = {"boolean": 8, "byte": 8, "short": 8, "integer": 8, "long": 8, "float": 8, "double": 8, "date": 8, "timestamp": 8, "timestamp_ntz": 8}
WIDE = 64

_local_root: str | None = None
#: Folders that a table of this session may still read; removed at its end at the latest.
_open: dict[str, Scratch] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder serves if everything runs in one
    machine (``local[...]``); on a cluster that is an error.
    """
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None or not os.path.isdir(_local_root):
        _local_root = tempfile.mkdtemp(prefix="meshloom-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


class Scratch:
    """Tables written to the shared folder, to cut lineage and to read a result more than once.

    A lost executor loses none of them.  ``drop`` removes one as soon as nothing
    reads it.  Those that a returned DataFrame still reads belong to the caller:
    they stay until ``close``, the end of a ``with scratch_tables():`` block around
    the call, or the end of the program, whichever comes first.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm = spark.sparkContext._jvm
        _open[self.root] = self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self._conf).delete(path, True)

    def close(self) -> None:
        if _open.pop(self.root, None):
            self.drop()


@contextmanager
def scratch_tables() -> Iterator[None]:
    """Removes, at its end, the tables that operators wrote inside; read or write their results before."""
    before = set(_open)
    try:
        yield
    finally:
        for root in set(_open) - before:
            _open[root].close()


def _close_all() -> None:
    for scratch in list(_open.values()):
        try:
            scratch.close()
        except Exception:  # noqa: BLE001 - the JVM may be gone; nothing is left to tell
            pass


atexit.register(_close_all)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, and they fit ``BROADCAST_BYTES``, else as it is (a shuffle join follows).

    The check reads ``df`` once, up to ``most`` + 1 rows; ``df`` must be cheap to compute.
    The bytes are presumed from the schema, ``WIDE`` for a column without a fixed size.
    """
    row = sum(_WIDTH.get(f.dataType.typeName(), WIDE) for f in df.schema.fields)
    most = min(most, BROADCAST_BYTES // max(row, 1))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lookup_join(big: DataFrame, lookup: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``lookup`` on ``key``, which is unique in ``lookup``, without a task for a hot key.

    ``weight`` is a column of ``lookup``: the rows that ``big`` has of the key;
    it is not in the result.  ``total`` is the sum of the weights.  The hot keys are
    joined by broadcast, the others by shuffle.  At most ``HOT_PARTS`` keys can have a
    share of 1/HOT_PARTS; were the weights larger than said, the ``HOT_PARTS`` heaviest are taken.
    Rows with a null key match nothing.
    """
    least = max(-(-total // HOT_PARTS), HOT_ROWS)
    rest = lookup.drop(weight)
    if total < least:
        return big.join(rest, key, how)
    hot = lookup.where(F.col(weight) >= least).orderBy(F.col(weight).desc(), key).limit(HOT_PARTS)
    names = [r[key] for r in hot.select(key).collect()]
    if not names:
        return big.join(rest, key, how)
    is_hot = F.col(key).isin(names)
    return (
        big.where(is_hot)
        .join(F.broadcast(rest.where(is_hot)), key, how)
        .unionByName(big.where(F.col(key).isNull() | ~is_hot).join(rest.where(F.col(key).isNull() | ~is_hot), key, how))
    )


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of all rows of ``df``: the session's number, or more if the files and tables it reads ask for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    # Files and tables know their size, and joins above would multiply them; local rows have none (the largest number stands for it).
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(s for s in sizes if s < 1 << 62)
    return max(least, min(-(-read // PARTITION_BYTES), MOST_PARTITIONS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
