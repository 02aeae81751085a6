"""Records that differ in formatting only: canonical keys and an incremental ledger of their counts."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.runtime import Scratch, lookup_join

#: Buckets of a new ledger, by hash of the key; a batch reads and writes only those that its keys fall into.
BUCKETS = 16
#: Keys a bucket may hold on average before the ledger is cut into FAN times as many.
BUCKET_KEYS = 1_000_000
FAN = 4
#: Parts by time that a whole table is cut into when it is taken batch by batch.
BATCHES = 4

# The names of an exported element's fields, as patterns over lower-case text.
FIELDS = {"cell_type": "cell[^a-z0-9]*type", "connectivity": "connectivity", "family": "family", "tag": "tag"}
# Between a field's name and its value.
_IS = r"[\"']?\s*(?:=>|->|:|=|\t)"
# What marks a name's begin and end once names are found; records hold neither.
_NAME, _VALUE = "\x01", "\x02"


def canonical_record(record: Column) -> Column:
    """The text that all spellings of one element record share; null if it has no cell type or no connectivity.

    A field's value runs to the name of the next field.  Cell type and tag keep
    their letters and digits in lower case, connectivity its integers in order,
    family its integer, leading zeros dropped.  An absent field is written
    otherwise than a present but empty one; of a field that comes twice the first counts.
    Null, empty and damaged records give null.
    """
    # Names are marked in one pass; then each field is cut out between two marks.
    any_name = rf"(?<![\p{{L}}\p{{N}}])({'|'.join(FIELDS.values())}){_IS}"
    low = F.translate(F.lower(record), _NAME + _VALUE, "  ")
    marked = F.regexp_replace(low, any_name, f"{_NAME}$1{_VALUE}")
    whole = lambda c: F.regexp_replace(c, r"(?<![0-9])0+(?=[0-9])", "")

    def fields(m: Column) -> Column:
        value = lambda f, body: F.regexp_extract(m, rf"{_NAME}(?:{FIELDS[f]}){_VALUE}{body}", 1)
        there = lambda f: m.rlike(rf"{_NAME}(?:{FIELDS[f]}){_VALUE}")
        word = lambda f: F.regexp_replace(value(f, rf"([^{_NAME}]*)"), r"[^\p{L}\p{N}]+", "")
        family = F.regexp_replace(whole(value("family", r"\s*[\"'(\[{<]?\s*([+-]?[0-9]+)")), r"^\+|^-(?=0$)", "")
        return F.struct(
            word("cell_type").alias("cell"),
            F.regexp_extract_all(value("connectivity", r"([^\p{L}\x01]*)"), F.lit(r"[0-9]+"), F.lit(0)).alias("nodes"),
            F.when(there("family"), F.concat(F.lit("f"), family)).otherwise("").alias("family"),
            F.when(there("tag"), F.concat(F.lit("t"), word("tag"))).otherwise("").alias("tag"),
        )

    def text(f: Column) -> Column:
        return F.when((f["cell"] != "") & (F.size(f["nodes"]) > 0), F.concat_ws("\x1f", f["cell"], whole(F.concat_ws(",", f["nodes"])), f["family"], f["tag"]))

    return F.when(record.isNotNull(), once(once(marked, fields), text))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Ledger:
    """How many records had each canonical key so far, and the smallest record id among them.

    A ledger lives in a folder, and a later session goes on with :meth:`open`.  The counts
    lie in buckets by hash of the key.  ``add`` aggregates a batch, joins it in
    full with the ledger's rows of the same buckets alone, and writes those buckets anew, one
    task a bucket; the others stay as they are.  Only then is a new manifest
    written, which says where each bucket lies and which batches are in: a run that dies
    before leaves the ledger as it was, and a batch whose name is in already is not added again.
    Batches may come in any order; the result is the same.  Records with a null key are not counted.

    The buckets follow the keys: where they hold more than ``BUCKET_KEYS`` on average, the ledger is
    cut into FAN times as many, by hash, so that a small batch touches few.  One writer at a time.
    """

    _COLUMNS = "key binary, n long, first_id long, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.path, self.bucket_keys = spark, path.rstrip("/"), bucket_keys
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        #: Version, buckets, the version that holds each bucket, keys in each, and the batches that are in.
        self._state = self._last() or {"version": 0, "buckets": buckets, "where": {}, "keys": {}, "batches": []}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        """The ledger in a folder; a new one if there is none."""
        return cls(spark, path)

    @property
    def buckets(self) -> int:
        return self._state["buckets"]

    # the manifest

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self._conf)

    def _last(self) -> dict | None:
        folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self._conf)
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = sorted(int(n[len("manifest-") : -len(".json")]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not done:
            return None
        rows = self.spark.read.text(f"{self.path}/manifest-{done[-1]}.json", wholetext=True).collect()  # one file
        return json.loads(rows[0][0])

    def _commit(self, state: dict) -> None:
        """Writes the manifest under another name, then renames it: there is a whole one or none."""
        name = f"manifest-{state['version']}.json"
        out = self._fs().create(self._at(f"_{name}"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs().rename(self._at(f"_{name}"), self._at(name)):
            raise RuntimeError(f"another writer has added to the ledger in {self.path}")
        old, self._state = self._state, state
        for v in set(old["where"].values()) - set(state["where"].values()):
            self._fs().delete(self._at(f"v{v}"), True)
        self._fs().delete(self._at(f"manifest-{old['version']}.json"), False)

    # rows

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")

    def _read(self, buckets: list[int]) -> DataFrame:
        by_version: dict[int, list[int]] = {}
        for b in buckets:
            if str(b) in self._state["where"]:
                by_version.setdefault(self._state["where"][str(b)], []).append(b)
        parts = [self.spark.read.schema(self._COLUMNS).parquet(f"{self.path}/v{v}").where(F.col("bucket").isin(own)) for v, own in sorted(by_version.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._COLUMNS)

    def _write(self, rows: DataFrame, version: int, buckets: int) -> dict[int, int]:
        """Writes buckets as a version, each by one task, and tells how many keys each has."""
        path = f"{self.path}/v{version}"
        rows.repartition(max(1, buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        # One row a bucket.
        return {r[0]: r[1] for r in self.spark.read.schema(self._COLUMNS).parquet(path).groupBy("bucket").count().collect()}

    def add(self, batch: DataFrame, name: str | None = None) -> bool:
        """Adds ``batch``: columns key (binary) and id (bigint), one row a record.  False if a batch of this name is in already."""
        state = self._state
        if name is not None and name in state["batches"]:
            return False
        version, n = state["version"] + 1, state["buckets"]
        counted = batch.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn("bucket", self._bucket(F.col("key"), n))
        scratch = Scratch(self.spark, "batch")
        new = scratch.save(counted, "counted")
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # as many as buckets at most
        where, keys = dict(state["where"]), dict(state["keys"])
        if touched:
            old = self._read(touched).select("bucket", "key", F.col("n").alias("m"), F.col("first_id").alias("earlier"))
            merged = new.join(old, ["bucket", "key"], "full_outer").select(
                "key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.least("first_id", "earlier").alias("first_id"), "bucket"
            )
            for b, count in self._write(merged, version, len(touched)).items():
                where[str(b)], keys[str(b)] = version, count
        batches = state["batches"] + ([name] if name is not None else [])
        self._commit({"version": version, "buckets": n, "where": where, "keys": keys, "batches": batches})
        scratch.close()
        if sum(keys.values()) > n * self.bucket_keys:
            self._split()
        return True

    def _split(self) -> None:
        """Cuts the ledger into FAN times as many buckets, as often as the keys ask for; each key stays among the parts of its bucket."""
        state, n = self._state, self._state["buckets"]
        while sum(state["keys"].values()) > n * self.bucket_keys:
            n *= FAN
        version = state["version"] + 1
        rows = self._read(list(range(state["buckets"]))).withColumn("bucket", self._bucket(F.col("key"), n))
        keys = self._write(rows, version, min(n, int(self.spark.conf.get("spark.sql.shuffle.partitions")) * FAN))
        self._commit({**state, "version": version, "buckets": n, "where": {str(b): version for b in keys}, "keys": {str(b): c for b, c in keys.items()}})

    def counts(self) -> DataFrame:
        """(key, n, first_id): one row a key."""
        return self._read(list(range(self.buckets))).select("key", "n", "first_id")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts, null kept apart from every text; null if the last part is null."""
    before = [F.coalesce(p.cast("string"), F.lit("\x1d")) for p in parts[:-1]]
    digest = lambda last: F.when(last.isNotNull(), F.unhex(F.sha2(F.concat_ws("\x1e", *before, last), 256)))
    return once(parts[-1].cast("string"), digest)


def keyed_batches(records: DataFrame, record_id: str, key: Column, at: str, batches: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(id, key, batch) of all records that have a key, and the same cut by ``at`` into parts of about as many rows; rows with a null time come with the first.

    The cuts are approximate quantiles of the times; rows of one time stay together.
    """
    time = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({at} as timestamp_ntz))")
    keyed = records.select(F.col(record_id).cast("long").alias("id"), key.alias("key"), time.alias("__at"))
    cuts = records.select(time.alias("t")).agg(F.percentile_approx("t", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = sum((F.when(F.col("__at") > c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    # Rows without a key are left out when the table is read: a filter here would have the key computed twice.
    saved = scratch.save(keyed.select("id", "key", batch.cast("int").alias("batch")), "keyed", partition_by=["batch"]).where("key is not null")
    return saved, [saved.where(F.col("batch") == i).select("id", "key") for i in range(batches)]


def collapse(records: DataFrame, record_id: str, key: Column, at: str, batches: int = BATCHES, buckets: int = BUCKETS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs all records through a ledger batch by batch: a new one, or with ``path`` the one in that folder.

    Gives the ledger's counts (key, n, first_id) and (kept_id, id) of every further copy among these records.
    Repeated rows (the same id twice) count as copies.  A hot key is
    combined before its shuffle, and joined back by broadcast of at most 64
    keys, known from the ledger's own counts.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "ledger")
    keyed, parts = keyed_batches(records, record_id, key, at, batches, scratch)
    ledger = Ledger(spark, path or scratch.path("book"), buckets)
    for part in parts:
        ledger.add(part)
    several = ledger.counts().where("n > 1")
    total = keyed.count()
    copies = lookup_join(keyed.select("id", "key"), several, "key", "n", total)
    return ledger.counts(), copies.where("id > first_id").select(F.col("first_id").alias("kept_id"), "id")
