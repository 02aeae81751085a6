"""The ledger of record copies, against counts in Python."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshloom.llm import ledger


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    yield s
    s.stop()


T0 = dt.datetime(2024, 1, 1)
ROWS = [(1, "a", T0), (2, "b", None), (3, "a", T0 + dt.timedelta(days=9)), (4, None, T0), (5, "a", None), (6, "b", T0 + dt.timedelta(days=3)), (7, "c", T0 + dt.timedelta(days=5)), (8, "b", None)]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("rows", [ROWS, [(i, k, None) for i, k, _ in ROWS], [(i, k, T0) for i, k, _ in ROWS], []])
def test_collapse_counts_all_copies(spark, kind, rows):
    records = spark.createDataFrame(rows, f"id long, k string, at {kind}")
    counts, copies = ledger.collapse(records, "id", ledger.fingerprint(F.col("k")), "at")
    want = Counter(k for _, k, _ in rows if k)
    first = {k: min(i for i, x, _ in rows if x == k) for k in want}
    assert sorted((r.first_id, r.n) for r in counts.collect()) == sorted((first[k], n) for k, n in want.items())
    assert sorted(tuple(r) for r in copies.collect()) == sorted((first[k], i) for i, k, _ in rows if k and i != first[k])


def test_batches_are_cut_by_time_and_lose_nothing(spark):
    records = spark.createDataFrame(ROWS, "id long, k string, at timestamp_ntz")
    saved, parts = ledger.keyed_batches(records, "id", ledger.fingerprint(F.col("k")), "at", 3, ledger.Scratch(spark, "t"))
    assert saved.count() == 7
    assert [sorted(r.id for r in p.select("id").collect()) for p in parts] == [[1, 2, 5, 8], [6, 7], [3]]


def batch(spark, rows):
    return spark.createDataFrame(rows, "key binary, id long")


def content(book):
    return sorted((bytes(r.key), r.n, r.first_id) for r in book.counts().collect())


def test_a_ledger_lasts_beyond_its_session(spark, tmp_path):
    path = f"file://{tmp_path}/book"
    days = [[(b"a", 5), (b"b", 6), (None, 7)], [(b"a", 1), (b"c", 9), (b"c", 2)], [], [(b"b", 3), (b"a", 8)]]
    want = sorted((k, n, min(i for d in days for x, i in d if x == k)) for k, n in Counter(x for d in days for x, _ in d if x).items())
    for k, day in enumerate(days):
        assert ledger.Ledger.open(spark, path).add(batch(spark, day), f"day {k}")
    assert content(ledger.Ledger.open(spark, path)) == want
    # A run that tries again adds nothing; batches in another order give the same.
    assert not ledger.Ledger.open(spark, path).add(batch(spark, days[0]), "day 0")
    assert content(ledger.Ledger.open(spark, path)) == want
    other = ledger.Ledger.open(spark, f"file://{tmp_path}/other")
    for day in reversed(days):
        other.add(batch(spark, day))
    assert content(other) == want


def test_a_run_that_dies_leaves_the_ledger_as_it_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/book"
    ledger.Ledger.open(spark, path).add(batch(spark, [(b"a", 5)]), "one")
    book = ledger.Ledger.open(spark, path)
    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            book.add(batch(spark, [(b"a", 2), (b"b", 3)]), "two")
    again = ledger.Ledger.open(spark, path)
    assert content(again) == [(b"a", 1, 5)]
    assert again.add(batch(spark, [(b"a", 2), (b"b", 3)]), "two") and content(again) == [(b"a", 2, 2), (b"b", 1, 3)]


def test_untouched_buckets_stay_and_buckets_follow_the_keys(spark, tmp_path):
    path = f"file://{tmp_path}/book"
    book = ledger.Ledger(spark, path, buckets=8, bucket_keys=4)
    book.add(batch(spark, [(bytes([k]), k) for k in range(20)]))
    before = dict(book._state["where"])
    book.add(batch(spark, [(b"\x01", 99)]))
    assert sum(v != before[k] for k, v in book._state["where"].items()) == 1
    book.add(batch(spark, [(bytes([k]), k) for k in range(100, 120)]))
    assert book.buckets > 8
    again = ledger.Ledger(spark, path, bucket_keys=4)
    assert again.buckets == book.buckets and again.counts().count() == 40
    again.add(batch(spark, [(b"\x01", 0)]))
    assert (b"\x01", 3, 0) in content(again)
