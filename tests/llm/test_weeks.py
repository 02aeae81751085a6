"""Quartiles of weeks and of weeks together: the certified rank errors, against counting."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import SparkSession

from meshloom.llm import queries
from meshloom.runtime import Scratch


def test_rank_errors_are_those_counted():
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    rng = random.Random(3)
    rows = []
    for week in range(3):
        rows += [("TIED", "f", week, float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(2000)]
        rows += [("SKEW", "f", week, rng.random() ** 40 * 10 ** (3 * week)) for _ in range(4000)]
        rows += [("FEW", "f", week, float(week))]
    rows += [("TIED", "f", 0, None), ("SKEW", "f", 1, float("nan")), ("SKEW", "f", 1, float("inf")), ("NONE", "f", 1, None)]
    values = spark.createDataFrame(rows, "etype string, field_name string, week_no long, value double").repartition(3)
    by = defaultdict(list)
    for etype, _, week, v in rows:
        if v is not None and abs(v) < float("inf"):
            by[etype, week].append(v)
            by[etype, None].append(v)
    got = queries.certified_weeks(values, Scratch(spark, "t")).collect()
    assert sorted((r.etype, str(r.week_no), r.pct) for r in got) == sorted((e, str(w), p) for e, w in by for p in (25, 50, 75))
    for r in got:
        v = by[r.etype, r.week_no]
        want = r.pct / 100 * len(v)
        below, within = sum(x < r.estimate for x in v), sum(x <= r.estimate for x in v)
        assert r.total == len(v)
        assert r.rank_error == pytest.approx(max(0, below - want, want - within) / len(v), abs=1e-9)
        if r.etype != "FEW":
            assert r.rank_error <= queries.RANK_TOLERANCE
