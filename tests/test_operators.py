"""The operators of the queries against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import itertools
import math
import random

import pytest
from pyspark.sql import SparkSession

from meshloom.operators import nearby, numbering


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_number_within_groups(spark):
    rng = random.Random(2)
    rows = [(1, rng.randrange(9), k) for k in range(500)] + [(rng.randrange(2, 60), rng.randrange(3), k) for k in range(500, 700)] + [(None, None, 700), (None, 4, 701), (7, None, 702)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    null_first = lambda v: (v is not None, v or 0)
    want = {}
    for k, own in itertools.groupby(sorted(rows, key=lambda r: (null_first(r[0]), null_first(r[1]), r[2])), key=lambda r: r[0]):
        want |= {r[2]: n for n, r in enumerate(own)}
    got = numbering.number_within_groups(df, ["k"], ["t", "id"], partitions=5).collect()
    assert len(got) == len(rows) and {r.id: r.pos for r in got} == want
    assert numbering.number_within_groups(df.limit(0), ["k"], ["t", "id"]).count() == 0
    with pytest.raises(ValueError):
        numbering.number_within_groups(df, ["k"], ["t"], name="id")


@pytest.mark.parametrize("eps", [0.0, 0.05])
def test_near_pairs(spark, eps):
    rng = random.Random(4)
    points = [(k, k % 2, rng.random(), rng.random(), 0.1 * rng.random()) for k in range(150)] + [(200, 0, 0.5, 0.5, 0.0), (201, 0, 0.5, 0.5, 0.0), (202, 0, None, 0.5, 0.0), (203, 0, 0.5, math.nan, 0.0), (204, None, 0.5, 0.5, 0.0)]
    ok = [p for p in points if None not in p and not math.isnan(p[3])]
    want = sorted((p[0], q[0]) for p, q in itertools.combinations(ok, 2) if p[1] == q[1] and math.dist(p[2:], q[2:]) <= eps)
    df = spark.createDataFrame(points, "node_id long, mesh_id long, x double, y double, z double")
    assert sorted((r.id_a, r.id_b) for r in nearby.near_pairs(df, eps).collect()) == want
    assert nearby.near_pairs(df.limit(0), eps).count() == 0


def test_points_in_regions(spark):
    rng = random.Random(5)
    points = [(100 + k, rng.uniform(-1, 3), rng.uniform(-1, 3)) for k in range(400)] + [(600, None, 1.0), (601, math.nan, 1.0)]
    zones = [(1, "box", [0.0, 1.0], [0.0, 2.0], None), (2, "disc", [1.0], [1.0], 0.7), (3, "poly", [0.0, 2.0, 0.0], [0.0, 0.0, 2.0], None), (4, "disc", [1.0], [1.0], None), (5, "box", None, [1.0], None)]
    want = [(z, i) for i, x, y in points[:400] for z, inside in ((1, 0 <= x <= 1 and 0 <= y <= 2), (2, math.hypot(x - 1, y - 1) <= 0.7), (3, x >= 0 and y >= 0 and x + y <= 2)) if inside]
    got = nearby.points_in_regions(spark.createDataFrame(points, "node_id long, x double, y double"), spark.createDataFrame(zones, "zone_id long, shape string, xs array<double>, ys array<double>, radius double"))
    assert sorted((r.zone_id, r.node_id) for r in got.collect()) == sorted(want)
