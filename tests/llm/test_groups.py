"""Groups of matches and canonical records against brute force, with nulls, loops, chains, hubs and hot keys."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshloom import runtime
from meshloom.llm import components, ledger


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def smallest_linked(pairs):
    group = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in group:
        for a, b in pairs:
            if a in group and b in group:
                group[a] = group[b] = min(group[a], group[b])
    return sorted((g, n) for n, g in group.items())


@pytest.mark.parametrize("pairs", [[], [(1, 1), (None, 2), (3, None)], [(k, k + 1) for k in range(60)], [(5, k) for k in range(6, 40)] + [(5, 6), (6, 5), (90, 91)]])
def test_connected_groups(spark, pairs):
    got = components.connected_groups(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted((r.group_id, r.node_id) for r in got.collect()) == smallest_linked(pairs)


@pytest.mark.parametrize("pairs", [[(0, k) for k in range(1, 400)], [(a, b) for a in range(30) for b in range(a)], [(k, k + 1) for k in range(150)] + [(500, k) for k in range(300, 420)]])
def test_hot_vertices_are_split(spark, pairs, monkeypatch):
    """A star, a complete graph and a chain, with a limit so low that hubs count as hot."""
    for module in (runtime, components):
        monkeypatch.setattr(module, "HOT_ROWS", 8)
    got = components.connected_groups(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted((r.group_id, r.node_id) for r in got.collect()) == smallest_linked(pairs)


def test_canonical_record(spark):
    same = ["cell_type: QUAD4; connectivity: [1, 2, 03]; family: -2; tag: a b", '{"Tag": "A-B", "CellType" : "quad4", "family": -02, "connectivity": [1 2 3]}']
    other = ["cell_type: QUAD4; connectivity: [1, 3, 2]; family: -2; tag: a b", "cell_type: QUAD4; connectivity: [1, 2, 3]; family: 2; tag: a b", "cell_type: QUAD4; connectivity: [1, 2, 3]; family: -2"]
    none = [None, "", "cell_type: QUAD4", "connectivity: [1, 2]", "cell_type: ; connectivity: [1]"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(same + other + none)], "id int, record string")
    keys = [r.key for r in df.select("id", ledger.canonical_record(F.col("record")).alias("key")).orderBy("id").collect()]
    assert keys[0] is not None and keys[0] == keys[1] and len(set(keys[:5])) == 4 and None not in keys[:5]
    assert keys[5:] == [None] * 5
