"""Groups of records linked by pairwise matches, by randomised contraction.

After Boegeholz, Brand and Todor, "In-database connected component analysis"
(2020).  Each round, every vertex hooks to the member of its closed
neighbourhood that comes first in a fresh hash order; edges are relabelled and
deduplicated.  A round removes a constant share of the vertices in expectation,
whatever the shape of the graph (long chains too), so their number and the
number of edges fall geometrically.  At the end the mappings of the rounds are
expanded from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.runtime import HOT_ROWS, Scratch, lookup_join

#: Mappings that one plan expands before its result is written.
EXPAND = 4


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", node: str = "node_id", group: str = "group_id", seed: int = 20_240_101, scratch: Scratch | None = None) -> DataFrame:
    """(group, node): for every id that occurs in a pair of two different ids, the smallest id linked to it directly or indirectly.

    Ids are whole numbers (cast to bigint).  Pairs with a null and pairs of an id
    with itself link nothing and bring no row; repeated pairs, in either direction,
    count once; other columns are ignored.  No pairs give no rows.  The result
    does not depend on ``seed``.  Every vertex joins on its own key, hot
    ones (hubs of the pairs, vertices that many others hook to, and giant groups at
    the end) by broadcast of at most 64 keys; see :func:`meshloom.runtime.lookup_join`.
    """
    spark = pairs.sparkSession
    scratch = scratch or Scratch(spark, "groups")
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = scratch.save(pairs.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "edges-0")
    left, rounds = edges.count(), []
    while left:
        k = len(rounds)
        order = lambda c: F.xxhash64(F.lit(seed + k), c)  # noqa: B023, E731
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = ends.groupBy("u").agg(F.min_by("v", order(F.col("v"))).alias("w"), F.count("*").alias("n"))
        rep = F.when(order(F.col("w")) < order(F.col("u")), F.col("w")).otherwise(F.col("u"))
        hooks = scratch.save(hooked.select("u", rep.alias("rep"), "n"), f"hooks-{k}")
        rounds.append(hooks.select("u", "rep"))
        # n counts both directions, so its sum is twice the number of edges.
        first = lookup_join(edges, hooks.select("u", F.col("rep").alias("ru"), "n"), "u", "n", 2 * left)
        both = lookup_join(first, hooks.select(F.col("u").alias("v"), F.col("rep").alias("rv"), "n"), "v", "n", 2 * left)
        shorter = both.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        edges = scratch.save(shorter, f"edges-{k + 1}")
        scratch.drop(f"edges-{k}")
        left = edges.count()
    if not rounds:
        return spark.createDataFrame([], f"{group} long, {node} long")

    labels = rounds[-1]
    for k in range(len(rounds) - 2, -1, -1):
        # A vertex without edges after its round keeps the name it has there.
        later = labels.select(F.col("u").alias("rep"), F.col("rep").alias("last"))
        vertices = rounds[k].count()  # of a written table
        if vertices >= HOT_ROWS:
            # Most vertices of a star hook to its centre: the vertices that others hook to carry how many do.
            hooked_to = rounds[k].groupBy("rep").agg(F.count("*").alias("n"))
            later = scratch.save(later.join(hooked_to, "rep"), f"later-{k}")
            joined = lookup_join(rounds[k], later, "rep", "n", vertices, "left")
        else:
            joined = rounds[k].join(later, "rep", "left")
        labels = joined.select("u", F.coalesce("last", "rep").alias("rep"))
        if k % EXPAND == 0:
            labels = scratch.save(labels, f"labels-{k}")
            for j in range(k + 1, len(rounds)):
                for name in (f"hooks-{j}", f"later-{j}", f"labels-{j}"):
                    scratch.drop(name)
    scratch.drop(f"edges-{len(rounds)}")
    smallest = labels.groupBy("rep").agg(F.min("u").alias("least"), F.count("*").alias("n"))
    vertices = labels.count()
    if vertices >= HOT_ROWS:
        smallest = scratch.save(smallest, "smallest")
    named = lookup_join(labels, smallest, "rep", "n", vertices)
    return named.select(F.col("least").alias(group), F.col("u").alias(node))
