"""Streams give what tables give."""

import pytest

from meshloom.functions import selection as sel
from meshloom.functions.fields import Field
from meshloom.runtime import Scratch
from meshloom.sources.builders import grid
from meshloom.streaming import eval_stream, select_stream


def test_a_stream_selects_like_a_table(session):
    spark = session
    mesh = grid(spark, range(6), range(5)).with_field("T", Field.x() * 10 + Field.y())
    rows = mesh.with_points(mesh.elements)
    groups = spark.createDataFrame([("QUAD4", "all", 0), ("TRI3", "other", 0)], "etype string, group_name string, family bigint")
    expr = (sel.rect((1, 1), (4, 4)) | (Field("T") > 40)) & sel.group("all") - sel.ids({"QUAD4": [7]}) - sel.nids([0], all=False) & ~sel.group("other")
    want = sorted(r.elem_id for r in type(mesh)(mesh.nodes, mesh.elements, groups).select_ids(expr).collect())
    scratch = Scratch(spark, "t")
    rows.write.parquet(scratch.path("in"))
    stream = spark.readStream.schema(rows.schema).parquet(scratch.path("in"))
    out = eval_stream(select_stream(stream, expr, 2, groups, points="points"), "U", Field("T") + Field.y(), points="points")
    query = out.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("at")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(scratch.path("out")).collect()
    assert sorted(r.elem_id for r in got) == want and len(want) > 3
    assert all(r.U == r["T"] + (r.elem_id // 5 + 0.5) for r in got)


def test_what_a_row_cannot_tell_is_refused(session):
    rows = grid(session, range(3), range(3)).elements
    for expr in (sel.rect((0, 0), (1, 1)), sel.group("a"), sel.ids(rows), Field.x() > 1):
        with pytest.raises(ValueError):
            select_stream(rows, expr, 2)
    assert select_stream(rows, sel.types("QUAD4"), 2).count() == 4
