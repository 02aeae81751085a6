"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import components, digests, leaks, ledger, subjects, tokens
from meshloom.runtime import Scratch, table

# -- p1: groups of matched nodes ---------------------------------------------


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "matches")
    families = table(spark, sf_dir, "mesh_groups").where("etype = 'SEG2' and group_name = 'node_match'").select("etype", "family").distinct()
    elements = table(spark, sf_dir, "mesh_elements").where("etype = 'SEG2'").select("etype", "family", "conn")
    ends = elements.join(families, ["etype", "family"], "left_semi").where(F.size("conn") == 2).select(F.col("conn")[0].alias("a"), F.col("conn")[1].alias("b"))
    pairs = ends.where("a <> b").distinct()  # redelivered elements, combined before any join
    nodes = table(spark, sf_dir, "mesh_nodes").select("node_id").distinct()
    known = pairs.join(nodes, pairs.a == nodes.node_id, "left_semi").join(nodes, pairs.b == nodes.node_id, "left_semi")
    return components.connected_groups(known, scratch=scratch)


# -- p2: records that differ in formatting only --------------------------------


def _collapsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "raw_elements")
    key = ledger.fingerprint(F.col("mesh_id"), ledger.canonical_record(F.col("record")))
    return ledger.collapse(raw, "raw_id", key, "received_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir)[1].withColumnRenamed("id", "raw_id")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a distinct record: its smallest raw_id and how many copies it had."""
    return _collapsed(spark, sf_dir)[0].select(F.col("first_id").alias("kept_id"), F.col("n").alias("n_copies"))


# -- p4: percentiles per type and week ---------------------------------------

FIELDS = ("temperature", "pressure", "quality")
RANK_TOLERANCE = 0.005
LEAST_VALUES = 100
_KEYS = ["etype", "field_name", "week_no"]


def _field_values(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """(etype, field_name, week_no, value), each element once."""
    e = table(spark, sf_dir, "mesh_elements").where("etype is not null and observed_at is not null")
    # Redelivered rows are equal in these columns; distinct() combines them before its shuffle.
    # No time zone has a part in this: the column has none.
    week = F.expr("floor(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(observed_at as timestamp_ntz)) / 604800000000)")
    once = e.select("elem_id", "etype", week.cast("long").alias("week_no"), *FIELDS).distinct().drop("elem_id")
    wide = scratch.save(once, "values")
    return wide.select("etype", "week_no", F.expr(f"stack({len(FIELDS)}, {', '.join(f"'{f}', {f}" for f in FIELDS)}) as (field_name, value)"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "percentiles")
    values = _field_values(spark, sf_dir, scratch)
    limits = table(spark, sf_dir, "field_limits").select("etype", "field_name", "pct", "limit_value", (F.col("pct") / 100.0).alias("q")).distinct()
    seen = digests.certified_quantiles(values, _KEYS, "value", limits, ["etype", "field_name"], least=LEAST_VALUES, tolerance=RANK_TOLERANCE, scratch=scratch)
    return seen.where(F.coalesce("snapped", "estimate") > F.col("limit_value")).select(*_KEYS).distinct()


def certified_weeks(values: DataFrame, scratch: Scratch) -> DataFrame:
    """(etype, field_name, week_no, pct, total, estimate, rank_error) of ``values``: quartiles of every week, and (week_no null) of all weeks together.

    ``rank_error`` is counted over the values in a second pass, for the weeks together as well, and is at most ``RANK_TOLERANCE``.
    """
    group = ["etype", "field_name"]
    weekly = scratch.save(digests.merge_digests(digests.digest(values, _KEYS, "value"), _KEYS), "weekly")
    pcts = values.sparkSession.createDataFrame([(25, 0.25), (50, 0.5), (75, 0.75)], "pct int, q double")
    wanted = weekly.select(*group).distinct().crossJoin(F.broadcast(pcts))  # three rows
    by_week = scratch.save(digests.quantiles(weekly, _KEYS, wanted, group), "by-week")
    together = scratch.save(digests.quantiles(digests.merge_digests(weekly, group), group, wanted, group), "together")
    columns = [*_KEYS, "pct", "total", "estimate", "rank_error"]
    certain = digests.settle(values, by_week, _KEYS, "value", RANK_TOLERANCE, scratch=scratch).select(*columns)
    combined = digests.settle(values, together, group, "value", RANK_TOLERANCE, scratch=scratch)
    return certain.unionByName(combined.withColumn("week_no", F.lit(None).cast("long")).select(*columns))


def p4_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of each type and field: of every week, and (week_no null) of all weeks together from the weeks' digests, each with its error in rank."""
    scratch = Scratch(spark, "percentiles")
    return certified_weeks(_field_values(spark, sf_dir, scratch), scratch)


def p4_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`p4_weeks` without the estimate, which differs from run to run within its error: how many values, and whether the error is within the tolerance."""
    return p4_weeks(spark, sf_dir).select(*_KEYS, "pct", "total", (F.col("rank_error") <= RANK_TOLERANCE).alias("certified"))


# -- p6: token ids -------------------------------------------------------------


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


# -- p7: passages of evaluation items in documents ----------------------------


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaks.leaked(documents, items).select("doc_id", "item_id")


# -- p8: subjects of documents -------------------------------------------------


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, areas, labels = (table(spark, sf_dir, name) for name in ("documents", "subject_areas", "subject_labels"))
    return subjects.dealt_with(documents, areas, labels)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found, "p4_weeks": p4_weeks, "p4_certified": p4_certified, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}

# One reading of a record for DuckDB, whose expressions have no look-around: keys are marked first, then cut apart.
_P2_KEYED = r"""
    with k as (
        select raw_id, mesh_id, regexp_replace(lower(record), '(cell[^a-z0-9]*type|connectivity|family|tag)[''"]?\s*(=>|->|:|=|\t)', chr(1) || '\1' || chr(2), 'g') as s
        from raw_elements where record is not null),
    f as (
        select raw_id, mesh_id,
            regexp_replace(regexp_extract(s, '\x01cell[^a-z0-9]*type\x02([^\x01]*)', 1), '[^a-z0-9]', '', 'g') as cell,
            list_transform(regexp_extract_all(regexp_extract(s, '\x01connectivity\x02([^\x01a-z]*)', 1), '[0-9]+'), lambda x: x::hugeint) as conn,
            case when contains(s, chr(1) || 'family' || chr(2)) then coalesce(try_cast(regexp_extract(s, '\x01family\x02[^\x010-9+-]*([+-]?[0-9]+)', 1) as bigint)::varchar, '') end as family,
            case when contains(s, chr(1) || 'tag' || chr(2)) then regexp_replace(regexp_extract(s, '\x01tag\x02([^\x01]*)', 1), '[^a-z0-9]', '', 'g') end as tag
        from k),
    g as (
        select raw_id, min(raw_id) over w as kept_id from f where cell <> '' and len(conn) > 0
        window w as (partition by mesh_id, cell, conn, family, tag))"""

_P4_VALUES = """
    with e as (select distinct elem_id, etype, observed_at, temperature, pressure, quality from mesh_elements where etype is not null and observed_at is not null),
    u as (select etype, observed_at, unnest(['temperature', 'pressure', 'quality']) as field_name, unnest([temperature, pressure, quality]) as value from e),
    v as (select etype, field_name, floor((epoch_us(observed_at) - 1704067200000000) / 604800000000)::bigint as week_no, value
        from u where value is not null and isfinite(value))"""

SQL = {
    "p4_certified": _P4_VALUES
    + """, w as (select etype, field_name, week_no, value from v union all select etype, field_name, null, value from v)
        select etype, field_name, week_no, pct, count(*) as total, true as certified from w, (select unnest([25, 50, 75]) as pct) group by all""",
    "p1_found": """
        with recursive m as (
            select distinct least(e.conn[1], e.conn[2]) as a, greatest(e.conn[1], e.conn[2]) as b
            from mesh_elements e join (select distinct etype, family from mesh_groups where etype = 'SEG2' and group_name = 'node_match') g using (etype, family)
            where len(e.conn) = 2 and e.conn[1] <> e.conn[2] and e.conn[1] in (select node_id from mesh_nodes) and e.conn[2] in (select node_id from mesh_nodes)),
        s as (select a, b from m union all select b, a from m),
        r as (select distinct a as node_id, a as seen from s union select r.node_id, s.b from r join s on r.seen = s.a)
        select min(seen) as group_id, node_id from r group by node_id""",
    "p2_found": _P2_KEYED + " select kept_id, raw_id from g where raw_id > kept_id",
    "p2_counts": _P2_KEYED + " select kept_id, count(*) as n_copies from g group by kept_id",
    "p4_found": _P4_VALUES
    + """
        select distinct etype, field_name, week_no from (
            select l.etype, l.field_name, v.week_no, l.pct, l.limit_value, count(*) as n, count(*) filter (where v.value <= l.limit_value) as within
            from (select distinct * from field_limits) l join v using (etype, field_name) group by all)
        where n >= 100 and within * 100 < pct * n""",
}
