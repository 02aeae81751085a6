"""Sets of element ids as DataFrames (etype, elem_id); the results hold each id once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.mesh import KEY


def _ids(a: DataFrame) -> DataFrame:
    return a.select(*KEY)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _ids(a).unionByName(_ids(b)).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _ids(a).intersect(_ids(b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _ids(a).subtract(_ids(b))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in one of the two; types that only one of them has count too.  One aggregation, no join."""
    both = _ids(a).distinct().withColumn("__side", F.lit(1)).unionByName(_ids(b).distinct().withColumn("__side", F.lit(2)))
    return both.groupBy(*KEY).agg(F.count("*").alias("n")).where("n = 1").select(*KEY)


def add(a: DataFrame, etype: str, elem_id: int) -> DataFrame:
    return union(a, a.sparkSession.createDataFrame([(etype, int(elem_id))], "etype string, elem_id bigint"))


def remove(a: DataFrame, etype: str, elem_id: int) -> DataFrame:
    """Without the id; one that is not there changes nothing."""
    return _ids(a).distinct().where(~((F.col("etype") == etype) & (F.col("elem_id") == int(elem_id))))


def without_type(a: DataFrame, etype: str) -> DataFrame:
    return _ids(a).distinct().where(F.col("etype") != etype)


def contains(a: DataFrame, etype: str, elem_id: int) -> bool:
    return not a.where((F.col("etype") == etype) & (F.col("elem_id") == int(elem_id))).isEmpty()


def sizes(a: DataFrame) -> DataFrame:
    """(etype, n): how many ids of each type."""
    return _ids(a).distinct().groupBy("etype").agg(F.count("*").alias("n"))
