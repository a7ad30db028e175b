"""Weighted counts of group members in trailing windows, for any number of groups for each question, without pairs and without ordering a whole group.

A count in a window is the difference of two running counts. Members and questions are cut into short slices of time: a window orders the points of one group
and slice, and what lies before a slice comes from a list with one row for each slice. A group that a third of all rows belong to is as many tasks as it has slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def counts_before(members: DataFrame | None, questions: DataFrame | None, seconds: int, slice_seconds: int = 3600, own: DataFrame | None = None) -> DataFrame:
    """id and n: for each id the sum over its ``questions`` (id, grp, at, sign) of sign times the number of ``members`` (grp, at) of the group from ``seconds`` before ``at`` up to just before it.

    ``own`` (id, grp, at, sign) are both at once, in half as many rows. Times are in microseconds. Rows without a time or group are left out; an id whose questions find nothing has 0. Members that
    repeat count each. Groups are told apart by 96 bits of their hash, which are shorter to order than names.
    """
    none = F.lit(None).cast("long")
    row = lambda df, t, id_, sign, member: df.select("grp", t.alias("t"), id_.alias("id"), sign.cast("long").alias("sign"), F.lit(member).alias("member"))
    parts, start = [], F.col("at") - seconds * MICRO
    # Before the first member there is nothing to count, so windows that begin there have no point at their beginning.
    begin = reduce(DataFrame.union, [df.select("at") for df in (own, members) if df is not None]).agg(F.min("at").alias("begin"))  # one row
    late = lambda df: df.crossJoin(F.broadcast(begin)).filter(start > F.col("begin"))
    if own is not None:
        parts += [row(own, F.col("at"), F.col("id"), F.col("sign"), 1), row(late(own), start, F.col("id"), -F.col("sign"), 0)]
    if members is not None:
        parts.append(row(members, F.col("at"), none, none, 1))
    if questions is not None:
        parts += [row(questions, F.col("at"), F.col("id"), F.col("sign"), 0), row(late(questions), start, F.col("id"), -F.col("sign"), 0)]
    points = reduce(DataFrame.union, parts).filter("grp IS NOT NULL AND t IS NOT NULL")
    points = points.select(F.xxhash64("grp").alias("g"), F.crc32("grp").alias("h"), F.floor(F.col("t") / (slice_seconds * MICRO)).cast("long").alias("slice"), "t", "id", "sign", "member")
    earlier = Window.partitionBy("g", "h", "slice").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    inside = points.withColumn("inside", F.coalesce(F.sum("member").over(earlier), F.lit(0))).filter("id IS NOT NULL")
    slices = points.groupBy("g", "h", "slice").agg(F.sum("member").alias("size"))
    before = F.sum("size").over(Window.partitionBy("g", "h").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("g", "h", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    counted = inside.join(slices, ["g", "h", "slice"])
    return counted.groupBy("id").agg(F.sum(F.col("sign") * (F.col("before") + F.col("inside"))).alias("n"))
