"""The earliest row of a group inside a trailing window, however many rows a group has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.trailing import SECOND

_DAY = 86_400


def earliest(entries: DataFrame, days: int) -> DataFrame:
    """``entries`` (id, at in microseconds, grp) with ``first`` (at, negated id): the earliest entry of the group from ``days`` before up to the entry itself.

    The group's rows are cut by day. Each entry asks the day on which its window begins for the first row at or after that time, and where there is none,
    the next day that has rows; days are one row each by then.
    """
    day = lambda t: F.floor(t / (_DAY * SECOND))
    rows = entries.select("grp", day(F.col("at")).alias("day"), "at", F.struct("at", (-F.col("id")).alias("other")).alias("row"), F.lit(None).cast("long").alias("probe"))
    begins = F.col("at") - days * _DAY * SECOND
    probes = entries.select("grp", day(begins).alias("day"), begins.alias("at"), F.lit(None).cast("struct<at:bigint,other:bigint>").alias("row"), F.col("id").alias("probe"))
    # From late to early; rows of the probe's own time come before it.
    order = Window.partitionBy("grp", "day").orderBy(F.desc("at"), F.col("probe").isNotNull(), F.col("row.other").desc())
    found = rows.unionByName(probes).withColumn("here", F.last("row", ignorenulls=True).over(order)).filter("probe IS NOT NULL")
    starts = rows.groupBy("grp", "day").agg(F.min("row").alias("row"))
    asked = found.select("grp", "day").distinct().join(starts, ["grp", "day"], "full")
    following = Window.partitionBy("grp").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    later = asked.withColumn("next", F.last("row", ignorenulls=True).over(following)).select("grp", "day", "next")
    return found.join(later, ["grp", "day"]).select("grp", F.col("probe").alias("id"), F.coalesce("here", "next").alias("first"))
