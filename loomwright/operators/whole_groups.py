"""What a row's groups hold in the time before it, for groups that are each small enough for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.trailing import SECOND


#: Parts for each core.
PARTS = 4


def look_back(entries: DataFrame, first: tuple[str, int], counts: dict[str, tuple[int, int]]) -> DataFrame:
    """``entries`` (id, at in microseconds, grp and others) without grp, each with its group's earliest row (at, negated id) in the last seconds up to itself, and with numbers of rows in windows.

    ``first`` is a column's name and seconds; ``counts`` are names with seconds: from the first before the row's time up to, but not with, the second. Rows are ordered once, from late to early, and all
    frames run on from row to row. Groups are told apart by 96 bits of their hash, which are shorter to order than names.
    """
    others = [c for c in entries.columns if c != "grp"]
    rows = entries.select(*others, F.xxhash64("grp").alias("_g"), F.crc32("grp").alias("_h"), (-F.col("at")).alias("_back"))
    # More parts than cores: a part with several large groups doesn't hold up the others.
    rows = rows.repartition(PARTS * entries.sparkSession.sparkContext.defaultParallelism, "_g", "_h")

    def since(seconds: int):
        return Window.partitionBy("_g", "_h").orderBy("_back").rangeBetween(Window.unboundedPreceding, seconds * SECOND)

    number = lambda seconds: F.count("*").over(since(seconds))
    found: dict[str, Column] = {name: number(back) - number(upto) for name, (back, upto) in counts.items()}
    return rows.select(*others, F.min(F.struct("at", (-F.col("id")).alias("other"))).over(since(first[1])).alias(first[0]), *[c.alias(name) for name, c in found.items()])
