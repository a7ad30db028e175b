"""Pairs of texts of which the shorter resembles a part of the longer one, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import segment as S

_SLACK = 1e-9


def most_edits(size: Column, least: float) -> Column:
    """Characters left out or put in, between a text of this length and a window that is as similar as ``least``, at most."""
    return F.floor((1 - least) * 2 * size + _SLACK).cast("int")


def aligned(shorts: DataFrame, longs: DataFrame, least: float) -> DataFrame:
    """Rows a, b, ratio of at least ``least``, for distinct texts ``a`` and ``b`` of which ``a`` is not the longer.

    Each text a is cut into one piece more than there can be edits, so one piece is unchanged in the window that fits best. Texts b answer with
    their substrings of the lengths that pieces have. Where a piece is found tells where windows may begin; only those are aligned. No pair is lost.
    """
    shorts = shorts.select("a").filter("a != ''").distinct()
    size = F.length("a")
    shorts = shorts.withColumn("edits", F.least(most_edits(size, least), size - 1))
    cut = lambda k: F.floor(k * size / (F.col("edits") + 1)).cast("int")
    place = F.explode(F.transform(F.sequence(F.lit(0), F.col("edits")), lambda k: F.struct(cut(k).alias("p"), (cut(k + 1) - cut(k)).alias("l"))))
    pieces = shorts.select("a", "edits", place.alias("x")).select("a", "edits", "x.p", F.substring(F.col("a"), F.col("x.p") + 1, F.col("x.l")).alias("piece"))
    lengths = [r[0] for r in pieces.select(F.length("piece")).distinct().collect()]  # a few small numbers
    if not lengths:
        return shorts.select("a", F.col("a").alias("b"), F.lit(0.0).alias("ratio")).limit(0)
    longs = longs.select("b").filter("b != ''").distinct()
    ends = lambda q: F.length("b") - q + 1
    parts = F.transform(F.sequence(F.lit(1), F.length("b")), lambda q: F.struct(q.alias("q"), F.array(*[F.when(q <= ends(n), F.substring(F.col("b"), q, F.lit(n))) for n in sorted(lengths)]).alias("some")))
    held = longs.select("b", F.inline(parts)).select("b", "q", F.explode(F.array_compact("some")).alias("piece"))
    met = pieces.join(held, "piece").filter(F.length("a") <= F.length("b"))
    near = met.groupBy("a", "b").agg(F.max("edits").alias("edits"), F.collect_set((F.col("q") - 1 - F.col("p")).cast("int")).alias("diagonals"))  # places in one text
    return near.select("a", "b", S.partial_ratio_near("a", "b", "diagonals", "edits").alias("ratio")).filter(F.col("ratio") >= least - _SLACK)


def partial_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Rows a, b, ratio for the distinct texts of ``left`` (a) and ``right`` (b), of which either may be the longer. Null and empty texts are like nothing."""
    one = aligned(left, right, least)
    other = aligned(right.select(F.col("b").alias("a")), left.select(F.col("a").alias("b")), least).select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio")
    return one.unionByName(other).groupBy("a", "b").agg(F.max("ratio").alias("ratio"))
