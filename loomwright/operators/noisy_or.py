"""Noisy-or combination of weights, inside and across channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the aggregation: share of the rest that other rows of a channel add, agreement bonus, its strength, cap, and siblings' factor.
WITHIN, BONUS, AGREES_AT, CAP, SIBLING = 0.5, 0.08, 0.15, 0.97, 0.7


def noisy_or(signals: list[tuple[float, Column]]) -> Column:
    """1 minus the product of (1 - weight * signal)."""
    return 1 - reduce(lambda a, b: a * b, [1 - F.lit(w) * s for w, s in signals])


def combine(rows: DataFrame, keys: list[str], channel: str, weight: str) -> DataFrame:
    """``keys``, ``score`` and ``channels``: the strongest weight of a channel and half of what the others would add; then noisy-or over
    channels, a bonus for each further channel that agrees (two at most), and a cap. Two aggregations; the second finds its rows already
    reduced to one for each channel."""
    w = F.col(weight)
    strength = F.max(w) + WITHIN * ((1 - F.product(1 - w)) - F.max(w))
    by_channel = rows.groupBy(*keys, channel).agg(strength.alias("_strength"))
    s = F.col("_strength")
    further = F.least(F.greatest(F.lit(0), F.count_if(s >= AGREES_AT) - 1), F.lit(2))
    return by_channel.groupBy(*keys).agg(F.least(F.lit(CAP), 1 - F.product(1 - s) + BONUS * further).alias("score"), F.count("*").alias("channels"))


def soften_siblings(rows: DataFrame, item: str, label: str, score: str) -> DataFrame:
    """Leaves (``parent/leaf``) below the best leaf of their parent count ``SIBLING`` of their score."""
    leaf = F.col(label).contains("/")
    best = F.max(F.when(leaf, F.col(score))).over(Window.partitionBy(item, F.split_part(F.col(label), F.lit("/"), F.lit(1))))
    return rows.withColumn(score, F.when(leaf & (F.col(score) < best), F.col(score) * SIBLING).otherwise(F.col(score)))
