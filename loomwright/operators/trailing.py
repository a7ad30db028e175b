"""Counts over trailing time windows that stay parallel however few keys there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros(column: str) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def sliced(df: DataFrame, ts: str, seconds_back: int, seconds_ahead: int = 0) -> DataFrame:
    """Rows dealt to time slices as long as the reach of a window, each also as context of the slices that its windows look into.

    Adds ``_t`` (microseconds), ``_slice`` and ``_own`` (false for context). A window by key and slice then sees all that it needs, and
    a key with a third of all rows is spread over as many tasks as it has slices.
    """
    reach = max(seconds_back, seconds_ahead) * SECOND
    df = df.withColumn("_t", micros(ts)).withColumn("_home", F.floor(F.col("_t") / reach).cast("long"))
    slices = [F.col("_home")] + [F.col("_home") + 1] * (seconds_back > 0) + [F.col("_home") - 1] * (seconds_ahead > 0)
    return df.withColumn("_slice", F.explode(F.array(*slices))).withColumn("_own", F.col("_slice") == F.col("_home")).drop("_home")


def window(keys: list[str], seconds_back: int, upto_micros: int = 0):
    """The rows of the same keys from ``seconds_back`` ago up to ``upto_micros`` after (negative: before) the row, on sliced rows."""
    return Window.partitionBy(*keys, "_slice").orderBy("_t").rangeBetween(-seconds_back * SECOND, upto_micros)


def count(keys: list[str], seconds_back: int, upto_micros: int = 0) -> Column:
    """How many rows of the same keys ``window`` holds, on sliced rows: what runs up to its end less what runs up to its start.

    Spark goes through a frame with two moving ends anew for every row; running counts are kept from row to row, so a crowded slice costs its rows once.
    """
    running = lambda end: F.count("*").over(Window.partitionBy(*keys, "_slice").orderBy("_t").rangeBetween(Window.unboundedPreceding, end))
    return running(upto_micros) - running(-seconds_back * SECOND - 1)


def own(df: DataFrame) -> DataFrame:
    """Without the context rows."""
    return df.filter("_own")
