"""Token buckets over request logs: which requests are let through when a key's tokens come back at a steady rate.

Whether a request is let through depends on all since the bucket was last full, so requests are cut where it surely was: after a pause as long as a
whole refill. Such pauses are found from counts by slice as long as a refill (a pause lies between two slices, never inside one), and the cut pieces
of a key go to tasks of their own. A task sorts its pieces and lets them stream by; what it holds of a piece is one number of tokens.
A key that never pauses that long stays one piece: what it may do depends on every request before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def metered(requests: DataFrame, capacity: int, seconds: int) -> DataFrame:
    """``requests`` (key, us, id) with ``allowed`` and ``tokens_left``: a bucket of ``capacity`` tokens for each key, full at first and refilled in ``seconds``.

    Times are whole microseconds and tokens are counted in the same fractions, so nothing is rounded: a request costs one token and is let through if there is one.
    Requests of one time come in order of id. Rows without a time are left out; null is a key like others.
    """
    refill = seconds * MICRO  # what a full bucket holds, in microseconds of refilling
    rows = requests.select("key", "us", "id").filter("us IS NOT NULL").withColumn("slice", F.floor(F.col("us") / refill).cast("long"))
    slices = rows.groupBy("key", "slice").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    order = Window.partitionBy("key").orderBy("slice")
    paused = F.coalesce(F.col("first") - F.lag("last").over(order) >= refill, F.lit(True))
    pieces = slices.withColumn("piece", F.sum(paused.cast("int")).over(order)).select(F.col("key").alias("_key"), F.col("slice").alias("_slice"), "piece")
    cut = rows.join(pieces, rows["key"].eqNullSafe(pieces["_key"]) & (rows["slice"] == pieces["_slice"])).select("key", "us", "id", "piece")
    cost = refill // capacity

    def run(batches):
        owner, level, last = None, refill, 0
        for batch in batches:
            allowed, left = [], []
            for key, us, piece in zip(*(batch[c].to_pylist() for c in ("key", "us", "piece")), strict=True):
                if (key, piece) != owner:
                    owner, level, last = (key, piece), refill, us
                level, last = min(refill, level + us - last), us
                allowed.append(level >= cost)
                level -= cost if level >= cost else 0
                left.append(level)
            names = ["key", "us", "id"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(allowed, pa.bool_()), pa.array(left, pa.int64())], names=[*names, "allowed", "left"])

    if refill % capacity:
        raise ValueError("a token must come back in whole microseconds")
    dealt = cut.repartition("key", "piece").sortWithinPartitions("key", "piece", "us", "id")
    kind = requests.schema["key"].dataType.simpleString()
    done = dealt.mapInArrow(run, f"key {kind}, us long, id long, allowed boolean, left long")
    return done.withColumn("tokens_left", F.col("left") / cost).drop("left")
