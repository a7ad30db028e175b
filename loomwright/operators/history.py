"""For every row of a key the median of the rows before it."""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_median(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` (key, order, value) with ``n_before`` and ``usual``: how many values the key has before the row, and their median (null if none).

    Rows are sorted inside partitions and stream by; a task holds the values of one key so far in order, so reduce a key's rows to one for each day (or other unit) first. Rows without a
    value have a median too but count for none; rows of one place in order see each other in any order, so there should be one.
    """

    def run(batches):
        owner, seen = object(), []
        for batch in batches:
            counts, medians = [], []
            for k, v in zip(batch[key].to_pylist(), batch[value].to_pylist(), strict=True):
                if k != owner:
                    owner, seen = k, []
                n = len(seen)
                counts.append(n)
                medians.append((seen[n // 2] + seen[(n - 1) // 2]) / 2 if n else None)
                if v is not None:
                    insort(seen, v)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in (key, order, value)], pa.array(counts, pa.int64()), pa.array(medians, pa.float64())], names=[key, order, value, "n_before", "usual"])

    rows = rows.select(key, order, F.col(value).cast("double").alias(value))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{fields}, n_before long, usual double")
