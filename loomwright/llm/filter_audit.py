"""How filters interact: what each removes, loses and repeats, at every step of every order of applying them.

A document's failures are the bits of one number (five filters, 32 patterns). Which filter removes it depends only on that pattern
and the order, so a table of 32 by 120, worked out once, holds the step of the first failure. Tasks look up whole Arrow
batches in it and add them up by part, order and step with ``np.bincount``, once for all documents and once for each label; each task emits its
partial arrays and Spark sums them.

Filter E (an equal text under a smaller doc_id) is the only one that needs other rows. Digests of texts are counted by task before every
shuffle: rows of equal digest, part, labels and pattern travel as one row with their smallest doc_id, so a text that a third of all rows
share is a few rows wherever it meets.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import small_batches, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts whose arrays a task holds before it emits them (about 18 kB each).
MOST_PARTS = 512
#: Rows that are looked up at once, each in all orders.
ROWS_AT_ONCE = 4096
CELLS = len(ORDERS) * (len(FILTERS) + 1)


def first_failures() -> np.ndarray:
    """For each pattern of failures and each order the step (from 0) that removes the document; the number of filters if none does."""
    steps = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), dtype=np.int64)
    for pattern in range(1 << len(FILTERS)):
        for k, order in enumerate(ORDERS):
            for step, name in enumerate(order):
                if pattern >> FILTERS.index(name) & 1:
                    steps[pattern, k] = step
                    break
    return steps


def own_failures(text: Column) -> dict[str, Column]:
    """Failure of the filters that need one text alone: few words, repeated words, many capitals, marks."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100,
        "B": F.lit(100) * distinct < F.lit(80) * n,
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(10) * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def patterns(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, pattern of failures and labels: part, pattern, good, toxic and n, the rows that share them (several such rows may be equal)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = sum((failed.cast("int") * (1 << FILTERS.index(name)) for name, failed in own_failures(text).items()), F.lit(0))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        own.alias("own"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))  # rows without an id meet nobody
    rows = written(rows, "audit-rows")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("doc_id", "good", "toxic")
    said = said.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(said, ["doc_id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)).cast("int") for c in ("good", "toxic")})
    shared = ["digest", "part", "own", "good", "toxic"]
    known = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", *shared).agg(F.count("*").alias("n"))
    groups = known.groupBy(*shared).agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("n"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("alone", F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))  # the rows of the smallest id
    again = 1 << FILTERS.index("E")
    split = F.inline(F.array(F.struct(F.col("own").alias("pattern"), F.col("alone").alias("rows")), F.struct((F.col("own") + again).alias("pattern"), (F.col("n") - F.col("alone")).alias("rows"))))
    counted = groups.select("part", "good", "toxic", split).filter("rows > 0")
    anonymous = rows.filter("doc_id IS NULL").groupBy("part", "good", "toxic", F.col("own").alias("pattern")).agg(F.count("*").alias("rows"))
    return counted.unionByName(anonymous).select("part", "pattern", "good", "toxic", F.col("rows").alias("n"))


def removals(rows: DataFrame) -> DataFrame:
    """Sums of ``rows`` (part, pattern, good, toxic, n) for each part, order and step: removed, good_lost, toxic_lost.

    ``cell`` is the order's place times six plus the step from 0; step 5 holds what no filter removes.
    """
    table = first_failures()
    places = np.arange(len(ORDERS)) * (len(FILTERS) + 1)

    def look_up(batches):
        sums: dict[str, np.ndarray] = {}

        def emitted():
            for part, cells in sums.items():
                columns = [pa.array([part] * CELLS, pa.string()), pa.array(np.arange(CELLS, dtype=np.int32)), *[pa.array(c) for c in cells]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "cell", "removed", "good_lost", "toxic_lost"])
            sums.clear()

        for batch in batches:
            coded = batch["part"].dictionary_encode()
            parts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            pattern, n = batch["pattern"].to_numpy(), batch["n"].to_numpy()
            marks = [n, n * batch["good"].to_numpy(), n * batch["toxic"].to_numpy()]
            for code, part in enumerate(parts):
                at = np.flatnonzero(codes == code)
                if part not in sums:
                    if len(sums) == MOST_PARTS:
                        yield from emitted()
                    sums[part] = np.zeros((3, CELLS), dtype=np.int64)
                for some in np.split(at, range(ROWS_AT_ONCE, len(at), ROWS_AT_ONCE)):
                    cells = (places + table[pattern[some]]).ravel()
                    for k, mark in enumerate(marks):
                        weight = np.repeat(mark[some], len(ORDERS))
                        sums[part][k] += np.bincount(cells, weights=weight, minlength=CELLS).astype(np.int64)
        yield from emitted()

    small_batches(rows.sparkSession)
    partial = rows.mapInArrow(look_up, "part string, cell int, removed long, good_lost long, toxic_lost long")
    return partial.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, zeros included.

    Null texts are empty, null languages the empty part. Rows that repeat a doc_id are documents each, with an equal text only under
    other, smaller ids; rows without doc_id have no label, and no equal text counts for or against them. A document that several
    labels name is good (toxic) if one of them says so. No documents give no rows.
    """
    width = len(FILTERS) + 1
    cells = removals(patterns(documents, labels))
    order = F.get(F.array(*[F.lit(o) for o in ORDERS]), F.floor(F.col("cell") / width).cast("int"))
    cells = cells.select("part", order.alias("filter_order"), (F.col("cell") % width + 1).cast("int").alias("step"), "removed", "good_lost", "toxic_lost")
    cells = cells.withColumn("name", F.when(F.col("step") < width, F.substring("filter_order", F.col("step"), F.lit(1))))
    later = Window.partitionBy("part", "filter_order").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    of_filter = Window.partitionBy("part", "name")
    # A filter's first place removes all that fail it, its last place those that fail nothing else.
    failing = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(of_filter)
    only = F.max(F.when(F.col("step") == width - 1, F.col("removed"))).over(of_filter)
    out = cells.withColumn("kept", F.sum("removed").over(later)).filter(F.col("step") < width)
    return out.select(
        "part", "filter_order", "step", "kept", "removed",
        (failing - F.col("removed")).alias("redundant"), only.alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(of_filter).alias("shapley"),
    )


ORACLE_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           len(words) < 100 AS A,
           100 * len(list_distinct(words)) < 80 * len(words) AS B,
           100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) AS C,
           regexp_matches(body, '[#$%&*|]') AS D,
           coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY body), false) AS E
    FROM texts LEFT JOIN said ON said.doc_id = texts.doc_id),
grouped AS (
    SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails,
           count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM failed GROUP BY ALL),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name),
orders AS (
    SELECT concat(a.name, b.name, c.name, d.name, e.name) AS filter_order
    FROM names a, names b, names c, names d, names e
    WHERE len(list_distinct([a.name, b.name, c.name, d.name, e.name])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS name, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
cells AS (
    SELECT part, filter_order, CAST(step AS INT) AS step, name,
           sum(CASE WHEN translate(fails, concat(earlier, name), '') = fails THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN contains(fails, name) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN contains(fails, name) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = name THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN contains(fails, name) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN contains(fails, name) AND translate(fails, earlier, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM grouped, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley
FROM cells"""
