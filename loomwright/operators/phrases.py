"""Places where phrases of a dictionary occur in texts, found in one pass over the texts.

The dictionary's size is checked: up to ``MOST_SURFACES`` phrases and ``MOST_BYTES`` of them go to every worker, which builds an automaton of them
once and runs it over Arrow batches, so texts are neither cut into places nor shuffled. A larger dictionary is cut into blocks of that size; every
block runs over the texts, and the choice among overlapping matches is made after all matches of a text have met.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.automaton import left_to_right, phrases

MOST_SURFACES, MOST_BYTES = 200_000, 16 << 20
_COLUMNS = ("at", "n", "start", "size", "surface")


def find(texts: DataFrame, surfaces: DataFrame, longest: bool = False) -> DataFrame:
    """``texts`` without ``text`` and ``fused``, with at, n, start, size and surface for every match; ``longest`` keeps those of a sweep from left to right only.

    ``text`` is spaced by single blanks and ``surface`` too; a ``fused`` text has no blanks, and surfaces are sought in it without theirs, wherever they begin.
    ``at`` is the number of words before the match and ``n`` its words (of a fused text 0 and 1); ``start`` and ``size`` are in characters. Null and
    empty texts and surfaces match nothing; rows that repeat give their matches as often. Surfaces that repeat count once.
    """
    spark = texts.sparkSession
    surfaces = surfaces.select("surface").filter("surface != ''").distinct()
    size = surfaces.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("surface")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // MOST_SURFACES), -(-size.bytes // MOST_BYTES))
    keys = [c for c in texts.columns if c not in ("text", "fused")]
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{fields}, at int, n int, start int, size int, surface string"
    texts = texts.select(*keys, "text", "fused").filter("text != ''")

    def matches(rows: DataFrame, block: int, pick: bool, schema: str, carried: list[str]) -> DataFrame:
        wanted = surfaces.filter(F.pmod(F.xxhash64("surface"), F.lit(blocks)) == block) if blocks > 1 else surfaces
        listed = spark.sparkContext.broadcast(sorted(r[0] for r in wanted.collect()))
        name = uuid.uuid4().hex

        def run(batches):
            found = phrases(name, listed.value)
            for batch in batches:
                rows, out = [], tuple([] for _ in _COLUMNS)
                for k, (text, fused) in enumerate(zip(batch["text"].to_pylist(), batch["fused"].to_pylist(), strict=True)):
                    spans = found.spans(text, fused)
                    at, seen = 0, 0
                    for start, size, number in left_to_right(spans) if pick else sorted(spans):
                        surface = found.surfaces[number]
                        if not fused:
                            at, seen = at + text.count(" ", seen, start), start
                        rows.append(k)
                        for column, value in zip(out, (at, 1 if fused else surface.count(" ") + 1, start, size, surface), strict=True):
                            column.append(value)
                kept = batch.select(carried).take(pa.array(rows, pa.int64()))
                columns = [pa.array(c, pa.string() if c is out[-1] else pa.int32()) for c in out]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*carried, *_COLUMNS])

        return rows.mapInArrow(run, schema)

    if blocks == 1:
        return matches(texts, 0, longest, schema, keys)
    # Equal rows travel as one with their number, so that a text's matches can meet by its content.
    counted = texts.groupBy(*keys, "text", "fused").agg(F.count("*").alias("_copies")).withColumn("_text", F.struct(F.xxhash64("text"), F.crc32("text")))
    counted = counted.withColumn("_text", F.col("_text").cast("string"))
    carried, wider = [*keys, "_copies", "_text", "fused"], schema.replace(", at int", ", _copies long, _text string, fused boolean, at int", 1)
    found = reduce(DataFrame.union, [matches(counted, k, False, wider, carried) for k in range(blocks)])
    if longest:
        found = swept(found, [*keys, "_text", "fused"], wider)
    return found.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*keys, *_COLUMNS)


def swept(matches: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Of matches those that a sweep from left to right keeps. Texts are sorted inside partitions and swept as they stream by, so one with very many matches is never gathered."""

    def sweep(batches):
        text, last, upto = None, None, 0
        for batch in batches:
            kept = []
            rows = zip(*(batch[c].to_pylist() for c in (*keys, "start", "size")), strict=True)
            for k, (*own, start, size) in enumerate(rows):
                if own != text:
                    text, last, upto = own, None, 0
                if start >= upto:
                    last, upto = (start, size), start + size
                    kept.append(k)
                elif (start, size) == last:
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    dealt = matches.repartition(*keys).sortWithinPartitions(*keys, "start", F.desc("size"), "surface")
    return dealt.mapInArrow(sweep, schema)
