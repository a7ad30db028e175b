"""Importance resampling towards a target distribution of hashed word features, by external sort-count.

One pass over the texts writes blocks of packed 16-bit bucket numbers with the offsets at which documents begin. Every later step reads
these blocks instead of texts: counting sorts a block and encodes its runs, so a block gives at most one row for each bucket, which
Spark sums; gathering takes each feature's gain by its bucket and adds them up between offsets with ``np.add.reduceat``.

The draw is by score (the floored mean gain plus a Gumbel number hashed from the doc_id). A histogram of scores tells how far down the
draw can reach; only rows above that are ordered, by ranges of (score, doc_id, place), and numbered by range and place in it, so no task orders
more than a range and equal keys can be split.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import discard, spread, written

BUCKETS = 10_000
SEED = 7
LEAST_WORDS, PERCENT = 20, 25
#: Features after which a block is written, 2 bytes each; a longer document is a block of its own.
BLOCK_FEATURES = 1 << 20
#: Scores in one bar of the histogram.
BAR = 16
#: A-Z to lower case; other bytes below 0x80 that are no letters or digits to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BLOCKS = "block long, doc_ids array<long>, n_words array<long>, offsets binary, stream binary"


def feature_hashes(text: bytes | None) -> tuple[int, list[int]]:
    """Words of a text and the checksums of its features: all words, then all pairs of neighbours, joined by a space."""
    words = text.translate(_FOLD).split() if text else []
    single = list(map(crc32, words))
    return len(words), single + list(map(crc32, [b" " + w for w in words[1:]], single))  # a checksum goes on from that of the word before


def packed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` (doc_id, text as binary) as blocks of bucket numbers: ids and word counts of their documents, where each begins, and the stream."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers must fit into 16 bits")

    def pack(batches):
        number = TaskContext.get().partitionId() << 33
        ids, n_words, offsets, streams, size = [], [], [], [], 0

        def block():
            columns = ([number], [ids], [n_words], [np.array(offsets, "<i8").tobytes()], [b"".join(streams)])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "doc_ids", "n_words", "offsets", "stream"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n, hashes = feature_hashes(text)
                if size and (size + len(hashes) > BLOCK_FEATURES):
                    yield block()
                    number += 1
                    ids, n_words, offsets, streams, size = [], [], [], [], 0
                ids.append(doc_id)
                n_words.append(n)
                offsets.append(size)
                streams.append((np.array(hashes, np.uint32) % buckets).astype("<u2").tobytes())
                size += len(hashes)
            if len(ids) > 50_000:  # empty texts add nothing to the stream
                yield block()
                number += 1
                ids, n_words, offsets, streams, size = [], [], [], [], 0
        if ids:
            yield block()

    return df.mapInArrow(pack, _BLOCKS)


def bucket_counts(blocks: DataFrame) -> dict[int, int]:
    """How many features lie in each bucket: at most as many rows as there are buckets, whatever the input."""

    def count(batches):
        for batch in batches:
            for stream in batch["stream"].to_pylist():
                ordered = np.sort(np.frombuffer(stream, "<u2"))
                starts = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.empty(0, np.int64)
                lengths = np.diff(starts, append=len(ordered))
                yield pa.RecordBatch.from_arrays([pa.array(ordered[starts].astype(np.int32)), pa.array(lengths.astype(np.int64))], names=["bucket", "n"])

    runs = blocks.select("stream").mapInArrow(count, "bucket int, n long")
    return {r.bucket: r.n for r in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """The floored thousandfold logarithm of how much more frequent each bucket is in the target, with one added to every count."""
    of_source, of_target = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = ((target.get(b, 0) + 1.0) * of_source / ((source.get(b, 0) + 1.0) * of_target) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """For each document of the blocks its place (block, row), n_words, n_features and weight: the floored mean gain, 0 without features."""
    table = blocks.sparkSession.sparkContext.broadcast(gains)

    def gather(batches):
        for batch in batches:
            for block, ids, n_words, offsets, stream in zip(*[batch[c].to_pylist() for c in ("block", "doc_ids", "n_words", "offsets", "stream")], strict=True):
                stream, starts = np.frombuffer(stream, "<u2"), np.frombuffer(offsets, "<i8")
                n = np.diff(starts, append=len(stream))
                full = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(full):  # documents without features have no room between offsets
                    weight[full] = np.add.reduceat(table.value[stream], starts[full]) // n[full]
                columns = [pa.array(ids, pa.int64()), pa.array(np.full(len(n), block)), pa.array(np.arange(len(n))), pa.array(n_words, pa.int64()), pa.array(n), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "block", "row", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(gather, "doc_id long, block long, row long, n_words long, n_features long, weight long")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``rank`` from 1 on in ``order``, which must tell all rows apart: sorted by ranges, numbered inside each, with the sizes of the ranges before added.

    There are as many ranges as shuffle partitions, so their sizes are a table of few rows.
    """
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows.withColumns({"_range": F.shiftright("_id", 33), "_inside": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), name)
    before, bases = 0, []
    for r in sorted(rows.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        bases.append((r[0], before))
        before += r[1]
    base = rows.sparkSession.createDataFrame(bases, "_range long, _base long")
    return rows.join(F.broadcast(base), "_range").withColumn("rank", F.col("_base") + F.col("_inside") + 1).drop("_range", "_inside", "_base")


def resample(documents: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank among the drawn ones (null: not drawn).

    Null and empty texts have no features and weight 0. Rows that repeat a doc_id are drawn each, in the order in which they were read; a
    row without doc_id is hashed with an empty id and comes after the others of its score. An empty target or an empty table is fine.
    """
    binary = lambda df, doc_id: spread(df.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text")))
    blocks = written(packed(binary(documents, F.col("doc_id").cast("long")), buckets), "feature-blocks")
    aims = written(packed(binary(target, F.lit(None).cast("long")), buckets), "target-blocks")
    gains = bucket_gains(bucket_counts(blocks), bucket_counts(aims), buckets)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = written(weights(blocks, gains).withColumn("score", F.col("weight") + gumbel), "scores")
    discard(blocks, aims)
    fits = F.col("n_words") >= least_words
    bars = scored.filter(fits).groupBy(F.floor(F.col("score") / BAR).alias("bar")).agg(F.count("*").alias("n")).collect()  # scores lie within some 100 000
    wanted = percent * sum(r.n for r in bars) // 100
    least, above = None, 0
    for r in sorted(bars, reverse=True):
        if above < wanted:
            least, above = r.bar * BAR, above + r.n
    reach = fits & (F.col("score") >= least) if least is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("block"), F.asc("row")]
    ranked = numbered(scored.filter(reach), order, "draw")
    rank = F.when(F.col("rank") <= wanted, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).union(scored.filter(~reach).select(*columns, F.lit(None).cast("long")))
