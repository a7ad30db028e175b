"""Exact duplicates by a log-structured merge index of text digests.

A batch of documents becomes a run: its rows are reduced in each task first (the memtable), flushed to a
folder of the index as digest-sorted Parquet with a Bloom filter on the digest column, and never changed
again. Compaction merges all runs into one sorted level, keeping for each digest the smallest identifier and
the count. Identifiers are ranks: to keep the largest doc_id the rank is its negation, so the smallest rank is
the largest id. A lookup joins digests with the compacted level; a digest with more than one row is a hit, and
the bytes of every hit are compared: a task reduces its copies to their least and greatest text before the
shuffle, and a digest whose least and greatest differ stops the job instead of merging different texts.

Copies of one text may be a third of all rows: counts and compared bytes are combined before each shuffle, and
the join that brings results back is an inner join whose skewed side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import ascii_lower, scratch_path, written

#: Hit digests that are broadcast at most, 8 bytes each; beyond it their texts are found by a shuffled join.
MOST_BROADCAST = 1_000_000
NO_ID = (1 << 63) - 1
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}


def normalised(text):
    """Null as empty, A-Z lower-cased."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def with_digest(documents: DataFrame) -> DataFrame:
    return documents.withColumn("digest", F.unhex(F.sha2(normalised(F.col("text")), 256)))


class DigestIndex:
    """Runs and the compacted level of one index, in one folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or scratch_path(spark, "digest-index")
        self.runs: list[str] = []
        self.level: str | None = None

    def flush(self, rows: DataFrame) -> None:
        """Adds a run from rows of (digest, rank): one entry for each digest, sorted, with a filter."""
        run = f"{self.folder}/run-{len(self.runs):06d}"
        entries = rows.groupBy("digest").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
        entries.sortWithinPartitions("digest").write.options(**BLOOM).parquet(run)
        self.runs.append(run)

    def entries(self) -> DataFrame:
        """All entries of the level and the runs, unmerged."""
        return self.spark.read.schema("digest binary, rank long, n long").parquet(*([self.level] if self.level else []), *self.runs)

    def compact(self) -> DataFrame:
        """Merges everything into a new level: the smallest rank and the whole count of each digest."""
        level = f"{self.folder}/level-{len(self.runs):06d}"
        merged = self.entries().groupBy("digest").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))
        merged.sortWithinPartitions("digest").write.options(**BLOOM).parquet(level)
        self.level, self.runs = level, []
        return self.entries()


    def look_up(self, digests: list[bytes]) -> DataFrame:
        """Entries of the given digests. Filters on the sorted digest column reach the files: their ranges, and their Bloom filters for what the ranges let through."""
        wanted = [F.lit(bytearray(d)) for d in digests]
        found = self.entries().filter(F.col("digest").isin(wanted))
        return found.groupBy("digest").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))


def verified(level: DataFrame, documents: DataFrame) -> DataFrame:
    """``level`` with ``same``: whether the bytes of all texts of a digest are equal. Single rows have nothing to compare."""
    hits = written(level.filter("n > 1").select("digest"), "hits")
    if hits.count() <= MOST_BROADCAST:
        hits = F.broadcast(hits)
    copies = with_digest(documents.select("text")).join(hits, "digest", "left_semi")
    text = normalised(F.col("text"))
    bytes_of = copies.groupBy("digest").agg(F.min(text).alias("least"), F.max(text).alias("greatest"))
    same = bytes_of.select("digest", (F.col("least") == F.col("greatest")).alias("same"))
    return level.join(same, "digest", "left").withColumn("same", F.coalesce("same", F.col("n") == 1))


def exact_duplicates(documents: DataFrame, runs: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (hex of the normalised text).

    Null texts equal empty ones. Rows that repeat with the same doc_id count each; if theirs is the largest id, all of them are
    marked as kept (``drop_copies`` keeps one). Rows without doc_id rank last and stay only if no other row has the text.
    """
    index = DigestIndex(documents.sparkSession)
    rows = with_digest(documents.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "digest")
    rows = written(rows.withColumn("rank", F.coalesce(-F.col("doc_id"), F.lit(NO_ID))), "digests")
    for run in range(runs):
        index.flush(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(runs)) == run))
    groups = verified(index.compact(), documents)
    sure = F.when(~F.col("same"), F.raise_error(F.lit("one digest for different texts"))).otherwise(F.col("least_rank"))
    groups = groups.withColumnRenamed("rank", "least_rank").withColumn("least_rank", sure).drop("same")
    found = rows.join(written(groups, "groups"), "digest")  # two tables: Spark can split a digest that a third of the rows have
    return found.select(
        "doc_id",
        F.when(F.col("least_rank") != NO_ID, -F.col("least_rank")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rank") == F.col("least_rank")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """``documents`` without the rows whose text a kept row has too. Rows without doc_id stay. Where doc_ids repeat, rows are
    told apart by their text as well, and of equal rows one stays."""
    judged = written(exact_duplicates(documents), "judged")
    if not judged.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").limit(1).isEmpty():
        rows = documents.withColumn("_sha", F.sha2(normalised(F.col("text")), 256))
        named = rows.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "_sha"])
        gone = judged.filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha2"))
        named = named.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_sha") == F.col("_sha2")), "left_anti")
        return named.union(rows.filter("doc_id IS NULL")).drop("_sha")
    gone = written(judged.filter("NOT kept").select("doc_id"), "copies")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return documents.join(gone, documents["doc_id"] == gone["doc_id"], "left_anti")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
WINDOW g AS (PARTITION BY body)"""
