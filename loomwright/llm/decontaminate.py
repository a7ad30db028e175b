"""Benchmark decontamination by spaced seeds.

A mask fixes which of the next few tokens count; the others may differ. Each mask makes a hash at every token
position of the benchmark and of the documents; equal hashes put an item and a document on one diagonal, and
around such a hit the tokens of both are compared along the diagonal. An overlap counts when ``SPAN`` tokens in a
row (or all tokens of a shorter item) agree in all but a few places, so changed words do not hide a passage:
``SPAN_MISSES`` in a span, in proportion fewer in shorter items, none in items under ``LEAST_CHANGED`` words. Whatever
an item's length, its masks are such that every pattern of changes that the rule allows leaves a hit.

Documents are only scanned: tokens are hashed once, positions, seeds and lookups stay in one task per split, and what is
kept of it is one row for each document, item and diagonal. The benchmark's seeds are broadcast, in blocks of a fixed size if there are
many, and beyond ``MOST_BLOCKS`` blocks both sides are joined by seed. Then only documents with hits are read again, to be compared.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import spread, written

SPAN, SPAN_MISSES = 13, 3
#: Items of fewer words must be found unchanged.
LEAST_CHANGED = 6
#: Offsets that count, of each mask. The first three were found by a greedy search over masks of weight 5 and length 9 at most (see ``uncovered``).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 8), (0, 1, 2, 6, 8), (0,), (0, 1), (0, 1, 2))
#: Items of at least so many words use the first three masks. Shorter ones use the last: cut into one part more than changes are allowed, one part is unchanged, and has three words.
LONG = 11
#: Seed rows (seed, item, position) of one broadcast, and the most broadcasts over the documents.
MOST_BROADCAST, MOST_BLOCKS = 1_000_000, 4


def masks_for(length: int) -> tuple[int, ...]:
    """Numbers of the masks that an item of ``length`` tokens uses."""
    return (0, 1, 2) if length >= LONG else (min(length, 3) + 2,)


def allowed(length: int) -> int:
    """Tokens that may differ in the best span of an item."""
    return 0 if length < LEAST_CHANGED else min(length, SPAN) * SPAN_MISSES // SPAN


def uncovered(length: int) -> list[tuple[int, ...]]:
    """Allowed patterns of changes, in an item of ``length`` tokens or a span of a longer one, that hold no hit."""
    width = min(length, SPAN)
    hits = [frozenset(a + o for o in MASKS[m]) for m in masks_for(length) for a in range(width - max(MASKS[m]))]
    return [c for k in range(allowed(length) + 1) for c in combinations(range(width), k) if not any(h.isdisjoint(c) for h in hits)]


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as an array; one empty token for texts without any."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.split(F.trim(clean), " ")


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def seed(mask: int, hashes: str, at: str) -> Column:
    """The mask's hash at a position; null where it does not fit."""
    offsets = MASKS[mask]
    return F.when(F.col(at) + offsets[-1] < F.size(hashes), F.xxhash64(F.lit(mask), *[F.get(hashes, F.col(at) + o) for o in offsets]))


def seeds(df: DataFrame, at: str, masks: list[Column]) -> DataFrame:
    """A row for each position of ``hashes`` and each of the ``masks``: the position and ``seed``."""
    df = df.withColumn(at, F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)))
    return df.withColumn("seed", F.explode(F.array(*masks))).filter("seed IS NOT NULL")


def agreement(tokens: Column, item: Column, shift: Column) -> Column:
    """For each item token whether the document has it at its place on the diagonal, as an array of 0 and 1."""
    return F.transform(item, lambda w, i: F.when(F.get(tokens, i + shift) == w, 1).otherwise(0))


def best_span(agree: Column, span: int = SPAN) -> Column:
    """Most agreements in ``span`` item tokens in a row."""
    width = F.least(F.size(agree), F.lit(span))
    starts = F.sequence(F.lit(1), F.size(agree) - width + 1)
    total = lambda at: F.aggregate(F.slice(agree, at, width), F.lit(0), lambda a, x: a + x)
    return F.array_max(F.transform(starts, total))


def needed(item_size: Column) -> Column:
    """Agreements asked of the best span (see ``allowed``)."""
    width = F.least(item_size, F.lit(SPAN))
    return width - F.when(item_size < LEAST_CHANGED, 0).otherwise(F.floor(width * SPAN_MISSES / SPAN).cast("int"))


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, matched (tokens of the item found on the best diagonal), item_tokens.

    Empty and null texts and items without any word overlap nothing. Every row is judged by its own text; repeated rows, and rows that share a doc_id
    or have none, give one row for each doc_id and item_id. So do items that share an item_id or have none: each is sought by its own text.
    """
    matched = F.aggregate("agree", F.lit(0), lambda a, x: a + x)
    return judged(documents, benchmark).groupBy("doc_id", "item_id").agg(F.max(matched).alias("matched"), F.max(F.size("item")).alias("item_tokens"))


def text_key(text: Column) -> Column:
    """With doc_id it tells rows apart: a digest of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def judged(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each diagonal on which a document and an item overlap: doc_id, row (``text_key``), item_id, item, agree."""
    items = benchmark.select("item_id", tokens_of(F.col("text")).alias("tokens")).filter(F.array_max("tokens") != "")
    # Items are known by a digest of id and text from here on, so none needs an id and ids may repeat.
    items = written(items.dropDuplicates(["item_id", "tokens"]).withColumn("item_key", F.xxhash64("item_id", "tokens")), "items")
    n = F.size("hashes")
    own = [F.when(F.lit(m).isin(0, 1, 2) & (n >= LONG) | ~F.lit(m).isin(0, 1, 2) & (n < LONG) & (F.least(n, F.lit(3)) + 2 == m), seed(m, "hashes", "item_at")) for m in range(len(MASKS))]
    keyed = seeds(items.select("item_key", hashed(F.col("tokens")).alias("hashes"), F.size("tokens").alias("item_size")), "item_at", own)
    keyed = written(keyed.select("seed", "item_key", "item_at", "item_size").distinct(), "seeds")
    used = {m for r in keyed.select("item_size").distinct().collect() for m in masks_for(r[0])}  # lengths of items only
    docs = spread(documents.select("doc_id", "text")).select("doc_id", text_key(F.col("text")).alias("row"), tokens_of(F.col("text")).alias("tokens"))
    scanned = seeds(docs.select("doc_id", "row", hashed(F.col("tokens")).alias("hashes")), "at", [seed(m, "hashes", "at") for m in sorted(used)] or [F.lit(None).cast("long")])
    blocks = -(-keyed.count() // MOST_BROADCAST) if MOST_BROADCAST > 0 else MOST_BLOCKS + 1
    if blocks > MOST_BLOCKS:
        hits = scanned.join(keyed, "seed")
    else:
        parts = [scanned.join(F.broadcast(keyed.filter(F.pmod("seed", F.lit(blocks)) == k) if blocks > 1 else keyed), "seed") for k in range(max(1, blocks))]
        hits = reduce(DataFrame.union, parts)
    hits = written(hits.select("doc_id", "row", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "diagonals")
    # A broadcast holds places only; items join by key afterwards, by whichever way their size allows.
    found = hits.select(F.col("doc_id").alias("found_id"), F.col("row").alias("found_row"), "item_key", "shift")
    found = F.broadcast(found) if hits.count() <= MOST_BROADCAST else found
    hits = docs.join(found, (F.col("row") == F.col("found_row")) & F.col("doc_id").eqNullSafe(F.col("found_id")))
    hits = hits.join(items.select("item_key", "item_id", F.col("tokens").alias("item")), "item_key")
    hits = hits.withColumn("agree", agreement(F.col("tokens"), F.col("item"), F.col("shift")))
    return hits.filter(best_span(F.col("agree")) >= needed(F.size("item"))).select("doc_id", "row", "item_id", "item", "agree")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows that overlap an item. Every row is judged by its own text, with or without a doc_id."""
    found = judged(documents, benchmark)
    bad = written(found.select(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row")).distinct(), "contaminated")
    if bad.count() <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["bad_id"]) & (text_key(documents["text"]) == bad["bad_row"]), "left_anti")
