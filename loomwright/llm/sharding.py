"""Shards by a hierarchical weighted hash tree of regions, racks and shards.

A key descends the tree: it draws a number for every region and takes the lowest, then for the racks of that region alone,
then for the shards of that rack alone. A node's draw is ``-ln(u) / weight``, with ``u`` hashed from the key and the node, and
its weight the sum of the weights below it, so each shard gets its share of the keys. Draws depend on nothing but key,
node and weight: if weights change inside a rack, keys move between that rack and others by the change of its sum, and
among its own shards; nothing moves between two nodes whose weights stay.

A shard that joins the founding ones gets a region of its own. The other regions' weights stay, so keys only move from
them into the new region: that is the law ``key``. (Put into an old rack, it would raise the weights above it, and a key that
they draw could land in an old shard there.)

Slots number the rows of a shard without gaps. They come from counts by shard and hash bucket and a running
number inside each bucket, so no shard is ever ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import written

#: Rows of one shard and bucket, about, that one task numbers; and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 4096, 65_536


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0


def topology(n_shards: int, regions: int = 3, racks: int = 2, weights: dict[int, float] | None = None, founding: int | None = None) -> list[Leaf]:
    """``n_shards`` shards: the ``founding`` ones (all, unless said otherwise) dealt over regions and, inside each, over racks; each later one in a region of its own."""
    weights, founding = weights or {}, n_shards if founding is None else founding
    place = lambda s: (s % regions, s // regions % racks) if s < founding else (regions + s - founding, 0)
    return [Leaf(s, *place(s), weights.get(s, 1.0)) for s in range(n_shards)]


def _lowest(key: Column, path: list[Column], options: Column) -> Column:
    """The node with the lowest draw among ``options``, an array of (node, weight) below the nodes of ``path``."""

    def draw(option: Column) -> Column:
        # 53 bits of the hash, never 0
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(len(path)), *path, option["node"]), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.ln(unit) / option["weight"]).alias("draw"), option["node"].alias("node"))

    return F.array_min(F.transform(options, draw))["node"]


def descend(df: DataFrame, key: Column, leaves: list[Leaf], out: str) -> DataFrame:
    """``df`` with columns ``out``, ``out``_region and ``out``_rack. All rows of a key get the same shard; null is a key of its own."""
    if not leaves or any(leaf.weight <= 0 for leaf in leaves):
        raise ValueError("shards with positive weights are needed")
    tree: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in leaves:
        tree.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    region, rack = F.col(f"{out}_region"), F.col(f"{out}_rack")
    n_regions, n_racks = max(tree) + 1, max(b for some in tree.values() for b in some) + 1
    total = lambda some: float(sum(x.weight for x in some))
    # The options below each node are constants, found by the place of the node: code of one size, however many nodes there are.
    none = F.lit(None).cast("array<struct<node:int,weight:double>>")
    nodes = lambda some: F.array(*[F.struct(F.lit(n).cast("int").alias("node"), F.lit(w).alias("weight")) for n, w in some]) if some else none
    racks_of = F.array(*[nodes([(b, total(some)) for b, some in sorted(tree.get(a, {}).items())]) for a in range(n_regions)])
    shards_of = F.array(*[nodes([(x.shard, x.weight) for x in tree.get(a, {}).get(b, [])]) for a in range(n_regions) for b in range(n_racks)])
    regions = nodes([(a, total(x for some in racks.values() for x in some)) for a, racks in sorted(tree.items())])
    df = df.withColumn(f"{out}_region", _lowest(key, [], regions))
    df = df.withColumn(f"{out}_rack", _lowest(key, [region], F.get(racks_of, region)))
    return df.withColumn(out, _lowest(key, [region, rack], F.get(shards_of, region * n_racks + rack)))


def number(rows: DataFrame, shard: str, key: str, order: list[str], out: str = "slot") -> DataFrame:
    """Rows numbered from 0 without gaps inside each shard, by hash bucket of the key and then by ``order``.

    ``rows`` is read twice; the first reading needs only ``shard`` and ``key``.
    """
    n = rows.count()
    shards = max(1, rows.select(shard).distinct().count()) if n else 1
    buckets = max(1, min(MOST_BUCKETS, -(-n // (BUCKET_ROWS * shards))))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n")).select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(base, [shard, "_bucket"]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside", "_bucket")


def shard_documents(documents: DataFrame, n_shards: int = 24) -> DataFrame:
    """Every document's size, text checksum, shard, slot and the shard it would have with one shard more.

    Law ``key``: doc_id and the number of shards decide. Null texts have size 8 and a null checksum; rows that repeat keep a slot each;
    rows without doc_id share one shard.
    """
    text = F.col("text").cast("binary")
    rows = documents.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = descend(rows, F.col("doc_id"), topology(n_shards), "shard")
    grown = descend(placed, F.col("doc_id"), topology(n_shards + 1, founding=n_shards), "grown_shard")
    placed = written(grown.drop("grown_shard_region", "grown_shard_rack"), "placed")  # some bytes a document: texts are read and trees descended once
    return number(placed, "shard", "doc_id", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack"),
    )
