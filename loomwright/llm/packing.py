"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Items are counted by length, so an instance of any number of documents shrinks to at most ``capacity``
counts. On these counts the driver works out groups of equal bins (patterns):

1. *Dominance reduction*: the longest open item is fixed with at most two partners whenever the set provably
   dominates every other set that could hold it (exact fit, only one partner possible, or at most two
   partners possible of which none beats the chosen ones). Fixed items leave the instance, equal sets at once.
2. *Best fit* on what remains, longest first, whole groups of equal items and equal bins at once.

Each piece finds its bin by its rank among the pieces of its own length: ranks come from two-level counts
(length and hash bucket), never from one ordered task, and the pattern intervals are bounded by lengths and
residuals rather than by rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import spread, written
from loomwright.llm.token_ids import encoder

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Hash buckets of a length's ranks; a length with N pieces has tasks of about N / RANK_BUCKETS rows.
RANK_BUCKETS = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with ``end_id`` after them, cut into pieces of ``capacity`` (the first may be shorter).

    Null texts count as empty and give one piece that holds the end id alone. Repeated rows stay repeated.
    """

    def cut(batches):
        encode = encoder(vocabulary, "bytes")
        end = np.array([end_id], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode.buffers(batch["text"]), strict=True):
                ids += end
                cuts = [0, *range((len(ids) - 1) % width + 1, len(ids) + 1, width)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc_id, n, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class _Sizes:
    """Open items: a sorted list of lengths with counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def give(self, size: int) -> None:
        if size not in self.count:
            self.sizes.insert(bisect_left(self.sizes, size), size)
            self.count[size] = 0
        self.count[size] += 1

    def fitting(self, room: int) -> int | None:
        """The largest open length of at most ``room``."""
        at = bisect_left(self.sizes, room + 1)
        return self.sizes[at - 1] if at else None

    def smallest(self, n: int, above: int = 0) -> list[int]:
        """The ``n`` smallest items, repeated by count, longer than ``above``."""
        out: list[int] = []
        for s in self.sizes[bisect_left(self.sizes, above + 1) :]:
            out += [s] * min(self.count[s], n - len(out))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """Two open items with the largest sum of at most ``room``, the longer first; of equal sums the one with the longest item."""
        best, pair = -1, None
        low, high = 0, bisect_left(self.sizes, room + 1) - 1
        while low <= high:
            a, b = self.sizes[high], self.sizes[low]
            if a + b > room:
                high -= 1
            elif low == high and self.count[a] < 2:
                break
            else:
                if a + b > best:
                    best, pair = a + b, (a, b)
                low += 1
        return pair


def _dominating(items: _Sizes, size: int, room: int) -> tuple[int, ...] | None:
    """Partners for an item of ``size`` (not among ``items``) that dominate all other partners; None if none provably do."""
    partner = items.fitting(room)
    if partner is None:
        return ()
    least = items.smallest(3)
    if partner == room or len(least) < 2 or least[0] + least[1] > room:  # exact fit, or one partner at most
        return (partner,)
    if len(least) == 3 and sum(least) <= room:  # three partners could fit
        return None
    a, b = items.best_pair(room)
    if partner >= a + b:
        return (partner,)
    between = items.smallest(2, above=b)
    if partner == a and (len(between) < 2 or sum(between) > room):
        return (a, b)
    return None


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed because they dominate all alternatives, as (lengths, times), and the counts that remain open.

    A set that dominates keeps dominating while its lengths last, as taking items away only removes alternatives,
    so equal sets are fixed at once. Passes repeat until one of them fixes nothing.
    """
    items, fixed, changed = _Sizes(counts), [], True
    while changed:
        changed = False
        for size in sorted(items.count, reverse=True):
            while size in items.count:
                items.take(size, 1)
                chosen = _dominating(items, size, capacity - size)
                items.give(size)
                if chosen is None:
                    break
                uses = Counter((size, *chosen))
                times = min(items.count[s] // k for s, k in uses.items())
                for s, k in uses.items():
                    items.take(s, k * times)
                fixed.append(((size, *chosen), times))
                changed = True
    return fixed, dict(items.count)


def best_fit(counts: dict[int, int], capacity: int, open_bins: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths, times) for groups of equal bins."""
    groups: dict[int, list[list]] = defaultdict(list)  # room left -> [lengths, times]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if not groups[room]:
            rooms.insert(bisect_left(rooms, room), room)
        groups[room].append([lengths, times])

    for lengths, times in open_bins:
        put(capacity - sum(lengths), lengths, times)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                whole, rest = divmod(left, each)
                if whole:
                    put(capacity - each * size, (size,) * each, whole)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[at]
            lengths, times = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            each = min(room // size, left)
            whole = min(times, left // each)
            put(room - each * size, lengths + (size,) * each, whole)
            if times > whole:
                put(room, lengths, times - whole)
            left -= each * whole
    return [(lengths, times) for room in rooms for lengths, times in groups[room]]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Reduction, then best fit of the rest into new bins and into the room that fixed sets leave."""
    fixed, rest = dominance_reduction(counts, capacity)
    return best_fit(rest, capacity, fixed)


def intervals(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset): rank r lies in sequence ``first sequence + r - first rank``."""
    out, used, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, times in bins:
        offset = 0
        for size in lengths:
            out[size].append((used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return {size: np.array(rows, dtype=np.int64) for size, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any more columns) with sequence_id and offset, gapless in each sequence.

    The pieces are read twice, so give a written table. Empty input gives empty output.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int")
    pieces = pieces.withColumn("_bucket", bucket)
    sizes = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    placed = intervals(plan_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("_rank", rank).join(bases, ["length", "_bucket"])
    fields = [f for f in pieces.schema.fields if f.name != "_bucket"]
    names = [f.name for f in fields]
    table = pieces.sparkSession.sparkContext.broadcast(placed)

    def place(batches):
        for batch in batches:
            rank = batch["_base"].to_numpy() + batch["_rank"].to_numpy()
            length = batch["length"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                rows = table.value[int(size)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
                offset[at] = rows[k, 2]
            columns = [batch[name] for name in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """All documents as pieces placed in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(token_pieces(spread(documents.select("doc_id", "text")), capacity, vocabulary, end_id), "pieces"), capacity)
