"""N-gram Jaccard join by count-vector R-trees.

A document's tokens are its distinct five-word shingles, as 64-bit hashes. Tokens are hashed into groups, and a
document becomes the point of its group counts. Larger sets have more groups (about one for four tokens), so that the bound
stays as sharp as it is for small ones; a point folds into one of half as many groups by adding its halves. Two sets share at most the sum over the groups of the smaller
count, so an R-tree whose nodes carry coordinate maxima and size ranges bounds the overlap of a query with
all documents below a node, and only pairs that the bound lets through are compared token by token.

One tree over a whole corpus would compare all with all, so trees are built where partners can be:

1. Equal sets collapse into one representative (the smallest doc_id) first.
2. Each representative goes to the keys of its prefix: the first tokens of its set in one order of all tokens, as many as
   Jaccard 0.8 needs (a fifth of the set, plus one). Similar sets have a key in common, whatever the order is (the prefix
   theorem). The order is by hash, but tokens that are among the ``FIRST_KEYS`` first of very many sets are put
   last, so that a passage of very many documents is no meeting place of all of them.
3. Of keys with the same members one is kept. At each, a tree links those that the bound lets through; the components of
   these links are the blocks that hold all partners.
4. In each block a tree proposes pairs, whole token sets are compared, and only links that join two
   components are looked for, so a group of n near copies takes about n comparisons.

Groups over ``MOST_ROWS`` or ``MOST_TOKENS`` are never put in one task: they are cut by sizes and then into chunks which all meet
a first chunk, and then, in chunks again, everything that this did not join to the largest component.

Words are compared through the 64-bit hashes of shingles: two sets of n tokens are misjudged with a chance below n * n / 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import discard, spread, written
from loomwright.llm.components import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
GROUPS, PER_GROUP, LEAF = 64, 4, 32
#: Rows of one group in one task, and their tokens where token sets are compared (8 bytes each).
MOST_ROWS, MOST_TOKENS = 4096, 1_000_000
#: Entries that a query is compared with before it asks the tree: those nearest in size.
NEAREST = 32
#: Representatives or keys that are broadcast at most (8 bytes each).
MOST_BROADCAST = 500_000
#: A token is put last if so many sets have it among their first keys; and so many tokens at most: this bounds a broadcast. Neither changes a result.
FIRST_KEYS, CROWD, MOST_LAST = 4, 256, 100_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, A-Z lower-cased, words cut at ASCII white space; of all words as one if there are fewer than ``size``."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        total = total * _ODD + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(total))


def counts_of(tokens: np.ndarray) -> np.ndarray:
    """The point of a token set."""
    groups = max(GROUPS, 1 << (len(tokens) // PER_GROUP).bit_length() - 1) if len(tokens) >= PER_GROUP else GROUPS
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint16)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A point of twice as many groups, or as many, as one of ``groups``."""
    return point if len(point) == groups else point[:groups] + point[groups:]


def enough(overlap, n_a, n_b):
    """Whether an overlap of sets of these sizes reaches the threshold: 100 * intersection >= 80 * union."""
    return (DENOMINATOR + NUMERATOR) * overlap >= NUMERATOR * (n_a + n_b)


class CountTree:
    """A packed R-tree of points with set sizes: entries sorted by size, then by their widest coordinate inside slabs."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.sizes, self.points = sizes, points
        m = len(sizes)
        order = np.argsort(sizes, kind="stable")
        slab = max(LEAF, int(np.sqrt(m / LEAF)) * LEAF)
        for a in range(0, m, slab) if m > LEAF else ():
            part = order[a : a + slab]
            axis = int(points[part].var(axis=0).argmax())
            order[a : a + slab] = part[np.argsort(points[part, axis], kind="stable")]
        self.order = order
        self.levels = []  # from the leaves up: least and greatest size, coordinate maxima
        low, high, top = sizes[order], sizes[order], points[order]
        while len(low) > LEAF:
            cuts = np.arange(0, len(low), LEAF)
            low, high, top = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(top, cuts, axis=0)
            self.levels.append((low, high, top))

    def query(self, size: int, point: np.ndarray) -> np.ndarray:
        """Entries whose overlap with the query may reach the threshold."""
        at = None
        for low, high, top in reversed(self.levels):
            at = np.arange(len(low)) if at is None else at[at < len(low)]
            fits = (DENOMINATOR * high[at] >= NUMERATOR * size) & (NUMERATOR * low[at] <= DENOMINATOR * size)
            at = at[fits]
            least = np.maximum(low[at], -(-NUMERATOR * size // DENOMINATOR))
            at = at[enough(np.minimum(top[at], point).sum(axis=1, dtype=np.int64), size, least)]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        found = self.order if at is None else self.order[at[at < len(self.order)]]
        n = self.sizes[found]
        found = found[(DENOMINATOR * n >= NUMERATOR * size) & (NUMERATOR * n <= DENOMINATOR * size)]
        return found[enough(np.minimum(self.points[found], point).sum(axis=1, dtype=np.int64), size, self.sizes[found])]


def spanning_labels(sizes: np.ndarray, points: list[np.ndarray], sets: list[np.ndarray] | None) -> np.ndarray:
    """The smallest entry of each entry's component; links are pairs past the bound, or verified by ``sets``."""
    label, width = np.arange(len(sizes)), np.array([len(p) for p in points])
    for groups in np.unique(width):
        # Partners differ in size by a quarter at most, so they have as many groups, or twice as many.
        own = np.flatnonzero(width == groups)
        wider = np.flatnonzero((width == 2 * groups) & (NUMERATOR * sizes <= DENOMINATOR * sizes[own].max()))
        entries = np.concatenate([own[np.argsort(sizes[own], kind="stable")], wider])
        _span(entries, len(own), sizes[entries], np.stack([folded(points[k], groups) for k in entries]), sets, label)
    return label


def _span(entries: np.ndarray, n_own: int, sizes: np.ndarray, points: np.ndarray, sets: list[np.ndarray] | None, label: np.ndarray) -> None:
    """Joins in ``label`` what the links of the first ``n_own`` entries (in order of size) with each other and with the rest join."""
    tree, largest = None, int(entries[0])

    def join(i: int, found: np.ndarray) -> None:
        """Links entry i with the components of ``found``, entries past the bound; the likeliest first."""
        me = entries[i]
        found = found[label[entries[found]] != label[me]]
        if sets is not None and len(found) > 1:
            bound = np.minimum(points[found], points[i]).sum(axis=1, dtype=np.int64) / (sizes[found] + sizes[i])
            found = found[np.argsort(bound, kind="stable")]
        while len(found):
            j = int(entries[found[-1]])
            if sets is None or enough(len(np.intersect1d(sets[me], sets[j], assume_unique=True)), sizes[i], sizes[found[-1]]):
                low, high = sorted((int(label[me]), int(label[j])))
                label[label == high] = low
                found = found[label[entries[found]] != low]
            else:
                found = found[:-1]

    def past(i: int, at: np.ndarray) -> np.ndarray:
        at = at[NUMERATOR * sizes[i] <= DENOMINATOR * sizes[at]]
        return at[enough(np.minimum(points[at], points[i]).sum(axis=1, dtype=np.int64), sizes[i], sizes[at])]

    for i in range(1, len(entries)):
        before = min(i, n_own)
        join(i, past(i, np.arange(max(0, before - NEAREST), before)))
        if before > NEAREST:
            if i % NEAREST == 0:
                values, counts = np.unique(label[entries[:before]], return_counts=True)
                largest = int(values[counts.argmax()])
            # A member of the largest component needs only those outside it.
            mine = label[entries[i]]
            others = np.flatnonzero(label[entries[:before]] != mine) if mine == label[largest] else None
            if others is not None and len(others) <= NEAREST * LEAF:
                join(i, past(i, others))
            else:
                tree = tree or CountTree(sizes[:n_own], points[:n_own])
                found = tree.query(sizes[i], points[i])
                join(i, found[found < before])


def _groups(batches):
    """Record batches sorted by their first column, as one table for each value."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def _views(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    """Binary values as arrays of ``kind``, without a copy."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        _, starts, data = chunk.buffers()
        at = np.frombuffer(starts, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        memory = memoryview(data) if data else b""
        out += [np.frombuffer(memory[a:b], kind) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def _link_groups(rows: DataFrame, verify: bool) -> DataFrame:
    """Edges (a, b) that span the links in each group of rows (group, rep, n, tokens or counts): stars around each component's first entry."""

    def link(batches):
        a, b = [], []
        for table in _groups(batches):
            if len(table) < 2:
                continue
            rep, n = table["rep"].to_numpy(), table["n"].to_numpy().astype(np.int64)
            sets = _views(table["data"], "<u8") if verify else None
            points = [counts_of(x) for x in sets] if verify else _views(table["data"], "<u2")
            first = spanning_labels(n, points, sets)
            linked = np.flatnonzero(first != np.arange(len(first)))
            a.append(rep[first[linked]])
            b.append(rep[linked])
            del sets, points, table
            if sum(map(len, a)) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])

    dealt = rows.select("group", "rep", "n", "data").repartition("group").sortWithinPartitions("group", "n", "rep")
    return dealt.mapInArrow(link, "a long, b long")


def links_in_groups(rows: DataFrame, verify: bool) -> DataFrame:
    """Edges that span the links of every group; large ones in chunks (see above). ``rows`` must be a written table."""

    def loads(df: DataFrame) -> DataFrame:
        """How many tasks each group asks for."""
        tokens = MOST_TOKENS if verify else 16 * MOST_TOKENS  # points take half a byte for each token
        return df.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / F.lit(MOST_ROWS), F.sum("n") / F.lit(tokens))).cast("int").alias("m"))

    large = written(loads(rows).filter("m > 1"), "large-groups")
    if large.isEmpty():
        return _link_groups(rows, verify)
    # Partners have sizes within a factor of 1.25: a row meets all of them in its own band of sizes or the next.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int")
    big = rows.join(large.select("group"), "group").withColumn("band", F.explode(F.array(band, band + 1)))
    big = written(big.withColumn("group", F.xxhash64("group", "band")).drop("band"), "banded")
    sizes = written(loads(big).filter("m > 1"), "large-bands")
    direct = rows.join(large, "group", "left_anti").select("group", "rep", "n", "data")
    direct = direct.unionByName(big.join(sizes, "group", "left_anti").select("group", "rep", "n", "data"))
    found = written(_link_groups(direct, verify), "direct-links")
    if sizes.isEmpty():
        return found
    big = big.join(sizes.withColumnRenamed("m", "chunks"), "group")
    big = written(big.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int")), "chunked")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    # The first chunk goes to all chunks, every other one stays where it is.
    met = big.withColumn("chunk", F.explode(F.when(F.col("chunk") == 0, every).otherwise(F.array("chunk"))))
    chunked = written(_link_groups(met.withColumn("group", F.xxhash64("group", "chunk")), verify), "chunk-links")
    label = components(chunked)
    named = big.select("group", "rep", "n").join(label, big["rep"] == label["node"], "left").select("group", "rep", "n", F.coalesce("component", "rep").alias("component"))
    named = written(named, "named")
    most = named.groupBy("group", "component").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("component", F.struct("c", "component")).alias("most"))
    rest = named.join(most, "group").filter("component != most").select("group", "rep", "n")
    parts = written(loads(rest).select("group", F.greatest("m", F.lit(1)).alias("parts")), "parts")
    if parts.isEmpty():
        return found.union(chunked)
    rest = rest.select("group", "rep").distinct().withColumn("open", F.lit(True))
    # Part p of the rest and chunk c meet in a group of their own: all chunks of a row of the rest, all parts of any other row.
    pairs = big.join(parts, "group").join(rest, ["group", "rep"], "left")
    part = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int")
    as_rest = pairs.filter("open").withColumn("p", part).withColumn("c", F.explode(every))
    as_chunk = pairs.withColumn("c", F.col("chunk")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter((F.col("p") != part) | F.col("open").isNull())
    crossed = as_rest.unionByName(as_chunk).withColumn("group", F.xxhash64("group", "p", "c"))
    return found.union(chunked).union(_link_groups(crossed, verify))


def sketches(documents: DataFrame, last: np.ndarray | None = None) -> DataFrame:
    """doc_id, n, two halves of the set's digest, the prefix keys and the point of every whole text. Tokens in ``last`` come last in the order."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("point", pa.binary())])
    shared = None if last is None else documents.sparkSession.sparkContext.broadcast(np.sort(last.astype(np.int64).view(np.uint64)))

    def sketch(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            keys, ends = [np.empty(0, np.uint64)], [0]
            for text in batch["text"].to_pylist():
                tokens = shingles(text)
                n = len(tokens)
                digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8")
                prefix = n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0
                point = counts_of(tokens).astype("<u2").tobytes() if n else None
                if shared is not None and n:
                    known = shared.value
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    common = known[at] == tokens
                    tokens = np.concatenate([tokens[~common], tokens[common]])
                keys.append(tokens[:prefix])
                ends.append(ends[-1] + prefix)
                for column, value in zip(rows, (n, digest[0], digest[1], point), strict=False):
                    column.append(value)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            plain = [pa.array(c, f.type) for c, f in zip(rows[:3], list(schema)[1:4], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *plain, listed, pa.array(rows[3], pa.binary())], schema=schema)

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(sketch, "doc_id long, n long, d1 long, d2 long, keys array<long>, point binary")


def token_sets(documents: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, n and the token set (8 bytes each, sorted) of the documents named in ``reps`` (rep), one row for each."""
    rows = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").join(small(reps), "rep", "left_semi")

    def sets(batches):
        for batch in batches:
            tokens = [shingles(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["rep"], pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["rep", "n", "data"])

    return rows.mapInArrow(sets, "rep long, n long, data binary")


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def representatives(sketched: DataFrame) -> DataFrame:
    """One row for each distinct set that is not empty: its digest, smallest doc_id, keys and point."""
    return sketched.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("point").alias("point"))


def shared_keys(reps: DataFrame) -> DataFrame:
    """(group, set) for each key that several representatives have; ``set`` numbers the rows of ``reps``.

    Keys grow with the corpus, so they are joined by a shuffle at every size; Spark splits a key that very many sets have.
    """
    keyed = reps.select("set", "rep", F.explode("keys").alias("group"))
    shared = written(keyed.groupBy("group").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a != b").select("group"), "shared-keys")
    return written(keyed.select("group", "set").join(shared.hint("merge"), "group"), "keyed")


def meeting_places(documents: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (set, rep, n, d1, d2, point) and the keys at which they meet (group, set)."""

    def numbered(df: DataFrame) -> DataFrame:
        return written(df.filter("rep IS NOT NULL").withColumn("set", F.monotonically_increasing_id()), "sets")

    reps = numbered(representatives(sketched))
    crowded = reps.select(F.explode(F.slice("keys", 1, FIRST_KEYS)).alias("group")).groupBy("group").agg(F.count("*").alias("c")).filter(F.col("c") > CROWD)
    crowded = written(crowded.orderBy(F.desc("c"), "group").limit(MOST_LAST), "crowded")
    last = [r[0] for r in crowded.select("group").collect()]  # at most MOST_LAST
    if last:
        # Only sets that have such a token in their prefix get other keys by the new order.
        touched = reps.select("n", "d1", "d2", "rep", F.explode("keys").alias("group")).join(F.broadcast(crowded), "group", "left_semi")
        touched = written(touched.select("n", "d1", "d2", "rep").distinct(), "touched")
        again = sketches(documents.join(small(touched.select(F.col("rep").alias("_rep")).distinct()), F.col("doc_id") == F.col("_rep"), "left_semi"), np.array(last, np.int64))
        again = representatives(again.join(small(touched.select("n", "d1", "d2")), ["n", "d1", "d2"], "left_semi"))
        first = reps
        reps = numbered(reps.drop("set").join(small(touched.select("n", "d1", "d2")), ["n", "d1", "d2"], "left_anti").unionByName(again))
        discard(first)
    keyed = shared_keys(reps)
    # Keys with the same members (by count, ends and two 64-bit digests) are one meeting place.
    members = keyed.groupBy("group").agg(
        F.count("*").alias("c"), F.min("set").alias("a"), F.max("set").alias("b"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y")
    )
    places = written(members.groupBy("c", "a", "b", "x", "y").agg(F.min("group").alias("group")).select("group"), "places")
    return reps, keyed.join(places.hint("merge"), "group")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) .

    Null and empty texts have no shingles and are components of their own. Rows that repeat a doc_id with other texts count as one node
    with several sets. Rows without doc_id take the component of an equal set, if any, else null.
    """
    documents = documents.select("doc_id", "text")
    sketched = written(sketches(documents), "sketches")
    rows = written(sketched.select("doc_id", "n", "d1", "d2"), "digests")
    reps, keyed = meeting_places(documents, sketched)
    discard(sketched)
    points = reps.select("set", "rep", "n", F.col("point").alias("data"))
    near = links_in_groups(written(keyed.join(points, "set").select("group", "rep", "n", "data"), "points"), verify=False)
    blocks = written(components(near), "blocks")
    sets = token_sets(documents, blocks.select(F.col("node").alias("rep")))
    block = small(blocks.select(F.col("node").alias("rep"), F.col("component").alias("group")))
    inside = written(sets.join(block, "rep").select("group", "rep", "n", "data"), "block-sets")
    discard(reps)
    links = links_in_groups(inside, verify=True)
    classes = written(components(links), "classes")
    # A doc_id that comes with several texts links its sets.
    reps = rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    named = reps.join(small(classes), reps["rep"] == classes["node"], "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    found = rows.select("doc_id", "n", "d1", "d2").join(written(named, "named-sets"), ["n", "d1", "d2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with one document of each component: the smallest doc_id.

    Rows that repeat a doc_id are one document and stay or go together; rows without doc_id stay.
    """
    judged = near_duplicates(documents)
    gone = written(judged.filter("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return documents.join(gone, documents["doc_id"] == gone["doc_id"], "left_anti")
