"""Substring dedup by suffix automata of reference shards.

A word is removed if a window of ``WINDOW`` words around it also starts in a document with a smaller doc_id.

1. *Anchors*: the least hash of the ``GRAM``-word runs inside a window. Equal windows have equal anchors, so only
   anchors found in two documents matter; documents without any are finished at once.
2. *Routes*: windows with such anchors are counted by hash. The smallest doc_id that has a window is where its
   reference text is; runs of windows with the same reference become probes.
3. *Automata*: reference texts form shards of about ``SHARD_WORDS`` words. A shard's suffix automaton, whose states know
   the smallest document they occur in, goes to every task that streams probes for it, and to no other. A probe's
   matching statistics, cut to the window's length, tell for each word whether the last ``WINDOW`` words occur in a
   smaller document. Hashes only say where to look; the automaton compares words.
4. *Removal*: the maximal spans are cut from the documents.

A passage may occur in a third of all documents: it is counted by partial sums, its reference text is in one shard
once, and that shard's probes are dealt to as many tasks as their number of words asks for. Texts are cut into pieces of
``PIECE_WORDS`` words that overlap by all but one word of a window, so every window is whole in a piece; a reference document with more
words than a shard is dealt to several shards, which all of its probes pass.

Shards are sent to the tasks that probe them, not broadcast: all shards together grow with the corpus. Which window repeats where is told by 64-bit
hashes, so a repeat whose hash another window of a smaller document has as well may be looked for in the wrong place; no word is removed for a hash alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import discard, spread, written
from loomwright.llm.jaccard_join import mixed, word_hashes

WINDOW, GRAM = 50, 16
#: Reference words of one automaton, and probed words of one task.
SHARD_WORDS, PROBE_WORDS = 60_000, 600_000
#: Words of one piece of text.
PIECE_WORDS = 20_000
#: Anchor hashes that are broadcast at most, 8 bytes each.
MOST_BROADCAST = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, np.uint64(base))
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _powers = (made[0], made[1])
    return _powers


def run_hashes(h: np.ndarray, length: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of ``length`` words (of those at ``starts``)."""
    power, inverse = _power_table(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    at = np.arange(len(h) - length + 1) if starts is None else starts
    return mixed((total[at + length] - total[at]) * inverse[at] + np.uint64(length))


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window of a document's word hashes."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    least, width, wanted = run_hashes(h, gram), 1, window - gram + 1
    while 2 * width <= wanted:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = wanted - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


class SuffixAutomaton:
    """Of several word sequences, each with a document number; ``least`` is the smallest document of each state's occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]
        self.words: dict[bytes, int] = {}

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.least.append(1 << 63)
        return len(self.length) - 1

    def add(self, words: list[bytes], document: int) -> None:
        last, number = 0, self.words
        for word in words:
            last = self._extend(last, number.setdefault(word, len(number)))
            if document < self.least[last]:
                self.least[last] = document

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of ``q`` that end with ``p`` and ``c``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return self._split(last, c, known)
        made = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, c, self.next[p][c])
        return made

    def finish(self) -> None:
        """Carries the smallest documents up the suffix links."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.least[v] < self.least[up]:
                self.least[up] = self.least[v]

    def spans(self, words: list[bytes], document: int, window: int) -> list[tuple[int, int]]:
        """Maximal spans covered by windows that occur in a smaller document."""
        out: list[tuple[int, int]] = []
        step, link, length, least, number = self.next, self.link, self.length, self.least, self.words
        v = matched = 0
        for i, word in enumerate(words):
            c = number.get(word)
            if c is None:
                v = matched = 0
                continue
            while v and c not in step[v]:
                v = link[v]
                matched = length[v]
            if c in step[v]:
                v, matched = step[v][c], matched + 1
            if matched >= window:
                while length[link[v]] >= window:
                    v = link[v]
                matched = min(matched, length[v])
                if least[v] < document:
                    a = i + 1 - window
                    if out and a <= out[-1][1]:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((a, i + 1))
        return out


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _judged(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """n_words, n_removed and the digest of what stays."""
    kept, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def removed_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``clean`` documents (doc_id, n_words, kept_sha256), finished; and ``shared`` ones (row, doc_id, text, spans array of starts and ends)."""
    documents = spread(documents.select(F.col("doc_id").cast("long"), "text"))
    anchor_schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])

    def find_anchors(batches):
        for batch in batches:
            out: tuple[list, list] = ([np.empty(0, np.int64)], [])
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = np.unique(anchors(word_hashes(words_of(text)), window, gram)).view(np.int64)
                out[0].append(found)
                out[1].extend([doc_id] * len(found))
            yield _batch((np.concatenate(out[0]), out[1]), anchor_schema)

    found = written(documents.filter("doc_id IS NOT NULL").mapInArrow(find_anchors, "anchor long, doc_id long"), "anchors")
    repeated = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("anchor")
    hits = found.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("hits"))
    hits = written(hits, "hits")
    discard(found)
    if (hits.agg(F.sum(F.size("hits") + 4)).first()[0] or 0) <= MOST_BROADCAST:
        hits = F.broadcast(hits)
    tagged = documents.join(hits, "doc_id", "left")
    first_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("hits", pa.list_(pa.int64()))])

    def finish_clean(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "hits")), strict=True):
                row = (doc_id, None, None, text, own)
                if own is None:
                    n, _, digest = _judged(words_of(text), [])
                    row = (doc_id, n, digest, None, None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield _batch(out, first_schema)

    sorted_out = tagged.mapInArrow(finish_clean, "doc_id long, n_words long, kept_sha256 string, text string, hits array<long>")
    sorted_out = written(sorted_out.withColumn("row", F.monotonically_increasing_id()), "sorted-out")
    clean = sorted_out.filter("hits IS NULL").select("doc_id", "n_words", "kept_sha256")
    shared = sorted_out.filter("hits IS NOT NULL").select("row", "doc_id", "text", "hits")

    # The place follows the hash at once: of a shuffled row, the codec then stores these two alone, as the rest repeats the row before.
    window_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("at", pa.int32())])

    def find_windows(batches):
        for batch in batches:
            for row, doc_id, text, own in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text", "hits")), strict=True):
                h = word_hashes(words_of(text))
                at = np.flatnonzero(np.isin(anchors(h, window, gram), np.array(own, np.int64).view(np.uint64)))
                yield _batch((np.full(len(at), row), np.full(len(at), doc_id), run_hashes(h, window, at).view(np.int64), at.astype(np.int32)), window_schema)

    windows = written(shared.mapInArrow(find_windows, "row long, doc_id long, hash long, at int"), "windows")
    first = windows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first != last").select("hash", "first")
    first = written(first, "first-windows")  # then the join below reads two tables, and Spark can split a window that very many documents have
    # Two lists of plain numbers, filled row by row and so in the same order; as one list of structs they take 32 bytes a window.
    routes = windows.join(first, "hash").groupBy("row").agg(F.collect_list("at").alias("at"), F.collect_list("first").alias("first"))

    step = max(1, PIECE_WORDS - window + 1)
    text_schema = pa.schema([("home", pa.int64()), ("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])

    def cut_texts(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            places = zip(*(([x.values.to_numpy() for x in batch[c]]) for c in ("at", "first")), strict=True)
            for row, doc_id, text, (at, home) in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), places, strict=True):
                words = words_of(text)
                order = np.argsort(at)  # a row has one window at a place
                at, home = at[order].astype(np.int64), home[order]
                cuts = [0, *(np.flatnonzero((np.diff(at) != 1) | (np.diff(home) != 0)) + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    first, last = int(at[a]), int(at[b - 1])
                    for start in range(first, last + 1, step):
                        end = min(start + step - 1, last) + window
                        value = (int(home[a]), int(home[a] != doc_id), row, doc_id, start, end - start, b" ".join(words[start:end]))
                        for column, x in zip(out, value, strict=True):
                            column.append(x)
            yield _batch(out, text_schema)

    texts = shared.select("row", "doc_id", "text").join(routes, "row").mapInArrow(cut_texts, "home long, kind int, row long, doc_id long, start int, n int, words binary")
    texts = written(texts, "span-texts")
    discard(windows, first)
    total = texts.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    large = texts.filter("kind = 0").groupBy("home").agg(F.ceil(F.sum("n") / SHARD_WORDS).cast("int").alias("blocks")).filter("blocks > 1")
    large = written(large, "large-references")
    if large.isEmpty():
        texts = texts.withColumn("block", F.lit(0))
    else:
        # A reference piece is in one block, a probe passes them all.
        texts = texts.join(large, "home", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.array(F.pmod(F.xxhash64("row", "start"), F.col("blocks")).cast("int"))
        texts = texts.withColumn("block", F.explode(F.when(F.col("kind") == 0, mine).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))).drop("blocks")
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("home", "block"), F.lit(shards)))
    loads = texts.filter("kind = 1").groupBy("shard").agg(F.ceil(F.sum("n") / PROBE_WORDS).cast("int").alias("splits"))
    texts = texts.join(loads, "shard")
    split = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("splits") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row", "start"), F.col("splits")).cast("int")))
    texts = texts.withColumn("task", F.explode(split)).withColumn("task", F.xxhash64("shard", "task"))
    span_schema = pa.schema([("row", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def stream(batches):
        task, automaton = None, None
        for table in _groups_by_kind(batches):
            kind = table["kind"][0].as_py()
            if table["task"][0].as_py() != task or automaton is None:
                task, automaton = table["task"][0].as_py(), SuffixAutomaton()
            if kind == 0:
                for doc_id, words in zip(table["doc_id"].to_pylist(), table["words"].to_pylist(), strict=True):
                    automaton.add(words.split(b" "), doc_id)
                automaton.finish()
                continue
            out: tuple[list, ...] = ([], [], [])
            for row, doc_id, start, words in zip(*(table[c].to_pylist() for c in ("row", "doc_id", "start", "words")), strict=True):
                for a, b in automaton.spans(words.split(b" "), doc_id, window):
                    out[0].append(row)
                    out[1].append(start + a)
                    out[2].append(start + b)
            yield _batch(out, span_schema)

    dealt = texts.select("task", "kind", "row", "doc_id", "start", "words").repartition("task").sortWithinPartitions("task", "kind", "doc_id", "row", "start")
    spans = dealt.mapInArrow(stream, "row long, a int, b int")
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    return clean, shared.select("row", "doc_id", "text").join(spans, "row", "left")


def _groups_by_kind(batches):
    """Tables of one task and kind each; probes come in pieces of one record batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        task, kind = batch["task"].to_numpy(), batch["kind"].to_numpy()
        cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(task)] if len(task) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = (task[a], kind[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            if kind[a] == 0:
                held.append(batch.slice(a, b - a))
            else:
                yield pa.Table.from_batches([batch.slice(a, b - a)])
    if held:
        yield pa.Table.from_batches(held)


def dedup_substrings(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (hex of the kept words joined by one space).

    Null and empty texts have no words. Texts under ``window`` words lose none. Rows without doc_id are neither smaller nor larger than
    others: they lose nothing and nothing is lost for them. Rows that repeat a doc_id are judged each, and not against each other.
    """
    clean, shared = removed_spans(documents, window, gram)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc_id, text, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                row = (doc_id, *_judged(words_of(text), [(s["a"], s["b"]) for s in spans or ()]))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield _batch(out, schema)

    finished = shared.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").union(finished)
