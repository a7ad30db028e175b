"""Token counts of whole texts by heap-and-linked-list byte-pair merging; no identifiers are made.

A piece (what the vocabulary's own pattern takes as one) begins as one symbol for each byte, the last one marked
as the end of a word. All adjacent pairs that the vocabulary merges stand in a heap by rank, then by place; symbols know
their neighbours by a linked list. The lowest pair is popped, its two symbols become one and the pairs on both
sides enter the heap; entries whose pair has changed meanwhile are passed over. Each merge takes one symbol away, so the
count is the initial symbols minus the merges, in n log n steps for a piece of any length.

Texts are cut at spaces and newlines, which this vocabulary drops, and each distinct chunk is counted once while it
stays in a worker's table of bounded size. Literals of added tokens inside a text count as one token each, as the library
recognises them by default.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import spread
from loomwright.llm.token_ids import PATTERNS, byte_letters, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: Tokens above which a document is over the limit.
LIMIT = 2048
#: Chunks in each of the two generations that one worker process keeps: a bound on memory that changes no count.
CACHE_CHUNKS = 200_000
#: Characters that every version of Unicode normalises, lower-cases and splits alike.
_PLAIN = re.compile("[\x21-\x7e¡-įı-ɏ]*")
_loaded: dict[str, "TokenCounter"] = {}


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols remain after all merges, the lowest rank first and of equal ranks the first place."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i], symbols[j] = symbols[i] + symbols[j], ""
        merges += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        h = before[i]
        if h >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return n - merges


class TokenCounter:
    """Counts for a vocabulary of merges with a mark at the end of words, byte letters and no white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, added = content["model"], content["added_tokens"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token") or model.get("dropout"):
            raise ValueError("a plain vocabulary of merges is needed")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must be plain literals")
        self.end = model["end_of_word_suffix"] or ""
        self.symbols = {s for s in model["vocab"] if len(s.removesuffix(self.end)) == 1}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): rank for rank, m in enumerate(model["merges"])}
        literals = sorted((t["content"] for t in added), key=len, reverse=True)
        self.literal = re.compile("|".join(map(re.escape, literals))) if literals else None
        tool = Tokenizer.from_file(path)
        self.normalise, self.pieces_of = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str
        self.split, self.letters = regex.compile(PATTERNS["words"]).findall, byte_letters()
        self.now: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def piece(self, letters: str) -> int:
        """Tokens of one piece in byte letters."""
        symbols = [*letters[:-1], letters[-1] + self.end]
        if not self.symbols.issuperset(symbols):  # the library leaves out what its vocabulary doesn't have
            symbols = [s for s in symbols if s in self.symbols]
        return merged_length(symbols, self.ranks)

    def chunk(self, chunk: str) -> int:
        """Tokens of a text without spaces and newlines: plain ones are split here, others by the library's own rules."""
        if _PLAIN.fullmatch(chunk):
            pieces = [p.encode().decode("latin-1").translate(self.letters) for p in self.split(chunk.lower())]
        else:
            pieces = [p for p, _ in self.pieces_of(self.normalise(chunk))]
        return sum(self.piece(p) for p in pieces if p)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty texts have none."""
        if not text:
            return 0
        total, parts = 0, [text]
        if self.literal and self.literal.search(text):
            parts = self.literal.split(text)
            total = len(parts) - 1
        now, old = self.now, self.old
        for part in parts:
            for chunk in part.replace("\n", " ").split(" "):
                found = now.get(chunk)
                if found is None:
                    found = old.get(chunk)
                    if found is None:
                        found = self.chunk(chunk)
                    if len(now) >= CACHE_CHUNKS:
                        self.old, self.now = old, now = now, {}
                    now[chunk] = found
                total += found
        return total


def counter(vocabulary: str) -> TokenCounter:
    """One counter for each worker process and vocabulary."""
    path = vocabulary_path(vocabulary)
    if path not in _loaded:
        _loaded[path] = TokenCounter(path)
    return _loaded[path]


def count_tokens(documents: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's doc_id, n_bytes (UTF-8), n_tokens and over_limit, in one pass without a shuffle.

    Null texts count as empty: no bytes, no tokens. Repeated rows and rows without doc_id stay as they are; further columns are not read.
    """

    def count(batches):
        tokens = counter(vocabulary).count
        for batch in batches:
            n = pa.array(map(tokens, batch["text"].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], n], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long")
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", size.alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
