"""Whole texts to token ids with the ``tokenizers`` library, each distinct word of a batch looked up once.

Both vocabularies used here never merge across a space that stands before a word, so a text may be cut
there and every chunk encoded by itself. A byte-level vocabulary keeps white space as tokens; its texts
are cut only where a single white-space character stands between words, and any text with a run of white
space goes through the tokenizer in one piece, as does any text with the literal of an added token such as
``<|endoftext|>``. A vocabulary that drops white space can be cut at every
space and newline. Chunks of Latin letters, digits and ASCII marks, for which all versions of Unicode agree,
are split by the vocabulary's own pattern and given to the library's merge model directly; all others, and
texts that cannot be cut, go through its whole encoder. The ids are the library's own in either case.

A batch is cut at byte places of its Arrow buffer. Its chunks are dictionary-encoded, the distinct ones are cut once more into
word and marks, and only what is distinct among those is looked up or encoded; NumPy lays the ids out in the order of the texts.
"""

from __future__ import annotations

import os
import re
from array import array
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words, marks and other chunks in each of the two generations that one worker process keeps: a bound on memory that changes no id.
CACHE_CHUNKS = 150_000
#: Look-ups between two checks of that bound.
LOOK_UPS = 10_000
#: Two characters of white space, whatever version of Unicode the engine knows.
_RUN = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]{2}"
_PLAIN = re.compile("[\n\x20-\x7e\u00a1-\u012f\u0131-\u024f]*")
#: A plain word with at most one space before it, which the patterns take as one piece.
_WORD = "^ ?[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and _PLAIN.fullmatch(c)) + "]+$"
#: Fixed values of the public vocabularies: how each splits a text before its merges.
PATTERNS = {
    "bytes": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "words": r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}
_loaded: dict[tuple[str, str], "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file, or ``name`` itself if it is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Chunks(dict):
    """Encodings of chunks that were asked for lately; what is missing is taken from the generation before or made."""

    def __init__(self, make, before: dict):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk)
        if found is None:
            found = self.make(chunk)
        self[chunk] = found
        return found

    def next(self) -> "_Chunks":
        """A new generation, with this one before it and none before that."""
        self.before = {}
        return _Chunks(self.make, self)


class Encoder:
    """Texts to little-endian id buffers. ``kind``: ``bytes`` (white space kept) or ``words`` (white space dropped)."""

    def __init__(self, path: str, kind: str, dtype: str = "<u4"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Literals that the library takes out of a text first: no text with one is cut, and none at all if one is sought in the normalised text.
        self.literals = tuple("" if t.normalized else t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.merge = self.tokenizer.model.tokenize
        self.kind, self.dtype = kind, np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.split = regex.compile(PATTERNS[kind]).findall
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.known = _Chunks(self._chunk, {})

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        """What the pattern takes as one: straight to the merges."""
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", self.space)
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.merge(letters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        if self.kind == "words":
            chunk = chunk.lower()
        if (chunk[1:] if chunk[:1] == " " else chunk).isalpha():
            return self._merged(chunk)
        parts = self.split(chunk)
        return b"".join([self.known[p] for p in parts]) if len(parts) > 1 else self._merged(parts[0]) if parts else b""

    def _uncut(self, texts: pa.Array) -> np.ndarray:
        """Which texts are taken whole."""
        out = np.full(len(texts), "" in self.literals)
        for literal in filter(None, self.literals):
            out |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        if self.kind == "bytes":
            out |= pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
        return out

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks whose encodings, joined, are the encodings of the texts, and how many stand before each text's end."""
        starts, data = _places(texts)
        text = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8)
        line = text == 10
        cut = np.zeros(len(text) + 1, bool)
        cut[:-1] = line | (text == 32)
        if self.kind == "bytes":  # a newline is a chunk of its own; elsewhere a chunk begins with the space or newline before it
            cut[1:] |= line
        cut[starts - starts[0]] = True
        cuts = np.flatnonzero(cut)
        return _strings(cuts + starts[0], data), np.searchsorted(cuts, starts[1:] - starts[0])

    def _ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts one after the other, and where each part's end."""
        found: list[bytes] = []
        for at in range(0, len(parts), LOOK_UPS):
            if len(self.known) > CACHE_CHUNKS:
                self.known = self.known.next()
            known = self.known
            found += [known[p] for p in parts.slice(at, LOOK_UPS).to_pylist()]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // self.dtype.itemsize
        return np.frombuffer(b"".join(found), self.dtype), ends

    def buffers(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as one buffer; null: empty."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        uncut = self._uncut(texts)
        if uncut.all():
            return [self._whole(t) for t in texts.to_pylist()]
        chunks, last = self._chunks(texts.filter(pa.array(~uncut)) if uncut.any() else texts)
        chunks = chunks.dictionary_encode()
        distinct = chunks.dictionary if self.kind == "bytes" else pc.utf8_ltrim(chunks.dictionary, " \n")
        words = pc.utf8_rtrim(distinct, punctuation)
        size = pc.binary_length(pc.if_else(pc.match_substring_regex(words, _WORD), words, distinct)).to_numpy()
        starts, data = _places(distinct)
        halves = np.empty(2 * len(distinct) + 1, np.int64)  # each distinct chunk's word and the marks after it, or all of it and nothing
        halves[::2], halves[1::2] = starts, starts[:-1] + size
        halves = _strings(halves, data).dictionary_encode()
        ids, ends = _laid_out(*self._ids(halves.dictionary), halves.indices.to_numpy())
        ids, ends = _laid_out(ids, ends[1::2], chunks.indices.to_numpy())
        ends = np.concatenate([np.zeros(1, np.int64), ends])[np.concatenate([np.zeros(1, np.int64), last])] * self.dtype.itemsize
        joined = memoryview(ids.tobytes())
        cut = (bytes(joined[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False))
        if not uncut.any():
            return list(cut)
        return [self._whole(texts[n].as_py()) if whole else next(cut) for n, whole in enumerate(uncut.tolist())]


def _places(texts: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    """Byte places of a large string array without nulls, and its bytes."""
    _, places, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), data
    return np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1], data


def _strings(places: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    """The strings between neighbouring byte places."""
    return pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(np.ascontiguousarray(places, np.int64)), data or pa.py_buffer(b""))


def _laid_out(ids: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries (``ends``: where each one's end) in a given order, and where they end there."""
    size = np.diff(ends, prepend=0)
    first, size = (ends - size)[order], size[order]
    out = np.cumsum(size)
    return ids[np.arange(out[-1] if len(out) else 0) + np.repeat(first - out + size, size)], out


def encoder(name: str, kind: str, dtype: str = "<u4") -> Encoder:
    """One encoder for each worker process and vocabulary."""
    path = vocabulary_path(name)
    if (path, dtype) not in _loaded:
        _loaded[path, dtype] = Encoder(path, kind, dtype)
    return _loaded[path, dtype]
