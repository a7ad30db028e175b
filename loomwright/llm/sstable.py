"""Sorted-string-table shards of token ids, keyed by document.

A shard is one file that ends in a footer, in this order:

* data blocks: up to ``BLOCK_IDS`` ids or ``BLOCK_KEYS`` keys. Each entry is *shared* (bytes of the key that
  equal the previous key's), *rest* (bytes that follow), the id count as a varint, the rest of the key and the
  ids in the shard's id width. Keys are a zero byte for no id, or a one
  byte and the document id as eight big-endian bytes with the sign bit flipped, so byte order is numeric order. The first key of a block shares nothing, so each block can be read by itself;
* the sparse index: for each block its first key, place, size, entries, ids, and CRC-32;
* a Bloom filter over the keys;
* the footer: places and sizes of index and filter, entries, ids, id width, version and a magic number.

A lookup bisects the manifest's key ranges, asks the shard's filter, bisects its index, and reads one block. Shards cover disjoint ranges of
document ids in ascending order, each of about ``SHARD_BYTES`` of text. Files are written under a name of their own and then renamed, so a task
that is run again, or twice at once, leaves the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import scratch_path, spread, written
from loomwright.llm.token_ids import encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS, BLOCK_KEYS = 65_536, 512
BITS_PER_KEY, PROBES = 10, 7
MAGIC, VERSION = b"LWSSTAB1", 1
FOOTER = struct.Struct("<QQQQQQII8s")
INDEX = struct.Struct("<B9sQQIQI")
#: Bytes of text in one shard, about, and of the finer ranges that shards are put together from.
SHARD_BYTES, RANGE_BYTES = 24 << 20, 2 << 20
#: Ranges at most: beyond them they grow, and shards with them (10000 shards of 200 MB are 2 TB; give ``most_ranges`` for more).
MOST_RANGES = 100_000
MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("blocks", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64())])
MANIFEST_DDL = "shard int, name string, entries long, ids long, blocks int, first_id long, last_id long"
COLUMNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Takes entries in ascending key order; ``sink`` needs write(bytes)."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.at = self.entries = self.ids = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._open()

    def _open(self) -> None:
        self.block, self.first, self.last, self.n, self.n_ids = bytearray(), b"", b"", 0, 0

    def _flush(self) -> None:
        if self.n:
            self.sink.write(bytes(self.block))
            self.index.append(INDEX.pack(len(self.first), self.first, self.at, len(self.block), self.n, self.n_ids, zlib.crc32(self.block)))
            self.at += len(self.block)
            self._open()

    def add(self, doc_id: int, ids: bytes) -> None:
        key, n_ids = key_of(doc_id), len(ids) // self.width
        if self.n and (self.n_ids + n_ids > BLOCK_IDS or self.n >= BLOCK_KEYS):
            self._flush()
        shared = 0
        while self.n and shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += bytes((shared, len(key) - shared)) + _varint(n_ids) + key[shared:] + ids
        self.first = self.first or key
        self.last = key
        self.n, self.n_ids = self.n + 1, self.n_ids + n_ids
        self.entries, self.ids = self.entries + 1, self.ids + n_ids
        self.keys.append(key)

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.sink.write(index + bloom.tobytes())
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.entries, self.ids, self.width, VERSION, MAGIC))


class Reader:
    """``source`` is a seekable file with read, seek and size."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        at, size, bloom_at, self.bits, self.entries, self.ids, self.width, version, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        source.seek(at)
        self.index = list(INDEX.iter_unpack(source.read(size)))
        self.index = [(x[1][: x[0]], *x[2:]) for x in self.index]
        self.first_keys = [x[0] for x in self.index]
        source.seek(bloom_at)
        self.bloom = source.read(-(-self.bits // 8))

    def block(self, n: int):
        """(doc_id, ids buffer) of each entry of a block, after its checksum."""
        _, at, size, entries, _, crc = self.index[n]
        self.source.seek(at)
        data = self.source.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {n} is damaged")
        at, key = 0, b""
        for _ in range(entries):
            shared, rest = data[at], data[at + 1]
            n_ids, at = _read_varint(data, at + 2)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield id_of(key), data[at : at + n_ids * self.width]
            at += n_ids * self.width

    def may_hold(self, doc_id: int) -> bool:
        return all(self.bloom[p >> 3] & 1 << (p & 7) for p in _probes(key_of(doc_id), self.bits))

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, by filter, bisection and one block (more where a key repeats); None if it is not there."""
        if not self.index or not self.may_hold(doc_id):
            return None
        n = max(0, bisect_right(self.first_keys, key_of(doc_id)) - 1)
        for found, ids in self.block(n):
            if found == doc_id:
                return np.frombuffer(ids, f"<u{self.width}")
        return None


def open_store(uri: str):
    """File system and path of a URI, as executors reach the shared folder."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def shard_bounds(documents: DataFrame, shard_bytes: int = SHARD_BYTES, most_ranges: int = MOST_RANGES) -> np.ndarray:
    """Last doc_id of every shard but the last one, so that shards hold about ``shard_bytes`` of text each.

    Quantiles of doc_id cut the rows into fine ranges, whose bytes are summed; neighbouring ranges make a shard.
    """
    sized = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    ranges = min(most_ranges, -(-total // min(RANGE_BYTES, shard_bytes)))
    if ranges < 2:
        return np.empty(0, np.int64)
    fine = sized.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] or []
    fine = np.unique(np.array(fine, np.int64))

    def place(batches):
        for batch in batches:
            at = np.searchsorted(fine, batch["doc_id"].fill_null(-(1 << 63)).to_numpy(), side="left")
            totals = np.bincount(at, batch["size"].to_numpy(), minlength=len(fine) + 1)
            used = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used].astype(np.int64))], names=["range", "size"])

    loads = {r[0]: r[1] for r in sized.mapInArrow(place, "range long, size long").groupBy("range").agg(F.sum("size")).collect()}  # at most ``most_ranges`` rows
    bounds, held = [], 0
    for k, last in enumerate(fine.tolist()):
        held += loads.get(k, 0)
        if held + loads.get(k + 1, 0) > shard_bytes:
            bounds.append(last)
            held = 0
    return np.array(bounds, np.int64)


def write_shards(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all documents into shard files; returns the manifest, one row per file: shard, name, entries, ids, blocks, first_id, last_id.

    Null texts count as empty: they hold the end id alone. Rows without doc_id come first, under one key.
    Tokenization runs on the input's own splits, and only ids are shuffled.
    """
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    cuts = shard_bounds(documents, shard_bytes)
    width = 2 if encoder(vocabulary, "words").tokenizer.get_vocab_size() <= 1 << 16 else 4

    def encode(batches):
        tool, end = encoder(vocabulary, "words", f"<u{width}"), np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            ids = [x + end for x in tool.buffers(batch["text"])]
            shard = np.searchsorted(cuts, batch["doc_id"].fill_null(-(1 << 63)).to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch["doc_id"], pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    encoded = spread(documents).mapInArrow(encode, "shard int, doc_id long, ids binary")
    # One partition for each shard by its number: hashed numbers would put several large shards in one task.
    placed = encoded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "doc_id")

    def write(batches):
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        shard = sink = writer = None

        def finish():
            writer.close()
            sink.close()
            store.move(f"{base}/{temporary}", f"{base}/shard-{shard:08d}.sst")
            row = {"shard": shard, "name": f"shard-{shard:08d}.sst", "entries": writer.entries, "ids": writer.ids, "blocks": len(writer.index)}
            return pa.RecordBatch.from_pylist([row | {"first_id": id_of(writer.keys[0]), "last_id": id_of(writer.keys[-1])}], MANIFEST)

        for batch in batches:
            for s, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if writer:
                        yield finish()
                    shard, temporary = s, f".{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{base}/{temporary}")
                    writer = Writer(sink, width)
                writer.add(doc_id, ids)
        if writer:
            yield finish()

    return placed.mapInArrow(write, MANIFEST_DDL)


def read_shards(manifest: DataFrame, folder: str, blocks_per_task: int = 16) -> DataFrame:
    """Every document read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files, start = [], 0
    for row in sorted(manifest.select("shard", "name", "ids", "blocks").collect()):  # one small row for each file
        files.append((row["name"], row["blocks"], start))
        start += row["ids"]
    work = spark.createDataFrame(files, "name string, blocks int, start long").withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)), F.lit(blocks_per_task))))
    work = work.select("name", "first", F.least(F.col("first") + blocks_per_task, F.col("blocks")).alias("last"), "start")
    tasks = sum(-(-max(1, f[1]) // blocks_per_task) for f in files)
    work = work.repartition(max(1, min(tasks, 10_000)))

    def read(batches):
        store, base = open_store(folder)
        for batch in batches:
            for name, first, last, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{base}/{name}") as file:
                    shard, out = Reader(file), []
                    at = start + sum(x[4] for x in shard.index[:first])
                    for n in range(first, last):
                        for doc_id, ids in shard.block(n):
                            wide = np.frombuffer(ids, f"<u{shard.width}").astype("<u4")
                            out.append((doc_id, at, len(wide), zlib.crc32(wide.tobytes())))
                            at += len(wide)
                    columns = zip(*out, strict=True) if out else [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COLUMNS, strict=True)], schema=COLUMNS)

    return work.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(folder: str, manifest_rows: list, doc_id: int) -> np.ndarray | None:
    """The ids of one document: the manifest's rows, in order, tell which file may have it."""
    store, base = open_store(folder)
    first = [-(1 << 63) if r["first_id"] is None else r["first_id"] for r in manifest_rows]
    at = bisect_right(first, doc_id) - 1
    if at < 0 or manifest_rows[at]["last_id"] is None or manifest_rows[at]["last_id"] < doc_id:
        return None
    with store.open_input_file(f"{base}/{manifest_rows[at]['name']}") as file:
        return Reader(file).get(doc_id)


def round_trip(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns what is read back from them."""
    folder = folder or scratch_path(documents.sparkSession, "sstable")
    return read_shards(written(write_shards(documents, folder), "manifest"), folder)
