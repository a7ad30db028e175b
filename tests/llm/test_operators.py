"""The training-data operators against brute force, on a fixture of hard cases: nulls, empty and very long texts,
ties, repeated rows, rows without an id, and extra columns whose names clash with the operators' own."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm import (
    decontaminate, exact_dedup, html_extract, jaccard_join, packing, sharding, sstable, substring_dedup, token_ids, toxicity, url_filter,
)

CLASHING = ["digest", "n", "rank", "shard", "slot", "group", "rep", "row", "key", "at", "tokens", "component", "score", "label", "hits", "_bucket", "body"]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


_rng = random.Random(5)
VOCABULARY = ["".join(_rng.choice("abcdeéßno") for _ in range(_rng.randint(1, 7))) for _ in range(600)]


def fixture():
    rng = random.Random(1)
    long = words(rng, 6000)
    near = long[:400]
    passage = words(rng, 90)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One Word"), (5, "one word"), (6, "ÉCOLE one"), (7, "école one")]
    rows += [(10, " ".join(long)), (11, " ".join(long).upper()), (12, " ".join(long))]
    for i in range(20, 30):  # near copies
        copy = list(near)
        for _ in range(i - 18):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy)))
    for i in range(30, 42):  # a passage in many documents
        rows.append((i, " ".join(words(rng, rng.randint(0, 60)) + passage[: 40 + 4 * (i - 30)] + words(rng, 30))))
    rows += [(50, "same text in repeated rows " * 12), (50, "same text in repeated rows " * 12)]
    rows += [(60, "tab\tand  runs   of\r\nspace <|endoftext|> it's 12 ½ 中文 🙂\0end\n\n x"), (None, "a row without an id " * 15), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(fixture(), "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING], F.lit("en").alias("lang")).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def collected(df):
    return [r.asDict() for r in df.collect()]


# ---- tokens, packing, shards of ids


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_encoder_gives_the_librarys_ids(name, kind):
    rng = random.Random(3)
    parts = [" ", "\n", "a", "B", "1", "'s", " ", ".", "é", "\u0301", "\t", "\xa0", "İ", "ı", "<|endoftext|>", "ς", "Σ", "\0", "\u2003", "中", "🙂", "\x1c", " x", "word", "²", "½", "\u00ad"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    tool = token_ids.Encoder(token_ids.vocabulary_path(name), kind)
    want = [tool.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in tool.buffers(texts)] == want


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_encoder_looks_each_word_of_a_batch_up_once(name, kind):
    tool = token_ids.Encoder(token_ids.vocabulary_path(name), kind)
    asked = collections.Counter()

    class Counting(token_ids._Chunks):
        def __getitem__(self, chunk):
            asked[chunk] += 1
            return super().__getitem__(chunk)

    tool.known = Counting(tool._chunk, {})
    texts = ["One two, two; two.\nthree three! two" + " two" * 50, None, "", "two three, two three.", "two  two <|endoftext|> two", "中 two, 中."] * 20
    want = [tool.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    batch = pa.array(["cut off", *texts])[1:]  # as Arrow gives a slice of a column
    assert [np.frombuffer(b, "<u4").tolist() for b in tool.buffers(batch)] == want
    assert asked and max(asked.values()) == 1
    assert tool.buffers(batch[:0]) == [] and tool.buffers(pa.nulls(2, pa.string())) == [b"", b""]


def test_encoder_with_a_small_table(monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(token_ids, "LOOK_UPS", 2)
    tool = token_ids.Encoder(token_ids.vocabulary_path("byte_bpe_50k.json"), "bytes")
    texts = [t for _, t in fixture()]
    assert [np.frombuffer(b, "<u4").tolist() for b in tool.buffers(texts)] == [tool.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(tool.known) < 20


@pytest.mark.parametrize("name,kind,known", [("byte_bpe_50k.json", "bytes", [64, 220, 50256, 275]), ("word_bpe_49k.json", "words", [320, 49407, 321])])
def test_added_tokens_are_those_of_the_librarys_default(name, kind, known):
    from tokenizers import Tokenizer

    rng = random.Random(14)
    parts = [" ", "\n", "a", "B", ".", "é", "  ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "\0", "word"]
    texts = ["a <|endoftext|> b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(1000)]
    plain = Tokenizer.from_file(token_ids.vocabulary_path(name))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == known
    assert [np.frombuffer(b, "<u4").tolist() for b in token_ids.Encoder(token_ids.vocabulary_path(name), kind).buffers(texts)] == want


def least_bins(sizes, capacity):
    """Fewest bins, by trying all placements."""
    best = [len(sizes)]

    def place(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if rest[0] <= room:
                after = list(bins)
                after[after.index(room)] -= rest[0]
                place(rest[1:], after)
        place(rest[1:], [*bins, capacity - rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best[0]


def test_dominance_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.dominance_reduction(collections.Counter(sizes), 20)
        assert sorted([s for lengths, times in fixed for s in lengths * times] + [s for s, n in rest.items() for _ in range(n)]) == sorted(sizes)
        open_items = [s for s, n in rest.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + least_bins(open_items, 20) == least_bins(sizes, 20)


def test_best_fit_places_everything_once():
    rng = random.Random(4)
    counts = collections.Counter(rng.randint(1, 100) for _ in range(5000))
    bins = packing.plan_bins(dict(counts), 100)
    assert all(sum(lengths) <= 100 for lengths, _ in bins)
    placed = collections.Counter()
    for lengths, times in bins:
        for s in lengths:
            placed[s] += times
    assert placed == counts
    assert sum(t for _, t in bins) <= 1.01 * sum(s * n for s, n in counts.items()) / 100 + 1


def test_packing(docs, empty):
    tool = token_ids.Encoder(token_ids.vocabulary_path("byte_bpe_50k.json"), "bytes")
    rows = collected(packing.pack_documents(docs))
    want = collections.Counter()
    for doc_id, text in fixture():
        ids = tool.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        for n, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 2048)])):
            want[doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_shards_of_ids_round_trip(spark, docs, empty, tmp_path):
    tool = token_ids.Encoder(token_ids.vocabulary_path("word_bpe_49k.json"), "words")
    folder = f"file://{tmp_path}"
    manifest = sstable.write_shards(docs, folder, shard_bytes=4000)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert manifest.count() > 2
    rows = collected(sstable.read_shards(manifest, folder, blocks_per_task=1))
    ids = {}
    want = collections.Counter()
    for doc_id, text in fixture():
        x = [*tool.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        ids[doc_id] = x
        want[doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known)
    files = sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["shard"])
    assert all(a["last_id"] is None or a["last_id"] < b["first_id"] for a, b in itertools.pairwise(files))
    assert sstable.look_up(folder, files, 10).tolist() == ids[10]
    assert sstable.look_up(folder, files, 60).tolist() == ids[60]
    assert sstable.look_up(folder, files, 9999) is sstable.look_up(folder, files, -5) is sstable.look_up(folder, files, 15) is None
    assert sstable.round_trip(empty).count() == 0


def test_damaged_block_is_noticed(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.sst")
    with fs.LocalFileSystem().open_output_stream(path) as sink:
        writer = sstable.Writer(sink, 2)
        for i in range(2000):
            writer.add(i - 1000, np.arange(i % 50, dtype="<u2").tobytes())
        writer.close()
    assert len(writer.index) > 2
    reader = sstable.Reader(fs.LocalFileSystem().open_input_file(path))
    assert all(reader.get(i - 1000).tolist() == list(range(i % 50)) for i in range(0, 2000, 97))
    assert sum(reader.may_hold(i) for i in range(5000, 10000)) < 150
    data = bytearray(open(path, "rb").read())
    data[5] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(fs.LocalFileSystem().open_input_file(path)).block(0))


# ---- sharding


def test_hash_tree(spark, docs, empty):
    rows = collected(sharding.shard_documents(docs))
    assert len(rows) == len(fixture())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32(t.encode()) if t is not None else None) for i, t in fixture())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by_shard = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard_documents(empty).count() == 0


def plain_descent(key, leaves):
    """The same descent in plain Python, one key at a time."""

    def chain(values):
        h = 42
        for v, code in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(struct.pack(code, v), h)
        return h

    def lowest(path, weights):
        draws = {}
        for node, weight in weights.items():
            h = chain([(key, "<q"), (len(path), "<i"), *[(n, "<i") for n in path], (node, "<i")])
            draws[node] = -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight
        return min(draws, key=lambda n: (draws[n], n))

    total = lambda **at: sum(x.weight for x in leaves if all(getattr(x, k) == v for k, v in at.items()))
    region = lowest([], {x.region: total(region=x.region) for x in leaves})
    rack = lowest([region], {x.rack: total(region=region, rack=x.rack) for x in leaves if x.region == region})
    return region, rack, lowest([region, rack], {x.shard: x.weight for x in leaves if (x.region, x.rack) == (region, rack)})


def test_hash_tree_against_plain_descent(spark):
    keys = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id") * 7919 - 5).alias("k"))
    for leaves in (sharding.topology(24), sharding.topology(26, founding=24), sharding.topology(7, weights={2: 5.0, 3: 0.25}), sharding.topology(1)):
        rows = sharding.descend(keys, F.col("k"), leaves, "a").collect()
        assert all((r["a_region"], r["a_rack"], r["a"]) == plain_descent(r["k"], leaves) for r in rows)


def test_hash_tree_is_fair_and_moves_little(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    weights = {0: 3.0, 5: 0.5}
    before = sharding.descend(keys, F.col("k"), sharding.topology(8, weights=weights), "a")
    both = sharding.descend(before, F.col("k"), sharding.topology(8, weights=weights | {5: 2.0}), "b").persist()
    total = 6 + 3.0 + 0.5
    counts = {r[0]: r[1] for r in both.groupBy("a").count().collect()}
    for shard in range(8):
        share = weights.get(shard, 1.0) / total
        assert abs(counts[shard] / 40_000 - share) < 0.012
    # Shard 5 is in region 2, rack 1: what moves goes into that region, or moves inside it into that rack, or inside that rack.
    moved = both.filter("a != b")
    assert moved.filter("NOT (b_region = 2 AND (a_region != 2 OR (b_rack = 1 AND (a_rack != 1 OR b = 5))))").count() == 0 and moved.count() > 0
    grown = sharding.descend(before, F.col("k"), sharding.topology(9, weights=weights, founding=8), "c").persist()
    assert grown.filter("a != c AND c != 8").count() == 0 and abs(grown.filter("c = 8").count() / 40_000 - 1 / (total + 1)) < 0.012


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    rows = spark.range(5000).select((F.col("id") % 3).alias("shard"), (F.col("id") % 1700).alias("k"))
    found = collections.defaultdict(list)
    for r in sharding.number(rows, "shard", "k", ["k"]).collect():
        found[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in found.values())


# ---- duplicates


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_duplicates(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in fixture():
        groups[lowered(t)].append(i)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    rows = collected(exact_dedup.exact_duplicates(docs))
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0
    left = collected(exact_dedup.drop_copies(docs))
    assert set(left[0]) == set(docs.columns)
    kept = sorted(r["doc_id"] for r in left if r["doc_id"] is not None)
    assert kept == sorted({i for i, k, _, same, _ in want if same and i is not None})


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("most_rows", [4096, 3])
def test_jaccard_components(spark, docs, empty, monkeypatch, most_rows):
    monkeypatch.setattr(jaccard_join, "MOST_ROWS", most_rows)
    if most_rows == 3:
        monkeypatch.setattr(jaccard_join, "CROWD", 5)
    want = brute_components([r for r in fixture() if r[0] is not None])
    rows = [r for r in collected(jaccard_join.near_duplicates(docs)) if r["doc_id"] is not None]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    if most_rows == 4096:
        assert jaccard_join.near_duplicates(empty).count() == 0
        left = {r["doc_id"] for r in jaccard_join.drop_near_duplicates(docs).collect()} - {None}
        assert left == {i for i, (_, c) in want.items() if c == i}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 60, 4000).astype(np.uint64)
    sets = []
    for _ in range(1500):
        start, size = rng.integers(0, 3500), rng.integers(20, 400)
        sets.append(np.unique(np.concatenate([base[start : start + size], rng.integers(0, 1 << 60, rng.integers(0, 30)).astype(np.uint64)])))
    sizes, points = np.array([len(s) for s in sets]), np.stack([jaccard_join.folded(jaccard_join.counts_of(s), 64) for s in sets])
    tree = jaccard_join.CountTree(sizes, points)
    assert len(tree.levels) > 1
    for i, s in list(enumerate(sets))[::60]:
        found = set(tree.query(sizes[i], points[i]).tolist())
        for j, t in enumerate(sets):
            if jaccard_join.enough(len(np.intersect1d(s, t)), len(s), len(t)):
                assert j in found


@pytest.mark.parametrize("verify", [False, True])
def test_labels_are_those_of_all_links(verify):
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(30):  # families of copies, each changed a little more, of all sizes up to some hundreds
        base = rng.integers(0, 1 << 60, rng.integers(5, 1200)).astype(np.uint64)
        for k in range(rng.integers(1, 25)):
            gone = rng.random(len(base)) < 0.01 * k
            sets.append(np.unique(np.concatenate([base[~gone], rng.integers(0, 1 << 60, gone.sum()).astype(np.uint64)])))
    sizes, points = np.array([len(s) for s in sets]), [jaccard_join.counts_of(s) for s in sets]
    assert len({len(p) for p in points}) > 2
    label = np.arange(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        groups = min(len(points[i]), len(points[j]))
        if max(len(points[i]), len(points[j])) > 2 * groups:
            continue
        overlap = len(np.intersect1d(sets[i], sets[j])) if verify else np.minimum(jaccard_join.folded(points[i], groups), jaccard_join.folded(points[j], groups)).sum()
        if jaccard_join.enough(overlap, sizes[i], sizes[j]) and label[i] != label[j]:
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    assert jaccard_join.spanning_labels(sizes, points, sets if verify else None).tolist() == label.tolist()


@pytest.mark.parametrize("shard_words,piece_words", [(60_000, 20_000), (300, 130)])
def test_substrings(docs, empty, monkeypatch, shard_words, piece_words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(substring_dedup, "PIECE_WORDS", piece_words)
    rows = [(i, (t or "").encode().split()) for i, t in fixture()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(i, first.get(key, i))
    want = collections.Counter()
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    found = collected(substring_dedup.dedup_substrings(docs))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == want
    assert sum(k[2] for k in want) > 6000
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_texts_meet_their_routes_in_few_columns(docs, monkeypatch):
    sides = []

    def joined(plan):
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        if "Join" in plan.nodeName():
            sides.extend({f"{c.output().apply(i).name()} {c.output().apply(i).dataType().simpleString()}" for i in range(c.output().size())} for c in children)
        for c in children:
            joined(c)

    def seen(df, name, write=substring_dedup.written):
        if name == "span-texts":
            joined(df._jdf.queryExecution().sparkPlan())
        return write(df, name)

    monkeypatch.setattr(substring_dedup, "written", seen)
    assert substring_dedup.removed_spans(docs)
    assert {"row bigint", "doc_id bigint", "text string"} in sides  # no anchors beside the text
    assert {"row bigint", "at array<int>", "first array<bigint>"} in sides


def test_automaton_against_search():
    rng = random.Random(9)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))] for _ in range(5)]
        automaton = substring_dedup.SuffixAutomaton()
        for n, t in enumerate(texts[:4]):
            automaton.add(t, n)
        automaton.finish()
        probe, document, window = texts[4], rng.randint(0, 4), rng.randint(1, 5)
        want = set()
        for k in range(len(probe) - window + 1):
            if any(probe[k : k + window] == t[a : a + window] for t in texts[:document] for a in range(len(t) - window + 1)):
                want.update(range(k, k + window))
        assert {x for a, b in automaton.spans(probe, document, window) for x in range(a, b)} == want


# ---- decontamination


def test_masks_cover_all_changes():
    assert all(decontaminate.uncovered(n) == [] for n in range(1, 60))
    assert [decontaminate.allowed(n) for n in (1, 5, 6, 8, 9, 12, 13, 40)] == [0, 0, 1, 1, 2, 2, 3, 3]


def brute_overlaps(rows, bench):
    """Every item along every diagonal of every text."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for item_id, t in bench:
        item = tokens(t)
        n, width = len(item), min(len(item), 13)
        least = width - (0 if n < 6 else width * 3 // 13)
        for doc_id, text in rows:
            doc = tokens(text)
            if item and any(
                max(sum(a <= i < a + width and 0 <= i + s < len(doc) and doc[i + s] == w for i, w in enumerate(item)) for a in range(n - width + 1)) >= least
                for s in range(-n, len(doc))
            ):
                out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("most", [1_000_000, 40, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    monkeypatch.setattr(decontaminate, "MOST_BLOCKS", 100)
    rng = random.Random(77)
    some = [w for w in VOCABULARY if w.isalpha()]
    bench = [(n, " ".join(rng.choice(some) for _ in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 30)]
    rows = []
    for n, text in bench:
        for changes in range(5):
            item = text.split()
            for k in rng.sample(range(n), min(changes, n)):
                item[k] = "qqq"
            cut = item[: rng.randint(1, n)] if changes == 4 else item
            rows.append((len(rows), " ".join([rng.choice(some) for _ in range(rng.randint(0, 8))] + cut + [rng.choice(some) for _ in range(rng.randint(0, 8))])))
    rows.append((len(rows), " ".join(rng.choice(some) for _ in range(4000)) + " " + bench[-1][1]))
    found = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute_overlaps(rows, bench)


def test_decontamination(spark, docs, empty):
    rng = random.Random(11)
    item, other, short = words(rng, 40), words(rng, 14), words(rng, 7)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, ""), (5, "too short"), (6, " ".join(short)), (1, " ".join(item))], "item_id long, text string")
    changed = list(item)
    for k in range(2, 40, 5):
        changed[k] = "zzz"
    rows = [
        (100, " ".join(words(rng, 50) + item + words(rng, 50))), (101, " ".join(words(rng, 20) + changed + words(rng, 9))), (102, ", ".join(w if "ß" in w else w.upper() for w in other)),
        (103, " ".join(words(rng, 300))), (104, " ".join(item[:6])), (105, " ".join(item[10:30] + words(rng, 5))), (106, " ".join(["x", *short, "y"])), (107, None),
    ]
    mine = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(mine, bench).collect()}
    assert found == {(100, 1), (101, 1), (102, 2), (105, 1), (106, 6)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(mine, bench).collect()} == {103, 104, 107}
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    rng = random.Random(12)
    item = words(rng, 20)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    mine = spark.createDataFrame([(1, " ".join(words(rng, 9) + item)), (2, " ".join(words(rng, 60)))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.overlaps(mine, bench).collect()] == [1]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination_of_rows_without_id(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    rng = random.Random(15)
    item = words(rng, 20)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    bad, clean = " ".join(words(rng, 9) + item), " ".join(words(rng, 60))
    mine = spark.createDataFrame([(None, bad, "x"), (None, clean, "x"), (None, bad, "x"), (None, None, "x"), (7, bad, "x"), (7, clean, "x"), (8, clean, "x")], "doc_id long, text string, row string")
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.overlaps(mine, bench).collect()} == {(None, 1, 20), (7, 1, 20)}
    left = collections.Counter((r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(mine, bench).collect())
    assert left == {(None, clean): 1, (None, None): 1, (7, clean): 1, (8, clean): 1}


# ---- toxicity


def toxic_rows(n=400):
    rng = random.Random(13)
    bad = ["vile", "grotty", "scumbag", "dreck"]
    out = []
    for i in range(n):
        w = words(rng, rng.randint(20, 80))
        label = int(i % 4 == 0)
        for _ in range(label * rng.randint(2, 5)):
            w[rng.randrange(len(w))] = rng.choice(bad)
        out.append((i, " ".join(w), label))
    return out


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rows = toxic_rows()
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, "you are scumbags and grottyest " * 3, "x"), (9001, None, "x"), (9002, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, None), (None, 1), (777_777, 1)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(found) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in found.values())
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in found.values()) >= len(held)
    assert np.mean([found[i]["predicted"] == x for i, x in held]) > 0.95
    assert found[9000]["predicted"] == 1 and found[9001]["predicted"] == found[9002]["predicted"] == 0
    model = toxicity.train(d, labels)
    left = {r["doc_id"] for r in toxicity.drop_toxic(d, model).collect()}
    assert left == {i for i, r in found.items() if r["predicted"] == 0}
    assert toxicity.toxicity(empty, labels).count() == 0
    none = collected(toxicity.toxicity(docs, labels.limit(0)))
    assert len(none) == len(fixture()) and not any(r["predicted"] for r in none)


# ---- URLs and pages


def test_url_rules_and_models(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.ORG/x", "https://b.example.org/es/1", "https://example.org/en/12", "https://example.org/en/2", "https://x.com/fr/1", "https://x.com/de/1",
        "https://xcom/de/1", "https://x.net/a?b=/c#d", "https://org", "https://good.net/en/1", "ftp://a?b://c/d",
    ]
    urls += [f"https://s{i % 7}.com/de/spam-offer-{i}" for i in range(80)] + [f"https://h{i % 7}.org/garden-notes-{i}" for i in range(80)]
    urls += ["https://q.net/spam-offer-9", "https://q.net/garden-notes-9"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, body string")
    found = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert len(found) == len(urls)
    got = [(found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) for i in range(15)]
    assert [g[:3] for g in got] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.org", "/x", "org/"), ("b.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"),
        ("example.org", "/en/2", "org/"), ("x.com", "/fr/1", "com/fr/"), ("x.com", "/de/1", "com/de/"), ("xcom", "/de/1", None), ("x.net", "/a", None), ("org", "", None), ("good.net", "/en/1", None), ("a", "", None),
    ]
    assert [g[3] for g in got[4:10]] == ["allow", "block", "block", "allow", "allow", "block"]
    assert found[len(urls) - 2]["verdict"] == "block" and found[len(urls) - 1]["verdict"] == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages.filter("url LIKE '%net%'")).collect()} == {"allow"}


def brute_llr(urls_a, urls_b, gram):
    """Witten-Bell by plain counting."""
    import math

    def probability(urls, context, c):
        p = 1.0 / url_filter.ALPHABET
        for k in range(url_filter.ORDER + 1):
            tail = context[len(context) - k :]
            follow = collections.Counter()
            for u in urls:
                s = "\x02" * url_filter.ORDER + u + "\x03"
                for at in range(url_filter.ORDER, len(s)):
                    if s[at - k : at] == tail:
                        follow[s[at]] += 1
            n, kinds = sum(follow.values()), len(follow)
            p = (follow[c] + kinds * p) / (n + kinds) if n else p
        return p

    return round((math.log(probability(urls_a, gram[:-1], gram[-1])) - math.log(probability(urls_b, gram[:-1], gram[-1]))) * url_filter.SCALE)


def test_ratio_table_against_plain_counts(spark):
    a, b = ["abcab", "abd", "caab"], ["bbca", "bd"]
    rows = spark.createDataFrame([(x, 1, 0) for x in a] + [(x, 0, 1) for x in b] + [("dab", 0, 0)], "body string, accepted long, rejected long")
    counts = url_filter.grams(rows).groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    for r in url_filter.ratio_table(counts).collect():
        assert abs(r["llr"] - brute_llr(a, b, r["gram"])) <= 1


def page(main, nav="<nav><a href=/>Home</a></nav>", extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{nav}<div class='ad'>Buy</div>{extra}<article>{main}</article><footer>&copy; x</footer></body>"


def test_page_text():
    cases = {
        page("<h1>Head &amp; more</h1><p><b>Bold <br><p>Second\n\t line&nbsp;here</p><ul><li>one<li>two</ul>"): "Head & more\nBold\nSecond line here\none\ntwo",
        page("<p>text</p><script>if (a < b) '</p>'</script><!-- no --><div class='share-buttons'>Share</div><section id='comments'><p>me too</p></section>"): "text",
        page("<p>a<i>b</i>c &lt;d&gt; &#233; &unknown;</p><form><p>Name</p></form><aside>x</aside>"): "abc <d> é &unknown;",
        "plain text only": "plain text only",
        "<div>unclosed <p>paragraph <b>bold": "unclosed\nparagraph bold",
        "<a title='x>y'>link</a> < 3 <!-- open": "link < 3",
    }
    for source, want in cases.items():
        assert html_extract.page_text(source, "http://h/x", set()) == want
    assert html_extract.page_text(None, None, set()) == html_extract.page_text("", "x", set()) == ""
    deep = "<div>" * 30_000 + "deep"
    assert html_extract.page_text(deep, "http://h/", set()) == "deep"


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_items_without_an_id_contaminate_too(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    rng = random.Random(77)
    items = [words(rng, n) for n in (30, 30, 30, 8, 3)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in zip((None, 5, 5, None, None), items, strict=True)] + [(None, None), (9, "")], "item_id long, text string")
    rows = [(k, " ".join(words(rng, 25) + item + words(rng, 25))) for k, item in enumerate(items)] + [(100, " ".join(words(rng, 80))), (101, None)]
    mine = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(3).alias("item_key"), F.lit("x").alias("item"))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(mine, bench).collect()} == {(0, None), (1, 5), (2, 5), (3, None), (4, None)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(mine, bench).collect()} == {100, 101}


@pytest.mark.parametrize("most", [1_000_000, -1])
def test_site_templates(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "MOST_BROADCAST", most)
    box = "<div class='zz'><p>About this site</p></div>"
    rows = [(i, f"http://one.example/{i}", f"<body>{box}<div><p>Text number {i}</p><p>common line</p></div></body>") for i in range(8)]
    rows += [(100 + i, "http://two.example/x", f"<body>{box}<div>Other {i}</div></body>") for i in range(2)]
    rows += [(200 + i, "http://three.example/x", f"<body><article>{box}same everywhere</article></body>") for i in range(9)]
    rows += [(300, None, None), (301, None, ""), (302, "http://one.example/9", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["text"].startswith(f"Text number {i}") and "About" not in found[i]["text"] for i in range(8))
    assert found[100]["text"] == "About this site\nOther 0"
    assert found[200]["text"] == "About this site\nsame everywhere"  # copies of one article make no template
    assert found[300]["text"] == found[301]["text"] == found[302]["text"] == "" and found[300]["n_chars"] == 0
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1_000_000, -1])
def test_articles_keep_the_running_text_they_share(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "MOST_BROADCAST", most)
    shared = "<ul><li>one thing</li><li><a href=/2>another</a></li></ul><dl><dt>term<dd>meaning</dl><div>A passage, <a href=/x>linked</a>.</div><section><div><p>Deep</p></div></section><figure><figcaption>Seen</figcaption></figure>"
    links = "<div><a href=/a>First link</a> | <a href=/b>Second link</a></div>"
    box = "<div><p>About this site</p></div>"
    rows = [(10 * n + i, f"http://{tag}.example/{i}", f"<body>{box}<{tag}><p>Text {i}</p>{shared}{links}</{tag}></body>") for n, tag in enumerate(["article", "main"]) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sources = "<ul><li><a href=/a>First source</a></li><li><a href=/b>Second source</a></li></ul>"
    some = [(100 + i, f"http://some.example/{i}", f"<body><article><p>Text {i}</p>{sources * (i < 4)}{links}</article></body>") for i in range(12)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(pages.union(spark.createDataFrame(some, pages.schema))).collect()}
    assert all(found.pop(100 + i) == f"Text {i}" + "\nFirst source\nSecond source" * (i < 4) for i in range(12))
    assert found == {k: f"Text {k % 10}\none thing\nanother\nterm\nmeaning\nA passage, linked.\nDeep\nSeen" for k, _, _ in rows}


@pytest.mark.parametrize("most", [1_000_000, -1])
def test_templates_are_found_by_counts_alone(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "MOST_BROADCAST", most)
    menu = "<div class=q1><span><a href=/a>Home page</a></span><span><a href=/b>All news</a></span></div>"
    foot = "<div class=q2><p>Some company, all rights kept.</p><p>Street 1</p></div>"
    told = "<div class=q3>We changed our terms of use in May.</div>"
    words = lambda i: " ".join(f"word{i}x{k}" for k in range(40))
    rows = [(i, f"http://plain.example/{i}", f"<body>{menu}{told}<div class=q4><h2>Heading</h2><p>{words(i)}</p><ul><li>Size<li>large {i}</ul></div>{foot}</body>") for i in range(12)]
    # no container at all: running text must recur on half of the pages, and the heading stays
    rows += [(100 + i, f"http://flat.example/{i}", f"<body>{menu}<h2>Heading</h2><p>{words(100 + i)}</p>{'<p>said twice</p>' * (i < 4)}{foot}</body>") for i in range(12)]
    # near copies of one page are no template
    rows += [(200 + i, f"http://copies.example/{i}", f"<body><article><p>{words(0)}</p><p>{words(1)}</p><p>{i}</p></article></body>") for i in range(12)]
    # frames: words change, the place and the name stay
    rows += [(300 + i, f"http://frames.example/{i}", f"<body><div class='box promo-box'>Buy {i}</div><article><p>{words(i)}</p><div class=notice>Closed {i}</div></article></body>") for i in range(6)]
    rows += [(400, "http://frames.example/7", f"<body><div class='once notice'>Said once</div><article><p>{words(7)}</p></article></body>")]
    rows = [(i, u, h.replace("class='once notice'", "class=notice") if i == 400 else h) for i, u, h in rows]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Heading\n{words(i)}\nSize\nlarge {i}" for i in range(12))
    assert all(found[100 + i] == f"Heading\n{words(100 + i)}" + "\nsaid twice" * (i < 4) for i in range(12))
    assert all(found[200 + i] == f"{words(0)}\n{words(1)}\n{i}" for i in range(12))
    assert all(found[300 + i] == words(i) for i in range(6))
    assert found[400] == words(7)  # a notice outside the article goes on every host, whether its frame recurs or not


def test_names_do_not_cut_main_text():
    body = "<p>Intro</p><div class='related-work'><p>Others did it.</p></div><section id='comment-on-method'>Why so</section><div class=notice>Mind this</div>"
    source = f"<body><div class=lead>Beside it</div><article><header><h1>Title</h1><p class=standfirst>In short</p></header>{body}<div class='ad-slot'>Buy</div><section class=comments>me too</section></article></body>"
    assert html_extract.page_text(source, "http://h/x", set()) == "Beside it\nTitle\nIn short\nIntro\nOthers did it.\nWhy so\nMind this"


def test_names_alone_never_delete_the_text_of_a_page():
    cases = {
        "<body><div id='sharing'><p>A story about sharing food with all the neighbours.</p></div><div>More</div></body>": "A story about sharing food with all the neighbours.\nMore",
        "<body><div class='ads'><p>Everything about small ads in papers.</p></div></body>": "Everything about small ads in papers.",
        page("<p>Intro</p><div class='share'>Market share grew</div><p>Since</p>"): "Intro\nMarket share grew\nSince",
        page("<p>Short</p><section id='comments'><p>a long thread of what many readers have said about it</p></section>"): "Short",
        page("<p>Energy is</p><math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math><p>he wrote</p>"): "Energy is\nE=mc2\nhe wrote",
        page("<p>So <math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math> is</p>"): "So x is",
        "<body><div class='main widget'><p>Inside a widget it says all</p></div><div class='comments'><p>one two three</p></div></body>": "Inside a widget it says all",
    }
    for source, want in cases.items():
        assert html_extract.page_text(source, "http://h/x", set()) == want


def authored_pages(rng, hosts=8, per_host=3):
    """Pages of hosts too small for counts, with menus, notices, adverts and comments, some in elements without telling names: (url, page, blocks of its text)."""
    out = []
    for h in range(hosts):
        for i in range(per_host):
            say = lambda n: " ".join(words(rng, n))
            blocks = [say(rng.randint(8, 60)) for _ in range(rng.randint(2, 7))]
            menu = "".join(f"<{t}><a href=/{k}>{say(2)}</a></{t}>" for k, t in enumerate(["span"] * rng.randint(3, 7)))
            menu = rng.choice([f"<nav>{menu}</nav>", f"<div class=q{h}>{menu}</div>", f"<div><div>{menu}</div></div>", f"<ul class=top>{menu.replace('span', 'li')}</ul>"])
            notice = rng.choice(["<div class=cookie-notice>{}</div>", "<div role=alert>{}</div>", "<div id=newsletter-signup><p>{}</p></div>"]).format(say(6))
            advert = rng.choice(["<div class=ad>{}</div>", "<div class='ad-slot'>{}</div>", "<aside>{}</aside>"]).format(say(9))
            thread = rng.choice(["<section class=comments><p>{}</p></section>", "<div id=disqus>{}</div>", ""]).format(say(20))
            text = "".join(f"<p>{b}</p>" for b in blocks)
            main = rng.choice([f"<article>{text}{thread}</article>", f"<main>{text}</main>{thread}", f"<div class=c{h}>{text}</div>{thread}", f"<div id=content><div>{text}</div></div>{thread}"])
            foot = rng.choice(["<footer>{}</footer>", "<div class=footer>{}</div>"]).format(say(8))
            out.append((f"http://h{h}.example/{i}", f"<html><body>{menu}{notice}{advert}{main}{foot}</body></html>", blocks))
    return out


def test_precision_and_recall_on_authored_pages(spark):
    pages = authored_pages(random.Random(8))
    found = {r["page_id"]: r["text"].split("\n") for r in html_extract.extract(spark.createDataFrame([(k, u, p) for k, (u, p, _) in enumerate(pages)], "page_id long, url string, html string")).collect()}
    right = sum(len(set(found[k]) & set(blocks)) for k, (*_, blocks) in enumerate(pages))
    precision, recall = right / sum(map(len, found.values())), right / sum(len(b) for *_, b in pages)
    assert precision >= 0.98 and recall == 1.0, (precision, recall)


def test_pages_that_repeat_an_id(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "MOST_BROADCAST", -1)
    box = "<div class=zz><p>About this site</p></div>"
    rows = [(7 if i % 2 else None, f"http://one.example/{i}", f"<body>{box}<div><p>Text number {i} and more</p></div></body>") for i in range(8)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("key"), F.lit(1).alias("template"))).collect()
    assert sorted((r["url"], r["text"]) for r in found) == [(u, f"Text number {i} and more") for i, (_, u, _) in enumerate(rows)]


def test_very_long_page():
    source = "<body><article>" + "".join(f"<p>part {i} <b>of</b> many</p>" for i in range(60_000)) + "</article></body>"
    text = html_extract.page_text(source, "http://h/x", set())
    assert text.count("\n") == 59_999 and text.endswith("part 59999 of many")


def test_digest_index_look_up(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = exact_dedup.with_digest(spark.range(2000).select(F.col("id").alias("rank"), F.concat(F.lit("Text "), F.col("id") % 700).alias("text")))
    for run in range(3):
        index.flush(rows.filter(F.col("rank") % 3 == run))
    digests = [hashlib.sha256(t).digest() for t in (b"text 5", b"text 699", b"text 700")]
    want = {(digests[0], 5, 3), (digests[1], 699, 2)}
    for _ in range(2):  # from the runs, then from the compacted level
        assert {(bytes(r["digest"]), r["rank"], r["n"]) for r in index.look_up(digests).collect()} == want
        index.compact()


def test_scores_are_those_of_the_most_toxic_window(spark):
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.2, 0.7, -0.1)
    rows = [(1, "One two"), (2, "the quick brown fox jumps over the lazy dog and runs away from all of them"), (3, None), (4, " ".join(f"w{i % 700}" for i in range(5000))), (4, "repeated id"), (None, "no id")]

    def plain(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        logit = [sum(float(model.weights[f]) for f in toxicity.features(w)) / len(toxicity.features(w)) for w in words]
        width = min(len(words), toxicity.WINDOW)
        top = max((sum(logit[i : i + width]) / width for i in range(len(words) - width + 1)), default=0.0) if words else 0.0
        return 1 / (1 + math.exp(-(model.slope * (model.bias + top) + model.shift)))

    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = sorted((i or 0, plain(t)) for i, t in rows)
    got = sorted((r["doc_id"] or 0, r["score"]) for r in found)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)
