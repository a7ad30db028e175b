"""Filter audit, token counts and resampling against plain Python, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import filter_audit, resampling, token_counts, token_ids

CLASHING = ["n", "part", "pattern", "good", "toxic", "digest", "salt", "own", "step", "block", "row", "stream", "weight", "score", "rank", "n_words", "n_bytes", "bucket", "cell"]
WORDS = ["oak", "River", "STONE", "möwe", "a", "of", "17", "it's", "x#y", "中文", "lamp", "sea"]


def rows():
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(WORDS) + (str(rng.randrange(200)) if rng.random() < 0.7 else "") for _ in range(n))
    copies, shout = some(130), "LOUD WORDS " * 60
    out = [(1, None, "de"), (2, "", None), (3, " \t\n\x0b ", "de"), (4, "\x1c one word", "fr")]
    out += [(i, copies, rng.choice(["de", "fr", None])) for i in range(10, 40)]
    out += [(i, shout, "de") for i in (50, 51, 51, 52)] + [(None, shout, "de"), (None, copies, None), (None, None, "fr")]
    out += [(10, copies, "fr"), (49, shout, "en"), (60, some(30_000), "en"), (61, "Z" * 300_000, "en"), (62, "plain " * 99 + "end", "en"), (63, "<|endoftext|>" * 3 + "x", "en")]
    return out + [(100 + i, some(rng.randint(0, 260)), rng.choice(["de", "fr", "en"])) for i in range(250)]


LABELS = [(10, 1, 0), (10, 0, 1), (11, 1, None), (50, 0, 1), (51, 1, 1), (60, 1, 0), (None, 1, 1), (9999, 1, 1)] + [(100 + i, i % 2, int(i % 3 == 0)) for i in range(0, 250, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string").repartition(5)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING]).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def plain_audit(documents, labels):
    least = {}
    for doc_id, text, _ in documents:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    by_part = defaultdict(list)
    for doc_id, text, lang in documents:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (doc_id is not None and least[text] < doc_id)
        by_part[lang or ""].append((fails, doc_id in good, doc_id in toxic))
    out = []
    for part, found in by_part.items():
        table, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            open_ = list(found)
            for step, name in enumerate(order, 1):
                gone = [x for x in open_ if name in x[0]]
                open_ = [x for x in open_ if name not in x[0]]
                failing = sum(name in x[0] for x in found)
                only = sum(x[0] == name for x in found)
                shapley[name] += len(gone)
                table.append([part, "".join(order), step, len(open_), len(gone), failing - len(gone), only, sum(x[1] for x in gone), sum(x[2] for x in gone), name])
        out += [tuple(r[:-1] + [shapley[r[-1]]]) for r in table]
    return sorted(out)


def test_audit_is_the_plain_one(docs, labels):
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == plain_audit(rows(), LABELS)


def test_audit_with_few_parts_at_once(docs, labels, monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 1)
    monkeypatch.setattr(filter_audit, "ROWS_AT_ONCE", 7)
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == plain_audit(rows(), LABELS)


def test_audit_sql_on_the_hard_rows(spark, docs, labels):
    con = duckdb.connect()
    documents, labels_ = docs.select("doc_id", "text", "lang").toPandas(), labels.toPandas()
    documents["doc_id"], labels_ = documents["doc_id"].astype("Int64"), labels_.astype("Int64")
    con.register("documents", documents)
    con.register("labels", labels_)
    found = con.sql(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({filter_audit.ORACLE_SQL})").fetchall()
    assert sorted(found) == plain_audit(rows(), LABELS)


def test_audit_of_nothing(empty, labels, docs):
    assert filter_audit.audit(empty, labels).collect() == []
    none = labels.limit(0)
    assert sorted(map(tuple, filter_audit.audit(docs, none).collect())) == plain_audit(rows(), [])


def test_first_failures_table():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and set(table[31]) == {0}
    assert table[0b00110, filter_audit.ORDERS.index("ADCBE")] == 2


def test_counts_are_the_librarys():
    rng = random.Random(3)
    parts = [" ", "\n", "a", "B", "1", "'s", "'LL", ".", "é", "́", "\t", "\xa0", "İ", "ı", "ſ", "<|endoftext|>", "<|startoftext|>", "<|endof", "ς", "Σ", "\0", " ", "中", "🙂", "\x1c", " x", "word", "²", "½", "­", "Ǆ", "Å"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(12_000)]
    texts += ["unbelievable" * 300, "ab" * 5000, "zz" * 4000 + "é" * 3000, "".join(rng.choice("abcdeé") for _ in range(20_000)), "", None]
    tool = token_counts.TokenCounter(token_ids.vocabulary_path(token_counts.VOCABULARY))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_ids.vocabulary_path(token_counts.VOCABULARY))
    assert [tool.count(t) for t in texts] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_with_small_tables(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_CHUNKS", 3)
    tool = token_counts.TokenCounter(token_ids.vocabulary_path(token_counts.VOCABULARY))
    text = "one two three four five six one two seven"
    assert tool.count(text) == tool.count(text) == 9


def test_merges_by_rank_then_place():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("x", "x"): 3, ("xx", "x"): 4}
    assert token_counts.merged_length(list("abc"), ranks) == 1
    assert token_counts.merged_length(list("xxxxx"), ranks) == 2  # xx xx x, then xx xxx
    assert token_counts.merged_length([], ranks) == 0 and token_counts.merged_length(["q"], ranks) == 1


def test_count_tokens(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_ids.vocabulary_path(token_counts.VOCABULARY))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = []
    for doc_id, text, _ in rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(empty).collect() == []


def plain_resampling(documents, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000

    def features(t):
        w = words(t)
        return [bucket(f) for f in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]

    s, t = Counter(), Counter()
    for _, text, _ in documents:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for doc_id, text, _ in documents:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fitting = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fitting[: 25 * len(fitting) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def in_order(found):
    return sorted(found, key=lambda r: tuple((x is None, x or 0) for x in r))


TARGET = ["Oak river lamp17 sea", None, "", "oak river " * 40, "möwe 中文 it's"]


def test_resampling_is_the_plain_one(spark, docs, monkeypatch):
    target = spark.createDataFrame(list(enumerate(TARGET)), "item_id long, text string")
    want = in_order(plain_resampling(rows(), TARGET))
    assert in_order(map(tuple, resampling.resample(docs, target).collect())) == want
    monkeypatch.setattr(resampling, "BLOCK_FEATURES", 100)
    assert in_order(map(tuple, resampling.resample(docs, target).collect())) == want


def test_resampling_of_equal_rows(spark):
    same = [(5, "word " * 30, "en")] * 9 + [(6, "word " * 30, "en")] * 3
    found = resampling.resample(spark.createDataFrame(same, "doc_id long, text string, lang string"), spark.createDataFrame([(1, "word")], "item_id long, text string"))
    assert in_order(map(tuple, found.collect())) == in_order(plain_resampling(same, ["word"]))


def test_resampling_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert in_order(map(tuple, resampling.resample(docs, none).collect())) == in_order(plain_resampling(rows(), []))
    assert resampling.resample(empty, none).collect() == []


def test_sorted_runs_are_the_counts(spark):
    blocks = resampling.packed(spark.createDataFrame([(1, b"a b a b a"), (2, None)], "doc_id long, text binary"), 10_000)
    want = Counter(zlib.crc32(f) % 10_000 for f in (b"a", b"b", b"a", b"b", b"a", b"a b", b"b a", b"a b", b"b a"))
    assert resampling.bucket_counts(blocks) == dict(want)
    assert np.frombuffer(blocks.collect()[0].offsets, "<i8")[0] == 0
