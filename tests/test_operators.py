"""Operators and functions on small tables with results worked out by hand."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import names as N2
from loomwright.functions import segment
from loomwright.functions import text as T
from loomwright.operators import noisy_or as N
from loomwright.operators.earliest import earliest
from loomwright.plans import histories, kinship, monitoring, texts, upkeep, vectors
from loomwright.sources import files, sinks
from loomwright.streaming import events as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "function,value,want",
    [
        (T.compact, "Dog-e 2 (Moon)!", "doge2moon"), (T.compact, None, ""), (T.surface, "The Cat's Meow (film)", "the cats meow"), (T.squeeze, "soooo goood aab", "soo good aab"),
        (T.split_camel, "camelCaseXMLName2Go", "camel Case XML Name2 Go"), (T.deleet, "p3p3", "pepe"), (T.deleet, "word12", None),
        (T.deleet, "$h1ba", "shiba"), (T.ticker_case, "$#do ge", "DOGE"), (T.fold, "ＡＢé", "ABe"), (T.fold, None, None),
    ],
)
def test_text_functions(spark, function, value, want):
    assert one(spark, function, value) == want


@pytest.mark.parametrize("n,want", [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (13, "13th"), (21, "21st"), (111, "111th")])
def test_ordinal(spark, n, want):
    assert one(spark, T.ordinal, n, "int") == want


def test_homoglyphs_and_scripts(spark):
    assert one(spark, T.homoglyph_word, "pаypal") and not one(spark, T.homoglyph_word, "paypal") and not one(spark, T.homoglyph_word, "привет")
    assert one(spark, lambda c: T.has_script(c, "han"), "a漢b") and not one(spark, lambda c: T.has_script(c, "han"), "abc")


def test_noisy_or_bonus_and_cap(spark):
    rows = [("a", "x", "c1", 0.5), ("a", "x", "c1", 0.4), ("a", "x", "c2", 0.3), ("b", "x", "c1", 1.0), ("b", "x", "c2", 0.9)]
    df = spark.createDataFrame(rows, "item string, label string, channel string, w double")
    got = {r["item"]: r["score"] for r in N.combine(df, ["item", "label"], "channel", "w").collect()}
    first = 0.5 + 0.5 * ((1 - 0.5 * 0.6) - 0.5)
    assert got["a"] == pytest.approx(1 - (1 - first) * 0.7 + 0.08)
    assert got["b"] == 0.97


def test_siblings_below_the_best_are_softened(spark):
    df = spark.createDataFrame([("i", "a/x", 0.8), ("i", "a/y", 0.6), ("i", "a/z", 0.8), ("i", "a", 0.1), ("j", "a/y", 0.6)], "item string, label string, score double")
    got = {(r["item"], r["label"]): r["score"] for r in N.soften_siblings(df, "item", "label", "score").collect()}
    assert got == {("i", "a/x"): 0.8, ("i", "a/y"): pytest.approx(0.42), ("i", "a/z"): 0.8, ("i", "a"): 0.1, ("j", "a/y"): 0.6}


def event_rows(spark, rows):
    base = datetime.datetime(2024, 1, 10)
    data = [(i, base + datetime.timedelta(seconds=s), u, k, v, "{}") for i, (s, u, k, v) in enumerate(rows)]
    return spark.createDataFrame(data, S.EVENTS)


def test_lineage_gap_of_300_seconds_and_ages(spark):
    day = 86_400
    rows = [(0, 1, "a", 1.0), (300, 1, "a", 1.0), (301, 1, "a", 1.0), (5 * 3600, 1, "a", 1.0), (7 * 3600, 1, "a", 1.0), (day + 400, 1, "a", 1.0), (0, 2, "a", 1.0)]
    got = {r["event_id"]: (r["original"], r["kind"]) for r in histories.lineage_kind(event_rows(spark, rows)).collect()}
    assert got[0] == (None, "original") and got[1] == (None, "original") and got[2] == (0, "early_copy")
    assert got[3][1] == "copy" and got[5] == (0, "late_copy") and got[6] == (None, "original")


def test_copy_rank_ties_count_as_later(spark):
    got = {r["event_id"]: (r["rank"], r["of_all"]) for r in histories.copy_rank(event_rows(spark, [(0, 1, "a", 1.0), (0, 1, "a", 1.0), (86_400, 1, "a", 1.0), (86_401, 1, "a", 1.0)])).collect()}
    assert got == {0: (1, 3), 1: (1, 3), 2: (3, 4), 3: (2, 2)}


def test_empty_events(spark):
    none = event_rows(spark, [(0, 1, "a", 1.0)]).limit(0)
    for query in (histories.lineage_kind, histories.copy_rank, monitoring.windowed_totals, monitoring.quota_running, histories.namesakes):
        assert query(none).count() == 0
    assert monitoring.calendar_spine_day(none).count() == 36


def test_longest_match_sweeps_from_the_left(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta beta gamma"), (2, None), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "beta gamma delta echo, gamma"), (2, "alpha beta! rest"), (3, "beta gamma; more")], "item_id long, text string")
    got = [(r["at"], r["n"], r["surface"]) for r in texts.dict_longest_match(docs, bench).orderBy("at").collect()]
    assert got == [(0, 2, "alpha beta"), (2, 1, "gamma"), (4, 2, "beta gamma")]


def test_hamming_pairs_lose_none(spark):
    import random

    rng = random.Random(6)
    numbers = [rng.getrandbits(64) for _ in range(40)]
    for n in list(numbers):
        x = n
        for b in rng.sample(range(64), rng.randint(0, 18)):
            x ^= 1 << b
        numbers.append(x)
    signed = [n - (1 << 64) if n >> 63 else n for n in numbers]
    df = spark.createDataFrame([(i, n, signed[0]) for i, n in enumerate(signed)], "id long, hash long, mirror long")
    got = {(r["a"], r["b"]): r["distance"] for r in vectors.hamming_pairs(df).collect()}
    want = {}
    for a in range(len(numbers)):
        for b in range(a + 1, len(numbers)):
            d = min((numbers[a] ^ numbers[b]).bit_count(), (numbers[a] ^ numbers[0]).bit_count())
            if d <= 14:
                want[a, b] = d
    assert got == want


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i * 37, i % 3, ["error", "view", "error"][i % 3] if i % 7 else "error", float(i)) for i in range(300)]
    batch = event_rows(spark, rows)
    batch.write.parquet(f"{tmp_path}/events.parquet")
    stream = spark.readStream.schema(S.EVENTS).parquet(f"{tmp_path}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    got = S.drain(S.hourly_usage(stream), "complete")
    want = batch.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n_items"), F.max("value").alias("peak"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def streamed(spark, path, files):
    """A stream of event files, one in each batch."""
    for n, rows in enumerate(files):
        event_rows(spark, rows).coalesce(1).write.parquet(f"{path}/{n}")
    return spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/*").withColumn("at", F.col("ts").cast("timestamp"))


def test_breaker_cools_down_and_probes(spark, tmp_path):
    hour = 3600
    kinds = [(0, "error"), (1, "error"), (2, "error"), (3, "error"), (4, "view"), (14, "error"), (15, "view"), (25, "view"), (26, "error"), (27, "error"), (28, "error")]
    rows = [(int(h * hour), 1, kind, 1.0) for h, kind in kinds]
    got = S.drain(S.breaker(streamed(spark, str(tmp_path), [rows]), 3, 10), "append").orderBy("opened").collect()
    # Opens at the third failure (hour 2); hours 3 and 4 are refused; the probe at 14 fails; 15 is refused; the probe at 25 succeeds; three more failures open it again.
    base = got[0]["opened"] - datetime.timedelta(hours=2)
    assert [((r["opened"] - base).total_seconds() / hour, r["reopened"]) for r in got] == [(2, False), (14, True), (28, False)]


def test_jobs_end_done_or_failed(spark, tmp_path):
    names = ["view", "click", "error", "click", "purchase", "click", "view", "click", "error", "click", "error", "click", "error", "click"]
    rows = [(n * 60, 5, kind, 1.0) for n, kind in enumerate(names)]
    got = S.drain(S.job_states(streamed(spark, str(tmp_path), [rows[:6], rows[6:]])), "append").orderBy("ended").collect()
    assert [(r["outcome"], r["attempts"]) for r in got] == [("done", 2), ("failed", 3)]


def test_late_rows_of_closed_windows_are_dropped(spark, tmp_path):
    hour = 3600
    files = [[(0, 1, "view", 1.0)], [(10 * hour, 1, "view", 1.0)], [(10 * hour + 60, 1, "view", 1.0)], [(60, 1, "view", 9.0), (9 * hour + 60, 1, "view", 1.0)], [(20 * hour, 1, "view", 1.0)]]
    got = S.drain(S.hourly_usage(streamed(spark, str(tmp_path), files)), "append").orderBy("hour").collect()
    assert [(r["n_items"], r["peak"]) for r in got][:3] == [(1, 1.0), (1, 1.0), (2, 1.0)]


def test_segmentation_and_indel_ratio(spark):
    counts = {"the": 50, "moon": 5, "dog": 5, "them": 2, "on": 9}
    assert segment.best_split("themoondog", counts, sum(counts.values())) == ["the", "moon", "dog"]
    rows = spark.createDataFrame([("abcd", "abxd"), ("", ""), (None, "a"), ("same", "same")], "a string, b string")
    assert [r[0] for r in rows.select(segment.indel_ratio("a", "b")).collect()] == [0.75, 1.0, None, 1.0]


def test_search_uses_only_given_parameters(spark):
    rows = [(1, 7, "O", datetime.datetime(1997, 5, 1), "1-URGENT"), (2, 8, "F", datetime.datetime(1997, 5, 1), "5-LOW")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string")
    keys = lambda **k: [r[0] for r in upkeep.search(orders, **k).orderBy("o_orderkey").collect()]
    assert keys() == [1, 2] and keys(status="O") == [1] and keys(customer=8) == [2] and keys(priorities=["1%", "5%"]) == [1, 2] and keys(until="1996-01-01") == []


def plain_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], (left + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def test_common_length_against_the_whole_table():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 90))) for _ in "ab")
        assert segment.common_length(a, b) == plain_common_length(a, b)


def test_similar_names_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    names = ["blue bolt brand#10", "blue plate brand#10", "a", "b", "", "aa", "ab", "aaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaa", "ééééééééa", "ééééééééb"]
    words = [["blue", "red", "old", "mild", "wild"], ["bolt", "plate", "volt", "late", "slate", "bold"], ["brand#10", "brand#11", "brand#2"]]
    names += [" ".join(rng.choice(w) for w in words) for _ in range(60)]
    names += ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    names += [n[:k] + rng.choice("abcx") + n[k + rng.randint(0, 2) :] for n in names[-100:] for k in [rng.randint(0, len(n))]]
    rows = [(rng.choice(["x", "y", None]), n) for n in names for _ in range(2)] + [("x", None)]
    found = [tuple(r) for r in upkeep.similar_pairs(spark.createDataFrame(rows, "p_type string, name string").repartition(3)).collect()]
    want = []
    for kind in ("x", "y", None):
        for a, b in itertools.combinations(sorted({n for k, n in rows if k == kind and n}), 2):
            ratio = 2 * plain_common_length(a, b) / (len(a) + len(b))
            if ratio >= 0.86:
                want.append((a, b, round(ratio, 4)))
    assert sorted(found) == sorted(want) and len(want) > 50


def test_similar_names_differ_in_their_words_too(spark, tmp_path):
    rows = [("T", "blue bolt", "Brand#10"), ("T", "blue plate", "Brand#10"), ("U", "blue plate", "Brand#10"), ("U", "grey slate", "Brand#20")]
    spark.createDataFrame(rows, "p_type string, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in upkeep.QUERIES["similar_names"](spark, str(tmp_path)).collect()] == [("blue bolt brand#10", "blue plate brand#10", 0.8649)]


# ---- lineage, by hand


def launch_rows(spark, rows):
    """id, seconds, name, ticker, logo, refers; seconds None: no launch time."""
    base = datetime.datetime(2024, 1, 10)
    data = [(i, None if s is None else base + datetime.timedelta(seconds=s), name, ticker, logo, refers) for i, s, name, ticker, logo, refers in rows]
    df = spark.createDataFrame(data, "id long, ts timestamp_ntz, name string, ticker string, logo long, refers boolean")
    return df.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def lineage_of(spark, rows):
    return {r["event_id"]: (r["original"], r["how"], r["rank"], r["kind"]) for r in kinship.lineage(launch_rows(spark, rows)).collect()}


def test_lineage_prefers_name_and_logo_then_name_then_logo(spark):
    hour = 3600
    rows = [
        (1, 0, "blue widget", "WIDG", 7, False), (2, hour, "red widget", "WIDG", None, False), (3, 2 * hour, "Blue Widget!", "WIDG", 7, False), (4, 3 * hour, "green widget", "WIDG", 9, False),
        (5, 3 * hour, "other plate", "PLAT", 7, False), (6, 3 * hour + 60, "lone anvil", "ANVI", None, True), (7, 3 * hour + 200, "lone anvil", "ANVI", None, False), (8, None, "x", "X", None, True), (9, None, "y", "Y", None, False),
    ]
    got = lineage_of(spark, rows)
    assert got[1] == (None, None, None, "original")
    assert got[3] == (1, "both", 3, "early_copy") and got[4] == (1, "name", 4, "copy") and got[2] == (1, "name", 2, "early_copy")
    assert got[5] == (1, "logo", 3, "early_copy")
    # Within five minutes a namesake is no source, but the later launch is a copy by rank; the first refers to something known.
    assert got[6] == (None, None, None, "reference") and got[7] == (None, None, 2, "early_copy")
    assert got[8] == (None, None, None, "reference") and got[9] == (None, None, None, "unknown")


def test_lineage_of_old_names_and_colliding_tickers(spark):
    day = 86_400
    rows = [
        (1, 0, "blue widget", "WIDG", 1, False), (2, 3 * day, "blue widget", "WIDG", 2, False),  # used before, silent for a day, another logo: a reference
        (3, 0, "green plate", "PLAT", 3, False), (4, 3 * day - 3600, "green plate", "PLAT", 4, False), (5, 3 * day, "green plate", "PLAT", 5, False),  # a wave an hour ago: a late copy
        (6, 0, "small gear", "GEAR", 6, False), (7, 7200, "red gear", "GEAR", 8, False),  # everyday words and ticker: a collision, no copy
        (8, 40 * day, "small gear", "GEAR", 6, False),  # out of the window
    ]
    got = lineage_of(spark, rows)
    assert got[2] == (1, "name", 1, "reference")
    assert got[5] == (3, "name", 2, "late_copy")
    assert got[7] == (None, None, None, "original") and got[8] == (None, None, None, "original")


def test_lineage_of_a_crowd_and_of_close_spellings(spark):
    rows = [(i, i * 600, "steel widget", "WIDG", None, False) for i in range(14)]
    rows += [(100, 0, "cosmonaut", "COSM", None, False), (101, 3600, "cosmonautt", "COSM", None, False), (102, 3600, "cosmos", "COSM", None, False)]
    got = lineage_of(spark, rows)
    assert got[0][3] == "original" and got[2] == (0, "name", 3, "early_copy") and got[5] == (0, "name", 6, "copy") and got[12] == (0, "name", 13, "late_copy")
    assert got[101] == (100, "name", 2, "early_copy") and got[102][0] is None


def test_earliest_looks_over_empty_days(spark):
    day = 86_400_000_000
    at = [(1, 0, "g"), (2, 5 * day + 7, "g"), (3, 12 * day, "g"), (4, 12 * day, "g"), (5, 20 * day, "g"), (6, 20 * day, "h")]
    got = {r["id"]: (r["first"]["at"], -r["first"]["other"]) for r in earliest(spark.createDataFrame(at, "id long, at long, grp string"), 10).collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (5 * day + 7, 2), 4: (5 * day + 7, 2), 5: (12 * day, 4), 6: (20 * day, 6)}


def test_name_functions(spark):
    assert one(spark, N2.normal_name, "Pеpe​Coin 2.0!!") == "pepe coin 2.0"
    assert one(spark, lambda c: F.array_join(N2.obfuscation(c), ","), "Pеpe​ soooon h3llo") == "zero_width,homoglyph,repeated_letters,leet"
    assert one(spark, N2.clean_ticker, " $#ｄｏ ge🐶é ") == "DOGEE"
    assert one(spark, N2.is_address, "So11111111111111111111111111111111111111112") and not one(spark, N2.is_address, "0" * 40) and not one(spark, N2.is_address, None)
    assert [one(spark, N2.image_score, d, "int") for d in (0, 8, 14, 20, 21)] == [1.0, 0.9, 0.7, 0.1, 0.0]
    assert one(spark, lambda c: F.array_join(N2.title_surfaces(c), "|"), "Peanut (squirrel)") == "peanut squirrel|peanut"
    assert one(spark, N2.duration, 7199.0, "double") == "119 min" and one(spark, N2.dollars, 2_500_000.0, "double") == "$2.5M"


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    for rows in ([("a", 1), ("a", 2), ("b", 1)], [("a", 3), ("c", 1)]):
        sinks.append_versions(spark, path, spark.createDataFrame(rows, "k string, o int"), "k", "o")
    assert sorted((r["k"], r["o"], r["version"]) for r in spark.read.parquet(path).collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1), ("c", 1, 1)]
    assert {r["x"] for r in files.records(spark, write_lines(tmp_path, ['{"x": 1, "old": 2}', "broken", "{}"]), "x long").collect()} == {1, None}


def write_lines(folder, lines):
    (folder / "lines.json").write_text("\n".join(lines))
    return f"file://{folder}/lines.json"
