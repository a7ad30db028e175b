"""Partial ratios and their join against all pairs; word splits with words of any length."""

import itertools
import random

import pytest

from loomwright.functions import segment
from loomwright.operators.partial import partial_pairs


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def plain_partial(a, b):
    def one(a, b):
        windows = {b[max(0, s) : s + len(a)] for s in range(1 - len(a), len(b))}
        return max((2 * plain_common(a, w) / (len(a) + len(w)) for w in windows), default=0.0)

    if not a or not b:
        return 0.0
    return max([one(a, b)] * (len(a) <= len(b)) + [one(b, a)] * (len(b) <= len(a)))


def texts(rng, n, longest, letters="abcd"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_partial_likeness():
    rng = random.Random(6)
    for a, b in zip(texts(rng, 400, 9), texts(rng, 400, 14), strict=True):
        assert segment.partial_likeness(a, b) == pytest.approx(plain_partial(a, b))
    assert segment.partial_likeness("", "abc") == segment.partial_likeness("", "") == 0.0
    assert segment.partial_likeness("abcd", "xxabcdxx") == 1.0


@pytest.mark.parametrize("least", [0.85, 0.88, 0.6])
def test_partial_pairs_loses_none(spark, least):
    rng = random.Random(int(least * 100))
    left, right = texts(rng, 60, 12, "abc"), texts(rng, 60, 24, "abc")
    left += ["needle", "é中🙂x", "x" * 300, "", None, left[0]]
    right += ["a haystack with a nedle in it", "é中x🙂xx", "x" * 299 + "y", "", None, right[0]]
    found = partial_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), least).collect()
    want = {(a, b): r for a, b in itertools.product(set(left), set(right)) if a and b and (r := plain_partial(a, b)) >= least - 1e-9}
    assert {(r["a"], r["b"]): pytest.approx(r["ratio"]) for r in found} == want and len(found) == len(want)


def test_partial_pairs_of_nothing(spark):
    none, some = spark.createDataFrame([], "a string"), spark.createDataFrame([("abc",)], "b string")
    assert partial_pairs(none, some, 0.85).count() == 0


def test_words_of_any_length_are_known():
    word = "pneumonoultramicroscopicsilicovolcanoconiosis"
    counts = {word: 5, "dust": 9, "a": 3}
    assert segment.best_split("dust" + word + "dust", counts, 17) == ["dust", word, "dust"]
    assert segment.best_split("zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", counts, 17) == ["z" * 30]
    assert segment.best_split("", counts, 17) == []
    rng = random.Random(1)
    import math

    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        known = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 9) for _ in range(4)}
        price = lambda w: math.log(known[w] / 30) if w in known else math.log(10 / 30) - len(w) * math.log(10)  # noqa: E731, B023
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(text)), k) for k in range(len(text)))
        best = max(sum(price(text[a:b]) for a, b in itertools.pairwise([0, *c, len(text)])) for c in cuts)
        assert sum(map(price, segment.best_split(text, known, 30))) == pytest.approx(best)


def test_resegmented(spark):
    from loomwright.plans.upkeep import resegmented

    words = [("calm", 5), ("lake", 7), ("tram", 2), ("ride", 3), ("a", 50), ("cat", 9), ("in", 20)]
    vocabulary = ["calm", "lake", "fern", "hat", "cat", "wob", "fernwobhat"]
    cases = {
        "calmlake": "calm lake", "fernwobhat": "fernwobhat", "catwobhat": "cat wob hat", "my catwobhat now": "my cat wob hat now", "my catfern now": "my catfern now",  # short tokens of a longer name stay
        "calm lake": "calm lake", "zzzz": "zzzz", "": "", "catwobhät x": "catwobhät x", "ferns": "fern s", "tramride": "tramride",
    }
    df = spark.createDataFrame([(n,) for n in cases] * 2 + [(None,)], "name string").select("*", *[__import__("pyspark").sql.functions.lit(1).alias("tokens_")])
    found = resegmented(df, spark.createDataFrame(words, "w string, n long"), spark.createDataFrame([(v,) for v in vocabulary], "w string")).collect()
    assert {r["name"]: r["words"] for r in found} == cases and len(found) == len(cases)
