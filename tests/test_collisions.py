"""Ticker collisions and trailing counts of groups against all pairs."""

import itertools
import random

import pytest

from loomwright.operators.trailing_counts import counts_before
from loomwright.plans import kinship
from tests.test_operators import launch_rows

DAY = 86_400


def test_counts_before(spark):
    rng = random.Random(3)
    members = [(rng.choice("ab"), rng.randrange(-50_000_000_000, 50_000_000_000)) for _ in range(300)] + [("a", None), (None, 5)]
    members += members[:20]
    questions = [(k % 40, rng.choice("abc"), rng.choice([m[1] for m in members if m[1] is not None]) + rng.choice([0, 0, 1]), rng.choice([1, -1])) for k in range(200)]
    found = {r["id"]: r["n"] for r in counts_before(spark.createDataFrame(members, "grp string, at long"), spark.createDataFrame(questions, "id long, grp string, at long, sign int"), 7000, 600).collect()}
    want = {}
    for i, grp, at, sign in questions:
        want[i] = want.get(i, 0) + sign * sum(g == grp and t is not None and at - 7_000_000_000 <= t < at for g, t in members)
    assert found == want


@pytest.mark.parametrize("most", [5, 1])
def test_collisions(spark, monkeypatch, most):
    monkeypatch.setattr(kinship, "MOST_KEYS", most)
    rng = random.Random(7 + most)
    words = ["widget", "falcon", "orchid", "small", "ring", "quartz", "harbor", "meadow", "lantern", "thimble"]
    names = [" ".join(rng.sample(words, rng.choice([1, 2, 2, 3, 7]))) for _ in range(25)] + ["falcons", "Falcon!", "old falcon", "cosmonaut", "cosmonautt"]
    rows = [(k, None if k % 31 == 0 else rng.randrange(70 * DAY), rng.choice(names), rng.choice(["AAAA", "BBBB"]), rng.choice([None, 1, 2, 3]), False) for k in range(220)]
    rows += [(1000 + k, 5 * DAY, "falcon ring", "AAAA", 1, False) for k in range(3)]  # of one time
    df = launch_rows(spark, rows)
    keys = kinship.agreement_keys(df.select("ticker", "name").distinct())
    agreeing = {}
    for r in keys.collect():
        agreeing.setdefault((r["ticker"], r["name"]), set()).add(r["key"])
    found = {r["id"]: r["same_ticker"] for r in kinship.collisions(df, keys).collect()}
    want = {}
    for (i, at, name, ticker, logo, _), _ in itertools.product([r for r in rows if r[1] is not None], [0]):
        want[i] = sum(
            t == ticker and b is not None and 0 < at - b <= 30 * DAY and not agreeing[t, n] & agreeing[ticker, name] and (logo is None or g != logo) for _, b, n, t, g, _ in rows
        )
    assert found == want and sum(want.values()) > 500
    assert max(map(len, agreeing.values())) > 5
