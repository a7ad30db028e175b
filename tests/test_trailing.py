"""Trailing counts: the same as over all pairs, from running counts, so that a crowded slice is not gone through anew for every row."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import trailing
from loomwright.operators.whole_groups import look_back
from loomwright.plans import histories, kinship
from tests.test_operators import launch_rows

START = datetime.datetime(2024, 1, 10)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def plan_of(df):
    return df._jdf.queryExecution().toString().lower()


def moving(df):
    """Whether a frame of the plan has two moving ends."""
    plan = plan_of(df)
    return "windowframe" in plan and "rangeframe, -" in plan


def crowd(spark, n=400):
    rng = random.Random(5)
    rows = [(k, rng.choice([0, 3600, 21_600, 86_400, 86_401, rng.randrange(200_000)]), rng.choice(["a", "b", None])) for k in range(n)]
    rows += [(n + k, None, key) for k, key in enumerate(["a", "a", "b", None])]
    stamp = lambda s: None if s is None else START + datetime.timedelta(seconds=s)
    return rows, spark.createDataFrame([(k, stamp(s), k % 7, key, 1.0, "{}") for k, s, key in rows], EVENTS)


def test_counts_in_windows(spark):
    rows, df = crowd(spark)
    dealt = trailing.sliced(df, "ts", 7200, 7200)
    ends = {"back": (7200, 0), "before": (7200, -1), "gap": (3600, -300 * trailing.SECOND), "around": (7200, 7200 * trailing.SECOND)}
    got = trailing.own(dealt.withColumns({name: trailing.count(["event_type"], back, upto) for name, (back, upto) in ends.items()})).collect()
    assert len(got) == 400
    for r in got:
        _, at, key = rows[r["event_id"]]
        for name, (back, upto) in ends.items():
            assert r[name] == sum(k == key and s is not None and at - back <= s and (s - at) * trailing.SECOND <= upto for _, s, k in rows), name


def test_siblings(spark):
    rows, df = crowd(spark)
    found = histories.siblings(df)
    assert not moving(found)
    got = {r["event_id"]: tuple(r)[1:] for r in found.collect()}
    for i, at, key in rows:  # rows without a time are each other's
        want = [sum(k == key and (s is None if at is None else s is not None and 0 <= at - s <= h * 3600) for _, s, k in rows) for h in (1, 6, 24)]
        assert got[i] == tuple(want)
    assert len(got) == len(rows)


def test_lineage_siblings(spark):
    rows, df = crowd(spark)
    part = spark.createDataFrame([(k, name) for k, name in enumerate(["old ring", "hot ring", "new bolt", "odd"])], "p_partkey long, p_name string")
    found = kinship.lineage_siblings(df.withColumn("event_type", F.coalesce("event_type", F.lit("error"))), part)
    assert not moving(found)
    launch = {i: (at, i % 4 // 2 if i % 4 < 3 else "odd", i % 7 * 3 + i % 3 if key else None) for i, at, key in rows if at is not None and i % 101}
    got = {r["event_id"]: tuple(r)[1:] for r in found.collect()}
    assert got.keys() == launch.keys()
    for i, (at, ticker, logo) in launch.items():
        near = [at - s for s, t, g in launch.values() if s <= at and (t == ticker or logo is not None and g == logo)]
        assert got[i] == tuple(sum(gap <= h * 3600 for gap in near) for h in (1, 6, 24))


def test_look_back(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([0, 5, 300, 86_400, rng.randrange(400_000)]) * trailing.SECOND, rng.choice("abc")) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, at long, grp string")
    for r in look_back(df, ("first", 86_400), {"near": (300, 0), "aged": (86_400, 300)}).collect():
        i, at, grp = rows[r["id"]]
        gaps = {j: at - t for j, t, g in rows if g == grp}
        in_day = [(gap, j) for j, gap in gaps.items() if 0 <= gap <= 86_400 * trailing.SECOND]
        assert (at - r["first"]["at"], -r["first"]["other"]) == max(in_day)
        assert r["near"] == sum(0 < gap <= 300 * trailing.SECOND for gap in gaps.values())
        assert r["aged"] == sum(300 * trailing.SECOND < gap <= 86_400 * trailing.SECOND for gap in gaps.values())


@pytest.mark.parametrize("crowd", [1_000_000, 40, 3])
def test_lineage_of_whole_groups_and_crowds(spark, monkeypatch, crowd):
    """Against all pairs, whether groups are ordered whole or cut, with names of several keys and launches of one time."""
    monkeypatch.setattr(kinship, "CROWD", crowd)
    rng = random.Random(11)
    names = ["quartz ring", "quartz bolt", "old bolt", "bolt", "harbor ring", "harbor bolt quartz", "small ring", "small rinng"]
    stamps = [None, 0, 301, 3600, 86_400, 86_700, 30 * 86_400]
    rows = [(k, rng.choice([rng.choice(stamps), rng.randrange(50 * 86_400)]), rng.choice(names), rng.choice(["AAAA", "BBBB"]), rng.choice([None, 1, 2, 3]), k % 5 == 0) for k in range(300)]
    df = launch_rows(spark, rows)
    agreeing = {}
    for r in kinship.agreement_keys(df.select("ticker", "name").distinct()).collect():
        agreeing.setdefault((r["ticker"], r["name"]), set()).add(r["key"])
    found = kinship.lineage(df)
    assert not moving(found)
    got = {r["event_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for i, at, name, ticker, logo, _ in rows:
        if at is None:
            assert (got[i]["original"], got[i]["how"], got[i]["rank"], got[i]["same_ticker"]) == (None, None, None, None)
            continue
        near = [(at - t, j, k == ticker, k == ticker and bool(agreeing[k, n] & agreeing[ticker, name]), logo is not None and g == logo) for j, t, n, k, g, _ in rows if t is not None and 0 <= at - t <= 30 * 86_400]
        best = {
            "both": max(((gap, j) for gap, j, same, _, logos in near if gap > 300 and same and logos), default=None),
            "name": max(((gap, j) for gap, j, _, agrees, _ in near if gap > 300 and agrees), default=None),
            "logo": max(((gap, j) for gap, j, _, _, logos in near if gap > 300 and logos), default=None),
        }
        how = next((k for k, v in best.items() if v), None)
        assert (got[i]["how"], got[i]["original"]) == (how, best[how][1] if how else None)
        assert got[i]["same_ticker"] == sum(gap > 0 and same and not agrees and not logos for gap, _, same, agrees, logos in near)
        by_name, by_logo = 1 + sum(0 < x[0] <= 86_400 and x[2] for x in near), 1 + sum(300 < x[0] <= 86_400 and x[4] for x in near)
        if how:
            assert got[i]["rank"] == (by_logo if how == "logo" else by_name)
