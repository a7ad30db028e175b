"""Ordered streams with deadlines, upkeep with a cursor, buckets and runs: against plain Python, over many small files, out of order, and killed in the middle."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators.token_bucket import metered
from loomwright.plans.monitoring import failure_runs
from loomwright.streaming import events as E
from loomwright.streaming import maintenance as M
from loomwright.streaming import ordered

EPOCH = datetime.datetime(2024, 1, 1)
HOUR = ordered.HOUR


def log(rng, n, users=4, hours=20):
    """Event rows with distinct ids, several of one time among them, in order of time."""
    at, out = 0, []
    for k in range(n):
        at += rng.choice([0, 0, 1, rng.randrange(hours * HOUR // users)])
        kind = rng.choice(["view", "click", "click", "error", "signup", "purchase"])
        out.append((k, EPOCH + datetime.timedelta(microseconds=at), rng.randrange(users), kind, float(rng.randrange(100)), f'{{"k": {rng.randrange(60)}}}' if k % 9 else "{}"))
    return out


def micros(ts):
    return (ts - EPOCH) // datetime.timedelta(microseconds=1)


def passed(rows):
    """Rows that the watermark has passed at the end, and the watermark."""
    mark = (max(micros(r[1]) for r in rows) // 1000 - 86_400_000) * 1000
    return [r for r in rows if micros(r[1]) <= mark], mark


def plain_jobs(rows):
    rows, mark = passed(rows)
    out = []
    for user in {r[2] for r in rows}:
        state, until, tried = "none", 0, 0

        def expire(upto):
            nonlocal state, until, tried
            if state == "running" and until <= upto:
                if tried >= 3:
                    out.append((user, until, "expired", tried))  # noqa: B023
                    state, until, tried = "none", 0, 0
                else:
                    state = "waiting"

        for _, ts, _, kind, value, _ in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            at = micros(ts)
            expire(at)
            if state == "none" and kind == "view" and value < 50:
                state, until, tried = "waiting", at, 0
            elif state == "waiting" and kind == "click" and at >= until:
                state, until, tried = "running", at + 12 * HOUR, tried + 1
            elif state == "running" and kind == "signup":
                until = at + 12 * HOUR
            elif state == "running" and kind == "purchase":
                out.append((user, at, "done", tried))
                state, until, tried = "none", 0, 0
            elif state == "running" and kind == "view" and value >= 50:
                state, until, tried = "waiting", at + 2 * HOUR, max(0, tried - 1)
            elif state == "running" and kind == "error":
                if tried >= 3:
                    out.append((user, at, "failed", tried))
                    state, until, tried = "none", 0, 0
                else:
                    state, until = "waiting", at + HOUR
        expire(mark)
    return sorted(out)


def plain_lists(rows):
    rows, mark = passed(rows)
    out = []
    for user in {r[2] for r in rows}:
        stays = []
        for k, ts, _, _, _, props in sorted((r for r in rows if r[2] == user and "k" in r[5]), key=lambda r: (r[1], r[0])):
            at, place = micros(ts), int(props[6:-1]) + 1
            if stays and at - stays[-1][-1][0] < 24 * HOUR:
                stays[-1].append((at, place))
            else:
                stays.append([(at, place)])
        for stay in stays:
            last = stay[-1][0]
            if last + 24 * HOUR <= mark:
                shown = [p for t, p in stay if t > last - 48 * HOUR]
                way = "falling" if shown[-1] >= min(shown) + 10 else "rising" if shown[-1] < shown[0] else "steady"
                out.append((user, stay[0][0], last, len(shown), min(shown), shown[0], shown[-1], way))
    return sorted(out)


def stored_in_files(spark, folder, rows, files, shuffled):
    rows = sorted(rows, key=lambda r: r[1])
    parts = [rows[k * len(rows) // files : (k + 1) * len(rows) // files] for k in range(files)]
    if shuffled:  # neighbours swapped: every file is behind the one before by less than the delay
        rng = random.Random(3)
        for part in parts:
            rng.shuffle(part)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, E.EVENTS).coalesce(1).write.parquet(f"{folder}/events{k:03d}.parquet")


@pytest.mark.parametrize("files,shuffled", [(1, False), (5, True)])
def test_ordered_streams(spark, tmp_path, files, shuffled):
    rows = log(random.Random(5), 420, hours=90) + [(1000, None, 1, "click", 1.0, "{}")]
    folder = f"file://{tmp_path}/in"
    timed = [r for r in rows if r[1] is not None]
    stored_in_files(spark, folder, timed, files, shuffled)
    spark.createDataFrame(rows[-1:], E.EVENTS).coalesce(1).write.parquet(f"{folder}/events999.parquet")
    stream = lambda: E.read_events(spark, f"{folder}/*", at_once=1 if files > 1 else None, pattern="*.parquet")
    at = lambda ts: micros(ts)
    jobs = E.drain(E.job_leases(stream()), "append").collect()
    assert sorted((r["user_id"], at(r["ended"]), r["outcome"], r["attempts"]) for r in jobs) == plain_jobs(timed)
    assert {r["outcome"] for r in jobs} == {"done", "failed", "expired"}
    lists = E.drain(E.trend_index(stream()), "append").collect()
    want = plain_lists(timed)
    assert sorted((r["user_id"], at(r["since"]), at(r["last"]), *r[3:]) for r in lists) == want and len(want) > 3


def test_upkeep_that_is_killed(spark, tmp_path):
    rows = log(random.Random(8), 120)
    folder, path, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "table", "cursor"))
    stored_in_files(spark, folder, rows, 6, True)
    table = M.daily_table(spark, path)
    runs = {"n": 0}

    def dies_after(batch):
        runs["n"] += 1
        return M.daily_totals(batch)

    def dying_merge(batch, source, number, order=None):
        done = M.S.StoredTable.merge(table, batch, source, number, order)
        if runs["n"] == 3:
            raise RuntimeError("killed after the commit, before the stream has noted it")
        return done

    table.merge = dying_merge
    stream = M.files_of(spark, f"{folder}/*", E.EVENTS, 1)
    with pytest.raises(Exception, match="killed"):
        M.catch_up(stream, table, "events", checkpoint, dies_after)
    assert 0 < M.daily_table(spark, path).read().agg(F.sum("n_items")).first()[0] < len(rows)
    again = M.daily_table(spark, path)
    M.catch_up(M.files_of(spark, f"{folder}/*", E.EVENTS, 1), again, "events", checkpoint, M.daily_totals)
    M.catch_up(M.files_of(spark, f"{folder}/*", E.EVENTS, 1), again, "events", checkpoint, M.daily_totals)  # nothing new
    want = sorted(tuple(r) for r in M.daily_totals(spark.createDataFrame(rows, E.EVENTS)).drop("mark").collect())
    assert sorted(tuple(r) for r in again.read().drop("mark").collect()) == want


def plain_bucket(requests, capacity, seconds):
    full, levels, out = seconds * 1_000_000, {}, set()
    cost = full // capacity
    for key, us, number in sorted((r for r in requests if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        level, last = levels.get(key, (full, us))
        level = min(full, level + us - last)
        allowed = level >= cost
        level -= cost if allowed else 0
        levels[key] = (level, us)
        out.add((key, us, number, allowed, level / cost))
    return out


def test_token_bucket(spark):
    rng = random.Random(4)
    requests, us = [], -5_000_000
    for k in range(400):
        us += rng.choice([0, 1, 400_000, 2_000_000, 9_999_999, 10_000_000, 10_000_001, 60_000_000])
        requests.append((rng.choice(["a", "b", "hot", "hot", "hot", None]), us, k))
    requests.append(("a", None, 999))
    df = spark.createDataFrame(requests, "key string, us long, id long").repartition(3).select("*", F.lit(1).alias("slice"), F.lit(2).alias("piece"))
    found = metered(df, 5, 10).collect()
    assert {tuple(r) for r in found} == plain_bucket(requests, 5, 10) and len(found) == 400
    assert metered(df.limit(0), 5, 10).count() == 0
    with pytest.raises(ValueError):
        metered(df, 7, 10)


def test_failure_runs(spark):
    rng = random.Random(12)
    rows, at = [], 0
    for k in range(500):
        at += rng.choice([0, 1_000_000, 600_000_000, 4_000_000_000, 90_000_000_000])
        rows.append((k, EPOCH + datetime.timedelta(microseconds=at), rng.choice([1, 2, None]), rng.choice([True, True, False, None])))
    want = []
    for user in (1, 2, None):
        run = []
        for k, ts, _, bad in [*sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])), (None, None, None, False)]:
            if bad:
                run.append(ts)
            elif run:
                want.append((user, run[0], run[-1], len(run)))
                run = []
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, bad boolean")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, failure_runs(df, F.col("bad")).collect()), key=key) == sorted(want, key=key)


def test_running_median(spark):
    import statistics

    from loomwright.operators.history import running_median

    rng = random.Random(2)
    rows = [(k, d, rng.choice([None, float(rng.randrange(50))])) for k in ("a", "b", None) for d in range(40)]
    rng.shuffle(rows)
    found = running_median(spark.createDataFrame(rows, "k string, d int, v double").repartition(3).select("*", F.lit(1).alias("usual_")), "k", "d", "v").collect()
    assert len(found) == len(rows)
    for r in found:
        before = [v for k, d, v in rows if k == r["k"] and d < r["d"] and v is not None]
        assert r["n_before"] == len(before) and r["usual"] == (statistics.median(before) if before else None)
