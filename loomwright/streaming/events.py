"""Structured Streaming forms of usage counters, waves, deduplication and the circuit breaker.

Each query drains what is there (``availableNow``) from a directory of files and returns the result as a table in the shared folder, where
checkpoints go too. State is keyed; keys that are quiet for longer than ``QUIET`` lose theirs by event time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwright.plans.registry import Pack
from loomwright.sources.scratch import new_folder
from loomwright.streaming import ordered

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, at_once: int | None = None, pattern: str = "events*.parquet") -> DataFrame:
    """The stream of event files of a folder, with ``at`` as event time. ``at_once`` bounds the files of a micro-batch: for files that come in order of time but for the delay of the stream's watermark."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern)
    files = (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).parquet(folder)
    return files.withColumn("at", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there and returns its result, written by the executors. In ``complete`` mode every batch replaces the table; in ``append`` mode it adds to it."""
    spark = stream.sparkSession
    out, checkpoint = new_folder(spark, "stream-result"), new_folder(spark, "stream-checkpoint")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(out)
    except Exception as error:  # noqa: BLE001  a stream without files has written nothing
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], stream.schema)


#: After so long without a row a key's state goes.
QUIET = "60 days"


def keyed(events: DataFrame, start: tuple, advance: Callable, emitted: str, state: str) -> DataFrame:
    """A state for each user, moved on by every row in order of time: ``advance(state, row)`` gives the next state and None or a row (without the user) to emit.

    Rows are ordered inside a micro-batch, whose size bounds what one user's rows take; a row that comes in a later batch than its time is taken as it comes.
    """
    names = [x.split()[0] for x in emitted.split(", ")]

    def work(key, frames, held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        now, out = held.get if held.exists else start, []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for row in rows.itertuples():
            now, found = advance(now, row)
            if found is not None:
                out.append((key[0], *found))
        held.update(now)
        held.setTimeoutTimestamp(held.getCurrentWatermarkMs() + int(pd.Timedelta(QUIET).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["user_id", *names])

    rows = events.withWatermark("at", "1 day").select("user_id", "event_id", "event_type", "value", "ts", "at")
    return rows.groupBy("user_id").applyInPandasWithState(work, f"user_id long, {emitted}", state, "append", GroupStateTimeout.EventTimeTimeout)


def hourly_usage(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hourly counters by kind; rows later than ``late`` are dropped once their window is closed."""
    w = F.window(F.col("at"), "1 hour")
    usage = events.withWatermark("at", late).groupBy(w, "event_type").agg(F.count("*").alias("n_items"), F.max("value").alias("peak"))
    return usage.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n_items", "peak")


def waves(events: DataFrame) -> DataFrame:
    """Counts by kind over a day, every six hours."""
    w = F.window(F.col("at"), "24 hours", "6 hours")
    counts = events.withWatermark("at", "1 day").groupBy(w, "event_type").agg(F.count("*").alias("n_items"))
    return counts.select(F.col("window.end").cast("timestamp_ntz").alias("until"), "event_type", "n_items")


def single_flight(events: DataFrame) -> DataFrame:
    """One row for each key, however often it is asked for within ``QUIET``; then its state goes."""
    rows = events.withWatermark("at", QUIET).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return rows.select("user_id", "event_type")


def reuse_flight(events: DataFrame, hours: int = 12) -> DataFrame:
    """Requests that start work: those of a user within ``hours`` of the last that did are answered by it."""

    def advance(last, row):
        at = row.ts.value // 1000
        if last[0] is not None and at - last[0] <= hours * 3_600_000_000:
            return last, None
        return (at,), (row.event_id,)

    return keyed(events, (None,), advance, "event_id long", "last long")


def failing(kind: str) -> bool:
    return kind in ("error", "click")


def breaker(events: DataFrame, failures: int = 5, cooldown_hours: int = 48) -> DataFrame:
    """When each user's circuit opens: at the ``failures``-th failure in a row. While it is open calls are refused and change nothing; the first call after the
    cooldown is a probe, which closes the circuit or opens it again."""

    def advance(state, row):
        run, until = state
        at = row.ts.value // 1000
        if at < until:
            return state, None
        if not failing(row.event_type):
            return (0, 0), None
        if run + 1 < failures:
            return (run + 1, 0), None
        return (run + 1, at + cooldown_hours * 3_600_000_000), (row.ts, run >= failures)

    return keyed(events, (0, 0), advance, "opened timestamp_ntz, reopened boolean", "run int, until long")


def job_states(events: DataFrame, attempts: int = 3) -> DataFrame:
    """A job for each user: a view enqueues it, a click claims it, an error fails the claim (back to waiting until ``attempts`` are used up), a purchase completes it. Emits how jobs end."""

    def advance(job, row):
        state, tried = job
        kind = row.event_type
        if kind == "view" and state == "none":
            return ("waiting", 0), None
        if kind == "click" and state == "waiting":
            return ("running", tried + 1), None
        if kind == "purchase" and state == "running":
            return ("none", 0), (row.ts, "done", tried)
        if kind == "error" and state == "running":
            return (("none", 0), (row.ts, "failed", tried)) if tried >= attempts else (("waiting", tried), None)
        return job, None

    return keyed(events, ("none", 0), advance, "ended timestamp_ntz, outcome string, attempts int", "state string, tried int")


#: How late rows may come for the ordered streams; rows that are newer than this before the last one still wait when the stream ends.
ORDERED_DELAY = "1 day"


def job_leases(events: DataFrame) -> DataFrame:
    """How the job of each user ends: done, failed after three attempts, or expired, its lease having run out on the third. Views enqueue (or defer, if they are worth 50 or more while it runs), clicks
    claim for twelve hours, signups renew, purchases complete, errors fail, with an hour before the next attempt."""
    kind = F.col("event_type")
    what = F.when((kind == "view") & (F.col("value") >= 50), "defer").when(kind == "view", "enqueue").when(kind == "click", "claim").when(kind == "signup", "renew").when(kind == "purchase", "complete").otherwise("fail")
    rows = events.select("user_id", "event_id", "at", F.unix_micros("at").alias("us"), what.alias("what"))
    ends = ordered.in_order(rows, "user_id", ordered.Jobs(("user_id", "ended", "outcome", "attempts")), "user_id long, ended long, outcome string, attempts int", ORDERED_DELAY)
    return ends.withColumn("ended", F.timestamp_micros("ended").cast("timestamp_ntz"))


def trend_index(events: DataFrame) -> DataFrame:
    """Each time that a term (user) was on the lists: an event is a place on one, by its property k. What has not been shown for 24 hours leaves; the last 48 hours before the last place count."""
    rows = events.select("user_id", "event_id", "at", F.unix_micros("at").alias("us"), (F.get_json_object("props", "$.k").cast("int") + 1).alias("place")).filter("place IS NOT NULL")
    names = ("user_id", "since", "last", "times", "best", "first_place", "last_place", "direction")
    schema = "user_id long, since long, last long, times int, best int, first_place int, last_place int, direction string"
    found = ordered.in_order(rows, "user_id", ordered.Listed(names), schema, ORDERED_DELAY)
    return found.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("since", "last")})


def _register(name, stream, mode, sql):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return drain(stream(read_events(spark, sf_dir)), mode)

    run.__name__, run.__doc__ = name, stream.__doc__
    pack.queries[name] = run
    pack.sql[name] = sql


_register("stream_hourly_usage", hourly_usage, "complete", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n_items, max(value) AS peak FROM events GROUP BY ALL")
_register(
    "stream_waves", waves, "complete",
    """SELECT until, event_type, count(*) AS n_items FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')::TIMESTAMP + INTERVAL 6 HOUR,
    time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')::TIMESTAMP + INTERVAL 24 HOUR, INTERVAL 6 HOUR)) AS until, event_type FROM events) GROUP BY ALL""",
)
_register("stream_dedupe", single_flight, "append", "SELECT DISTINCT user_id, event_type FROM events")
#: Rows of each user numbered in order of time, for the twins that follow them one by one.
_ORDERED = "e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"

_register(
    "stream_reuse_flight", reuse_flight, "append",
    f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, n, event_id, ts AS last, true AS starts FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.ts - r.last <= INTERVAL 12 HOUR THEN r.last ELSE e.ts END, NOT (e.ts - r.last <= INTERVAL 12 HOUR) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, event_id FROM r WHERE starts""",
)
_register(
    "stream_breaker", breaker, "append",
    f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT *, event_type IN ('error', 'click') AS bad FROM e),
    r AS (SELECT user_id, n, ts, CASE WHEN bad THEN 1 ELSE 0 END AS run, TIMESTAMP '1970-01-01' AS until, false AS opens, false AS reopened FROM f WHERE n = 1
      UNION ALL SELECT f.user_id, f.n, f.ts, CASE WHEN f.ts < r.until THEN r.run WHEN NOT f.bad THEN 0 ELSE r.run + 1 END,
        CASE WHEN f.ts < r.until THEN r.until WHEN f.bad AND r.run + 1 >= 5 THEN f.ts + INTERVAL 48 HOUR ELSE TIMESTAMP '1970-01-01' END, f.ts >= r.until AND f.bad AND r.run + 1 >= 5, f.ts >= r.until AND f.bad AND r.run >= 5
      FROM r JOIN f ON f.user_id = r.user_id AND f.n = r.n + 1)
    SELECT user_id, ts AS opened, reopened FROM r WHERE opens""",
)
_register(
    "stream_job_states", job_states, "append",
    f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, n, ts, CASE WHEN event_type = 'view' THEN 'waiting' ELSE 'none' END AS state, 0 AS tried, NULL::VARCHAR AS outcome, 0 AS used FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.ts,
        CASE WHEN event_type = 'view' AND state = 'none' THEN 'waiting' WHEN event_type = 'click' AND state = 'waiting' THEN 'running' WHEN event_type = 'purchase' AND state = 'running' THEN 'none'
          WHEN event_type = 'error' AND state = 'running' THEN CASE WHEN tried >= 3 THEN 'none' ELSE 'waiting' END ELSE state END,
        CASE WHEN event_type = 'view' AND state = 'none' THEN 0 WHEN event_type = 'click' AND state = 'waiting' THEN tried + 1 WHEN state = 'running' AND (event_type = 'purchase' OR (event_type = 'error' AND tried >= 3)) THEN 0 ELSE tried END,
        CASE WHEN state = 'running' AND event_type = 'purchase' THEN 'done' WHEN state = 'running' AND event_type = 'error' AND tried >= 3 THEN 'failed' END, tried
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, ts AS ended, outcome, used AS attempts FROM r WHERE outcome IS NOT NULL""",
)

#: Rows that the watermark has passed at the end: all but those of the last day, to the millisecond.
_PASSED = "p AS (SELECT *, (SELECT make_timestamp((epoch_us(max(ts)) // 1000 - 86400000) * 1000) FROM events) AS mark FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM p WHERE ts <= mark)"

_register(
    "stream_job_leases", job_leases, "append",
    f"""WITH RECURSIVE {_PASSED}, w AS (SELECT user_id, n, ts, mark, CASE WHEN event_type = 'view' AND value >= 50 THEN 'defer' WHEN event_type = 'view' THEN 'enqueue' WHEN event_type = 'click' THEN 'claim' WHEN event_type = 'signup' THEN 'renew' WHEN event_type = 'purchase' THEN 'complete' ELSE 'fail' END AS what FROM o),
    r AS (SELECT user_id, n, mark, ts, CASE WHEN what = 'enqueue' THEN 'waiting' ELSE 'none' END AS state, ts AS until, 0 AS tried, NULL::TIMESTAMP AS gone, 0 AS gone_tried, NULL::VARCHAR AS outcome, 0 AS used FROM w WHERE n = 1
      UNION ALL SELECT user_id, n, mark, ts,
        CASE WHEN s = 'none' THEN CASE WHEN what = 'enqueue' THEN 'waiting' ELSE 'none' END WHEN s = 'waiting' THEN CASE WHEN what = 'claim' AND ts >= u THEN 'running' ELSE 'waiting' END
          WHEN what = 'complete' OR (what = 'fail' AND t >= 3) THEN 'none' WHEN what IN ('defer', 'fail') THEN 'waiting' ELSE 'running' END,
        CASE WHEN s = 'none' THEN ts WHEN s = 'waiting' THEN CASE WHEN what = 'claim' AND ts >= u THEN ts + INTERVAL 12 HOUR ELSE u END
          WHEN what = 'renew' THEN ts + INTERVAL 12 HOUR WHEN what = 'defer' THEN ts + INTERVAL 2 HOUR WHEN what = 'fail' THEN ts + INTERVAL 1 HOUR ELSE u END,
        CASE WHEN s = 'none' THEN 0 WHEN s = 'waiting' THEN CASE WHEN what = 'claim' AND ts >= u THEN t + 1 ELSE t END WHEN what = 'defer' THEN greatest(0, t - 1) WHEN what = 'complete' OR (what = 'fail' AND t >= 3) THEN 0 ELSE t END,
        gone, gone_tried, CASE WHEN s = 'running' AND what = 'complete' THEN 'done' WHEN s = 'running' AND what = 'fail' AND t >= 3 THEN 'failed' END, t
      FROM (SELECT w.user_id, w.n, w.mark, w.ts, w.what, out_ AND tried >= 3 AS lost, CASE WHEN out_ THEN CASE WHEN tried >= 3 THEN 'none' ELSE 'waiting' END ELSE state END AS s, until AS u,
          CASE WHEN out_ AND tried >= 3 THEN 0 ELSE tried END AS t, CASE WHEN out_ AND tried >= 3 THEN until END AS gone, tried AS gone_tried
        FROM (SELECT *, state = 'running' AND until <= next_ts AS out_ FROM (SELECT r.*, x.ts AS next_ts FROM r JOIN w x ON x.user_id = r.user_id AND x.n = r.n + 1)) q JOIN w ON w.user_id = q.user_id AND w.n = q.n + 1)),
    z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
    SELECT user_id, ts AS ended, outcome, used AS attempts FROM r WHERE outcome IS NOT NULL UNION ALL SELECT user_id, gone, 'expired', gone_tried FROM r WHERE gone IS NOT NULL
    UNION ALL SELECT user_id, until, 'expired', tried FROM z WHERE state = 'running' AND until <= mark AND tried >= 3""",
)
_register(
    "stream_trend_index", trend_index, "append",
    f"""WITH {_PASSED}, g AS (SELECT user_id, event_id, ts, mark, (props->>'k')::INT + 1 AS place, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM o WHERE props->>'k' IS NOT NULL),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stay FROM g), m AS (SELECT *, min(ts) OVER k AS since, max(ts) OVER k AS last FROM s WINDOW k AS (PARTITION BY user_id, stay)),
    a AS (SELECT user_id, stay, any_value(since) AS since, any_value(last) AS last, count(*)::INT AS times, min(place) AS best, arg_min(place, (ts, event_id)) AS first_place, arg_max(place, (ts, event_id)) AS last_place
      FROM m WHERE ts > last - INTERVAL 48 HOUR AND last + INTERVAL 24 HOUR <= mark GROUP BY user_id, stay)
    SELECT user_id, since, last, times, best, first_place, last_place, CASE WHEN last_place >= best + 10 THEN 'falling' WHEN last_place < first_place THEN 'rising' ELSE 'steady' END AS direction FROM a""",
)
