"""Service monitoring: totals, percentiles, spines, unions and freshness over the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.plans.registry import AS_OF, Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

def now():
    """The fixed clock as a column."""
    return F.lit(AS_OF).cast("timestamp_ntz")


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


@pack.query(
    "events",
    sql=f"""
    WITH newest AS (
      SELECT user_id, event_type, value / 500 AS score,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n
      FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)
    SELECT event_type, count(*) AS n_items,
           count(*) FILTER (WHERE score >= 0.7) AS strong,
           count(*) FILTER (WHERE score >= 0.5 AND score < 0.7) AS middling,
           count(*) FILTER (WHERE score < 0.5) AS weak
    FROM newest WHERE n = 1 GROUP BY event_type""",
)
def recall_summary(events: DataFrame) -> DataFrame:
    """Latest version of each item in the last week, counted by score band."""
    recent = events.filter(F.col("ts") >= now() - F.expr("INTERVAL 7 DAYS"))
    score = F.col("value") / 500
    return (
        latest(recent, ["user_id", "event_type"], F.col("event_id").desc())
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n_items"),
            F.count_if(score >= 0.7).alias("strong"),
            F.count_if((score >= 0.5) & (score < 0.7)).alias("middling"),
            F.count_if(score < 0.5).alias("weak"),
        )
    )


D = f"TIMESTAMP '{AS_OF}'"


def within(hours: int):
    """Rows of the last ``hours`` before the fixed clock."""
    return F.col("ts") >= now() - F.expr(f"INTERVAL {hours} HOURS")


@pack.query(
    "events",
    sql=f"""
    SELECT event_type,
      count(*) FILTER (WHERE ts >= {D} - INTERVAL 1 HOUR) AS n_1h,
      count(*) FILTER (WHERE ts >= {D} - INTERVAL 24 HOUR) AS n_24h,
      count(*) FILTER (WHERE ts >= {D} - INTERVAL 168 HOUR) AS n_7d, count(*) AS n_all,
      round(coalesce(sum(value) FILTER (WHERE ts >= {D} - INTERVAL 24 HOUR), 0), 4) AS value_24h,
      round(coalesce(sum(value) FILTER (WHERE ts >= {D} - INTERVAL 168 HOUR), 0), 4) AS value_7d,
      round(sum(value), 4) AS value_all
    FROM events GROUP BY event_type""",
)
def windowed_totals(events: DataFrame) -> DataFrame:
    """Counts and sums over several trailing windows in one pass."""
    total = lambda h: F.round(F.coalesce(F.sum(F.when(within(h), F.col("value"))), F.lit(0.0)), 4)
    return events.groupBy("event_type").agg(
        *[F.count_if(within(h)).alias(name) for h, name in ((1, "n_1h"), (24, "n_24h"), (168, "n_7d"))],
        F.count("*").alias("n_all"),
        total(24).alias("value_24h"),
        total(168).alias("value_7d"),
        F.round(F.sum("value"), 4).alias("value_all"),
    )


@pack.query(
    "events",
    sql=f"""
    SELECT event_type, count(*) AS n_items, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95,
      round(max(value), 4) AS slowest, round(quantile_cont(value, 0.95) FILTER (WHERE ts >= {D} - INTERVAL 168 HOUR), 4) AS p95_7d
    FROM events GROUP BY event_type""",
)
def latency_by_depth(events: DataFrame) -> DataFrame:
    """Exact percentiles for each kind, overall and for the last week."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("n_items"),
        F.round(F.percentile("value", 0.5), 4).alias("p50"),
        F.round(F.percentile("value", 0.95), 4).alias("p95"),
        F.round(F.max("value"), 4).alias("slowest"),
        F.round(F.percentile(F.when(within(168), F.col("value")), 0.95), 4).alias("p95_7d"),
    )


@pack.query(
    "events",
    sql="""
    WITH m AS (SELECT event_type, user_id % 4 AS method, count(*) AS calls, sum(value) AS ms, max(value) AS worst,
                 count(*) FILTER (WHERE value > 100) AS errors FROM events GROUP BY ALL)
    SELECT event_type, sum(calls)::BIGINT AS calls, round(sum(ms), 4) AS ms, max(worst) AS worst,
      round(sum(errors)::DOUBLE / sum(calls)::DOUBLE, 6) AS error_rate,
      string_agg(method || '=' || calls, ',' ORDER BY method) AS methods
    FROM m GROUP BY event_type""",
)
def upstream_by_source(events: DataFrame) -> DataFrame:
    """Usage by source over usage by source and method, with the calls of each method."""
    methods = events.groupBy("event_type", (F.col("user_id") % 4).alias("method")).agg(
        F.count("*").alias("calls"), F.sum("value").alias("ms"), F.max("value").alias("worst"), F.count_if(F.col("value") > 100).alias("errors")
    )
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("method", "calls"))), lambda x: F.concat_ws("=", x["method"].cast("string"), x["calls"].cast("string"))), ",")
    return methods.groupBy("event_type").agg(
        F.sum("calls").alias("calls"), F.round(F.sum("ms"), 4).alias("ms"), F.max("worst").alias("worst"),
        F.round(F.sum("errors") / F.sum("calls"), 6).alias("error_rate"), listed.alias("methods"),
    )


def spine(df: DataFrame, first: str, last: str, step: str, name: str) -> DataFrame:
    """One row for each step between two fixed times."""
    times = F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}"))
    return df.sparkSession.range(1).select(F.explode(times).alias(name))


@pack.query(
    "events",
    sql="""
    SELECT g.hour, coalesce(n, 0)::BIGINT AS n_items, round(coalesce(total, 0), 4) AS total
    FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-29 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS hour) g
    LEFT JOIN (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, sum(value) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1) u USING (hour)""",
)
def calendar_spine_hour(events: DataFrame) -> DataFrame:
    """Every hour of two days, with zeros where nothing happened."""
    usage = events.filter("event_type = 'purchase'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    hours = spine(events, "2024-01-29 00:00:00", "2024-01-30 23:00:00", "1 HOUR", "hour")
    return hours.join(usage, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n_items"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@pack.query(
    "events",
    sql="""
    SELECT g.day::DATE::VARCHAR AS day, coalesce(n, 0)::BIGINT AS n_items, coalesce(users, 0)::BIGINT AS users
    FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS day) g
    LEFT JOIN (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1) u USING (day)""",
)
def calendar_spine_day(events: DataFrame) -> DataFrame:
    """Every day of a range, with zeros where nothing happened."""
    usage = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    days = spine(events, "2024-01-01", "2024-02-05", "1 DAY", "day").select(F.to_date("day").alias("day"))
    return days.join(usage, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("users", F.lit(0)).alias("users"))


@pack.query(
    "events",
    sql="""
    SELECT event_type, CASE WHEN value < 50 THEN 'short' ELSE 'long' END AS stage, count(*) AS n_items,
      round(quantile_cont((props->>'$.k')::INT, 0.5), 4) AS p50, round(quantile_cont((props->>'$.k')::INT, 0.95), 4) AS p95
    FROM events GROUP BY ALL""",
)
def stage_percentiles(events: DataFrame) -> DataFrame:
    """Percentiles of a number inside a JSON document, by stage."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.groupBy("event_type", F.when(F.col("value") < 50, "short").otherwise("long").alias("stage")).agg(
        F.count("*").alias("n_items"), F.round(F.percentile(k, 0.5), 4).alias("p50"), F.round(F.percentile(k, 0.95), 4).alias("p95")
    )


@pack.query(
    "events",
    sql="""
    SELECT event_type, count(*) AS n_items, arg_max(value, ts) AS newest_value, max(ts) AS newest, count(DISTINCT user_id) AS users
    FROM events WHERE value > 20 GROUP BY event_type ORDER BY n_items DESC, event_type LIMIT 20""",
)
def errors_top(events: DataFrame) -> DataFrame:
    """The most frequent kinds of slow rows with the newest example of each."""
    kinds = events.filter("value > 20").groupBy("event_type").agg(
        F.count("*").alias("n_items"), F.max_by("value", "ts").alias("newest_value"), F.max("ts").alias("newest"), F.count_distinct("user_id").alias("users")
    )
    return kinds.orderBy(F.desc("n_items"), "event_type").limit(20)


@pack.query(
    "orders", "lineitem",
    sql="""
    WITH days AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY)) AS day),
    parts AS (
      SELECT o_orderdate AS day, 1 AS created, 0 AS done, 0 AS failed FROM orders
      UNION ALL SELECT l_shipdate, 0, 1, 0 FROM lineitem WHERE l_linestatus = 'F'
      UNION ALL SELECT l_shipdate, 0, 0, 1 FROM lineitem WHERE l_returnflag = 'R')
    SELECT days.day::DATE::VARCHAR AS day, coalesce(sum(created), 0)::BIGINT AS created, coalesce(sum(done), 0)::BIGINT AS done, coalesce(sum(failed), 0)::BIGINT AS failed
    FROM days LEFT JOIN parts ON days.day = parts.day GROUP BY 1""",
)
def hourly_union(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Created, done and failed per day from three sources on one calendar."""
    one, none = F.lit(1), F.lit(0)

    def part(df, day, *flags):
        return df.select(F.to_date(day).alias("day"), *[f.alias(n) for f, n in zip(flags, ("created", "done", "failed"), strict=True)])

    rows = (
        part(orders, "o_orderdate", one, none, none)
        .unionByName(part(lineitem.filter("l_linestatus = 'F'"), "l_shipdate", none, one, none))
        .unionByName(part(lineitem.filter("l_returnflag = 'R'"), "l_shipdate", none, none, one))
    )
    usage = rows.groupBy("day").agg(*[F.sum(n).alias(n) for n in ("created", "done", "failed")])
    days = spine(orders, "1996-01-01", "1996-12-31", "1 DAY", "day").select(F.to_date("day").alias("day"))
    return days.join(usage, "day", "left").select(F.col("day").cast("string").alias("day"), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("created", "done", "failed")])


@pack.query(
    "events", "orders", "lineitem", "customer",
    sql="""
    SELECT (SELECT max(ts) FROM events) AS newest_event, (SELECT count(*) FROM events) AS n_events,
      (SELECT max(o_orderdate) FROM orders) AS newest_order, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders,
      (SELECT max(l_shipdate) FROM lineitem) AS newest_line, (SELECT count(*) FROM customer) AS n_customers""",
)
def freshness_row(events: DataFrame, orders: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """One row of freshness figures; each part is a one-row aggregate."""
    return (
        events.agg(F.max("ts").alias("newest_event"), F.count("*").alias("n_events"))
        .crossJoin(orders.agg(F.max("o_orderdate").alias("newest_order"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders")))
        .crossJoin(lineitem.agg(F.max("l_shipdate").alias("newest_line")))
        .crossJoin(customer.agg(F.count("*").alias("n_customers")))
    )


@pack.query("events", sql="SELECT user_id, count(*) AS n_items, max(ts) AS newest FROM events GROUP BY user_id ORDER BY n_items DESC, user_id LIMIT 20")
def top_requesters(events: DataFrame) -> DataFrame:
    """The twenty busiest users."""
    return events.groupBy("user_id").agg(F.count("*").alias("n_items"), F.max("ts").alias("newest")).orderBy(F.desc("n_items"), "user_id").limit(20)


@pack.query(
    "events",
    sql="""
    SELECT event_type, count(*) AS n_items, count(*) FILTER (WHERE value >= 100) AS heavy,
      count(*) FILTER (WHERE value >= 10 AND value < 100) AS middling, count(*) FILTER (WHERE value < 10) AS light
    FROM events GROUP BY event_type""",
)
def kind_counts(events: DataFrame) -> DataFrame:
    """Counts of each kind by class of value."""
    v = F.col("value")
    return events.groupBy("event_type").agg(
        F.count("*").alias("n_items"), F.count_if(v >= 100).alias("heavy"), F.count_if((v >= 10) & (v < 100)).alias("middling"), F.count_if(v < 10).alias("light")
    )


@pack.query(
    "events",
    sql="SELECT event_type, count(*) AS n_items, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days, count(*) FILTER (WHERE value > 50) AS above FROM events GROUP BY event_type",
)
def signals_by_depth(events: DataFrame) -> DataFrame:
    """Rows, distinct users and days, and rows above a value, by kind."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("n_items"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"), F.count_if(F.col("value") > 50).alias("above")
    )


@pack.query(
    "events",
    sql="""
    SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, sum(n)::BIGINT AS n_items, round(sum(total), 4) AS total, max(peak) AS peak FROM (
      SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, event_type, count(*) AS n, sum(value) AS total, max(value) AS peak FROM events WHERE event_id % 2 = 0 GROUP BY ALL
      UNION ALL SELECT date_trunc('hour', ts)::TIMESTAMP, event_type, count(*), sum(value), max(value) FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
    GROUP BY ALL""",
)
def usage_rollup_merge(events: DataFrame) -> DataFrame:
    """Two flushed batches of hourly counters merged: sums are added, peaks compared."""

    def batch(rest):
        rows = events.filter(F.col("event_id") % 2 == rest)
        return rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t"), F.max("value").alias("p"))

    return merge_counters(batch(0), batch(1))


def merge_counters(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Additive and extremal upsert of (hour, event_type, n, t, p)."""
    return stored.unionByName(batch).groupBy("hour", "event_type").agg(F.sum("n").alias("n_items"), F.round(F.sum("t"), 4).alias("total"), F.max("p").alias("peak"))


@pack.query(
    "events",
    sql="""
    SELECT event_id, user_id, used, used > 3 AS over_limit FROM (
      SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)""",
)
def quota_running(events: DataFrame) -> DataFrame:
    """Running use of a daily quota of three, by user and UTC day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    used = events.withColumn("used", F.count("*").over(w))
    return used.select("event_id", "user_id", "used", (F.col("used") > 3).alias("over_limit"))


@pack.query(
    "orders",
    sql="""
    WITH c AS (SELECT o_orderkey, CASE WHEN day(o_orderdate) >= 15 THEN make_date(year(o_orderdate), month(o_orderdate), 15)
        ELSE (make_date(year(o_orderdate), month(o_orderdate), 15) - INTERVAL 1 MONTH)::DATE END AS cycle_start FROM orders)
    SELECT cycle_start::VARCHAR AS cycle_start, (cycle_start + INTERVAL 1 MONTH)::DATE::VARCHAR AS cycle_end, count(*) AS n_items FROM c GROUP BY ALL""",
)
def billing_cycle(orders: DataFrame) -> DataFrame:
    """Orders by billing cycle, which begins on the 15th."""
    mid = F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(15))
    start = F.when(F.dayofmonth("o_orderdate") >= 15, mid).otherwise(F.add_months(mid, -1))
    return orders.groupBy(start.alias("cycle_start")).agg(F.count("*").alias("n_items")).select(F.col("cycle_start").cast("string").alias("cycle_start"), F.add_months("cycle_start", 1).cast("string").alias("cycle_end"), "n_items")


@pack.query(
    "orders",
    sql="""
    SELECT row_number() OVER (ORDER BY o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END DESC NULLS LAST, o_orderdate, o_orderkey) AS place, o_orderkey, o_orderpriority
    FROM orders WHERE o_orderstatus = 'O' ORDER BY place LIMIT 100""",
)
def claim_order(orders: DataFrame) -> DataFrame:
    """The next hundred open items: urgent first, of the lowest tier the newest first, of the others the oldest."""
    low = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate"))
    head = orders.filter("o_orderstatus = 'O'").orderBy("o_orderpriority", low.desc_nulls_last(), "o_orderdate", "o_orderkey").limit(100)
    w = Window.orderBy("o_orderpriority", low.desc_nulls_last(), "o_orderdate", "o_orderkey")  # over a hundred rows
    return head.select(F.row_number().over(w).cast("long").alias("place"), "o_orderkey", "o_orderpriority")


@pack.query(
    "orders", "lineitem",
    sql="""
    SELECT o_orderkey, o_orderdate FROM orders o WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O'
      AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= TIMESTAMP '1999-01-01')""",
)
def stale_anti(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Open low-priority items without recent activity."""
    recent = lineitem.filter("l_shipdate >= TIMESTAMP_NTZ '1999-01-01'")
    waiting = orders.filter("o_orderpriority = '5-LOW' AND o_orderstatus = 'O'")
    return waiting.join(recent, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderdate")


@pack.query(
    "orders",
    sql="""
    SELECT o_orderpriority, n_items, sum(n_items) OVER (ORDER BY o_orderpriority)::BIGINT AS ahead
    FROM (SELECT o_orderpriority, count(*) AS n_items FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)""",
)
def pending_by_priority(orders: DataFrame) -> DataFrame:
    """Open items of each priority and of all that are as urgent or more."""
    counts = orders.filter("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.count("*").alias("n_items"))
    return counts.withColumn("ahead", F.sum("n_items").over(Window.orderBy("o_orderpriority").rowsBetween(Window.unboundedPreceding, 0)))


def failure_runs(events: DataFrame, failed: Column) -> DataFrame:
    """user_id, began, ended and n_failed of every run of failures in a row, in order of (ts, event_id).

    Two levels: runs inside an hour, then those that touch its ends are joined over the hours. No task orders a whole key, only one of its hours or a list of its hours.
    """
    rows = events.select("user_id", "ts", "event_id", F.coalesce(failed, F.lit(False)).alias("failed")).withColumn("hour", F.date_trunc("hour", "ts"))
    inside = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id")
    rows = rows.withColumns({"place": F.row_number().over(inside), "upto": F.sum(F.col("failed").cast("int")).over(inside), "size": F.count("*").over(Window.partitionBy("user_id", "hour"))})
    hours = rows.groupBy("user_id", "hour").agg(F.max_by("failed", "place").alias("ends_failed"))
    before = F.lag("ends_failed", 1, False).over(Window.partitionBy("user_id").orderBy("hour"))
    hours = hours.select(F.col("user_id").alias("_user"), F.col("hour").alias("_hour"), before.alias("was_failed"))
    runs = rows.filter("failed").groupBy("user_id", "hour", (F.col("place") - F.col("upto")).alias("island")).agg(
        F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n_failed"), F.min("place").alias("first"), (F.max("place") == F.max("size")).alias("open")
    )
    runs = runs.join(hours, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("hour") == F.col("_hour"))).withColumn("goes_on", (F.col("first") == 1) & F.col("was_failed"))
    whole = runs.filter("NOT goes_on AND NOT open").select("user_id", "began", "ended", "n_failed")
    ends = runs.filter("goes_on OR open")
    chain = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(Window.partitionBy("user_id").orderBy("hour", "began"))
    joined = ends.withColumn("chain", chain).groupBy("user_id", "chain").agg(F.min("began").alias("began"), F.max("ended").alias("ended"), F.sum("n_failed").alias("n_failed"))
    return whole.unionByName(joined.drop("chain"))


@pack.query(
    "events",
    sql="""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts) AS island FROM events)
    SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n_failed FROM e WHERE event_type = 'error' GROUP BY user_id, island HAVING count(*) >= 3""",
)
def breaker_runs(events: DataFrame) -> DataFrame:
    """Runs of three or more failures in a row: when a circuit would have opened."""
    return failure_runs(events.filter("ts IS NOT NULL"), F.col("event_type") == "error").filter("n_failed >= 3")
