"""Stored tables kept up by batches: last write wins, counters, first known values, and whole editions behind a guard.

Every query makes a table in the shared folder, merges two batches into it, brings one of them again, and returns the table. Batches are the earlier and the later half of
the driver's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.plans.registry import Pack
from loomwright.sources import scratch
from loomwright.sources import stored as S

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql


def _table(rows: DataFrame, name: str, keys: list[str], rules: dict) -> S.StoredTable:
    return S.StoredTable(rows.sparkSession, scratch.new_folder(rows.sparkSession, name), keys, rules, buckets=16)


@pack.query("events", sql="SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def stored_last_write(events: DataFrame) -> DataFrame:
    """Each user's last event: what comes later wins, whole rows at a time."""
    rows = events.select("user_id", "event_id", "event_type", "value", "ts")
    table = _table(rows, "last-write", ["user_id"], {c: S.newest for c in ("event_type", "value", "ts")})
    order, middle = F.struct("ts", "event_id"), F.lit("2024-01-16").cast("timestamp_ntz")
    for number, part in ((1, F.col("ts") < middle), (2, F.col("ts") >= middle), (2, F.col("ts") < middle)):
        table.merge(rows.filter(part), "events", number, order)
    return table.read()


@pack.query("events", sql="SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS calls, count_if(value > 50)::BIGINT AS slow, max(value) AS peak, min(ts) AS since FROM events GROUP BY ALL")
def stored_counters(events: DataFrame) -> DataFrame:
    """Hourly counters by kind: counts are added, peaks and first times are kept at their extremes. Batches are reduced to one row for each key first."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    table = _table(events, "counters", ["hour", "event_type"], {"calls": S.added, "slow": S.added, "peak": S.greatest, "since": S.least})
    for number, rest in ((1, 0), (2, 1), (1, 0), (2, 1)):
        batch = events.filter(F.col("event_id") % 2 == rest).groupBy(hour, "event_type")
        table.merge(batch.agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 50).alias("slow"), F.max("value").alias("peak"), F.min("ts").alias("since")), "meter", number)
    return table.read()


@pack.query(
    "orders",
    sql="""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus != 'P' THEN o_orderpriority END AS priority, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders)
    SELECT o_custkey, arg_min(priority, (o_orderdate, o_orderkey)) FILTER (WHERE priority IS NOT NULL) AS priority, arg_max(price, (o_orderdate, o_orderkey)) FILTER (WHERE price IS NOT NULL) AS price FROM o GROUP BY o_custkey""",
)
def stored_first_known(orders: DataFrame) -> DataFrame:
    """Values that are missing at times: one column keeps the first that was known, the other takes the last, and null replaces neither."""
    rows = orders.select(
        "o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice")).alias("price")
    )
    table = _table(rows, "first-known", ["o_custkey"], {"priority": S.first_known, "price": S.known})
    middle = rows.agg(F.percentile_approx("o_orderdate", 0.5)).first()[0]
    order, early = F.struct("o_orderdate", "o_orderkey"), F.col("o_orderdate") < F.lit(middle)
    for number, part in ((1, early), (2, ~early), (2, ~early)):
        table.merge(rows.filter(part), "orders", number, order)
    return table.read()


@pack.query("part", sql="SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END::INT AS p_size FROM part WHERE p_partkey % 3 != 0")
def stored_refresh(part: DataFrame) -> DataFrame:
    """Whole editions: the second lacks a third of the keys, which go; a third edition that is too small, and an incomplete one that brings changes, show what is kept."""
    rows = part.select("p_partkey", "p_name", "p_size")
    table = _table(rows, "refresh", ["p_partkey"], {"p_name": S.newest, "p_size": S.newest})
    table.refresh(rows, "edition", 1)
    table.refresh(rows.filter(F.col("p_partkey") % 3 != 0), "edition", 2)
    table.refresh(rows.filter(F.col("p_partkey") % 50 == 0), "edition", 3)  # too small: refused
    changed = rows.filter((F.col("p_partkey") % 3 != 0) & (F.col("p_partkey") % 2 == 0)).withColumn("p_size", (F.col("p_size") + 100).cast("int"))
    table.refresh(changed, "edition", 4, least_share=0.4, complete=False)
    return table.read()
