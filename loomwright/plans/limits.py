"""Request limits: what token buckets let through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.token_bucket import metered
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: Tokens of a bucket and the hours in which an empty one is full again; one token in exactly three hours.
CAPACITY, HOURS = 4, 12
_COST = HOURS * 3_600_000_000 // CAPACITY
_FULL = HOURS * 3_600_000_000


@pack.query(
    "events",
    sql=f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
    r AS (SELECT user_id, n, event_id, us, true AS allowed, {_FULL - _COST}::BIGINT AS lvl FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, event_id, us, lvl >= {_COST}, CASE WHEN lvl >= {_COST} THEN lvl - {_COST} ELSE lvl END
      FROM (SELECT e.user_id, e.n, e.event_id, e.us, least({_FULL}, r.lvl + e.us - r.us) AS lvl FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, event_id, allowed, lvl / {_COST}.0::DOUBLE AS tokens_left FROM r""",
)
def token_bucket_refill(events: DataFrame) -> DataFrame:
    """Each event as a request of its user: whether a bucket of four tokens, refilled in twelve hours, lets it through, and what it leaves."""
    requests = events.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"))
    return metered(requests, CAPACITY, HOURS * 3600).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "allowed", "tokens_left")
