"""Histories by key: latest rows, copy ranks, waves, lineage, retention and merges of batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators import trailing
from loomwright.operators.earliest import earliest
from loomwright.operators.history import running_median
from loomwright.operators.trailing import SECOND, micros
from loomwright.plans.monitoring import D, latest, now, within
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

@pack.query("events", sql="SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(events: DataFrame) -> DataFrame:
    """The newest row of each user."""
    return latest(events, ["user_id"], F.desc("event_id")).select("user_id", "event_id", "event_type", "ts")


@pack.query(
    "events",
    sql="""
    WITH newest AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)
    SELECT user_id, max(event_id) AS event_id FROM newest WHERE event_type = 'purchase' GROUP BY user_id""",
)
def latest_among_newest5(events: DataFrame) -> DataFrame:
    """The newest purchase among each user's five newest rows."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    newest = events.withColumn("n", F.row_number().over(w)).filter("n <= 5")
    return newest.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@pack.query(
    "events",
    sql=f"SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) > 3 AND ts < {D} - INTERVAL 7 DAY",
)
def retention_keep3(events: DataFrame) -> DataFrame:
    """Rows to delete: beyond the newest three of their key and over a week old."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("event_id"))
    return events.withColumn("n", F.row_number().over(w)).filter((F.col("n") > 3) & ~within(168)).select("event_id", "user_id", "event_type")


@pack.query(
    "events",
    sql="""
    SELECT event_type, count(*) AS superseded FROM events e
    WHERE EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = e.event_type AND n.event_id > e.event_id) GROUP BY event_type""",
)
def keep_newest_each_depth(events: DataFrame) -> DataFrame:
    """How many rows a newer one of their key replaces."""
    newest = F.max("event_id").over(Window.partitionBy("user_id", "event_type"))
    return events.withColumn("newest", newest).filter("event_id < newest").groupBy("event_type").agg(F.count("*").alias("superseded"))


@pack.query(
    "part", "lineitem",
    sql="SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-06-01' AND l_returnflag = 'R')",
)
def orphan_sweep(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Parts that no recent returned line refers to."""
    used = lineitem.filter("l_shipdate >= TIMESTAMP_NTZ '2001-06-01' AND l_returnflag = 'R'")
    return part.join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@pack.query(
    "orders",
    sql="""
    WITH past AS (SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'),
    batch AS (SELECT max(o_orderdate) AS last FROM (SELECT o_orderdate FROM past ORDER BY o_orderdate LIMIT 500))
    SELECT o_orderkey, o_orderdate FROM past WHERE o_orderdate <= (SELECT last FROM batch)""",
)
def cursor_batch(orders: DataFrame) -> DataFrame:
    """The next batch past a cursor: up to the time of the 500th row, ties included."""
    past = orders.filter("o_orderdate > TIMESTAMP_NTZ '1997-01-01'")
    last = past.select("o_orderdate").orderBy("o_orderdate").limit(500).agg(F.max("o_orderdate").alias("last"))
    return past.join(F.broadcast(last), F.col("o_orderdate") <= F.col("last")).select("o_orderkey", "o_orderdate")


@pack.query(
    "orders",
    sql="""
    SELECT o_orderkey, json_object('status', o_orderstatus, 'caveats', concat_ws('; ', CASE WHEN o_totalprice > 400000 THEN 'large' END, 'condensed'))::VARCHAR AS doc FROM orders""",
)
def condense_json(orders: DataFrame) -> DataFrame:
    """A stored document without its bulky keys and with a caveat added."""
    full = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.when(F.col("o_totalprice") > 400000, "large").alias("caveats")))
    kept = F.from_json(full, "status string, caveats string")
    out = F.struct(kept["status"].alias("status"), F.concat_ws("; ", kept["caveats"], F.lit("condensed")).alias("caveats"))
    return orders.select("o_orderkey", F.to_json(out).alias("doc"))


@pack.query(
    "events",
    sql=f"""
    WITH stored AS (SELECT user_id, count(*) AS v FROM events WHERE ts < {D} - INTERVAL 2 DAY GROUP BY 1)
    SELECT e.event_id, e.user_id, (coalesce(v, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id))::BIGINT AS version
    FROM events e LEFT JOIN stored USING (user_id) WHERE ts >= {D} - INTERVAL 2 DAY""",
)
def versioned_append(events: DataFrame) -> DataFrame:
    """Version numbers of new rows: on from the highest stored version of their key."""
    stored = events.filter(~within(48)).groupBy("user_id").agg(F.count("*").alias("v"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    new = events.filter(within(48)).withColumn("n", order)
    return new.join(stored, "user_id", "left").select("event_id", "user_id", (F.coalesce("v", F.lit(0)) + F.col("n")).cast("long").alias("version"))


@pack.query(
    "events",
    sql=f"""
    SELECT user_id, value, event_type FROM (
      SELECT user_id, value, event_type, event_id, 0 AS batch FROM events WHERE ts < {D} - INTERVAL 2 DAY UNION ALL
      SELECT user_id, value + 1000, event_type, event_id, 1 FROM events WHERE ts >= {D} - INTERVAL 2 DAY)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, event_id DESC) = 1""",
)
def upsert_latest(events: DataFrame) -> DataFrame:
    """Upsert, last write wins: rows of the new batch replace stored ones of the same key."""
    old = events.filter(~within(48)).withColumn("batch", F.lit(0))
    new = events.filter(within(48)).withColumn("value", F.col("value") + 1000).withColumn("batch", F.lit(1))
    return latest(old.unionByName(new), ["user_id"], F.desc("batch"), F.desc("event_id")).select("user_id", "value", "event_type")


@pack.query(
    "events",
    sql="""
    SELECT ts::DATE::VARCHAR AS day, count(*) AS n_items, sum(event_id)::BIGINT AS ids FROM (
      SELECT * FROM events WHERE ts::DATE != DATE '2024-01-15' UNION ALL SELECT * FROM events WHERE ts::DATE = DATE '2024-01-15' AND value > 20) GROUP BY 1""",
)
def replace_partition(events: DataFrame) -> DataFrame:
    """One day replaced by a new batch, all other days as stored."""
    day = F.to_date("ts")
    batch = events.withColumn("day", day).filter("day = DATE '2024-01-15' AND value > 20")
    stored = events.withColumn("day", day).join(F.broadcast(batch.select("day").distinct()), "day", "left_anti")
    rows = stored.unionByName(batch)
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n_items"), F.sum("event_id").alias("ids"))


@pack.query(
    "events",
    sql="""
    SELECT event_id,
      1 + count(*) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS rank,
      count(*) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR FOLLOWING) AS of_all
    FROM events""",
)
def copy_rank(events: DataFrame) -> DataFrame:
    """Place among the rows of the same key within a day either way; rows of the same time count as later."""
    keys, day = ["event_type", "user_id"], 86_400
    dealt = trailing.sliced(events.select("event_id", "ts", *keys), "ts", day, day)
    before, around = trailing.window(keys, day, -1), trailing.window(keys, day, day * SECOND)
    return trailing.own(dealt.withColumns({"rank": F.count("*").over(before) + 1, "of_all": F.count("*").over(around)})).select("event_id", "rank", "of_all")


@pack.query(
    "events",
    sql="SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND CURRENT ROW) AS n_{h}h" for h in (1, 6, 24)) + " FROM events",
)
def siblings(events: DataFrame) -> DataFrame:
    """Rows of the same key in the last 1, 6 and 24 hours, the row itself included; rows without a time are together."""
    rows, hours = events.select("event_id", "event_type", "ts"), (1, 6, 24)
    dealt = trailing.sliced(rows.filter("ts IS NOT NULL"), "ts", 86_400)
    timed = trailing.own(dealt.withColumns({f"n_{h}h": trailing.count(["event_type"], h * 3600) for h in hours}))
    untimed = rows.filter("ts IS NULL")
    together = untimed.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    untimed = untimed.join(together, F.col("event_type").eqNullSafe(F.col("key"))).select("event_id", *[F.col("n").alias(f"n_{h}h") for h in hours])
    return timed.select("event_id", *[f"n_{h}h" for h in hours]).unionByName(untimed)


@pack.query(
    "events",
    sql="""
    WITH e AS (SELECT event_id, user_id, ts, value::BIGINT * 7919 + (value * 100)::BIGINT AS amount FROM events)
    SELECT a.event_id AS item, count(DISTINCT b.event_id) AS namesakes FROM e a JOIN e b
      ON a.event_id != b.event_id AND (a.user_id = b.user_id OR a.amount = b.amount) AND b.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts
    GROUP BY 1""",
)
def namesakes(events: DataFrame) -> DataFrame:
    """Other rows of the last day with the same user or the same amount: counted by each and by both, so no pairs are made."""
    amount = F.round("value").cast("long") * 7919 + F.round(F.col("value") * 100).cast("long")
    dealt = trailing.sliced(events.select(F.col("event_id").alias("item"), "user_id", "ts", amount.alias("amount")), "ts", 86_400)
    same = lambda *keys: F.count("*").over(trailing.window(list(keys), 86_400))
    counted = dealt.withColumn("namesakes", same("user_id") + same("amount") - same("user_id", "amount") - 1)
    return trailing.own(counted).filter("namesakes > 0").select("item", "namesakes")


@pack.query(
    "events",
    sql="""
    SELECT event_id, count(*) OVER k - 1 AS others, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS place, min(ts) OVER k AS first_seen
    FROM events WINDOW k AS (PARTITION BY user_id, event_type)""",
)
def link_reuse(events: DataFrame) -> DataFrame:
    """How many others share a key, the place among them, and when it was first seen."""
    # Counted by day first: a key's days are few rows, and its rows are ordered inside a day only.
    keys = ["user_id", "event_type"]
    rows = events.select("event_id", "ts", *keys, F.to_date("ts").alias("day"))
    days = rows.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.min("ts").alias("least"))
    k = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(k.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(*keys, "day", before.alias("before"), F.sum("n").over(k).alias("total"), F.min("least").over(k).alias("first_seen"))
    ranked = rows.withColumn("inside", F.rank().over(Window.partitionBy(*keys, "day").orderBy("ts"))).join(days, [*keys, "day"])
    return ranked.select("event_id", (F.col("total") - 1).alias("others"), (F.col("before") + F.col("inside")).cast("long").alias("place"), "first_seen")


@pack.query(
    "events",
    sql=f"SELECT event_type, {', '.join(f'count(*) FILTER (WHERE ts >= {D} - INTERVAL {h} HOUR) AS n_{h}h' for h in (1, 6, 24))}, count(*) FILTER (WHERE ts < {D} - INTERVAL 24 HOUR) AS before, min(ts) AS first_seen FROM events GROUP BY 1",
)
def referent_wave(events: DataFrame) -> DataFrame:
    """Counts over trailing windows, how many came before, and the first time."""
    return events.groupBy("event_type").agg(*[F.count_if(within(h)).alias(f"n_{h}h") for h in (1, 6, 24)], F.count_if(~within(24)).alias("before"), F.min("ts").alias("first_seen"))


@pack.query(
    "events",
    sql=f"""
    WITH t AS (SELECT ts, unnest([event_type, event_type || '/' || (user_id % 3), CASE WHEN value > 100 THEN 'heavy' END]) AS tag FROM events)
    SELECT tag, count(*) FILTER (WHERE ts >= {D} - INTERVAL 1 HOUR) AS n_1h, count(*) FILTER (WHERE ts >= {D} - INTERVAL 24 HOUR) AS n_24h, count(*) AS n_all
    FROM t WHERE tag IS NOT NULL GROUP BY tag""",
)
def category_waves(events: DataFrame) -> DataFrame:
    """Counts of each tag of the rows' tag lists over trailing windows."""
    tags = F.array_compact(F.array("event_type", F.concat_ws("/", "event_type", (F.col("user_id") % 3).cast("string")), F.when(F.col("value") > 100, "heavy")))
    rows = events.select("ts", F.explode(tags).alias("tag"))
    return rows.groupBy("tag").agg(F.count_if(within(1)).alias("n_1h"), F.count_if(within(24)).alias("n_24h"), F.count("*").alias("n_all"))


@pack.query(
    "events",
    sql="""
    WITH e AS (
      SELECT *, first_value(event_id) OVER w AS original, first_value(ts) OVER w AS original_ts,
        1 + count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS rank
      FROM events
      WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 720 HOUR PRECEDING AND INTERVAL 301 SECOND PRECEDING))
    SELECT event_id, original, rank, CASE WHEN original IS NULL THEN 'original' WHEN rank >= 11 OR ts - original_ts > INTERVAL 24 HOUR THEN 'late_copy'
      WHEN rank <= 3 AND ts - original_ts < INTERVAL 6 HOUR THEN 'early_copy' ELSE 'copy' END AS kind FROM e""",
)
def lineage_kind(events: DataFrame) -> DataFrame:
    """Each row's original (the earliest of its key in 30 days that is over 300 seconds older) and what kind of copy it is."""
    keys = ["user_id", "event_type"]
    grp = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    first = earliest(events.select(F.col("event_id").alias("id"), micros("ts").alias("at"), grp.alias("grp")), 30).select(F.col("id").alias("event_id"), "first")
    dealt = trailing.sliced(events.select("event_id", "ts", *keys), "ts", 86_400)
    ranks = trailing.own(dealt.withColumn("rank", F.count("*").over(trailing.window(keys, 86_400, -1)) + 1)).select("event_id", "ts", "rank")
    e = ranks.join(first, "event_id")
    gap = micros("ts") - F.col("first.at")
    old = gap >= 301 * SECOND
    e = e.select("event_id", "rank", F.when(old, -F.col("first.other")).alias("original"), F.when(old, gap).alias("age"))
    age = F.col("age")
    kind = (
        F.when(F.col("original").isNull(), "original")
        .when((F.col("rank") >= 11) | (age > 86_400 * SECOND), "late_copy")
        .when((F.col("rank") <= 3) & (age < 6 * 3600 * SECOND), "early_copy")
        .otherwise("copy")
    )
    return e.select("event_id", "original", "rank", kind.alias("kind"))


@pack.query(
    "events",
    sql="""
    SELECT user_id, count(DISTINCT ts::DATE) AS days FROM events WHERE event_type = 'purchase'
      AND ts::DATE >= DATE '2024-01-30' - 30 AND ts::DATE < DATE '2024-01-30' GROUP BY user_id""",
)
def days_listed(events: DataFrame) -> DataFrame:
    """Distinct days in the thirty before yesterday."""
    day = F.to_date("ts")
    yesterday = F.lit("2024-01-30").cast("date")
    rows = events.filter((F.col("event_type") == "purchase") & (day >= F.date_sub(yesterday, 30)) & (day < yesterday))
    return rows.groupBy("user_id").agg(F.count_distinct(day).alias("days"))


@pack.query(
    "events",
    sql=f"""
    SELECT user_id, event_type, round(value, 4) AS spike FROM (
      SELECT * FROM events WHERE ts >= {D} - INTERVAL 72 HOUR QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) = 1)
    WHERE value > 20 ORDER BY value DESC NULLS LAST, user_id LIMIT 50""",
)
def trend_best_recent(events: DataFrame) -> DataFrame:
    """The best recent row of each term, the highest first."""
    best = latest(events.filter(within(72)), ["user_id"], F.col("value").desc_nulls_last(), F.col("event_id"))
    return best.filter("value > 20").orderBy(F.col("value").desc_nulls_last(), "user_id").limit(50).select("user_id", "event_type", F.round("value", 4).alias("spike"))


@pack.query(
    "events",
    sql=f"""
    WITH h AS (SELECT hour, user_id, row_number() OVER (PARTITION BY hour ORDER BY v DESC, user_id) AS place
      FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, user_id, max(value) AS v FROM events WHERE ts >= {D} - INTERVAL 72 HOUR GROUP BY 1, 2)),
    m AS (SELECT user_id, min(place) AS best, count(*) AS hours, arg_min(place, hour) AS first_place, arg_max(place, hour) AS last_place, max(hour) AS last_hour FROM h GROUP BY 1)
    SELECT user_id, best, hours, first_place, last_place, CASE WHEN last_hour < {D} - INTERVAL 10 HOUR OR last_place >= best + 10 THEN 'falling' WHEN last_place < first_place THEN 'rising' ELSE 'steady' END AS direction FROM m""",
)
def list_merge(events: DataFrame) -> DataFrame:
    """Hourly ranked lists merged: best, first and last place of each entry and where it is going."""
    hourly = events.filter(within(72)).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "user_id").agg(F.max("value").alias("v"))
    # A list is ranked in bands of value, so that no hour is ordered in one task.
    hourly = hourly.withColumn("band", F.floor("v"))
    bands = hourly.groupBy("hour", "band").agg(F.count("*").alias("n"))
    above = Window.partitionBy("hour").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("hour", "band", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    inside = F.row_number().over(Window.partitionBy("hour", "band").orderBy(F.desc("v"), "user_id"))
    ranked = hourly.withColumn("inside", inside).join(bands, ["hour", "band"]).withColumn("place", (F.col("above") + F.col("inside")).cast("long"))
    merged = ranked.groupBy("user_id").agg(
        F.min("place").alias("best"), F.count("*").alias("hours"), F.min_by("place", "hour").alias("first_place"), F.max_by("place", "hour").alias("last_place"), F.max("hour").alias("last_hour")
    )
    falling = (F.col("last_hour") < now() - F.expr("INTERVAL 10 HOURS")) | (F.col("last_place") >= F.col("best") + 10)
    direction = F.when(falling, "falling").when(F.col("last_place") < F.col("first_place"), "rising").otherwise("steady")
    return merged.select("user_id", "best", "hours", "first_place", "last_place", direction.alias("direction"))


@pack.query(
    "events",
    sql="""
    WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL)
    SELECT a.event_type, round(a.v, 4) AS today, round(median(b.v), 4) AS usual, round(a.v / greatest(median(b.v), 50), 4) AS spike
    FROM d a JOIN d b ON a.event_type = b.event_type AND b.day < a.day WHERE a.day = DATE '2024-01-30' GROUP BY a.event_type, a.v""",
)
def spike_ratio(events: DataFrame) -> DataFrame:
    """A day's total against the median of all days before, with a floor."""
    days = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    before = days.filter("day < DATE '2024-01-30'").groupBy("event_type").agg(F.median("v").alias("usual"))
    today = days.filter("day = DATE '2024-01-30'")
    return today.join(before, "event_type").select(
        "event_type", F.round("v", 4).alias("today"), F.round("usual", 4).alias("usual"), F.round(F.col("v") / F.greatest("usual", F.lit(50.0)), 4).alias("spike")
    )


@pack.query(
    "events",
    sql="""
    WITH d AS (SELECT user_id, ts::DATE AS day, sum(floor(value * 100)::BIGINT)::DOUBLE AS v FROM events WHERE ts IS NOT NULL GROUP BY ALL)
    SELECT user_id, day::VARCHAR AS day, v AS cents, count(v) OVER w AS n_before, median(v) OVER w AS usual, CASE WHEN median(v) OVER w IS NOT NULL THEN round(v / greatest(median(v) OVER w, 5000), 6) END AS spike
    FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def spike_history(events: DataFrame) -> DataFrame:
    """Every term's total on every day against the median of all its days before, with a floor; null on the first."""
    days = events.filter("ts IS NOT NULL").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))
    rows = running_median(days, "user_id", "day", "cents")
    spike = F.when(F.col("usual").isNotNull(), F.round(F.col("cents") / F.greatest("usual", F.lit(5000.0)), 6))
    return rows.select("user_id", F.col("day").cast("string").alias("day"), "cents", "n_before", "usual", spike.alias("spike"))


@pack.query(
    "events",
    sql="""
    SELECT user_id, round(sum(value), 4) AS volume, arg_max(event_type, value * 1000000 + event_id) AS leader, count(*) AS n_items
    FROM events WHERE value IS NOT NULL GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 25""",
)
def merge_top(events: DataFrame) -> DataFrame:
    """Volumes summed by key with the attribute of the busiest row; the top 25."""
    merged = events.filter("value IS NOT NULL").groupBy("user_id").agg(
        F.sum("value").alias("v"), F.max_by("event_type", F.col("value") * 1000000 + F.col("event_id")).alias("leader"), F.count("*").alias("n_items")
    )
    return merged.orderBy(F.desc("v"), "user_id").limit(25).select("user_id", F.round("v", 4).alias("volume"), "leader", "n_items")


@pack.query(
    "orders", "customer",
    sql="""
    SELECT c_mktsegment, count(*) AS n_items, round(sum(o_totalprice), 2) AS volume, max(o_totalprice) AS largest, arg_max(o_custkey, o_totalprice * 100000 + o_orderkey) AS leader,
      round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def story_heat(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Volume, largest item and leader of each story, and its share of all."""
    heat = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(
        F.count("*").alias("n_items"), F.sum("o_totalprice").alias("v"), F.max("o_totalprice").alias("largest"), F.max_by("o_custkey", F.col("o_totalprice") * 100000 + F.col("o_orderkey")).alias("leader")
    )
    total = F.sum("v").over(Window.partitionBy(F.lit(1)))  # over one row for each segment
    return heat.select("c_mktsegment", "n_items", F.round("v", 2).alias("volume"), "largest", "leader", F.round(F.col("v") / total, 6).alias("share"))


def unioned(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@pack.query(
    "events",
    sql="""
    SELECT user_id, min(first_seen) AS first_seen, coalesce(max(name) FILTER (WHERE source = 1), max(name) FILTER (WHERE source = 2)) AS name FROM (
      SELECT user_id, min(ts) AS first_seen, CASE WHEN user_id % 2 = 0 THEN 'a' || user_id END AS name, 1 AS source FROM events WHERE event_type = 'signup' GROUP BY user_id
      UNION ALL SELECT user_id, min(ts), 'b' || user_id, 2 FROM events WHERE event_type = 'view' GROUP BY user_id) GROUP BY user_id""",
)
def coalesce_upsert(events: DataFrame) -> DataFrame:
    """Upsert that keeps the first known value by source precedence and the earliest time."""

    def part(kind, name, source):
        rows = events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.min("ts").alias("first_seen"))
        return rows.select("user_id", "first_seen", name.alias("name"), F.lit(source).alias("source"))

    even = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("a"), F.col("user_id").cast("string")))
    rows = unioned([part("signup", even, 1), part("view", F.concat(F.lit("b"), F.col("user_id").cast("string")), 2)])
    return rows.groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("source"))).alias("name"))


@pack.query(
    "events",
    sql=f"""
    WITH new AS (SELECT DISTINCT user_id FROM events WHERE ts >= {D} - INTERVAL 120 HOUR), old AS (SELECT DISTINCT user_id FROM events WHERE ts < {D} - INTERVAL 120 HOUR),
    ok AS (SELECT (SELECT count(*) FROM new) >= 0.5 * (SELECT count(*) FROM old) AS complete)
    SELECT user_id, CASE WHEN (SELECT complete FROM ok) AND user_id NOT IN (SELECT user_id FROM new) THEN 'deleted' WHEN user_id IN (SELECT user_id FROM new) THEN 'refreshed' ELSE 'kept' END AS state FROM old
    UNION SELECT user_id, 'refreshed' FROM new""",
)
def guarded_refresh(events: DataFrame) -> DataFrame:
    """A bulk refresh that deletes what was not refreshed, but only if the new set is at least half the old one."""
    new = events.filter(within(120)).select("user_id").distinct().withColumn("new", F.lit(True))
    old = events.filter(~within(120)).select("user_id").distinct().withColumn("old", F.lit(True))
    both = old.join(new, "user_id", "full")
    sizes = both.agg((F.count("new") >= 0.5 * F.count("old")).alias("complete"))
    state = F.when(F.col("new"), "refreshed").when(F.col("complete"), "deleted").otherwise("kept")
    return both.crossJoin(F.broadcast(sizes)).select("user_id", state.alias("state"))  # one row of sizes
