"""What many launches of a day have in common: a name launched again and again, a word that rises, and overlap with what is traded most.

Roles on the driver's tables: an event is a launch, its part gives name and brand, the event's value is its volume; launches of a third of the users name the mania of the last day. Launches
without a time or a part are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators import trailing
from loomwright.plans.registry import Pack
from loomwright.sources.scratch import written

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: Launches of a name in a day and of a word, its lift, and what a word counts for beside a name; weights of overlap with the most traded, and how many those are.
DAY, LEAST_NAME, LEAST_WORD, LEAST_LIFT, WORD_FACTOR = 86_400, 5, 5, 3.0, 0.8
SELF, SAME, SHARED, TOP = 0.5, 0.6, 0.45, 25
#: Words that say nothing of what a launch is about.
EVERYDAY = ("small", "large", "red", "blue", "old", "new", "hot", "cold")


def weight_of(n: Column, least: int) -> Column:
    """Grows with the logarithm of the count, up to a bound."""
    return F.least(F.lit(0.75), 0.35 + 0.1 * F.log2(n / float(least) + 1))


def launches(events: DataFrame, part: DataFrame) -> DataFrame:
    """id, ts, name, ticker, volume, recent (in the last day of all)."""
    last = part.agg(F.max("p_partkey").alias("last_part")).crossJoin(events.agg(F.max("ts").alias("end")))  # one row
    rows = events.filter("ts IS NOT NULL").crossJoin(F.broadcast(last)).withColumn("k", F.col("event_id") % (F.col("last_part") + 1))
    rows = rows.join(part.select("p_partkey", "p_name", "p_brand"), F.col("k") == F.col("p_partkey")).withColumn("recent", F.col("ts") > F.col("end") - F.expr("INTERVAL 24 HOURS"))
    brand = F.concat(F.lit("b"), F.regexp_replace("p_brand", "[^0-9]", ""))
    mania = F.when(F.col("recent") & (F.col("user_id") % 3 == 0), " mania").otherwise("")
    name = F.concat(F.lower("p_name"), F.lit(" "), brand, mania)
    ticker = F.upper(F.concat(F.left(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(2)), brand))
    return rows.select(F.col("event_id").alias("id"), "ts", name.alias("name"), ticker.alias("ticker"), F.floor(F.col("value") * 100).cast("long").alias("volume"), "recent")


def meta(rows: DataFrame) -> DataFrame:
    """id, launched, rule, word, weight, top_rule, top_place, top_weight: the launch count of the name, else the hottest word; and the first of the most traded that the launch is, names or shares a word with.

    Counts by word are combined before they meet; the most traded are ``TOP`` rows.
    """
    rows = written(rows, "meta-launches")
    dealt = trailing.sliced(rows.select("id", "ts", "name"), "ts", DAY, DAY)
    same = trailing.own(dealt.withColumn("launched", F.count("*").over(trailing.window(["name"], DAY, DAY * trailing.SECOND)))).select("id", "launched")
    words = rows.select("id", "recent", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).filter(~F.col("word").isin(*EVERYDAY))
    sizes = rows.agg(F.count_if("recent").alias("recent_all"), F.count_if(~F.col("recent")).alias("base_all"))  # one row
    counts = words.groupBy("word").agg(F.count_if("recent").alias("n"), F.count_if(~F.col("recent")).alias("base")).filter(F.col("n") >= LEAST_WORD)
    lift = (F.col("n") / F.greatest(F.lit(1), F.col("recent_all"))) / ((F.col("base") + 1) / (F.col("base_all") + 1))
    rising = counts.crossJoin(F.broadcast(sizes)).withColumn("lift", F.round(lift, 6)).filter(F.col("lift") >= LEAST_LIFT).select("word", "n", "lift")
    hot = words.join(rising, "word").groupBy("id").agg(F.min_by(F.struct("word", "n"), F.struct(-F.col("lift"), F.col("word"))).alias("hot"))
    volumes = rows.filter("recent").groupBy("name", "ticker").agg(F.sum("volume").alias("volume")).orderBy(F.desc("volume"), "name", "ticker").limit(TOP)
    listed = volumes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("volume"), "name", "ticker"))).agg(F.collect_list(F.struct("place", "name", "ticker")).alias("top"))  # TOP rows, one array
    mine = rows.crossJoin(F.broadcast(listed))
    own = F.filter(F.split("name", " "), lambda w: ~w.isin(*EVERYDAY))
    first = lambda fits: F.array_min(F.transform(F.filter("top", fits), lambda t: t["place"]))
    mine = mine.select("id", first(lambda t: (t["name"] == F.col("name")) & (t["ticker"] == F.col("ticker")) & F.col("recent")).alias("is_top"), first(lambda t: (t["name"] == F.col("name")) | (t["ticker"] == F.col("ticker"))).alias("same"), first(lambda t: F.arrays_overlap(F.split(t["name"], " "), own)).alias("shares"))
    found = rows.select("id", "name").join(same, "id").join(hot, "id", "left").join(mine, "id")
    by_name = F.col("launched") >= LEAST_NAME
    rule = F.when(by_name, "name").when(F.col("hot").isNotNull(), "word")
    weight = F.when(by_name, weight_of(F.col("launched"), LEAST_NAME)).when(F.col("hot").isNotNull(), WORD_FACTOR * weight_of(F.col("hot.n"), LEAST_WORD))
    top_rule = F.when(F.col("is_top").isNotNull(), "self").when(F.col("same").isNotNull(), "same").when(F.col("shares").isNotNull(), "word")
    top_weight = F.when(top_rule == "self", SELF).when(top_rule == "same", SAME).when(top_rule == "word", SHARED)
    return found.select(
        "id", "launched", rule.alias("rule"), F.when(rule == "word", F.col("hot.word")).alias("word"), F.round(weight, 6).alias("weight"),
        top_rule.alias("top_rule"), F.coalesce("is_top", "same", "shares").alias("top_place"), top_weight.alias("top_weight"),
    )


_QUIET = ", ".join(f"'{w}'" for w in EVERYDAY)


@pack.query(
    "events", "part",
    sql=f"""WITH la AS (SELECT event_id AS id, ts, ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS recent, user_id, floor(value * 100)::BIGINT AS volume, p_name, 'b' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand FROM events JOIN part ON p_partkey = event_id % (SELECT max(p_partkey) + 1 FROM part)),
    l AS (SELECT id, ts, recent, volume, lower(p_name) || ' ' || brand || CASE WHEN recent AND user_id % 3 = 0 THEN ' mania' ELSE '' END AS name, upper(left(split_part(p_name, ' ', 2), 2) || brand) AS ticker FROM la),
    o AS (SELECT a.id, count(*) AS launched FROM l a JOIN l b ON a.name = b.name AND b.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts + INTERVAL 24 HOUR GROUP BY a.id),
    w AS (SELECT * FROM (SELECT DISTINCT id, recent, unnest(string_split(name, ' ')) AS word FROM l) WHERE word NOT IN ({_QUIET})),
    c AS (SELECT word, count_if(recent) AS n, count_if(NOT recent) AS base FROM w GROUP BY word HAVING count_if(recent) >= {LEAST_WORD}),
    r AS (SELECT word, n, round((n / greatest(1, (SELECT count_if(recent) FROM l))::DOUBLE) / ((base + 1) / ((SELECT count_if(NOT recent) FROM l) + 1)::DOUBLE), 6) AS lift FROM c),
    h AS (SELECT id, word, n FROM w JOIN r USING (word) WHERE lift >= {LEAST_LIFT} QUALIFY row_number() OVER (PARTITION BY id ORDER BY lift DESC, word) = 1),
    t AS (SELECT name, ticker, row_number() OVER (ORDER BY sum(volume) DESC, name, ticker) AS place FROM l WHERE recent GROUP BY name, ticker ORDER BY place LIMIT {TOP}),
    p AS (SELECT l.id, min(place) FILTER (WHERE l.name = t.name AND l.ticker = t.ticker AND recent) AS is_top, min(place) FILTER (WHERE l.name = t.name OR l.ticker = t.ticker) AS same,
      min(place) FILTER (WHERE list_has_any(string_split(t.name, ' '), list_filter(string_split(l.name, ' '), lambda x: x NOT IN ({_QUIET})))) AS shares FROM l, t GROUP BY l.id)
    SELECT id AS event_id, launched, CASE WHEN launched >= {LEAST_NAME} THEN 'name' WHEN word IS NOT NULL THEN 'word' END AS rule, CASE WHEN launched < {LEAST_NAME} THEN word END AS word,
      round(CASE WHEN launched >= {LEAST_NAME} THEN least(0.75::DOUBLE, 0.35::DOUBLE + 0.1::DOUBLE * log2(launched / {LEAST_NAME}::DOUBLE + 1)) WHEN word IS NOT NULL THEN {WORD_FACTOR}::DOUBLE * least(0.75::DOUBLE, 0.35::DOUBLE + 0.1::DOUBLE * log2(n / {LEAST_WORD}::DOUBLE + 1)) END, 6) AS weight,
      CASE WHEN is_top IS NOT NULL THEN 'self' WHEN same IS NOT NULL THEN 'same' WHEN shares IS NOT NULL THEN 'word' END AS top_rule, coalesce(is_top, same, shares)::INT AS top_place,
      CASE WHEN is_top IS NOT NULL THEN {SELF} WHEN same IS NOT NULL THEN {SAME} WHEN shares IS NOT NULL THEN {SHARED} END::DOUBLE AS top_weight FROM o LEFT JOIN h USING (id) LEFT JOIN p USING (id)""",
)
def launch_meta(events: DataFrame, part: DataFrame) -> DataFrame:
    """What each launch shares with the day's others: its name, a rising word, one of the most traded."""
    return meta(launches(events, part)).withColumnRenamed("id", "event_id")
