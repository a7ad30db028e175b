"""Tables in files, joins with parameters, membership, sorts and word sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.plans.monitoring import D, within
from loomwright.plans.registry import Pack
from loomwright.sources import files, scratch, sinks

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql


@pack.query("nation", "region", sql="SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def packaged_records(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Dimensions packed as gzip JSON lines and read back with a schema: the file, not the query, is the source."""
    spark, folder = nation.sparkSession, scratch.new_folder(nation.sparkSession, "packaged")
    nation.write.option("compression", "gzip").json(folder + "/nation")
    region.write.json(folder + "/region")
    n = files.records(spark, folder + "/nation", "n_nationkey int, n_name string, n_regionkey int, absent string")
    r = files.records(spark, folder + "/region", "r_regionkey int, r_name string")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


@pack.query("part", sql="SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part")
def packaged_words(part: DataFrame) -> DataFrame:
    """A gzip word list written and read back."""
    spark, folder = part.sparkSession, scratch.new_folder(part.sparkSession, "words")
    part.select(F.explode(F.split("p_name", " ")).alias("value")).distinct().write.option("compression", "gzip").text(folder)
    return files.word_list(spark, folder)


@pack.query("events", sql="SELECT event_id, CASE WHEN event_id % 7 != 0 THEN (props->>'k')::BIGINT END AS k, NULL::VARCHAR AS added FROM events")
def result_envelope(events: DataFrame) -> DataFrame:
    """Stored documents read with a later schema: a field that they lack is null, one that the schema lacks is ignored, and a broken document is null."""
    document = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    read = events.select("event_id", files.envelope(document, "k long, added string").alias("doc"))
    return read.select("event_id", "doc.k", "doc.added")


@pack.query("orders", sql="SELECT o_custkey, count(*)::INT AS versions, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def append_versions(orders: DataFrame) -> DataFrame:
    """Rows appended to a table in two steps, each numbered after the versions that are there; then the table's last version by key."""
    spark, path = orders.sparkSession, scratch.new_folder(orders.sparkSession, "versions")
    middle = orders.agg(F.percentile_approx("o_orderkey", 0.5)).first()[0] or 0
    for step in (F.col("o_orderkey") <= middle, F.col("o_orderkey") > middle):
        sinks.append_versions(spark, path, orders.select("o_custkey", "o_orderkey").filter(step), "o_custkey", "o_orderkey")
    rows = spark.read.parquet(path)
    return rows.groupBy("o_custkey").agg(F.max("version").alias("versions"), F.max_by("o_orderkey", "version").alias("latest"))


@pack.query("events", sql="SELECT event_type, count(*) AS n_items, round(sum(CASE WHEN event_type IN ('click', 'error') THEN value * 2 ELSE value END), 3) AS total FROM events GROUP BY event_type")
def replace_partitions(events: DataFrame) -> DataFrame:
    """A partitioned table of which two partitions are written again: these are replaced, the others stay."""
    spark, path = events.sparkSession, scratch.new_folder(events.sparkSession, "partitions")
    rows = events.select("event_id", "value", "event_type")
    sinks.replace_partitions(path, rows, "event_type")
    sinks.replace_partitions(path, rows.filter(F.col("event_type").isin("click", "error")).withColumn("value", F.col("value") * 2), "event_type")
    return spark.read.schema(rows.schema).parquet(path).groupBy("event_type").agg(F.count("*").alias("n_items"), F.round(F.sum("value"), 3).alias("total"))


_MAYBE = "CASE WHEN {k} % 5 != 0 THEN {k} % 3 END"


@pack.query("events", sql=f"SELECT event_id, {_MAYBE.format(k='event_id')} IS NOT DISTINCT FROM {_MAYBE.format(k='user_id')} AS same, {_MAYBE.format(k='event_id')} IS DISTINCT FROM 1 AS other FROM events")
def null_safe_compare(events: DataFrame) -> DataFrame:
    """Comparisons in which null equals null."""
    maybe = lambda c: F.when(F.col(c) % 5 != 0, F.col(c) % 3)
    return events.select("event_id", maybe("event_id").eqNullSafe(maybe("user_id")).alias("same"), (~maybe("event_id").eqNullSafe(F.lit(1))).alias("other"))


@pack.query(
    "orders",
    sql="""SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS seen FROM orders GROUP BY o_custkey
    HAVING list_contains(list(o_orderstatus), 'P') AND NOT list_contains(list(o_orderstatus), 'F')""",
)
def array_membership(orders: DataFrame) -> DataFrame:
    """Keys by what their lists of states hold. The lists are sets of a few states, so they stay small however many rows a key has."""
    seen = orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return seen.filter(F.array_contains("s", "P") & ~F.array_contains("s", "F")).select("o_custkey", F.array_join(F.array_sort("s"), ",").alias("seen"))


@pack.query("events", sql="SELECT event_id, len(json_keys(d)) > 1 AS richer, json_exists(d, '$.extra') AS has_extra, (d->>'$.k')::BIGINT AS k FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_merge_patch(props::JSON, '{\"extra\": 1}') ELSE props::JSON END AS d FROM events)")
def json_keys(events: DataFrame) -> DataFrame:
    """Which keys a document has."""
    document = F.when(F.col("event_id") % 3 == 0, F.concat(F.substring(F.col("props"), F.lit(1), F.length("props") - 1), F.lit(', "extra": 1}'))).otherwise(F.col("props"))
    keys = F.json_object_keys(document)
    return events.select("event_id", (F.size(keys) > 1).alias("richer"), F.array_contains(keys, "extra").alias("has_extra"), F.get_json_object(document, "$.k").cast("long").alias("k"))


WANTED = ((3, "O"), (7, "F"), (11, "P"), (3, "F"))


@pack.query("orders", sql=f"SELECT o_orderkey, o_custkey FROM orders JOIN (VALUES {', '.join(map(str, WANTED))}) v(k, s) ON o_custkey = k AND o_orderstatus = s")
def parameter_join(orders: DataFrame) -> DataFrame:
    """Rows named by two parallel arrays of parameters, joined as a table of their own: as few rows as there are parameters."""
    ks, states = zip(*WANTED, strict=True)
    wanted = orders.sparkSession.range(1).select(F.explode(F.arrays_zip(F.array(*map(F.lit, ks)).alias("k"), F.array(*map(F.lit, states)).alias("s"))).alias("w")).select("w.k", "w.s")
    return orders.join(F.broadcast(wanted), (F.col("o_custkey") == F.col("k")) & (F.col("o_orderstatus") == F.col("s"))).select("o_orderkey", "o_custkey")


@pack.query("customer", "orders", sql="SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows that have at least one match; each once."""
    large = orders.filter("o_totalprice > 400000").select("o_custkey")
    return customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@pack.query("orders", sql="SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus = 'P' DESC, o_totalprice DESC, o_orderkey LIMIT 60")
def boolean_sort(orders: DataFrame) -> DataFrame:
    """Those in one state first, then the largest: the top sixty."""
    return orders.orderBy((F.col("o_orderstatus") == "P").desc(), F.desc("o_totalprice"), "o_orderkey").limit(60).select("o_orderkey", "o_orderstatus")


@pack.query("part")
def random_sample(part: DataFrame) -> DataFrame:
    """A hundred rows in random order, the same for the same seed and partitions."""
    return part.select("p_partkey", "p_name").orderBy(F.rand(7)).limit(100)


@pack.query(
    "events",
    sql=f"""WITH r AS (SELECT event_id, ts FROM events WHERE ts >= {D} - INTERVAL 20 DAY), newest AS (SELECT * FROM r ORDER BY ts DESC, event_id DESC LIMIT 600)
    SELECT event_id, ts FROM newest UNION SELECT * FROM (SELECT event_id, ts FROM r WHERE (SELECT count(*) FROM r) > 600 ORDER BY ts, event_id LIMIT 10)""",
)
def newest_and_first(events: DataFrame) -> DataFrame:
    """The newest six hundred and, only if there are more, the earliest ten too."""
    rows = events.filter(within(480)).select("event_id", "ts")
    newest = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(600)
    # One row beyond the limit tells that it was hit.
    hit = rows.select(F.lit(1).alias("one")).limit(601).agg((F.count("*") > 600).alias("hit"))
    first = rows.orderBy("ts", "event_id").limit(10).crossJoin(F.broadcast(hit)).filter("hit").drop("hit")  # one row
    return newest.unionByName(first).dropDuplicates(["event_id"])


@pack.query(
    "conversations",
    sql="""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, len(list_intersect(a, b)) AS shared, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_distinct(list_concat(a, b))) AS all_words, len(list_intersect(a, b)) > 0 AS overlap FROM p""",
)
def word_sets(conversations: DataFrame) -> DataFrame:
    """Words that a turn shares with the next one, that the next one adds, and of both together."""
    w = conversations.select("conv_id", "turn", F.array_distinct(T.words(F.col("text"))).alias("a"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    size = lambda c: F.size(c).cast("long")
    return w.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", size(F.array_intersect("a", "b")).alias("shared"), size(F.array_except("b", "a")).alias("added"), size(F.array_union("a", "b")).alias("all_words"), F.arrays_overlap("a", "b").alias("overlap")
    )


#: Stop words, and the compact words that may be inside of others.
PIECES = ("bolt", "ring", "gear", "anvil")


@pack.query(
    "part",
    sql=f"""WITH t AS (SELECT DISTINCT replace(p_name, ' ', '') AS word FROM part), s AS (SELECT word, unnest(range(3, length(word) - 1)) AS i FROM t WHERE length(word) >= 6),
    c AS (SELECT word, unnest([left(word, i), substr(word, i + 1)]) AS piece, unnest([length(word) - i, i]) AS rest FROM s)
    SELECT word, piece FROM c WHERE piece IN {PIECES} AND length(piece) >= 4 AND rest >= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(piece) DESC, piece) = 1""",
)
def compound_parts(part: DataFrame) -> DataFrame:
    """Known pieces at the start or end of words that are fused with something else; the longest piece of each word."""
    words = part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("word")).distinct().filter("length(word) >= 6")
    cuts = words.withColumn("i", F.explode(F.sequence(F.lit(3), F.length("word") - 2)))
    ends = F.array(F.struct(F.left("word", F.col("i")).alias("piece"), (F.length("word") - F.col("i")).alias("rest")), F.struct(F.substring(F.col("word"), F.col("i") + 1, F.length("word")).alias("piece"), F.col("i").alias("rest")))
    found = cuts.select("word", F.inline(ends)).filter(F.col("piece").isin(*PIECES) & (F.length("piece") >= 4) & (F.col("rest") >= 2))
    return found.groupBy("word").agg(F.min_by("piece", F.struct(-F.length("piece"), F.col("piece"))).alias("piece"))
