"""Upkeep of tables: rate limits, freshness of caches, hygiene of metadata, binary records, names to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import records as R
from loomwright.functions import segment as S
from loomwright.plans.monitoring import D, now
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: How long each kind of row counts as fresh, in hours.
TTL = {"view": 6, "click": 12, "signup": 168, "purchase": 720, "error": 1}


@pack.query("events", sql="SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS used, greatest(count(*) - 2, 0) AS refused FROM events GROUP BY ALL HAVING count(*) > 2")
def token_bucket(events: DataFrame) -> DataFrame:
    """Requests beyond the two that an hour allows each user."""
    used = events.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("used"))
    return used.filter("used > 2").withColumn("refused", F.greatest(F.col("used") - 2, F.lit(0)))


@pack.query(
    "events",
    sql=f"SELECT event_type, count(*) FILTER (WHERE {D} - ts < to_hours(CASE event_type {' '.join(f'WHEN {k!r} THEN {h}' for k, h in TTL.items())} END)) AS fresh, count(*) AS n_all FROM events GROUP BY event_type",
)
def ttl_fresh(events: DataFrame) -> DataFrame:
    """Rows of each kind that have not expired."""
    hours = F.create_map(*[F.lit(x) for kv in TTL.items() for x in kv])[F.col("event_type")]
    age = F.unix_micros(now().cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy("event_type").agg(F.count_if(age < hours * 3_600_000_000).alias("fresh"), F.count("*").alias("n_all"))


@pack.query(
    "events",
    sql="""
    SELECT DISTINCT event_id, ts FROM ((SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts DESC LIMIT 500) UNION ALL (SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts LIMIT 10))""",
)
def head_tail_union(events: DataFrame) -> DataFrame:
    """The newest five hundred and the earliest ten, each once."""
    rows = events.filter("event_type = 'view'").select("event_id", "ts")
    return rows.orderBy(F.desc("ts")).limit(500).unionByName(rows.orderBy("ts").limit(10)).dropDuplicates(["event_id"])


@pack.query(
    "pages",
    sql=r"""
    SELECT page_id, CASE WHEN starts_with(url, 'https://') AND length(url) <= 200 THEN url END AS safe_url, length(html) - length(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS scrubbed,
      length(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS title_chars FROM pages""",
)
def metadata_hygiene(pages: DataFrame) -> DataFrame:
    """Only https links of bounded length stay; control characters go; the title is trimmed."""
    clean = F.regexp_replace("html", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    safe = F.when(F.col("url").startswith("https://") & (F.length("url") <= 200), F.col("url"))
    title = F.length(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return pages.select("page_id", safe.alias("safe_url"), (F.length("html") - F.length(clean)).cast("long").alias("scrubbed"), title.cast("long").alias("title_chars"))


def little_endian(data, at: int, size: int):
    """An unsigned little-endian number inside a binary column."""
    digits = F.concat(*[F.hex(F.substring(data, at + size - k, 1)) for k in range(size)])
    return F.conv(digits, 16, 10).cast("long")


@pack.query("events", sql="SELECT event_id, user_id, (event_id % 256)::BIGINT AS flag FROM events")
def decode_records(events: DataFrame) -> DataFrame:
    """Fixed-layout binary records (a flag byte, then two little-endian numbers) back to columns."""

    def packed(column, size):
        digits = F.lpad(F.hex(column), 2 * size, "0")
        return F.concat(*[F.substring(digits, 2 * (size - 1 - k) + 1, 2) for k in range(size)])

    record = F.unhex(F.concat(packed(F.col("event_id") % 256, 1), packed(F.col("event_id"), 8), packed(F.col("user_id"), 4)))
    rows = events.select(record.alias("data"))
    return rows.select(little_endian(F.col("data"), 1, 8).alias("event_id"), little_endian(F.col("data"), 9, 4).alias("user_id"), little_endian(F.col("data"), 0, 1).alias("flag"))


#: An account as bytes: a kind, a padded name, a type, sizes behind a flag, a supply behind a flag.
ACCOUNT = [(None, "u8"), ("name", "text"), ("type", "text"), ("sizes", ("optional", ("many", "u8"))), ("supply", ("optional", "u64"))]


@pack.query(
    "part",
    sql="""SELECT p_partkey, CASE WHEN ok THEN p_name END AS name, CASE WHEN ok THEN p_type END AS type, CASE WHEN ok AND p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 3 = 2 THEN p_size * 2 ELSE p_size END END::BIGINT AS sizes,
      CASE WHEN ok AND p_partkey % 2 = 0 THEN p_partkey END AS supply FROM (SELECT *, p_partkey % 11 != 0 AND p_partkey % 13 != 0 AS ok FROM part)""",
)
def account_records(part: DataFrame) -> DataFrame:
    """Records with length-prefixed, optional and repeated fields read from bytes; those cut off or with a length beyond their end give nulls. ``sizes`` is the sum of the repeated field."""

    def little(value, size):
        digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
        return F.concat(*[F.substring(digits, 2 * (size - 1 - k) + 1, 2) for k in range(size)])

    text = lambda t, size: F.concat(little(size, 4), F.hex(t.cast("binary")))
    key = F.col("p_partkey")
    name = F.rpad("p_name", 20, "\0")
    named = F.when(key % 13 == 0, F.concat(F.lit("FFFFFFFF"), F.hex(name.cast("binary")))).otherwise(text(name, F.octet_length(name)))
    sizes = F.when(key % 3 == 0, F.lit("00")).otherwise(F.concat(F.lit("01"), little(key % 3, 4), F.repeat(little(F.col("p_size"), 1), (key % 3).cast("int"))))
    supply = F.when(key % 2 == 0, F.concat(F.lit("01"), little(key, 8))).otherwise(F.lit("00"))
    digits = F.concat(F.lit("04"), named, text(F.col("p_type"), F.octet_length("p_type")), sizes, supply)
    data = F.unhex(F.when(key % 11 == 0, F.left(digits, F.length(digits) - 2)).otherwise(digits))
    record = R.decoded(data, ACCOUNT, "name string, type string, sizes array<long>, supply long")
    rows = part.select("p_partkey", record.alias("r"))
    total = F.aggregate("r.sizes", F.lit(0).cast("long"), lambda t, x: t + x)
    return rows.select("p_partkey", "r.name", "r.type", total.alias("sizes"), "r.supply")


@pack.query("orders", sql="SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01' AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')")
def optional_filters(orders: DataFrame) -> DataFrame:
    """A search whose parameters may be missing: only those given become predicates, and reach the scan."""
    return search(orders, status="O", since="1997-01-01", until="1998-01-01", priorities=["1%", "2%"], customer=None)


def search(orders: DataFrame, status=None, since=None, until=None, priorities=None, customer=None) -> DataFrame:
    day = F.col("o_orderdate")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    rules = [
        status is not None and (F.col("o_orderstatus") == status), since and (day >= at(since)), until and (day <= at(until)), customer is not None and (F.col("o_custkey") == customer),
        priorities and F.expr("o_orderpriority LIKE ANY (" + ", ".join(f"'{p}'" for p in priorities) + ")"),
    ]
    for rule in rules:
        if rule is not None and rule is not False:
            orders = orders.filter(rule)
    return orders.select("o_orderkey")


@pack.query("part", sql="SELECT DISTINCT replace(p_name, ' ', '') AS compact, p_name AS words FROM part")
def segment_words(part: DataFrame) -> DataFrame:
    """Names without spaces cut into words again, by how often the table's words occur."""
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return split_names(part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("compact")), words)


#: Fixed values of the choice between two readings of a name: what a known word gains, what a lone letter, a pair of letters and any token cost, letters of a token that is
#: looked at again inside a name of several, and how often a word of the vocabulary counts at least.
KNOWN_WORD, LONE_LETTER, TWO_LETTERS, EACH_TOKEN, LONG_TOKEN, BOOST = 2.0, 1.5, 0.4, 0.15, 9, 500_000_000


def resegmented(names: DataFrame, words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """name and words of each distinct name (lower case, spaced): a name of one token, and long tokens of others, are split where the pieces score better.

    ``words`` (w, n) says how often words occur, and words of ``vocabulary`` (w) count as if they were very frequent. A reading gains for each token of the vocabulary and loses for lone letters, for pairs
    of letters that aren't one, and for every token. Only letters are split. Distinct tokens are split once; a null name is left out, an empty one stays empty.
    """
    names = names.select("name").filter("name IS NOT NULL").distinct()
    vocabulary = vocabulary.select("w").filter("w != ''").distinct()
    boosted = words.select("w", "n").unionByName(vocabulary.select("w", F.lit(BOOST).cast("long").alias("n"))).groupBy("w").agg(F.max("n").alias("n"))
    tokens = F.filter(F.split("name", " +"), lambda t: t != "")
    rows = names.withColumn("tokens", tokens)
    again = F.filter("tokens", lambda t: t.rlike(r"^[a-z]+$") & ((F.length(t) >= LONG_TOKEN) | (F.size("tokens") == 1)))
    asked = rows.select(F.explode(again).alias("compact")).distinct()
    split = split_names(asked, boosted).select(F.col("compact").alias("token"), F.split("words", " ").alias("parts")).filter(F.size("parts") > 1)
    pieces = split.select("token", F.posexplode(F.concat(F.array("token"), "parts")).alias("at", "w"))
    scored = pieces.join(vocabulary.withColumn("known", F.lit(True)), "w", "left")
    points = F.when(F.col("known"), KNOWN_WORD).when(F.length("w") == 1, -LONE_LETTER).when(F.length("w") == 2, -TWO_LETTERS).otherwise(0.0) - EACH_TOKEN
    better = scored.groupBy("token").agg(F.sum(F.when(F.col("at") == 0, points)).alias("whole"), F.sum(F.when(F.col("at") > 0, points)).alias("cut")).filter("cut > whole + 1e-9")
    chosen = split.join(better.select("token"), "token")
    found = rows.select("name", F.posexplode("tokens").alias("at", "token")).join(chosen, "token", "left")
    found = found.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("parts", F.array("token")).alias("parts")))).alias("all"))  # tokens of one name
    whole = rows.join(found, "name", "left")
    return whole.select("name", F.coalesce(F.array_join(F.flatten(F.transform("all", lambda x: x["parts"])), " "), F.lit("")).alias("words"))


_WRITTEN = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN 'my ' || replace(p_name, ' ', '') || 'coin' ELSE 'qzx' || split_part(p_name, ' ', 2) END"


@pack.query(
    "part",
    sql=f"""SELECT DISTINCT {_WRITTEN} AS name, CASE p_partkey % 4 WHEN 2 THEN 'my ' || p_name || ' coin' WHEN 3 THEN 'qzx ' || split_part(p_name, ' ', 2) ELSE p_name END AS words FROM part""",
)
def resegment_names(part: DataFrame) -> DataFrame:
    """Names written apart, in one word, inside a longer one and behind letters that nobody knows, read again where another reading scores better."""
    name, noun, rest = F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 4
    fused = F.replace(name, F.lit(" "), F.lit(""))
    written = F.when(rest == 0, name).when(rest == 1, fused).when(rest == 2, F.concat(F.lit("my "), fused, F.lit("coin"))).otherwise(F.concat(F.lit("qzx"), noun))
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    vocabulary = words.select("w").union(part.sparkSession.range(1).select(F.lit("coin")))
    return resegmented(part.select(written.alias("name")), words, vocabulary)


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """compact and words of each distinct name, by a table of words (w, n) of any size: each name asks for the counts of its own pieces."""
    names = names.distinct()
    starts = F.explode(F.sequence(F.lit(1), F.length("compact")))
    longest = words.agg(F.coalesce(F.max(F.length("w")), F.lit(1)).alias("longest"))  # one row
    pieces = names.filter("compact != ''").crossJoin(F.broadcast(longest)).withColumn("a", starts)
    pieces = pieces.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.col("longest"), F.length("compact") - F.col("a") + 1))))
    pieces = pieces.select("compact", F.substring(F.col("compact"), F.col("a"), F.col("l")).alias("w")).distinct()
    known = pieces.join(words, "w").groupBy("compact").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("counts"))  # one entry for each piece of a name at most
    total = words.agg(F.sum("n").alias("total"))
    rows = names.join(known, "compact", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("compact", S.segment(F.col("compact"), F.col("counts"), F.coalesce("total", F.lit(1))).alias("words"))


@pack.query("part")
def similar_names(part: DataFrame) -> DataFrame:
    """Pairs of distinct names of one type whose Indel ratio is 0.86 or more: one row for each pair and type. No pair is lost."""
    return similar_pairs(part.select("p_type", F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("name")))


def similar_pairs(names: DataFrame) -> DataFrame:
    """Rows a, b, ratio for the names (p_type, name) of one type."""
    return close_pairs(names, LEAST_RATIO).select("a", "b", F.round("ratio", 4).alias("ratio")).filter("ratio >= 0.86")


#: A ratio that rounds to 0.86 is more than this.
LEAST_RATIO = 0.8599


def shared_bigrams(size, other, least_ratio: float = LEAST_RATIO):
    """Pairs of neighbouring characters, each counted as often as it occurs, that names of these lengths with such a ratio have in common at least.

    Each character left out of one name takes two of its pairs, each one put in takes one; the ratio bounds how many there are.
    """
    changes = F.floor((size + other) * (1 - least_ratio))
    return F.ceil((size + other) / 2 - 1 - 1.5 * changes)


def bigrams(name):
    """A name's pairs of neighbouring characters, the second occurrence of one told from the first: an array without repeats."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda k: F.substring(name, k, F.lit(2)))
    return F.transform(pairs, lambda x, k: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), k), lambda y: y == x)).cast("string")))


def close_pairs(names: DataFrame, least_ratio: float) -> DataFrame:
    """Rows p_type, a, b, ratio for the names (p_type, name) of one type, of at least ``least_ratio``.

    Names meet by the rarest of their bigrams: whoever shares as many as the ratio asks for has one in common among so many of them.
    """
    names = names.filter("length(name) > 1").distinct().withColumn("grams", bigrams(F.col("name")))
    size = F.length("name")
    least = F.ceil(size * (least_ratio / (2 - least_ratio)))  # length of the shortest name that can be as similar
    lengths = F.sequence(least, F.greatest(least, F.floor(size * ((2 - least_ratio) / least_ratio))))
    fewest = F.greatest(F.lit(1), F.array_min(F.transform(lengths, lambda other: shared_bigrams(size, other, least_ratio))))
    names = names.withColumn("keys", F.size("grams") - fewest + 1)
    rows = names.select("*", F.explode("grams").alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = rows.join(often, "gram").groupBy("p_type", "name", "keys").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("ranked"))
    grams = F.transform("ranked", lambda x: x["gram"])
    keyed = ranked.select("p_type", "name", F.length("name").alias("size"), grams.alias("grams"), F.slice(grams, F.lit(1), F.greatest(F.lit(0), F.col("keys").cast("int"))).alias("keys"))
    keyed = keyed.withColumn("key", F.explode("keys")).withColumn("key", F.struct("p_type", "key"))
    keyed = keyed.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")  # few bytes, but many pairs: not to be coalesced
    left, right = (keyed.select(*[F.col(c).alias(f"{c}_{x}") for c in keyed.columns]).withColumnRenamed(f"name_{x}", x) for x in "ab")
    near = (F.col("size_a") + F.col("size_b")) * least_ratio <= 2 * F.least("size_a", "size_b")
    pairs = left.join(right, (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b")) & near)
    once = F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0)) == F.col("key_a.key")  # a pair counts at the first key that both have
    enough = once & (F.size(F.array_intersect("grams_a", "grams_b")) >= shared_bigrams(F.col("size_a"), F.col("size_b"), least_ratio))
    return pairs.filter(enough).withColumn("ratio", S.indel_ratio("a", "b")).filter(F.col("ratio") >= least_ratio).select(F.col("key_a.p_type").alias("p_type"), "a", "b", "ratio")


@pack.query(
    "orders", "lineitem",
    sql="""
    SELECT o.o_orderkey, o.o_custkey, l.l_partkey AS newest_part FROM orders o LEFT JOIN (
      SELECT l_orderkey, arg_max(l_partkey, l_shipdate::VARCHAR || lpad(l_partkey::VARCHAR, 12, '0')) AS l_partkey FROM lineitem WHERE l_quantity >= 40 GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""",
)
def newest_suitable(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Each row with the newest suitable row of another table, if any."""
    newest = lineitem.filter("l_quantity >= 40").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("newest_part"))
    return orders.filter("o_orderstatus = 'P'").join(newest, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", "newest_part")
