"""Text features, dictionary matches, trends and similarity of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import phrases
from loomwright.plans.monitoring import D, now
from loomwright.plans.registry import Pack
from loomwright.plans.upkeep import close_pairs

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql


@pack.query("part", sql="SELECT regexp_replace(lower(coalesce(p_name, '')), '[^a-z0-9]', '', 'g') AS compact, count(*) AS n_items FROM part GROUP BY 1")
def compact_name(part: DataFrame) -> DataFrame:
    """Items by compact name."""
    return part.groupBy(T.compact(F.col("p_name")).alias("compact")).agg(F.count("*").alias("n_items"))


@pack.query(
    "part",
    sql=r"""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(p_name || ' (' || p_type || ') ' || p_brand || '''s', '\([^)]*\)', ' ', 'g')), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS surface FROM part""",
)
def surface_form(part: DataFrame) -> DataFrame:
    """Comparable form of a decorated title."""
    title = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "), "p_brand", F.lit("'s"))
    return part.select("p_partkey", T.surface(title).alias("surface"))


@pack.query(
    "documents",
    sql="""
    WITH t AS (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9@$]+')) AS token FROM documents)
    SELECT token, translate(token, '013457@$', 'oieastas') AS plain, count(*) AS n_items FROM t
    WHERE regexp_matches(token, '[a-z]') AND regexp_matches(token, '[0-9@$]') AND NOT regexp_matches(token, '^[a-z]+[0-9]{1,4}$') AND NOT regexp_matches(token, '^[0-9]{1,4}[a-z]+$')
      AND regexp_matches(translate(token, '013457@$', 'oieastas'), '^[a-z]+$') GROUP BY ALL""",
)
def deleet(documents: DataFrame) -> DataFrame:
    """Words written with digits for letters, and what they stand for."""
    tokens = documents.select(F.explode(F.split(F.lower("text"), "[^a-z0-9@$]+")).alias("token"))
    return tokens.withColumn("plain", T.deleet(F.col("token"))).filter("plain IS NOT NULL").groupBy("token", "plain").agg(F.count("*").alias("n_items"))


@pack.query(
    "documents",
    sql="SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '[{r}]')) AS {n}" for n, r in T.SCRIPTS.items()) + " FROM documents GROUP BY lang",
)
def script_flags(documents: DataFrame) -> DataFrame:
    """Documents of each language that hold each script."""
    return documents.groupBy("lang").agg(*[F.count_if(T.has_script(F.col("text"), s)).alias(s) for s in T.SCRIPTS])


_MIXED = f"regexp_matches(word, '[{T.SCRIPTS['latin']}]') AND regexp_matches(word, '[{T.SCRIPTS['cyrillic']}{T.SCRIPTS['greek']}]')"


@pack.query(
    "documents",
    sql=f"""
    SELECT lang, count(*) AS n_words, count(*) FILTER (WHERE {_MIXED}) AS mixed FROM (
      SELECT lang, unnest(string_split(translate(text, 'ao' , CASE WHEN doc_id % 10 = 0 THEN 'ао' ELSE 'ao' END), ' ')) AS word FROM documents) GROUP BY lang""",
)
def homoglyph(documents: DataFrame) -> DataFrame:
    """Words that mix alphabets; every tenth document has its a and o replaced by look-alikes first."""
    text = F.when(F.col("doc_id") % 10 == 0, F.translate("text", "ao", "ао")).otherwise(F.col("text"))
    rows = documents.select("lang", F.explode(F.split(text, " ")).alias("word"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_words"), F.count_if(T.homoglyph_word(F.col("word"))).alias("mixed"))


def _squeeze_sql(x: str) -> str:
    return reduce(lambda sql, c: f"regexp_replace({sql}, '{c}{{3,}}', '{c}{c}', 'g')", "abcdefghijklmnopqrstuvwxyz", x)


@pack.query("documents", sql=f"SELECT doc_id, length(text) - length({_squeeze_sql('lower(text)')}) AS dropped FROM documents")
def squeeze(documents: DataFrame) -> DataFrame:
    """Characters dropped by squeezing repeated letters."""
    return documents.select("doc_id", (F.length("text") - F.length(T.squeeze(F.lower("text")))).cast("long").alias("dropped"))


@pack.query(
    "part",
    sql=r"""
    SELECT DISTINCT p_type || p_name AS name, regexp_replace(regexp_replace(p_type || p_name || 'XMLPart', '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') AS split FROM part""",
)
def camel_split(part: DataFrame) -> DataFrame:
    """Joined names cut at their capitals."""
    name = F.concat("p_type", "p_name")
    return part.select(name.alias("name"), T.split_camel(F.concat(name, F.lit("XMLPart"))).alias("split")).distinct()


@pack.query(
    "part",
    sql="""
    WITH p AS (SELECT DISTINCT p_name, upper(regexp_replace(p_type, '[^A-Z]', '', 'g'))[1:2] AS ticker FROM part),
    i AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') AS initials FROM p)
    SELECT p_name, ticker, CASE WHEN ticker = '' THEN 'unrelated' WHEN lower(ticker) = replace(p_name, ' ', '') THEN 'equals' WHEN lower(ticker) = initials THEN 'acronym'
      WHEN regexp_matches(p_name, '^' || lower(ticker)) THEN 'prefix' WHEN regexp_matches(p_name, lower(ticker[1]) || '.*' || lower(ticker[2])) THEN 'subsequence'
      WHEN levenshtein(lower(ticker), p_name[1:2]) <= 1 THEN 'fuzzy' ELSE 'unrelated' END AS rule FROM i""",
)
def acronym_explain(part: DataFrame) -> DataFrame:
    """How a short ticker comes from a name; the first rule that fits wins."""
    p = part.select("p_name", F.left(F.upper(F.regexp_replace("p_type", "[^A-Z]", "")), F.lit(2)).alias("ticker")).distinct()
    low = F.lower("ticker")
    initials = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.left(w, F.lit(1))), "")
    rule = (
        F.when(F.col("ticker") == "", "unrelated")
        .when(low == F.replace("p_name", F.lit(" "), F.lit("")), "equals")
        .when(low == initials, "acronym")
        .when(F.col("p_name").startswith(low), "prefix")
        .when(F.regexp_like("p_name", F.concat(F.left(low, F.lit(1)), F.lit(".*"), F.substring(low, 2, 1))), "subsequence")
        .when(F.levenshtein(low, F.left("p_name", F.lit(2))) <= 1, "fuzzy")
        .otherwise("unrelated")
    )
    return p.select("p_name", "ticker", rule.alias("rule"))


@pack.query(
    "pages",
    sql=r"""
    WITH u AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) AS first,
      regexp_extract(url, '/([0-9]+)(?:\.html)?/?(?:[?#].*)?$', 1) AS number, url FROM pages)
    SELECT page_id, host, first, number, CASE WHEN host = '' THEN 'invalid' WHEN regexp_matches(url, '[?&]utm_') THEN 'campaign' WHEN regexp_matches(url, '[?&]page=') THEN 'list'
      WHEN host LIKE 'blog.%' THEN 'post' WHEN number != '' THEN 'item' WHEN first = '' THEN 'homepage' ELSE 'unknown' END AS kind FROM u""",
)
def url_classify(pages: DataFrame) -> DataFrame:
    """Kind of each URL with its host, first path segment and number."""
    u = pages.select(
        "page_id", "url",
        F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("host"),
        F.regexp_extract("url", r"^https?://[^/?#]+/([^/?#]*)", 1).alias("first"),
        F.regexp_extract("url", r"/([0-9]+)(?:\.html)?/?(?:[?#].*)?$", 1).alias("number"),
    )
    kind = (
        F.when(F.col("host") == "", "invalid").when(F.col("url").rlike("[?&]utm_"), "campaign").when(F.col("url").rlike("[?&]page="), "list")
        .when(F.col("host").startswith("blog."), "post").when(F.col("number") != "", "item").when(F.col("first") == "", "homepage").otherwise("unknown")
    )
    return u.select("page_id", "host", "first", "number", kind.alias("kind"))


@pack.query("events", sql="SELECT event_id, CASE WHEN event_id % 9 != 0 THEN make_timestamp((((event_id * 1000003 + 1000) * 4194304 >> 22) + 1288834974657) * 1000) END AS made FROM events")
def snowflake_time(events: DataFrame) -> DataFrame:
    """The time inside a 64-bit id: milliseconds since the service's epoch, above 22 bits; null for ids from before, which are small."""
    ident = F.when(F.col("event_id") % 9 == 0, F.col("event_id")).otherwise(F.shiftleft(F.col("event_id") * 1000003 + 1000, 22))
    made = F.timestamp_millis(F.shiftright(ident, 22) + F.lit(1288834974657)).cast("timestamp_ntz")
    return events.select("event_id", F.when(ident >= 1000 << 22, made).alias("made"))


@pack.query(
    "orders",
    sql="""
    WITH r AS (SELECT o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m, o_orderkey FROM orders)
    SELECT o_orderkey, n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END || ' of ' || m AS place FROM r""",
)
def ordinal_rank(orders: DataFrame) -> DataFrame:
    """Place among the rows of a key, in words."""
    # Two levels, so that no task orders all rows of a key: places inside a month, and the rows of the months before.
    rows = orders.select("o_custkey", "o_orderdate", "o_orderkey", F.trunc("o_orderdate", "month").alias("month"))
    months = rows.groupBy("o_custkey", "month").agg(F.count("*").alias("size"))
    of_key = Window.partitionBy("o_custkey")
    before = F.coalesce(F.sum("size").over(of_key.orderBy(F.asc_nulls_first("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = months.select(F.col("o_custkey").alias("_key"), F.col("month").alias("_month"), before.alias("before"), F.sum("size").over(of_key).alias("m"))
    inside = F.rank().over(Window.partitionBy("o_custkey", "month").orderBy("o_orderdate", "o_orderkey"))
    same = F.col("o_custkey").eqNullSafe(F.col("_key")) & F.col("month").eqNullSafe(F.col("_month"))
    r = rows.withColumn("inside", inside).join(months, same).select("o_orderkey", (F.col("before") + F.col("inside")).alias("n"), "m")
    return r.select("o_orderkey", F.concat(T.ordinal(F.col("n")), F.lit(" of "), F.col("m").cast("string")).alias("place"))


_WORDS = "regexp_extract_all(lower(text), '[a-z]{2,}')"


@pack.query(
    "documents",
    sql=f"""
    WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS word FROM documents), n AS (SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS recent, count(*) FILTER (WHERE doc_id % 4 != 0) AS base FROM documents),
    c AS (SELECT word, count(*) FILTER (WHERE doc_id % 4 = 0) AS recent, count(*) FILTER (WHERE doc_id % 4 != 0) AS base FROM w GROUP BY 1)
    SELECT word, c.recent, c.base, round((c.recent::DOUBLE / greatest(1, n.recent)) / ((c.base + 1)::DOUBLE / (n.base + 1)), 6) AS lift FROM c, n WHERE c.recent >= 5""",
)
def word_lift(documents: DataFrame) -> DataFrame:
    """How much more often a word occurs in recent documents than in the others."""
    counts, sizes = _word_counts(documents)
    return counts.crossJoin(F.broadcast(sizes)).select("word", "recent", "base", F.round(_lift(), 6).alias("lift"))  # one row of sizes


def _word_counts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with each word, recent and before (words in five recent documents at least), and how many documents there are."""
    recent = F.col("doc_id") % 4 == 0
    words = documents.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if(recent).alias("recent"), F.count_if(~recent).alias("base")).filter("recent >= 5")
    return counts, documents.agg(F.count_if(recent).alias("recent_all"), F.count_if(~recent).alias("base_all"))


def _lift():
    return (F.col("recent") / F.greatest(F.lit(1), F.col("recent_all"))) / ((F.col("base") + 1) / (F.col("base_all") + 1))


@pack.query(
    "documents",
    sql=f"""
    WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS word FROM documents), n AS (SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS recent, count(*) FILTER (WHERE doc_id % 4 != 0) AS base FROM documents),
    c AS (SELECT word, count(*) FILTER (WHERE doc_id % 4 = 0) AS recent, count(*) FILTER (WHERE doc_id % 4 != 0) AS base FROM w GROUP BY 1),
    l AS (SELECT word, c.recent, round((c.recent::DOUBLE / greatest(1, n.recent)) / ((c.base + 1)::DOUBLE / (n.base + 1)), 6) AS lift FROM c, n WHERE c.recent >= 5)
    SELECT doc_id, word AS hot_word, lift, round(least(0.75, 0.35 + 0.1 * log2(recent / 5.0 + 1)), 4) AS weight FROM w JOIN l USING (word) WHERE lift >= 3
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lift DESC, word) = 1""",
)
def hot_word(documents: DataFrame) -> DataFrame:
    """The word of each document that rose most, with its weight."""
    counts, sizes = _word_counts(documents)
    lifted = counts.crossJoin(F.broadcast(sizes)).withColumn("lift", F.round(_lift(), 6)).filter("lift >= 3").select("word", "recent", "lift")
    words = documents.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    best = words.join(lifted, "word").groupBy("doc_id").agg(F.min_by(F.struct("word", "lift", "recent"), F.struct(-F.col("lift"), F.col("word"))).alias("b"))
    weight = F.round(F.least(F.lit(0.75), 0.35 + 0.1 * F.log2(F.col("b.recent") / 5.0 + 1)), 4)
    return best.select("doc_id", F.col("b.word").alias("hot_word"), F.col("b.lift").alias("lift"), weight.alias("weight"))


@pack.query(
    "events",
    sql=f"""
    SELECT event_id, round(1 / (1 + d / 2.0) * pow(0.5, h / 24) * CASE d % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.8 ELSE 0.5 END, 6) AS novelty
    FROM (SELECT event_id, user_id % 10 AS d, date_diff('second', date_trunc('second', ts)::TIMESTAMP, {D}) / 3600.0 AS h FROM events)""",
)
def novelty(events: DataFrame) -> DataFrame:
    """A score that falls with the number of predecessors and with age."""
    d = F.col("user_id") % 10
    h = (F.unix_timestamp(now().cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600.0
    way = F.when(d % 3 == 0, 1.0).when(d % 3 == 1, 0.8).otherwise(0.5)
    return events.select("event_id", F.round(1 / (1 + d / 2.0) * F.pow(F.lit(0.5), h / 24) * way, 6).alias("novelty"))


@pack.query(
    "events",
    sql="""
    SELECT event_id, round(CASE WHEN user_id % 5 = 0 THEN 0.5 ELSE 1 END * least(1, greatest(0.05, CASE event_type WHEN 'view' THEN ln(value + 1) / ln(30) WHEN 'click' THEN log10((value + 1) / 100) / 3
      WHEN 'error' THEN value / 8 WHEN 'signup' THEN value / 25 ELSE 0.5 * (51 - user_id % 50) / 50 + 0.5 * least(value, 12) / 12 END)), 6) AS score FROM events""",
)
def trend_score(events: DataFrame) -> DataFrame:
    """One scale for the strength of trends of different sources; generic terms count half."""
    v, kind = F.col("value"), F.col("event_type")
    raw = (
        F.when(kind == "view", F.ln(v + 1) / F.ln(F.lit(30.0)))
        .when(kind == "click", F.log10((v + 1) / 100) / 3)
        .when(kind == "error", v / 8)
        .when(kind == "signup", v / 25)
        .otherwise(0.5 * (51 - F.col("user_id") % 50) / 50 + 0.5 * F.least(v, F.lit(12.0)) / 12)
    )
    generic = F.when(F.col("user_id") % 5 == 0, 0.5).otherwise(1.0)
    return events.select("event_id", F.round(generic * F.least(F.lit(1.0), F.greatest(F.lit(0.05), raw)), 6).alias("score"))


@pack.query(
    "customer", "orders",
    sql="""
    WITH a AS (SELECT c_custkey, c_nationkey, greatest(c_acctbal, 0) AS followers, count(o_orderkey) AS posts, date_diff('day', coalesce(min(o_orderdate), TIMESTAMP '2001-08-01'), TIMESTAMP '2001-08-01') AS age
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)
    SELECT c_custkey, round((0.4 * least(1, log10(1 + age) / log10(366)) + 0.3 * least(1, log10(1 + followers) / log10(100001)) + 0.2 * least(1, log10(1 + posts) / log10(3001)) + CASE WHEN c_nationkey % 5 = 0 THEN 0.1 ELSE 0 END)
      * CASE WHEN followers = 0 THEN 0.7 ELSE 1 END * greatest(0.4, 1 / (1 + 0.05 * greatest(posts - 1, 0))), 6) AS credibility FROM a""",
)
def credibility(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Weighted mean of age, reach and activity on log scales, with penalties."""
    stats = orders.groupBy("o_custkey").agg(F.count("*").alias("posts"), F.min("o_orderdate").alias("first"))
    last = F.lit("2001-08-01").cast("timestamp_ntz")
    a = customer.join(stats, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_nationkey", F.greatest("c_acctbal", F.lit(0.0)).alias("followers"), F.coalesce("posts", F.lit(0)).alias("posts"), F.date_diff(last, F.coalesce("first", last)).alias("age")
    )
    scale = lambda c, full: F.least(F.lit(1.0), F.log10(1 + F.col(c)) / F.log10(F.lit(1.0 + full)))
    mean = 0.4 * scale("age", 365) + 0.3 * scale("followers", 100_000) + 0.2 * scale("posts", 3000) + F.when(F.col("c_nationkey") % 5 == 0, 0.1).otherwise(0.0)
    penalty = F.when(F.col("followers") == 0, 0.7).otherwise(1.0) * F.greatest(F.lit(0.4), 1 / (1 + 0.05 * F.greatest(F.col("posts") - 1, F.lit(0))))
    return a.select("c_custkey", F.round(mean * penalty, 6).alias("credibility"))


@pack.query(
    "orders",
    sql="SELECT o_custkey, CASE WHEN count(*) <= 1 THEN 0.2 ELSE round(least(0.8, greatest(0.2, log10(count(*)) / 2.5)), 6) END AS popularity FROM orders GROUP BY 1",
)
def popularity_scale(orders: DataFrame) -> DataFrame:
    """Counts of links on a log scale between 0.2 and 0.8."""
    n = F.count("*")
    scale = F.when(n <= 1, 0.2).otherwise(F.round(F.least(F.lit(0.8), F.greatest(F.lit(0.2), F.log10(n) / 2.5)), 6))
    return orders.groupBy("o_custkey").agg(scale.alias("popularity"))


@pack.query(
    "benchmark",
    sql="""
    WITH w AS (SELECT DISTINCT item_id, length(text) AS size, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark)
    SELECT word, item_id AS owner FROM w QUALIFY row_number() OVER (PARTITION BY word ORDER BY size DESC, item_id) = 1""",
)
def surface_owner(benchmark: DataFrame) -> DataFrame:
    """Each surface belongs to the best-known item that has it."""
    w = benchmark.select("item_id", F.length("text").alias("size"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("word"))
    return w.groupBy("word").agg(F.min_by("item_id", F.struct(-F.col("size"), F.col("item_id"))).alias("owner"))


#: Words of a surface at most, and letters of a surface of one word at least.
MOST_SURFACE_WORDS, LEAST_LETTERS = 6, 5
#: Dictionary surfaces: the phrases between the marks of benchmark items, of one to six words.
_PHRASES = f"""ph AS (SELECT DISTINCT item_id, regexp_extract_all(p, '[a-z]{{2,}}') AS w FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[.,;:!?\\n]+')) AS p FROM benchmark)),
    pl AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS surface FROM ph WHERE len(w) BETWEEN 1 AND {MOST_SURFACE_WORDS} AND (len(w) > 1 OR length(w[1]) >= {LEAST_LETTERS})), s AS (SELECT DISTINCT n, surface FROM pl)"""
_FOUND = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
    o AS (SELECT doc_id, pos, n, surface FROM (SELECT doc_id, pos, unnest([1, 2, 3, 4, 5, 6]) AS n, w FROM g) x JOIN s USING (n) WHERE pos + n - 1 <= len(w) AND array_to_string(w[pos : pos + n - 1], ' ') = surface)"""


def payloads(benchmark: DataFrame) -> DataFrame:
    """item_id, n and surface: what each surface stands for. Several items may have one surface."""
    phrases = benchmark.select("item_id", F.explode(F.split(F.lower("text"), "[.,;:!?\n]+")).alias("p")).select("item_id", T.words(F.col("p")).alias("w"))
    n = F.size("w")
    phrases = phrases.filter(n.between(1, MOST_SURFACE_WORDS) & ((n > 1) | (F.length(F.get("w", F.lit(0))) >= LEAST_LETTERS)))
    return phrases.select("item_id", n.alias("n"), F.array_join("w", " ").alias("surface")).distinct()


def dictionary(benchmark: DataFrame) -> DataFrame:
    return payloads(benchmark).select("n", "surface").distinct()


def occurrences(documents: DataFrame, surfaces: DataFrame, longest: bool = False) -> DataFrame:
    """Every place where a surface occurs, or those that a sweep from left to right keeps (``longest``): doc_id, at, n, surface."""
    texts = documents.select("doc_id", F.array_join(T.words(F.col("text")), " ").alias("text"), F.lit(False).alias("fused"))
    return phrases.find(texts, surfaces, longest).select("doc_id", "at", "n", "surface")


@pack.query("documents", "benchmark", sql=f"WITH {_PHRASES}, {_FOUND} SELECT doc_id, sum(n)::BIGINT AS words, count(*) AS n_matches FROM (SELECT doc_id, pos, max(n) AS n FROM o GROUP BY ALL) GROUP BY doc_id")
def dict_candidates(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Longest dictionary match at each place, counted for each document."""
    longest = occurrences(documents, dictionary(benchmark)).groupBy("doc_id", "at").agg(F.max("n").alias("n"))
    return longest.groupBy("doc_id").agg(F.sum("n").alias("words"), F.count("*").alias("n_matches"))


_SWEPT = f"""RECURSIVE {_PHRASES}, {_FOUND}, l AS (SELECT doc_id, pos - 1 AS p0, max(n) AS n, arg_max(surface, n) AS surface FROM o GROUP BY doc_id, pos),
    x AS (SELECT l.*, k.p0 AS following FROM l ASOF LEFT JOIN (SELECT doc_id, p0 FROM l) k ON l.doc_id = k.doc_id AND l.p0 + l.n <= k.p0),
    r AS (SELECT * FROM x WHERE (doc_id, p0) IN (SELECT (doc_id, min(p0)) FROM x GROUP BY doc_id) UNION ALL SELECT x.* FROM r JOIN x ON r.doc_id = x.doc_id AND r.following = x.p0)"""


@pack.query("documents", "benchmark", sql=f"WITH {_SWEPT} SELECT doc_id, p0::INT AS \"at\", n::INT AS n, surface FROM r")
def dict_longest_match(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Dictionary matches from left to right: of those that begin first the longest, then none that overlaps it."""
    return occurrences(documents, dictionary(benchmark), longest=True)


@pack.query("documents", "benchmark", sql=f"WITH {_SWEPT} SELECT item_id, count(*) AS n_matches, count(DISTINCT doc_id) AS documents FROM r JOIN pl USING (surface) GROUP BY item_id")
def dict_payloads(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What the kept matches stand for: all items of a surface count."""
    found = occurrences(documents, dictionary(benchmark), longest=True).groupBy("surface", "doc_id").agg(F.count("*").alias("c"))
    named = found.join(payloads(benchmark).select("item_id", "surface"), "surface")
    return named.groupBy("item_id").agg(F.sum("c").alias("n_matches"), F.count_distinct("doc_id").alias("documents"))


@pack.query(
    "documents", "benchmark",
    sql=f"""WITH {_PHRASES}, {_FOUND}, common AS (SELECT word FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM d) GROUP BY 1 HAVING count(*) > 0.05 * (SELECT count(*) FROM documents))
    SELECT surface, count(DISTINCT doc_id) AS documents, count(*) AS n_matches FROM o WHERE n > 1 OR surface NOT IN (SELECT word FROM common) GROUP BY surface""",
)
def trend_match(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Trend terms found in documents; everyday words don't count by themselves."""
    total = documents.agg(F.count("*").alias("total"))
    words = documents.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("surface"))
    common = words.groupBy("surface").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).filter("c > 0.05 * total").select("surface", F.lit(1).alias("n"))
    found = occurrences(documents, dictionary(benchmark)).join(common, ["surface", "n"], "left_anti")
    return found.groupBy("surface").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("n_matches"))


@pack.query(
    "documents", "benchmark",
    sql=f"""WITH {_PHRASES}, total AS (SELECT count(*) AS t FROM benchmark), df AS (SELECT word, count(DISTINCT item_id) AS c FROM (SELECT item_id, unnest({_WORDS}) AS word FROM benchmark) GROUP BY 1),
    common AS (SELECT word FROM df, total WHERE c > 0.3 * t), stop AS (SELECT word FROM df, total WHERE c > 0.8 * t), first AS (SELECT item_id, array_to_string({_WORDS}[1:1], '') AS label, length(text) AS links FROM benchmark),
    q AS (SELECT pl.*, links, string_split(surface, ' ') AS ws, surface = label AS is_label FROM pl JOIN first USING (item_id)),
    li AS (SELECT coalesce((SELECT list(word) FROM stop), []) AS ls, coalesce((SELECT list(word) FROM common), []) AS lc),
    f AS (SELECT q.*, len(list_filter(ws, lambda x: NOT list_contains(ls, x))) = 0 AS stops, len(list_filter(ws, lambda x: NOT list_contains(lc, x))) = 0 AS ordinary FROM q, li),
    k AS (SELECT surface, item_id, links, n = 1 OR ordinary AS name_only FROM f WHERE n <= 5 AND length(replace(surface, ' ', '')) >= 4 AND len(list_filter(ws, lambda x: length(x) >= 3)) > 0 AND NOT stops
      AND NOT (n = 1 AND (ordinary OR (item_id % 2 = 0 AND NOT is_label))) AND NOT (n > 1 AND ordinary AND NOT is_label))
    SELECT surface, item_id AS owner, name_only FROM k QUALIFY row_number() OVER (PARTITION BY surface ORDER BY links DESC, item_id) = 1""",
)
def gazetteer(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The surfaces that a dictionary of named things keeps, and the best-known item of each: none of stop words alone, no single common word, no bare part
    of a person's name, no phrase of ordinary words that isn't the item's own label; which ones count in names only."""
    words = benchmark.select("item_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    rated = words.crossJoin(F.broadcast(benchmark.agg(F.count("*").alias("t")))).select("word", (F.col("c") > 0.3 * F.col("t")).alias("common"), (F.col("c") > 0.8 * F.col("t")).alias("stop"))  # one row of totals
    items = benchmark.select("item_id", F.get(T.words(F.col("text")), F.lit(0)).alias("label"), F.length("text").alias("links"))
    rows = payloads(benchmark).join(items, "item_id").withColumn("is_label", F.col("surface") == F.col("label"))
    judged = rows.select("surface", "n", F.explode(F.split("surface", " ")).alias("word")).distinct().join(rated, "word").groupBy("surface").agg(F.bool_and("stop").alias("stops"), F.bool_and("common").alias("ordinary"), F.max(F.length("word")).alias("longest"))
    rows = rows.join(judged, "surface").filter((F.col("n") <= 5) & (F.length(F.replace("surface", F.lit(" "), F.lit(""))) >= 4) & (F.col("longest") >= 3) & ~F.col("stops"))
    single, person = F.col("n") == 1, F.col("item_id") % 2 == 0
    rows = rows.filter(~(single & (F.col("ordinary") | (person & ~F.col("is_label")))) & ~(~single & F.col("ordinary") & ~F.col("is_label")))
    best = F.min_by(F.struct(F.col("item_id").alias("owner"), (single | F.col("ordinary")).alias("name_only")), F.struct(-F.col("links"), F.col("item_id"))).alias("b")
    return rows.groupBy("surface").agg(best).select("surface", "b.owner", "b.name_only")


_VARIANTS = """n AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' two' WHEN 2 THEN 's' ELSE 'x' END AS name, CASE WHEN p_partkey % 3 = 0 THEN upper(left(split_part(p_name, ' ', 2), 4)) ELSE 'ZZZ' END AS ticker FROM part)"""


@pack.query(
    "part",
    sql=f"""WITH {_VARIANTS}, i AS (SELECT DISTINCT p_name AS item, replace(p_name, ' ', '') AS y, upper(left(split_part(p_name, ' ', 2), 4)) || length(split_part(p_name, ' ', 1)) AS symbol FROM part),
    u AS (SELECT DISTINCT name, replace(name, ' ', '') AS x, ticker || length(split_part(name, ' ', 1)) AS ticker FROM n), c AS (SELECT * FROM u, i),
    lc AS (SELECT *, list_last(list_reduce(list_transform(string_split(x, ''), lambda c: [ascii(c)::BIGINT]), lambda acc, c: list_reduce(list_transform(range(1, length(y) + 1), lambda j: [j::BIGINT]),
        lambda row, j: list_append(row, CASE WHEN ascii(y[j[1]]) = c[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], row[j[1]]) END), [0::BIGINT]), list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT))) AS common FROM c),
    g AS (SELECT name, ticker, item, CASE WHEN x = y THEN 0.85 WHEN length(y) >= 4 AND contains(x, y) AND length(x) <= length(y) + 12 THEN 0.55 WHEN length(x) >= 4 AND 2.0 * common / (length(x) + length(y)) >= 0.86 THEN 0.5 ELSE 0 END AS by_name,
        CASE WHEN ticker = symbol THEN 0.75 ELSE 0 END AS by_ticker FROM lc),
    k AS (SELECT name, ticker, item, 1 - (1 - by_name) * (1 - by_ticker) AS s FROM g WHERE (by_name > 0 OR by_ticker > 0) AND (1 - (1 - by_name) * (1 - by_ticker) >= 0.7 OR (by_name > 0 AND by_ticker > 0) OR by_name = 0.85)),
    t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY name, ticker ORDER BY round(s, 8) DESC, item) <= 5)
    SELECT p_partkey, item, round(s, 6) AS score FROM n JOIN t ON n.name = t.name AND n.ticker || length(split_part(n.name, ' ', 1)) = t.ticker""",
)
def known_item_match(part: DataFrame) -> DataFrame:
    """Names and tickers matched with known items: the same ticker, and the best of equal, contained and close names; signals combine, weak single ones go, five items at most for each name.

    Distinct names are matched, not rows. Contained names are found by an automaton of all names, close spellings through rare pairs of letters, so no two lists are crossed.
    """
    rest = F.col("p_partkey") % 4
    noun = lambda c: F.upper(F.left(F.split_part(c, F.lit(" "), F.lit(2)), F.lit(4)))
    size = lambda c: F.length(F.split_part(c, F.lit(" "), F.lit(1))).cast("string")
    rows = part.select("p_partkey", F.concat("p_name", F.when(rest == 0, "").when(rest == 1, " two").when(rest == 2, "s").otherwise("x")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, noun(F.col("p_name"))).otherwise("ZZZ").alias("ticker"))
    rows = rows.withColumn("ticker", F.concat("ticker", size(F.col("name"))))
    names = rows.select("name", "ticker").distinct().withColumn("x", F.replace("name", F.lit(" "), F.lit("")))
    items = part.select(F.col("p_name").alias("item")).distinct().select("item", F.replace("item", F.lit(" "), F.lit("")).alias("y"), F.concat(noun(F.col("item")), size(F.col("item"))).alias("symbol"))
    compacts = names.select("x").distinct()
    held = phrases.find(compacts.select("x", F.col("x").alias("text"), F.lit(True).alias("fused")), items.select(F.col("y").alias("surface"))).select("x", F.col("surface").alias("y")).distinct()
    contained = held.join(items, "y").filter((F.length("x") <= F.length("y") + 12) & (F.length("y") >= 4)).select("x", "item", F.when(F.col("x") == F.col("y"), 0.85).otherwise(0.55).alias("w"))
    spelled = compacts.select(F.lit("").alias("p_type"), F.col("x").alias("name")).union(items.select(F.lit(""), "y"))
    close = close_pairs(spelled, 0.86)
    close = close.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))).filter("length(x) >= 4")
    close = close.join(compacts, "x", "left_semi").join(items, "y").select("x", "item", F.lit(0.5).alias("w"))
    by_name = contained.unionByName(close).groupBy("x", "item").agg(F.max("w").alias("by_name")).join(names, "x").select("name", "ticker", "item", "by_name")
    by_ticker = names.join(items, F.col("ticker") == F.col("symbol")).select("name", "ticker", "item", F.lit(0.75).alias("by_ticker"))
    both = by_name.join(by_ticker, ["name", "ticker", "item"], "full").fillna(0.0, ["by_name", "by_ticker"]).withColumn("s", 1 - (1 - F.col("by_name")) * (1 - F.col("by_ticker")))
    both = both.filter((F.col("s") >= 0.7) | ((F.col("by_name") > 0) & (F.col("by_ticker") > 0)) | (F.col("by_name") == 0.85))
    best = both.withColumn("n", F.row_number().over(Window.partitionBy("name", "ticker").orderBy(F.round("s", 8).desc(), "item"))).filter("n <= 5")
    return rows.join(best.select("name", "ticker", "item", "s"), ["name", "ticker"]).select("p_partkey", "item", F.round("s", 6).alias("score"))


@pack.query(
    "labels", "documents",
    sql="""
    WITH p AS (SELECT doc_id, CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END AS quality, CASE WHEN regexp_matches(text, '(?i)idiot|stupid|trash|loser') THEN 1 ELSE 0 END AS toxic FROM documents),
    l AS (SELECT l.doc_id, 'quality' AS label, l.quality AS gold, p.quality AS pred FROM labels l JOIN p USING (doc_id) UNION ALL SELECT l.doc_id, 'toxic', l.toxic, p.toxic FROM labels l JOIN p USING (doc_id)),
    c AS (SELECT label, count(*) FILTER (WHERE gold = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE gold = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND pred = 0) AS fn FROM l GROUP BY label),
    a AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c)
    SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM a""",
)
def precision_recall(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Gold against predicted labels: true and false positives, misses, precision and recall, by label and overall."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    p = documents.select("doc_id", flag(F.col("n_chars") >= 2000).alias("p_quality"), flag(F.col("text").rlike("(?i)idiot|stupid|trash|loser")).alias("p_toxic"))
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("gold"), F.col(f"p_{n}").alias("pred")) for n in ("quality", "toxic")])
    rows = labels.join(p, "doc_id").select(F.inline(pairs))
    counts = rows.groupBy("label").agg(
        F.count_if((F.col("gold") == 1) & (F.col("pred") == 1)).alias("tp"),
        F.count_if((F.col("gold") == 0) & (F.col("pred") == 1)).alias("fp"),
        F.count_if((F.col("gold") == 1) & (F.col("pred") == 0)).alias("fn"),
    )
    micro = counts.agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")]).select(F.lit("micro").alias("label"), "tp", "fp", "fn")
    share = lambda other: F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), 6)
    return counts.unionByName(micro).select("label", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))
