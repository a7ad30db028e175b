"""Signals around an item: the post or account it links, news outlets, pairs it trades against, pruning of weak evidence, flags and a summary.

Roles on the driver's tables: an order is an item, its customer the account behind the link; order lines are evidence; pages are posts and articles. Missing facts
are null and never raise a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.plans.evidence import _EVIDENCE, evidence
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: Followers of a large account, days that an account counts as fresh, and days within which a post counts as news.
LARGE, FRESH_DAYS, NEWS_DAYS = 9000, 30, 3

_LINKED = f"""i AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'profile' WHEN 4 THEN 'community' ELSE 'tweet' END AS kind, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'ok' END AS status,
      c_acctbal >= {LARGE} AS big, o_orderstatus = 'O' AS names_it, (o_orderkey % 9) - 2 AS gap_days, (o_custkey % 800) - 5 AS account_days FROM orders JOIN customer ON o_custkey = c_custkey)"""
_RELATED = """CASE WHEN kind = 'search' THEN 'search_only' WHEN kind = 'community' OR status != 'ok' THEN NULL WHEN kind = 'profile' THEN CASE WHEN big AND account_days > 365 THEN 'narrative_reference' ELSE 'official_account' END
      WHEN gap_days > 0 AND NOT (names_it AND NOT big) THEN 'narrative_reference' WHEN names_it THEN 'official_account' ELSE 'launch_announcement' END"""


def linked_items(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """o_orderkey, kind of link, status, and facts of the account: large, names the item, days between post and item, age."""
    k = F.col("o_orderkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.when(k % 5 == 0, "search").when(k % 5 == 1, "profile").when(k % 5 == 4, "community").otherwise("tweet").alias("kind"),
        F.when(k % 11 == 0, "deleted").when(k % 13 == 0, "failed").otherwise("ok").alias("status"), (F.col("c_acctbal") >= LARGE).alias("big"),
        (F.col("o_orderstatus") == "O").alias("names_it"), (k % 9 - 2).alias("gap_days"), (F.col("o_custkey") % 800 - 5).alias("account_days"),
    )


def relation() -> Column:
    """What a link is to the item: a search only, someone else's story, the item's own account, or its launch. Null where nothing is known."""
    kind, big = F.col("kind"), F.col("big")
    profile = F.when(big & (F.col("account_days") > 365), "narrative_reference").otherwise("official_account")
    borrowed = (F.col("gap_days") > 0) & ~(F.col("names_it") & ~big)
    return (
        F.when(kind == "search", "search_only").when((kind == "community") | (F.col("status") != "ok"), F.lit(None).cast("string")).when(kind == "profile", profile)
        .when(borrowed, "narrative_reference").when(F.col("names_it"), "official_account").otherwise("launch_announcement")
    )


@pack.query(
    "orders", "customer",
    sql=f"""WITH {_LINKED}, r AS (SELECT *, {_RELATED} AS relation FROM i) SELECT o_orderkey, kind, relation, CASE WHEN kind = 'tweet' AND relation = 'narrative_reference' THEN CASE WHEN gap_days < {NEWS_DAYS} THEN 0.45 ELSE 0.25 END END AS timing,
      CASE WHEN kind = 'tweet' AND status = 'ok' AND names_it THEN 0.3 END AS mention FROM r""",
)
def link_relations(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """How each item stands to what it links, with the weight of the post's timing and of a post that names the item."""
    rows = linked_items(orders, customer).withColumn("relation", relation())
    tweet = F.col("kind") == "tweet"
    timing = F.when(tweet & (F.col("relation") == "narrative_reference"), F.when(F.col("gap_days") < NEWS_DAYS, 0.45).otherwise(0.25))
    return rows.select("o_orderkey", "kind", "relation", timing.alias("timing"), F.when(tweet & (F.col("status") == "ok") & F.col("names_it"), 0.3).alias("mention"))


#: Flags as code, severity, rule and detail, in Spark's and DuckDB's common SQL.
FLAGS = (
    ("search_link_only", "info", "kind = 'search'", "'the link is a search, not an account'"),
    ("post_deleted", "warn", "kind = 'tweet' AND status = 'deleted'", "'the linked post no longer exists'"),
    ("account_suspended", "warn", "kind = 'profile' AND status = 'deleted'", "'the linked account does not exist'"),
    ("borrowed_narrative", "info", "relation = 'narrative_reference' AND big", "'a large account that is not the launcher'"),
    ("fresh_account", "info", "kind IN ('tweet', 'profile') AND status = 'ok' AND account_days <= 30 AND NOT big", "CONCAT('account made ', CAST(ABS(account_days) AS STRING), CASE WHEN account_days < 0 THEN ' d after' ELSE ' d before' END)"),
    ("old_story", "info", "relation = 'narrative_reference' AND gap_days >= 3", "CONCAT('the post is ', CAST(gap_days AS STRING), ' d older')"),
    ("not_fetched", "info", "kind = 'community' OR (kind != 'search' AND status = 'failed')", "'nothing is known of the link'"),
)


@pack.query(
    "orders", "customer",
    sql=f"WITH {_LINKED}, r AS (SELECT *, {_RELATED} AS relation FROM i) " + " UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS code, '{s}' AS severity, {d} AS detail FROM r WHERE {r}" for c, s, r, d in FLAGS),
)
def link_flags(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Flags of an item's link with severity and detail: all rules in one pass over the items."""
    rows = linked_items(orders, customer).withColumn("relation", relation())
    raised = [F.when(F.expr(rule), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.expr(detail).alias("detail"))) for code, severity, rule, detail in FLAGS]
    return rows.select("o_orderkey", F.explode(F.array_compact(F.array(*raised))).alias("f")).select("o_orderkey", "f.code", "f.severity", "f.detail")


LEAST_OUTLETS, EVERYDAY_OUTLETS = 3, 6


@pack.query(
    "pages",
    sql=f"""WITH p AS (SELECT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS outlet, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages),
    w AS (SELECT outlet, list_transform(range(1, len(x)), lambda k: x[k] || ' ' || x[k + 1]) AS pairs FROM (SELECT outlet, regexp_extract_all(title, '[a-z]{{2,}}') AS x FROM p))
    SELECT phrase, count(DISTINCT outlet) AS outlets, count(*) AS posts FROM (SELECT outlet, unnest(pairs) AS phrase FROM w) GROUP BY phrase HAVING count(DISTINCT outlet) >= {LEAST_OUTLETS}""",
)
def named_by_outlets(pages: DataFrame) -> DataFrame:
    """Phrases of two words that the titles of at least three outlets have; one outlet that repeats itself is one."""
    outlet = F.lower(F.regexp_extract("url", "://([^/?#]+)", 1))
    x = F.regexp_extract_all(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("[a-z]{2,}"), 0)
    pairs = F.when(F.size("x") > 1, F.transform(F.sequence(F.lit(0), F.size("x") - 2), lambda k: F.concat_ws(" ", F.get("x", k), F.get("x", k + 1))))
    phrases = pages.select(outlet.alias("outlet"), x.alias("x")).select("outlet", F.explode(pairs).alias("phrase"))
    # First by outlet too, so that one outlet's rows are combined before they are counted.
    by_outlet = phrases.groupBy("phrase", "outlet").agg(F.count("*").alias("c"))
    return by_outlet.groupBy("phrase").agg(F.count("*").alias("outlets"), F.sum("c").alias("posts")).filter(F.col("outlets") >= LEAST_OUTLETS)


@pack.query(
    "pages",
    sql="""WITH t AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS author, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
    w AS (SELECT page_id, author, string_split(title, ' ') AS ws FROM t), c AS (SELECT page_id, author, unnest(ws) AS word, unnest(range(0, len(ws))) AS place FROM w),
    k AS (SELECT *, CASE WHEN regexp_matches(word, '^[A-Z][a-z]{2,}$') THEN 2 WHEN regexp_matches(word, '^[a-z]{4,}$') THEN 1 ELSE 0 END AS strength FROM c)
    SELECT page_id, author, word AS subject, strength FROM k WHERE strength > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY strength DESC, place) = 1""",
)
def post_subject(pages: DataFrame) -> DataFrame:
    """The best candidate for what a post is about: a proper word before a plain one, the first of equals."""
    author = F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("author")
    words = pages.select("page_id", author, F.posexplode(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ")).alias("at", "word"))
    strength = F.when(F.col("word").rlike("^[A-Z][a-z]{2,}$"), 2).when(F.col("word").rlike("^[a-z]{4,}$"), 1).otherwise(0)
    ranked = words.withColumn("strength", strength).filter("strength > 0")
    best = F.min_by(F.struct("word", "strength"), F.struct(-F.col("strength"), F.col("at"))).alias("b")
    return ranked.groupBy("page_id", "author").agg(best).select("page_id", "author", F.col("b.word").alias("subject"), F.col("b.strength").alias("strength"))


@pack.query(
    "part",
    sql="""WITH p AS (SELECT p_partkey, p_name, upper(left(split_part(p_name, ' ', 2), 4)) AS ticker, replace(p_name, ' ', '') AS compact, string_split(p_name, ' ') AS tokens FROM part),
    j AS (SELECT a.p_partkey, a.ticker AS t, a.compact AS c, a.tokens AS w, b.ticker AS pt, b.compact AS pc, b.tokens AS pw FROM p a JOIN p b ON b.p_partkey = (a.p_partkey * 7 + 3) % (SELECT count(*) FROM part))
    SELECT p_partkey, CASE WHEN length(pt) >= 3 AND pt = t THEN 'ticker' WHEN length(pt) >= 3 AND t != pt AND contains(t, pt) THEN 'ticker_contains' WHEN length(pt) >= 3 AND list_contains(w, lower(pt)) THEN 'name_contains_ticker'
      WHEN len(list_filter(pw, lambda x: length(x) >= 4 AND list_contains(w, x))) > 0 THEN 'name_word' WHEN length(pc) >= 5 AND contains(c, pc) AND c != pc THEN 'name_contains' END AS builds_on FROM j""",
)
def pairing(part: DataFrame) -> DataFrame:
    """Whether an item's ticker or name builds on that of the item it trades against, and why; the first rule that fits."""
    p = part.select("p_partkey", F.upper(F.left(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(4))).alias("t"), F.replace("p_name", F.lit(" "), F.lit("")).alias("c"), F.split("p_name", " ").alias("w"))
    n = part.agg(F.count("*").alias("n"))
    other = p.select(F.col("p_partkey").alias("against"), F.col("t").alias("pt"), F.col("c").alias("pc"), F.col("w").alias("pw"))
    j = p.crossJoin(F.broadcast(n)).withColumn("against", (F.col("p_partkey") * 7 + 3) % F.col("n")).join(other, "against")  # one row of n
    long = F.length("pt") >= 3
    shared = F.size(F.filter(F.array_intersect("pw", "w"), lambda x: F.length(x) >= 4)) > 0
    why = (
        F.when(long & (F.col("pt") == F.col("t")), "ticker").when(long & (F.col("pt") != F.col("t")) & F.contains("t", "pt"), "ticker_contains").when(long & F.array_contains("w", F.lower("pt")), "name_contains_ticker")
        .when(shared, "name_word").when((F.length("pc") >= 5) & F.contains("c", "pc") & (F.col("c") != F.col("pc")), "name_contains")
    )
    return j.select("p_partkey", why.alias("builds_on"))


@pack.query(
    "lineitem", "part",
    sql=f"""WITH {_EVIDENCE}, x AS (SELECT *, supplier % 4 AS kind FROM e),
    k AS (SELECT item, bool_or(kind = 0) AS marked, bool_or(kind = 1 AND channel != 'A') AS named, bool_or(kind = 2) AS derived, max(CASE WHEN kind = 3 THEN weight END) AS theme, (max(struct_pack(weight := weight, seq := seq, supplier := supplier, leaf := leaf, parent := parent)) FILTER (WHERE kind = 3)).parent AS main FROM x GROUP BY item)
    SELECT item, seq, x.supplier, leaf, round(CASE WHEN x.kind = 0 AND NOT named AND NOT derived THEN 0 WHEN x.kind = 1 AND theme >= 0.3 AND parent != main THEN weight * 0.6 WHEN x.kind = 2 AND source = 'F' THEN weight * 0.55
      WHEN x.kind = 3 AND channel = 'N' AND parent = main THEN least(1, weight * 1.1) WHEN x.kind = 3 AND channel = 'N' THEN weight * 0.85 ELSE weight END, 4) AS weight FROM x JOIN k USING (item) WHERE weight > 0""",
)
def pruned_evidence(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Weights after the pruning rules: a lone marker says nothing unless the item names or derives from something, a homonym counts 0.6 where the item's other
    theme disagrees, mentions count 0.55, a name's head word 1.1 and its modifiers 0.85. The rules look at facts of the item that one aggregation gives."""
    rows = evidence(lineitem, part).withColumn("kind", F.col("supplier") % 4)
    kind, w = F.col("kind"), F.col("weight")
    facts = rows.groupBy("item").agg(
        F.bool_or((kind == 1) & (F.col("channel") != "A")).alias("named"), F.bool_or(kind == 2).alias("derived"), F.max(F.when(kind == 3, w)).alias("theme"),
        F.max(F.when(kind == 3, F.struct("weight", "seq", "supplier", "leaf", "parent")))["parent"].alias("main"),
    )
    j = rows.filter("weight > 0").join(facts, "item")
    same = F.coalesce(F.col("parent") == F.col("main"), F.lit(False))
    weight = (
        F.when((kind == 0) & ~F.col("named") & ~F.col("derived"), 0.0).when((kind == 1) & (F.col("theme") >= 0.3) & ~same, w * 0.6).when((kind == 2) & (F.col("source") == "F"), w * 0.55)
        .when((kind == 3) & (F.col("channel") == "N") & same, F.least(F.lit(1.0), w * 1.1)).when((kind == 3) & (F.col("channel") == "N"), w * 0.85).otherwise(w)
    )
    return j.select("item", "seq", "supplier", "leaf", F.round(weight, 4).alias("weight"))


@pack.query(
    "orders", "customer",
    sql=f"""WITH {_LINKED}, r AS (SELECT *, {_RELATED} AS relation, (o_orderkey % 97) / 97.0 AS score FROM i)
    SELECT o_orderkey, concat_ws(' ', 'Item ' || o_orderkey || CASE WHEN score >= 0.45 THEN ' refers to account ' || (o_orderkey % 10) || ' (confidence ' || printf('%.2f', score + 0.0001) || ').' WHEN relation = 'narrative_reference' THEN ' was launched on a story.' ELSE ': no clear reference found.' END,
      CASE WHEN score < 0.45 AND score >= 0.3 THEN 'Weak guess: account ' || (o_orderkey % 10) || '.' END, CASE WHEN relation IS NOT NULL THEN 'Link: ' || replace(relation, '_', ' ') || '.' END, CASE WHEN status != 'ok' THEN 'Caveat: link ' || status || '.' END) AS summary FROM r""",
)
def summaries(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One paragraph for each item: what it refers to or that nothing is clear, a weak guess, its link, and caveats."""
    rows = linked_items(orders, customer).withColumns({"relation": relation(), "score": (F.col("o_orderkey") % 97) / 97.0})
    k, account, score = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 10).cast("string"), F.col("score")
    head = (
        F.when(score >= 0.45, F.concat(F.lit(" refers to account "), account, F.lit(" (confidence "), F.format_string("%.2f", score + 0.0001), F.lit(").")))
        .when(F.col("relation") == "narrative_reference", " was launched on a story.").otherwise(": no clear reference found.")
    )
    parts = [
        F.concat(F.lit("Item "), k, head), F.when((score < 0.45) & (score >= 0.3), F.concat(F.lit("Weak guess: account "), account, F.lit("."))),
        F.when(F.col("relation").isNotNull(), F.concat(F.lit("Link: "), F.replace("relation", F.lit("_"), F.lit(" ")), F.lit("."))), F.when(F.col("status") != "ok", F.concat(F.lit("Caveat: link "), "status", F.lit("."))),
    ]
    return rows.select("o_orderkey", F.concat_ws(" ", *parts).alias("summary"))


_SELF = """p AS (SELECT p_partkey, p_name, upper(left(split_part(p_name, ' ', 2), 4)) AS ticker, p_partkey % 5 AS k FROM part), i AS (SELECT DISTINCT p_name AS item, upper(left(split_part(p_name, ' ', 2), 4)) AS symbol FROM part),
    n AS (SELECT p_partkey, ticker, CASE k WHEN 0 THEN p_name WHEN 1 THEN p_name || ' 2.0' WHEN 2 THEN 'quiet story' WHEN 3 THEN 'the coin' ELSE split_part(p_name, ' ', 2) || ' army' END AS name FROM p)"""


@pack.query(
    "part",
    sql=f"""WITH {_SELF}, j AS (SELECT n.*, item, symbol, list_filter(string_split(name, ' '), lambda w: length(w) >= 3 AND regexp_matches(w, '^[a-z]+$') AND w NOT IN ('the', 'coin', 'army')) AS ws FROM n JOIN i ON ticker = symbol)
    SELECT p_partkey, item, CASE WHEN name = item THEN 'self' WHEN starts_with(name, item || ' ') THEN 'sequel' WHEN len(ws) > 0 AND len(list_intersect(ws, string_split(item, ' '))) = 0 THEN 'collision' ELSE 'reference' END AS relation,
      round(CASE WHEN name = item THEN 0.8 WHEN starts_with(name, item || ' ') THEN 0.6 WHEN len(ws) > 0 AND len(list_intersect(ws, string_split(item, ' '))) = 0 THEN 0 ELSE 0.6 END, 2) AS inherits FROM j""",
)
def known_item_relation(part: DataFrame) -> DataFrame:
    """How an item stands to a known one with the same ticker: the item itself, a sequel, a reference, or a collision of tickers whose names have no word in common; and the factor at which it inherits."""
    ticker = F.upper(F.left(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(4)))
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" 2.0"))).when(k == 2, "quiet story").when(k == 3, "the coin").otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" army")))
    items = part.select(F.col("p_name").alias("item"), ticker.alias("symbol")).distinct()
    j = part.select("p_partkey", ticker.alias("ticker"), name.alias("name")).join(items, F.col("ticker") == F.col("symbol"))
    words = F.filter(F.split("name", " "), lambda w: (F.length(w) >= 3) & w.rlike("^[a-z]+$") & ~w.isin("the", "coin", "army"))
    apart = (F.size(words) > 0) & ~F.arrays_overlap(words, F.split("item", " "))
    relation = F.when(F.col("name") == F.col("item"), "self").when(F.startswith("name", F.concat("item", F.lit(" "))), "sequel").when(apart, "collision").otherwise("reference")
    return j.select("p_partkey", "item", relation.alias("relation"), F.when(relation == "self", 0.8).when(relation == "collision", 0.0).otherwise(0.6).alias("inherits"))
