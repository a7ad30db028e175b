"""Posts matched with what they may be about.

Roles on the driver's tables: a conversation's first turn names something (its first three words the name, the first of them the ticker); the other turns are posts, some with the
ticker as a cashtag or hashtag, some with the name in one word, one with a letter missing. Null texts name nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import matching as M
from loomwright.operators.noisy_or import noisy_or
from loomwright.plans.likeness import partial_sql
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: Weights of name and ticker, and from which fit a post matches or partly does. Share of turns that have an everyday word.
NAME, TICKER, MATCH, PARTIAL, EVERYDAY = 0.85, 0.55, 0.6, 0.2, 0.05
NAME_WORDS = 3


def everyday_words(conversations: DataFrame) -> DataFrame:
    """Words of more than a twentieth of all turns; rows of the same turn count a word once."""
    total = conversations.agg(F.count("*").alias("total"))  # one row
    words = conversations.select("conv_id", "turn", F.explode(F.array_distinct(M.tokens(F.col("text")))).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    return words.crossJoin(F.broadcast(total)).filter(F.col("n") > EVERYDAY * F.col("total")).select("word")


def named(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, name (tokens), ticker and post of every turn but the first."""
    first = conversations.filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("said"))
    rows = conversations.filter("turn > 0").join(first, "conv_id")
    name = F.slice(M.tokens(F.col("said")), 1, NAME_WORDS)
    rows = rows.select("conv_id", "turn", "text", name.alias("name")).withColumn("ticker", M.upper(F.get("name", F.lit(0))))
    which, compact = (F.col("conv_id") + F.col("turn")) % 5, F.array_join("name", "")
    more = F.when(which == 1, F.concat(F.lit(" $"), "ticker")).when(which == 2, F.concat(F.lit(" #"), "ticker")).when(which == 3, F.concat(F.lit(" "), compact)).when(which == 4, F.concat(F.lit(" x"), F.substring(compact, 2, 1 << 30))).otherwise("")
    return rows.select("conv_id", "turn", "name", "ticker", F.concat(F.coalesce("text", F.lit("")), F.coalesce(more, F.lit(""))).alias("post"))


def verdicts(rows: DataFrame, everyday: DataFrame) -> DataFrame:
    """``rows`` (name, ticker, post) with name_how, name_score, ticker_how, ticker_score, run, fit and verdict.

    Only posts that name nothing otherwise are sought for something like the name, near unchanged pieces of it.
    """
    rows = rows.withColumn("post_tokens", M.tokens(F.col("post")))
    rows = rows.join(everyday.select(M.upper(F.col("word")).alias("ticker"), F.lit(True).alias("common")).groupBy("ticker").agg(F.max("common").alias("common")), "ticker", "left")
    rows = rows.withColumn("plain", M.name_match(F.col("name"), F.col("post_tokens")))
    wanting = (F.col("plain.score") == 0) & (F.length(F.array_join("name", "")) >= M.FUZZY_LETTERS)
    rows = rows.withColumn("fuzzy", M.fuzzy_part(F.when(wanting, F.array_join("name", "")), F.when(wanting, F.array_join("post_tokens", ""))))
    rows = rows.withColumn("n", M.name_match(F.col("name"), F.col("post_tokens"), F.coalesce("fuzzy", F.lit(0.0))))
    rows = rows.withColumn("t", M.ticker_match(F.col("ticker"), F.col("post"), F.coalesce("common", F.lit(False))))
    rows = rows.withColumn("fit", noisy_or([(NAME, F.col("n.score")), (TICKER, F.col("t.score"))]))
    verdict = F.when(F.col("fit") >= MATCH - 1e-9, "match").when(F.col("fit") >= PARTIAL - 1e-9, "partial").otherwise("none")
    return rows.withColumns({
        "name_how": F.col("n.how"), "name_score": F.col("n.score"), "ticker_how": F.col("t.how"), "ticker_score": F.col("t.score"), "run": M.longest_run(F.col("name"), F.col("post_tokens")), "verdict": verdict,
    }).drop("n", "t", "plain", "fuzzy", "post_tokens", "common")


_STOP = ", ".join(f"'{w}'" for w in M.STOP)
_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


@pack.query(
    "conversations",
    sql=rf"""WITH fi AS (SELECT conv_id, min(text) AS said FROM conversations WHERE turn = 0 GROUP BY conv_id),
    na AS (SELECT c.conv_id, turn, text, {_TOKENS.format('said')}[1:{NAME_WORDS}] AS name, upper({_TOKENS.format('said')}[1]) AS ticker FROM conversations c JOIN fi USING (conv_id) WHERE turn > 0),
    po AS (SELECT conv_id, turn, name, ticker, array_to_string(name, '') AS compact, coalesce(text, '') || coalesce(CASE (conv_id + turn) % 5 WHEN 1 THEN ' $' || ticker WHEN 2 THEN ' #' || ticker WHEN 3 THEN ' ' || array_to_string(name, '') WHEN 4 THEN ' x' || array_to_string(name, '')[2:] ELSE '' END, '') AS post FROM na),
    ev AS (SELECT upper(word) AS word FROM (SELECT DISTINCT conv_id, turn, unnest({_TOKENS.format('text')}) AS word FROM conversations) GROUP BY word HAVING count(*) > {EVERYDAY} * (SELECT count(*) FROM conversations)),
    pt AS (SELECT *, {_TOKENS.format('post')} AS p FROM po), pf AS (SELECT *, ' ' || array_to_string(p, ' ') || ' ' AS flat, list_distinct(list_filter(name, lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) AS words,
      list_transform(regexp_extract_all(post, '\$([A-Za-z][A-Za-z0-9]*)', 1), lambda x: upper(x)) AS cash, list_transform(regexp_extract_all(post, '#([\p{{L}}\p{{N}}_]+)', 1), lambda x: upper(x)) AS tags, regexp_extract_all(post, '[\p{{L}}\p{{N}}]+') AS raw FROM pt),
    sc AS (SELECT *, len(list_intersect(words, p)) AS hits, length(array_to_string(name, ' ')) >= {M.EXACT_LETTERS} AND contains(flat, ' ' || array_to_string(name, ' ') || ' ') AS is_exact,
      length(compact) >= {M.FUSED_LETTERS} AND regexp_matches(flat, ' ' || array_to_string(string_split(compact, ''), ' ?') || ' ') AS is_fused FROM pf),
    fz AS (SELECT DISTINCT compact AS a, array_to_string(p, '') AS b FROM sc WHERE NOT is_exact AND NOT is_fused AND hits = 0 AND length(compact) >= {M.FUZZY_LETTERS} AND len(p) > 0), {partial_sql('fz', M.FUZZY_LIKE)},
    nm AS (SELECT sc.*, ratio, CASE WHEN is_exact THEN 'exact' WHEN is_fused THEN 'fused' WHEN hits > 0 THEN 'words' WHEN ratio IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS name_how,
      CASE WHEN is_exact THEN {M.EXACT} WHEN is_fused THEN {M.FUSED} WHEN hits > 0 AND hits = len(words) THEN {M.ALL_WORDS} WHEN hits > 0 THEN round({M.SOME_WORDS}::DOUBLE * hits / len(words), 3) WHEN ratio IS NOT NULL THEN round({M.FUZZY}::DOUBLE * ratio, 3) ELSE 0.0 END::DOUBLE AS name_score,
      CASE WHEN coalesce(ticker, '') = '' THEN 'none' WHEN list_contains(cash, ticker) THEN 'cashtag' WHEN list_contains(tags, ticker) THEN 'hashtag'
        WHEN length(ticker) >= {M.BARE_LETTERS} AND len(list_filter(raw, lambda w: upper(w) = ticker AND (w = upper(w) OR NOT common))) > 0 THEN 'bare' WHEN length(ticker) >= {M.ONE_OFF_LETTERS} AND len(list_filter(cash, lambda c: levenshtein(c, ticker) = 1)) > 0 THEN 'one off' ELSE 'none' END AS ticker_how
      FROM (SELECT *, ticker IN (SELECT word FROM ev) AS common FROM sc) sc LEFT JOIN pr ON NOT is_exact AND NOT is_fused AND hits = 0 AND a = compact AND b = array_to_string(p, '')),
    ft AS (SELECT *, CASE ticker_how WHEN 'cashtag' THEN {M.CASHTAG} WHEN 'hashtag' THEN {M.HASHTAG} WHEN 'bare' THEN {M.BARE} WHEN 'one off' THEN {M.ONE_OFF} ELSE 0.0 END::DOUBLE AS ticker_score FROM nm),
    fs AS (SELECT *, 1 - (1 - {NAME}::DOUBLE * name_score) * (1 - {TICKER}::DOUBLE * ticker_score) AS fit FROM ft)
    SELECT conv_id, turn, name_how, name_score, ticker_how, ticker_score, round(fit, 6) AS fit, CASE WHEN fit >= {MATCH} - 1e-9 THEN 'match' WHEN fit >= {PARTIAL} - 1e-9 THEN 'partial' ELSE 'none' END AS verdict,
      coalesce(list_max(list_filter(range(1, len(name) + 1), lambda n: len(list_filter(range(1, len(name) - n + 2), lambda k: contains(flat, ' ' || array_to_string(name[k : k + n - 1], ' ') || ' '))) > 0)), 0)::INT AS run FROM fs""",
)
def post_matches(conversations: DataFrame) -> DataFrame:
    """How each post names what its conversation is about, how well it fits, and the verdict."""
    found = verdicts(named(conversations), everyday_words(conversations))
    return found.select("conv_id", "turn", "name_how", "name_score", "ticker_how", "ticker_score", M.rounded(F.col("fit"), 6).alias("fit"), "verdict", "run")
