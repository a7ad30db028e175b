"""Names and tickers that resemble a part of something longer.

Roles on the driver's tables: a part's words are tickers and names, written with a letter dropped; its compact name, with brand or type, is the longer text.
Null names give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import REST, compact
from loomwright.operators.partial import partial_pairs
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: How like a ticker must be, and how like a name; letters of either at least.
TICKER_LIKE, NAME_LIKE, TICKER_LETTERS, NAME_LETTERS = 0.85, 0.88, 3, 5


def common_sql(x: str, y: str) -> str:
    """DuckDB SQL for the length of the longest common subsequence of two ASCII texts."""
    return f"""list_last(list_reduce(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT]), lambda acc, c: list_reduce(list_transform(range(1, length({y}) + 1), lambda j: [j::BIGINT]),
        lambda row, j: list_append(row, CASE WHEN ascii({y}[j[1]]) = c[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], row[j[1]]) END), [0::BIGINT]), list_transform(range(0, length({y}) + 1), lambda j: 0::BIGINT)))"""


def partial_sql(pairs: str, least: float) -> str:
    """DuckDB CTEs from ``pairs`` (a, b) to ``pr`` (a, b, ratio): every window of the longer text, both ways round for equal lengths."""
    return f"""di AS (SELECT a, b, a AS x, b AS y FROM {pairs} WHERE length(a) <= length(b) UNION ALL SELECT a, b, b, a FROM {pairs} WHERE length(a) >= length(b)),
    wi AS (SELECT a, b, x, unnest(list_transform(range(2 - length(x), length(y) + 1), lambda s: substr(y, greatest(1, s)::BIGINT, (least(length(y), s + length(x) - 1) - greatest(1, s) + 1)::BIGINT))) AS w FROM di),
    lk AS (SELECT DISTINCT x, w FROM wi), lc AS (SELECT x, w, 2.0 * {common_sql('x', 'w')} / (length(x) + length(w)) AS ratio FROM lk),
    pr AS (SELECT a, b, max(ratio) AS ratio FROM wi JOIN lc USING (x, w) GROUP BY ALL HAVING max(ratio) >= {least} - 1e-9)"""


_NOUN = "split_part(p_name, ' ', 2)"
_DROPPED = f"left({_NOUN}, (p_partkey % length({_NOUN}))::BIGINT) || substr({_NOUN}, (p_partkey % length({_NOUN}) + 2)::BIGINT)"


@pack.query(
    "part",
    sql=f"""WITH t AS (SELECT DISTINCT {_DROPPED} AS a FROM part WHERE length({_NOUN}) > {TICKER_LETTERS}), n AS (SELECT DISTINCT replace(p_name, ' ', '') AS b FROM part), ps AS (SELECT * FROM t, n), {partial_sql('ps', TICKER_LIKE)}
    SELECT a AS ticker, b AS name, round(ratio, 4) AS ratio FROM pr""",
)
def fuzzy_tickers(part: DataFrame) -> DataFrame:
    """Tickers of three letters or more and the names that have a part like them, at 0.85 or more."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    at = (F.col("p_partkey") % F.length(noun)).cast("int")
    dropped = F.concat(F.left(noun, at), F.substring(noun, at + 2, F.lit(REST)))
    tickers = part.filter(F.length(noun) > TICKER_LETTERS).select(dropped.alias("a"))
    names = part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("b"))
    return partial_pairs(tickers, names, TICKER_LIKE).select(F.col("a").alias("ticker"), F.col("b").alias("name"), F.round("ratio", 4).alias("ratio"))


_TYPED = "regexp_replace(lower(p_type || p_name), '[^a-z0-9]', '', 'g')"
_CUT = "replace(p_name, ' ', '')[2:]"


@pack.query(
    "part",
    sql=f"""WITH t AS (SELECT DISTINCT {_CUT} AS a FROM part WHERE length({_CUT}) >= {NAME_LETTERS}), n AS (SELECT DISTINCT {_TYPED} AS b FROM part), ps AS (SELECT * FROM t, n), {partial_sql('ps', NAME_LIKE)}
    SELECT a AS name, b AS text, round(ratio, 4) AS ratio FROM pr""",
)
def partial_names(part: DataFrame) -> DataFrame:
    """Names of five letters or more that lack their first, and the longer texts that have a part like them, at 0.88 or more."""
    cut = F.substring(F.replace("p_name", F.lit(" "), F.lit("")), 2, REST)
    names = part.filter(F.length(cut) >= NAME_LETTERS).select(cut.alias("a"))
    texts = part.select(compact(F.concat("p_type", "p_name")).alias("b"))
    return partial_pairs(names, texts, NAME_LIKE).select(F.col("a").alias("name"), F.col("b").alias("text"), F.round("ratio", 4).alias("ratio"))
