"""Aggregation of evidence with all its rules: first rows, parents, backing, channels, hints, caps, siblings, and the main theme.

Roles on the driver's tables: an order is an item, an order line with its part is a row of evidence. Nulls: a row without item, label or weight gives no
evidence. Of rows that repeat, the first in ``seq``, supplier, part and weight order counts. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.noisy_or import AGREES_AT, BONUS, CAP, SIBLING, WITHIN
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: Factor of rows from a description, floor of what is reported, caps of labels that only dictionary rows (and no image) support.
DESCRIPTION, FLOOR, DICTIONARY_CAP, NOUN_CAP = 0.6, 0.2, 0.6, 0.45
#: Kinds that say how large an account is, and kinds that say what a word usually means.
HINTS, DICTIONARY = ("author", "quote"), ("noun",)
#: A label that any noun suggests; a label without a parent; the family whose weaker members count for less, and its member that is exempt.
NOUN_LABEL, NO_PARENT, FAMILY, EXEMPT = "STANDARD", "PROMO/Brand#7", "ECONOMY", "ECONOMY/Brand#1"
#: Order of themes where scores tie; labels that are relation or setting rather than theme.
THEMES, NO_THEME = ("ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"), ("PROMO",)

_ROWS = """r AS (
      SELECT l_orderkey AS item, l_linenumber AS seq, l_suppkey AS supplier, l_partkey AS part, CASE WHEN p_size <= 10 THEN p_type ELSE p_type || '/' || p_brand END AS label,
        CASE l_linenumber % 5 WHEN 0 THEN 'noun' WHEN 1 THEN 'author' WHEN 2 THEN 'quote' WHEN 3 THEN 'entity' ELSE 'rule' END AS kind, (l_suppkey % 3)::VARCHAR AS source,
        CASE WHEN l_suppkey % 11 = 0 THEN 'chain' WHEN l_quantity > 45 THEN 'trend' WHEN l_returnflag = 'A' THEN 'description'
          WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'image' ELSE 'post' END WHEN l_linestatus = 'O' THEN 'symbol' ELSE 'name' END AS place,
        least(1.0, l_discount * 5 + 0.0130007193 + l_partkey * 0.0000001) AS weight
      FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_SCORES = f"""{_ROWS},
    d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item, CASE WHEN kind IN ('author', 'quote') THEN 'size' ELSE kind END, label, source, place ORDER BY seq, supplier, part, weight) = 1),
    b AS (SELECT *, coalesce(bool_or(NOT (kind = 'noun' AND place IN ('description', 'post')) AND split_part(label, '/', 1) = '{NOUN_LABEL}') OVER (PARTITION BY item), false) AS backed FROM d),
    t AS (SELECT item, kind, place, weight * CASE WHEN place = 'description' THEN {DESCRIPTION} ELSE 1 END AS w,
        CASE WHEN place = 'symbol' AND item % 3 = 0 THEN 'name' WHEN place = 'chain' THEN 'db' ELSE place END AS channel,
        unnest(CASE WHEN label LIKE '%/%' AND label != '{NO_PARENT}' THEN [label, split_part(label, '/', 1)] ELSE [label] END) AS label
      FROM b WHERE NOT (kind = 'noun' AND place IN ('description', 'post') AND label = '{NOUN_LABEL}' AND NOT backed)),
    c AS (SELECT item, label, channel, max(w) + {WITHIN} * (1 - product(1 - w) - max(w)) AS s, bool_or(kind NOT IN ('author', 'quote')) AS substantive, bool_or(kind IN ('author', 'quote')) AS hinted,
        bool_or(kind != 'noun') AS named, bool_or(place = 'image') AS pictured, max(w) FILTER (WHERE kind NOT IN ('author', 'quote')) AS top, product(1 - w) FILTER (WHERE kind NOT IN ('author', 'quote')) AS miss
      FROM t WHERE w > 0 GROUP BY ALL),
    n AS (SELECT *, top + {WITHIN} * (1 - miss - top) AS alone FROM c),
    f AS (SELECT item, label, least({CAP}, 1 - product(1 - s) + {BONUS} * least(greatest(count(*) FILTER (WHERE s >= {AGREES_AT} AND substantive) - 1, 0), 2)) AS conf,
        least({CAP}, 1 - coalesce(product(1 - alone), 1) + {BONUS} * least(greatest(count(*) FILTER (WHERE alone >= {AGREES_AT}) - 1, 0), 2)) AS unhinted,
        bool_or(hinted) AS hinted, bool_or(named) AS named, bool_or(pictured) AS pictured, count(*) AS channels FROM n GROUP BY ALL),
    h AS (SELECT *, CASE WHEN hinted AND unhinted < {FLOOR} THEN unhinted ELSE conf END AS v FROM f),
    k AS (SELECT item, label, channels, round(CASE WHEN named THEN v WHEN label = '{NOUN_LABEL}' AND NOT pictured THEN least(v, {NOUN_CAP}) ELSE least(v, {DICTIONARY_CAP}) END, 3) AS score FROM h),
    s AS (SELECT item, label, channels, CASE WHEN label LIKE '{FAMILY}/%' AND label != '{EXEMPT}'
        AND score < max(CASE WHEN label LIKE '{FAMILY}/%' AND label != '{EXEMPT}' THEN score END) OVER (PARTITION BY item) THEN round(score * {SIBLING} + 1e-9, 3) ELSE score END AS score FROM k)"""


def rows_of(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Order lines as evidence: item, seq, supplier, part, label, kind, source, place, weight."""
    line = F.col("l_linenumber") % 5
    kind = F.when(line == 0, "noun").when(line == 1, "author").when(line == 2, "quote").when(line == 3, "entity").otherwise("rule")
    returned = F.when(F.col("l_linestatus") == "O", "image").otherwise("post")
    place = (
        F.when(F.col("l_suppkey") % 11 == 0, "chain").when(F.col("l_quantity") > 45, "trend").when(F.col("l_returnflag") == "A", "description")
        .when(F.col("l_returnflag") == "R", returned).when(F.col("l_linestatus") == "O", "symbol").otherwise("name")
    )
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"),
        F.when(F.col("p_size") <= 10, F.col("p_type")).otherwise(F.concat_ws("/", "p_type", "p_brand")).alias("label"),
        kind.alias("kind"), (F.col("l_suppkey") % 3).cast("string").alias("source"), place.alias("place"),
        F.least(F.lit(1.0), F.col("l_discount") * 5 + 0.0130007193 + F.col("l_partkey") * 0.0000001).alias("weight"),
    )


def channel_of(place, symbol_is_name):
    """The independent input of a row: a symbol that spells the name is the name again, the chain is the database."""
    return F.when((place == "symbol") & symbol_is_name, "name").when(place == "chain", "db").otherwise(place)


def judge(rows: DataFrame, symbol_is_name) -> DataFrame:
    """item, label, channels and score of every label, by all rules but the floor.

    The window by item and both aggregations share one exchange by item, label and channel hash or a coarser one.
    """
    hint, noun = F.col("kind").isin(*HINTS), F.col("kind").isin(*DICTIONARY)
    same = F.when(hint, "size").otherwise(F.col("kind"))
    first = Window.partitionBy("item", same, "label", "source", "place").orderBy("seq", "supplier", "part", "weight")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    weak = noun & F.col("place").isin("description", "post")
    top = F.split_part(F.col("label"), F.lit("/"), F.lit(1))
    backed = F.coalesce(F.bool_or(~weak & (top == NOUN_LABEL)).over(Window.partitionBy("item")), F.lit(False))
    rows = rows.withColumn("_backed", backed).filter(~(weak & (F.col("label") == NOUN_LABEL) & ~F.col("_backed")))
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight") * F.when(F.col("place") == "description", DESCRIPTION).otherwise(1.0)))
    targets = F.when(F.col("label").contains("/") & (F.col("label") != NO_PARENT), F.array("label", top)).otherwise(F.array("label"))
    rows = rows.select("item", "kind", "place", w.alias("w"), channel_of(F.col("place"), symbol_is_name).alias("channel"), F.explode(targets).alias("label")).filter("w > 0")
    strength = lambda x: F.max(x) + WITHIN * (1 - F.product(1 - x) - F.max(x))
    plain = F.when(~hint, F.col("w"))
    by_channel = rows.groupBy("item", "label", "channel").agg(
        strength(F.col("w")).alias("s"), strength(plain).alias("alone"), F.bool_or(~hint).alias("substantive"), F.bool_or(hint).alias("hinted"),
        F.bool_or(~noun).alias("named"), F.bool_or(F.col("place") == "image").alias("pictured"),
    )
    bonus = lambda agrees: BONUS * F.least(F.greatest(F.count_if(agrees) - 1, F.lit(0)), F.lit(2))
    s, alone = F.col("s"), F.col("alone")
    scored = by_channel.groupBy("item", "label").agg(
        F.least(F.lit(CAP), 1 - F.product(1 - s) + bonus((s >= AGREES_AT) & F.col("substantive"))).alias("conf"),
        F.least(F.lit(CAP), 1 - F.coalesce(F.product(1 - alone), F.lit(1.0)) + bonus(alone >= AGREES_AT)).alias("unhinted"),
        F.bool_or("hinted").alias("hinted"), F.bool_or("named").alias("named"), F.bool_or("pictured").alias("pictured"), F.count("*").alias("channels"),
    )
    v = F.when(F.col("hinted") & (F.col("unhinted") < FLOOR), F.col("unhinted")).otherwise(F.col("conf"))
    capped = F.when(F.col("named"), v).when((F.col("label") == NOUN_LABEL) & ~F.col("pictured"), F.least(v, F.lit(NOUN_CAP))).otherwise(F.least(v, F.lit(DICTIONARY_CAP)))
    scored = scored.select("item", "label", "channels", F.round(capped, 3).alias("score"))
    kin = F.col("label").startswith(FAMILY + "/") & (F.col("label") != EXEMPT)
    best = F.max(F.when(kin, F.col("score"))).over(Window.partitionBy("item"))
    return scored.withColumn("score", F.when(kin & (F.col("score") < best), F.round(F.col("score") * SIBLING + 1e-9, 3)).otherwise(F.col("score")))


@pack.query("lineitem", "part", sql=f"WITH {_SCORES} SELECT item, label, channels, score FROM s WHERE score >= {FLOOR}")
def judged_labels(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Confidence of every label: first rows only, parents, backing of nouns, channels, agreement of substantive ones, hints that never lift over the floor, caps, softened siblings, rounded to three places."""
    return judge(rows_of(lineitem, part), F.col("item") % 3 == 0).filter(F.col("score") >= FLOOR)


@pack.query(
    "lineitem", "part",
    sql=f"""WITH {_SCORES} SELECT item, label AS main, score FROM s WHERE score >= {FLOOR} AND label NOT LIKE '%/%'
    QUALIFY row_number() OVER (PARTITION BY item ORDER BY label IN {NO_THEME + ('',)}, CASE WHEN label IN {NO_THEME + ('',)} THEN 0 ELSE -score END, CASE WHEN label IN {NO_THEME + ('',)} THEN -score END,
      coalesce(list_position({list(THEMES)}, label), 99), label) = 1""",
)
def main_theme(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The strongest top-level theme, ties by the fixed order of themes; a relation or setting only where there is no theme."""
    tops = judge(rows_of(lineitem, part), F.col("item") % 3 == 0).filter((F.col("score") >= FLOOR) & ~F.col("label").contains("/"))
    place = F.array_position(F.array(*map(F.lit, THEMES)), F.col("label"))
    order = Window.partitionBy("item").orderBy(F.col("label").isin(*NO_THEME), F.desc("score"), F.when(place > 0, place).otherwise(99), "label")
    return tops.withColumn("n", F.row_number().over(order)).filter("n = 1").select("item", F.col("label").alias("main"), "score")


@pack.query(
    "lineitem", "part",
    sql=f"""WITH {_ROWS}, v AS (SELECT item, split_part(label, '/', 1) AS label, source, min(struct_pack(seq := seq, supplier := supplier, part := part, w := weight, place := place)) AS x
        FROM r WHERE kind IN ('entity', 'rule') GROUP BY ALL),
      o AS (SELECT item, label, 1 - product(1 - least(0.98, x.w) * CASE WHEN x.place = 'description' THEN 0.6 ELSE 1 END) AS raw, count(*) AS inputs FROM v GROUP BY ALL),
      k AS (SELECT *, row_number() OVER w AS n, lead(raw) OVER w AS second FROM o WINDOW w AS (PARTITION BY item ORDER BY round(raw, 8) DESC, label DESC))
    SELECT item, label, inputs, round(least({CAP}, raw), 3) AS raw, round(second, 3) AS second, second >= 0.3 AND raw - second < 0.1 AS ambiguous, least({CAP}, raw) < 0.45 AS weak FROM k WHERE n = 1""",
)
def referent_of(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The referent of each item: one vote for each source and label (its first row), kinds that name things only, descriptions at 0.6, the runner-up, and whether the result is ambiguous or weak."""
    rows = rows_of(lineitem, part).filter(F.col("kind").isin("entity", "rule"))
    first = F.min_by(F.struct("weight", "place"), F.struct("seq", "supplier", "part", "weight")).alias("x")
    votes = rows.groupBy("item", F.split_part(F.col("label"), F.lit("/"), F.lit(1)).alias("label"), "source").agg(first)
    w = F.least(F.lit(0.98), F.col("x.weight")) * F.when(F.col("x.place") == "description", DESCRIPTION).otherwise(1.0)
    scored = votes.groupBy("item", "label").agg((1 - F.product(1 - w)).alias("raw"), F.count("*").alias("inputs"))
    order = Window.partitionBy("item").orderBy(F.round("raw", 8).desc(), F.desc("label"))
    best = scored.withColumns({"n": F.row_number().over(order), "second": F.lead("raw").over(order)}).filter("n = 1")
    capped = F.least(F.lit(CAP), F.col("raw"))
    return best.select(
        "item", "label", "inputs", F.round(capped, 3).alias("raw"), F.round("second", 3).alias("second"),
        ((F.col("second") >= 0.3) & (F.col("raw") - F.col("second") < 0.1)).alias("ambiguous"), (capped < 0.45).alias("weak"),
    )
