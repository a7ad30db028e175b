"""Evidence: weighted labels from several channels, combined to category and referent confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators import noisy_or as N
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: The weight of a row of evidence; the odd offset keeps values off thresholds and rounding ties.
_WEIGHT = "least(1.0, l_discount * 5 + 0.0130007193)"
#: Evidence from order lines: item, leaf and parent label, channel, source and weight.
_EVIDENCE = f"""e AS (SELECT l_orderkey AS item, p_type || '/' || p_brand AS leaf, p_type AS parent, l_returnflag AS channel, l_linestatus AS source, l_linenumber AS seq, l_suppkey AS supplier, {_WEIGHT} AS weight
      FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def evidence(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("item"), F.concat_ws("/", "p_type", "p_brand").alias("leaf"), F.col("p_type").alias("parent"),
        F.col("l_returnflag").alias("channel"), F.col("l_linestatus").alias("source"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("supplier"),
        F.least(F.lit(1.0), F.col("l_discount") * 5 + 0.0130007193).alias("weight"),
    )


_STRENGTH = """d AS (SELECT item, leaf, parent, channel, source, max(weight) AS weight FROM e GROUP BY ALL),
    t AS (SELECT item, channel, source, weight * CASE WHEN source = 'F' THEN 0.6 ELSE 1 END AS w, unnest([leaf, parent]) AS label FROM d),
    c AS (SELECT item, label, channel, max(w) + 0.5 * ((1 - product(1 - w)) - max(w)) AS strength FROM t WHERE w > 0 GROUP BY ALL),
    f AS (SELECT item, label, least(0.97, 1 - product(1 - strength) + 0.08 * least(greatest(0, count(*) FILTER (WHERE strength >= 0.15) - 1), 2)) AS raw, count(*) AS channels FROM c GROUP BY ALL),
    s AS (SELECT item, label, channels, CASE WHEN label LIKE '%/%' AND raw < max(CASE WHEN label LIKE '%/%' THEN raw END) OVER (PARTITION BY item, split_part(label, '/', 1)) THEN raw * 0.7 ELSE raw END AS score FROM f)"""


def scored(rows: DataFrame) -> DataFrame:
    """Deduplicated evidence, carried to leaf and parent, combined over channels, softened among siblings."""
    distinct = rows.groupBy("item", "leaf", "parent", "channel", "source").agg(F.max("weight").alias("weight"))
    carried = distinct.withColumn("w", F.col("weight") * F.when(F.col("source") == "F", 0.6).otherwise(1.0)).withColumn("label", F.explode(F.array("leaf", "parent")))
    return N.soften_siblings(N.combine(carried.filter("w > 0"), ["item", "label"], "channel", "w"), "item", "label", "score")


@pack.query("lineitem", "part", sql=f"WITH {_EVIDENCE}, {_STRENGTH} SELECT item, label, channels, round(score, 4) AS score FROM s WHERE score >= 0.2")
def noisy_or_two_level(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Confidence of every label of every item: noisy-or inside and across channels, bonus for agreement, floor 0.2."""
    return scored(evidence(lineitem, part)).filter("score >= 0.2").select("item", "label", "channels", F.round("score", 4).alias("score"))


@pack.query(
    "lineitem", "part",
    sql=f"""WITH {_EVIDENCE}, {_STRENGTH} SELECT item, label AS main, round(score, 4) AS score FROM s WHERE label NOT LIKE '%/%' AND score >= 0.2
    QUALIFY row_number() OVER (PARTITION BY item ORDER BY round(score, 8) DESC, label) = 1""",
)
def main_category(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The strongest top label of each item; ties go to the first in a fixed order."""
    tops = scored(evidence(lineitem, part)).filter(~F.col("label").contains("/") & (F.col("score") >= 0.2))
    best = Window.partitionBy("item").orderBy(F.round("score", 8).desc(), "label")
    return tops.withColumn("n", F.row_number().over(best)).filter("n = 1").select("item", F.col("label").alias("main"), F.round("score", 4).alias("score"))


@pack.query(
    "lineitem", "part",
    sql=f"""WITH {_EVIDENCE}, b AS (SELECT parent, leaf, round(avg(weight), 8) AS w FROM e GROUP BY ALL)
    SELECT leaf, round(CASE WHEN w < max(w) OVER (PARTITION BY parent) THEN w * 0.7 ELSE w END, 4) AS softened FROM b""",
)
def sibling_softening(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Leaves under one parent that are not its best count for less."""
    b = evidence(lineitem, part).groupBy("parent", F.col("leaf")).agg(F.round(F.avg("weight"), 8).alias("w"))
    top = F.max("w").over(Window.partitionBy("parent"))
    return b.select("leaf", F.round(F.when(F.col("w") < top, F.col("w") * 0.7).otherwise(F.col("w")), 4).alias("softened"))


_VOTE = f"""{_EVIDENCE}, v AS (SELECT item, parent AS label, supplier % 5 AS source, max(least(0.98, weight * CASE WHEN channel = 'N' THEN 0.6 ELSE 1 END)) AS w FROM e GROUP BY ALL),
    r AS (SELECT item, label, 1 - product(1 - w) AS raw, count(*) AS inputs FROM v GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(raw, 8) DESC, label DESC) AS n, lead(raw) OVER (PARTITION BY item ORDER BY round(raw, 8) DESC, label DESC) AS second FROM r)"""


def votes(rows: DataFrame) -> DataFrame:
    """The best label of each item by one vote for each source, with the runner-up's score."""
    weight = F.least(F.lit(0.98), F.col("weight") * F.when(F.col("channel") == "N", 0.6).otherwise(1.0))
    v = rows.groupBy("item", F.col("parent").alias("label"), (F.col("supplier") % 5).alias("source")).agg(F.max(weight).alias("w"))
    r = v.groupBy("item", "label").agg((1 - F.product(1 - F.col("w"))).alias("raw"), F.count("*").alias("inputs"))
    w = Window.partitionBy("item").orderBy(F.round("raw", 8).desc(), F.desc("label"))
    return r.withColumns({"n": F.row_number().over(w), "second": F.lead("raw").over(w)}).filter("n = 1")


@pack.query(
    "lineitem", "part",
    sql=f"""WITH {_VOTE} SELECT item, label, inputs, round(raw, 4) AS raw, round(second, 4) AS second,
      CASE WHEN raw < 0.45 THEN 'weak' WHEN second >= 0.3 AND raw - second < 0.1 THEN 'ambiguous' ELSE 'clear' END AS caveat FROM o WHERE n = 1""",
)
def referent_vote(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The referent each item's sources vote for, the runner-up and how clear the vote is."""
    caveat = F.when(F.col("raw") < 0.45, "weak").when((F.col("second") >= 0.3) & (F.col("raw") - F.col("second") < 0.1), "ambiguous").otherwise("clear")
    return votes(evidence(lineitem, part)).select("item", "label", "inputs", F.round("raw", 4).alias("raw"), F.round("second", 4).alias("second"), caveat.alias("caveat"))


@pack.query(
    "lineitem", "part",
    sql=f"""WITH {_VOTE} SELECT item, round(CASE WHEN raw < 0.45 THEN least(0.49, 0.3 + 0.2 * raw) WHEN inputs >= 2 THEN 0.7 + 0.27 * least(1, (raw - 0.45) / 0.5)
      ELSE 0.5 + 0.19 * least(1, (raw - 0.45) / 0.5) END, 4) AS confidence FROM o WHERE n = 1""",
)
def referent_bands(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Votes mapped to bands of confidence by the number of independent inputs."""
    raw = F.col("raw")
    lift = F.least(F.lit(1.0), (raw - 0.45) / 0.5)
    confidence = F.when(raw < 0.45, F.least(F.lit(0.49), 0.3 + 0.2 * raw)).when(F.col("inputs") >= 2, 0.7 + 0.27 * lift).otherwise(0.5 + 0.19 * lift)
    return votes(evidence(lineitem, part)).select("item", F.round(confidence, 4).alias("confidence"))


@pack.query(
    "lineitem", "part",
    sql=f"""WITH {_EVIDENCE}, k AS (SELECT item, parent, count(DISTINCT channel) AS channels FROM e GROUP BY ALL)
    SELECT e.item, e.seq, e.supplier, e.leaf, round(sum(weight * CASE WHEN channels >= 2 THEN 1 ELSE 0.25 END), 4) AS weight FROM e JOIN k USING (item, parent) GROUP BY ALL""",
)
def second_signal(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Evidence counts a quarter unless another channel supports its top label."""
    e = evidence(lineitem, part)
    k = e.groupBy("item", "parent").agg(F.count_distinct("channel").alias("channels"))
    weight = F.col("weight") * F.when(F.col("channels") >= 2, 1.0).otherwise(0.25)
    return e.join(k, ["item", "parent"]).groupBy("item", "seq", "supplier", "leaf").agg(F.round(F.sum(weight), 4).alias("weight"))


@pack.query(
    "orders", "lineitem", "part",
    sql=f"""WITH {_EVIDENCE}, o AS (SELECT o_orderkey AS item, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS original FROM orders),
    own AS (SELECT item, leaf, max(weight) AS w FROM e WHERE weight >= 0.4 GROUP BY ALL)
    SELECT item, leaf, round(w, 4) AS score, false AS inherited FROM own
    UNION ALL SELECT o.item, own.leaf, round(own.w * 0.8, 4), true FROM o JOIN own ON own.item = o.original WHERE o.item != o.original AND o.item NOT IN (SELECT item FROM own)""",
)
def inherit(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Copies without labels of their own take those of their original, at 0.8 of the weight."""
    first = F.first("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    origin = orders.select(F.col("o_orderkey").alias("item"), first.alias("original"))
    own = evidence(lineitem, part).filter("weight >= 0.4").groupBy("item", "leaf").agg(F.max("weight").alias("w"))
    bare = origin.filter("item != original").join(own.select("item").distinct(), "item", "left_anti")
    taken = bare.join(own.withColumnRenamed("item", "original"), "original").select("item", "leaf", F.round(F.col("w") * 0.8, 4).alias("score"), F.lit(True).alias("inherited"))
    return own.select("item", "leaf", F.round("w", 4).alias("score"), F.lit(False).alias("inherited")).unionByName(taken)


_FLAGS = {
    "large": "o_totalprice > 300000", "urgent": "o_orderpriority LIKE '1%'", "stale": "o_orderdate < TIMESTAMP '1996-01-01'", "open": "o_orderstatus = 'O'",
    "large_and_open": "o_totalprice > 300000 AND o_orderstatus = 'O'",
}


@pack.query("orders", sql=f"SELECT code, count(*) AS n_items FROM (SELECT unnest([{', '.join(f'CASE WHEN {rule} THEN {code!r} END' for code, rule in _FLAGS.items())}]) AS code FROM orders) WHERE code IS NOT NULL GROUP BY code")
def flag_rules(orders: DataFrame) -> DataFrame:
    """How many rows raise each flag."""
    rules = {code: rule.replace("TIMESTAMP ", "TIMESTAMP_NTZ ") for code, rule in _FLAGS.items()}
    codes = F.array_compact(F.array(*[F.when(F.expr(rule), code) for code, rule in rules.items()]))
    return orders.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n_items"))


@pack.query(
    "lineitem",
    sql="""
    WITH m AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity / 50 * 0.997130007 AS name, l_discount * 10 AS ticker, l_tax * 10 AS image, CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE 1 END AS against FROM lineitem),
    f AS (SELECT *, against * (1 - (1 - 0.85 * name) * (1 - 0.55 * least(1, ticker)) * (1 - 0.9 * least(1, image) * 0.5)) AS fit FROM m)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, round(fit, 4) AS fit, CASE WHEN fit >= 0.60001 THEN 'match' WHEN fit >= 0.20001 THEN 'partial' ELSE 'none' END AS verdict FROM f""",
)
def match_fit(lineitem: DataFrame) -> DataFrame:
    """Weighted noisy-or of name, ticker and image agreement, halved by contradiction, with a verdict."""
    fit = N.noisy_or([(0.85, F.col("l_quantity") / 50 * 0.997130007), (0.55, F.least(F.lit(1.0), F.col("l_discount") * 10)), (0.45, F.least(F.lit(1.0), F.col("l_tax") * 10))])
    fit = F.when(F.col("l_linestatus") == "O", 0.5).otherwise(1.0) * fit
    rows = lineitem.withColumn("f", fit)
    verdict = F.when(F.col("f") >= 0.60001, "match").when(F.col("f") >= 0.20001, "partial").otherwise("none")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", F.round("f", 4).alias("fit"), verdict.alias("verdict"))
