"""URL filter by a character language-model ratio.

Rules on host and path decide the URLs they fit. Those URLs are the training rows of two variable-order
Markov models of characters, one of accepted and one of rejected URLs: the probability of a character mixes
contexts of 4, 3, 2, 1 and no characters, each order weighted by how often and how variedly its context was seen
(Witten-Bell), down to an even spread over ``ALPHABET``. A URL without a rule is judged by the difference
of its two log-likelihoods per character, against a threshold calibrated on labelled URLs that the models
did not count: the one with the least mean of the two error rates.

All counts cover all rows. Only character 5-grams are counted, looked up and joined; log ratios are rounded
to whole millionths before they are added, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import ascii_lower, written

ORDER, ALPHABET = 4, 96
SCALE, BIN = 1_000_000, 20_000
#: URLs whose digest begins with one of these hex digits calibrate; the others train.
CALIBRATION_DIGITS = "0123"
#: 5-grams of the model that are broadcast at most (about 60 bytes each).
MOST_BROADCAST = 400_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""

    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)

    def value(rule: Rule) -> Column:
        return F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))

    ordered = sorted(rules, key=lambda r: (len(r.name), r.name))  # shortest first: later ones win
    return reduce(lambda rest, r: F.when(fits(r), value(r)).otherwise(rest), ordered, F.lit(None))


def model_text(url: Column) -> Column:
    """What the models read: the URL after its scheme, A-Z lower-cased, every digit as 0."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.regexp_replace(ascii_lower(rest), "[0-9]", "0")


def grams(df: DataFrame) -> DataFrame:
    """A row for each character of ``body`` and the end: ``gram`` is the character after its 4-character context."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("body"), F.lit("\x03"))
    df = df.withColumn("_padded", padded).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_padded") - ORDER)))
    return df.withColumn("gram", F.substring(F.col("_padded"), F.col("_at"), F.lit(ORDER + 1))).drop("_padded", "_at", "body")


def ratio_table(counts: DataFrame) -> DataFrame:
    """gram and llr (millionths) for every gram of ``counts`` (gram, accepted, rejected)."""
    sides = ("accepted", "rejected")
    model = None
    for k in range(ORDER + 1):
        tail = F.substring(F.col("gram"), F.lit(ORDER + 1 - k), F.lit(k + 1))
        seen = counts.groupBy(tail.alias("tail")).agg(*[F.sum(s).alias(s) for s in sides])
        context = F.substring(F.col("tail"), F.lit(1), F.lit(k))
        seen = seen.withColumn("context", context)
        totals = seen.groupBy("context").agg(*[F.sum(s).alias(f"{s}_n") for s in sides], *[F.count_if(F.col(s) > 0).alias(f"{s}_kinds") for s in sides])
        level = seen.join(F.broadcast(totals) if k == 0 else totals, "context")  # k = 0: one row
        if model is None:
            lower = {s: F.lit(1.0 / ALPHABET) for s in sides}
        else:
            level = level.withColumn("lower", F.substring(F.col("tail"), F.lit(2), F.lit(k))).join(model, "lower")
            lower = {s: F.col(f"{s}_p") for s in sides}

        def mixed(s):
            mass = F.col(f"{s}_n") + F.col(f"{s}_kinds")
            return F.when(mass > 0, (F.col(s) + F.col(f"{s}_kinds") * lower[s]) / mass).otherwise(lower[s])

        model = level.select(F.col("tail").alias("lower"), *[mixed(s).alias(f"{s}_p") for s in sides])
    llr = F.round((F.ln("accepted_p") - F.ln("rejected_p")) * SCALE).cast("long")
    return model.select(F.col("lower").alias("gram"), llr.alias("llr"))


def rate(texts: DataFrame, table: DataFrame) -> DataFrame:
    """``texts`` (body and more) grouped to one row for each body with ``score``: millionths per character, rounded down."""
    return (
        grams(texts.withColumn("of", F.col("body")))
        .join(table, "gram")
        .groupBy("of")
        .agg(F.floor(F.sum("llr") / F.count("*")).cast("long").alias("score"))
        .withColumnRenamed("of", "body")
    )


def calibrate(scores: DataFrame) -> int:
    """The least threshold (a multiple of ``BIN``) with the smallest mean error, from rows (score, accepted, rejected); 0 without both classes."""
    bins = scores.groupBy(F.floor(F.col("score") / BIN).cast("long").alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect()
    accepted, rejected = sum(b["a"] for b in bins), sum(b["r"] for b in bins)  # a few thousand bins at most: scores are bounded
    if not accepted or not rejected:
        return 0
    best, at, lost = None, 0, 0
    kept = rejected
    for b in sorted(bins, key=lambda b: b["bin"]):
        # threshold at the bin's lower edge: rows below are blocked
        error = lost * rejected + kept * accepted
        if best is None or error < best:
            best, at = error, b["bin"] * BIN
        lost, kept = lost + b["a"], kept - b["r"]
    return at


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every page's page_id, host, path, rule and verdict, with the score of the models.

    Null and empty URLs and those without ``://`` have empty host and path; the models read what there is. Repeated URLs are judged once
    and answered each. Without training rows of both classes every score is 0, which allows.
    """
    rows = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "body": model_text(F.col("url"))})
    rows = rows.withColumn("_rule", first_rule(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_rule.rule"), "_by_rule": F.col("_rule.verdict")}).drop("_rule", "url")
    rows = written(rows, "urls")
    texts = rows.groupBy("body").agg(F.count_if(F.col("_by_rule") == "allow").alias("accepted"), F.count_if(F.col("_by_rule") == "block").alias("rejected"))
    aside = F.substring(F.md5(F.col("body").cast("binary")), 1, 1).isin(*CALIBRATION_DIGITS)
    texts = written(texts.withColumn("aside", aside), "url-texts")
    learnt = [F.sum(F.when(F.col("aside"), 0).otherwise(F.col(s))).alias(s) for s in ("accepted", "rejected")]
    counts = written(grams(texts).groupBy("gram").agg(*learnt), "grams")
    table = written(ratio_table(counts), "gram-ratios")
    if table.count() <= MOST_BROADCAST:
        table = F.broadcast(table)
    scores = written(rate(texts.select("body"), table), "url-scores")
    labelled = texts.filter(F.col("aside") & (F.col("accepted") + F.col("rejected") > 0))
    threshold = calibrate(labelled.join(scores, "body"))
    judged = rows.join(scores, "body")
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_model).alias("verdict"), "score")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for ``filter_urls``."""
    rest = "translate(regexp_replace(coalesce(url, ''), '(?s)^.*?://', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest) + " END"
    width = ORDER + 1
    parts = [
        f"""u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_replace({rest}, '[0-9]', '0', 'g') AS body FROM pages)""",
        f"j AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS by_rule FROM u)",
        f"""t AS (SELECT body, count(*) FILTER (WHERE by_rule = 'allow') AS accepted, count(*) FILTER (WHERE by_rule = 'block') AS rejected,
          contains('{CALIBRATION_DIGITS}', substr(md5(body), 1, 1)) AS aside, repeat(chr(2), {ORDER}) || body || chr(3) AS padded FROM j GROUP BY body)""",
        f"g AS (SELECT body, accepted, rejected, aside, substr(padded, i, {width}) AS gram FROM (SELECT *, unnest(range(1, length(padded) - {ORDER} + 1)) AS i FROM t))",
        "c AS (SELECT gram, sum(CASE WHEN aside THEN 0 ELSE accepted END) AS accepted, sum(CASE WHEN aside THEN 0 ELSE rejected END) AS rejected FROM g GROUP BY gram)",
    ]
    for k in range(width):
        parts.append(f"s{k} AS (SELECT substr(gram, {width - k}, {k + 1}) AS tail, sum(accepted)::BIGINT AS accepted, sum(rejected)::BIGINT AS rejected FROM c GROUP BY 1)")
        sums = ", ".join(f"sum({s})::BIGINT AS {s}_n, count(*) FILTER (WHERE {s} > 0) AS {s}_kinds" for s in ("accepted", "rejected"))
        parts.append(f"n{k} AS (SELECT substr(tail, 1, {k}) AS context, {sums} FROM s{k} GROUP BY 1)")
        low = lambda s: f"m.{s}_p" if k else f"{1.0 / ALPHABET!r}::DOUBLE"  # noqa: E731, B023
        mixed = ", ".join(f"CASE WHEN {s}_n + {s}_kinds > 0 THEN ({s} + {s}_kinds * {low(s)}) / ({s}_n + {s}_kinds) ELSE {low(s)} END AS {s}_p" for s in ("accepted", "rejected"))
        lower = f" JOIN m{k - 1} m ON m.tail = substr(s.tail, 2, {k})" if k else ""
        parts.append(f"m{k} AS (SELECT s.tail, {mixed} FROM s{k} s JOIN n{k} n ON n.context = substr(s.tail, 1, {k}){lower})")
    parts += [
        f"r AS (SELECT tail AS gram, round((ln(accepted_p) - ln(rejected_p)) * {SCALE})::BIGINT AS llr FROM m{ORDER})",
        "x AS (SELECT body, floor(sum(llr)::DOUBLE / count(*))::BIGINT AS score FROM g JOIN r USING (gram) GROUP BY body)",
        f"b AS (SELECT floor(score / {BIN}.0)::BIGINT AS bin, sum(accepted)::BIGINT AS a, sum(rejected)::BIGINT AS r FROM t JOIN x USING (body) WHERE aside AND accepted + rejected > 0 GROUP BY 1)",
        """e AS (SELECT bin, coalesce(sum(a) OVER w, 0) * (SELECT sum(r) FROM b) + ((SELECT sum(r) FROM b) - coalesce(sum(r) OVER w, 0)) * (SELECT sum(a) FROM b) AS error
          FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        f"h AS (SELECT CASE WHEN coalesce((SELECT least(sum(a), sum(r)) FROM b), 0) = 0 THEN 0 ELSE (SELECT bin * {BIN} FROM e ORDER BY error, bin LIMIT 1) END AS threshold)",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= (SELECT threshold FROM h) THEN 'allow' ELSE 'block' END) AS verdict, score FROM j JOIN x USING (body)"
