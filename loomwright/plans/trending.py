"""What items have to do with what trends: matches by name, text, word and symbol, the gate for ordinary words, and evidence by source.

Roles on the driver's tables: documents are items (see ``lexicon.items_of``; every seventh has a name of one word), phrases of benchmark items are trending labels of three sources, and the benchmark item's
whole text is the story behind its labels. Null names and texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import phrases
from loomwright.plans.lexicon import items_of
from loomwright.plans.registry import Pack
from loomwright.plans.texts import _PHRASES, payloads
from loomwright.sources.scratch import written

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: Letters of a word that may be all that matches, words of a label of which one may match.
WORD_LETTERS, LABEL_WORDS = 4, 4
#: Shares of documents above which a word is everyday, and up to which it is rare.
EVERYDAY, RARE = 0.05, 0.01
#: For each source, what it measures, and the bounds from which a label counts so much, the strongest first; any other label counts ``FAINT``, and labels that trend every day half.
SOURCES = {"articles": ("spike", ((10.0, 0.6), (3.0, 0.45))), "searches": ("views", ((10_000.0, 0.55), (1_000.0, 0.45))), "lists": ("place", ((-10.0, 0.5), (-25.0, 0.4)))}
FAINT, GENERIC = 0.3, 0.5


def terms_of(benchmark: DataFrame) -> DataFrame:
    """term, words, story, source, strength and generic of every trending label; of labels that several items have, the item of the smallest number tells."""
    story = F.array_distinct(T.words(F.col("text")))
    size = F.length("text")
    names = F.array(*[F.lit(s) for s in SOURCES])
    which = (F.col("item_id") % 3).cast("int")
    strength = F.when(which == 0, size / 15.0).when(which == 1, size * 37.0).otherwise(-(1.0 + size % 50))
    items = benchmark.select("item_id", story.alias("story"), F.get(names, which).alias("source"), strength.alias("strength"), (F.col("item_id") % 5 == 0).alias("generic"))
    owner = payloads(benchmark).groupBy(F.col("surface").alias("term")).agg(F.min("item_id").alias("item_id"))
    return owner.join(items, "item_id").select("term", F.split("term", " ").alias("words"), "story", "source", "strength", "generic")


def common_words(documents: DataFrame) -> DataFrame:
    """word, everyday and rare, by the share of documents that have it."""
    total = documents.agg(F.count("*").alias("total"))  # one row
    words = documents.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("total")
    return words.crossJoin(F.broadcast(total)).select("word", (share > EVERYDAY).alias("everyday"), (share <= RARE).alias("rare"))


def trend_hits(items: DataFrame, terms: DataFrame, words: DataFrame) -> DataFrame:
    """id, term, field, surface, partial and support, a row for each label that an item (id, tokens, symbol, description) has to do with; of several ways the first of name, description, word, symbol.

    A description counts only by labels that are no everyday phrase, or by rare words. A name of one word may be a word of a label, a symbol a whole label. One-word matches of ordinary words stay only
    if the item's texts have another word of the label, or one of its story that is not everyday.
    """
    terms = written(terms, "trend-terms")
    known = written(words, "trend-words")
    names = written(items.select("id", "tokens", "symbol"), "trend-names")
    labels = terms.select(F.col("term").alias("surface"))
    everyday = known.filter("everyday").select("word", F.lit(True).alias("common"))
    # Labels of everyday words only, and one-word labels that are not rare, say nothing in a description.
    each = terms.select("term", F.size("words").alias("n"), F.explode("words").alias("word")).join(known, "word", "left")
    telling = each.groupBy("term").agg(
        F.max("n").alias("n"), F.bool_and(F.coalesce("everyday", F.lit(False)) | (F.length("word") <= 2)).alias("ordinary"), F.bool_and(F.coalesce("rare", F.lit(True)) & (F.length("word") >= WORD_LETTERS)).alias("rare")
    )
    telling = telling.filter(((F.col("n") > 1) & ~F.col("ordinary")) | ((F.col("n") == 1) & F.col("rare"))).select(F.col("term").alias("surface"))
    spaced = lambda df, text: df.select("id", text.alias("text"), F.lit(False).alias("fused"))
    found = lambda df, field, place, partial=False: df.select("id", "term", F.struct(F.lit(place).alias("place"), F.lit(field).alias("field"), "surface", F.lit(partial).alias("partial")).alias("way"))
    by_name = phrases.find(spaced(names, F.array_join("tokens", " ")), labels, longest=True).withColumn("term", F.col("surface"))
    by_text = phrases.find(spaced(items, F.col("description")), telling, longest=True).withColumn("term", F.col("surface"))
    alone = names.filter(F.size("tokens") == 1).select("id", F.get("tokens", F.lit(0)).alias("surface")).filter(F.length("surface") >= WORD_LETTERS)
    inside = terms.filter(F.size("words").between(2, LABEL_WORDS)).select("term", F.explode("words").alias("surface")).distinct()
    tick = F.lower("symbol")
    ticks = names.filter((F.length(tick) >= WORD_LETTERS) & tick.rlike("^[a-z]+$") & (tick != F.array_join("tokens", "")) & ~F.array_contains("tokens", tick)).select("id", tick.alias("surface"))
    by_symbol = ticks.join(labels.withColumn("term", F.col("surface")), "surface")
    ways = found(by_name, "name", 0).unionByName(found(by_text, "description", 1)).unionByName(found(alone.join(inside, "surface"), "name", 2, True)).unionByName(found(by_symbol, "symbol", 3))
    hits = written(ways.groupBy("id", "term").agg(F.min("way").alias("way")).select("id", "term", "way.*"), "trend-hits")
    hits = hits.join(known.select(F.col("word").alias("surface"), "everyday", "rare"), "surface", "left")
    ok = F.col("surface").contains(" ") | F.when(F.col("partial"), F.coalesce("rare", F.lit(True))).otherwise(~F.coalesce("everyday", F.lit(False)))
    hits = written(hits.select("id", "term", "field", "surface", "partial", ok.alias("ok")), "gated-hits")
    # What the gate would drop is asked for support: the items' texts are read for these alone.
    asked = hits.filter("NOT ok").select("id", "term", "surface")
    stories = terms.join(asked.select("term").distinct(), "term", "left_semi")
    quiet = stories.select("term", F.explode("story").alias("word")).join(everyday, "word").groupBy("term").agg(F.collect_set("word").alias("quiet"))
    long = lambda ws: F.filter(ws, lambda w: F.length(w) >= WORD_LETTERS)
    told = F.concat(long("words"), F.array_except(long("story"), F.coalesce("quiet", F.array().cast("array<string>"))))
    stories = stories.join(quiet, "term", "left").select("term", told.alias("told"))
    texts = items.join(asked.select("id").distinct(), "id", "left_semi").select("id", F.array_distinct(F.concat("tokens", F.split(F.coalesce("description", F.lit("")), " "))).alias("said"))
    supported = asked.join(stories, "term").join(texts, "id")
    support = F.get(F.filter("told", lambda w: F.array_contains("said", w) & (w != F.col("surface"))), F.lit(0))
    supported = supported.select("id", "term", support.alias("support")).filter("support IS NOT NULL")
    return hits.join(supported, ["id", "term"], "left").filter("ok OR support IS NOT NULL").drop("ok")


def weights(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """``hits`` with source and weight: by how strong the label is where it trends."""
    weight = F.lit(FAINT)
    for name, (_, bounds) in SOURCES.items():
        for least, w in reversed(bounds):
            weight = F.when((F.col("source") == name) & (F.col("strength") >= least), w).otherwise(weight)
    weight = F.round(weight * F.when(F.col("generic"), GENERIC).otherwise(1.0), 3)
    return hits.join(terms.select("term", "source", "strength", "generic"), "term").withColumn("weight", weight).drop("strength", "generic")


def items_with_short_names(documents: DataFrame) -> DataFrame:
    """Items of which every seventh has a name of one word."""
    return items_of(documents).withColumn("tokens", F.when(F.col("id") % 7 == 0, F.slice("tokens", 1, 1)).otherwise(F.col("tokens")))


_CASES = " ".join(f"WHEN source = '{name}' AND strength >= {least} THEN {w}" for name, (_, bounds) in SOURCES.items() for least, w in bounds)
_TWIN = f"""RECURSIVE {_PHRASES},
    dw AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM documents),
    i0 AS (SELECT id, w, CASE WHEN id % 4 = 1 THEN list_transform(w[1:6], lambda x: x || 's') ELSE w[1:6] END AS six FROM dw), it AS (SELECT id, w, w[2] AS tick, CASE WHEN id % 7 = 0 THEN six[1:1] ELSE six END AS tokens FROM i0),
    kw AS (SELECT word, count(*) / (SELECT count(*) FROM documents)::DOUBLE > {EVERYDAY} AS everyday, count(*) / (SELECT count(*) FROM documents)::DOUBLE <= {RARE} AS rare FROM (SELECT DISTINCT id, unnest(w) AS word FROM dw) GROUP BY word),
    ow AS (SELECT surface AS term, min(item_id) AS item_id FROM pl GROUP BY surface),
    te AS (SELECT term, string_split(term, ' ') AS words, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS story, CASE item_id % 3 WHEN 0 THEN 'articles' WHEN 1 THEN 'searches' ELSE 'lists' END AS source,
      CASE item_id % 3 WHEN 0 THEN length(text) / 15.0 WHEN 1 THEN length(text) * 37.0 ELSE -(1.0 + length(text) % 50) END::DOUBLE AS strength, item_id % 5 = 0 AS generic FROM ow JOIN benchmark USING (item_id)),
    ew AS (SELECT term, len(words) AS n, unnest(words) AS word FROM te),
    tl AS (SELECT term FROM ew LEFT JOIN kw USING (word) GROUP BY term HAVING (max(n) > 1 AND NOT bool_and(coalesce(everyday, false) OR length(word) <= 2)) OR (max(n) = 1 AND bool_and(coalesce(rare, true) AND length(word) >= {WORD_LETTERS}))),
    tx AS (SELECT id, 'name' AS field, tokens AS words FROM it UNION ALL SELECT id, 'description', w FROM it), po AS (SELECT id, field, words, unnest(range(1, len(words) + 1)) AS pos FROM tx),
    oc AS (SELECT id, field, pos, n, surface FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS n FROM po) x JOIN (SELECT term AS surface, len(words) AS n, term IN (SELECT term FROM tl) AS tells FROM te) s USING (n)
      WHERE pos + n - 1 <= len(words) AND array_to_string(words[pos : pos + n - 1], ' ') = surface AND (field = 'name' OR tells)),
    lo AS (SELECT id, field, pos, max(n) AS n, arg_max(surface, n) AS surface FROM oc GROUP BY ALL), nx AS (SELECT lo.*, k.pos AS following FROM lo ASOF LEFT JOIN (SELECT id, field, pos FROM lo) k ON lo.id = k.id AND lo.field = k.field AND lo.pos + lo.n <= k.pos),
    sw AS (SELECT * FROM nx WHERE (id, field, pos) IN (SELECT (id, field, min(pos)) FROM nx GROUP BY id, field) UNION ALL SELECT nx.* FROM sw JOIN nx ON sw.id = nx.id AND sw.field = nx.field AND sw.following = nx.pos),
    wy AS (SELECT id, surface AS term, CASE field WHEN 'name' THEN 0 ELSE 1 END AS place, field, surface, false AS partial FROM sw
      UNION ALL SELECT id, term, 2, 'name', word, true FROM it JOIN (SELECT DISTINCT term, word FROM ew WHERE n BETWEEN 2 AND {LABEL_WORDS}) e ON len(tokens) = 1 AND tokens[1] = word AND length(word) >= {WORD_LETTERS}
      UNION ALL SELECT id, term, 3, 'symbol', term, false FROM it JOIN te ON term = tick AND length(tick) >= {WORD_LETTERS} AND tick != array_to_string(tokens, '') AND NOT list_contains(tokens, tick)),
    hi AS (SELECT * FROM wy QUALIFY row_number() OVER (PARTITION BY id, term ORDER BY place, surface) = 1),
    ga AS (SELECT hi.*, contains(surface, ' ') OR CASE WHEN partial THEN coalesce(rare, true) ELSE NOT coalesce(everyday, false) END AS ok FROM hi LEFT JOIN kw ON word = surface),
    qe AS (SELECT list(word) AS quiet FROM kw WHERE everyday), st AS (SELECT term, list_concat(list_filter(words, lambda x: length(x) >= {WORD_LETTERS}), list_filter(story, lambda x: length(x) >= {WORD_LETTERS} AND NOT list_contains(quiet, x))) AS told FROM te, qe),
    su AS (SELECT ga.*, CASE WHEN NOT ok THEN list_filter(told, lambda x: x != surface AND (list_contains(tokens, x) OR list_contains(w, x)))[1] END AS support FROM ga JOIN st USING (term) JOIN it USING (id))"""


@pack.query(
    "documents", "benchmark",
    sql=f"""WITH {_TWIN} SELECT id, term, field, surface, partial, support, source, round(CASE {_CASES} ELSE {FAINT} END * CASE WHEN generic THEN {GENERIC} ELSE 1.0 END, 3)::DOUBLE AS weight
      FROM su JOIN te USING (term) WHERE ok OR support IS NOT NULL""",
)
def trend_evidence(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The trending labels that each item has to do with, how, what supports ordinary words, and the weight by source."""
    terms = terms_of(benchmark)
    return weights(trend_hits(items_with_short_names(documents), terms, common_words(documents)), terms)
