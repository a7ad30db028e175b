"""Evidence of a dictionary from several fields of an item: its name, spaced, fused and singular, its symbol, and its description.

Roles on the driver's tables: a document is an item, its first words the name, its second word the symbol, its whole text the description; benchmark items are what
the dictionary's surfaces stand for, by their phrases and, in names only, by their words. Null fields give no evidence; items that repeat give theirs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import phrases
from loomwright.plans.registry import Pack
from loomwright.plans.texts import _PHRASES, payloads
from loomwright.sources.scratch import written

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: What a symbol counts for beside a name, letters of a symbol, of a plural and of a surface in a fused name at least, stray letters before the end of a word.
SYMBOL_FACTOR, SYMBOL_LETTERS, PLURAL_LETTERS, FUSED_LETTERS, STRAY = 0.8, 3, 4, 4, 2
#: Weight of an item nobody knows and what being known adds; from which popularity on a one-word match says enough; share of documents that have an everyday word; letters of an alias.
LEAST, KNOWN, SURE, EVERYDAY, ALIAS_LETTERS = 0.5, 0.35, 0.8, 0.05, 5
NAME_WORDS = 6


def singular(names: DataFrame, known: DataFrame) -> DataFrame:
    """``names`` (id, tokens) with ``singular``: words in s that nobody knows lose it where what remains is among ``known`` (word).

    Only distinct words that look like plurals are joined with the known ones; names without one are left as they are.
    """
    looks = lambda w: (F.length(w) >= PLURAL_LETTERS) & w.endswith("s") & ~w.endswith("ss")
    stem = lambda w: F.left(w, F.length(w) - 1)
    candidates = names.select(F.explode(F.filter("tokens", looks)).alias("word")).distinct()
    plurals = candidates.join(known, "word", "left_anti").join(known.withColumnRenamed("word", "stem"), F.col("stem") == stem(F.col("word")), "left_semi")
    mine = names.select("id", F.explode(F.array_distinct(F.filter("tokens", looks))).alias("word")).distinct().join(plurals, "word")
    found = mine.groupBy("id").agg(F.collect_set("word").alias("plurals"))  # words of one name
    rows = names.join(found, "id", "left")
    one = F.transform("tokens", lambda w: F.when(F.array_contains("plurals", w), stem(w)).otherwise(w))
    return rows.withColumn("singular", F.when(F.col("plurals").isNull(), F.col("tokens")).otherwise(one)).drop("plurals")


def name_texts(items: DataFrame, known: DataFrame) -> DataFrame:
    """id, field, written (the name's words, in its own passes), factor, text and fused: a row for each pass over the name and the symbol of each item (id, tokens, symbol).

    A name without plurals has no singular pass, as it would find the same.
    """
    rows = singular(items, known)
    name, fused, one = F.array_join("tokens", " "), F.array_join("tokens", ""), F.array_join("singular", " ")
    none = F.lit(None).cast("array<string>")
    said = lambda field, text, factor=1.0, letters=False: F.struct(F.lit(field).alias("field"), (F.col("tokens") if field == "name" else none).alias("written"), F.lit(factor).alias("factor"), text.alias("text"), F.lit(letters).alias("fused"))
    passes = F.array(
        said("name", name),
        said("name", fused, letters=True),
        said("name", F.when(one != name, one)),
        said("symbol", F.when(F.length("symbol") >= SYMBOL_LETTERS, F.lower("symbol")), SYMBOL_FACTOR),
    )
    return rows.select("id", F.inline(passes)).filter("text IS NOT NULL")


def tail_of_word(surface: Column, written: Column) -> Column:
    """Whether a match is only the end of a longer word of the name, with a stray letter or two before it."""
    stray = lambda w: w.endswith(surface) & (F.length(w) - F.length(surface)).between(1, STRAY)
    return ~surface.contains(" ") & ~F.array_contains(written, surface) & F.exists(written, stray)


def evidence(items: DataFrame, dictionary: DataFrame, everyday: DataFrame) -> DataFrame:
    """id, field, surface, item_id, weight and generic, a row for each thing that a field of an item names.

    ``dictionary`` has surface, item_id, name_only and popularity; ``everyday`` has word. Longer matches win over what they hold, in each pass by itself, all meanings of
    a surface count, name-only surfaces count in names alone, and a surface counts once for each field however many passes find it, at its highest factor. ``generic`` marks
    one everyday word that stands for something little known.
    """
    dictionary = dictionary.filter("surface != ''").groupBy("surface", "item_id").agg(F.bool_and("name_only").alias("name_only"), F.max("popularity").alias("popularity"))
    dictionary = written(dictionary, "dictionary")  # read for every pass
    known = dictionary.select(F.explode(F.split("surface", " ")).alias("word")).distinct()
    texts = written(name_texts(written(items.select("id", "tokens", "symbol"), "names"), known), "name-texts")
    told = items.select("id", F.lit("description").alias("field"), F.lit(None).cast("array<string>").alias("written"), F.lit(1.0).alias("factor"), F.col("description").alias("text"), F.lit(False).alias("fused"))
    inside = F.col("field") == "name"
    # A name-only surface must not cover another one outside of names, so each kind of pass seeks among its own.
    anywhere = dictionary.groupBy("surface").agg(F.bool_and("name_only").alias("name_only"))
    fused = F.length(F.replace("surface", F.lit(" "), F.lit(""))) >= FUSED_LETTERS
    found = (
        phrases.find(texts.filter(inside & ~F.col("fused")), anywhere, longest=True)
        .unionByName(phrases.find(texts.filter(inside & F.col("fused")), anywhere.filter(fused), longest=True))
        .unionByName(phrases.find(texts.filter(~inside).unionByName(told), anywhere.filter("NOT name_only"), longest=True))
    )
    found = found.filter(F.col("written").isNull() | ~tail_of_word(F.col("surface"), F.col("written")))
    found = found.groupBy("id", "field", "surface").agg(F.max("factor").alias("factor"))
    named = found.join(dictionary, "surface").filter(inside | ~F.col("name_only"))
    named = named.join(everyday.select(F.col("word").alias("surface"), F.lit(True).alias("common")).distinct(), "surface", "left")
    generic = F.coalesce("common", F.lit(False)) & (F.col("popularity") < SURE)
    return named.select("id", "field", "surface", "item_id", F.round((LEAST + KNOWN * F.col("popularity")) * F.col("factor"), 3).alias("weight"), generic.alias("generic"))


def everyday_words(documents: DataFrame) -> DataFrame:
    """Words of more than a twentieth of all documents."""
    total = documents.agg(F.count("*").alias("total"))  # one row
    words = documents.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.crossJoin(F.broadcast(total)).filter(F.col("n") > EVERYDAY * F.col("total")).select("word")


def items_of(documents: DataFrame) -> DataFrame:
    """id, tokens, symbol, description; every fourth name is written in plurals."""
    words = T.words(F.col("text"))
    d = documents.select(F.col("doc_id").alias("id"), words.alias("w"))
    name = F.slice("w", 1, NAME_WORDS)
    tokens = F.when(F.col("id") % 4 == 1, F.transform(name, lambda x: F.concat(x, F.lit("s")))).otherwise(name)
    return d.select("id", tokens.alias("tokens"), F.upper(F.get("w", F.lit(1))).alias("symbol"), F.array_join("w", " ").alias("description"))


def named_things(benchmark: DataFrame) -> DataFrame:
    """surface, item_id, name_only, popularity: the phrases of an item, and in names its longer words."""
    popularity = F.least(F.lit(1.0), F.log10(F.length("text") + 1) / 3).alias("popularity")
    items = benchmark.select("item_id", popularity)
    whole = payloads(benchmark).select("surface", "item_id", (F.col("n") == 1).alias("name_only"))
    words = benchmark.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("surface"), "item_id", F.lit(True).alias("name_only")).filter(F.length("surface") >= ALIAS_LETTERS)
    return whole.union(words).join(items, "item_id")


_WORDS = "regexp_extract_all(lower(text), '[a-z]{2,}')"
_TWIN = f"""RECURSIVE {_PHRASES},
    dn AS (SELECT item_id, surface, n = 1 AS name_only FROM pl UNION ALL SELECT item_id, surface, true FROM (SELECT DISTINCT item_id, unnest({_WORDS}) AS surface FROM benchmark) WHERE length(surface) >= {ALIAS_LETTERS}),
    di AS (SELECT surface, item_id, bool_and(name_only) AS name_only, max(least(1.0::DOUBLE, log10(length(text) + 1) / 3)) AS popularity FROM dn JOIN benchmark USING (item_id) GROUP BY ALL),
    su AS (SELECT surface, bool_and(name_only) AS name_only, len(string_split(surface, ' ')) AS n, replace(surface, ' ', '') AS fused FROM di GROUP BY surface),
    kn AS (SELECT list(DISTINCT word) AS known FROM (SELECT unnest(string_split(surface, ' ')) AS word FROM su)),
    dw AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
    it AS (SELECT id, w, CASE WHEN id % 4 = 1 THEN list_transform(w[1:{NAME_WORDS}], lambda x: x || 's') ELSE w[1:{NAME_WORDS}] END AS tokens FROM dw),
    sg AS (SELECT it.*, list_transform(tokens, lambda x: CASE WHEN length(x) >= {PLURAL_LETTERS} AND ends_with(x, 's') AND NOT ends_with(x, 'ss') AND NOT list_contains(known, x) AND list_contains(known, left(x, length(x) - 1)) THEN left(x, length(x) - 1) ELSE x END) AS one FROM it, kn),
    tx AS (SELECT id, 'name' AS field, 1 AS pass, tokens AS words FROM sg UNION ALL SELECT id, 'name', 3, one FROM sg WHERE one != tokens
      UNION ALL SELECT id, 'symbol', 4, w[2:2] FROM sg WHERE length(w[2]) >= {SYMBOL_LETTERS} UNION ALL SELECT id, 'description', 5, w FROM sg),
    po AS (SELECT id, field, pass, words, unnest(range(1, len(words) + 1)) AS pos FROM tx),
    fu AS (SELECT id, array_to_string(tokens, '') AS t FROM sg), fl AS (SELECT DISTINCT length(fused) AS size FROM su WHERE length(fused) >= {FUSED_LETTERS}),
    fp AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS pos FROM fu),
    oc AS (SELECT id, field, pass, pos, n AS size, surface FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS n FROM po) x JOIN su USING (n) WHERE pos + n - 1 <= len(words) AND array_to_string(words[pos : pos + n - 1], ' ') = surface AND (field = 'name' OR NOT su.name_only)
      UNION ALL SELECT id, 'name', 2, pos, size, surface FROM (SELECT * FROM fp, fl) y JOIN su ON fused = substr(t, pos, size) AND length(fused) = size WHERE pos + size - 1 <= length(t)),
    lo AS (SELECT id, pass, pos, max(size) AS size FROM oc GROUP BY ALL),
    nx AS (SELECT lo.*, k.pos AS following FROM lo ASOF LEFT JOIN (SELECT id, pass, pos FROM lo) k ON lo.id = k.id AND lo.pass = k.pass AND lo.pos + lo.size <= k.pos),
    sw AS (SELECT * FROM nx WHERE (id, pass, pos) IN (SELECT (id, pass, min(pos)) FROM nx GROUP BY id, pass) UNION ALL SELECT nx.* FROM sw JOIN nx ON sw.id = nx.id AND sw.pass = nx.pass AND sw.following = nx.pos),
    hi AS (SELECT oc.* FROM oc SEMI JOIN sw USING (id, pass, pos, size)),
    ok AS (SELECT DISTINCT id, field, surface FROM hi JOIN sg USING (id) WHERE field != 'name' OR contains(surface, ' ') OR list_contains(tokens, surface) OR len(list_filter(tokens, lambda x: ends_with(x, surface) AND length(x) - length(surface) BETWEEN 1 AND {STRAY})) = 0),
    ev AS (SELECT word FROM (SELECT DISTINCT id, unnest(w) AS word FROM dw) GROUP BY word HAVING count(*) > {EVERYDAY} * (SELECT count(*) FROM documents))"""


@pack.query(
    "documents", "benchmark",
    sql=f"""WITH {_TWIN} SELECT id, field, surface, item_id, round(({LEAST} + {KNOWN} * popularity) * CASE WHEN field = 'symbol' THEN {SYMBOL_FACTOR} ELSE 1.0 END, 3) AS weight,
      surface IN (SELECT word FROM ev) AND popularity < {SURE} AS generic FROM ok JOIN di USING (surface) WHERE field = 'name' OR NOT name_only""",
)
def lexicon_evidence(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What the name, the symbol and the description of each item stand for, and how much each says."""
    return evidence(items_of(documents), named_things(benchmark), everyday_words(documents))
