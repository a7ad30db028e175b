"""Vectors and hashes: nearest labels, margins, blends and near duplicates by Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.encoders import Letters, best_prompt, unit_vectors
from loomwright.plans.registry import Pack

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

DIMENSIONS = 64
MOST_BITS = 14

_COSINE = """c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL),
    cs AS (SELECT label, list(m ORDER BY i) AS centroid FROM c GROUP BY label),
    s AS (SELECT vec_id, e.label AS own, cs.label, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), centroid) AS score FROM embeddings e, cs)"""


def centroids(embeddings: DataFrame) -> DataFrame:
    """Mean vector of each label: one row for each label."""
    means = embeddings.groupBy("label").agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(DIMENSIONS)])
    return means.select("label", F.array(*[f"m{i}" for i in range(DIMENSIONS)]).alias("centroid"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)


def cosines(embeddings: DataFrame) -> DataFrame:
    """Every vector against every label's centroid; the labels are few, so their centroids are broadcast as one array."""
    named = F.broadcast(centroids(embeddings).agg(F.collect_list(F.struct("label", "centroid")).alias("all")))  # one row, one entry for each label
    rows = embeddings.withColumnRenamed("label", "own").crossJoin(named).select("vec_id", "own", "embedding", F.inline("all"))
    score = _dot(F.col("embedding"), F.col("centroid")) / F.sqrt(_dot(F.col("embedding"), F.col("embedding")) * _dot(F.col("centroid"), F.col("centroid")))
    return rows.select("vec_id", "own", "label", score.alias("score"))


@pack.query("embeddings", sql=f"WITH {_COSINE} SELECT vec_id, arg_max(label, score) AS nearest, round(max(score), 4) AS score FROM s GROUP BY vec_id")
def nearest_label(embeddings: DataFrame) -> DataFrame:
    """The label whose centroid is nearest by cosine."""
    return cosines(embeddings).groupBy("vec_id").agg(F.max_by("label", "score").alias("nearest"), F.round(F.max("score"), 4).alias("score"))


@pack.query(
    "embeddings",
    sql=f"""WITH {_COSINE}, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC) AS n, score - lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC) AS margin FROM s)
    SELECT vec_id, label, round(margin, 4) AS margin, round(least(0.4, 0.25 + 0.15 * greatest(0, score - 0.45) / 0.2), 4) AS weight FROM o WHERE n = 1 AND score >= 0.45 AND margin >= 0.03""",
)
def nearest_margin(embeddings: DataFrame) -> DataFrame:
    """Nearest labels that are near enough and clear of the next, with the weight of their evidence."""
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"))
    o = cosines(embeddings).withColumns({"n": F.row_number().over(w), "margin": F.col("score") - F.lead("score").over(w)})
    weight = F.least(F.lit(0.4), 0.25 + 0.15 * F.greatest(F.lit(0.0), F.col("score") - 0.45) / 0.2)
    return o.filter("n = 1 AND score >= 0.45 AND margin >= 0.03").select("vec_id", "label", F.round("margin", 4).alias("margin"), F.round(weight, 4).alias("weight"))


@pack.query(
    "embeddings",
    sql=f"""WITH {_COSINE}, p AS (SELECT vec_id, label, exp(10 * score) / sum(exp(10 * score)) OVER (PARTITION BY vec_id) AS a, exp(CASE WHEN label = own THEN 2.0 ELSE 0 END) / sum(exp(CASE WHEN label = own THEN 2.0 ELSE 0 END)) OVER (PARTITION BY vec_id) AS b FROM s)
    SELECT vec_id, label, round(0.5 * a + 0.5 * b, 4) AS p FROM p""",
)
def softmax_blend(embeddings: DataFrame) -> DataFrame:
    """Two softmax distributions over labels, mixed half and half."""
    w = Window.partitionBy("vec_id")
    a, b = F.exp(10 * F.col("score")), F.exp(F.when(F.col("label") == F.col("own"), 2.0).otherwise(0.0))
    return cosines(embeddings).select("vec_id", "label", F.round(0.5 * a / F.sum(a).over(w) + 0.5 * b / F.sum(b).over(w), 4).alias("p"))


def sign_hash(embedding):
    """The signs of 64 numbers as the bits of a long, the first as the lowest."""
    bits = [F.shiftleft(F.when(F.get(embedding, F.lit(i)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), i) for i in range(DIMENSIONS)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def images(embeddings: DataFrame) -> DataFrame:
    """id and numbers of every vector, and below zero those of copies: of every eighth vector with five or four of its numbers turned round, and of the next one read from its end."""
    turned = F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 13 == 0, -x).otherwise(x))
    rest, copy = F.col("vec_id") % 8, (-F.col("vec_id") - 1).alias("id")
    copies = embeddings.filter(rest == 0).select(copy, turned.alias("numbers")).union(embeddings.filter(rest == 1).select(copy, F.reverse(turned)))
    return embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("numbers")).union(copies)


def image_hashes(embeddings: DataFrame) -> DataFrame:
    """id, hash and the hash of the mirrored image: the signs of all 64 numbers, from either end. A missing number counts as not positive."""
    return images(embeddings).select("id", sign_hash(F.col("numbers")).alias("hash"), sign_hash(F.reverse("numbers")).alias("mirror"))


#: Twin of the hashes: 64 letters for each image.
_BITS = """t AS (SELECT vec_id, embedding, list_transform(embedding, lambda x, i: CASE WHEN (i - 1 + vec_id) % 13 = 0 THEN -x ELSE x END) AS turned FROM embeddings),
    im AS (SELECT vec_id, embedding AS v FROM t UNION ALL SELECT -vec_id - 1, turned FROM t WHERE vec_id % 8 = 0 UNION ALL SELECT -vec_id - 1, list_reverse(turned) FROM t WHERE vec_id % 8 = 1),
    h AS (SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM im)"""


def near_masks(width: int, most: int) -> list[int]:
    """Numbers of ``width`` bits with at most ``most`` of them set."""
    return [sum(1 << k for k in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def hamming_pairs(hashes: DataFrame, most: int = MOST_BITS, bands: int = 5) -> DataFrame:
    """Pairs (a, b, distance) of rows (id, hash, mirror) at most ``most`` bits apart, plain or mirrored.

    A hash is cut into bands. Two hashes within ``most`` bits are within ``most // bands`` on one of them, so one side asks with its band and the other
    answers for all values that near to its own: an equi join that misses no pair. With 64 bits, 14 of them and five bands it looks at one pair in eighteen.
    """
    width = [(DIMENSIONS * k // bands, DIMENSIONS * (k + 1) // bands) for k in range(bands)]
    value = lambda column, a, b: F.shiftrightunsigned(column, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    # The band's number goes into the bits above its value.
    own = lambda column: [value(column, a, b).bitwiseOR(F.lit(k << 32)) for k, (a, b) in enumerate(width)]

    def near(band, bits: int):
        return F.transform(F.array(*[F.lit(m).cast("long") for m in near_masks(bits, most // bands)]), lambda m: band.bitwiseXOR(m))

    def around(column):
        return F.concat(*[near(x, b - a) for x, (a, b) in zip(own(column), width, strict=True)])

    left = hashes.select(F.col("id").alias("a"), F.col("hash").alias("h"), F.explode(F.array(*own(F.col("hash")))).alias("band"))
    right = hashes.select(F.col("id").alias("b"), F.col("hash").alias("g"), F.col("mirror").alias("m"), F.explode(F.array_distinct(F.concat(around(F.col("hash")), around(F.col("mirror"))))).alias("band"))
    distance = F.least(F.bit_count(F.col("h").bitwiseXOR(F.col("g"))), F.bit_count(F.col("h").bitwiseXOR(F.col("m"))))
    found = left.join(right, (left["band"] == right["band"]) & (F.col("a") < F.col("b")) & (distance <= most))
    return found.select("a", "b", distance.cast("int").alias("distance")).distinct()


@pack.query(
    "embeddings",
    sql=f"""
    WITH {_BITS}
    SELECT a.vec_id AS a, b.vec_id AS b, least(hamming(a.bits, b.bits), hamming(a.bits, reverse(b.bits)))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id
    WHERE least(hamming(a.bits, b.bits), hamming(a.bits, reverse(b.bits))) <= 14""",
)
def near_dup_hamming(embeddings: DataFrame) -> DataFrame:
    """Pairs of hashes at most 14 bits apart, plain or mirrored."""
    return hamming_pairs(image_hashes(embeddings))


@pack.query(
    "embeddings",
    sql=f"""
    WITH {_BITS},
    p AS (SELECT a.vec_id AS item, b.vec_id AS other, least(hamming(a.bits, b.bits), hamming(a.bits, reverse(b.bits))) AS d FROM h a JOIN h b ON a.vec_id != b.vec_id)
    SELECT item, other, d::INT AS distance, CASE WHEN d <= 8 THEN 0.85 ELSE 0.6 END AS strength FROM p WHERE d <= 14 QUALIFY row_number() OVER (PARTITION BY item ORDER BY d, other) <= 10""",
)
def near_dup_strength(embeddings: DataFrame) -> DataFrame:
    """The ten nearest near duplicates of each item, and how strong each is as evidence."""
    pairs = hamming_pairs(image_hashes(embeddings))
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("other"), "distance").unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("other"), "distance"))
    nearest = both.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy("distance", "other"))).filter("n <= 10")
    return nearest.select("item", "other", "distance", F.when(F.col("distance") <= 8, 0.85).otherwise(0.6).alias("strength"))


#: Letters that stand for a text, and prompts of each label.
LETTERS, PROMPTS = "aeinorst", {"late": ["tttoo s", "other rest"], "early": ["eee aa", "inner near"], "plain": ["soon iron"]}
_PROMPTS = ", ".join(f"('{label}', '{text}')" for label, texts in PROMPTS.items() for text in texts)
_LETTER_COUNTS = f"list_transform(string_split('{LETTERS}', ''), lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE)"


@pack.query(
    "benchmark",
    sql=f"""WITH b AS (SELECT item_id, lower(text) AS t FROM benchmark), v AS (SELECT item_id, {_LETTER_COUNTS} AS v FROM b), q AS (SELECT label, {_LETTER_COUNTS} AS q FROM (VALUES {_PROMPTS}) p(label, t)),
    s AS (SELECT item_id, label, max(list_cosine_similarity(v, q)) AS score FROM v, q GROUP BY ALL), r AS (SELECT *, lead(score) OVER (PARTITION BY item_id ORDER BY score DESC) AS second, row_number() OVER (PARTITION BY item_id ORDER BY score DESC) AS n FROM s)
    SELECT item_id, label, round(score, 6) AS score, round(least(0.4, 0.25 + 0.15 * (score - 0.45) / 0.2), 6) AS weight FROM r WHERE n = 1 AND score >= 0.45 AND score - second >= 0.03""",
)
def encoded_texts(benchmark: DataFrame) -> DataFrame:
    """Texts encoded in batches by an injected encoder, and the label whose prompt is nearest if it leads clearly."""
    encoder = Letters(LETTERS)

    def unit(text):
        v = encoder.encode([text])[0]
        return v / np.sqrt((v * v).sum())

    prompts = {label: [unit(t) for t in texts] for label, texts in PROMPTS.items()}
    rows = benchmark.select("item_id", unit_vectors(F.lower("text"), encoder).alias("v"))
    best = rows.select("item_id", best_prompt(F.col("v"), prompts, 0.45, 0.03).alias("b")).filter("b IS NOT NULL")
    return best.select("item_id", "b.label", F.round("b.score", 6).alias("score"), F.round("b.weight", 6).alias("weight"))
