"""Post matching letter by letter, as its SQL does it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwright.functions import matching as M
from loomwright.plans import matching
from tests.test_queries import rows

TEXTS = ["straße groß", "ΑΣ ΟΔΟΣ", "ﬁn ŉ İx", "ᾳ ᾼ ǰ և", "ƛɤ", "plain Text", "ß", "", None]


def test_case_of_single_letters(spark):
    duck = duckdb.connect()
    got = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, t string").select("k", M.lower(F.col("t")).alias("l"), M.upper(F.col("t")).alias("u")).orderBy("k").collect()
    assert [(r["l"], r["u"]) for r in got] == [duck.execute("SELECT lower($1::VARCHAR), upper($1::VARCHAR)", [t]).fetchone() for t in TEXTS]


def test_rounding_of_a_fused_name_with_a_ticker_one_off(spark):
    df = spark.createDataFrame([(1 - (1 - 0.85 * 0.9) * (1 - 0.55 * 0.35),), (0.0,), (0.125,), (1.0,)], "x double")
    assert [r[0] for r in df.select(M.rounded(F.col("x"), 6)).collect()] == [0.810238, 0.0, 0.125, 1.0]


TURNS = [
    (1, 0, "Keitß einpflich"), (1, 1, "nothing"), (1, 2, "keitß again"), (1, 3, "$KEIT"), (1, 4, "x"), (2, 0, "große Straße"), (2, 1, "GROẞE"), (2, 2, "grosse strasse"), (2, 5, "große"),
    (3, 0, "ΛΟΓΟΣ νέος"), (3, 1, "λογος"), (3, 3, "λογοσ"), (4, 0, "İstanbul post"), (4, 1, "istanbul"), (4, 2, "i̇stanbul"), (5, 0, "KEITÄ"), (5, 2, "the $KEIT"), (5, 5, "$KEITA"), (6, 0, None), (6, 1, "x"), (7, 1, "no first"),
    (8, 0, "calm lake"), (8, 3, "the calmlake $CALN"), (9, 0, "odd one"), (9, 1, None), (9, 1, "odd"), (9, 1, "odd"), (9, 1, "odd even"),
]


@pytest.mark.parametrize("repeated", [1, 40])
def test_posts_with_odd_letters_and_repeated_turns(spark, repeated):
    duck = duckdb.connect()
    turns = TURNS + [(10, 1, "odd")] * repeated + [(11 + k, 1, "even") for k in range(repeated)]
    df = spark.createDataFrame([(c, t, "user", text) for c, t, text in turns], "conv_id long, turn long, role string, text string")
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, 'user', ?)", turns)
    got, want = matching.post_matches(df), duck.sql(matching.ORACLE_SQL["post_matches"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    everyday = {r[0] for r in matching.everyday_words(df).collect()}
    assert ("odd" in everyday) == (repeated == 1)
