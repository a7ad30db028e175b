"""The pipeline against brute force, stage by stage, and as a whole."""

import random

import corpus_pipeline
from loomwright.llm import queries
from tests.llm.test_operators import brute_components, lowered, toxic_rows, words


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    rows = [(i, t) for i, t, _ in toxic_rows(400)]
    item = words(rng, 30)
    clean = next(t for i, t, x in toxic_rows(400) if x == 0)
    base = words(rng, 200)
    near = [*base[:100], "changed", *base[101:]]
    rows += [(1000, clean), (1001, clean.upper()), (1002, " ".join(base)), (1003, " ".join(near)), (1004, " ".join(words(rng, 40) + item)), (1005, None), (1006, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in toxic_rows(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path)).persist()
        if name != "best-fit packing":
            assert found.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] if "text" in found.columns else None for r in found.collect()}
        docs = found
    toxic = {i for i, _, x in toxic_rows(400) if x}
    first = set(kept["toxicity"])
    assert len(toxic & first) <= 5 and len(set(dict(rows)) - toxic - first) <= 5
    groups = {}
    for i, t in kept["toxicity"].items():
        groups[lowered(t)] = max(i, groups.get(lowered(t), i))
    assert set(kept["exact dedup"]) == set(groups.values())
    want = brute_components(kept["exact dedup"].items())
    assert set(kept["n-gram Jaccard join"]) == {i for i, (_, c) in want.items() if c == i}
    assert set(kept["benchmark decontamination"]) == set(kept["n-gram Jaccard join"]) - {1004}
    assert set(kept["best-fit packing"]) == set(kept["benchmark decontamination"])
    whole = queries.QUERIES["pipeline"](spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == set(kept["best-fit packing"])


CLASHING = ("rep", "set", "group", "row", "bad_id", "bad_row", "seed", "at", "tokens", "score", "digest", "n", "d1", "keys", "point", "_sha", "_rep", "length", "piece")


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = [(1, "a text of some words here", "en", "s", 25), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "A text of some words here", "en", "s", 25), (None, "no id", "en", "s", 5)]
    for rows, left in (([], []), ([(*r, *CLASHING) for r in some], [None, 3, 4])):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "best-fit packing":
                assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == list(CLASHING)
        assert sorted((r["doc_id"] for r in docs.collect()), key=lambda x: -1 if x is None else x) == left
