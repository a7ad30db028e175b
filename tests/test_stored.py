"""Stored tables: repeated and failed batches, empty ones, null keys, editions behind a guard."""

import pytest
from pyspark.sql import functions as F

from loomwright.sources import stored as S

SCHEMA = "k string, at int, v int, name string"


def made(spark, tmp_path, **more):
    rules = {"at": S.greatest, "v": S.added, "name": S.known}
    return S.StoredTable(spark, f"file://{tmp_path}/t", ["k"], rules, buckets=4, **more)


def rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    table, batch = made(spark, tmp_path), lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert table.read().count() == 0
    assert table.merge(batch(("a", 1, 10, "one"), ("a", 2, 5, None), (None, 1, 1, "nobody")), "s", 1, F.col("at"))
    assert table.merge(batch(("a", 3, 1, None), ("b", 1, 7, "two")), "s", 2, F.col("at"))
    want = [("a", 3, 16, "one"), ("b", 1, 7, "two"), (None, 1, 1, "nobody")]
    assert rows(table) == sorted(want, key=str)
    assert not table.merge(batch(("a", 9, 100, "again")), "s", 2) and not table.merge(batch(("a", 9, 100, "again")), "s", 1)
    assert rows(table) == sorted(want, key=str)
    assert table.merge(batch(("a", 9, 100, "other source")), "other", 1) and ("a", 9, 116, "other source") in rows(table)
    assert table.merge(batch(), "s", 3) and table.state()["applied"] == {"s": 3, "other": 1}
    again = made(spark, tmp_path)
    assert rows(again) == rows(table)


def test_only_partitions_of_the_batch_are_written(spark, tmp_path):
    table = made(spark, tmp_path)
    table.merge(spark.createDataFrame([(f"k{i}", i, 1, "x") for i in range(40)], SCHEMA), "s", 1)
    before = table.state()["folders"]
    table.merge(spark.createDataFrame([("k7", 99, 1, "y")], SCHEMA), "s", 2)
    after = table.state()["folders"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert len(rows(table)) == 40 and ("k7", 99, 2, "y") in rows(table)
    assert table.vacuum() == 0 and len(rows(table)) == 40
    for number in range(3, 12):
        table.merge(spark.createDataFrame([(f"k{i}", i, 1, "x") for i in range(40)], SCHEMA), "s", number)
    assert table.vacuum() > 0 and len(rows(table)) == 40 and len(table._manifests()) == 1


def test_a_job_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path)
    table.merge(spark.createDataFrame([("a", 1, 1, "x")], SCHEMA), "s", 1)
    batch = spark.createDataFrame([("a", 2, 5, "y"), ("b", 1, 1, "z")], SCHEMA)

    def dies(self, state):
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr(S.StoredTable, "_commit", dies)
        with pytest.raises(RuntimeError):
            table.merge(batch, "s", 2)
    assert rows(table) == [("a", 1, 1, "x")]
    (tmp_path / "t/manifests/000000000002").write_text('{"schema": "k str')  # died in the middle of its manifest
    assert rows(table) == [("a", 1, 1, "x")]
    assert table.merge(batch, "s", 2) and rows(table) == [("a", 2, 6, "y"), ("b", 1, 1, "z")]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    table, other = made(spark, tmp_path), made(spark, tmp_path)
    table.merge(spark.createDataFrame([("a", 1, 1, "x")], SCHEMA), "s", 1)
    numbers = table._manifests()
    assert other.merge(spark.createDataFrame([("b", 1, 1, "x")], SCHEMA), "s", 2)
    monkeypatch.setattr(table, "_manifests", lambda: numbers)  # as if it had looked before the other one committed
    with pytest.raises(Exception, match="exist"):
        table._commit(table.state())
    assert rows(other) == [("a", 1, 1, "x"), ("b", 1, 1, "x")]


def test_refresh(spark, tmp_path):
    table = S.StoredTable(spark, f"file://{tmp_path}/t", ["k"], {"v": S.newest}, buckets=4)
    edition = lambda *ks, v=1: spark.createDataFrame([(k, v) for k in ks], "k string, v int")
    assert table.refresh(edition(*"abcdef"), "e", 1)
    assert not table.refresh(edition("a"), "e", 2) and not table.refresh(edition(), "e", 2)
    assert table.refresh(edition("a", "b", "c", "x", v=2), "e", 2, complete=False)
    assert rows(table) == [("a", 2), ("b", 2), ("c", 2), ("d", 1), ("e", 1), ("f", 1), ("x", 2)]
    assert table.refresh(edition("a", "b", "c", "y", v=3), "e", 3)
    assert rows(table) == [("a", 3), ("b", 3), ("c", 3), ("y", 3)]
    assert not table.refresh(edition(*"abcdefgh"), "e", 3)
