"""Every query of the core on tables without rows, and many on tables whose only row is null in every column: no crash."""

import os

import pytest

from loomwright.plans import catalogue, kinship, lexicon, likeness, limits, matching, meta, stored, trending, vectors
from loomwright.sources.tables import TABLES
from loomwright.streaming import maintenance

#: Packs whose queries also get rows of nulls.
WITH_NULLS = (kinship, lexicon, likeness, limits, matching, meta, stored, trending, vectors, maintenance)

SOURCE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="the driver's tables are not here")


def folder_of(spark, tmp_path_factory, kind):
    folder = f"file://{tmp_path_factory.mktemp(kind)}"
    for name in TABLES:
        df = spark.read.parquet(f"{SOURCE}/{name}.parquet")
        rows = [] if kind == "empty" else [tuple(None for _ in df.columns)]
        spark.createDataFrame(rows, df.schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder_of(spark, tmp_path_factory, "empty")


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    return folder_of(spark, tmp_path_factory, "nulls")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, empty, name):
    df = catalogue.QUERIES[name](spark, empty)
    assert df.columns
    df.count()


@pytest.mark.parametrize("name", sorted(name for pack in WITH_NULLS for name in pack.QUERIES))
def test_rows_of_nulls(spark, nulls, name):
    catalogue.QUERIES[name](spark, nulls).collect()
