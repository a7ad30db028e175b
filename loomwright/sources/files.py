"""Readers of files that come with a deployment: JSON and gzip JSON records, gzip word lists, and tolerant documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """JSON records, gzip or plain by the file's ending: a line each, or one array in a file (``whole``). Fields that are missing are null, others are left out; broken lines give null rows."""
    return spark.read.schema(schema).option("multiLine", whole).option("mode", "PERMISSIVE").json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a text file (gzip or plain), one on each line; empty lines and lines after ``#`` don't count."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return lines.filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def envelope(document: Column, schema: str) -> Column:
    """A stored JSON document as a struct of the current schema, whatever older fields it has or lacks; null if it is no JSON."""
    return F.from_json(document, schema, {"mode": "PERMISSIVE"})
