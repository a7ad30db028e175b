"""Tables that are written in steps: versions appended, partitions replaced. Each step is one Spark write, so a task that runs again leaves no second copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_versions(spark: SparkSession, path: str, rows: DataFrame, key: str, order: str) -> None:
    """Appends rows with ``version``: the next numbers after those that the table has for the key. The first call makes the table."""
    try:
        known = spark.read.parquet(path).groupBy(key).agg(F.max("version").alias("_last"))
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = spark.createDataFrame([], f"{rows.schema[key].simpleString().replace(':', ' ', 1)}, _last int")
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    numbered = numbered.join(known, key, "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int"))
    numbered.drop("_n", "_last").write.mode("append").parquet(path)


def replace_partitions(path: str, rows: DataFrame, column: str) -> None:
    """Writes rows so that the partitions they have replace those of the table; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
