"""Incremental upkeep of stored tables: new files in bounded batches, each committed together with the cursor.

The cursor is the stream's checkpoint, and the number of the last batch that a table has taken is part of the table's own manifest. A batch is merged in one
commit; if the job dies after that and before the stream has noted it, the batch comes again under its number and the table takes it for done. So a
run that was killed anywhere ends, once it is started again, with the same rows as one that was not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.plans.registry import Pack
from loomwright.sources import scratch
from loomwright.sources import stored as S
from loomwright.streaming.events import EVENTS

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql


def catch_up(stream: DataFrame, table: S.StoredTable, source: str, checkpoint: str, reduced: Callable[[DataFrame], DataFrame], order: Column | None = None) -> None:
    """Merges all that is there and has not been merged: ``reduced(batch)`` gives each batch's rows for the table."""

    def take(batch: DataFrame, number: int) -> None:
        table.merge(reduced(batch), source, number, order)

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(take).start()
    query.awaitTermination()


def files_of(spark, folder: str, schema: str, at_once: int) -> DataFrame:
    """A folder's Parquet files as a stream, so many in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(folder)


def daily_totals(batch: DataFrame) -> DataFrame:
    day = F.to_date("ts").alias("day")
    return batch.groupBy("user_id", day).agg(F.count("*").alias("n_items"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"), F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.max(F.struct("ts", "event_id")).alias("mark"))


def daily_table(spark, path: str) -> S.StoredTable:
    """Totals of users by day, kept up by batches that may bring any day again."""
    rules = {"n_items": S.added, "cents": S.added, "last": S.greatest, "latest": lambda c: F.max_by(c, "mark"), "mark": S.greatest}
    return S.StoredTable(spark, path, ["user_id", "day"], rules, buckets=8)


@pack.query("events", sql="SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n_items, sum(floor(value * 100)::BIGINT)::BIGINT AS cents, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY ALL")
def stream_maintenance(events: DataFrame) -> DataFrame:
    """Daily totals from files that are taken two at a time, in two runs: the second finds what the first had not seen."""
    spark = events.sparkSession
    folder, checkpoint = scratch.new_folder(spark, "incoming"), scratch.new_folder(spark, "cursor")
    table = daily_table(spark, scratch.new_folder(spark, "daily"))
    rows = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    for rest in (0, 1):
        rows.filter(F.col("event_id") % 2 == rest).repartition(5, "event_id").write.mode("append").parquet(folder)
        catch_up(files_of(spark, folder, EVENTS, 2), table, "events", checkpoint, daily_totals)
    return table.read().drop("mark").withColumn("day", F.col("day").cast("string"))
