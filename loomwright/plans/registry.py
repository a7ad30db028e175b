"""A pack of queries: functions of (spark, sf_dir), registered with their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.sources.tables import table

#: The fixed clock of all time-relative queries; nothing reads the wall clock.
AS_OF = "2024-01-31 00:00:00"


class Pack:
    """Collects queries. ``tables`` names the inputs the function gets after its own arguments."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, *tables: str, sql: str | None = None):
        def keep(make):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return make(*(table(spark, sf_dir, name) for name in tables))

            run.__name__, run.__doc__ = make.__name__, make.__doc__
            self.queries[make.__name__] = run
            if sql is not None:
                self.sql[make.__name__] = sql
            return make

        return keep
