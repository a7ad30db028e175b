"""Stored tables that batches are merged into: copy-on-write by hash partitions of the key, committed by a manifest.

A table is a folder. Rows lie in ``buckets`` partitions by a hash of their key; a merge reads and rewrites only the partitions that the batch's keys
fall into, into a folder of its own, and then commits by one small manifest file that names the folder of every partition. Until that file is whole nobody sees the merge,
so a job that dies leaves the table as it was. Batches are numbered by their writer: the manifest holds the last number of each source, and a batch that comes
again changes nothing. Manifests are made exclusively, so of two writers at once one fails and can run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NEW, _AT = "_new", "_at"


def newest(name: str) -> Column:
    """The value of the last row, null or not."""
    return F.max_by(F.struct(name), F.struct(_NEW, _AT))[name]


def known(name: str) -> Column:
    """The value of the last row that has one."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(_NEW, _AT)))


def first_known(name: str) -> Column:
    """The value of the first row that has one: what is stored stays."""
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.struct(_NEW, _AT)))


def added(name: str) -> Column:
    return F.sum(name)


def greatest(name: str) -> Column:
    return F.max(name)


def least(name: str) -> Column:
    return F.min(name)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


class StoredTable:
    """A table of rows with unique ``keys`` and a rule for each further column: how stored and new values of a key become one.

    Rules are aggregates over the stored row and the batch's rows of a key, which may be many; the order among a batch's rows is that of ``merge``'s ``order``.
    Null keys are a key like others.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rules: dict[str, Callable[[str], Column]], buckets: int = 64):
        self.spark, self.path, self.keys, self.rules, self.buckets = spark, path.rstrip("/"), keys, rules, buckets

    # -- manifests

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _manifests(self) -> dict[int, str]:
        fs, where = self._fs(f"{self.path}/manifests")
        if not fs.exists(where):
            return {}
        return {int(f.getPath().getName()): f.getPath().toString() for f in fs.listStatus(where) if f.getPath().getName().isdigit()}

    def _read(self, path: str) -> dict | None:
        """A manifest, or None where its writer died before it was whole."""
        fs, where = self._fs(path)
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def state(self) -> dict:
        """The last whole manifest: schema, folder of each partition, and the last batch of each source."""
        for _, path in sorted(self._manifests().items(), reverse=True):
            if found := self._read(path):
                return found
        return {"schema": None, "buckets": self.buckets, "folders": {}, "applied": {}}

    def _commit(self, state: dict) -> None:
        number = max(self._manifests(), default=0) + 1
        fs, where = self._fs(f"{self.path}/manifests/{number:012d}")
        stream = fs.create(where, False)  # fails if another writer was first
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()

    # -- rows

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _stored(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        folders = [f for b, f in state["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return None
        return self.spark.read.schema(state["schema"]).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        """The table as of the last commit; before the first one it has no columns of its own."""
        state = self.state()
        rows = self._stored(state)
        return rows if rows is not None else self.spark.createDataFrame([], state["schema"] or "none int")

    def _write(self, rows: DataFrame, state: dict, touched: list[int]) -> dict:
        """A state whose ``touched`` partitions hold ``rows`` alone; partitions without rows are gone."""
        folder = f"data/{uuid.uuid4().hex}"
        names = [*self.keys, *self.rules]
        rows = rows.select(*names)
        rows.withColumn("_bucket", self._bucket(state["buckets"])).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, where = self._fs(f"{self.path}/{folder}")
        made = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched}
        folders |= {name.partition("=")[2]: f"{folder}/{name}" for name in made if name.startswith("_bucket=")}
        return state | {"folders": folders, "schema": _ddl(rows)}

    def _merged(self, stored: DataFrame | None, batch: DataFrame, order: Column | None) -> DataFrame:
        names = [*self.keys, *self.rules]
        new = batch.select(*names, F.lit(True).alias(_NEW), (order if order is not None else F.lit(0)).alias(_AT))
        if stored is not None:
            at = new.schema[_AT].dataType
            new = stored.select(*names, F.lit(False).alias(_NEW), F.lit(None).cast(at).alias(_AT)).unionByName(new)
        return new.groupBy(*self.keys).agg(*[rule(name).alias(name) for name, rule in self.rules.items()])

    def merge(self, batch: DataFrame, source: str, number: int, order: Column | None = None) -> bool:
        """Merges a batch unless it or a later one of its source has been; says whether it did. ``order`` tells which of a batch's rows of one key is the last."""
        state = self.state()
        if state["applied"].get(source, -1) >= number:
            return False
        touched = sorted(r[0] for r in batch.select(self._bucket(state["buckets"]).alias("b")).distinct().collect())  # partition numbers
        if touched:
            state = self._write(self._merged(self._stored(state, touched), batch, order), state, touched)
        elif not state["schema"]:
            state = state | {"schema": _ddl(self._merged(None, batch, order).select(*self.keys, *self.rules))}
        self._commit(state | {"applied": state["applied"] | {source: number}})
        return True

    def refresh(self, batch: DataFrame, source: str, number: int, least_share: float = 0.5, complete: bool = True, order: Column | None = None) -> bool:
        """Merges a whole new edition and, if it is ``complete``, deletes stored keys that it lacks. An edition of no rows, or of fewer keys than ``least_share`` of the
        stored ones, changes nothing."""
        state = self.state()
        if state["applied"].get(source, -1) >= number:
            return False
        stored, keys = self._stored(state), batch.select(*self.keys).distinct()
        got = keys.count()
        if not got or stored is not None and got < least_share * stored.count():
            return False
        if stored is not None and complete:
            same = [stored[k].eqNullSafe(keys[k]) for k in self.keys]
            stored = stored.join(keys, same, "left_semi")
        state = self._write(self._merged(stored, batch, order), state, list(range(state["buckets"])))
        self._commit(state | {"applied": state["applied"] | {source: number}})
        return True

    def vacuum(self) -> int:
        """Deletes folders that the last manifest doesn't name and the manifests before it; says how many folders went. For times without readers or writers."""
        state, gone = self.state(), 0
        named = {f.split("/")[1] for f in state["folders"].values()}
        fs, where = self._fs(f"{self.path}/data")
        for f in fs.listStatus(where) if fs.exists(where) else []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)
                gone += 1
        whole = [n for n, path in self._manifests().items() if self._read(path)]
        for n, path in self._manifests().items():
            if whole and n < max(whole):
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), False)
        return gone
