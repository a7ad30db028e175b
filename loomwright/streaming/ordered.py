"""Keyed state that moves on in order of event time, with deadlines: jobs with leases and the index of what is listed.

Rows wait in a list of the state store until the watermark has passed them and are then taken in order of (time, id), whatever micro-batch brought them, so the
result depends neither on how files are dealt to batches nor on retries. Deadlines (a lease runs out, a term leaves the list) take their place among the rows by time;
where no row follows, a timer fires once the watermark passes them. Rows that the watermark has not passed when the stream ends stay in the state.
Rows come one by one; a key keeps its rows of about one watermark delay, which are read and written together, once for each micro-batch that has rows or a deadline of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MILLI = 1000


class InOrder(StatefulProcessor):
    """``start`` is a new key's state as a tuple, ``state_schema`` its columns, ``pending_schema`` those of ``taken(row)``, what is kept of a row; ``advance(state, at, taken)`` and
    ``expire(state, at)`` give the next state and the output tuples, and ``deadline(state)`` the time in microseconds when it expires, or None."""

    start: tuple = ()
    state_schema = pending_schema = ""
    columns: tuple[str, ...] = ()

    def taken(self, row: Row) -> tuple:
        raise NotImplementedError

    def advance(self, state: tuple, at: int, taken: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        return None

    def expire(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return state, []

    # -- the processor

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.pending = handle.getListState("pending", f"at long, id long, {self.pending_schema}")

    def _run(self, key, watermark: int, new: list[tuple]) -> Iterator[Row]:
        """Everything that is due by the watermark (microseconds), rows and deadlines in order; then one timer for the next."""
        held = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        due = sorted(held + new, key=lambda x: x[:2])
        state = tuple(self.state.get()) if self.state.exists() else self.start
        rest = len(due)
        for n, (at, _, *taken) in enumerate([*due, (None, None)]):
            while (ends := self.deadline(state)) is not None and ends <= watermark and (at is None or ends <= at):
                state, out = self.expire(state, ends)
                yield from (Row(**dict(zip(self.columns, (*key, *x), strict=True))) for x in out)
            if at is None or at > watermark:
                rest = n
                break
            state, out = self.advance(state, at, tuple(taken))
            yield from (Row(**dict(zip(self.columns, (*key, *x), strict=True))) for x in out)
        if rest < len(due):
            self.pending.put(due[rest:])
        elif held:
            self.pending.clear()
        if state == self.start:
            self.state.clear()
        else:
            self.state.update(state)
        ends = self.deadline(state)
        times = [t // _MILLI + 1 for t in (due[rest][0] if rest < len(due) else None, ends) if t is not None]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(max(min(times), watermark // _MILLI + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(row["us"], row["event_id"], *self.taken(row)) for row in rows]
        yield from self._run(key, max(0, timerValues.getCurrentWatermarkInMs()) * _MILLI, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._run(key, timerValues.getCurrentWatermarkInMs() * _MILLI, [])

    def close(self) -> None:
        return


def in_order(rows: DataFrame, key: str, processor: InOrder, schema: str, delay: str) -> DataFrame:
    """Runs a processor over a stream with columns ``at`` (event time), ``us`` (the same in microseconds) and ``event_id``; rows without a time are left out."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = rows.filter("us IS NOT NULL").withWatermark("at", delay)
    return timed.groupBy(key).transformWithState(processor, schema, "append", "EventTime")


HOUR = 3_600_000_000


class Jobs(InOrder):
    """A job for each key, with leases. ``enqueue`` opens one unless one is open; ``claim`` starts a waiting one whose time has come, for the length of a lease; ``renew`` prolongs the lease;
    ``complete`` ends it; ``fail`` sends it back to wait for a while, or ends it once its attempts are used up; ``defer`` sends it back without using one. A lease that runs out
    is a failure without the wait."""

    state_schema = "state string, until long, tried int"
    pending_schema = "what string"
    start = ("none", 0, 0)

    def __init__(self, columns: tuple[str, ...], attempts: int = 3, lease: int = 12 * HOUR, retry: int = HOUR, later: int = 2 * HOUR):
        self.columns, self.attempts, self.lease, self.retry, self.later = columns, attempts, lease, retry, later

    def taken(self, row):
        return (row["what"],)

    def advance(self, state, at, taken):
        (name, until, tried), what = state, taken[0]
        if name == "none":
            return ("waiting", at, 0) if what == "enqueue" else state, []
        if name == "waiting":
            return ("running", at + self.lease, tried + 1) if what == "claim" and at >= until else state, []
        if what == "renew":
            return ("running", at + self.lease, tried), []
        if what == "complete":
            return self.start, [(at, "done", tried)]
        if what == "defer":
            return ("waiting", at + self.later, max(0, tried - 1)), []
        if what == "fail":
            return self._failed(at, tried, at + self.retry, "failed")
        return state, []

    def _failed(self, at, tried, again, outcome):
        return (self.start, [(at, outcome, tried)]) if tried >= self.attempts else (("waiting", again, tried), [])

    def deadline(self, state):
        return state[1] if state[0] == "running" else None

    def expire(self, state, at):
        return self._failed(at, state[2], at, "expired")


class Listed(InOrder):
    """What lists show of a term while it is listed: it leaves the index when no list has shown it for ``keep``, and only the last ``history`` before its last place counts.

    Emits, for each time that it was listed: first and last time, how often, best, first and last place, and the direction: falling if the last place is ``drop`` or more below the best,
    rising if it is above the first, else steady. Places are kept by time in the state, no more of them than ``history`` spans."""

    state_schema = "since long, last long, places array<struct<at:long,place:int>>"
    pending_schema = "place int"
    start = (0, 0, [])

    def __init__(self, columns: tuple[str, ...], keep: int = 24 * HOUR, history: int = 48 * HOUR, drop: int = 10):
        self.columns, self.keep, self.history, self.drop = columns, keep, history, drop

    def taken(self, row):
        return (row["place"],)

    def advance(self, state, at, taken):
        since, _, places = state
        kept = [(t, p) for t, p in map(tuple, places) if t > at - self.history]
        return (since if places else at, at, [*kept, (at, taken[0])]), []

    def deadline(self, state):
        return state[1] + self.keep if state[2] else None

    def expire(self, state, at):
        since, last, places = state
        shown = [p for _, p in map(tuple, places)]
        best = min(shown)
        direction = "falling" if shown[-1] >= best + self.drop else "rising" if shown[-1] < shown[0] else "steady"
        return self.start, [(since, last, len(shown), best, shown[0], shown[-1], direction)]
