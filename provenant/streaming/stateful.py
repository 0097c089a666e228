"""Keyed state with typed values and timers: triage, the checkpoint journal and retention as streams.

They run on ``transformWithState``, so a session needs ``spark.sql.streaming.stateStore.providerClass`` to name the RocksDB provider (``ROCKSDB``): state
lives on disk beside the executors and in the query's checkpoint, and a restarted query goes on where it was. State is a few values a key; no history is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provenant.operators.lifecycle import TRIAGE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Triage(StatefulProcessor):
    """The state of each finding; every command is answered by an event that says what it did."""

    def __init__(self, start: str, table: dict[str, dict[str, str]], ttl_ms: int | None) -> None:
        self.start, self.moves, self.ttl_ms = start, table, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.life = handle.getValueState("life", "state string, applied long, rejected long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, applied, rejected = self.life.get() if self.life.exists() else (self.start, 0, 0)
        for r in sorted(rows, key=lambda r: r.ord):
            to = self.moves.get(r.command, {}).get(state)
            applied, rejected = applied + (to is not None), rejected + (to is None)
            yield Row(key=key[0], ord=r.ord, command=r.command, previous=state, state=to or state, accepted=to is not None, n_applied=applied, n_rejected=rejected)
            state = to or state
        self.life.update((state, applied, rejected))

    def close(self) -> None:
        pass


def triage(commands: DataFrame, start: str, table: dict[str, dict[str, str]] = TRIAGE, ttl_ms: int | None = None) -> DataFrame:
    """``commands(key, ord, command)`` -> an append-only event for each: ``key, ord, command, previous, state, accepted, n_applied, n_rejected``.

    Commands of one batch are taken in order of ``ord``; a command without a transition changes nothing. ``ttl_ms``: a finding without commands for so long
    begins anew.
    """
    shaped = commands.select("key", F.col("ord").cast("long").alias("ord"), "command")
    kind = commands.schema["key"].dataType.simpleString()
    return shaped.groupBy("key").transformWithState(
        Triage(start, table, ttl_ms), f"key {kind}, ord long, command string, previous string, state string, accepted boolean, n_applied long, n_rejected long", "Append", "None" if ttl_ms is None else "ProcessingTime")


class Journal(StatefulProcessor):
    """A unit of work: running units that are not heard of in time count as abandoned and may be retried."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unit = handle.getValueState("unit", "status string, attempts long, until long")

    def _put(self, key, status: str, attempts: int, until: int | None) -> Row:
        self.unit.update((status, attempts, until))
        return Row(stage=key[0], unit_key=key[1], status=status, attempt_count=attempts)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, attempts, until = self.unit.get() if self.unit.exists() else ("pending", 0, None)
        before = until
        for r in sorted(rows, key=lambda r: r.ord):
            if status == "completed":
                continue
            if r.kind == "begin":
                status, attempts, until = "running", attempts + 1, r.at + self.patience_ms
            elif r.kind in ("complete", "fail"):
                status, until = ("completed" if r.kind == "complete" else "failed_retryable"), None
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if until is not None:
                self.handle.registerTimer(until)
        yield self._put(key, status, attempts, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempts, until = self.unit.get()
        if status == "running" and until == expiredTimerInfo.getExpiryTimeInMs():
            yield self._put(key, "failed_retryable", attempts, None)

    def close(self) -> None:
        pass


def journal(events: DataFrame, late: str, patience_ms: int) -> DataFrame:
    """``events(stage, unit_key, kind, ord, at)`` (at: a timestamp; kinds begin, complete, fail) -> ``stage, unit_key, status, attempt_count`` at each change.

    begin: running, one more attempt, unless completed; complete and fail act on what is not completed. A unit that runs for more than ``patience_ms`` of
    event time, by the watermark of ``late``, without another event, is failed_retryable.
    """
    shaped = events.withWatermark("at", late).select("stage", "unit_key", "kind", F.col("ord").cast("long").alias("ord"), F.unix_millis("at").alias("at_ms"), "at")
    named = shaped.select("stage", "unit_key", "kind", "ord", F.col("at").alias("event_time"), F.col("at_ms").alias("at"))
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in ("stage", "unit_key"))
    return named.groupBy("stage", "unit_key").transformWithState(Journal(patience_ms), f"{kinds}, status string, attempt_count long", "Update", "EventTime")


class Retention(StatefulProcessor):
    """An artifact has one timer; a later event moves it, a deletion ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r.ord)
        if self.ends.exists():
            self.handle.deleteTimer(self.ends.get()[0])
        if last.deleted or last.expires is None:
            self.ends.clear()
        else:
            self.ends.update((last.expires,))
            self.handle.registerTimer(last.expires)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.ends.exists() and self.ends.get()[0] == due:
            self.ends.clear()
            yield Row(artifact_id=key[0], expires=due)

    def close(self) -> None:
        pass


def retention(artifacts: DataFrame, late: str) -> DataFrame:
    """``artifacts(artifact_id, ord, at, expires_at, deleted)`` -> ``artifact_id, expires`` (milliseconds), once for each artifact whose time is over by the watermark of
    ``at`` less ``late`` and that has not been deleted or prolonged. An artifact is forgotten as it expires."""
    shaped = artifacts.withWatermark("at", late).select("artifact_id", F.col("ord").cast("long").alias("ord"), "at", F.unix_millis("expires_at").alias("expires"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    kind = artifacts.schema["artifact_id"].dataType.simpleString()
    return shaped.groupBy("artifact_id").transformWithState(Retention(), f"artifact_id {kind}, expires long", "Append", "EventTime")
