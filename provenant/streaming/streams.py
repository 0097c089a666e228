"""Streaming editions of the keyed state operators; each agrees with its batch fold on the same events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provenant.operators.lifecycle import ENDINGS

#: The life of a finding in one scope: status, times reopened, time of the last accepted event, whether the scope has ended.
Life = tuple[str | None, int, int | None, bool]
BORN: Life = (None, 0, None, False)


def advance(life: Life, outcome: str, at: int) -> Life:
    """One event of ``lifecycle.occurrence_fold``, for state that is kept between batches."""
    status, reopened, last, over = life
    if over:
        return life
    if outcome in ENDINGS:
        return (outcome if status == "open" else status, reopened, last, True)
    if last is not None and at < last:
        return life
    if outcome == "observed":
        return ("open", reopened + (status == "fixed"), at, False)
    return (outcome if outcome in ("fixed", "duplicate") else status, reopened, at, False)


def enqueue_once(events: DataFrame, key: list[str], at: str, horizon: str) -> DataFrame:
    """The first request of each key. A repeat within the horizon is dropped; the watermark only bounds the state."""
    return events.withWatermark(at, horizon).dropDuplicatesWithinWatermark(key)


def counts_by_window(events: DataFrame, at: str, width: str, late: str, key: str) -> DataFrame:
    """Events per key and tumbling window, final once the watermark has passed (beyond the reference's batch counts)."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))


def on_time_only(events: DataFrame, key: str, at: str) -> DataFrame:
    """``events(key, at, run)`` -> runs that are not older than a run of their key that arrived before, across batches."""
    kind = events.schema[key].dataType.simpleString()

    def keep(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        out = []
        for pdf in frames:
            for r in pdf.sort_values("arrival").itertuples():
                if newest is None or r.at >= newest:
                    newest = r.at
                    out.append((k[0], r.run, r.at))
        state.update((int(newest),))
        yield pd.DataFrame(out, columns=["key", "run", "at"])

    shaped = events.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col("run").cast("long").alias("run"), F.col("arrival").cast("long").alias("arrival"))
    return shaped.groupBy("key").applyInPandasWithState(keep, f"key {kind}, run long, at long", "newest long", "append", GroupStateTimeout.NoTimeout)


def occurrences(events: DataFrame) -> DataFrame:
    """``events(key, ord, outcome, at)`` -> after each batch, for every key in it, ``key, status, reopened, last_at``."""
    kind = events.schema["key"].dataType.simpleString()

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        life = state.get if state.exists else BORN
        for r in pd.concat(list(frames)).sort_values("ord").itertuples():
            life = advance(life, r.outcome, int(r.at))
        state.update(life)
        yield pd.DataFrame({"key": [k[0]], "status": [life[0]], "reopened": [life[1]], "last_at": [life[2]]})

    return events.groupBy("key").applyInPandasWithState(
        fold, f"key {kind}, status string, reopened long, last_at long", "status string, reopened long, last_at long, over boolean", "update", GroupStateTimeout.NoTimeout
    )


def leases(requests: DataFrame, seconds: int) -> DataFrame:
    """``requests(job, worker, at)`` -> ``job, worker, at, outcome``: claimed, renewed or refused; a lease that has run out may be taken.

    The state of a job is its owner and expiry; keyed processing is the lock.
    """
    kind = requests.schema["job"].dataType.simpleString()

    def claim(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, until = state.get if state.exists else ("", -(1 << 62))
        out = []
        for r in pd.concat(list(frames)).sort_values(["at", "worker"]).itertuples():
            outcome = "renewed" if owner == r.worker and r.at < until else "claimed" if r.at >= until else "refused"
            if outcome != "refused":
                owner, until = r.worker, int(r.at) + seconds
            out.append((k[0], r.worker, r.at, outcome))
        state.update((owner, int(until)))
        yield pd.DataFrame(out, columns=["job", "worker", "at", "outcome"])

    return requests.groupBy("job").applyInPandasWithState(
        claim, f"job {kind}, worker string, at long, outcome string", "owner string, until long", "append", GroupStateTimeout.NoTimeout
    )
