"""Streams with typed state: equal to their batch folds, across a restart from the checkpoint."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import lifecycle as L
from provenant.streaming import stateful as S


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """A stream of files, a file a batch; each ``run`` is a query of its own on the same checkpoint and output."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, folder, schema
        (folder / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self, make, mode):
        stream = make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in")))
        out, folder = [], str(self.folder / "checkpoint")
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return out


def test_triage_goes_on_after_a_restart(rocks, tmp_path):
    rng = random.Random(1)
    commands = [*L.TRIAGE, "nonsense"]
    start = next(iter(next(iter(L.TRIAGE.values()))))
    rows = [(f"f{rng.randrange(5) if i % 3 else 0}", i, rng.choice(commands)) for i in range(300)]
    feed = Feed(rocks, tmp_path, "key string, ord long, command string")
    feed.add(rows[:100])
    feed.add(rows[100:150])
    events = feed.run(lambda s: S.triage(s, start), "append")
    assert len(events) == 150
    feed.add(rows[150:])
    events += feed.run(lambda s: S.triage(s, start), "append")
    assert sorted(e["ord"] for e in events) == list(range(300))
    last = {e["key"]: (e["state"], e["n_applied"], e["n_rejected"]) for e in sorted(events, key=lambda e: e["ord"])}
    batch = L.fold_commands(rocks.createDataFrame(rows, feed.schema), "key", ["ord"], "command", start).collect()
    assert last == {r["key"]: (r["state"], r["n_applied"], r["n_rejected"]) for r in batch}


def _time(seconds):
    """Seconds after the first second: what lies at the first watermark would be late."""
    return F.timestamp_seconds(F.col(seconds) + 1)


def test_journal_abandons_what_is_silent(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "stage string, unit_key string, kind string, ord long, s long")
    make = lambda s: S.journal(s.withColumn("at", _time("s")), "0 seconds", 60_000)
    feed.add([("scan", "a", "begin", 1, 0), ("scan", "b", "begin", 1, 0), ("scan", "b", "complete", 2, 10), ("scan", "c", "begin", 1, 50)])
    feed.run(make, "update")
    feed.add([("scan", "z", "begin", 1, 70), ("scan", "b", "begin", 3, 70)])
    feed.add([("scan", "z", "complete", 2, 75)])
    seen = feed.run(make, "update")
    state = {r["unit_key"]: (r["status"], r["attempt_count"]) for r in seen}
    assert state["a"] == ("failed_retryable", 1) and state["b"] == ("completed", 1) and state["z"] == ("completed", 1) and "c" not in state
    feed.add([("scan", "a", "begin", 2, 80), ("scan", "a", "complete", 3, 90)])
    assert {r["unit_key"]: (r["status"], r["attempt_count"]) for r in feed.run(make, "update")}["a"] == ("completed", 2)


def test_retention(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "artifact_id string, ord long, s long, e long, deleted boolean")
    make = lambda s: S.retention(s.withColumn("at", _time("s")).withColumn("expires_at", _time("e")), "0 seconds")
    feed.add([("short", 1, 0, 30, None), ("gone", 1, 0, 30, False), ("longer", 1, 0, 30, False), ("never", 1, 0, None, False), ("far", 1, 0, 9000, False)])
    assert feed.run(make, "append") == []
    feed.add([("gone", 2, 5, 30, True), ("longer", 2, 5, 80, False)])
    feed.add([("tick", 1, 40, 9000, False)])
    first = feed.run(make, "append")
    assert [(r["artifact_id"], r["expires"]) for r in first] == [("short", 31_000)]
    feed.add([("tick", 2, 100, 9000, False)])
    feed.add([("tick", 3, 101, 9000, False)])
    assert [(r["artifact_id"], r["expires"]) for r in feed.run(make, "append")] == [("longer", 81_000)]
