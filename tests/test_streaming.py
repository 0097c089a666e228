"""Streaming editions agree with their batch folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import lifecycle as L
from provenant.streaming import streams as S


def _source(spark, tmp_path, rows, schema, files=2):
    df = spark.createDataFrame(rows, schema)
    for i in range(files):
        df.where(F.pmod(F.xxhash64(*df.columns), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(stream, name, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_occurrences(spark, tmp_path):
    rows = [("a", 1, "observed", 1), ("a", 2, "fixed", 2), ("a", 3, "observed", 3), ("b", 1, "observed", 2), ("b", 2, "fixed", 1)]
    df, stream = _source(spark, tmp_path, rows, "key string, ord long, outcome string, at long", files=1)
    got = _run(S.occurrences(stream), "occ", tmp_path, "update")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, L.occurrence_fold(df).collect()))


def test_leases_and_once(spark, tmp_path):
    _, stream = _source(spark, tmp_path, [("j", "w1", 0), ("j", "w2", 5), ("j", "w1", 8), ("j", "w2", 30)], "job string, worker string, at long", files=1)
    got = _run(S.leases(stream, 10), "leases", tmp_path, "append")
    assert [r["outcome"] for r in got.orderBy("at").collect()] == ["claimed", "refused", "renewed", "claimed"]
    once = S.enqueue_once(stream.withColumn("t", F.timestamp_seconds("at")), ["job"], "t", "1 hour")
    assert _run(once, "once", tmp_path, "append").count() == 1


def test_on_time(spark, tmp_path):
    _, stream = _source(spark, tmp_path, [("k", 5, 1, 1), ("k", 3, 2, 2), ("k", 7, 3, 3)], "key string, at long, run long, arrival long", files=1)
    got = _run(S.on_time_only(stream, "key", "at"), "ontime", tmp_path, "append")
    assert sorted(r["run"] for r in got.collect()) == [1, 3]
