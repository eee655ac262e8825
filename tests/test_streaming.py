from __future__ import annotations

from pyspark.sql import functions as F

from millrace.streaming import live


def _stream(spark, tmp_path):
    rows = [("a", f"2026-01-01 00:{m:02d}:00", m % 3 == 2) for m in range(9)] + [("b", "2026-01-01 00:30:00", True)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, s string, bad boolean").select("k", F.to_timestamp("s").alias("at"), "bad").coalesce(1).write.parquet(src)
    return spark.readStream.schema("k string, at timestamp, bad boolean").parquet(src)


def _run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_and_first_seen(spark, tmp_path):
    s = _stream(spark, tmp_path)
    got = _run(live.windowed_counts(s, "at", "1 hour", "5 minutes", None, ["k"]), "complete", "w")
    assert {(r.k, r.n) for r in got.collect()} == {("a", 5), ("a", 4), ("b", 1)}
    assert {r.k for r in _run(live.first_seen(s, "at", "1 hour", ["k"]), "append", "f").collect()} == {"a", "b"}


def test_state_and_drain(spark, tmp_path):
    s = _stream(spark, tmp_path)
    got = _run(live.running_streaks(s, "k", "at", "bad"), "update", "r")
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 1)}
    seen = []
    live.drain(s, lambda b, i: seen.append(b.count()), str(tmp_path / "c"))
    assert sum(seen) == 10
