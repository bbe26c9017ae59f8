import datetime as dt

from pyspark.sql import functions as F

from tessera.streaming import snapshots


def symbol(spark, rows):
    df = spark.createDataFrame(rows, "id string, file string, logic string, dropped boolean, seq long")
    return df.select("id", F.struct("file").alias("source"), F.struct("logic").alias("fingerprint"), "dropped", "seq")


def test_batches_move_the_state(spark, tmp_path):
    state, changes = str(tmp_path / "state"), str(tmp_path / "changes")
    symbol(spark, [("a", "f", "1", False, 0), ("b", "f", "1", False, 0)]).drop("seq").write.parquet(f"{state}/0")
    inbox = str(tmp_path / "in")
    for i, rows in enumerate([[("a", "f", "2", False, 1), ("c", "f", "1", False, 2)], [("a", "g", "2", False, 3), ("b", "f", "1", True, 4), ("c", "f", "1", False, 5)]]):
        symbol(spark, rows).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
        q = snapshots.follow(spark, stream, state, changes, str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    got = {(r.batch, r.id, r.status) for r in spark.read.parquet(changes).collect()}
    assert got == {(0, "a", "changed"), (0, "c", "added"), (1, "a", "moved"), (1, "b", "dropped-toggled")}


def test_windows_sessions_and_streaks(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, at(m), "click", 1.0, m in (2, 3, 4, 8)) for m in range(12)] + [(2, at(60), "view", 2.0, False)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double, failed boolean").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string, value double, failed boolean").parquet(str(tmp_path / "e"))
    out = {}
    for name, df, mode in (("w", snapshots.windowed_counts(stream), "complete"), ("s", snapshots.sessions(stream), "complete"), ("f", snapshots.failure_streaks(stream), "append")):
        q = df.writeStream.format("memory").queryName(f"q_{name}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        out[name] = spark.table(f"q_{name}").collect()
    assert sorted((r.start.minute, r.n) for r in out["w"]) == [(0, 1), (0, 10), (10, 2)]
    assert sorted(r.n for r in out["s"]) == [1, 12]
    assert [(r.user_id, r.streak, r.ts.minute) for r in out["f"]] == [(1, 3, 4)]
