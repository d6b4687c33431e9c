"""A fold of a head and then a tail equals the fold of all."""

from pyspark.sql import functions as F

from quarrystone.streaming import folds


def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_checkpointed_fold_is_the_fold_of_all(spark, small, tmp_path):
    e = events(spark, small)
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        e.filter(part).coalesce(1).write.mode("append").parquet(src)
        folds.upsert_batches(folds.stream_files(spark, src, folds.EVENTS), out, cp, ["user_id"], "event_id")
    got = sorted((r.user_id, r.event_id) for r in folds.current(spark, out).collect())
    want = sorted((r.user_id, r.m) for r in e.groupBy("user_id").agg(F.max("event_id").alias("m")).collect())
    assert got == want


def test_appends_run_once(spark, small, tmp_path):
    e = events(spark, small)
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    e.coalesce(2).write.parquet(src)
    for _ in range(2):
        folds.run_available(folds.stream_files(spark, src, folds.EVENTS).select("event_id"), out, cp)
    assert spark.read.parquet(out).count() == e.count()


def test_batch_and_stream_windows_agree(spark, small, tmp_path):
    e = events(spark, small)
    src = str(tmp_path / "in")
    e.orderBy("ts").coalesce(1).write.parquet(src)
    q = folds.windowed(folds.stream_files(spark, src, folds.EVENTS), "ts", "6 hours").writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    want = {(r.start, r.event_type): r.n for r in folds.windowed(e, "ts", "6 hours").collect()}
    assert got == want and want


def test_ordered_state(spark, small, tmp_path):
    e = events(spark, small)
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    q = folds.ordered_fold(folds.stream_files(spark, src, folds.EVENTS)).writeStream.format("memory").queryName("s").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.user_id: r.n for r in spark.table("s").collect()} == {r.user_id: r["count"] for r in e.groupBy("user_id").count().collect()}
