"""Structured Streaming twins of the folds: files in, state in checkpoints. A fold of a head and then of a tail is the fold of
both: the state store holds what was folded, and the same aggregate runs over a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A directory of files as a stream. A file counts once, whole: a writer moves it in when it is complete, so no half-written
    line is ever read."""
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.format(fmt).load(path)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process what is there and stop; the next call goes on from the checkpoint."""
    q = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def upsert_batches(df: DataFrame, table_dir: str, checkpoint: str, key: list[str], order: str) -> None:
    """The last row per key kept in a directory. Each batch is merged with the version before it into one of its own, named by
    the batch's number and complete when its success mark is there: a reader never sees half a version, and a batch that runs
    twice, after a failure, gives the same table."""

    def merge(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, table_dir) if v < no]
        rows = batch if not before else batch.unionByName(spark.read.parquet(f"{table_dir}/v{before[-1]}"))
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, *[c for c in rows.columns if c != order])).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{table_dir}/v{no}")

    df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Numbers of the complete versions in a directory of any file system Spark can reach."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path_of(table_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(path_of(root, f"{n}/_SUCCESS")))


def current(spark: SparkSession, table_dir: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{table_dir}/v{versions(spark, table_dir)[-1]}")


def fold_counts(events: DataFrame) -> DataFrame:
    """Counts of a reading's operations, batch or stream alike."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))


def windowed(events: DataFrame, at: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and peaks by window of event time; rows later than the watermark are left out."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "peak")


def session_windows(events: DataFrame, at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a user by a gap in event time."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def running_state(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A fold that hangs on order: per user the last type and how often it changed."""
    last, changes, n = state.get if state.exists else (None, 0, 0)
    for f in frames:
        for kind in f.sort_values(["ts", "event_id"])["event_type"]:
            changes += last is not None and kind != last
            last, n = kind, n + 1
    state.update((last, int(changes), int(n)))
    yield pd.DataFrame({"user_id": [key[0]], "last": [last], "changes": [int(changes)], "n": [int(n)]})


def ordered_fold(events: DataFrame) -> DataFrame:
    """(user_id, last, changes, n) after every batch, by state kept per user."""
    return events.groupBy("user_id").applyInPandasWithState(running_state, "user_id bigint, last string, changes bigint, n bigint", "last string, changes bigint, n bigint", "update", "NoTimeout")


def peaks(samples: DataFrame, at: str, value: str, bucket: float) -> DataFrame:
    """(bucket, lo, hi) of samples (at in seconds): the outline of a sound, to be bucketed again at will."""
    return samples.groupBy(F.floor(F.col(at) / bucket).alias("bucket")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
