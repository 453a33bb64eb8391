"""Structured Streaming: event-time windows, the feedback stream, training triggers and resumable urls."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import feedback as B
from quillmill.session import scratch_path


def event_stream(spark: SparkSession, path: str, schema=None, lateness: str = "1 hour") -> DataFrame:
    """A file stream of events with a watermark; ts without zone is read as UTC, as watermarks need an instant."""
    schema = schema or spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a path may be one file or a folder
    return spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def run_available(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Everything available now, written batch by batch to the shared folder; `complete` keeps the last state."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        # the batch number in the path makes a repeated batch overwrite itself
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*stream.columns)


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per tumbling or sliding window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total_cents")).select(F.col("w.start").alias("start"), "event_type", "n", "total_cents")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions that end after a gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def feedback(events: DataFrame) -> DataFrame:
    """Feedback rows with their labels, row by row."""
    return B.labelled(B.outcomes(events))


def triggers(events: DataFrame, least: int = 32, every: int = 8, full: int | None = None) -> DataFrame:
    """(user_id, n_rows, n_triggers) so far: per user, training starts once `least` rows are there and `every` are new.

    With `full`, the length of the buffer decides instead: training starts whenever it holds `least` rows or more and a
    multiple of `every`, so on each row once the buffer is full. State per user: rows seen, rows since the last start, starts.
    """

    def step(key, batches, state):
        seen, new, fired = state.get if state.exists else (0, 0, 0)
        for b in batches:
            for _ in range(len(b)):
                seen, new = seen + 1, new + 1
                held = seen if full is None else min(seen, full)
                if held >= least and (new >= every if full is None else held % every == 0):
                    fired, new = fired + 1, 0
        state.update((seen, new, fired))
        yield pd.DataFrame({"user_id": [key[0]], "n_rows": [seen], "n_triggers": [fired]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n_rows long, n_triggers long", "seen long, new long, fired long", "update", "NoTimeout")


def first_urls(entries: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Each url once: repeats within the watermark are dropped, so that a resumed download changes nothing."""
    return entries.withWatermark("download_date", lateness).dropDuplicatesWithinWatermark(["url"])


def read_through(stream: DataFrame, lookup: Callable[[DataFrame], DataFrame], write_back: Callable[[DataFrame], None], base: str) -> None:
    """Per micro-batch: look claims up in the store as it is now, then write new records back for the next batch."""

    def one(batch: DataFrame, n: int) -> None:
        write_back(lookup(batch).filter("record_id is null"))

    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()


def online_learning(stream: DataFrame, learner, order: str, base: str, keep: int = 10_000) -> None:
    """Per micro-batch: append feedback rows (features and true labels) to a table, and let the learner take its steps on
    the last `keep` rows of it, which is all that comes to the driver. The learner is saved after each batch."""
    columns = ["features", "true_confidence", "true_routing", "true_error"]

    def one(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/feedback/batch={n}")
        spark = batch.sparkSession
        new = spark.read.parquet(f"{base}/feedback/batch={n}").count()
        tail = spark.read.parquet(f"{base}/feedback").filter("features is not null").orderBy(F.desc(order)).limit(keep).select(order, *columns).toPandas()
        if learner.learn(tail.sort_values(order), new):
            learner.save(spark, f"{base}/learner")

    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
