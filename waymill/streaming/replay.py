"""Streams over files, run to their end: input in bounded micro-batches, output in the shared folder."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.session import Scratch
from waymill.streaming import keyed


def files(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def in_time_slices(df: DataFrame, ts: str, slices: int, scratch: Scratch, name: str = "slices") -> str:
    """Write a batch as files in order of time, and give the folder: what a source would have delivered.

    A file stream reads files by their time of change, so the range partitions' files get times in their order.
    """
    ordered = df.repartitionByRange(slices, ts).sortWithinPartitions(ts)
    scratch.write(ordered, name)
    path = f"{scratch.root}/{name}"
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    began = int((time.time() - 3600) * 1000)
    for i, part in enumerate(parts):
        fs.setTimes(part, began + 1000 * i, -1)
    return path


def run(stream: DataFrame, scratch: Scratch, name: str = "out", mode: str = "append", once: bool = False) -> DataFrame:
    """Run a stream over what is there, exactly once, and read its output back.

    once: in one micro-batch, for operators on processing time, which else would wait for their clock for ever.
    """
    path = f"{scratch.root}/{name}"
    trigger = {"once": True} if once else {"availableNow": True}
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{scratch.root}/{name}-log").trigger(**trigger).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, scratch: Scratch, write: Callable[[DataFrame, int], None], name: str = "each") -> None:
    """Run a stream with a function of (micro-batch, number)."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{scratch.root}/{name}-log").trigger(availableNow=True).start()
    query.awaitTermination()


def close_time(events: DataFrame, path: str) -> None:
    """Add a row without key or value ten years after the last event to what a source delivers: it drives the watermark
    over the end."""
    end = events.agg((F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    closing = end.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    closing.coalesce(1).write.mode("append").parquet(path)


def keyed_replay(spark: SparkSession, events: DataFrame, processor: keyed.Keyed, slices: int = 4) -> DataFrame:
    """Replay events (columns of keyed.EVENTS) as a stream through a keyed operator; timers fire up to the end of time."""
    scratch = Scratch(spark, "stream")
    path = in_time_slices(events, "ts", slices, scratch)
    if processor.time_mode == "EventTime":
        close_time(events, path)
    with keyed.stateful(spark):
        out = run(keyed.apply(files(spark, path, events.schema), processor), scratch, once=processor.time_mode == "ProcessingTime")
    return out.filter("key IS NOT NULL") if processor.time_mode == "EventTime" else out


def latest_values(spark: SparkSession, events: DataFrame, slices: int = 4) -> DataFrame:
    """Coalescing fan-out: only the newest event of a key in each micro-batch is delivered (batch, key, seq)."""
    scratch = Scratch(spark, "latest")
    path = in_time_slices(events, "ts", slices, scratch)

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("key").agg(F.max_by("seq", F.struct("ts", "seq")).alias("seq"))
        newest.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{scratch.root}/out/part={number}")

    run_batches(files(spark, path, events.schema), scratch, write)
    return spark.read.parquet(f"{scratch.root}/out").select("batch", "key", "seq")


def windowed_counts(spark: SparkSession, events: DataFrame, window: str, late: str, slices: int = 4) -> DataFrame:
    """Event-time windows with a watermark (start, value, n): windows are final once the watermark has passed them.

    A closing row after the last event drives the watermark over the end, so the last windows come out too.
    """
    scratch = Scratch(spark, "windows")
    path = in_time_slices(events, "ts", slices, scratch)
    close_time(events, path)
    stream = files(spark, path, events.schema)
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "value").agg(F.count(F.lit(1)).alias("n"))
    out = run(counts.select(F.col("window.start").alias("start"), "value", "n"), scratch)
    return out.filter("value IS NOT NULL")
