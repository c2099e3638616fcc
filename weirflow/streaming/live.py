"""Streams: stateless verbs append, groupings are kept up to date, windows may close by watermark.

A function from table to table made of filters and projections runs on a stream as it is (``run_append``). Sinks write
Parquet under a checkpoint, so a restarted query goes on where it stopped and each row is written once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.stored import scratch_path


def shared_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "stream")


def escaped(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 4) -> DataFrame:
    """The files of a Parquet table as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(escaped(path[:-1]) + "[t]")


def run_append(stream: DataFrame, verbs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run verbs over all that is there and return the table that the stream has written."""
    spark, where = stream.sparkSession, shared_folder(stream.sparkSession)
    out = verbs(stream)
    query = out.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/rows")


def run_latest(stream: DataFrame, verbs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a grouping, kept in state by key; each batch writes the whole result anew and the last one is returned."""
    spark, where = stream.sparkSession, shared_folder(stream.sparkSession)
    out = verbs(stream)
    batches: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/batch-{batch}")
        batches.append(batch)

    query = out.writeStream.outputMode("complete").option("checkpointLocation", f"{where}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(f"{where}/batch-{batches[-1]}")


def closed_windows(stream: DataFrame, time: str, width: str, key: str, late: str = "1 hour") -> DataFrame:
    """(start, key, count) of windows that closed ``late`` behind the latest time; later rows are left out and state is bounded."""

    def verbs(df: DataFrame) -> DataFrame:
        timed = df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
        counted = timed.groupBy(F.window("_time", width), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("count"))
        return counted.select(F.col("window.start").alias("start"), "key", "count")

    return run_append(stream, verbs)


def tally(stream: DataFrame, column: str) -> DataFrame:
    return run_latest(stream, lambda df: df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count")))


def windowed_counts(stream: DataFrame, time: str, width: str, key: str) -> DataFrame:
    """(start, key, count) of tumbling windows; all windows stay open, so late rows count and the result is that of a batch."""

    def verbs(df: DataFrame) -> DataFrame:
        timed = df.withColumn("_time", F.col(time).cast("timestamp"))
        counted = timed.groupBy(F.window("_time", width), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("count"))
        return counted.select(F.col("window.start").alias("start"), "key", "count")

    return run_latest(stream, verbs)


def on_match(stream: DataFrame, column: str, pattern: str, action: Callable[[DataFrame], None]) -> None:
    """Call ``action`` with the rows of each batch that match, where there are any; at least once for each row."""
    where = shared_folder(stream.sparkSession)

    def handle(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            action(rows)

    hits = stream.filter(F.col(column).rlike(pattern))
    hits.writeStream.foreachBatch(handle).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()


def retain_last(stream: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """(key, value, order): the last n rows of each key by a long ``order``; the state of a key is n rows."""
    import pandas as pd

    kind, what = (stream.schema[c].dataType.simpleString() for c in (key, value))

    def keep(name: tuple, batches, state):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in batches:
            held = sorted([*held, *zip(rows[order].tolist(), rows[value].tolist(), strict=True)], key=lambda r: r[0])[-n:]
        state.update(([r[0] for r in held], [r[1] for r in held]))
        yield pd.DataFrame({"key": [name[0]], "orders": [[r[0] for r in held]], "values": [[r[1] for r in held]]})

    def verbs(df: DataFrame) -> DataFrame:
        rows = df.select(key, value, F.col(order).cast("bigint").alias(order)).groupBy(key)
        return rows.applyInPandasWithState(keep, f"key {kind}, orders array<bigint>, values array<{what}>", f"orders array<bigint>, values array<{what}>", "update", "NoTimeout")

    spark, where = stream.sparkSession, shared_folder(stream.sparkSession)
    out = verbs(stream)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/rows/batch={batch}")

    out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(f"{where}/rows")
    latest = states.groupBy("key").agg(F.max_by(F.struct("orders", "values"), "batch").alias("s"))
    pairs = latest.select("key", F.explode(F.arrays_zip("s.orders", "s.values")).alias("p"))
    return pairs.select("key", F.col("p.values").alias("value"), F.col("p.orders").alias("order"))
