"""Structured Streaming forms: ingestion, running taint, sliding quarantine, and a tailing reader."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from palimpsest.sources.store import Store

#: Seqs that one group looks through for a gap.
BLOCK = 65_536


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A table of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windows(events: DataFrame, at: str, late: str = "10 minutes", size: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; what is later than the watermark is left out."""
    w = events.withWatermark(at, late).groupBy(F.window(at, size), by)
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def first_seen(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Retried writes once: duplicates within the watermark are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sliding_count(events: DataFrame, key: str, at_ms: str, window_ms: int, most: int) -> DataFrame:
    """(key, at, recent, held): writes of a key in the window that ends with each write.

    The state of a key holds the times inside the window only.
    """

    def f(key_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        out = []
        for pdf in batches:
            for t in sorted(pdf[at_ms].tolist()):
                times = [x for x in times if x > t - window_ms] + [t]
                out.append((str(key_[0]), t, len(times), len(times) > most))
        state.update((times,))
        yield pd.DataFrame(out, columns=["key", "at", "recent", "held"])

    schema = "key string, at long, recent long, held boolean"
    return events.groupBy(key).applyInPandasWithState(f, schema, "times array<long>", "append", "NoTimeout")


def running_least(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least) after each batch: the least trusted tier of a session so far."""

    def f(key_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        least = min([int(pdf[value].min()) for pdf in batches] + ([state.get[0]] if state.exists else []))
        state.update((least,))
        yield pd.DataFrame([(str(key_[0]), least)], columns=["key", "least"])

    return events.groupBy(key).applyInPandasWithState(f, "key string, least long", "least long", "update", "NoTimeout")


def tail(log: DataFrame, target: str, checkpoint: str):
    """Copy a log to ``target`` batch by batch. A batch is written under its own number, so one
    that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def readable(log: DataFrame) -> DataFrame:
    """The events up to the horizon: no delete is applied before the write that it deletes.

    Horizons are written first: knowing their size, Spark need not deal the log by namespace.
    """
    return log.join(Store(log.sparkSession).save(horizon(log)), "ns").where(F.col("seq") <= F.col("horizon")).drop("horizon")


def horizon(log: DataFrame) -> DataFrame:
    """The largest seq up to which nothing is missing: a reader may apply events up to it."""
    # It is the smallest seq that nothing follows. Blocks also see the seq that begins the next block.
    block = F.floor(F.col("seq") / BLOCK)
    seen = F.when(F.col("seq") % BLOCK == 0, F.array(block, block - 1)).otherwise(F.array(block))
    w = Window.partitionBy("ns", "block").orderBy("seq")
    steps = log.where("seq IS NOT NULL").select("ns", "seq", F.explode(seen).alias("block")).withColumn("next", F.lead("seq").over(w))
    ends = steps.where((F.col("block") == block) & (F.col("next").isNull() | (F.col("next") > F.col("seq") + 1)))
    return ends.groupBy("ns").agg(F.min("seq").alias("horizon"))
