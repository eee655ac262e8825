"""Incremental variants on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def windowed_counts(events: DataFrame, at: str, late: str, width: str, slide: str | None, keys: list[str]) -> DataFrame:
    """Counts by key and tumbling or sliding window; rows later than ``late`` are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def first_seen(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def running_streaks(events: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """``key, streak``: after each micro-batch, how many of a key's newest events in a row have ``flag`` (rows of a batch in time order).

    State is one number a key, so it stays small however long the stream runs.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(at)
        streak = state.get[0] if state.exists else 0
        for f in rows[flag].fillna(False):
            streak = streak + 1 if f else 0
        state.update((streak,))
        yield pd.DataFrame({key: [k[0]], "streak": [streak]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, streak long", "streak long", "update", GroupStateTimeout.NoTimeout)


def drain(events: DataFrame, into, checkpoint: str) -> None:
    """Work off what is there and stop: ``into(batch, id)`` gets each micro-batch once."""
    events.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def settled(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """What an updating stream has to say once its input is worked off: each key's row of the last micro-batch that changed it.

    Every micro-batch is appended to a table at ``path`` under its number; a batch that is run again after a failure replaces
    its rows, so none counts twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    columns = stream.columns
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    rows = spark.read.schema(schema).parquet(path)
    values = [c for c in columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values, F.col("_batch")), "_batch").alias("_r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in columns])
