"""Interactions as streams: validation, popularity, consecutive duplicates, recent state per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.library import validated

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive, as interaction rows."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.select(
        F.col("event_id").alias("interaction_id"), "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"),
    )


def split_by_validity(stream: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows with a reason): a stream-static join."""
    rows = validated(stream, items)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends to a Parquet table; the checkpoint makes each file count once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def popularity(stream: DataFrame) -> DataFrame:
    """Running counts by item."""
    return stream.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def windowed_popularity(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by item and time window; rows later than ``late`` are dropped, so old windows leave the state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "item_id").agg(F.count(F.lit(1)).alias("n"))


class RecentHistory(StatefulProcessor):
    """The last items of each user without consecutive repeats, forgotten ``ttl_ms`` after the last write."""

    def __init__(self, most: int = 50, ttl_ms: int = 300_000):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getValueState("items", "items array<bigint>", ttlDurationMs=self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = list(self.items.get()[0]) if self.items.exists() else []
        new = pd.concat(list(rows)).sort_values(["ts", "interaction_id"])
        for item in new["item_id"].tolist():
            if not items or items[-1] != item:
                items.append(item)
        items = items[-self.most :]
        self.items.update((items,))
        yield pd.DataFrame({"user_id": [key[0]], "history": ["|".join(map(str, items))]})

    def close(self) -> None:
        pass


def recent_history(stream: DataFrame, most: int = 50, ttl_ms: int = 300_000) -> DataFrame:
    """(user_id, history) after each batch, for the users in it. Needs the RocksDB state store."""
    return stream.groupBy("user_id").transformWithStateInPandas(
        RecentHistory(most, ttl_ms), "user_id bigint, history string", "Update", "ProcessingTime" if ttl_ms else "None"
    )
