"""Latency percentiles over each route's latest samples, kept while requests stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.evaluate import SHARES
from .interactions import EVENTS

NAMES = [f"p{round(100 * p)}" for p in SHARES]


def request_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive, as requests (route, ts, request_id, ms)."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.select(F.col("event_type").alias("route"), "ts", F.col("event_id").alias("request_id"), F.col("value").alias("ms"))


class LatestSamples(StatefulProcessor):
    """A ring of each route's latest samples, at most ``most``; rows of a batch enter in the order of time and id."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getValueState("samples", "samples array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"ts": [], "request_id": [], "ms": []})
        for part in rows:  # of one batch only the latest can stay
            held = pd.concat([held, part[["ts", "request_id", "ms"]]]) if len(held) else part[["ts", "request_id", "ms"]]
            held = held.sort_values(["ts", "request_id"]).tail(self.most)
        before = list(self.samples.get()[0]) if self.samples.exists() else []
        ring = (before + held["ms"].dropna().tolist())[-self.most :]
        self.samples.update((ring,))
        ordered, n = sorted(ring), len(ring)
        found = {name: [ordered[min(int(n * p), n - 1)] if n else None] for p, name in zip(SHARES, NAMES, strict=True)}
        yield pd.DataFrame({"route": [key[0]], "n": [n], **found})

    def close(self) -> None:
        pass


def rolling_latency(requests: DataFrame, most: int = 1000) -> DataFrame:
    """(route, n, p50, p95, p99) after each batch, for the routes in it, to two decimals; equal to
    ``evaluate.rolling_percentiles`` over all rows so far where batches come in order of time. Needs the RocksDB state
    store; the state of a route is at most ``most`` numbers, and a restart goes on from the checkpoint."""
    schema = ", ".join(["route string", "n bigint", *(f"{name} double" for name in NAMES)])
    found = requests.groupBy("route").transformWithStateInPandas(LatestSamples(most), schema, "Update", "None")
    return found.select("route", "n", *(F.round(name, 2).alias(name) for name in NAMES))
