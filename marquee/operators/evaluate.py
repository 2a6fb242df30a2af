"""Offline evaluation: baselines, ranking metrics, percentiles."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import running
from .recommend import mean_vectors, popular_for_users, ranked, similar_for_users


#: Percentiles of latencies.
SHARES = (0.5, 0.95, 0.99)


def exploded(samples: DataFrame) -> DataFrame:
    return samples.select("user_id", F.posexplode("history").alias("pos", "item_id"))


def popularity_baseline(samples: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    seen = exploded(samples).select("user_id", "item_id").distinct()
    return popular_for_users(samples, ranking, seen, k).select("user_id", "item_id", "rank")


def history_repeat_baseline(samples: DataFrame, k: int) -> DataFrame:
    """The history again, latest first, each item once."""
    rows = exploded(samples).groupBy("user_id", "item_id").agg(F.max("pos").alias("at"))
    return ranked(rows, k, F.desc("at")).select("user_id", "item_id", "rank")


def average_vector_baseline(samples: DataFrame, units: DataFrame, k: int) -> DataFrame:
    history = exploded(samples)
    seen = history.select("user_id", "item_id").distinct()
    return similar_for_users(mean_vectors(history, units), units, seen, k).select("user_id", "item_id", "rank")


def metrics(rankings: DataFrame, samples: DataFrame, catalog_size: int, ks: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(model, metric, value) of rankings (model, user_id, item_id, rank): recall@k, ndcg@10, mrr over whole lists, and
    the share of the catalog recommended, in one pass over the rankings. A model without any list for a sample misses it."""
    n = samples.select("user_id", F.col("target").alias("item_id"))
    hits = rankings.join(n.withColumn("hit", F.lit(True)), ["user_id", "item_id"], "left")
    hit = F.coalesce("hit", F.lit(False))
    counts = {f"recall@{k}": F.count_if(hit & (F.col("rank") <= k)) for k in ks}
    if 10 in ks:
        counts["ndcg@10"] = F.sum(F.when(hit & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    counts["mrr"] = F.sum(F.when(hit, 1 / F.col("rank")).otherwise(0.0))
    wide = hits.groupBy("model").agg(*(c.alias(name) for name, c in counts.items()), F.countDistinct("item_id").alias("items"))
    wide = wide.join(F.broadcast(n.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))))  # one row
    columns = {name: F.col(f"`{name}`") / F.col("n") for name in counts}
    columns["coverage"] = F.col("items") / F.lit(max(catalog_size, 1))
    wide = wide.select("model", *(c.alias(name) for name, c in columns.items()))
    names = list(columns)
    return wide.select("model", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{x}`").cast("double") for x in names)))).alias("metric", "value"))


def weighted_mean(parts: DataFrame, value: str, weight: str) -> DataFrame:
    """Mean of batch or shard figures, weighted by their sizes."""
    return parts.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def index_percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = SHARES, key: str | None = None) -> DataFrame:
    """sorted[min(int(n * p), n - 1)] for each share p, as columns p50, p95, ..., by rank, not by collecting values.

    Without a key, values are counted and their counts summed by ranges; with one, each key has a window of its own.
    """
    names = [f"p{round(100 * p)}" for p in shares]
    at = lambda n, p: F.least(F.floor(n * p), n - 1)
    if key is None:
        counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
        placed, total = running(counts, [F.col(value)], _before=F.col("_n"))
        n = F.lit(total["_before"]).cast("bigint")
        holds = lambda p: (F.col("_before") <= at(n, p)) & (at(n, p) < F.col("_before") + F.col("_n"))
        return placed.agg(*(F.max(F.when(holds(p), F.col(value))).alias(name) for p, name in zip(shares, names, strict=True)))
    w = Window.partitionBy(key)
    placed = rows.select(key, value, (F.row_number().over(w.orderBy(value)) - 1).alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    picked = [F.max(F.when(F.col("at") == at(F.col("n"), p), F.col(value))).alias(name) for p, name in zip(shares, names, strict=True)]
    return placed.groupBy(key).agg(*picked)


def rolling_percentiles(rows: DataFrame, key: str, value: str, order: tuple[str, ...], most: int = 1000) -> DataFrame:
    """(key, n, p50, p95, p99), to two decimals, over each key's latest ``most`` values by ``order``; nulls are no values.

    A key with very many rows is first thinned in parts, by a hash, to the latest of each, so no task sorts all of it.
    """
    latest_first = [F.desc(c) for c in order]
    rows = rows.where(F.col(value).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    for by in ((key, "_part"), (key,)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*latest_first))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    found = index_percentiles(rows, value, key=key)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(found, key).select(key, "n", *(F.round(c, 2).alias(c) for c in found.columns if c != key))


def latest(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The latest rows by the given columns."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(most)


@dataclass
class Timing:
    """Milliseconds of the steps of a recommendation: ``with timing.step("history"): ...``"""

    steps: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.steps[name] = self.steps.get(name, 0.0) + 1000 * (time.perf_counter() - began)

    def as_dict(self) -> dict[str, float]:
        """By step, with the total, to two decimals."""
        return {f"{k}_ms": round(v, 2) for k, v in (self.steps | {"total": sum(self.steps.values())}).items()}


def beats(values: DataFrame, model: str, baseline: str, metric: str = "recall@10") -> DataFrame:
    pick = lambda m: F.max(F.when((F.col("model") == m) & (F.col("metric") == metric), F.col("value")))
    return values.agg((pick(model) > pick(baseline)).alias("beats"))
