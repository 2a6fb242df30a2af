"""Upserts, update joins and deletes over immutable tables: each is one join and a rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` after INSERT ... ON CONFLICT (key) DO UPDATE SET columns: others keep what they had."""
    s = source.select(F.col(key), F.lit(True).alias("given"), *(F.col(c).alias(f"new_{c}") for c in columns))
    rows = target.join(s, key, "full")
    return rows.select(
        *(F.when(F.col("given"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns)
    )


def kept_ids(users: DataFrame) -> DataFrame:
    """(id, keep_id): the smallest id of each name, without regard to case; users without a name keep theirs."""
    w = Window.partitionBy(F.lower("username"))
    named = users.where("username is not null").select("id", F.min("id").over(w).alias("keep_id"))
    return named.unionByName(users.where("username is null").select("id", F.col("id").alias("keep_id")))


def moved_interactions(interactions: DataFrame, kept: DataFrame) -> DataFrame:
    moved = kept.where("id <> keep_id").select(F.col("id").alias("user_id"), "keep_id")
    rows = interactions.join(moved, "user_id", "left")
    return rows.withColumn("user_id", F.coalesce("keep_id", "user_id")).drop("keep_id")


def merged_users(users: DataFrame) -> DataFrame:
    """One user for each lower-cased name: the one with the smallest id."""
    named = users.where("username is not null")
    smallest = named.groupBy(F.lower("username").alias("name")).agg(F.min("id").alias("id"))
    gone = named.join(smallest.select("id"), "id", "left_anti").select("id")
    return users.join(gone, "id", "left_anti").withColumn("username", F.lower("username"))
