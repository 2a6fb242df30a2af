"""A user's library, watchlist, history and status, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents
from ..schema import INTERACTION_TYPES
from .bounds import checked, rating_fits
from .sequences import deduped, last, rated_enough


def details(rows: DataFrame, items: DataFrame) -> DataFrame:
    return rows.join(items.select("item_id", "title", "genres", "start_year"), "item_id")


def history_page(interactions: DataFrame, items: DataFrame, limit: int = 20) -> DataFrame:
    """Each user's latest ``limit`` interactions with titles, latest first."""
    checked(history_limit=limit)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("interaction_id"))
    rows = details(interactions, items).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return rows.where(F.col("rank") <= limit)


def latest_per_item(interactions: DataFrame, kind: str, source: str) -> DataFrame:
    """One row for each user and item of that type and source: the latest."""
    w = Window.partitionBy("user_id", "item_id").orderBy(F.desc("ts"), F.desc("interaction_id"))
    rows = interactions.where((F.col("type") == kind) & (F.col("source") == source))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def library(interactions: DataFrame, items: DataFrame) -> DataFrame:
    return details(latest_per_item(interactions, "view", "library"), items)


def watchlist(interactions: DataFrame, items: DataFrame) -> DataFrame:
    return details(latest_per_item(interactions, "click", "watchlist"), items)


def of_source(interactions: DataFrame, source: str, column: str = "context") -> DataFrame:
    """Interactions whose context, JSON in any form, is an object with this source."""
    return interactions.where(documents.contains(documents.as_document(interactions, column), {"source": source}))


def seen(interactions: DataFrame) -> DataFrame:
    return interactions.select("user_id", "item_id").distinct()


def excluded(interactions: DataFrame) -> DataFrame:
    """Items that library recommendations leave out: in the library, or dismissed."""
    return interactions.where(F.col("source").isin("library", "dismissed")).select("user_id", "item_id").distinct()


def library_history(interactions: DataFrame, most: int = 50) -> DataFrame:
    """(user_id, pos, item_id, n): library rows in order, consecutive repeats dropped, the last ``most``."""
    rows = deduped(interactions.where("source = 'library'"))
    w = Window.partitionBy("user_id")
    rows = rows.select(
        "user_id", F.row_number().over(w.orderBy("ts", "interaction_id")).cast("bigint").alias("pos"), "item_id",
        F.count(F.lit(1)).over(w).alias("n"),
    )
    return last(rows, most)


def user_history(interactions: DataFrame, most: int = 50) -> DataFrame:
    """(user_id, pos, item_id, n) of all users' rating-filtered histories."""
    rows = deduped(rated_enough(interactions))
    w = Window.partitionBy("user_id")
    rows = rows.select(
        "user_id", F.row_number().over(w.orderBy("ts", "interaction_id")).cast("bigint").alias("pos"), "item_id",
        F.count(F.lit(1)).over(w).alias("n"),
    )
    return last(rows, most)


def status(interactions: DataFrame) -> DataFrame:
    """Flags and the latest library rating for each user and item."""
    has = lambda kind, source: F.bool_or((F.col("type") == kind) & F.coalesce(F.col("source") == source, F.lit(False)))
    rated = F.when((F.col("type") == "rating") & (F.col("source") == "library") & F.col("rating").isNotNull(), F.struct("ts", "interaction_id", "rating"))
    return interactions.groupBy("user_id", "item_id").agg(
        has("view", "library").alias("in_library"), has("click", "watchlist").alias("in_watchlist"),
        has("click", "dismissed").alias("dismissed"), F.max(rated)["rating"].alias("rating"),
    )


def user_stats(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("type") == "rating").alias("ratings")
    )


def genre_profile(library_rows: DataFrame) -> DataFrame:
    """(user_id, genre, n): how often each lower-cased genre stands in a user's library."""
    genres = library_rows.select("user_id", F.explode(F.transform("genres", F.lower)).alias("genre"))
    return genres.groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"))


def validated(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``reason``: null for rows that may be appended, else why not."""
    known = items.select(F.col("item_id"), F.lit(True).alias("known"))
    reason = F.when(~F.coalesce(F.col("type").isin(*INTERACTION_TYPES), F.lit(False)), "type").when(F.col("known").isNull(), "item")
    return rows.join(known, "item_id", "left").withColumn("reason", reason).drop("known")


def validated_ratings(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Library ratings with ``reason``: null for those that may be appended, else why not (type, item or rating)."""
    checked_rows = validated(rows, items)
    return checked_rows.withColumn("reason", F.coalesce("reason", F.when(~rating_fits(F.col("rating")), "rating")))


def removed(interactions: DataFrame, gone: DataFrame) -> DataFrame:
    """Interactions without those named by (user_id, item_id, source) and, where given, type."""
    g = gone.select("user_id", "item_id", "source", F.col("type").alias("gone_type"))
    i = interactions
    match = (i["user_id"] == g["user_id"]) & (i["item_id"] == g["item_id"]) & (i["source"] == g["source"])
    return i.join(g, match & (g["gone_type"].isNull() | (g["gone_type"] == i["type"])), "left_anti")


def without_user(interactions: DataFrame, users: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interactions and users after accounts (user_id) are deleted."""
    kept = interactions.join(gone, "user_id", "left_anti")
    return kept, users.join(gone, users["id"] == gone["user_id"], "left_anti")
