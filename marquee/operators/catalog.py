"""Catalog search, tag and genre counts, items as served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents
from ..functions.scalars import distinct_labels, url_extension
from ..schema import CANONICAL_GENRES
from .bounds import checked


def genres_overlap(labels: list[str]) -> Column:
    """Items with one of the labels, in the same case; items without genres are out."""
    return F.coalesce(F.arrays_overlap("genres", F.array(*map(F.lit, distinct_labels(labels)))), F.lit(False))


def search(items: DataFrame, q: str | None = None, genres: list[str] | None = None, tag: str | None = None) -> DataFrame:
    """Adds ``relevance`` (0 exact title, 1 prefix, 2 other). ``%`` and ``_`` in q are wildcards, as typed."""
    q = (q or "").strip()
    if q:
        title = F.col("title")
        exact, prefix = F.lower(title) == q.lower(), title.ilike(f"{q}%")
        items = items.where(title.ilike(f"%{q}%")).withColumn("relevance", F.when(exact, 0).when(prefix, 1).otherwise(2))
    else:
        items = items.withColumn("relevance", F.lit(0))
    if genres and distinct_labels(genres):
        items = items.where(genres_overlap(genres))
    if tag and tag.strip():
        items = items.where(F.exists("tags", lambda t: F.lower(t).like(f"%{tag.strip().lower()}%")))
    return items


def page(found: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    checked(limit=limit, offset=offset)
    return found.orderBy("relevance", "title", "item_id").offset(offset).limit(limit)


def tag_counts(items: DataFrame, limit: int = 30, min_count: int = 25) -> DataFrame:
    """Lower-cased tags by count; an item's case variants count each."""
    checked(count_limit=limit)
    tags = items.select(F.explode(F.transform("tags", F.lower)).alias("tag"))
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return counts.orderBy(F.desc("n"), "tag").limit(limit)


def with_document_tags(items: DataFrame, column: str = "metadata") -> DataFrame:
    """Items with ``tags`` from the array of that name in their metadata, as ``tag_counts`` reads them; nulls are no tags."""
    return items.withColumn("tags", F.array_compact(documents.texts(documents.as_document(items, column), "tags")))


def genre_counts(items: DataFrame, limit: int = 50, min_count: int = 25) -> DataFrame:
    """Canonical genres with enough items, in canonical order."""
    checked(count_limit=limit)
    order = items.sparkSession.createDataFrame(list(enumerate(CANONICAL_GENRES)), "place int, genre string")
    counts = items.select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") >= min_count)
    return counts.join(F.broadcast(order), "genre").orderBy("place").limit(limit).select("genre", "n", "place")


def served(items: DataFrame, posters: DataFrame | None = None) -> DataFrame:
    """Items as shown: a local poster's address before the image's, empty lists for missing ones."""
    url = F.nullif(F.trim("image_url"), F.lit(""))
    if posters is not None:
        items = items.join(posters.select("item_id", "file"), "item_id", "left")
        url = F.coalesce(F.concat(F.lit("/posters/"), "file"), url)
    return items.select(
        "item_id", "title", "start_year", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
        url.alias("poster"), url_extension(F.col("image_url")).alias("extension"),
    )


def without_embedding(items: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The work queue of items that have no (non-null) vector."""
    return items.join(embeddings.where("vector is not null").select("item_id"), "item_id", "left_anti").select("item_id")


def without_metadata(items: DataFrame) -> DataFrame:
    return items.where("description is null or image_url is null").select("item_id")


def needing(items: DataFrame, key: Column, force: bool = False, fields: tuple[str, ...] = ("description", "image_url")) -> DataFrame:
    """The work queue of items that a source knows (``key`` holds) and that lack a field; with ``force`` all it knows."""
    lacks = F.lit(force)
    for field in fields:
        lacks = lacks | F.col(field).isNull()
    return items.where(key & lacks)


def remaining(items: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(source, n): how many items each source still has to fill, in one pass."""
    n = items.agg(*(F.count_if(key & (F.col("description").isNull() | F.col("image_url").isNull())).alias(name) for name, key in keys.items()))
    return n.unpivot([], list(keys), "source", "n")


def with_documents(items: DataFrame, column: str = "metadata") -> DataFrame:
    """Items with their metadata as documents and the year that is shown: of several keys, the first that spells one."""
    out = items.withColumn(column, documents.as_document(items, column))
    return out.withColumn("year", documents.year(F.col(column)))


def with_poster_url(items: DataFrame) -> DataFrame:
    return items.where(F.trim("image_url") != "").select("item_id", "image_url")


def patched(items: DataFrame, patches: DataFrame, overwrite_genres: bool) -> DataFrame:
    """Items after patches (item_id, description, image_url, genres): text that is not empty overwrites, genres only if
    asked to or where there are none."""
    p = patches.select("item_id", *(F.col(c).alias(f"new_{c}") for c in ("description", "image_url", "genres")))
    given = lambda c: F.nullif(F.col(f"new_{c}"), F.lit(""))
    has = F.coalesce(F.size("new_genres"), F.lit(0)) > 0
    bare = F.coalesce(F.size("genres"), F.lit(0)) == 0
    out = items.join(p, "item_id", "left").withColumns({
        "description": F.coalesce(given("description"), "description"),
        "image_url": F.coalesce(given("image_url"), "image_url"),
        "genres": F.when(has & (F.lit(overwrite_genres) | bare), F.col("new_genres")).otherwise(F.col("genres")),
    })
    return out.drop("new_description", "new_image_url", "new_genres")
