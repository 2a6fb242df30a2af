"""Popularity, genre weighting and the recommendation policy, for all users in one plan.

Popularity needs no user x catalog product: a user's k best unseen items lie among the first k + (items seen) of the
ranking, so each user is joined to that prefix by its length, and the anti join with what was seen leaves at least k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ab_variant, lowered
from ..schema import GENRE_POOL, GENRE_WEIGHT, MIN_INTERACTIONS, POPULARITY_LIMIT
from ..tables import stored
from .bounds import checked
from .vectors import summed, top_k


def popularity(interactions: DataFrame) -> DataFrame:
    """(item_id, n, rank, total) by count, ties by item. One row per item goes through the final sort."""
    counts = interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return _placed(counts, F.desc("n"), F.col("item_id"))


def _placed(counts: DataFrame, *order: Column) -> DataFrame:
    return counts.select(
        "item_id", "n", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("total"),
    )


def popularity_of_sequences(seqs: DataFrame, embedded: DataFrame) -> DataFrame:
    """By count in sequences, repeats included; ties by the first place met (users in order, then position). Items that
    are not embedded are dropped after ranking."""
    counts = seqs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("user_id", "pos")).alias("first"))
    ranked = counts.select("item_id", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"))
    return _placed(ranked.join(embedded.select("item_id"), "item_id", "left_semi").select("item_id", "n", "place"), F.col("place"))


def popularity_top(interactions: DataFrame, embedded: DataFrame, limit: int = POPULARITY_LIMIT) -> DataFrame:
    """The first ``limit`` by count, of which those embedded are kept."""
    counts = interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(limit)
    return _placed(counts.join(embedded.select("item_id"), "item_id", "left_semi"), F.desc("n"), F.col("item_id"))


def popularity_or_catalog(interactions: DataFrame, items: DataFrame, limit: int = POPULARITY_LIMIT) -> DataFrame:
    """The most popular items; where there are no interactions at all, items in id order."""
    top = interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(limit)
    if interactions.isEmpty():
        top = items.orderBy("item_id").limit(limit).select("item_id", F.lit(0).cast("bigint").alias("n"))
    return _placed(top, F.desc("n"), F.col("item_id"))


def unseen_prefix(users: DataFrame, ranking: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """(user_id, item_id, rank, total, index): each user's first ``depth`` unseen items of the ranking, index from 0."""
    counts = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seen"))
    reach = users.select("user_id").distinct().join(counts, "user_id", "left")
    reach = reach.select("user_id", F.explode(F.sequence(F.lit(1), F.coalesce("n_seen", F.lit(0)).cast("int") + depth)).alias("rank"))
    rows = reach.join(ranking.select("item_id", "total", "rank"), "rank").join(seen, ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("rank")
    rows = rows.withColumn("index", F.row_number().over(w).cast("bigint") - 1)
    return rows.where(F.col("index") < depth).select("user_id", "item_id", "rank", "total", "index")


def popular_for_users(users: DataFrame, ranking: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, score, rank): score falls with the place in the full ranking."""
    rows = unseen_prefix(users, ranking, seen, k)
    return rows.select("user_id", "item_id", (F.col("total") - F.col("rank") + 1).cast("double").alias("score"), (F.col("index") + 1).alias("rank"))


def attach_titles(candidates: DataFrame, items: DataFrame) -> DataFrame:
    return candidates.join(items.select("item_id", "title"), "item_id", "left")


def wanted_genres(labels: list[str] | None) -> list[str]:
    return sorted({g.strip().lower() for g in labels or [] if g.strip()})


def matches_genres(genres: Column, labels: list[str] | None) -> Column:
    """Whether item genres, lower-cased, meet the labels; no labels match all."""
    wanted = wanted_genres(labels)
    return F.arrays_overlap(lowered(genres), F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def filtered_by_genres(candidates: DataFrame, items: DataFrame, labels: list[str] | None, k: int) -> DataFrame:
    """Candidates (user_id, item_id, score, rank) of matching genres, in their order, the first k."""
    rows = candidates.withColumnRenamed("rank", "prior").join(items.where(matches_genres(F.col("genres"), labels)).select("item_id"), "item_id")
    return ranked(rows, k, F.col("prior"))


def _overlap(rows: DataFrame, items: DataFrame, profile: DataFrame, key: list[str]) -> DataFrame:
    """(key, overlap): the summed profile counts of each candidate's distinct lower-cased genres."""
    genres = rows.select(*key).join(items.select("item_id", F.explode(F.array_distinct(lowered(F.col("genres")))).alias("genre")), "item_id")
    return genres.join(profile, ["user_id", "genre"]).groupBy(*key).agg(F.sum("n").alias("overlap"))


def genre_weighted(
    users: DataFrame, ranking: DataFrame, seen: DataFrame, items: DataFrame, k: int, profile: DataFrame | None = None,
    labels: list[str] | None = None, pool: int = GENRE_POOL,
) -> DataFrame:
    """Popularity weighted by genres: overlap * GENRE_WEIGHT + (ranking length - pool index), over the first ``pool``
    unseen. The index counts items that the filter drops. A user without a profile is weighted by the labels met."""
    rows = unseen_prefix(users, ranking, seen, pool)
    rows = rows.join(items.select("item_id", "genres"), "item_id", "left").where(matches_genres(F.col("genres"), labels))
    wanted = F.array(*map(F.lit, wanted_genres(labels))).cast("array<string>")
    by_label = F.size(F.array_intersect(lowered(F.col("genres")), wanted)).cast("bigint")
    if profile is None:
        overlap = by_label
    else:
        rows = rows.join(_overlap(rows, items, profile, ["user_id", "item_id"]), ["user_id", "item_id"], "left")
        rows = rows.join(profile.select("user_id", F.lit(True).alias("has")).distinct(), "user_id", "left")
        overlap = F.when(F.col("has"), F.coalesce("overlap", F.lit(0))).otherwise(by_label)
    score = (overlap * GENRE_WEIGHT + F.col("total") - F.col("index")).cast("double")
    rows = rows.select("user_id", "item_id", "index", score.alias("score"))
    return ranked(rows, k, F.desc("score"), F.col("index")).select("user_id", "item_id", "score", "rank")


def boosted(candidates: DataFrame, items: DataFrame, profile: DataFrame, k: int) -> DataFrame:
    """Candidates with the profile counts of their genres added to the score; ties keep the prior order.

    Candidates are read once: their genres are summed back into one row for each.
    """
    genres = items.select("item_id", F.explode(F.array_distinct(lowered(F.col("genres")))).alias("genre"))
    rows = candidates.withColumnRenamed("rank", "prior").join(genres, "item_id", "left").join(profile, ["user_id", "genre"], "left")
    rows = rows.groupBy("user_id", "item_id").agg(
        F.first("prior").alias("prior"), (F.first("score") + F.coalesce(F.sum("n"), F.lit(0))).alias("score")
    )
    return ranked(rows, k, F.desc("score"), F.col("prior")).select("user_id", "item_id", "score", "rank")


def mean_vectors(history: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, q): the summed vectors of each user's history, repeats included (the cosine needs no division).

    Histories are cut to their last items before, so a user's vectors are few.
    """
    rows = history.select("user_id", "item_id").join(units, "item_id")
    return rows.groupBy(F.col("user_id").alias("query_id")).agg(summed(F.collect_list("v")).alias("q"))


def similar_for_users(queries: DataFrame, units: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, score, rank) by cosine with each user's predicted vector, without what was seen."""
    found = top_k(queries, units, k, seen.select(F.col("user_id").alias("query_id"), "item_id"))
    return found.withColumnRenamed("query_id", "user_id")


def recommend(
    users: DataFrame, seqs: DataFrame, queries: DataFrame, units: DataFrame, ranking: DataFrame, seen: DataFrame,
    items: DataFrame, k: int, labels: list[str] | None = None, rerank=None,
) -> DataFrame:
    """The policy over all users: popularity below MIN_INTERACTIONS, else search, rerank and filter.

    ``queries`` (query_id, q) are predicted vectors of the warm users; ``rerank`` maps candidates to candidates.
    """
    checked(k=k)
    warm = seqs.where(F.col("n") >= MIN_INTERACTIONS).select("user_id").distinct()
    cold = users.select("user_id").distinct().join(warm, "user_id", "left_anti")
    wanted = wanted_genres(labels)
    found = similar_for_users(queries, units, seen, max(k, 8 * k if wanted else k))
    if rerank is not None:
        found = rerank(found, max(k, 4 * k if wanted else k))
    found = filtered_by_genres(found, items, labels, k) if wanted else found.where(F.col("rank") <= k)
    popular = genre_weighted(cold, ranking, seen, items, k, labels=labels) if wanted else popular_for_users(cold, ranking, seen, k)
    columns = ["user_id", "item_id", "score", "rank"]
    return found.select(*columns, F.lit("model").alias("strategy")).unionByName(
        popular.select(*columns, F.lit("popularity").alias("strategy"))
    )


def recommend_in_library(
    histories: DataFrame, queries: DataFrame, units: DataFrame, excluded: DataFrame, items: DataFrame, profile: DataFrame,
    k: int, labels: list[str] | None = None,
) -> DataFrame:
    """Library mode for users with a model's vector: without a filter, the k candidates are re-ordered by the library's
    genres; with one, more are fetched and filtered."""
    wanted = wanted_genres(labels)
    found = similar_for_users(queries, units, excluded, 8 * k if wanted else k)
    found = found.join(histories.select("user_id").distinct(), "user_id", "left_semi")
    return filtered_by_genres(found, items, labels, k) if wanted else boosted(found, items, profile, k)


def library_popularity(
    users: DataFrame, ranking: DataFrame, excluded: DataFrame, items: DataFrame, profile: DataFrame, k: int, labels: list[str] | None = None
) -> DataFrame:
    """Popular items in library mode, without a model: with a genre filter weighted by its labels alone, else by each
    user's library; users with neither get plain popularity. (user_id, item_id, score, rank)"""
    if wanted_genres(labels):
        return genre_weighted(users, ranking, excluded, items, k, labels=labels)
    users, profiled = users.select("user_id").distinct(), profile.select("user_id").distinct()
    own = genre_weighted(users.join(profiled, "user_id", "left_semi"), ranking, excluded, items, k, profile=profile)
    return own.unionByName(popular_for_users(users.join(profiled, "user_id", "left_anti"), ranking, excluded, k))


def cascade(users: DataFrame, sources: list[tuple[str, DataFrame | None]], k: int) -> DataFrame:
    """(user_id, item_id, score, rank, source): sources of candidates (user_id, item_id, score, rank) in order, each only
    for users who still lack items, only as many as they lack, and none that they have. A source that is None is skipped.

    Each step is written, so a later source reads counts and items of earlier ones and computes none of them again.
    """
    if k < 1:
        raise ValueError("k must be positive")
    users = users.select("user_id").distinct()
    columns, steps, lack = ["user_id", "item_id", "score", "rank", "source"], [], users.withColumn("have", F.lit(0).cast("bigint"))
    for name, candidates in sources:
        if candidates is None:
            continue
        rows = candidates.select("user_id", "item_id", "score", F.col("rank").alias("prior")).join(lack, "user_id")
        for step in steps:
            rows = rows.join(step.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("user_id").orderBy("prior")).cast("bigint")
        rows = rows.withColumn("rank", F.col("have") + place).where(F.col("rank") <= k)
        steps.append(stored(rows.withColumn("source", F.lit(name)).select(*columns), "cascade"))
        counts = steps[-1].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        have = F.col("have") + F.coalesce("n", F.lit(0))
        lack = stored(lack.join(counts, "user_id", "left").select("user_id", have.alias("have")).where(F.col("have") < k), "lack")
    if not steps:
        return users.sparkSession.createDataFrame([], "user_id bigint, item_id bigint, score double, rank bigint, source string")
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out


def serving_sources(
    embeddings: DataFrame, model: DataFrame | None, library: DataFrame | None, popular: DataFrame, version: str = "model", fallback: bool = True
) -> tuple[str, list[tuple[str, DataFrame | None]]]:
    """What can be served, as sources of ``cascade`` with the version to report: without vectors or without a model only
    popularity, which is an error where fallback is not wanted and vectors are there."""
    bare = embeddings.where(F.col("vector").isNotNull()).isEmpty()
    if not bare and model is None and not fallback:
        raise FileNotFoundError("there is no model, and fallback is off")
    usable = None if bare else model
    return "popularity-fallback" if usable is None else version, [("model", usable), ("library", library), ("popularity", popular)]


def variants(users: DataFrame, fraction: float = 0.5) -> DataFrame:
    return users.select("user_id", ab_variant(F.col("user_id"), fraction).alias("variant")).distinct()


def served(
    users: DataFrame, model: DataFrame | None, popular: DataFrame, fraction: float = 0.5, force: str | None = None, fallback: bool = True
) -> DataFrame:
    """The recommendations that each user's variant serves, with the variant that served them.

    ``force`` overrides the assignment. Users of the generative variant for whom the model has nothing, or all of them
    without a model, get popularity; without ``fallback``, a missing model is an error.
    """
    checked(variant=force)
    if model is None and not fallback:
        raise RuntimeError("the model is not available")
    assigned = variants(users, fraction) if force is None else users.select("user_id", F.lit(force).alias("variant")).distinct()
    columns = ["user_id", "item_id", "score", "rank"]
    if model is None:
        return popular.join(assigned, "user_id", "left_semi").select(*columns, F.lit("popularity").alias("variant"))
    generative = assigned.where("variant = 'generative'").join(model.select("user_id").distinct(), "user_id", "left_semi")
    by_model = model.join(generative.select("user_id"), "user_id", "left_semi").select(*columns, F.lit("generative").alias("variant"))
    rest = assigned.join(generative, "user_id", "left_anti")
    by_count = popular.join(rest.select("user_id"), "user_id", "left_semi").select(*columns, F.lit("popularity").alias("variant"))
    return by_model.unionByName(by_count)


def overlap_audit(recommended: DataFrame, seen: DataFrame) -> DataFrame:
    """Recommended items that were seen: empty for lists that leave out what was seen."""
    return recommended.select("user_id", "item_id").join(seen, ["user_id", "item_id"], "left_semi")


def audit_summary(users: DataFrame, recommended: DataFrame, seen: DataFrame) -> DataFrame:
    """(users, passed, failed, empty) of the audit."""
    n = recommended.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    bad = overlap_audit(recommended, seen).groupBy("user_id").agg(F.count(F.lit(1)).alias("bad"))
    rows = users.select("user_id").distinct().join(n, "user_id", "left").join(bad, "user_id", "left")
    none, wrong = F.col("n").isNull(), F.coalesce("bad", F.lit(0)) > 0
    return rows.agg(
        F.count(F.lit(1)).alias("users"), F.count_if(~none & ~wrong).alias("passed"), F.count_if(wrong).alias("failed"), F.count_if(none).alias("empty")
    )
