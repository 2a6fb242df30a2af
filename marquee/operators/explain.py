"""Why an item is recommended, in words, from a user's library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import listing, truncate
from ..schema import MIN_INTERACTIONS

# Wording of explanations: fixed values.
NO_TITLE = "this movie"
TASTE = "Matches your taste for {}."
VIBE = "Similar vibe to {} ({})."
PAIRED = "Pairs well with {} from your library."
BESIDE = "Fits alongside {} in your library."
FITS = "{} fits your {} picks — especially if you liked {}."
EMPTY = "Add more films to your library so we can explain why {} might suit your taste."
REASON_LENGTH, TEXT_LENGTH, LIBRARY_GAP = 90, 140, 50


def _filled(wording: str, *values):
    """A wording with columns in its gaps; null if one of them is."""
    parts = wording.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))))


def related(pairs: DataFrame, library: DataFrame, items: DataFrame, most: int = 3) -> DataFrame:
    """(user_id, item_id, place, title, genres): library entries nearest to the item, by shared genres, then year gap.

    pairs: (user_id, item_id); library: (user_id, item_id, title, genres, start_year, ts, interaction_id).
    """
    target = pairs.join(items.select("item_id", F.col("genres").alias("tg"), F.col("start_year").alias("ty")), "item_id")
    own = library.select("user_id", "title", "genres", F.col("start_year").alias("ey"), "ts", "interaction_id")
    rows = target.join(own, "user_id")
    empty = F.array().cast("array<string>")
    overlap = F.size(F.array_intersect(F.coalesce("genres", empty), F.coalesce("tg", empty)))
    gap = F.when(F.col("ty").isNotNull(), F.abs(F.col("ty") - F.coalesce("ey", "ty"))).otherwise(LIBRARY_GAP)
    w = Window.partitionBy("user_id", "item_id").orderBy(F.desc(overlap), gap, F.desc("ts"), F.desc("interaction_id"))
    rows = rows.withColumn("place", F.row_number().over(w).cast("bigint"))
    return rows.where(F.col("place") <= most).select("user_id", "item_id", "place", "title", "genres")


def shared_genres(pairs: DataFrame, library: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id, shared): the item's genres that the library has, the most frequent first."""
    counts = library.select("user_id", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"))
    genres = pairs.join(items.select("item_id", F.explode(F.array_distinct("genres")).alias("genre")), "item_id")
    found = genres.join(counts, ["user_id", "genre"]).groupBy("user_id", "item_id")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "genre")))
    return found.agg(F.transform(ordered, lambda s: s["genre"]).alias("shared"))


def explained(pairs: DataFrame, library: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id, title, explanation, reasons, shared, related) for pairs of users and items."""
    near = related(pairs, library, items)
    top = near.groupBy("user_id", "item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda s: s["title"]).alias("related"),
        F.min(F.when(F.col("place") == 1, F.struct("title", "genres"))).alias("anchor"),
    )
    rows = (
        pairs.join(items.select("item_id", "title", "genres"), "item_id", "left")
        .join(shared_genres(pairs, library, items), ["user_id", "item_id"], "left")
        .join(top, ["user_id", "item_id"], "left")
    )
    empty = F.array().cast("array<string>")
    title, anchor = F.coalesce("title", F.lit(NO_TITLE)), F.col("anchor.title")
    shared = F.coalesce("shared", empty)
    lead = F.element_at(shared, 1)
    common = F.array_sort(F.array_intersect(F.coalesce("anchor.genres", empty), F.coalesce("genres", empty)))
    taste = F.when(F.size(shared) > 0, _filled(TASTE, lead))
    beside = (
        F.when(F.size(common) > 0, _filled(VIBE, anchor, listing(F.slice(common, 1, 2))))
        .when(F.size(shared) > 0, _filled(PAIRED, anchor))
        .otherwise(_filled(BESIDE, anchor))
    )
    reasons = F.transform(F.array_compact(F.array(taste, beside)), lambda r: truncate(r, REASON_LENGTH))
    no_library = anchor.isNull()
    said = F.when(F.size(shared) > 0, _filled(FITS, title, lead, anchor)).otherwise(F.element_at(reasons, 1))
    return rows.select(
        "user_id", "item_id", title.alias("title"),
        F.when(no_library, _filled(EMPTY, title)).otherwise(truncate(said, TEXT_LENGTH)).alias("explanation"),
        F.when(no_library, empty).otherwise(reasons).alias("reasons"),
        F.when(no_library, empty).otherwise(shared).alias("shared"),
        F.coalesce("related", empty).alias("related"),
    )


def feature_explanation(candidates: DataFrame, features: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Retrieval score, features and rank score of candidates; without a ranker the retrieval score is the rank score."""
    rows = features.join(candidates.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    if ranks is None:
        return rows.withColumn("rank_score", F.col("retrieval_score"))
    return rows.join(ranks.select("user_id", "item_id", F.col("score").alias("rank_score")), ["user_id", "item_id"], "left")


def recommendation_explanations(
    pairs: DataFrame, history: DataFrame, candidates: DataFrame, items: DataFrame, ranking: DataFrame, units: DataFrame, ranker=None
) -> DataFrame:
    """Why each pair (user_id, item_id) is, or would be, recommended: (user_id, item_id, title, variant, history_length,
    retrieval_score, rank_score, features, importance).

    history: (user_id, pos, item_id); candidates: each user's pool (user_id, item_id, score). Users with too short a history
    get popularity, without scores. With a ranker (see ``rank.fit``), pairs in the pool have its seven features and score,
    others only its importances; without one the retrieval score stands for both, and is the only feature.
    """
    from . import rank

    lengths = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("history_length"))
    pool = candidates.select("user_id", "item_id", F.col("score").alias("retrieval_score"))
    rows = pairs.select("user_id", "item_id").join(lengths, "user_id", "left").join(pool, ["user_id", "item_id"], "left")
    rows = rows.join(items.select("item_id", "title"), "item_id", "left").withColumn("history_length", F.coalesce("history_length", F.lit(0)))
    warm = F.col("history_length") >= MIN_INTERACTIONS
    rows = rows.withColumn("variant", F.when(warm, "generative").otherwise("popularity")).withColumn("retrieval_score", F.when(warm, F.col("retrieval_score")))
    none = F.create_map().cast("map<string,double>")
    columns = ["user_id", "item_id", "title", "variant", "history_length", "retrieval_score", "rank_score", "features", "importance"]
    if ranker is None:
        one = lambda value: F.when(warm, F.create_map(F.lit("retrieval_score"), value)).otherwise(none)
        rows = rows.withColumns({"rank_score": F.col("retrieval_score"), "features": one(F.coalesce("retrieval_score", F.lit(0.0))), "importance": one(F.lit(1.0))})
        return rows.select(*columns)
    asked = rows.where(F.col("retrieval_score").isNotNull()).select("user_id", "item_id", F.col("retrieval_score").alias("score"))
    found = rank.scored(ranker.model, rank.features(asked, history, items, ranking, units))
    found = found.select("user_id", "item_id", F.col("p").alias("rank_score"), F.create_map(*(x for f in rank.FEATURES for x in (F.lit(f), F.col(f).cast("double")))).alias("features"))
    shares = F.create_map(*(x for f, v in rank.importance(ranker.model).items() for x in (F.lit(f), F.lit(v))))
    rows = rows.join(found, ["user_id", "item_id"], "left")
    return rows.withColumns({"features": F.coalesce("features", none), "importance": F.when(warm, shares).otherwise(none)}).select(*columns)
