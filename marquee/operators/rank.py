"""Ranker: seven features in one projection, training rows, boosted trees."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dot, genre_overlap_ratio, normalize_year, quantized
from ..schema import CANDIDATE_POOL, RECENT_WINDOW
from ..sources.files import write_json
from ..tables import stored
from .numbering import running
from .recommend import ranked
from .vectors import summed, top_k

FEATURES = [
    "retrieval_score", "popularity_rank_norm", "history_length", "genre_overlap", "in_recent_history",
    "avg_history_similarity", "item_year_norm",
]


def features(candidates: DataFrame, history: DataFrame, items: DataFrame, ranking: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates (user_id, item_id, score) with FEATURES. History: (user_id, pos, item_id).

    The mean similarity to the history is the dot with the history's mean vector, so history and candidates are never
    multiplied out: one row of sums per user is joined to the user's candidates.
    """
    genres = history.join(items.select("item_id", F.explode("genres").alias("genre")), "item_id")
    genres = genres.groupBy("user_id").agg(F.collect_set("genre").alias("history_genres"))
    latest = F.max("pos").alias("latest")
    length = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("length"), latest)
    vectors = history.join(units, "item_id").groupBy("user_id").agg(F.collect_list("v").alias("vs"))
    mean = vectors.select("user_id", F.transform(summed(F.col("vs")), lambda x: x / F.size("vs")).alias("mean"))
    user = length.join(genres, "user_id", "left").join(mean, "user_id", "left")
    recent = (
        history.join(length, "user_id").where(F.col("pos") > F.col("latest") - RECENT_WINDOW)
        .select("user_id", "item_id", F.lit(1.0).alias("recent")).distinct()
    )
    item = items.select("item_id", "genres", "start_year").join(ranking.select("item_id", F.col("rank").alias("place"), "total"), "item_id", "left").join(units, "item_id", "left")
    rows = candidates.join(item, "item_id").join(user, "user_id", "left").join(recent, ["user_id", "item_id"], "left")
    return rows.select(
        *candidates.columns,
        F.col("score").alias("retrieval_score"),
        F.coalesce(1 - (F.col("place") - 1) / F.col("total"), F.lit(0.0)).alias("popularity_rank_norm"),
        F.coalesce(F.col("length"), F.lit(0)).cast("double").alias("history_length"),
        genre_overlap_ratio(F.col("genres"), F.col("history_genres")).alias("genre_overlap"),
        F.coalesce("recent", F.lit(0.0)).alias("in_recent_history"),
        quantized(F.coalesce(dot(F.col("v"), F.col("mean")), F.lit(0.0))).alias("avg_history_similarity"),
        normalize_year(F.col("start_year")).alias("item_year_norm"),
    )


def training_rows(samples: DataFrame, queries: DataFrame, units: DataFrame, items: DataFrame, ranking: DataFrame, pool: int = CANDIDATE_POOL) -> DataFrame:
    """Candidates of each sample (user_id, history, target) without its history, the target always among them, with
    features and label. Queries and what the search finds are read more than once, so they are written; so should samples be."""
    queries = stored(queries, "queries")
    history = samples.select("user_id", F.posexplode("history").alias("pos", "item_id"))
    exclude = history.select(F.col("user_id").alias("query_id"), "item_id").distinct()
    found = stored(top_k(queries, units, pool, exclude).select(F.col("query_id").alias("user_id"), "item_id", "score"), "found")
    target = samples.select("user_id", F.col("target").alias("item_id"))
    missing = target.join(found, ["user_id", "item_id"], "left_anti").join(units, "item_id")
    missing = missing.join(queries.withColumnRenamed("query_id", "user_id"), "user_id")
    missing = missing.select("user_id", "item_id", quantized(dot(F.col("q"), F.col("v"))).alias("score"))
    rows = features(found.unionByName(missing), history, items, ranking, units)
    label = target.withColumn("label", F.lit(1.0))
    return rows.join(label, ["user_id", "item_id"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


#: Boosting of the ranker: fixed values.
ROUNDS, STEP, SHARE, SEED = 200, 0.05, 0.8, 42
#: Boosting with held-out rows stops when a round lowers their loss by less than this share of it.
TOLERANCE = 0.005


def train(rows: DataFrame, rounds: int = ROUNDS, depth: int = 5, validation: str | None = None) -> PipelineModel:
    """Boosted trees over FEATURES; with a ``validation`` column (true for rows that are held out) boosting stops when
    their loss stops falling, and the rounds up to the best are kept."""
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=STEP, subsamplingRate=SHARE, featureSubsetStrategy="all", seed=SEED, labelCol="label", validationTol=TOLERANCE)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(rows)


def held_out(user_id: Column, share: int = 5, seed: int = SEED) -> Column:
    """Whether a user's rows validate the ranker: one in ``share``, by a hash, so no user is on both sides."""
    return F.conv(F.substring(F.md5(F.concat(user_id.cast("string"), F.lit(f"|rank{seed}"))), 1, 8), 16, 10).cast("bigint") % share == 0


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``p``, the model's probability of the label."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


@dataclass(frozen=True)
class Ranker:
    """A trained ranker as it is kept: the model and what it was trained with."""

    model: PipelineModel
    config: dict

    @property
    def trees(self) -> int:
        return self.model.stages[-1].getNumTrees

    def rerank(self, rows: DataFrame, k: int) -> DataFrame:
        return rerank(self.model, rows, k)


def fit(rows: DataFrame, pool: int = CANDIDATE_POOL, rounds: int = ROUNDS, depth: int = 5, validation: str | None = None, trained_at: str | None = None) -> Ranker:
    """Trains a ranker on rows (FEATURES, label) and records its parameters and, where rows are held out, their AUC."""
    model = train(rows, rounds, depth, validation)
    value = None
    if validation:
        value = auc(scored(model, rows.where(validation)), "p").first()["auc"]
    config = {
        "features": FEATURES, "rounds": rounds, "depth": depth, "step": STEP, "pool": pool, "rows": rows.count(), "auc": value, "trained_at": trained_at,
    }
    return Ranker(model, config)


def save(ranker: Ranker, path: str) -> None:
    """Writes the model, and last its configuration: an artefact without one is not whole."""
    ranker.model.write().overwrite().save(f"{path}/model")
    write_json(SparkSession.active(), ranker.config, f"{path}/config")


def load(spark: SparkSession, path: str, **expected) -> Ranker | None:
    """A saved ranker, or None where there is none. One of other features, or whose configuration differs from what is
    expected of it by name, is refused."""
    try:
        line = spark.read.text(f"{path}/config").first()
    except AnalysisException:
        return None
    config = json.loads(line[0])
    for name, want in ({"features": FEATURES} | expected).items():
        if config.get(name) != want:
            raise ValueError(f"the ranker was trained with {name} {config.get(name)}, not {want}")
    return Ranker(PipelineModel.load(f"{path}/model"), config)


def rerank(model: PipelineModel, rows: DataFrame, k: int) -> DataFrame:
    """The k best candidates by the model; ties keep the retrieval order."""
    best = ranked(scored(model, rows), k, F.desc("p"), F.desc("retrieval_score"), F.col("item_id"))
    return best.select("user_id", "item_id", F.col("p").alias("score"), "rank")


def importance(model: PipelineModel) -> dict[str, float]:
    """Gains by feature, summing to 1 (all 0 if no tree splits)."""
    gains = model.stages[-1].featureImportances.toArray()
    total = gains.sum()
    return {f: float(g / total) if total else 0.0 for f, g in zip(FEATURES, gains, strict=True)}


def auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores: ties count half."""
    bins = rows.groupBy(F.col(score).alias("at")).agg(F.sum(F.col(label)).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    placed, _ = running(bins, [F.col("at")], below=F.col("n"))
    parts = placed.select((F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), "p", "n")
    return parts.agg((F.sum("wins") / (F.sum("p") * F.sum("n"))).alias("auc"))
