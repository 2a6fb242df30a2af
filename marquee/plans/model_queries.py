"""Vector, ranker, evaluation and predictor queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, norm, quantized
from ..operators import evaluate, predict, rank, recommend, sequences, training, vectors
from ..sources import vector_store
from ..tables import shared_dir, stored
from .model import Model, joined
from .registry import query

BASE = ("inter", "emb", "seqs", "seen", "unit", "query", "scored")


@query("SELECT item_id, floor(sqrt(list_dot_product(vector, vector)) * 1e6 + 0.5) / 1e6 AS norm FROM emb", "emb")
def embedding_norms(m: Model) -> DataFrame:
    return m.embeddings.select("item_id", quantized(norm(F.col("vector"))).alias("norm"))


TOP = """t AS (SELECT a.item_id AS query_id, b.item_id, floor(list_dot_product(a.v, b.v) * 1e6 + 0.5) / 1e6 AS score FROM unit a, unit b WHERE a.item_id % 10 = 0 AND a.item_id <> b.item_id)"""


@query(f"+ {TOP} SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM t QUALIFY rank <= 5", "emb", "unit")
def cosine_topk(m: Model) -> DataFrame:
    q = m.units.where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    return vectors.top_k(q, m.units, 5, q.select("query_id", F.col("query_id").alias("item_id")))


def _store(m: Model) -> vector_store.VectorStore:
    """A store of the whole catalog, written now and opened with its ids compared."""
    path = f"{shared_dir(m.spark).rstrip('/')}/marquee-store-{uuid.uuid4().hex}"
    vector_store.write_store(m.embeddings, path)
    return vector_store.open_store(m.spark, path, ids=m.embeddings.select("item_id"))


@query(f"+ {TOP} SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM t QUALIFY rank <= 5", "emb", "unit")
def cosine_topk_of_store(m: Model) -> DataFrame:
    """The same search over a vector store, by cells: its blocks are read, never computed again."""
    store = _store(m)
    q = store.vectors().where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"), F.lit(6).alias("want"))
    found = vectors.top_candidates(q, store, broadcast_bytes=0).where("item_id <> query_id")
    return recommend.ranked(found.withColumnRenamed("query_id", "user_id"), 5, F.desc("score"), F.col("item_id")).withColumnRenamed("user_id", "query_id")


@query("""+ r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row FROM emb)
SELECT i.item_id, coalesce(row, -1) AS row, floor(coalesce(list_dot_product(v, v), 0) * 1e6 + 0.5) / 1e6 AS square FROM items i LEFT JOIN r USING (item_id) LEFT JOIN unit USING (item_id)""", "items", "emb", "unit")
def catalog_rows(m: Model) -> DataFrame:
    """Each item's row in the store, -1 without a vector, and the square of what a lookup gives."""
    found = _store(m).lookup(m.items.select("item_id"))
    return found.select("item_id", "row", quantized(dot(F.col("v"), F.col("v"))).alias("square"))


@query("""+ f AS (SELECT * FROM unit ORDER BY item_id LIMIT 5), t AS (SELECT f.item_id AS own, u.item_id, row_number() OVER (
  PARTITION BY f.item_id ORDER BY floor(list_dot_product(f.v, u.v) * 1e6 + 0.5) / 1e6 DESC, u.item_id) AS rank FROM f, unit u)
SELECT count(*) AS checked, count(*) FILTER (own <> item_id) AS mismatches FROM t WHERE rank = 1""", "emb", "unit")
def index_self_check(m: Model) -> DataFrame:
    return vectors.self_check(m.units)


@query("""+ q AS (SELECT user_id, max(item_id) FILTER (pos = n) AS target FROM seqs GROUP BY user_id), t AS (SELECT s.* FROM scored s JOIN q ON q.user_id = s.user_id AND q.target <> s.item_id)
SELECT user_id AS query_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM t QUALIFY rank <= 8""", *BASE)
def hard_negatives(m: Model) -> DataFrame:
    target = m.samples.select(F.col("user_id").alias("query_id"), "target")
    return vectors.hard_negatives(m.queries.join(target, "query_id"), m.units, 8)


HARD = """tq AS (SELECT user_id, max(item_id) FILTER (pos = n) AS target FROM seqs GROUP BY user_id), ht AS (SELECT s.* FROM scored s JOIN tq ON tq.user_id = s.user_id AND tq.target <> s.item_id
), hard AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM ht QUALIFY rank <= 8
), bt AS (SELECT *, (row_number() OVER (ORDER BY md5(user_id || '|5'), user_id) - 1) // 16 AS batch FROM tq JOIN query USING (user_id)
), ex AS (SELECT batch, target AS item_id FROM bt UNION SELECT batch, item_id FROM hard JOIN bt USING (user_id)
), ord AS (SELECT item_id, row_number() OVER (ORDER BY md5(item_id || '|5'), item_id) AS at, count(*) OVER () AS n FROM unit
), walk AS (SELECT b.batch, o.item_id, (o.at - 1 - b.start + o.n) % o.n AS j FROM (SELECT DISTINCT batch, CAST('0x' || substr(md5(batch || '|5'), 1, 8) AS BIGINT) % (SELECT count(*) FROM unit) AS start FROM bt) b, ord o)"""


@query(f"""+ {HARD} SELECT batch, item_id, row_number() OVER (PARTITION BY batch ORDER BY j) AS rank FROM walk ANTI JOIN ex USING (batch, item_id) QUALIFY rank <= 32""", *BASE)
def shared_negatives(m: Model) -> DataFrame:
    """For each batch of 16 samples one draw of 32 items, without its positives and hard negatives."""
    target = m.samples.select(F.col("user_id").alias("query_id"), "target")
    samples = training.batch_numbers(m.queries.join(target, "query_id"), 16, 5, "query_id")
    return training.negatives(samples, m.units, 32, 8, seed=5)[0]


@query("""+ tq AS (SELECT user_id, max(item_id) FILTER (pos = n) AS target FROM seqs GROUP BY user_id), sr AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM scored
), bt AS (SELECT *, (row_number() OVER (ORDER BY md5(user_id || '|5'), user_id) - 1) // 16 AS batch FROM tq JOIN query USING (user_id))
SELECT batch, count(*) AS n, count(rank) / count(*) AS recall FROM bt LEFT JOIN sr ON sr.user_id = bt.user_id AND sr.item_id = bt.target AND rank <= 10 GROUP BY batch""", *BASE)
def batch_recall(m: Model) -> DataFrame:
    """How often the target is among the best ten of the whole catalog, by batch: histories are not left out."""
    target = m.samples.select(F.col("user_id").alias("query_id"), "target")
    samples = training.batch_numbers(m.queries.join(target, "query_id"), 16, 5, "query_id")
    return training.batch_recall(samples, m.units, 10, ("batch",))


@query("""+ s AS (SELECT a.item_id AS query_id, list_dot_product(a.v, b.v) / 0.07 AS pos, list(list_dot_product(a.v, c.v) / 0.07 ORDER BY c.item_id) AS negs
  FROM unit a JOIN unit b ON b.item_id = a.item_id + 1 JOIN unit c ON c.item_id BETWEEN a.item_id + 2 AND a.item_id + 6 GROUP BY ALL)
SELECT query_id, floor((ln(list_sum(list_transform(list_prepend(pos, negs), lambda x: exp(x)))) - pos) * 1e6 + 0.5) / 1e6 AS loss FROM s""", "emb", "unit")
def infonce(m: Model) -> DataFrame:
    u = m.units
    a = u.select(F.col("item_id").alias("query_id"), F.col("v").alias("p"))
    b = u.select((F.col("item_id") - 1).alias("query_id"), F.col("v").alias("pos"))
    c = u.select("item_id", "v", F.explode(F.array(*(F.lit(i) for i in range(2, 7)))).alias("step"))
    c = c.groupBy((F.col("item_id") - F.col("step")).alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_id", "v"))), lambda s: s["v"]).alias("negatives")
    )
    return vectors.infonce(a.join(b, "query_id").join(c, "query_id"))


SAMPLE = """smp AS (SELECT user_id, item_id, pos, n, max(item_id) FILTER (pos = n) OVER (PARTITION BY user_id) AS target FROM seqs
), hist AS (SELECT user_id, item_id, pos FROM smp WHERE pos < n AND pos >= n - 50
), hseen AS (SELECT DISTINCT user_id, item_id FROM hist), tgt AS (SELECT DISTINCT user_id, target AS item_id FROM smp)"""
REPEAT = "rep AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY max(pos) DESC) AS rank FROM hist GROUP BY user_id, item_id QUALIFY rank <= 50)"
POPBASE = """ppairs AS (SELECT u.user_id, p.item_id, p.rank AS prank FROM (SELECT DISTINCT user_id FROM hist) u, pop p
), pbase AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY prank) AS rank FROM ppairs ANTI JOIN hseen USING (user_id, item_id) QUALIFY rank <= 50)"""
AVGBASE = """hp AS (SELECT user_id, i, sum(v[i]) AS x FROM hist JOIN unit USING (item_id), range(1, 65) r(i) GROUP BY user_id, i
), hq AS (SELECT user_id, list(x / greatest(len, 1e-12) ORDER BY i) AS q FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS len FROM hp) GROUP BY user_id
), hs AS (SELECT user_id, item_id, floor(list_dot_product(q, v) * 1e6 + 0.5) / 1e6 AS score FROM hq, unit
), abase AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM hs ANTI JOIN hseen USING (user_id, item_id))"""
EVAL = ("inter", "emb", "seqs", "pop", "unit")


@query(f"+ {SAMPLE}, {REPEAT} SELECT * FROM rep", *EVAL)
def recs_history_repeat(m: Model) -> DataFrame:
    return evaluate.history_repeat_baseline(m.samples, 50)


@query(f"+ {SAMPLE}, {POPBASE} SELECT * FROM pbase", *EVAL)
def recs_popularity_baseline(m: Model) -> DataFrame:
    return evaluate.popularity_baseline(m.samples, m.ranking, 50)


@query(f"+ {SAMPLE}, {AVGBASE} SELECT user_id, item_id, rank FROM abase WHERE rank <= 50", *EVAL)
def recs_average_baseline(m: Model) -> DataFrame:
    return evaluate.average_vector_baseline(m.samples, m.units, 50)


METRICS = f"""{SAMPLE}, {REPEAT}, {POPBASE}, {AVGBASE}, rk AS (SELECT 'repeat' AS model, * FROM rep UNION ALL SELECT 'popularity', * FROM pbase
  UNION ALL SELECT 'average', user_id, item_id, rank FROM abase WHERE rank <= 50
), hit AS (SELECT model, rank FROM rk JOIN tgt USING (user_id, item_id)), n AS (SELECT count(*) AS n FROM tgt), ms AS (SELECT DISTINCT model FROM rk
), mt AS (SELECT model, 'recall@10' AS metric, count(*) FILTER (rank <= 10) / max(n) AS value FROM ms LEFT JOIN hit USING (model), n GROUP BY model
  UNION ALL SELECT model, 'recall@20', count(*) FILTER (rank <= 20) / max(n) FROM ms LEFT JOIN hit USING (model), n GROUP BY model
  UNION ALL SELECT model, 'recall@50', count(*) FILTER (rank <= 50) / max(n) FROM ms LEFT JOIN hit USING (model), n GROUP BY model
  UNION ALL SELECT model, 'ndcg@10', coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / max(n) FROM ms LEFT JOIN hit USING (model), n GROUP BY model
  UNION ALL SELECT model, 'mrr', coalesce(sum(1 / rank), 0) / max(n) FROM ms LEFT JOIN hit USING (model), n GROUP BY model
  UNION ALL SELECT model, 'coverage', count(DISTINCT item_id) / (SELECT count(*) FROM emb) FROM rk GROUP BY model)"""


def _metrics(m: Model) -> DataFrame:
    named = lambda df, name: df.select(F.lit(name).alias("model"), "user_id", "item_id", "rank")
    rankings = (
        named(evaluate.history_repeat_baseline(m.samples, 50), "repeat")
        .unionByName(named(evaluate.popularity_baseline(m.samples, m.ranking, 50), "popularity"))
        .unionByName(named(evaluate.average_vector_baseline(m.samples, m.units, 50), "average"))
    )
    return evaluate.metrics(rankings, m.samples, m.units.count())


@query(f"+ {METRICS} SELECT model, metric, floor(value * 1e6 + 0.5) / 1e6 AS value FROM mt", *EVAL)
def eval_metrics(m: Model) -> DataFrame:
    return _metrics(m).withColumn("value", quantized(F.col("value")))


@query(f"+ {METRICS} SELECT max(value) FILTER (model = 'average' AND metric = 'recall@10') > max(value) FILTER (model = 'popularity' AND metric = 'recall@10') AS beats FROM mt", *EVAL)
def eval_beats_baseline(m: Model) -> DataFrame:
    return evaluate.beats(_metrics(m), "average", "popularity")


FEATS = """h AS (SELECT user_id, item_id, pos, n FROM seqs WHERE pos > n - 50), u AS (SELECT user_id, count(*) AS len, max(pos) AS latest FROM h GROUP BY user_id
), hg AS (SELECT user_id, list(DISTINCT genre) AS hgenres FROM (SELECT user_id, unnest(genres) AS genre FROM h JOIN items USING (item_id)) GROUP BY user_id
), mp AS (SELECT user_id, i, sum(v[i]) / count(*) AS x FROM h JOIN unit USING (item_id), range(1, 65) r(i) GROUP BY user_id, i
), mean AS (SELECT user_id, list(x ORDER BY i) AS mean FROM mp GROUP BY user_id
), rec AS (SELECT DISTINCT h.user_id, h.item_id FROM h JOIN u USING (user_id) WHERE h.pos > latest - 5)"""


@query(f"""+ {FEATS} SELECT w.user_id, w.item_id, w.score AS retrieval_score, coalesce(1 - (p.rank - 1) / p.total, 0) AS popularity_rank_norm, CAST(u.len AS DOUBLE) AS history_length,
  CASE WHEN coalesce(len(i.genres), 0) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(i.genres, coalesce(hgenres, []))) / len(i.genres) END AS genre_overlap,
  CASE WHEN rec.item_id IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS in_recent_history, floor(list_dot_product(v, mean) * 1e6 + 0.5) / 1e6 AS avg_history_similarity,
  least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (i.start_year - 1970) / CAST(54 AS DOUBLE))) AS item_year_norm
FROM warm w JOIN items i USING (item_id) JOIN u USING (user_id) LEFT JOIN hg USING (user_id) JOIN mean USING (user_id) LEFT JOIN rec ON rec.user_id = w.user_id AND rec.item_id = w.item_id
  LEFT JOIN pop p ON p.item_id = w.item_id JOIN unit ON unit.item_id = w.item_id WHERE w.rank <= 10""", "items", "inter", "pop", *BASE[1:])
def rank_features(m: Model) -> DataFrame:
    rows = rank.features(m.candidates.select("user_id", "item_id", "score"), sequences.last(m.seqs), m.items, m.ranking, m.units)
    return rows.select("user_id", "item_id", *rank.FEATURES)


def _training(m: Model) -> DataFrame:
    samples = stored(m.samples, "samples")
    history = evaluate.exploded(samples)
    return rank.training_rows(samples, recommend.mean_vectors(history, m.units), m.units, m.items, m.ranking, pool=20)


@query(f"""+ {SAMPLE}, {AVGBASE}, c AS (SELECT user_id, item_id FROM abase JOIN items USING (item_id) WHERE rank <= 20
  UNION SELECT user_id, item_id FROM tgt JOIN hq USING (user_id) JOIN items USING (item_id) WHERE item_id IN (SELECT item_id FROM emb))
SELECT user_id, item_id, CASE WHEN (user_id, item_id) IN (SELECT (user_id, item_id) FROM tgt) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label FROM c""", "items", *EVAL)
def rank_training_rows(m: Model) -> DataFrame:
    return _training(m).select("user_id", "item_id", "label")


@query(f"""+ {SAMPLE}, {AVGBASE}, c AS (SELECT user_id, item_id, floor(score * 100) AS s FROM abase WHERE rank <= 20), l AS (SELECT s, CASE WHEN (user_id, item_id) IN (SELECT (user_id, item_id) FROM tgt) THEN 1 ELSE 0 END AS y FROM c
), b AS (SELECT s, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM l GROUP BY s), w AS (SELECT p * (coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS w, p, n FROM b)
SELECT floor(sum(w) / (sum(p) * sum(n)) * 1e6 + 0.5) / 1e6 AS auc FROM w""", *EVAL)
def rank_auc(m: Model) -> DataFrame:
    found = recommend.similar_for_users(recommend.mean_vectors(evaluate.exploded(m.samples), m.units), m.units, evaluate.exploded(m.samples).select("user_id", "item_id").distinct(), 20)
    label = m.samples.select("user_id", F.col("target").alias("item_id"), F.lit(1.0).alias("label"))
    rows = found.join(label, ["user_id", "item_id"], "left").select(F.floor(F.col("score") * 100).alias("score"), F.coalesce("label", F.lit(0.0)).alias("label"))
    return rank.auc(rows).select(quantized(F.col("auc")).alias("auc"))


@query()
def rank_gbt(m: Model) -> DataFrame:
    """Each user's candidates, re-ranked by boosted trees of up to 200 rounds that stop early by held-out users, after the
    model went through its artefact."""
    rows = stored(_training(m).withColumn("held", rank.held_out(F.col("user_id"))), "rank-rows")
    path = f"{shared_dir(m.spark).rstrip('/')}/marquee-ranker-{uuid.uuid4().hex}"
    rank.save(rank.fit(rows, pool=20, validation="held"), path)
    return rank.load(m.spark, path, pool=20).rerank(rows.drop("label", "held"), 10)


@query("""+ lat AS (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT * FROM events ORDER BY ts DESC LIMIT 1000))
SELECT max(value) FILTER (place = least(CAST(floor(n * 0.5) AS BIGINT), n - 1)) AS p50, max(value) FILTER (place = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) AS p95,
  max(value) FILTER (place = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)) AS p99 FROM lat""", "emb")
def latency_percentiles(m: Model) -> DataFrame:
    return evaluate.index_percentiles(evaluate.latest(m.table("events"), 1000, "ts"), "value")


@query("""WITH l AS (SELECT event_type AS route, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL
), k AS (SELECT route, value, row_number() OVER (PARTITION BY route ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY route) AS n FROM l WHERE r <= 1000)
SELECT route, max(n) AS n, round(max(value) FILTER (place = least(CAST(floor(n * 0.5) AS BIGINT), n - 1)), 2) AS p50, round(max(value) FILTER (place = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)), 2) AS p95,
  round(max(value) FILTER (place = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)), 2) AS p99 FROM k GROUP BY route""")
def latency_by_route(m: Model) -> DataFrame:
    """Percentiles over each route's latest 1000 samples."""
    rows = m.table("events").select(F.col("event_type").alias("route"), "ts", "event_id", "value")
    return evaluate.rolling_percentiles(rows, "route", "value", ("ts", "event_id"))


@query("SELECT event_type, CAST(least(floor(value / 20), 9) AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def event_histogram(m: Model) -> DataFrame:
    bucket = F.least(F.floor(F.col("value") / 20), F.lit(9)).cast("int")
    return m.table("events").groupBy("event_type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query()
def recs_transformer(m: Model) -> DataFrame:
    """Top items by the transformer's predicted vectors (random weights: shapes and plan, not quality)."""
    config = predict.Config()
    rows = predict.history_vectors(sequences.last(m.seqs), m.units)
    return recommend.similar_for_users(predict.predicted(rows, config, predict.weights_of(config)), m.units, m.seen, 10)


@query()
def transformer_training(m: Model) -> DataFrame:
    """Mean loss before each training step of the output head."""
    config = predict.Config()
    history = sequences.sequences(m.interactions, m.units).where("pos < n").withColumn("n", F.col("n") - 1)
    target = m.samples.select("user_id", F.col("target").alias("item_id")).join(m.units, "item_id").select("user_id", F.col("v").alias("target"))
    samples = predict.history_vectors(history, m.units).join(target, "user_id").cache()
    _, losses = predict.train_head(samples, config, steps=3)
    return m.spark.createDataFrame(list(enumerate(losses)), "step int, loss double")


@query()
def head_training(m: Model) -> DataFrame:
    """Loss and validation recall of three epochs in exact batches, with checkpoints."""
    config, split = predict.Config(), sequences.split(m.seqs)
    seqs = stored(m.seqs.select("user_id", "pos", "item_id"), "seqs")
    users = lambda name: seqs.join(split.where(F.col("split") == name).select("user_id"), "user_id", "left_semi")
    part = lambda name: predict.window_states(users(name), m.units, config, predict.weights_of(config))
    path = f"{shared_dir(m.spark).rstrip('/')}/marquee-training-{uuid.uuid4().hex}"
    _, history = predict.train(stored(part("train"), "train"), stored(part("val"), "val"), m.units, config, path, predict.Training(epochs=3, steps=2))
    return m.spark.createDataFrame([(h["epoch"], h["loss"], h["recall"]) for h in history], "epoch int, loss double, recall double")


@query("""SELECT a.item_id, floor(list_dot_product(list_transform(range(1, 65), lambda i: a.v[i] + b.v[i]), a.v) / sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] + b.v[i]) * (a.v[i] + b.v[i])))) * 1e6 + 0.5) / 1e6 AS cosine
FROM unit a JOIN unit b ON b.item_id = a.item_id + 1""", "emb", "unit")
def fused_vectors(m: Model) -> DataFrame:
    u = m.units
    b = u.select((F.col("item_id") - 1).alias("item_id"), F.col("v").alias("image"))
    return u.join(b, "item_id").select("item_id", quantized(dot(vectors.fused(F.col("v"), F.col("image")), F.col("v"))).alias("cosine"))
