"""Negatives, batches, loading until enough users qualify, the serving cascade, the ranker's artefact."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import rank, recommend, sequences, training

INTERACTIONS = "interaction_id bigint, user_id bigint, item_id bigint, ts bigint, type string, rating double"


def units(spark, n, dimension):
    eye = np.eye(n, dimension)
    return spark.createDataFrame([(i + 1, [float(x) for x in row]) for i, row in enumerate(eye)], "item_id bigint, v array<double>")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "batch bigint, item_id bigint")


def test_shared_negatives_of_one_batch(spark):
    """Six of ten items, the same for the whole batch; none for samples; no item twice."""
    samples = spark.createDataFrame([(0, 1, [1.0] + [0.0] * 7, 1), (0, 2, [0.0, 1.0] + [0.0] * 6, 2)], "batch bigint, query_id bigint, q array<double>, target bigint")
    shared, hard = training.negatives(samples, units(spark, 10, 8), random=6, hard=0)
    items = [r.item_id for r in shared.collect()]
    assert hard is None and len(items) == 6 == len(set(items)) and not {1, 2} & set(items)


def test_hard_negatives_are_per_sample(spark):
    samples = spark.createDataFrame([(0, 1, [1.0, 0.0, 0.0, 0.0], 1), (0, 2, [0.0, 1.0, 0.0, 0.0], 2)], "batch bigint, query_id bigint, q array<double>, target bigint")
    shared, hard = training.negatives(samples, units(spark, 5, 4), random=0, hard=2)
    lists = {}
    for r in hard.collect():
        lists.setdefault(r.query_id, []).append(r.item_id)
    assert shared is None and {k: len(v) for k, v in lists.items()} == {1: 2, 2: 2}
    assert 1 not in lists[1] and 2 not in lists[2]


def test_shared_negatives_are_topped_up(spark):
    """What a batch excludes is made up for, around the end of the order; a short catalog gives what is left."""
    catalog = units(spark, 12, 4)
    excluded = pairs(spark, [(0, i) for i in range(1, 9)] + [(1, None), (2, 3), (2, 3), (2, 99)] + [(3, i) for i in range(1, 13)])
    for k, want in ((4, {0: 4, 1: 4, 2: 4}), (6, {0: 4, 1: 6, 2: 6}), (100, {0: 4, 1: 12, 2: 11}), (0, {})):
        got = {}
        for r in training.shared_negatives(excluded, catalog, k).collect():
            got.setdefault(r.batch, []).append((r.rank, r.item_id))
        assert {b: len({i for _, i in v}) for b, v in got.items()} == want
        assert all([r for r, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
        assert not {i for _, i in got.get(0, [])} & set(range(1, 9)) and 3 not in {i for _, i in got.get(2, [])}
    one, two = (sorted(map(tuple, training.shared_negatives(excluded.repartition(n), catalog.repartition(n), 4).collect())) for n in (1, 5))
    assert one == two != sorted(map(tuple, training.shared_negatives(excluded, catalog, 4, seed=7).collect()))
    with pytest.raises(ValueError, match="empty catalog"):
        training.shared_negatives(excluded, catalog.where("false"), 4)


def test_batches(spark):
    """Exact sizes, an order of each epoch, whatever the partitions; histories cut and padded."""
    windows = spark.createDataFrame([(u, p, list(range(1, p)), 100 * u + p) for u in range(10) for p in range(2, 9)], "user_id bigint, pos bigint, history array<bigint>, target bigint")
    rows = training.training_batches(windows, 16, length=5).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.batch, []).append(r.place)
        want = list(range(1, r.pos))[-5:]
        assert list(r["items"]) == want + [0] * (5 - len(want)) and list(r["mask"]) == [True] * len(want) + [False] * (5 - len(want)) and r.target == 100 * r.user_id + r.pos
    assert {b: sorted(v) for b, v in sizes.items()} == {b: list(range(16 if b < 4 else 6)) for b in range(5)}
    order = lambda **k: [(r.user_id, r.pos) for r in sorted(training.training_batches(windows.repartition(k.pop("n", 3)), 16, **k).collect(), key=lambda r: (r.batch, r.place))]
    assert order(n=1) == order(n=7) and len({tuple(order(epoch=e, shard=s)) for e in (0, 1) for s in (0, 1)}) == 4
    with pytest.raises(ValueError, match="at least one"):
        training.training_batches(windows, 0)


def test_batch_recall_keeps_histories(spark):
    """The best item counts even if it was seen; a target without a vector is a miss."""
    samples = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.1, 0.0], 3), (3, [1.0, 0.0, 0.0, 0.0], 99)], "query_id bigint, q array<double>, target bigint")
    recall = lambda k: training.batch_recall(samples, units(spark, 4, 4), k).first()
    assert (recall(1).n, recall(1).recall, recall(2).recall) == (3, 1 / 3, 2 / 3)
    assert training.batch_recall(samples.where("false"), units(spark, 4, 4), 1).first().recall == 0.0


def test_loading_stops_when_enough_users_qualify(spark, tmp_path):
    """The first users in shuffled order, of only as many ranges as they need: the other files are gone."""
    rng = np.random.default_rng(1)
    rows = [(u * 10 + i, u, int(rng.integers(1, 40)), i, "rating", float(rng.choice([2.0, 4.0, 5.0]))) for u in range(400) for i in range(int(rng.integers(1, 9)))]
    table, path = spark.createDataFrame(rows, INTERACTIONS), str(tmp_path / "t")
    embedded = spark.range(1, 30).withColumnRenamed("id", "item_id")
    whole = sequences.sequences(table, embedded)
    order = [r.user_id for r in whole.select("user_id").distinct().orderBy(sequences.shuffled(F.col("user_id")), "user_id").collect()]
    sequences.with_user_range(table, 1).write.partitionBy("user_range").parquet(path)
    ranged = spark.read.parquet(path)
    for most, at_most in ((5, 1), (30, 7), (10_000, 16)):
        found, read = sequences.first_qualifying(ranged, most, embedded, digits=1)
        assert read <= at_most
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.where(F.col("user_id").isin(order[:most])).collect()))
    for r in range(3, 16):
        shutil.rmtree(tmp_path / "t" / f"user_range={r}", ignore_errors=True)
    found, read = sequences.first_qualifying(ranged, 10, embedded, digits=1)
    assert read <= 3 and {r.user_id for r in found.collect()} == set(order[:10])
    with pytest.raises(ValueError, match="at least one user"):
        sequences.first_qualifying(ranged, 0)


CANDIDATES = "user_id bigint, item_id bigint, score double, rank bigint"


def test_cascade_fills_only_what_is_lacking(spark):
    users = spark.createDataFrame([(1,), (2,), (3,), (3,)], "user_id bigint")
    rows = lambda *v: spark.createDataFrame([(u, i, float(100 - r), r) for u, i, r in v], CANDIDATES)
    model = rows((1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4), (2, 20, 1), (9, 1, 1))
    library = rows((1, 30, 1), (2, 20, 1), (2, 31, 2))
    popular = rows(*((u, i, r + 1) for u in (1, 2, 3) for r, i in enumerate((20, 31, 50, 51))))
    got = {}
    for r in sorted(recommend.cascade(users, [("model", model), ("library", library), ("none", None), ("popularity", popular)], 3).collect(), key=lambda r: r.rank):
        got.setdefault(r.user_id, []).append((r.rank, r.item_id, r.source))
    assert got == {
        1: [(1, 10, "model"), (2, 11, "model"), (3, 12, "model")],
        2: [(1, 20, "model"), (2, 31, "library"), (3, 50, "popularity")],
        3: [(1, 20, "popularity"), (2, 31, "popularity"), (3, 50, "popularity")],
    }
    assert recommend.cascade(users, [("model", None)], 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        recommend.cascade(users, [("model", model)], 0)


def test_serving_sources(spark):
    """Without vectors or a model only popularity is served; without fallback a missing model is an error."""
    vectors = spark.createDataFrame([(1, [1.0])], "item_id bigint, vector array<double>")
    none, model = vectors.where("false"), spark.createDataFrame([(1, 2, 1.0, 1)], CANDIDATES)
    assert recommend.serving_sources(vectors, model, None, model, "m@1")[0] == "m@1"
    for embeddings, found in ((none, model), (vectors, None), (none, None)):
        version, sources = recommend.serving_sources(embeddings, found, None, model)
        assert version == "popularity-fallback" and dict(sources)["model"] is None and dict(sources)["popularity"] is model
    with pytest.raises(FileNotFoundError):
        recommend.serving_sources(vectors, None, None, model, fallback=False)
    assert recommend.serving_sources(none, None, None, model, fallback=False)[0] == "popularity-fallback"


# ---------------------------------------------------------------- the ranker's artefact


@pytest.fixture(scope="module")
def ranker_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.random((600, len(rank.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 3] + 0.2 * rng.random(600) > 0.9).astype(float)
    names = [*rank.FEATURES, "label", "user_id", "item_id"]
    rows = spark.createDataFrame([(*map(float, v), float(t), i // 6, i) for i, (v, t) in enumerate(zip(x, y, strict=True))], ", ".join(f"{n} {'bigint' if n.endswith('_id') else 'double'}" for n in names))
    return rows.withColumn("held", rank.held_out(F.col("user_id"))).coalesce(1).cache()


def test_ranker_artefact(spark, ranker_rows, tmp_path):
    path = f"file://{tmp_path}/r"
    assert rank.load(spark, path) is None
    ranker = rank.fit(ranker_rows, rounds=30, depth=3, validation="held", trained_at="2026-01-01")
    assert ranker.trees <= 30 and abs(ranker.config["auc"] - 0.98) < 0.02 and ranker.config["rows"] == 600
    rank.save(ranker, path)
    again = rank.load(spark, path, pool=50, depth=3)
    assert again.config == ranker.config
    scores = lambda r: sorted((x.item_id, x.p) for x in rank.scored(r.model, ranker_rows).select("item_id", "p").collect())
    assert scores(again) == scores(ranker)
    kept = rank.auc(rank.scored(again.model, ranker_rows.where("held")), "p").first().auc
    assert abs(kept - ranker.config["auc"]) < 1e-12
    with pytest.raises(ValueError, match="trained with pool 50, not 20"):
        rank.load(spark, path, pool=20)


def test_ranker_of_other_features_is_refused(spark, ranker_rows, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/r"
    rank.save(rank.fit(ranker_rows, rounds=2, depth=2), path)
    monkeypatch.setattr(rank, "FEATURES", rank.FEATURES[:-1])
    with pytest.raises(ValueError, match="features"):
        rank.load(spark, path)


def test_boosting_stops_early(spark, ranker_rows):
    """Labels that nothing explains: held-out loss does not fall for long."""
    noise = ranker_rows.withColumn("label", (F.pmod(F.xxhash64("item_id"), F.lit(2))).cast("double"))
    assert rank.fit(noise, rounds=40, depth=3, validation="held").trees < 40
