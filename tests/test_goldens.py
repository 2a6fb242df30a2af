"""Known inputs and outputs of the recommendation model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.operators import catalog, evaluate, explain, library, merge, predict, rank, recommend, sequences, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(value):
    return F.lit(value).cast("string") if value is None else F.lit(value)


@pytest.mark.parametrize(
    ("value", "want"),
    [("Action,Adventure,Comedy", ["Action", "Adventure", "Comedy"]), ("\\N", None), ("", None), (" , ", None), (None, None), (" a ,, b", ["a", "b"])],
)
def test_imdb_genres(spark, value, want):
    assert one(spark, S.parse_imdb_genres(lit(value))) == want


def test_text(spark):
    assert one(spark, S.parse_genres(F.lit("(no genres listed)"))) is None
    assert one(spark, S.format_imdb_id(F.lit("0114709"))) == "tt0114709" == one(spark, S.format_imdb_id(F.lit(114709)))
    assert one(spark, S.format_imdb_id(F.lit("12345678"))) == "tt12345678" and one(spark, S.format_imdb_id(F.lit(" tt1 "))) == "tt1"
    assert one(spark, S.clean_api_string(F.lit(" N/A "))) is None
    for items, want in (([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")):
        assert one(spark, S.listing(F.array(*map(F.lit, items)).cast("array<string>"))) == want
    assert one(spark, S.truncate(F.lit("aaa bbb ccc"), 10)) == "aaa..." and one(spark, S.truncate(F.lit("x" * 12), 10)) == "x" * 7 + "..."
    assert one(spark, S.poster_extension(F.lit("image/png; q=1"), F.lit("http://x/a.jpg"))) == "png"
    assert one(spark, S.poster_extension(F.lit("text/html"), F.lit("http://x/a.WEBP?b=.png"))) == "webp"
    assert one(spark, S.poster_extension(F.lit(None).cast("string"), F.lit("http://x.png"))) == "jpg"


def test_years(spark):
    year = lambda *v: one(spark, S.display_year(*map(lit, v)))
    assert year("x", "1995.0", "2001-01-01") == 2001 and year(None, " 1999 ", None) == 1999 and year(None, None, "20") is None
    assert one(spark, S.ranker_year(F.lit("x"), F.lit("1999"))) is None and one(spark, S.ranker_year(F.lit(""), F.lit("1999"))) == 1999
    for y, want in ((1970, 0.0), (2024, 1.0), (None, 0.5), (1900, 0.0), (2100, 1.0)):
        assert one(spark, S.normalize_year(F.lit(y).cast("int"))) == want


def test_preferences_and_arrays(spark):
    canon = S.canonical_genres(F.array(*map(F.lit, ["Comedy", "Animation", "animation", " Comedy "])))
    assert one(spark, canon) == ["Animation", "Comedy"]
    assert S.distinct_labels(["Animation", "animation", " Comedy ", ""]) == ["Animation", "Comedy"]
    arr = lambda *v: F.array(*(F.lit(x) for x in v)).cast("array<bigint>")
    assert one(spark, S.padded(arr(4), 5)) == [4, 0, 0, 0, 0] and one(spark, S.padding_mask(arr(4), 5)) == [True] + [False] * 4
    assert one(spark, S.padded(arr(1, 2, 3), 2)) == [2, 3]
    g = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    assert one(spark, S.genre_overlap_ratio(g("Action", "Comedy"), g("Action", "Drama"))) == 0.5
    assert one(spark, S.genre_overlap_ratio(g(), g("x"))) == 0.0


def test_ab_variants(spark):
    users = spark.range(100).select(F.col("id").alias("user_id"))
    assert {r.variant for r in recommend.variants(users, 0.0).collect()} == {"popularity"}
    assert {r.variant for r in recommend.variants(users, 1.0).collect()} == {"generative"}


ROWS = "user_id bigint, item_id bigint, type string, rating double, source string"


def interactions(spark, rows):
    data = [(i, u, item, i, t, r, s) for i, (u, item, t, r, s) in enumerate(rows)]
    return spark.createDataFrame(data, "interaction_id bigint, user_id bigint, item_id bigint, ts bigint, type string, rating double, source string")


def test_sequences(spark):
    rows = [(1, 10, "rating", 4.0), (1, 10, "rating", 5.0), (1, 11, "rating", 2.0), (1, 12, "tag", None), (1, 13, "rating", 3.5),
            (2, 10, "rating", 5.0), (2, 99, "rating", 5.0), (2, 11, "rating", 4.0)]
    table = interactions(spark, [(*r, None) for r in rows])
    embedded = spark.createDataFrame([(i,) for i in (10, 11, 12, 13)], "item_id bigint")
    got = sequences.sequences(table, embedded).orderBy("user_id", "pos").collect()
    assert [(r.user_id, r.item_id) for r in got] == [(1, 10), (1, 12), (1, 13)]


def exploded(spark, seqs):
    rows = [(u, i + 1, item, len(s)) for u, s in seqs.items() for i, item in enumerate(s)]
    return spark.createDataFrame(rows, "user_id bigint, pos bigint, item_id bigint, n bigint")


def test_windows_and_holdout(spark):
    seqs = exploded(spark, {1: [1, 2, 3, 4, 5]})
    got = [(r.history, r.target) for r in sequences.training_windows(seqs, 3).orderBy("pos").collect()]
    assert got == [([1], 2), ([1, 2], 3), ([1, 2, 3], 4), ([2, 3, 4], 5)]
    (r,) = sequences.holdout(seqs, 3).collect()
    assert (r.history, r.target) == ([2, 3, 4], 5)
    (r,) = sequences.holdout(seqs, 3, held=2).collect()
    assert (r.history, r.target) == ([1, 2, 3], 5)


def test_split_and_shards(spark):
    users = spark.range(100).select(F.col("id").alias("user_id"))
    counts = {r.split: r["count"] for r in sequences.split(users, 0).groupBy("split").count().collect()}
    assert counts == {"train": 80, "val": 10, "test": 10}
    assert sequences.split(users, 0).select("user_id").distinct().count() == 100
    shards = [r["count"] for r in sequences.shards(users.limit(10), 4).groupBy("shard").count().orderBy("shard").collect()]
    assert shards == [3, 3, 3, 1]
    assert sequences.subsample(users, 7).count() == 7 and sequences.subsample(users, 0).count() == 100
    assert sequences.epoch_seed(1, 2, 3) == 20301 and sequences.epochs_of_batch(5, 2, 0) == 3 and sequences.epochs_of_batch(1, 4, 0) == 1


def test_popularity_ties_keep_first_met(spark):
    seqs = exploded(spark, {1: [10, 20, 20], 2: [20, 30], 3: [10, 10, 10]})
    embedded = spark.createDataFrame([(10,), (20,)], "item_id bigint")
    got = recommend.popularity_of_sequences(seqs, embedded).orderBy("rank").collect()
    assert [(r.item_id, r.n, r["rank"]) for r in got] == [(10, 4, 1), (20, 3, 2)]


def vector_table(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2]), (4, [0.1, 0.9])]
    return spark.createDataFrame(rows, "item_id bigint, vector array<double>")


def test_top_k(spark):
    units = vectors.unit_table(vector_table(spark), 2)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, q array<double>")
    out = lambda *gone: [r.item_id for r in vectors.top_k(q, units, 2, spark.createDataFrame([(7, g) for g in gone], "query_id bigint, item_id bigint")).orderBy("rank").collect()]  # noqa: E731, E501
    assert out(1) == [2, 3] and out(1, 2) == [3, 4] and out(1, 2, 3) == [4]
    for most in (0, 1 << 20):  # in cells of a grid, or by broadcast: the best two of four blocks of one
        small = vectors.top_candidates(q.select("query_id", S.normalized(F.col("q")).alias("q"), F.lit(2).alias("want")), units, 3, 1, most)
        best = sorted((-r.score, r.item_id) for r in small.collect())
        assert best[:2] == [(-1.0, 1), (-0.993884, 2)] and len(best) == (2 if most else 4)
    with pytest.raises(ValueError, match="positive"):
        vectors.top_k(q, units, 0)
    with pytest.raises(Exception, match="has not 3 numbers"):
        vectors.unit_table(vector_table(spark), 3).collect()
    check = vectors.self_check(units, 3).first()
    assert (check.checked, check.mismatches) == (3, 0)


def catalog_rows(spark):
    rows = [(100, "A", ["Drama", "Romance"], 1990), (200, "B", ["Animation", "Family"], 1995), (300, "C", ["Animation"], 2000)]
    return spark.createDataFrame(rows, "item_id bigint, title string, genres array<string>, start_year int")


def ranking(spark, ids):
    return spark.createDataFrame([(i, r + 1, len(ids)) for r, i in enumerate(ids)], "item_id bigint, rank bigint, total bigint")


def test_genre_weighting(spark):
    users = spark.createDataFrame([(1,)], "user_id bigint")
    none = spark.createDataFrame([], "user_id bigint, item_id bigint")
    profile = spark.createDataFrame([(1, "animation", 3), (1, "family", 2)], "user_id bigint, genre string, n bigint")
    got = recommend.genre_weighted(users, ranking(spark, [100, 200, 300]), none, catalog_rows(spark), 2, profile).orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in got] == [(200, 50_002.0), (300, 30_001.0)]
    seen = spark.createDataFrame([(1, 200)], "user_id bigint, item_id bigint")
    got = recommend.genre_weighted(users, ranking(spark, [100, 200, 300]), seen, catalog_rows(spark), 5, labels=["ANIMATION"]).collect()
    assert [(r.item_id, r.score) for r in got] == [(300, 10_002.0)]


def test_genre_filter_keeps_order(spark):
    items = spark.createDataFrame([(1, ["Animation"]), (2, ["Action"]), (3, ["Animation", "Comedy"])], "item_id bigint, genres array<string>")
    c = spark.createDataFrame([(9, i, 1.0 / i, i) for i in (1, 2, 3)], "user_id bigint, item_id bigint, score double, rank bigint")
    assert [r.item_id for r in recommend.filtered_by_genres(c, items, ["Animation"], 2).orderBy("rank").collect()] == [1, 3]
    assert recommend.filtered_by_genres(c, items, [" "], 2).count() == 2


def test_popularity_for_users(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    seen = spark.createDataFrame([(1, 100), (1, 999)], "user_id bigint, item_id bigint")
    got = recommend.popular_for_users(users, ranking(spark, [100, 200, 300]), seen, 2).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.item_id, r.score) for r in got] == [(1, 200, 2.0), (1, 300, 1.0), (2, 100, 3.0), (2, 200, 2.0)]


def test_metrics(spark):
    rank_rows = [("m", u, i, p) for u, items in enumerate([[1, 2, 3], [4, 5, 6], [7, 8, 9]]) for p, i in enumerate(items, 1)]
    rankings = spark.createDataFrame(rank_rows, "model string, user_id bigint, item_id bigint, rank bigint")
    samples = spark.createDataFrame([(0, 2), (1, 4), (2, 10)], "user_id bigint, target bigint")
    got = {r.metric: r.value for r in evaluate.metrics(rankings, samples, 10, (1, 2, 10)).collect()}
    assert got["recall@1"] == 1 / 3 and got["recall@2"] == 2 / 3 and got["mrr"] == 0.5 and got["coverage"] == 0.9
    assert math.isclose(got["ndcg@10"], (1 / math.log2(3) + 1) / 3)
    w = evaluate.weighted_mean(spark.createDataFrame([(1.0, 1), (4.0, 2)], "v double, n int"), "v", "n").first()[0]
    assert w == 3.0


def test_latency_percentiles(spark):
    got = evaluate.index_percentiles(spark.range(10), "id").first()
    assert (got.p50, got.p95, got.p99) == (5, 9, 9)


def library_rows(spark):
    return interactions(spark, [(1, 100, "view", None, "library"), (1, 300, "rating", 5.0, None), (1, 200, "view", None, "library"), (1, 200, "rating", 4.0, "library"), (1, 100, "click", None, "watchlist")])


def test_library_isolation(spark):
    rows, items = library_rows(spark), catalog_rows(spark)
    assert {r.item_id for r in library.library(rows, items).collect()} == {100, 200}
    assert [r.item_id for r in library.library_history(rows).orderBy("pos").collect()] == [100, 200]
    s = {r.item_id: r for r in library.status(rows).collect()}
    assert (s[100].in_library, s[100].in_watchlist, s[100].rating) == (True, True, None) and s[200].rating == 4.0 and not s[300].in_library


def test_explanations(spark):
    pairs = spark.createDataFrame([(1, 300), (2, 300)], "user_id bigint, item_id bigint")
    lib = library.library(library_rows(spark), catalog_rows(spark))
    got = {r.user_id: r for r in explain.explained(pairs, lib, catalog_rows(spark)).collect()}
    assert got[1].explanation == "C fits your Animation picks — especially if you liked B."
    assert got[1].reasons == ["Matches your taste for Animation.", "Similar vibe to B (Animation)."] and got[1].related == ["B", "A"]
    assert got[2].explanation == "Add more films to your library so we can explain why C might suit your taste." and got[2].reasons == []


def test_genre_counts(spark):
    rows = [(g,) for g, n in (("Animation", 30), ("IMAX", 40), ("Action", 26), ("Film-Noir", 5)) for _ in range(n)]
    items = spark.createDataFrame(rows, "g string").select(F.array("g").alias("genres"))
    assert [r.genre for r in catalog.genre_counts(items).orderBy("place").collect()] == ["Action", "Animation"]
    with pytest.raises(ValueError, match="limit"):
        catalog.page(items, limit=101)


def test_merges(spark):
    users = spark.createDataFrame([(1, "Ann"), (2, "ANN"), (3, None), (4, "bob")], "id bigint, username string")
    assert {(r.id, r.username) for r in merge.merged_users(users).collect()} == {(1, "ann"), (3, None), (4, "bob")}
    moved = merge.moved_interactions(interactions(spark, [(2, 5, "view", None, None), (4, 6, "view", None, None)]), merge.kept_ids(users))
    assert {(r.user_id, r.item_id) for r in moved.collect()} == {(1, 5), (4, 6)}


def test_transformer_invariants():
    config = predict.Config(dimension=8, hidden=16, heads=2, layers=2, feed=32, length=6)
    w = predict.weights_of(config)
    rng = np.random.default_rng(1)
    x, mask = rng.normal(size=(3, 6, 8)), np.arange(6) < np.array([6, 3, 1])[:, None]
    y = predict.forward(config, w, x, mask)
    assert y.shape == (3, 8) and np.allclose(np.linalg.norm(y, axis=1), 1)
    x2 = x.copy()
    x2[1, 3:] = 99.0  # padding is not read
    assert np.allclose(predict.forward(config, w, x2, mask), y)
    alone = predict.forward(config, w, x[1:2, :3], mask[1:2, :3])
    assert np.allclose(alone, y[1:2])
    with pytest.raises(ValueError, match="empty"):
        predict.forward(config, w, x, mask & False)


def test_head_gradient_matches_differences():
    rng = np.random.default_rng(2)
    state, target, w, b = rng.normal(size=(5, 6)), rng.normal(size=(5, 4)), rng.normal(size=(6, 4)), rng.normal(size=4)
    _, g, _ = predict.head_gradient(state, target, w, b, 0.5)
    for i, j in ((0, 0), (3, 2)):
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        up, down = (predict.head_gradient(state, target, w + s * e, b, 0.5)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[i, j]) < 1e-4


def test_training_lowers_loss(spark):
    rng = np.random.default_rng(3)
    rows = [([rng.normal(size=8).tolist() for _ in range(3)], t) for t in np.eye(8).tolist() for _ in range(4)]
    samples = spark.createDataFrame(rows, "vectors array<array<double>>, target array<double>")
    config = predict.Config(dimension=8, hidden=16, heads=2, layers=1, feed=32, length=4)
    _, losses = predict.train_head(samples.coalesce(1), config, steps=4, rate=0.2, temperature=0.5)
    assert len(losses) == 4 and losses[-1] < losses[0]


def test_ranker(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 10, i, *rng.random(7).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "user_id bigint, item_id bigint, " + ", ".join(f"{f} double" for f in rank.FEATURES))
    frame = frame.withColumn("label", (F.col("retrieval_score") > 0.7).cast("double"))
    model = rank.train(frame, rounds=3, depth=2)
    best = rank.rerank(model, frame, 2)
    assert best.count() == 20 and abs(sum(rank.importance(model).values()) - 1) < 1e-9
    assert rank.auc(spark.createDataFrame([(0.1, 0.0), (0.9, 1.0), (0.5, 1.0), (0.5, 0.0)], "score double, label double")).first()[0] == 0.875


def test_serving_policy(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    recs = lambda rows: spark.createDataFrame([(u, i, 1.0, 1) for u, i in rows], "user_id bigint, item_id bigint, score double, rank bigint")
    model, popular = recs([(1, 7)]), recs([(1, 5), (2, 5)])
    out = lambda *a, **k: {(r.user_id, r.item_id, r.variant) for r in recommend.served(users, *a, **k).collect()}
    assert out(model, popular, force="generative") == {(1, 7, "generative"), (2, 5, "popularity")}
    assert out(model, popular, force="popularity") == out(None, popular) == {(1, 5, "popularity"), (2, 5, "popularity")}
    with pytest.raises(ValueError, match="variant"):
        recommend.served(users, model, popular, force="x")
    with pytest.raises(RuntimeError, match="model"):
        recommend.served(users, None, popular, fallback=False)
