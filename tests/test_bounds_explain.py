"""Bounds of requests, explanations by features, resetting tables, loading vectors."""

import numpy as np
import pytest

from marquee.operators import bounds, catalog, explain, library, rank, recommend, vectors
from marquee.sources import files


@pytest.mark.parametrize(
    ("name", "inside", "outside"),
    [("k", (1, 100), (0, 101, -5)), ("limit", (1, 100), (0, 101)), ("count_limit", (1, 200), (0, 201)), ("history_limit", (1, 200), (0, 201)), ("rating", (1, 3.5, 5), (0.5, 5.5)), ("variant", bounds.VARIANTS, ("x", "")), ("offset", (0, 10**9), (-1,))],
)
def test_bounds(name, inside, outside):
    for value in (*inside, None):
        bounds.checked(**{name: value})
    for value in outside:
        with pytest.raises(ValueError, match=name):
            bounds.checked(**{name: value})


def test_operators_check_their_bounds(spark):
    items = spark.createDataFrame([(1, "t", ["a"], 2000, ["x"])], "item_id bigint, title string, genres array<string>, start_year int, tags array<string>")
    rows = spark.createDataFrame([], "interaction_id bigint, user_id bigint, item_id bigint, ts bigint, type string, source string")
    for call in (
        lambda: catalog.page(catalog.search(items), 0), lambda: catalog.page(catalog.search(items), 20, -1), lambda: catalog.tag_counts(items, 201), lambda: catalog.genre_counts(items, 0),
        lambda: library.history_page(rows, items, 201), lambda: recommend.recommend(None, None, None, None, None, None, None, 0),
    ):
        with pytest.raises(ValueError, match="must"):
            call()


def test_ratings_outside_bounds_are_rejected(spark):
    items = spark.createDataFrame([(1,)], "item_id bigint")
    rows = spark.createDataFrame([(1, "rating", 1.0), (1, "rating", 5.0), (1, "rating", 0.5), (1, "rating", None), (2, "rating", 3.0), (1, "x", 3.0)], "item_id bigint, type string, rating double")
    got = [(r.item_id, r.type, r.rating, r.reason) for r in library.validated_ratings(rows, items).collect()]
    assert sorted(x[3] or "" for x in got) == ["", "", "item", "rating", "rating", "type"]


def test_explanations_by_features(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, f"T{i}", ["a"] if i % 2 else ["b", "c"], 1990 + i) for i in range(8)], "item_id bigint, title string, genres array<string>, start_year int")
    units = vectors.unit_table(spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(8)], "item_id bigint, vector array<double>"))
    history = spark.createDataFrame([(1, p, p) for p in range(1, 5)] + [(2, 1, 1), (2, 2, 2)], "user_id bigint, pos bigint, item_id bigint")
    pool = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.4), (2, 5, 0.8)], "user_id bigint, item_id bigint, score double")
    ranking = spark.createDataFrame([(i, 1, i + 1, 8) for i in range(8)], "item_id bigint, n bigint, rank bigint, total bigint")
    pairs = spark.createDataFrame([(1, 5), (1, 7), (1, 99), (2, 5), (3, 5)], "user_id bigint, item_id bigint")
    got = {(r.user_id, r.item_id): r for r in explain.recommendation_explanations(pairs, history, pool, items, ranking, units).collect()}
    assert {k: (r.variant, r.history_length, r.retrieval_score, r.rank_score, r.features, r.importance) for k, r in got.items()} == {
        (1, 5): ("generative", 4, 0.9, 0.9, {"retrieval_score": 0.9}, {"retrieval_score": 1.0}), (1, 7): ("generative", 4, None, None, {"retrieval_score": 0.0}, {"retrieval_score": 1.0}),
        (1, 99): ("generative", 4, None, None, {"retrieval_score": 0.0}, {"retrieval_score": 1.0}), (2, 5): ("popularity", 2, None, None, {}, {}), (3, 5): ("popularity", 0, None, None, {}, {}),
    }
    assert (got[1, 5].title, got[1, 99].title) == ("T5", None)
    x = rng.random((80, 7))
    rows = spark.createDataFrame([(*map(float, v), float(v[0] > 0.5)) for v in x], ", ".join(f"{f} double" for f in [*rank.FEATURES, "label"]))
    ranker = rank.fit(rows, rounds=3, depth=2)
    got = {(r.user_id, r.item_id): r for r in explain.recommendation_explanations(pairs, history, pool, items, ranking, units, ranker).collect()}
    assert set(got[1, 5].features) == set(rank.FEATURES) == set(got[1, 5].importance) and abs(sum(got[1, 5].importance.values()) - 1) < 1e-9
    assert got[1, 5].features["retrieval_score"] == 0.9 and got[1, 5].features["history_length"] == 4.0 and 0 < got[1, 5].rank_score < 1
    assert got[1, 7].features == {} and got[1, 7].rank_score is None and got[1, 7].importance == got[1, 5].importance
    assert got[2, 5].features == {} == got[2, 5].importance and got[2, 5].variant == "popularity"


def test_tables_are_reset(spark, tmp_path):
    a, b = f"file://{tmp_path}/items", f"file://{tmp_path}/interactions"
    spark.range(1, 5).withColumnRenamed("id", "item_id").write.parquet(a)
    spark.range(1, 9).withColumnRenamed("id", "interaction_id").write.parquet(b)
    assert files.next_id(spark.read.parquet(b), "interaction_id") == 9
    files.reset_tables(spark, {a: "item_id bigint", b: "interaction_id bigint"})
    for path, column in ((a, "item_id"), (b, "interaction_id")):
        assert spark.read.parquet(path).count() == 0 and files.next_id(spark.read.parquet(path), column) == 1


def test_loading_vectors_needs_some(spark):
    schema = "item_id bigint, vector array<double>"
    assert vectors.loaded(spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], schema), 2).first().v == [0.6, 0.8]
    with pytest.raises(ValueError, match="no embeddings"):
        vectors.loaded(spark.createDataFrame([(2, None)], schema), 2)
    with pytest.raises(Exception, match="has not 3 numbers"):
        vectors.loaded(spark.createDataFrame([(1, [3.0, 4.0])], schema), 3).collect()


def test_the_catalog_is_never_broadcast(spark, sf_dir):
    """Its file is small enough for a broadcast, its rows at scale are not."""
    from marquee.plans.registry import QUERIES

    for name in ("explain_text", "explain_shared_genres", "explain_related"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, (name, plan)
