"""Resumable training of the output head, and rolling latency as a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee import tables
from marquee.operators import evaluate, predict
from marquee.streaming import latency

CONFIG = predict.Config(dimension=8, hidden=8, heads=2, layers=1, feed=8, length=4)
HOW = predict.Training(epochs=4, batch=16, steps=2, rate=0.05, negatives=6, patience=9, recall_k=3)


@pytest.fixture(scope="module")
def training_tables(spark):
    """Users who walk in a circle over items: the next item follows from the last."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 8))
    units = spark.createDataFrame([(i, [float(x) for x in row / np.linalg.norm(row)]) for i, row in enumerate(v)], "item_id bigint, v array<double>")
    seqs = spark.createDataFrame([(u, p + 1, (3 * u + p) % 20, 6) for u in range(30) for p in range(6)], "user_id bigint, pos bigint, item_id bigint, n bigint")
    rows = predict.windowed_vectors(seqs, units).cache()
    assert rows.count() == 150 and {len(r.vectors) for r in rows.collect()} == {1, 2, 3, 4, 5}
    rows = rows.withColumn("vectors", F.slice("vectors", F.greatest(F.lit(1), F.size("vectors") - 3), 4)).cache()
    return rows.where("user_id < 24"), rows.where("user_id >= 24"), units


@pytest.fixture(scope="module")
def whole_run(training_tables, tmp_path_factory):
    return predict.train(*training_tables, CONFIG, f"file://{tmp_path_factory.mktemp('whole')}", HOW)


def test_loss_falls(whole_run):
    losses = [h["loss"] for h in whole_run[1]]
    assert [h["epoch"] for h in whole_run[1]] == [0, 1, 2, 3] and losses[-1] < losses[0]


def test_a_resumed_run_equals_one_that_was_not_stopped(training_tables, whole_run, tmp_path):
    path = f"file://{tmp_path}/r"
    _, first = predict.train(*training_tables, CONFIG, path, HOW, stop_after=2)
    weights, history = predict.train(*training_tables, CONFIG, path, HOW)
    assert len(first) == 2 and history == whole_run[1]
    assert all(np.array_equal(weights[k], whole_run[0][k]) for k in weights)
    assert predict.train(*training_tables, CONFIG, path, HOW)[1] == history  # nothing is left to do


def test_training_does_not_depend_on_partitions(training_tables, whole_run, tmp_path):
    train, validation, units = training_tables
    weights, history = predict.train(train.repartition(5), validation.repartition(2), units.repartition(3), CONFIG, f"file://{tmp_path}/p", HOW)
    assert history == whole_run[1] and np.array_equal(weights["out"], whole_run[0]["out"])


def test_early_stop_keeps_the_best(training_tables, tmp_path):
    """A rate of 0 changes nothing, so the first epoch is the best and patience ends the run."""
    how = predict.Training(epochs=9, batch=64, steps=1, rate=0.0, negatives=0, patience=2, recall_k=3)
    weights, history = predict.train(*training_tables, CONFIG, f"file://{tmp_path}/e", how)
    assert len(history) == 3 and len({h["recall"] for h in history}) == 1
    assert np.array_equal(weights["out"], predict.weights_of(CONFIG)["out"])


def test_others_are_negatives():
    rng = np.random.default_rng(0)
    state, target, w, b, others = rng.normal(size=(5, 6)), rng.normal(size=(5, 4)), rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=(3, 4))
    loss, gw, gb = predict.head_gradient(state, target, w, b, 0.5, others)
    assert loss > predict.head_gradient(state, target, w, b, 0.5)[0]
    for place in ((0, 0), (3, 2), (5, 1)):
        near = w.copy()
        near[place] += 1e-6
        assert abs((predict.head_gradient(state, target, near, b, 0.5, others)[0] - loss) / 1e-6 - gw[place]) < 1e-3
    assert abs((predict.head_gradient(state, target, w, b + np.r_[1e-6, 0, 0, 0], 0.5, others)[0] - loss) / 1e-6 - gb[0]) < 1e-3


@pytest.mark.parametrize("summed", [predict.SUMMED, 3])
def test_sums_of_many_batches_are_exact(spark, monkeypatch, summed):
    """Each batch's loss and gradient fit in a long of grains, their sums do not; a worker may give several rows."""
    monkeypatch.setattr(predict, "SUMMED", summed)
    rng = np.random.default_rng(4)
    state, target, w, b = rng.normal(size=(4, 6)), rng.normal(size=(4, 5)), rng.normal(size=(6, 5)), rng.normal(size=5)
    loss, gw, gb = predict.head_gradient(state, target, w, b, 3e-7)
    one = np.rint(np.r_[loss, gw.ravel(), gb] / predict.GRAIN)
    assert 2.0**60 < np.abs(one).max() < 2.0**63 and (one < 0).any()
    rows = [(k, i, [float(x) for x in state[i]], [float(x) for x in target[i]], None) for k in range(40) for i in range(4)]
    batches = spark.createDataFrame(rows, "batch bigint, place int, state array<double>, target array<double>, others array<array<double>>")
    n, total, g = predict._gradients(batches.repartition(3), {"out": w, "out_b": b}, 3e-7)
    want = [float(40 * int(x)) * predict.GRAIN for x in one]
    assert max(abs(40 * int(x)) for x in one) >= 2**63 and n == 160 and [total, *g] == want


def test_a_loss_that_is_no_number_is_an_error():
    for x in (np.nan, np.inf, -predict.MOST):
        with pytest.raises(ValueError, match="no number or too large"):
            predict._whole(np.array([0.0, x]))


# ---------------------------------------------------------------- rolling latency


def test_stream_equals_batch_after_each_micro_batch(spark, sf_dir, tmp_path):
    """Files in order of time; the stream is stopped between files and goes on from its checkpoint."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").toPandas()
    cuts, folder = np.array_split(np.arange(len(events)), 5), tmp_path / "in"
    folder.mkdir()
    seen = []

    def keep(rows, number):
        seen.append({r.route: tuple(r) for r in rows.collect()})

    def go():
        stream = latency.rolling_latency(latency.request_stream(spark, f"file://{folder}"), most=60)
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/c").outputMode("update").trigger(availableNow=True).start().awaitTermination()

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for turn, part in enumerate(cuts):
            spark.createDataFrame(events.iloc[part]).coalesce(1).write.parquet(f"file://{tmp_path}/w{turn}")
            file = next((tmp_path / f"w{turn}").glob("part-*.parquet"))
            file.rename(folder / f"{turn}.parquet")
            if turn in (0, 2, 4):  # the second and the fourth time two files have come
                go()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(seen) == 5
    last = {}
    for turn, found in enumerate(seen):
        last |= found
        rows = spark.createDataFrame(events.iloc[: int(cuts[turn][-1]) + 1]).select(F.col("event_type").alias("route"), "ts", "event_id", "value")
        want = {r.route: tuple(r) for r in evaluate.rolling_percentiles(rows, "route", "value", ("ts", "event_id"), 60).collect()}
        assert last == want


def test_rolling_percentiles(spark):
    rows = spark.createDataFrame([("a", i, float(i * 7 % 50)) for i in range(50)] + [("b", 1, 2.345), ("c", 1, None)], "route string, t int, ms double")
    got = {r.route: tuple(r)[1:] for r in evaluate.rolling_percentiles(rows, "route", "ms", ("t",), 20).collect()}
    latest = sorted(float(i * 7 % 50) for i in range(30, 50))
    assert got == {"a": (20, latest[10], latest[19], latest[19]), "b": (1, 2.35, 2.35, 2.35)}


def test_states_of_histories_equal_those_of_windows(spark, training_tables):
    """Users of 1 to 3 * length items, in batches that cut them: each window's state is that of its own vectors."""
    units = training_tables[2]
    rows = [(u, 2 * p + 1, (7 * u + 3 * p * p) % 23) for u in range(13) for p in range(u + 1)]  # items 20 to 22 have no vector
    seqs = spark.createDataFrame(rows, "user_id bigint, pos bigint, item_id bigint")
    w, before = predict.weights_of(CONFIG), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.user_id, r.pos, r.item_id): r.state for r in predict.encoded(predict.windowed_vectors(seqs, units, CONFIG.length), CONFIG, w).collect()}
    try:
        for size in (1, 5, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = predict.window_states(seqs.coalesce(1), units, CONFIG, w).collect()
            assert len(got) == len(want) > 60 and {(r.user_id, r.pos, r.item_id): r.state for r in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_training_keeps_no_vectors_of_windows(spark, training_tables, tmp_path, monkeypatch):
    """No table of a run holds a window's vectors, and an epoch's tables are gone."""
    folder = tmp_path / "tables"
    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file://{folder}")
    predict.train(*training_tables, CONFIG, f"file://{tmp_path}/c", HOW, stop_after=1)
    names = [p.name for p in folder.iterdir()]
    assert sum(n.startswith("marquee-states") for n in names) == 2 and not [n for n in names if n.startswith(("marquee-epoch", "marquee-asked"))]
    assert not [n for n in names if "vectors" in spark.read.parquet(f"file://{folder}/{n}").columns]
