"""The vector store, its map of ids, and search over it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.operators import numbering, vectors
from marquee.sources import vector_store

SCHEMA = "item_id bigint, vector array<double>"


def table(spark, ids, dimension=6, seed=0):
    v = np.random.default_rng(seed).normal(size=(len(ids), dimension))
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v, strict=True)], SCHEMA).repartition(3)


def test_write_and_open(spark, tmp_path):
    rows, path = table(spark, range(100, 120)), f"file://{tmp_path}/s"
    vector_store.write_store(rows.unionByName(spark.createDataFrame([(99, None)], SCHEMA)), path, 6, 3)
    store = vector_store.open_store(spark, path, dimension=6, ids=rows.select("item_id"), verify=True)
    assert (store.dimension, store.count, store.blocks.count()) == (6, 20, 7)
    assert {(r.item_id, r.row) for r in store.rows.collect()} == {(100 + i, i) for i in range(20)}
    v = {r.item_id: np.array(r.v) for r in store.vectors().collect()}
    for r in rows.collect():
        assert np.allclose(v[r.item_id], np.array(r.vector) / np.linalg.norm(r.vector)) and abs(np.linalg.norm(v[r.item_id]) - 1) < 1e-12


def test_row_index_and_lookup(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    vector_store.write_store(table(spark, [5, 7, 9]), path, block=2)
    store = vector_store.open_store(spark, path)
    ids = spark.createDataFrame([(5,), (7,), (9,), (6,), (-1,), (10**12,), (None,), (7,)], "x bigint")
    assert sorted((str(r.x), r.row) for r in store.row_index(ids, "x").collect()) == sorted([("5", 0), ("7", 1), ("9", 2), ("6", -1), ("-1", -1), (str(10**12), -1), ("None", -1), ("7", 1)])
    for r in store.lookup(ids, "x").collect():
        assert abs(np.linalg.norm(r.v) - (0 if r.row < 0 else 1)) < 1e-12 and len(r.v) == 6


def test_refusals(spark, tmp_path):
    path, rows = f"file://{tmp_path}/s", table(spark, [1, 2, 3])
    with pytest.raises(FileNotFoundError):
        vector_store.open_store(spark, path)
    vector_store.write_store(rows, path)
    with pytest.raises(ValueError, match="6 numbers, not 5"):
        vector_store.open_store(spark, path, dimension=5)
    for ids in ([1, 2], [1, 2, 4], [1, 2, 3, 3]):  # stale lists of ids
        with pytest.raises(ValueError, match="other ids"):
            vector_store.open_store(spark, path, ids=table(spark, ids).select("item_id"))
    table(spark, [1, 2, 4]).select("item_id", F.lit(0).cast("bigint").alias("row")).write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="map of ids"):
        vector_store.open_store(spark, path, verify=True)
    for bad, said in (
        (rows.where("false"), "no embeddings"), (spark.createDataFrame([(1, None)], SCHEMA), "no embeddings"), (rows.unionByName(table(spark, [9], 5)), "5 to 6"),
        (rows.unionByName(table(spark, [2], 6, 8)), "several vectors"), (spark.createDataFrame([(None, [1.0])], SCHEMA), "no id"),
    ):
        with pytest.raises(ValueError, match=said):
            vector_store.write_store(bad, f"file://{tmp_path}/bad")
    with pytest.raises(ValueError, match="wanted are 7"):
        vector_store.write_store(rows, f"file://{tmp_path}/bad", 7)


@pytest.mark.parametrize(("block", "group", "most"), [(3, 4, 0), (1, 100, 0), (7, 1, 0), (3, 4, 1 << 20)])
def test_search_equals_brute_force(spark, tmp_path, block, group, most):
    """Three rows a block and several partitions, in cells and by broadcast, over a table and over a store."""
    rows, asked, path = table(spark, range(40)), table(spark, range(100, 123), seed=1), f"file://{tmp_path}/s"
    units = vectors.unit_table(rows)
    q = vectors.unit_table(asked).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"), (F.col("item_id") % 6).cast("int").alias("want"))
    vector_store.write_store(rows, path, block=block)
    a, b = ({r.item_id: np.array(r.v) for r in t.collect()} for t in (vectors.unit_table(asked), units))
    want = set()
    for i, v in a.items():
        order = sorted((-np.floor(v @ w * 1e6 + 0.5) / 1e6, j) for j, w in b.items())
        want |= {(i, j, -s) for s, j in order[: i % 6]}
    for catalog in (units, vector_store.open_store(spark, path)):
        found = vectors.top_candidates(q, catalog, group, block, most)
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        lists = {}
        for r in found.collect():
            lists.setdefault(r.query_id, []).append((-r.score, r.item_id))
        assert {(i, j, -s) for i, x in lists.items() for s, j in sorted(x)[: i % 6]} == want
        assert max(map(len, lists.values())) <= 5 * (40 if most == 0 else 1)
    assert vectors.top_candidates(q, units.where("false"), group, block, most).count() == 0
    assert vectors.top_candidates(q.where("false"), units, group, block, most).count() == 0


def test_numbering(spark):
    rows = spark.createDataFrame([(i * 37 % 101, "x" if i % 3 else None, i % 5) for i in range(101)], "k int, s string, v int").repartition(5)
    out, n = numbering.numbered(rows, F.col("s"), F.desc("k"))
    order = sorted(rows.collect(), key=lambda r: (r.s is not None, r.s or "", -r.k))
    assert n == 101 and [(r.k, r.rn) for r in sorted(out.collect(), key=lambda r: r.rn)] == [(r.k, i + 1) for i, r in enumerate(order)]
    sums, total = numbering.running(rows, [F.col("k")], a=F.col("v"), b=F.col("v") * 0.5)
    at, seen = 0, {r.k: (r.a, r.b) for r in sums.collect()}
    for r in sorted(rows.collect(), key=lambda r: r.k):
        assert seen[r.k] == (at, at * 0.5)
        at += r.v
    assert total == {"a": at, "b": at * 0.5}
    none, n = numbering.numbered(rows.where("false"), F.col("k"))
    assert n == 0 and none.count() == 0
    assert "Window" in out._jdf.queryExecution().toString() and "SinglePartition" not in out._jdf.queryExecution().toString()


def test_search_in_blocks_holds_one_product_and_keeps_ties():
    """Blocks in any order against a plain sort, with many equal scores; what is held at a time does not grow with the blocks."""
    import tracemalloc

    rng = np.random.default_rng(3)
    catalog = rng.integers(-1, 2, size=(40_000, 4)).astype(float)
    queries, want = rng.integers(-1, 2, size=(600, 4)).astype(float), rng.integers(1, 90, size=600)
    best = vectors._Best(pa.array(np.arange(600)), queries, want)
    tracemalloc.start()
    for at in (24_576, 0, 32_768, 8192, 16_384):
        best.meet(np.arange(at, min(at + 8192, 40_000)), catalog[at : at + 8192])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = np.floor(queries @ catalog.T * 1e6 + 0.5) / 1e6
    got = best.rows().to_pydict()
    for q in range(600):
        order = np.lexsort((np.arange(40_000), -score[q]))[: want[q]]
        at = [i for i, x in enumerate(got["query_id"]) if x == q] if q % 50 == 0 else None
        if at is not None:
            assert [got["item_id"][i] for i in at] == order.tolist()
    assert len(got["query_id"]) == want.sum() and peak < 100 << 20, peak


def test_excluded_items_leave_in_the_search(spark):
    """Where the catalog is broadcast, lists leave the search whole and ranked: no join or window follows. By cells they are equal."""
    rng = np.random.default_rng(3)
    units = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)], "item_id long, v array<double>")
    queries = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(9)], "query_id long, q array<double>")
    gone = [(q, i) for q in range(8) for i in range(40) if (q * i) % 3 == 0 or q == 7] + [(2, 3), (2, 3), (3, 999), (8, None)]
    exclude = spark.createDataFrame(gone, "query_id long, item_id long")
    told = vectors.top_k(queries, units, 6, exclude)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftAnti" not in plan
    rows = lambda df: sorted(map(tuple, df.select("query_id", "item_id", "score", "rank").collect()))
    got, cells = rows(told), rows(vectors.top_k(queries, units, 6, exclude, broadcast_bytes=0))
    assert got == cells and {r[0] for r in got} == {1, 2, 4, 5, 8} and not {r[:2] for r in got} & set(gone)


def test_training_rows_search_once(spark, sf_dir):
    """The rows read what was found, and the samples, from tables: neither search nor sequences stand in their plan."""
    from marquee.plans.registry import QUERIES

    plan = QUERIES["rank_training_rows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "lag(" not in plan
