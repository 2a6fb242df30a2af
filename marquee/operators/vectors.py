"""Dense vectors: similarity search by blocks, negatives, losses.

Search takes the catalog in blocks of at most CATALOG_BLOCK rows, from a vector store or cut once from a table. A catalog
of at most BROADCAST_BYTES, by its count and dimension, is broadcast: queries are read once where they are and nothing
is shuffled. A larger one is dealt to cells of a grid, groups of at most about QUERY_GROUP queries by parts of the
catalog: each block is read from its table and sent to one cell for each group. In both, a worker multiplies its queries
with one block after another and keeps only each query's best so far, so what leaves it is one list for each query (and
part), whatever the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot, norm, normalized, quantized
from ..schema import TEMPERATURE
from ..tables import stored

#: Queries in one product, vectors in a block of the catalog, and queries that a task holds.
QUERY_BLOCK, CATALOG_BLOCK, QUERY_GROUP = 256, 8192, 4096
#: Catalogs of more bytes are not broadcast.
BROADCAST_BYTES = 64 << 20


def unit_table(embeddings: DataFrame, dimension: int | None = None) -> DataFrame:
    """(item_id, v): vectors of length 1; a vector of another dimension is an error."""
    rows = embeddings.where(F.col("vector").isNotNull())
    if dimension:
        fits = F.assert_true(F.size("vector") == dimension, F.lit(f"a vector has not {dimension} numbers"))
        rows = rows.withColumn("vector", F.when(fits.isNull(), F.col("vector")))
    return rows.select("item_id", normalized(F.col("vector")).alias("v"))


def loaded(embeddings: DataFrame, dimension: int) -> DataFrame:
    """``unit_table`` of a table that must hold vectors: none at all is an error, as is one of another dimension."""
    if embeddings.where(F.col("vector").isNotNull()).isEmpty():
        raise ValueError("there are no embeddings")
    return unit_table(embeddings, dimension)


def fused(text, image=None):
    """The sum of two vectors, of length 1 if it is not 0."""
    if image is None:
        return normalized(text)
    total = F.zip_with(text, image, lambda a, b: a.cast("double") + b.cast("double"))
    return F.when(norm(total) > 0, normalized(total)).otherwise(total)


def summed(vectors: Column) -> Column:
    """The sum of an array of vectors of one length."""
    zero = F.array_repeat(F.lit(0.0), F.size(vectors[0]))
    return F.aggregate(vectors, zero, lambda total, v: F.zip_with(total, v, lambda a, b: a + b))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of arrays, each of at most ``size`` rows as they stream by: nothing is shuffled or counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == size:
                    yield block(held, n)
                    held, n = [], 0
        if held:
            yield block(held, n)

    def block(held: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
        bounds = pa.array([0, n], pa.int32())
        whole = pa.Table.from_batches(held)
        arrays = [pa.ListArray.from_arrays(bounds, pa.concat_arrays(column.chunks)) for column in whole.columns]
        return pa.RecordBatch.from_arrays(arrays, names=whole.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema))


def _best(score: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's ``want`` highest scores; of equal ones, the first."""
    rows, columns = [], []
    for r, n in enumerate(np.minimum(want, score.shape[1]).tolist()):
        line = score[r]
        best = np.arange(len(line))
        if n < len(line):
            least = np.partition(line, len(line) - n)[len(line) - n]
            above = np.flatnonzero(line > least)
            best = np.r_[above, np.flatnonzero(line == least)[: n - len(above)]]
        rows.append(np.full(len(best), r))
        columns.append(best)
    return np.concatenate(rows), np.concatenate(columns)


class _Best:
    """The best items so far of some queries: a running top-k over blocks of the catalog."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, want: np.ndarray, without: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.vectors, self.want = ids, vectors, want
        self.without = without  # places of queries, ascending, and items that each must not get
        self.row, self.item, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(want), -np.inf)  # of the scores of queries that have all they want

    def meet(self, items: np.ndarray, block: np.ndarray) -> None:
        """One block of the catalog, its items ascending."""
        parts = [(self.row, self.item, self.score)]
        for at in range(0, len(self.vectors), QUERY_BLOCK):
            score = self.vectors[at : at + QUERY_BLOCK] @ block.T
            score *= 1e6  # in place: one product is all that is held
            score += 0.5
            np.floor(score, out=score)
            score /= 1e6
            want = self.want[at : at + QUERY_BLOCK]
            near = score >= self.least[at : at + QUERY_BLOCK, None]  # an equal one may have a smaller item
            if self.without is not None:
                rows, columns = self._left_out(at, items)
                near[rows, columns] = False
                score[rows, columns] = -np.inf
            many = near.sum(1) > want
            picked = _best(score[many], want[many]) if many.any() else None
            near[many] = False
            rows, columns = np.nonzero(near)
            parts.append((rows + at, items[columns], score[rows, columns]))
            if picked:
                rows, columns = np.flatnonzero(many)[picked[0]], picked[1]
                parts.append((rows + at, items[columns], score[rows, columns]))
        self.row, self.item, self.score = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((self.item, -self.score, self.row))
        row = self.row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < self.want[row]]
        self.row, self.item, self.score = self.row[order], self.item[order], self.score[order]
        have = np.bincount(self.row, minlength=len(self.want))
        full = have >= self.want
        self.least[full] = self.score[np.cumsum(have)[full] - 1]

    def _left_out(self, at: int, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (row, column) in the product of the queries from ``at`` on with ``items`` of what they must not get."""
        a, b = np.searchsorted(self.without[0], [at, at + QUERY_BLOCK])
        row, item = self.without[0][a:b] - at, self.without[1][a:b]
        first, n = np.searchsorted(items, item), np.searchsorted(items, item, "right")
        n -= first  # an item may have several vectors
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(row, n), np.repeat(first, n) + within

    def places(self) -> np.ndarray:
        """The rank of each row, from 1: they come query by query, best first."""
        return np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.row)), pa.array(self.item), pa.array(self.score)], names=["query_id", "item_id", "score"])


def catalog_blocks(catalog, size: int = CATALOG_BLOCK) -> DataFrame:
    """(ids, v) of a vector store, or of a table (item_id, v), which is then written in blocks; vectors end to end."""
    if not isinstance(catalog, DataFrame):
        return catalog.blocks.select("ids", "v")
    cut = _blocks(catalog.select("item_id", "v"), size)
    return stored(cut.select(F.col("item_id").alias("ids"), F.flatten("v").alias("v")), "catalog")


def _matrix(ids: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def _by_broadcast(queries: DataFrame, blocks: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(query_id, item_id, score, rank): whole lists, as a worker meets the whole catalog; without the items of a column
    ``without`` of the queries, if there is one."""
    told = queries.sparkSession.sparkContext.broadcast(blocks)  # of at most BROADCAST_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_GROUP):
                part, without = batch.slice(at, QUERY_GROUP), None
                if part.num_columns > 3:
                    n = pa.compute.fill_null(pa.compute.list_value_length(part.column(3)), 0).to_numpy(zero_copy_only=False)
                    without = np.repeat(np.arange(part.num_rows), n), part.column(3).flatten().to_numpy(zero_copy_only=False)
                best = _Best(part.column(0), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1), part.column(2).to_numpy(), without)
                for items, block in told.value:
                    best.meet(items, block)
                rows = best.rows()
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best.places())], names=[*rows.schema.names, "rank"])

    columns = ["query_id", "q", "want", *(c for c in queries.columns if c == "without")]
    return queries.select(*columns).mapInArrow(run, "query_id long, item_id long, score double, rank long")


def _by_cells(queries: DataFrame, blocks: DataFrame, query_group: int) -> DataFrame:
    spark = queries.sparkSession
    queries = stored(queries.select("query_id", "q", "want"), "queries")
    groups = max(1, -(-queries.count() // query_group))
    parts = max(1, min(blocks.count(), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)))
    none = lambda kind: F.lit(None).cast(kind)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("g"), every(parts).alias("p"), F.lit(0).alias("side"), "query_id", "q", "want", none("array<bigint>").alias("ids"), none("array<double>").alias("v"))
    own = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(parts)).cast("int")
    right = blocks.select(every(groups).alias("g"), own.alias("p"), F.lit(1).alias("side"), none("bigint").alias("query_id"), none("array<double>").alias("q"), none("int").alias("want"), "ids", "v")
    cells = left.unionByName(right).repartition("g", "p").sortWithinPartitions("g", "p", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if key != cell:
                    if best is not None:
                        yield best.rows()
                    cell, held, best = key, [], None
                if batch.column(2)[i].as_py() == 0:  # queries come before blocks
                    held.append((batch.column(3)[i].as_py(), batch.column(4)[i].values.to_numpy(), batch.column(5)[i].as_py()))
                elif held:
                    if best is None:
                        ids, q, want = zip(*held, strict=True)
                        best = _Best(pa.array(ids, pa.int64()), np.stack(q), np.array(want))
                    best.meet(*_matrix(batch.column(6)[i].values.to_numpy(), batch.column(7)[i].values.to_numpy()))
        if best is not None:
            yield best.rows()

    return cells.mapInArrow(run, "query_id long, item_id long, score double")


def _told(catalog, broadcast_bytes: int, catalog_block: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """The blocks of a catalog that may be broadcast, or None."""
    if isinstance(catalog, DataFrame):
        size = catalog.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
        n, d = size.n, size.d or 0
    else:
        n, d = catalog.count, catalog.dimension
    if 8 * n * (d + 1) > broadcast_bytes:
        return None
    if isinstance(catalog, DataFrame):
        table = catalog.select("item_id", "v").toArrow()
        ids, flat = table.column(0).to_numpy(), table.column(1).combine_chunks().flatten().to_numpy()
        whole = [_matrix(ids, flat)] if n else []
    else:
        whole = [_matrix(np.array(r.ids), np.array(r.v)) for r in catalog.blocks.select("ids", "v").collect()]
    return [(i[at : at + catalog_block], v[at : at + catalog_block]) for i, v in whole for at in range(0, len(i), catalog_block)]


def top_candidates(
    queries: DataFrame, catalog, query_group: int = QUERY_GROUP, catalog_block: int = CATALOG_BLOCK, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(query_id, item_id, score) for each query (query_id, q, want): its best ``want`` items, once for each part of the
    catalog, which is a table (item_id, v) or a vector store."""
    queries, blocks = queries.select("query_id", "q", "want").where("want > 0"), _told(catalog, broadcast_bytes, catalog_block)
    if blocks is None:
        return _by_cells(queries, catalog_blocks(catalog, catalog_block), query_group)
    return _by_broadcast(queries, blocks).drop("rank")


def top_k(queries: DataFrame, catalog, k: int, exclude: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, item_id, score, rank): each query's k best items by quantized cosine, ties by item; an id is one query's.
    The catalog is a table (item_id, v) or a vector store.

    ``exclude`` (query_id, item_id) is left out. Where the catalog is broadcast, a query takes its excluded items along and
    its list leaves the worker ranked: nothing is joined or sorted after the search. Else a query asks for that many more
    and an anti join takes them out. Both are exact. With fewer items than k the list is shorter.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    q = queries.select("query_id", normalized(F.col("q")).alias("q"))
    blocks = _told(catalog, broadcast_bytes, CATALOG_BLOCK)
    if exclude is not None:
        own = exclude.where("item_id is not null").groupBy("query_id").agg(F.collect_set("item_id").alias("without"))
        q = q.join(own, "query_id", "left")
    if blocks is not None:
        return _by_broadcast(q.withColumn("want", F.lit(k)), blocks)
    if exclude is not None:
        q = q.withColumn("want", F.coalesce(F.array_size("without"), F.lit(0)) + k).drop("without")
    else:
        q = q.withColumn("want", F.lit(k))
    found = _by_cells(q, catalog_blocks(catalog), QUERY_GROUP)
    if exclude is not None:
        found = found.join(exclude.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def hard_negatives(queries: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Each query's k best items but its target (queries: query_id, q, target)."""
    return top_k(queries, catalog, k, queries.select("query_id", F.col("target").alias("item_id")))


def self_check(catalog: DataFrame, sample: int = 5) -> DataFrame:
    """(checked, mismatches): of the first items by id, how many are not their own nearest neighbour."""
    first = catalog.orderBy("item_id").limit(sample).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    return top_k(first, catalog, 1).agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("query_id") != F.col("item_id")).alias("mismatches")
    )


def infonce(samples: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(query_id, loss) of samples (query_id, p, pos, negatives array of vectors): cross entropy of the positive."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    pos = dot(F.col("p"), F.col("pos")) / temperature
    negs = F.transform("negatives", lambda v: dot(F.col("p"), v) / temperature)
    total = F.aggregate(F.transform(negs, F.exp), F.exp(pos), lambda s, x: s + x)
    return samples.select("query_id", quantized(F.log(total) - pos).alias("loss"))
