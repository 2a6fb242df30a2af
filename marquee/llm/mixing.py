"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled (hashed) order, repeated up to MAX_EPOCHS times. A document copy
gets a virtual start and finish time, its source's words before and through it divided by the source's target, so all
queues are served at rates in proportion to their targets. A copy is eligible if it starts before virtual time 1, when
all targets are due, so that a source does not take the place of a long document of another. The mix is all eligible
copies in order of virtual finish time (a global range sort), truncated once, where the running sum of words reaches
the total budget. The copy in service there
is taken in part, so the mix has the budget's words exactly; each source's words differ from its target by less than
the longest documents in service at the end.

Targets: weights by source in code point order (null last), repeating; they share the budget (the words of all
documents); a source stops at MAX_EPOCHS times its words and the excess is shared again by weight until none is above.

Running sums over a source that may hold a third of all rows are taken in three levels: by hash prefix of the source,
by a longer prefix within, then by document, so no window holds more than a few thousand rows at 10^10 documents. The
running sum over the mix is taken by range partition: whole partitions before the cut are taken, those behind it are
not, and only the partition in which the budget ends is summed row by row. The only single-task steps are over one row
for each source and one for each range partition.

Defined results: null text has size 0; documents without words take 0. A null source is a source. Repeated and null
doc_ids are documents of their own (rows are told apart by a number given when sizes are written). An empty table
gives no rows. Reruns agree: the order comes from MD5 of doc_id and seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the order key that name a window of the first level, and of the second.
LEVEL_1, LEVEL_2 = 2, 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, counted on the UTF-8 bytes of the whole column at once."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(len(texts), np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    upto = np.searchsorted(np.flatnonzero(starts), offsets)  # word starts before each text
    return np.diff(upto)


def sized(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(row, doc_id, source, size), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # places of words take about as many bytes as the text
                part = batch.slice(at, 512)
                size = pa.array(word_counts(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), size], names=["doc_id", "source", "size"])

    rows = docs.select(
        docs[id_column].alias("doc_id"), docs[source_column].cast("string").alias("source"), docs[text_column].alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(releasing(run), f"doc_id {kind}, source string, size long")
    return saved(out.select(F.monotonically_increasing_id().alias("row"), "*"), "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): the shares of the budget, water-filled under each source's cap.

    In order of cap over weight, source i is capped if its cap is at most its share of what the sources before it
    leave; from the first that is not, all share the rest by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy(F.asc_nulls_last("source"))
    number = (F.row_number().over(one) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight.cast("double")).withColumn("cap", epochs * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("cap") > F.col("weight") * F.col("level"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    target = F.when(water.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * water))
    return ranked.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: str = SEED,
          id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it is made of.

    The mix: (row, doc_id, source, epoch, size, taken, virtual_start, virtual_finish, ...), which ``in_order`` sorts by
    virtual finish time. The documents: (row, doc_id, source, size, source_size, target).
    """
    sizes = sized(docs, id_column, source_column, text_column)
    shares = saved(targets(sizes, weights, epochs), "targets")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("row").cast("string"))))
    keyed = sizes.withColumn("key", order).select(
        "*", F.substring("key", 1, LEVEL_1).alias("k1"), F.substring("key", 1, LEVEL_2).alias("k2")
    )
    part = keyed.groupBy("source", "k1", "k2").agg(F.sum("size").alias("s"))
    w2 = Window.partitionBy("source", "k1").orderBy("k2").rowsBetween(Window.unboundedPreceding, -1)
    w1 = Window.partitionBy("source").orderBy("k1").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inner = part.select("source", "k1", "k2", F.coalesce(F.sum("s").over(w2), zero).alias("in_k1"))
    outer = part.groupBy("source", "k1").agg(F.sum("s").alias("s"))
    outer = outer.select("source", "k1", F.coalesce(F.sum("s").over(w1), zero).alias("before_k1"))
    outer = outer.select(F.col("source").alias("of"), F.col("k1").alias("o1"), "before_k1")
    before = inner.join(outer, inner["source"].eqNullSafe(outer["of"]) & (inner["k1"] == outer["o1"])).select(
        F.col("source").alias("of"), F.col("k2").alias("o2"), (F.col("in_k1") + F.col("before_k1")).alias("before")
    )
    w3 = Window.partitionBy("source", "k2").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    queued = keyed.withColumn("in_k2", F.coalesce(F.sum("size").over(w3), zero))
    queued = queued.join(before, queued["source"].eqNullSafe(before["of"]) & (queued["k2"] == before["o2"])).select(
        "row", "doc_id", "source", "size", "key", (F.col("in_k2") + F.col("before")).alias("words_before")
    )
    shares = shares.withColumnRenamed("source", "of")
    copies = queued.join(shares, queued["source"].eqNullSafe(shares["of"])).select(
        "row", "doc_id", "source", "size", "key", "source_size", "target", "words_before",
        F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"),
    )
    start = F.col("epoch") * F.col("source_size") + F.col("words_before")
    copies = copies.where(F.col("size") > 0).select(
        "row", "doc_id", "source", "epoch", "size", "key",
        F.try_divide(start, F.col("target")).alias("virtual_start"),
        F.try_divide(start + F.col("size"), F.col("target")).alias("virtual_finish"),
    )
    made_of = sizes.join(shares, sizes["source"].eqNullSafe(shares["of"])).select(
        "row", "doc_id", "source", "size", "source_size", "target"
    )
    budget = sizes.agg(F.sum("size")).first()[0] or 0
    return truncated(copies.where("virtual_start < 1"), budget), made_of


ORDER = ("virtual_finish", "source_last", "source", "key", "row", "epoch")


def truncated(copies: DataFrame, budget: int) -> DataFrame:
    """Copies in order of virtual finish time, with ``taken`` words, up to the budget."""
    parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = copies.withColumn("source_last", F.col("source").isNull()).repartitionByRange(parts, *ORDER)
    ranged = saved(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    sums = saved(sums.select("part", "words", upto.alias("upto")).withColumn("before", F.col("upto") - F.col("words")), "ranges")
    at = ranged.join(F.broadcast(sums.where(F.col("before") < budget)), "part")  # a row for each range partition
    whole = at.where(F.col("upto") <= budget).withColumn("taken", F.col("size"))
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1))
    left = F.lit(budget) - F.col("before") - F.coalesce(running, F.lit(0).cast("long"))
    cut = at.where(F.col("upto") > budget).withColumn("left", left).where("left > 0")
    cut = cut.withColumn("taken", F.least("size", "left"))
    columns = ["row", "doc_id", "source", "epoch", "size", "taken", "virtual_start", "virtual_finish", "source_last", "key"]
    return whole.select(*columns).unionByName(cut.select(*columns))


def in_order(mix: DataFrame) -> DataFrame:
    """The mix in its order: partition by partition, and by rows within."""
    parts = int(mix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mix.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken) for each document."""
    mix, made_of = mixed(docs, **options)
    taken = mix.groupBy("row").agg(F.sum("taken").alias("taken"))
    return made_of.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
