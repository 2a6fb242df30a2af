"""A vector store: the catalog's vectors as numbered rows in blocks, a map from ids to rows, and a manifest.

Rows are numbered by id. ``blocks`` holds them by the thousand, so a search reads whole blocks and a block is the largest
thing that a task holds. ``rows`` maps ids to rows and is dealt by ranges of the id, so files tell which ids they can
hold. The manifest has what a reader must agree with: dimension, count, block size, and digests of ids and vectors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..operators.vectors import CATALOG_BLOCK, unit_table
from ..tables import stored
from .files import write_json

VERSION = 1


@dataclass(frozen=True)
class VectorStore:
    """An opened store. blocks: (block, ids array, v array: the vectors end to end); rows: (item_id, row)."""

    dimension: int
    count: int
    block: int
    blocks: DataFrame
    rows: DataFrame
    digest: tuple[int, int]

    def row_index(self, ids: DataFrame, column: str = "item_id") -> DataFrame:
        """Adds ``row``: the id's row, -1 for ids that are not in the store (null too)."""
        known = self.rows.select(F.col("item_id").alias("_id"), "row")
        return ids.join(known, ids[column] == F.col("_id"), "left").withColumn("row", F.coalesce("row", F.lit(-1).cast("bigint"))).drop("_id")

    def vectors(self) -> DataFrame:
        """(item_id, row, v) of all rows."""
        each = self.blocks.select("block", "v", F.posexplode("ids").alias("at", "item_id"))
        v = F.slice("v", F.col("at") * self.dimension + 1, F.lit(self.dimension))
        return each.select("item_id", (F.col("block") * self.block + F.col("at")).alias("row"), v.alias("v"))

    def lookup(self, ids: DataFrame, column: str = "item_id") -> DataFrame:
        """Adds ``row`` and ``v``: the id's vector, zeros for ids that are not in the store."""
        zeros = F.array_repeat(F.lit(0.0), self.dimension)
        found = self.row_index(ids, column).join(self.vectors().select("row", "v"), "row", "left")
        return found.withColumn("v", F.coalesce("v", zeros))


def _digest(rows: DataFrame, *columns: str) -> int:
    """A digest of a table's rows whatever their order; 0 for no rows."""
    return rows.agg(F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0).cast("bigint"))).first()[0]


def ids_digest(ids: DataFrame) -> int:
    return _digest(ids, "item_id")


def write_store(embeddings: DataFrame, path: str, dimension: int | None = None, block: int = CATALOG_BLOCK) -> None:
    """Writes (item_id, vector), vectors made unit length, as a store. Null vectors are left out; no vectors at all,
    vectors of several lengths (or not of ``dimension``), and ids with several vectors are errors."""
    rows = embeddings.where(F.col("vector").isNotNull())
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count_if(F.col("item_id").isNull()).alias("nameless")).first()
    if not found.n:
        raise ValueError("there are no embeddings")
    if found.least != found.most or found.most != (dimension or found.most):
        raise ValueError(f"vectors have {found.least} to {found.most} numbers, wanted are {dimension or 'equal lengths'}")
    if found.nameless:
        raise ValueError("a vector has no id")
    units, count = numbered(unit_table(rows), F.col("item_id"))
    units = stored(units.select("item_id", (F.col("rn") - 1).alias("row"), "v"), "store-rows")
    if not units.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("an id has several vectors")
    grouped = units.groupBy(F.floor(F.col("row") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "item_id", "v"))).alias("r"))  # of at most ``block`` rows
    blocks = grouped.select("block", F.transform("r", lambda x: x["item_id"]).alias("ids"), F.flatten(F.transform("r", lambda x: x["v"])).alias("v"))
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    units.select("item_id", "row").repartitionByRange("item_id").sortWithinPartitions("item_id").write.mode("overwrite").parquet(f"{path}/rows")
    manifest = {
        "version": VERSION, "dimension": found.most, "count": count, "block": block,
        "ids": ids_digest(units), "vectors": _digest(units, "item_id", "row", "v"),
    }
    write_json(rows.sparkSession, manifest, f"{path}/manifest")  # last: a store without one is not whole


def open_store(spark: SparkSession, path: str, dimension: int | None = None, ids: DataFrame | None = None, verify: bool = False) -> VectorStore:
    """Opens a store and refuses one of another dimension, or whose ids are not those of ``ids`` (item_id). With
    ``verify`` its tables are read and compared with the manifest's counts and digests."""
    try:
        line = spark.read.text(f"{path}/manifest").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"there is no vector store in {path}") from e
    m = json.loads(line[0])
    if m["version"] != VERSION:
        raise ValueError(f"the store has version {m['version']}")
    if dimension is not None and m["dimension"] != dimension:
        raise ValueError(f"the store has vectors of {m['dimension']} numbers, not {dimension}")
    if ids is not None and (ids.count(), ids_digest(ids)) != (m["count"], m["ids"]):
        raise ValueError("the store was built for other ids")
    blocks, rows = (spark.read.parquet(f"{path}/{name}") for name in ("blocks", "rows"))
    store = VectorStore(m["dimension"], m["count"], m["block"], blocks, rows, (m["ids"], m["vectors"]))
    if verify:
        if rows.count() != m["count"] or ids_digest(rows) != m["ids"]:
            raise ValueError("the store's map of ids is not the one of its manifest")
        whole = store.vectors()
        if whole.count() != m["count"] or _digest(whole, "item_id", "row", "v") != m["vectors"]:
            raise ValueError("the store's vectors are not those of its manifest")
    return store
