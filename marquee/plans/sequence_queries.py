"""Sequence queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import padded, padding_mask
from ..operators import sequences, training
from ..sources import testdata
from ..tables import shared_dir
from .model import Model, joined
from .registry import query

Q = ("inter", "emb", "seqs")


@query("SELECT user_id, item_id, pos, n FROM seqs", *Q)
def user_sequences(m: Model) -> DataFrame:
    return m.seqs


@query("SELECT n AS length, count(DISTINCT user_id) AS users FROM seqs GROUP BY n", *Q)
def sequence_lengths(m: Model) -> DataFrame:
    return m.seqs.where("pos = 1").groupBy(F.col("n").alias("length")).agg(F.count(F.lit(1)).alias("users"))


WINDOWS = """win AS (SELECT user_id, pos, array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), '|') AS history, item_id AS target
  FROM seqs QUALIFY pos > 1)"""


@query(f"+ {WINDOWS} SELECT * FROM win", *Q)
def training_windows(m: Model) -> DataFrame:
    return sequences.training_windows(m.seqs).withColumn("history", joined("history"))


@query("""SELECT user_id, array_to_string(list(item_id ORDER BY pos) FILTER (pos < n AND pos >= n - 50), '|') AS history, max(item_id) FILTER (pos = n) AS target
FROM seqs GROUP BY user_id""", *Q)
def eval_holdout(m: Model) -> DataFrame:
    return m.samples.withColumn("history", joined("history"))


@query("""SELECT user_id, array_to_string(list(item_id ORDER BY pos) FILTER (pos < n - 2 AND pos >= n - 4), '|') AS history, max(item_id) FILTER (pos = n) AS target
FROM seqs WHERE n >= 4 GROUP BY user_id""", *Q)
def eval_holdout_three(m: Model) -> DataFrame:
    return sequences.holdout(m.seqs, length=2, held=3).withColumn("history", joined("history"))


@query("""+ h AS (SELECT user_id, list(item_id ORDER BY pos) AS items FROM seqs WHERE pos > n - 50 GROUP BY user_id)
SELECT user_id, array_to_string(list_concat(items, list_transform(range(50 - len(items)), lambda x: 0)), '|') AS ids,
  array_to_string(list_transform(range(1, 51), lambda i: CASE WHEN i <= len(items) THEN 1 ELSE 0 END), '|') AS mask FROM h""", *Q)
def padded_batches(m: Model) -> DataFrame:
    rows = sequences.last(m.seqs).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("h"))
    rows = rows.select("user_id", F.transform("h", lambda x: x["item_id"]).alias("items"))
    mask = F.transform(padding_mask(F.col("items"), 50), lambda b: b.cast("int"))
    return rows.select("user_id", joined(padded(F.col("items"), 50)).alias("ids"), joined(mask).alias("mask"))


SHUFFLED = "u AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '|42'), user_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM seqs))"


@query(f"+ {SHUFFLED} SELECT user_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM u", *Q)
def user_split(m: Model) -> DataFrame:
    return sequences.split(m.seqs)


@query(f"+ {SHUFFLED} SELECT user_id FROM u WHERE rn <= 40", *Q)
def user_subsample(m: Model) -> DataFrame:
    return sequences.subsample(m.seqs, 40)


@query("""+ u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM seqs))
SELECT user_id, CAST(floor((rn - 1) / ceil(n / 7)) AS BIGINT) AS shard FROM u""", *Q)
def user_shards(m: Model) -> DataFrame:
    return sequences.shards(m.seqs, 7)


@query(f"""+ {WINDOWS} SELECT user_id, pos, history, target FROM win
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '|' || pos || '|42'), pos) <= 4""", *Q)
def sampled_windows(m: Model) -> DataFrame:
    return sequences.sampled_windows(m.seqs, 4).withColumn("history", joined("history"))


@query("""+ k AS (SELECT user_id, item_id, ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity,
  lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, item_id, l_suppkey, l_extendedprice, l_quantity) AS before FROM bulk WHERE rating >= 3.5
), s AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, item_id, l_suppkey, l_extendedprice, l_quantity) AS pos,
  count(*) OVER (PARTITION BY user_id) AS n FROM k WHERE before IS NULL OR before <> item_id)
SELECT user_id, item_id, pos, n FROM s WHERE n >= 3""", "bulk")
def bulk_sequences(m: Model) -> DataFrame:
    rows = m.bulk.withColumn("type", F.lit("rating"))
    return sequences.sequences(rows, order=testdata.BULK_ORDER).select("user_id", "item_id", "pos", "n")


@query("SELECT item_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM bulk GROUP BY item_id", "bulk")
def bulk_popularity(m: Model) -> DataFrame:
    from ..operators.recommend import popularity

    return popularity(m.bulk).select("item_id", "n", "rank")


@query("""SELECT user_id, item_id, n, rank FROM (SELECT user_id, item_id, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, item_id) AS rank
  FROM bulk GROUP BY user_id, item_id) WHERE rank <= 5""", "bulk")
def bulk_topk_per_user(m: Model) -> DataFrame:
    from ..operators.recommend import ranked

    counts = m.bulk.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, 5, F.desc("n"), F.col("item_id"))


@query("""+ u AS (SELECT user_id FROM seqs WHERE pos = 1 ORDER BY md5(user_id || '|42'), user_id LIMIT 25)
SELECT user_id, item_id, pos, n FROM seqs SEMI JOIN u USING (user_id)""", *Q)
def sequences_until(m: Model) -> DataFrame:
    """Sequences of the first 25 users that qualify, of a table dealt by ranges of users, read only as far as needed."""
    path = f"{shared_dir(m.spark).rstrip('/')}/marquee-by-user-{uuid.uuid4().hex}"
    ranged = sequences.with_user_range(m.interactions, 1)
    ranged.repartition("user_range").write.partitionBy("user_range").parquet(path)
    return sequences.first_qualifying(m.spark.read.parquet(path), 25, m.embeddings, digits=1)[0]


@query("""+ w AS (SELECT user_id, pos, list(item_id) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS history, item_id AS target FROM seqs
), b AS (SELECT *, row_number() OVER (ORDER BY md5(user_id || '|' || pos || '|20342'), user_id, pos) - 1 AS k FROM w WHERE pos > 1)
SELECT k // 64 AS batch, CAST(k % 64 AS INTEGER) AS place, user_id, pos, target, array_to_string(history, '|') || repeat('|0', 50 - len(history)) AS items, len(history) AS length FROM b""", *Q)
def training_batches(m: Model) -> DataFrame:
    """Batches of 64 windows in the order of the third epoch's fourth shard, histories padded."""
    rows = training.training_batches(sequences.training_windows(m.seqs), 64, epoch=2, shard=3)
    length = F.size(F.filter("mask", lambda x: x)).cast("bigint")
    return rows.select("batch", "place", "user_id", "pos", "target", joined("items").alias("items"), length.alias("length"))
