"""Per-user event sequences: filtering, consecutive de-duplication, windows, splits.

The canonical form is exploded: (user_id, pos, item_id). One window over (user_id) serves each step, so the exchange
by user is made once and reused; users are many and their histories short, so no user's window is large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_SEQ_LEN, MIN_INTERACTIONS, MIN_RATING, SPLIT_SEED, TRAIN_RATIO, VAL_RATIO
from ..tables import stored
from .numbering import numbered

ORDER = ("ts", "interaction_id")


def rated_enough(rows: DataFrame, min_rating: float | None = MIN_RATING) -> DataFrame:
    """Only rows of type rating are tested; a missing rating fails."""
    if min_rating is None:
        return rows
    return rows.where((F.col("type") != "rating") | (F.coalesce(F.col("rating"), F.lit(float("-inf"))) >= min_rating))


def deduped(rows: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Without rows whose item is that of the user's row before."""
    before = F.lag("item_id").over(Window.partitionBy("user_id").orderBy(*order))
    return rows.withColumn("before", before).where("before is null or before <> item_id").drop("before")


def sequences(
    interactions: DataFrame, embedded: DataFrame | None = None, min_rating: float | None = MIN_RATING,
    min_length: int = MIN_INTERACTIONS, order: tuple[str, ...] = ORDER,
) -> DataFrame:
    """(user_id, pos, item_id, n): histories in order, of users with at least ``min_length`` left.

    Unembedded items go before de-duplication, so their neighbours may become equal neighbours and merge.
    """
    rows = interactions
    if embedded is not None:
        rows = rows.join(embedded.select("item_id"), "item_id", "left_semi")
    rows = deduped(rated_enough(rows, min_rating), order)
    w = Window.partitionBy("user_id")
    return rows.select(
        "user_id", F.row_number().over(w.orderBy(*order)).cast("bigint").alias("pos"), "item_id",
        F.count(F.lit(1)).over(w).alias("n"),
    ).where(F.col("n") >= min_length)


def last(seqs: DataFrame, n: int = MAX_SEQ_LEN) -> DataFrame:
    return seqs.where(F.col("pos") > F.col("n") - n)


def training_windows(seqs: DataFrame, length: int = MAX_SEQ_LEN, min_history: int = 1) -> DataFrame:
    """(user_id, pos, history, target): each position with at least ``min_history`` before it is a target."""
    w = Window.partitionBy("user_id").orderBy("pos")
    history = F.collect_list("item_id").over(w.rowsBetween(-length, -1))
    out = seqs.select("user_id", "pos", history.alias("history"), F.col("item_id").alias("target"))
    return out.where(F.col("pos") > min_history)


def holdout(seqs: DataFrame, length: int = MAX_SEQ_LEN, held: int = 1) -> DataFrame:
    """(user_id, history, target): the last item is the target, the history ends ``held`` items before the end."""
    from_end = F.col("n") - F.col("pos") + 1
    rows = seqs.where(F.col("n") >= held + 1).withColumn("rn", from_end)
    history = F.array_sort(F.collect_list(F.when((F.col("rn") > held) & (F.col("rn") <= held + length), F.struct("pos", "item_id"))))
    return rows.groupBy("user_id").agg(
        F.transform(history, lambda x: x["item_id"]).alias("history"), F.max(F.when(F.col("rn") == 1, F.col("item_id"))).alias("target")
    )


def shuffled(key: Column, seed: int = SPLIT_SEED) -> Column:
    """A reproducible random order of keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def ranked_users(users: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds rn (1..n in shuffled order) and n, by ranges of the order."""
    ranked, n = numbered(users.select("user_id").distinct(), shuffled(F.col("user_id"), seed), F.col("user_id"))
    return ranked.withColumn("n", F.lit(n).cast("bigint"))


def split(users: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """(user_id, split): exact shares of users in train, val and test."""
    r = ranked_users(users, seed)
    train, val = F.floor(F.col("n") * TRAIN_RATIO), F.floor(F.col("n") * VAL_RATIO)
    name = F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + val, "val").otherwise("test")
    return r.select("user_id", name.alias("split"))


def subsample(users: DataFrame, most: int, seed: int = SPLIT_SEED) -> DataFrame:
    """``most`` users in shuffled order (a top-k, not a full sort); all if most < 1."""
    users = users.select("user_id").distinct()
    return users if most < 1 else users.orderBy(shuffled(F.col("user_id"), seed), "user_id").limit(most)


def with_user_range(rows: DataFrame, digits: int = 2, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``user_range`` (0 to 16^digits - 1), the first digits of the users' shuffled order, to partition a table by."""
    return rows.withColumn("user_range", F.conv(F.substring(shuffled(F.col("user_id"), seed), 1, digits), 16, 10).cast("int"))


def first_qualifying(
    ranged: DataFrame, most: int, embedded: DataFrame | None = None, min_rating: float | None = MIN_RATING, min_length: int = MIN_INTERACTIONS,
    seed: int = SPLIT_SEED, digits: int = 2, first: int = 1,
) -> tuple[DataFrame, int]:
    """Sequences of the first ``most`` users, in shuffled order, whose sequences are long enough, and how many ranges of
    users were read for it. All such users where they are fewer.

    ``ranged`` (see ``with_user_range``, same seed and digits) is read range by range, in batches that double, and no
    further than needed: on a table partitioned by user_range the other files are not opened. As ranges follow the
    shuffled order, the users are those that the whole table would give.
    """
    if most < 1:
        raise ValueError("at least one user must be wanted")
    low, width, found, n = 0, first, None, 0
    while low < 16**digits and (n < most or found is None):
        part = ranged.where(F.col("user_range").between(low, low + width - 1)).drop("user_range")
        part = stored(sequences(part, embedded, min_rating, min_length), "qualifying")
        n += part.where("pos = 1").count()
        found = part if found is None else found.unionByName(part)
        low, width = low + width, 2 * width
    users = found.where("pos = 1").select("user_id").orderBy(shuffled(F.col("user_id"), seed), "user_id").limit(most)
    return found.join(users, "user_id", "left_semi"), min(low, 16**digits)


def shards(users: DataFrame, count: int) -> DataFrame:
    """(user_id, shard): contiguous runs of ceil(n / count) users in id order."""
    ranked, n = numbered(users.select("user_id").distinct(), F.col("user_id"))
    return ranked.select("user_id", F.floor((F.col("rn") - 1) / max(1, math.ceil(n / count))).cast("bigint").alias("shard"))


def sampled_windows(seqs: DataFrame, per_user: int, seed: int = SPLIT_SEED, length: int = MAX_SEQ_LEN) -> DataFrame:
    """At most ``per_user`` training windows of each user, drawn without replacement."""
    windows = training_windows(seqs, length)
    draw = F.md5(F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("pos").cast("string"), F.lit(f"|{seed}")))
    w = Window.partitionBy("user_id").orderBy(draw, "pos")
    return windows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= per_user).drop("draw")


def epoch_seed(base: int, epoch: int, shard: int) -> int:
    return base + epoch * 10_000 + shard * 100


def epochs_of_batch(epochs: int, batches: int, batch: int) -> int:
    """How many of ``epochs`` a batch of users gets when batches share them."""
    return max(1, epochs // batches) + (batch < epochs % batches if epochs >= batches else 0)


def shard_size(n: int, count: int) -> int:
    return math.ceil(n / count)
