"""SimHash near-duplicates over a Gray-order hierarchical index.

1. A fingerprint for each text, in one pass (xxhash over word shingles, bit counts in numpy).
2. Texts collapse to distinct fingerprints, so copies cost nothing further.
3. Two 64-bit fingerprints at a distance of at most 3 agree on one of four 16-bit quarters, and on the 48 other bits
   they again agree on one of four parts. Each fingerprint is dealt to its 16 pairs (quarter, part): groups that share
   28 bits. A group that is still large is dealt again by a quarter of its free bits, as often as needed, which is
   exact for the same reason. So no group grows without bound and no link is lost.
4. Within a group, fingerprints stand in Gray order, where neighbours share long masked patterns. Runs of neighbours
   are factored into nodes (a mask of agreed bits and their pattern), nodes into upper nodes. A query's differences
   from an upper node's pattern bound those from all below it, so whole groups are pruned. Matches only join sets
   (a union-find in the task); one edge to each set's smallest member leaves the task, never all pairs.
5. Components over these edges by alternating large and small stars, as DataFrame jobs.

Defined results: a null or empty text has no words and fingerprint 0, linked like any other. Repeated doc_ids give
one row per input row, each with its own text's fingerprint. Null doc_ids give rows too but never name a component
unless the whole component has none (then component_id is null). An empty table gives no rows. Only the two named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

BITS = 64
#: Groups with more fingerprints than this are dealt again by more bits.
GROUP_LIMIT = 4096
#: Children of an index node.
FANOUT = 8
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if it is set in over half of their XXH64."""
    return fingerprint_of((text or "").encode("utf-8", "surrogatepass"), shingle, seed)


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """``fingerprint`` of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    pair = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return pair.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the index


class GrayIndex:
    """Distinct fingerprints in Gray order under levels of (mask of agreed bits, pattern) nodes."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        both, any_ = [prints], [prints]  # bits set in all, and in some, of what lies below a node
        while len(both[-1]) > FANOUT:
            heads = np.arange(0, len(both[-1]), FANOUT)
            both.append(np.bitwise_and.reduceat(both[-1], heads))
            any_.append(np.bitwise_or.reduceat(any_[-1], heads))
        self.levels = [(a | (b ^ _FULL), a) for a, b in zip(both, any_, strict=True)]

    def matches(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in queries, in prints) of all pairs at a distance of at most ``most``."""
        mask, pattern = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[level]
            keep = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]) <= most
            q, node = q[keep], node[keep]
            if level:
                below = len(self.levels[level - 1][0])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                inside = node < below
                q, node = q[inside], node[inside]
        return q, node


def join_sets(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; label[x] is the smallest member of x's set when it returns."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(step := label[label], label):
            label[:] = step


def group_links(prints: np.ndarray, most: int) -> np.ndarray:
    """For fingerprints in Gray order, the position of the smallest member of each one's set."""
    label = np.arange(len(prints))
    if len(prints) == 2:
        label[1] = 0 if int(prints[0] ^ prints[1]).bit_count() <= most else 1
        return label
    index = GrayIndex(prints)
    step = max(1, min(512, (1 << 21) // len(prints)))
    for at in range(0, len(prints), step):
        q, found = index.matches(prints[at : at + step], most)
        join_sets(label, q + at, found)
    return label


def gray_rank(fp: Column) -> Column:
    """The position of a code word in the binary-reflected Gray order (prefix XOR of its bits)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


# ---------------------------------------------------------------- groups


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(free: list[int]) -> list[list[int]]:
    """Free bit positions in four parts of nearly equal size."""
    return [free[len(free) * i // 4 : len(free) * (i + 1) // 4] for i in range(4)]


def _masks(fixed: int) -> list[int]:
    """The masks that fix one more quarter of the bits that ``fixed`` leaves free."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    return [fixed | sum(1 << i for i in part) for part in _parts(free) if part]


def start_masks() -> list[int]:
    return sorted({m for first in _masks(0) for m in _masks(first)})


def _dealt(prints: DataFrame, masks: list[int]) -> DataFrame:
    keyed = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    return keyed.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def _edges_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, part, fp) with the groups together and in Gray order -> edges (fp, smaller fp)."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        bounds = np.r_[0, cut, len(rows)]
        prints = rows[:, 2].view(np.uint64) if rows.flags.c_contiguous is False else rows[:, 2].copy().view(np.uint64)
        a, b = [], []
        sizes = np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]  # most groups are pairs
        near = np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= most
        a.append(prints[pairs + 1][near])
        b.append(prints[pairs][near])
        for at, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            own = prints[at : at + n]
            label = group_links(own, most)
            moved = label != np.arange(n)
            a.append(own[moved])
            b.append(own[label[moved]])
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        if len(x):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"]
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        held.append(rows)
        rows = np.concatenate(held)
        last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from flush(rows[:cut])
        held = [rows[cut:]]  # the group that may go on: GROUP_LIMIT rows at most
    if held and len(held[0]):
        yield from flush(held[0])


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect the same sets as all pairs at a distance <= most."""
    if most > 3:
        raise ValueError("four parts guarantee a shared one up to 3 differing bits")
    keyed, out = _dealt(prints, start_masks()), None
    while True:
        counted = keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        counted = saved(counted, "groups")
        small = keyed.join(counted.where(F.col("n") <= GROUP_LIMIT).select("mask", "part"), ["mask", "part"])
        found = (
            small.select("mask", "part", "fp")
            .repartition("mask", "part")
            .sortWithinPartitions("mask", "part", gray_rank(F.col("fp")), "fp")
            .mapInArrow(lambda batches: _edges_of(batches, most), "a long, b long")
        )
        out = found if out is None else out.unionByName(found)
        large = counted.where(F.col("n") > GROUP_LIMIT)
        masks = [r[0] for r in large.select("mask").distinct().collect()]  # a few tens of masks at each level
        if not masks:
            return out.distinct()
        keyed = keyed.join(large.select("mask", "part"), ["mask", "part"], "left_semi").select("fp", "mask")
        finer = F.create_map(*[
            x for m in masks for x in (F.lit(m), F.array(*[F.lit(_signed(f)) for f in _masks(m % (1 << 64))]))
        ])
        keyed = keyed.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        keyed = saved(keyed.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))), "finer")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): the smallest node reachable.

    Alternating large and small stars; each round is two grouped minima and two joins, written to the shared folder.
    The minima are tables of their own, so Spark can split the joins where a node has very many neighbours.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = saved(edges, "edges")
    for _ in range(rounds):
        # large star: each node's larger neighbours move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct(), "large")
        # small star: each node's smaller neighbours, and the node, move to the smallest of them
        lowest = saved(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        after = saved(small.where("u <> v").distinct(), "stars")
        dropped(least, large, lowest)
        if _same(edges, after):
            dropped(after)
            break
        dropped(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _same(a: DataFrame, b: DataFrame) -> bool:
    def digest(df: DataFrame) -> tuple:
        sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        return tuple(df.agg(F.count(F.lit(1)), sums).first())

    return digest(a) == digest(b)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, most: int = 3
) -> DataFrame:
    """(doc_id, fp, component_id): texts whose fingerprints link, directly or through others, share a component,
    named by its smallest doc_id."""
    each = saved(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    prints = each.groupBy("fp").agg(F.min("doc_id").alias("first"))
    prints = saved(prints, "distinct")
    found = components(links(prints.select("fp"), most))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    # written, so the join has exchanges of its own, which Spark splits where one component is very large
    smallest = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- similar documents


def similar(inside, n, other):
    """Whether sets of n and other shingles, of which ``inside`` are common to both, have a Jaccard similarity >= 0.8."""
    return 9 * inside >= 4 * (n + other)


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, component_id): texts whose shingle sets have a Jaccard similarity of 0.8 or more, directly or through
    others, share a component; texts without words are similar to each other.

    ``links`` of fingerprints come first, each confirmed by whole shingle sets; similar texts that no such link connects
    are found by comparing those sets, exactly: see ``jaccard``.
    """
    from .jaccard import jaccard_components  # which builds on this module

    found = jaccard_components(docs, id_column, text_column, shingle, by_print=True)
    none = found.where("n_shingles = 0").agg(F.min("doc_id").alias("none"))  # one row
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("none"))
    return found.join(F.broadcast(none)).select("doc_id", component.alias("component_id"))
