"""Documents whose sets of word shingles are similar: size-banded tiles with bitmap signatures, then exact intersection.

1. One pass over the texts gives each set's size, a 128-bit digest and a bitmap that its hashed shingles set. Sets of one
   digest are one set from here on. The pass also counts shingles that are frequent within some stretch of its task.
2. All sets are put in one order of shingles: by hash, frequent ones last. Two sets with a similarity of 0.8 or more
   share one of their first n - ceil(0.8 n) + 1 shingles in it, whatever the order: a tile is the sets that share one.
   Tiles of the same members, as near copies make by the hundred, are one tile.
3. In a tile, sets are compared in bands of sizes, in numpy: bits set in one bitmap and not in the other are shingles
   that the other lacks, so counts of them bound the overlap from above. So does the place of the shared shingle, in the
   tile where it is the first one shared: none before it is. Large tiles are cut into pieces.
4. First each set meets only its most promising and its first partner in each tile (in large tiles in its piece, which
   also has one set common to all pieces). Pairs are confirmed by intersecting their sorted arrays of whole shingle sets,
   and join components. In tiles that still have several components, sets outside the largest one meet two more partners
   from other components; at last all pairs across components that pass the bound are confirmed. So every similar pair is
   confirmed or connected by others that are, and large groups of near copies never make all pairs.
5. With ``by_print`` SimHash proposes pairs before that: sets of one fingerprint, and those that ``simhash.links`` connects.
   What of them is confirmed joins components, and sets of one component do not look for each other in tiles.

Whole sets leave the workers only where some partner passed the bound, and are made from the text anew for that. Work in
a tile is the square of its sets outside its largest component and linear in that one; very many sets that begin alike,
pass the bound and are not similar cost the square of their number.

Defined results: a null or empty text has an empty set and a component of its own, named by its own id. A text with fewer
words than a shingle is one shingle. Repeated rows are linked by their sets, also if their ids are equal; a component is
named by its smallest id that is not null, if it has one. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import configured, dropped, releasing, saved
from .simhash import components, fingerprint_of, links, similar

#: Shingles met this often in the sets of one stretch (of so many shingles) of a task are counted, and those with more
#: than COMMON in all come last in the order, at most MOST_COMMON of them. The order matters to speed only.
STRETCH, OFTEN, COMMON, MOST_COMMON = 1 << 20, 3, 100, 1_000_000
#: Bits of a set's bitmap: the power of two that is at least BITS_EACH for each shingle, between the two bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 2, 64, 8192
#: Larger tiles are cut into pieces of about this many sets.
PIECE = 1024
#: Bits of the filter by which a pass over the texts leaves out sets that are not wanted.
FILTER_BITS = 24
#: Rows of an Arrow batch, and shingles after which a batch of sets ends.
ARROW_ROWS, BATCH_SHINGLES = 1000, 1 << 18
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# ---------------------------------------------------------------- sets


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)], dtype=np.uint64)[:n]


#: A number for each byte, the same for both cases of a letter and 0 for white space; bytes of a block; powers for one.
_BYTES = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_BYTES[_SPACE] = 0
_BLOCK, _BASE = 1 << 16, 0xD1342543DE82EF95
_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text, A-Z as a-z: polynomials over its bytes' numbers, in blocks that end with a word."""
    whole, out, low = np.frombuffer(text, np.uint8), [], 0
    while low < len(whole):
        high = min(low + _BLOCK, len(whole))
        if high < len(whole) and not _SPACE[whole[high - 1]]:
            cut = np.flatnonzero(_SPACE[whole[low:high]])
            if len(cut):
                high = low + int(cut[-1]) + 1
            else:  # a word longer than a block
                while high < len(whole) and not (found := np.flatnonzero(_SPACE[whole[high : high + _BLOCK]])).size:
                    high = min(high + _BLOCK, len(whole))
                high = high + int(found[0]) if high < len(whole) else high
        block = whole[low:high]
        inside = ~_SPACE[block]
        starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
        if len(starts):
            n = len(block)
            up, down = (_UP, _DOWN) if n <= _BLOCK else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
            out.append(_mixed(np.add.reduceat(_BYTES[block] * up[:n], starts) * down[starts]))
        low = high
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct word shingles, ascending: polynomials over the words' hashes."""
    each = word_hashes(text or b"")
    if not len(each):
        return np.empty(0, np.int64)
    width = min(shingle, len(each))
    n = len(each) - width + 1
    h = each[:n].copy()
    for k in range(1, width):
        h = h * _STEP + each[k : k + n]
    h = np.sort(_mixed(h).view(np.int64))
    return h[np.r_[True, h[1:] != h[:-1]]]


def digest_of(hashes: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64).tolist()
    return a, b


def bitmap(hashes: np.ndarray) -> bytes:
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * len(hashes) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[hashes & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of batches with the sets of their texts."""
    for batch in batches:
        at, held, size = 0, [], 0
        for i in range(batch.num_rows):
            held.append(shingle_set(batch.column(column)[i].as_py(), shingle))
            size += len(held[-1])
            if i + 1 == batch.num_rows or size > BATCH_SHINGLES:
                yield batch.slice(at, len(held)), held
                at, held, size = i + 1, [], 0


def _new(sets: list[np.ndarray], seen: set[tuple[int, int]]) -> list[tuple[int, tuple[int, int]]]:
    """(place, digest) of the sets that are not empty and new to this task; what it remembers is bounded."""
    out = []
    for i, s in enumerate(sets):
        key = digest_of(s)
        if len(s) and key not in seen:
            if len(seen) >= 1 << 18:
                seen.clear()
            seen.add(key)
            out.append((i, key))
    return out


def signatures(docs: DataFrame, shingle: int, id_column: str, text_column: str, prints: bool = False) -> DataFrame:
    """(doc_id, n, k1, k2, bits, fp) for each row, and rows (h, times) for shingles that are frequent in some stretch; fp is
    the SimHash of the text, null unless ``prints`` are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        stretch, size = [], 0
        for batch, sets in _sets(batches, shingle, 1):
            keys = np.array([digest_of(s) for s in sets], np.int64).reshape(-1, 2)
            none = pa.nulls(len(sets), pa.int64())
            columns = [
                batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()),
                pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                prints_of(batch.column(1)) if prints else none, none, none,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            new = [sets[i] for i, _ in _new(sets, seen)]
            stretch, size = stretch + new, size + sum(map(len, new))
            if size >= STRETCH:
                yield from often(stretch)
                stretch, size = [], 0
        if stretch:
            yield from often(stretch)

    def often(stretch: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, times = np.unique(np.concatenate(stretch), return_counts=True)
        h, times = h[times >= OFTEN], times[times >= OFTEN]
        if len(h):
            none = pa.nulls(len(h), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(h), pa.binary()), none, pa.array(h), pa.array(times.astype(np.int64))], names=names)

    def prints_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint_of(t.as_py() or b"") for t in texts), np.uint64, len(texts)).view(np.int64))

    names = ["doc_id", "n", "k1", "k2", "bits", "fp", "h", "times"]
    pair = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("binary").alias("text"))
    return pair.mapInArrow(releasing(run), "doc_id long, n long, k1 long, k2 long, bits binary, fp long, h long, times long")


def frequent(found: DataFrame) -> np.ndarray:
    """The shingles that come last in the order, ascending: at most MOST_COMMON, so 8 MB at most."""
    counts = found.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("times").alias("times"))
    rows = counts.where(F.col("times") > COMMON).orderBy(F.desc("times"), "h").limit(MOST_COMMON).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy())


def prefix(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set's shingles: ascending, those in ``last`` after all others."""
    n = len(hashes)
    if len(last):
        late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: n - (4 * n + 4) // 5 + 1]


def _prefixes(docs: DataFrame, shingle: int, text_column: str, last) -> DataFrame:
    """(h, k1, k2, place) of the first shingles of each set, copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, sets in _sets(batches, shingle):
            new = _new(sets, seen)
            if new:
                first = [prefix(sets[i], last.value) for i, _ in new]
                keys = np.repeat(np.array([k for _, k in new], np.int64), [len(x) for x in first], axis=0)
                place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in first])
                columns = [np.concatenate(first), keys[:, 0].copy(), keys[:, 1].copy(), place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "k1", "k2", "place"])

    return docs.select(docs[text_column].cast("binary").alias("text")).mapInArrow(releasing(run), "h long, k1 long, k2 long, place int")


def tiles(docs: DataFrame, sets: DataFrame, shingle: int, text_column: str, last: np.ndarray) -> DataFrame:
    """(h, c, no, root, n, room, bits): the sets (no, root, k1, k2, n, bits) of each tile h, c of them, tiles of equal members once;
    room is what of a set is left from the shared shingle on, the first of them where several tiles became one."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(last)  # 8 MB at most
    entries = _prefixes(docs, shingle, text_column, shared).repartition("h").dropDuplicates(["h", "k1", "k2"])
    w = Window.partitionBy("h")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "k1", "k2")).over(w).alias(f"d{seed}") for seed in (1, 2)]
    counted = entries.select("h", "k1", "k2", "place", F.count(F.lit(1)).over(w).alias("c"), *marks).where("c > 1")
    counted = saved(counted, "shared")
    once = counted.groupBy("c", "d1", "d2", "k1", "k2").agg(F.min("h").alias("h"), F.min("place").alias("place"))
    rows = once.select("h", "c", "k1", "k2", "place").join(sets, ["k1", "k2"])
    out = saved(rows.select("h", "c", "no", "root", "n", (F.col("n") - F.col("place")).alias("room"), "bits"), "tiles")
    dropped(counted)
    return out


# ---------------------------------------------------------------- tiles


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each group by the first ``keys`` columns, of rows that come group by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        if held and any(held[0].column(i)[0].as_py() != key[0, i] for i in range(keys)):
            yield pa.concat_batches(held)
            held = []
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        at = 0
        for to in cuts.tolist():
            yield pa.concat_batches([*held, batch.slice(at, to - at)]) if held else batch.slice(at, to - at)
            held, at = [], to
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def _bitmaps(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width in 64-bit words: the places of bitmaps of that width, and those as rows of a matrix."""
    sizes = pa.compute.binary_length(column).to_numpy() // 8
    out = {}
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        whole = b"".join(column.take(pa.array(at)).to_pylist())
        out[width] = at, np.frombuffer(whole, np.uint64).reshape(-1, width)
    return out


def _near(left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, share): pairs of rows of two sides (n, bitmaps by width, room) that may be similar, and what share of both
    sets the bitmaps let be common.

    Sizes of similar sets differ by a quarter at most, so widths are equal or one doubling apart; the wider is folded.
    """
    for width, (i, a) in left[1].items():
        for other in (width // 2, width, 2 * width):
            if other not in right[1]:
                continue
            j, b = right[1][other]
            x, y = (a | 0, b) if other == width else (a[:, :other] | a[:, other:], b) if other < width else (a, b[:, :width] | b[:, width:])
            step = max(1, (1 << 19) // max(1, y.size))
            for at in range(0, len(i), step):
                part, n, m = x[at : at + step, None, :], left[0][i[at : at + step], None], right[0][j][None, :]
                lacks = np.bitwise_count(part & ~y[None]).sum(axis=2, dtype=np.int64)
                lacked = np.bitwise_count(y[None] & ~part).sum(axis=2, dtype=np.int64)
                bound = np.minimum(np.minimum(n - lacks, m - lacked), np.minimum(left[2][i[at : at + step], None], right[2][j][None, :]))
                p, q = np.nonzero(similar(bound, n, m))
                yield i[at + p], j[q], 1 - (lacks[p, q] + lacked[p, q]) / (left[0][i[at + p]] + right[0][j[q]])


def _best_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, piece, no, root, n, room, bits) -> for each set of a piece its partner of another root of the greatest bound,
    and its first one."""
    for group in _grouped(batches, 2):
        no, root, n, room = (group.column(k).to_numpy() for k in (2, 3, 4, 5))
        if (root == root[0]).all():
            continue
        if len(n) == 2 and not similar(min(n.min(), room.min()), n[0], n[1]):
            continue
        side = n, _bitmaps(group.column(6)), room
        found = list(_near(side, side))
        if found:
            i, j, share = (np.concatenate(x) for x in zip(*found, strict=True))
            apart = root[i] != root[j]
            i, j, share = i[apart], j[apart], share[apart]
            taken = np.concatenate([_firsts(i, np.lexsort((no[j], *order, i))) for order in ([-share], [])])
            if len(taken):
                yield _pairs(no[i[taken]], no[j[taken]])


def _open_pairs(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Rows (h, p, q, side, no, n, room, root, bits) -> pairs of one set of each side, of different roots, that may be
    similar; with ``best`` each set of the first side only with its most promising and its first partner."""
    for group in _grouped(batches, 3):
        side, no, n, room, root = (group.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6, 7))
        rows = [np.flatnonzero(side == s) for s in (0, 1)]
        if not len(rows[0]) or not len(rows[1]):
            continue
        left, right = ((n[r], _bitmaps(group.column(8).take(pa.array(r))), room[r]) for r in rows)
        found = []
        for i, j, share in _near(left, right):
            i, j = rows[0][i], rows[1][j]
            apart = root[i] != root[j]
            if apart.any() and not best:
                yield _pairs(no[i[apart]], no[j[apart]])
            elif apart.any():
                found.append((i[apart], j[apart], share[apart]))
        if found:
            i, j, share = (np.concatenate(x) for x in zip(*found, strict=True))
            taken = [_firsts(i, np.lexsort((no[j], *order, i))) for order in ([-share], [])]
            yield _pairs(*(no[x[np.concatenate(taken)]] for x in (i, j)))


def _firsts(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of places in ``order``, where equal keys follow each other, the first of each key."""
    ordered = key[order]
    return order[np.r_[True, ordered[1:] != ordered[:-1]][: len(order)]]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _many(count) -> F.Column:
    return F.ceil(count / F.lit(PIECE)).cast("int")


def print_pairs(each: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that share a fingerprint with the first set that has it, and first sets of linked fingerprints."""
    own = each.where("n > 0").select("k1", "k2", "fp").distinct().join(sets.select("k1", "k2", "no"), ["k1", "k2"])
    own = saved(own.select("fp", "no"), "prints")
    head = saved(own.groupBy("fp").agg(F.min("no").alias("head")), "heads")
    same = own.join(head, "fp").select("no", "head")
    one, two = (head.select(F.col("fp").alias(x), F.col("head").alias(y)) for x, y in (("a", "no"), ("b", "head")))
    near = links(head.select("fp")).join(one, "a").join(two, "b").select("no", "head")
    pairs = same.unionByName(near).where("no <> head")
    pairs = saved(pairs.select(F.greatest("no", "head").alias("a"), F.least("no", "head").alias("b")).distinct(), "print-pairs")
    dropped(own, head)
    return pairs


def first_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each set's most promising partner in each tile, of a large tile in its piece."""
    large = rows.where(F.col("c") > PIECE)
    pieces = rows.withColumn("piece", F.when(F.col("c") > PIECE, F.pmod(F.xxhash64("no"), _many(F.col("c")))).otherwise(0).cast("int"))
    one = large.groupBy("h").agg(F.min_by(F.struct("no", "root", "n", "room", "bits"), "no").alias("one"), F.max("c").alias("c"))
    common = one.select("h", F.explode(F.sequence(F.lit(0), _many(F.col("c")) - 1)).alias("piece"), "one.*")
    columns = ("h", "piece", "no", "root", "n", "room", "bits")
    dealt = pieces.select(*columns).unionByName(common.select(*columns))
    dealt = dealt.repartition("h", "piece").sortWithinPartitions("h", "piece", "n", "no")
    return dealt.mapInArrow(releasing(_best_partners), "a long, b long").distinct()


def rest_pairs(rows: DataFrame, roots: DataFrame, best: bool = False) -> DataFrame:
    """(a, b): in tiles of several components all pairs across components that may be similar, or (``best``) two partners
    at most for each set outside the largest one. Tiles of two sets had their only pair before."""
    rows = rows.where("c > 2")
    ids = rows.select("h", "no").join(roots.withColumnRenamed("node", "no"), "no", "left").select("h", "no", F.coalesce("root", "no").alias("root"))
    by_root = ids.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = by_root.groupBy("h").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.max("m").alias("most"), F.sum("m").alias("c"))
    still = largest.where("most < c").select("h", "largest", F.col("c").alias("of"), (F.col("c") - F.col("most")).alias("others"))
    open_ = rows.select("h", "no", "n", "room", "bits").join(still, "h").join(roots.withColumnRenamed("node", "no"), "no", "left")
    open_ = saved(open_.withColumn("root", F.coalesce("root", "no")), "open")
    p, q = _many(F.col("others")), _many(F.col("of"))  # pieces of the smaller components' sets, and of all
    own = lambda many: F.pmod(F.xxhash64("no"), many).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), many - 1))
    columns = ("no", "n", "room", "root", "bits")
    small = open_.where("root <> largest").select("h", own(p).alias("p"), every(q).alias("q"), F.lit(0).alias("side"), *columns)
    all_ = open_.select("h", every(p).alias("p"), own(q).alias("q"), F.lit(1).alias("side"), *columns)
    dealt = small.unionByName(all_).repartition("h", "p", "q").sortWithinPartitions("h", "p", "q", "side", "n", "no")
    found = saved(dealt.mapInArrow(releasing(lambda batches: _open_pairs(batches, best)), "a long, b long").distinct(), "rest-pairs")
    dropped(open_)
    return found


# ---------------------------------------------------------------- confirmation


class Confirmer:
    """Confirms pairs of sets by whole shingle sets, which it makes from the texts when they are first wanted."""

    def __init__(self, docs: DataFrame, sets: DataFrame, shingle: int, text_column: str):
        self.docs, self.sets, self.shingle, self.text_column = docs, sets, shingle, text_column
        self.known: list[DataFrame] = []

    def _wanted(self, wanted: DataFrame) -> DataFrame:
        """(no, hashes) of wanted sets (no, k1, k2). A bit for the low bits of each key tells workers what to leave out."""
        spark, width, shingle = wanted.sparkSession, 1 << FILTER_BITS, self.shingle
        place = F.pmod(F.col("k1"), F.lit(width)) + 1
        parts = wanted.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        bits = np.zeros(width // 8, np.uint8)
        for r in parts.collect():  # 4 kB each, 2^FILTER_BITS bits in all
            bits[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
        told = spark.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for _, sets in _sets(batches, shingle):
                new = _new(sets, seen)
                low = np.array([k[0] & (width - 1) for _, k in new], np.int64)
                new = [new[x] for x in np.flatnonzero(told.value[low >> 3] >> (low & 7).astype(np.uint8) & 1).tolist()]
                if new:
                    keys, own = np.array([k for _, k in new], np.int64), [sets[i] for i, _ in new]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), lists], names=["k1", "k2", "hashes"])

        whole = self.docs.select(self.docs[self.text_column].cast("binary").alias("text")).mapInArrow(releasing(run), "k1 long, k2 long, hashes array<long>")
        return whole.join(wanted, ["k1", "k2"]).groupBy("no").agg(F.any_value("hashes").alias("hashes"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose similarity is 0.8 or more."""
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
        for table in self.known:
            wanted = wanted.join(table.select("no"), "no", "left_anti")
        wanted = saved(wanted.join(self.sets.select("no", "k1", "k2"), "no"), "wanted")
        with configured(pairs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS):
            if not wanted.isEmpty():
                self.known.append(saved(self._wanted(wanted), "whole-sets"))
            dropped(wanted)
            whole = self.known[0]
            for table in self.known[1:]:
                whole = whole.unionByName(table)
            one, two = (whole.select(F.col("no").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
            both = pairs.join(one, "a").join(two, "b").select("a", "b", "hashes_a", "hashes_b")
            return saved(both.mapInArrow(releasing(_intersected), "a long, b long"), "confirmed")

    def close(self) -> None:
        dropped(*self.known)


def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sorted arrays have enough in common."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
            place = np.minimum(np.searchsorted(a, b), len(a) - 1)
            keep[i] = similar(int((a[place] == b).sum()), len(a), len(b))
        yield batch.select([0, 1]).filter(pa.array(keep))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, by_print: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: sets with a Jaccard similarity of 0.8 or more, directly or
    through others, share a component. ``by_print`` only changes which pairs are confirmed first."""
    with configured(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS):
        found = saved(signatures(docs, shingle, id_column, text_column, by_print), "signatures")
        last = frequent(found)
        each = found.where(F.col("n").isNotNull())
        sets = each.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
        sets = saved(sets.withColumn("no", F.monotonically_increasing_id()), "distinct-sets")
        confirmer = Confirmer(docs, sets, shingle, text_column)
        dealt, linked = sets.drop("first").withColumn("root", F.col("no")), None
        if by_print:
            linked = print_pairs(each, sets)
            known = confirmer.confirmed(linked)
            roots = components(known).withColumnRenamed("node", "no")
            dealt = saved(sets.drop("first").join(roots, "no", "left").withColumn("root", F.coalesce("root", "no")), "rooted-sets")
        rows = tiles(docs, dealt, shingle, text_column, last)
        asked = first_pairs(rows)
        asked = saved(asked if linked is None else asked.join(linked, ["a", "b"], "left_anti"), "first-pairs")
        edges = confirmer.confirmed(asked)
        if linked is not None:
            asked, edges = asked.unionByName(linked), edges.unionByName(known)
        roots = components(edges)
        for best in (True, False):  # what the first turn connects, the second need not compare
            more = saved(rest_pairs(rows, roots, best).join(asked, ["a", "b"], "left_anti"), "more-pairs")
            new = confirmer.confirmed(more)
            asked = asked.unionByName(more)
            if not new.isEmpty():
                edges = edges.unionByName(new)
                roots = components(edges)
        dropped(rows)
        confirmer.close()
    rooted = sets.join(roots, sets["no"] == roots["node"], "left").select("k1", "k2", "first", F.coalesce("root", "no").alias("root"))
    # written, so the join has exchanges of its own, which Spark splits where one component is very large
    smallest = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = saved(rooted.join(smallest, "root").select("k1", "k2", "component_id"), "named")
    own = each.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    return own.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
