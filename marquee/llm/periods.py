"""Periodic runs of words: every maximal stretch that repeats with some period, over a harmonic grid.

1. A run of length 3p or more with period p covers three neighbouring points jp, (j+1)p, (j+2)p of the grid of p. All
   grids of a text of n words together have about n ln n points; numpy tests them in blocks of bounded size, and points
   whose words differ (at the three points, or in the middle or at the end of the two periods between them) are left out.
2. For a point that is left, the common extension of jp and (j+1)p forward and backward gives the stretch around it. An
   extension is the least common prefix between two places of a suffix array, by a range minimum over a sparse table;
   the reversed words have an array of their own for the extensions backward. Both are built only if points are left.
3. Stretches of equal bounds are one run: its least period, which divides the others found.

Memory for one text is about 8 log2(n) bytes a word while arrays are built; texts are taken one by one.

Defined results: a null or empty text has no words and no runs. Repeated rows and null ids give one row each. An empty
table gives no rows. Only the two named columns are read, so extra columns, of whatever name, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Grid points in one block.
BLOCK = 1 << 20
#: Rows of one batch handed back, and bytes of text after which it ends earlier.
OUT_ROWS, OUT_BYTES = 1000, 1 << 23


class Extensions:
    """Lengths of common prefixes between suffixes of a word sequence: suffix array and sparse table of minima."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        rank = np.unique(words, return_inverse=True)[1].astype(np.int32)
        levels, reach = [rank], 1  # levels[k] tells stretches of 2^k words apart
        while int(rank.max()) < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:].astype(np.int64) + 1
            key = rank.astype(np.int64) * (n + 1) + after
            order = np.argsort(key, kind="stable")
            step = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
            rank = np.empty(n, np.int32)
            rank[order] = step
            levels.append(rank)
            reach *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        one, two = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(levels) - 2, -1, -1):  # at the last level all differ
            inside = np.flatnonzero((one < n) & (two < n))
            same = inside[levels[k][one[inside]] == levels[k][two[inside]]]
            for moved in (one, two, common):
                moved[same] += 1 << k
        self.n, self.rank = n, rank
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from a[i] on and from b[i] on, for different a[i] and b[i] of 0 to n; none from n on."""
        out = np.zeros(len(a), np.int64)
        inside = np.flatnonzero((a < self.n) & (b < self.n))
        one, two = self.rank[a[inside]], self.rank[b[inside]]
        low, high = np.minimum(one, two), np.maximum(one, two)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            least = self.least[k]
            out[inside[at]] = np.minimum(least[low[at]], least[high[at] - (1 << k)])
        return out


def _grid(n: int, periods: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (p, jp) for all p with ``periods`` periods in n words and all j with (j + 2)p < n."""
    first, last = 1, n // periods
    while first <= last:
        p = np.arange(first, min(last, first + block) + 1)
        counts = (n - 1) // p - 1
        ends = np.cumsum(counts)
        taken = max(1, int(np.searchsorted(ends, block, "right")))
        p, counts, ends = p[:taken], counts[:taken], ends[:taken]
        step = np.repeat(p, counts)
        yield step, (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * step
        first += taken


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, block: int = BLOCK) -> np.ndarray:
    """All runs of a sequence of word numbers as rows (start, length, period) by start, then period."""
    if least_periods < 3:
        raise ValueError("a run must have three periods or more")
    n, found, forward, backward = len(words), [], None, None
    if n < max(least_words, least_periods):
        return np.empty((0, 3), np.int64)
    for p, at in _grid(n, least_periods, block):
        keep = np.flatnonzero((words[at] == words[at + p]) & (words[at] == words[at + 2 * p]))
        for place in (lambda q: q // 2, lambda q: q - 1):
            here = at[keep] + place(p[keep])
            keep = keep[words[here] == words[here + p[keep]]]
        if not len(keep):
            continue
        if forward is None:
            forward, backward = Extensions(words), Extensions(words[::-1])
        p, at = p[keep], at[keep]
        before = backward.of(n - at, n - at - p)  # from the words before both
        end = at + p + forward.of(at, at + p)
        start = at - before
        long = end - start >= np.maximum(least_words, least_periods * p)
        found.append(np.unique(np.stack([start, end, p], axis=1)[long], axis=0))
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end and period: the least period comes first
    first = np.r_[True, np.any(rows[1:, :2] != rows[:-1, :2], axis=1)][: len(rows)]
    rows = rows[first]
    rows = np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by one space, without those that some run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(change)[:-1] > 0
    return b" ".join(words) if not gone.any() else b" ".join(words[i] for i in np.flatnonzero(~gone).tolist())


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: its runs by start, then period, and its text without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts, runs, kept = 0, [], [], []
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                counts.append(len(words))
                runs.append(runs_of(ids))
                kept.append(collapsed(words, runs[-1]))
                if len(kept) == OUT_ROWS or i + 1 == batch.num_rows or sum(map(len, kept[-100:])) > OUT_BYTES:
                    yield packed(batch.column(0).slice(at, len(kept)), counts, runs, kept)
                    at, counts, runs, kept = i + 1, [], [], []

    def packed(ids: pa.Array, counts: list[int], runs: list[np.ndarray], kept: list[bytes]) -> pa.RecordBatch:
        flat = np.concatenate(runs)
        fields = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], names=["start", "length", "period"])
        ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        columns = [ids.cast(pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, fields), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    pair = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return pair.mapInArrow(
        releasing(run), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def greatest(runs: Column) -> Column:
    """The run of the greatest exact length / period, of equals the first; null for no runs."""
    none = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(1).cast("long").alias("period"))
    above = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, none, lambda best, r: F.when(above(best, r), r).otherwise(best)))


def run_digest(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` found, as counts, the greatest run and digests."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", greatest(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[k].alias(k) for k in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, drawn by a hash of the id, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, word = F.floor(h / 10), F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    drawn = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.filter(word, lambda w: w != "")).alias("w"))
    drawn = drawn.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    p = F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")
    drawn = drawn.withColumn("p", p)
    turns = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    again = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), F.col("n") - F.col("a")))
    return drawn.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
