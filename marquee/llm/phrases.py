"""Substring deduplication with repeated-phrase automata.

A window is ``span`` consecutive words of one document; each word covered by a window whose word sequence also starts
anywhere else (another document or the same one) is removed. All stages work on whole texts of all documents.

1. Anchors. Rolling hashes of ``gram`` words; each window picks its least one (leftmost of equals). Equal windows pick
   equal anchors at equal places, so a window can only repeat if its anchor does. The windows of one anchor
   occurrence form a chunk (at most span - gram + 1 windows).
2. Documents with equal word sequences form a class: all of a repeated class is repeated text, and only its smallest
   member goes on, so large groups of copies cost one document.
3. Confirming. Anchors found once are dropped by a count with map-side sums. What is left of the text is read as
   distinct chunks, the first document that has one lending its words. A chunk that is alone with its anchor is
   confirmed as a whole; windows of chunks that share an anchor but differ are counted by (anchor, window) hashes, 128
   bits together. Each confirmed window is lent by one chunk, so a passage is stored once however many hold it.
4. Locating. Anchors are dealt to shards of about ``SHARD_WORDS`` words of passages. A task compiles the Aho-Corasick
   automaton of its shard's passages (over word numbers) and streams the shard's distinct chunks, as words with what
   surrounds them, through it: every place of every passage marks the words that it covers. Chunks without a
   passage's anchor cannot hold one and are not streamed. A shard with very many chunks is split by a salt (each part
   compiles the automaton), one with very many passages into parts of its own.
5. The marks of a chunk go to every place that it has in a document; texts with marks are read once more.

Nothing is broadcast but what Spark finds small; nothing is collected but two counts. A passage shared by a third of
all documents is one key of sums, one passage in one automaton, and a key of joins that Spark splits when skewed.

Defined results: a null or empty text has no words, keeps none and removes none. Texts of fewer than ``span`` words
are kept whole. Rows with equal or null ids are documents of their own (rows are told apart by id and text, and equal
rows are copies of each other). Only the two named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

SPAN, GRAM = 35, 12
#: Words in the passages of one automaton, and distinct chunks streamed through it in one task, about.
SHARD_WORDS, SHARD_CHUNKS = 200_000, 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WIDE = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def rolling(hashes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of n, built by doubling."""
    parts, size, power, at = [], 1, base, hashes  # runs of 1, 2, 4, ... and the base to that power
    out, have = None, 0
    while size <= n:
        parts.append((size, power, at))
        if 2 * size <= n:
            at = at[:-size] * power + at[size:]
        power, size = np.uint64(int(power) ** 2 & (1 << 64) - 1), 2 * size
    for size, power, at in reversed(parts):
        if n & size:
            if out is None:
                out, have = at, size
            else:
                m = len(hashes) - have - size + 1
                out, have = out[:m] * power + at[have : have + m], have + size
    return out


def chunks(words: list[bytes], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchors, first window of each chunk, number of windows, hash of all its words, window hashes)."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = rolling(hashes, gram, _BASE)
    least = sliding_window_view(grams, span - gram + 1).argmin(axis=1)
    least += np.arange(len(least))
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, len(least)])
    windows = rolling(hashes, span, _WIDE)
    whole = (windows[first] * _BASE ^ windows[first + count - 1]) * _WIDE + count.astype(np.uint64)
    return grams[least[first]], first, count, whole, windows


def _longs(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _anchored(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Per document: its word sequence's digest, kept_sha256 of the whole, and its chunks."""
    schema = "row struct<id:long,dig:long>, n_words int, whole_sha256 string, anchors array<long>, wholes array<long>, places array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, sha, found = [], [], []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    n.append(len(words))
                    sha.append(kept_digest(words))
                    if len(words) < span:
                        found.append((none, none, none))
                    else:
                        anchor, first, count, whole, _ = chunks(words, span, gram)
                        found.append((_longs(anchor), _longs(whole), first * (span + 1) + count))
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int32()), pa.array(sha, pa.string()), *(_list(list(c), pa.int64()) for c in columns)],
                    names=["row", "n_words", "whole_sha256", "anchors", "wholes", "places"],
                )

    return docs.select("row", "text").mapInArrow(run, schema)


def _regions(docs: DataFrame, span: int) -> DataFrame:
    """For the chunks wanted of each document: all words of the chunk, and its window hashes if they are to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, windows = [], []
                for t, picked in zip(part.column(0), part.column(1), strict=True):
                    words, picked = words_of(t.as_py()), picked.as_py()
                    hashes = None
                    if not all(p["alone"] for p in picked):
                        hashes = rolling(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), span, _WIDE)
                    for p in picked:
                        first, count = divmod(p["place"], span + 1)
                        region = b" ".join(words[first : first + count + span - 1]).decode("utf-8", "surrogatepass")
                        rows.append((p["anchor"], p["whole"], p["n"], count, region))
                        windows.append(np.empty(0, np.int64) if p["alone"] else _longs(hashes[first : first + count]))
                anchor, whole, n, count, region = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in (anchor, whole, n, count)), pa.array(region, pa.string()), _list(windows, pa.int64())],
                    names=["anchor", "whole", "n", "count", "region", "windows"],
                )

    return docs.select("text", "picked").mapInArrow(
        run, "anchor long, whole long, n long, count long, region string, windows array<long>"
    )


def runs(lent: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, last) of neighbouring windows, given as (place, holders), that the same chunks hold."""
    out: list[tuple[int, int]] = []
    before = None
    for place, holders in sorted(lent):
        if before == (place - 1, holders):
            out[-1] = (out[-1][0], place)
        else:
            out.append((place, place))
        before = place, holders
    return out


class Shard:
    """The passages of one shard as automata over word numbers, compiled when the first region comes."""

    def __init__(self, span: int):
        self.span = span
        self.number: dict[bytes, int] = {}
        self.automata: list[ahocorasick.Automaton] = []
        self.size = SHARD_WORDS
        self.ready = False

    def lend(self, region: bytes, lent: list[tuple[int, int]]) -> None:
        words = region.split(b" ")
        for first, last in runs(lent):
            if self.size >= SHARD_WORDS:
                self.automata.append(ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE))
                self.size = 0
            passage = words[first : last + self.span]
            self.automata[-1].add_word(tuple(self.number.setdefault(w, len(self.number) + 1) for w in passage))
            self.size += len(passage)

    def located(self, region: bytes) -> list[int]:
        """Places from and to, in turn, of the stretches of words that passages cover."""
        if not self.ready:
            for automaton in self.automata:
                automaton.make_automaton()
            self.ready = True
        words = region.split(b" ")
        coded = tuple(self.number.get(w, 0) for w in words)
        edge = np.zeros(len(words) + 2, np.int32)
        for automaton in self.automata:
            for end, n in automaton.iter(coded):
                edge[end + 2 - n] += 1
                edge[end + 2] -= 1
        covered = np.cumsum(edge) > 0
        return np.flatnonzero(covered[1:] != covered[:-1]).tolist()


def _located(dealt: DataFrame, span: int) -> DataFrame:
    """(anchor, whole, covered): what the passages of each shard cover of its regions.

    Rows (part, is_region, anchor, whole, region, lent) come with the parts together and passages before regions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, last = None, Shard(span), None
        for batch in batches:
            found: list[tuple[int, int, list[int]]] = []
            for r in (r for at in range(0, batch.num_rows, 512) for r in batch.slice(at, 512).to_pylist()):
                if r["part"] != part:
                    part, shard, last = r["part"], Shard(span), None
                region = r["region"].encode("utf-8", "surrogatepass")
                if not r["is_region"]:
                    shard.lend(region, [(w["i"], w["holders"]) for w in r["lent"]])
                elif (r["anchor"], r["whole"]) != last:  # a region lent by repeated rows comes several times
                    last = r["anchor"], r["whole"]
                    if covered := shard.located(region):
                        found.append((*last, covered))
            if found:
                anchor, whole, covered = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), pa.array(whole, pa.int64()), pa.array(covered, pa.list_(pa.int32()))],
                    names=["anchor", "whole", "covered"],
                )

    return dealt.mapInArrow(run, "anchor long, whole long, covered array<int>")


def _stripped(marked: DataFrame) -> DataFrame:
    """(no, n_removed, kept_sha256) of documents (no, text, marks): marks are (first word, stretches from there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, marks in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                edge = np.zeros(len(words) + 1, np.int32)
                for m in marks:
                    at = m["covered"].values.to_numpy() + m["first"].as_py()
                    np.add.at(edge, at[::2], 1)
                    np.add.at(edge, at[1::2], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(kept_digest([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["no", "n_removed", "kept_sha256"]
            )

    return marked.select("no", "text", "marks").mapInArrow(run, "no long, n_removed long, kept_sha256 string")


def _lent(regions: DataFrame) -> DataFrame:
    """(anchor, whole, lent): the windows (place, digest of the chunks that hold it) that a chunk lends to the automata.

    Neighbouring windows with the same holders are one passage, which all of them hold whole.
    """
    single = regions.where(F.size("windows") > 0).select("anchor", "whole", "n", F.posexplode("windows").alias("i", "window"))
    twice = single.groupBy("anchor", "window").agg(
        F.sum("n").alias("m"), F.min(F.struct("whole", "i")).alias("by"), F.bit_xor(F.xxhash64("whole")).alias("holders")
    ).where("m > 1")
    part = twice.groupBy("anchor", F.col("by.whole").alias("whole")).agg(F.collect_list(F.struct("by.i", "holders")).alias("lent"))
    every = F.transform(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")), lambda i: F.struct(i.alias("i"), F.lit(0).cast("long").alias("holders")))
    return part.unionByName(regions.where(F.size("windows") == 0).select("anchor", "whole", every.alias("lent")))


def _dealt(regions: DataFrame, lent: DataFrame, span: int) -> DataFrame:
    """Rows for ``_located``: passages and regions by shard, split where a shard has too many of either."""
    rows = regions.join(lent, ["anchor", "whole"], "left").select("anchor", "whole", "region", "lent")
    rows = saved(rows, "lent")
    size = F.size("lent") + (span - 1) * F.size(F.array_distinct("lent.holders"))
    lenders = rows.where("lent is not null")
    words = lenders.agg(F.sum(size)).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-words // SHARD_WORDS))))
    passages = lenders.groupBy(shard.alias("shard")).agg(F.ceil(F.sum(size) / (2 * SHARD_WORDS)).alias("subs"))
    regions_of = rows.groupBy(shard.alias("shard")).agg(F.ceil(F.count(F.lit(1)) / SHARD_CHUNKS).alias("salts"))
    parts = passages.join(regions_of, "shard")  # shards without a passage have nothing to locate
    rows = rows.withColumn("shard", shard).join(parts, "shard")
    dealt = lambda n: F.pmod(F.xxhash64("whole", F.lit(1)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    passages = rows.where("lent is not null").select("*", dealt("subs").alias("sub"), every("salts").alias("salt"))
    passages = passages.withColumn("is_region", F.lit(False))
    places = rows.select("*", every("subs").alias("sub"), dealt("salts").alias("salt")).withColumn("is_region", F.lit(True))
    places = places.withColumn("lent", F.lit(None).cast(rows.schema["lent"].dataType))
    columns = ["is_region", "anchor", "whole", "region", "lent"]
    both = passages.select(F.struct("shard", "sub", "salt").alias("part"), *columns).unionByName(
        places.select(F.struct("shard", "sub", "salt").alias("part"), *columns)
    )
    return both.repartition("part").sortWithinPartitions("part", "is_region", "anchor", "whole")


def remove_repeats(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``."""
    key = F.struct(docs[id_column].cast("long").alias("id"), F.xxhash64(docs[text_column]).alias("dig"))
    docs = docs.select(key.alias("row"), docs[text_column].alias("text"))
    each = _anchored(docs, span, gram).withColumn("no", F.monotonically_increasing_id())
    each = saved(each, "anchors")  # from here on, ``no`` stands for the document

    # classes of equal word sequences
    same = each.where(F.col("n_words") >= span).groupBy("whole_sha256").agg(
        F.min("no").alias("no"), F.count(F.lit(1)).alias("members")
    )
    same = saved(same, "classes")
    copied = same.where("members > 1").select("whole_sha256", F.lit(True).alias("copied"))
    heads = same.select("no", (F.col("members") > 1).alias("known"))

    # chunks of one document of each class, where the anchor is found again
    every = each.join(heads, "no").select("no", "known", F.explode(F.arrays_zip("anchors", "wholes", "places")).alias("c"))
    every = every.select("no", "known", F.col("c.anchors").alias("anchor"), F.col("c.wholes").alias("whole"), F.col("c.places").alias("place"))
    repeated = saved(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "repeated")
    found = saved(every.join(repeated, "anchor"), "chunks")
    dropped(repeated)

    # distinct chunks, with the words of the first document that has one
    kinds = found.groupBy("anchor", "whole").agg(F.min(F.struct("no", "place")).alias("of"), F.count(F.lit(1)).alias("n"))
    kinds = saved(kinds, "kinds")
    alone = kinds.groupBy("anchor").agg((F.count(F.lit(1)) == 1).alias("alone"))
    wanted = kinds.join(alone, "anchor").groupBy("of.no").agg(
        F.collect_list(F.struct("anchor", "whole", "n", F.col("of.place").alias("place"), "alone")).alias("picked")
    )
    lenders = wanted.join(each.select("no", "row"), "no").select("row", "picked")
    regions = saved(_regions(docs.join(lenders, "row"), span), "regions")
    dropped(kinds)

    dealt = _dealt(regions, _lent(regions), span)
    located = saved(_located(dealt, span), "located")
    dropped(regions)

    # marks go to all places of a chunk
    first = F.floor(F.col("place") / (span + 1)).cast("int")
    marks = found.where("not known").join(located, ["anchor", "whole"]).select("no", F.struct(first.alias("first"), "covered").alias("mark"))
    marks = marks.groupBy("no").agg(F.collect_list("mark").alias("marks"))
    marks = saved(marks.join(each.select("no", "row"), "no"), "marks")
    dropped(found, located)
    stripped = saved(_stripped(docs.join(marks, "row")), "stripped")
    dropped(marks)

    return (
        each.select("no", "row", "n_words", "whole_sha256")
        .join(copied, "whole_sha256", "left")
        .join(stripped, "no", "left")
        .select(
            F.col("row.id").alias("doc_id"),
            F.col("n_words").cast("long").alias("n_words"),
            F.when(F.col("copied"), F.col("n_words").cast("long"))
            .otherwise(F.coalesce("n_removed", F.lit(0)))
            .cast("long")
            .alias("n_removed"),
            F.when(F.col("copied"), F.lit(kept_digest([]))).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        )
    )
