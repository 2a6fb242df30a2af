"""Quality rules by repetition coverage.

Words of a text are interned to integers, rolling hashes of every n-gram length run over them in numpy, and the
characters inside n-grams that occur more than once are measured against all characters in words. Lines are compared
as whole byte strings.

Defined results: a null or empty text (or one of white space only) has no words, fails the base rule and is not
kept; its coverages are 0. Repeated rows give equal results; other columns of the input, whatever their names, are
not read. One row in gives one row out and no row depends on another, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: n-gram length: the largest share of word characters that may lie in n-grams found more than once.
#: Fixed values, published with the quality rules of large web corpora.
DUP_NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: n-gram length: the largest share of word characters that the most frequent n-gram may cover. Fixed values too.
TOP_NGRAM_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of lines, and of word characters in lines, equal to an earlier line.
DUP_LINE_LIMIT, DUP_LINE_CHAR_LIMIT = 0.30, 0.20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOLS = b"[#*$%&|<>]"
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_ngram_coverage double, top_ngram_coverage double, "
    "dup_line_coverage double"
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads small word numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in one of the n-grams that begin at ``starts``."""
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The figures of one text, in the order of SCHEMA without doc_id."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, _symbols(raw), 0, 0, True, False, 0.0, 0.0, 0.0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    per_word = [len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in number]
    chars = np.array(per_word, np.int64)[ids]
    total = int(chars.sum())

    dup_lines, dup_line_chars, lines, seen = 0, 0, 0, set()
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            inside = line.split()
            if inside:
                lines += 1
                if line in seen:
                    dup_lines += 1
                    dup_line_chars += sum(per_word[number[w]] for w in inside)
                else:
                    seen.add(line)
    else:
        lines = 1

    hashed, rolled = mixed(ids.astype(np.uint64) + np.uint64(1)), None
    repeat_words, worst_dup, worst_top, broken = 0, 0.0, 0.0, False
    for k in range(1, max(DUP_NGRAM_LIMITS) + 1):
        if k > n:
            break
        rolled = hashed if k == 1 else rolled[:-1] * _BASE + hashed[k - 1 :]
        if k == 1:
            continue
        order = np.argsort(rolled, kind="stable")
        line_up = rolled[order]
        head = np.flatnonzero(np.r_[True, line_up[1:] != line_up[:-1]])
        counts = np.diff(np.r_[head, len(line_up)])
        most = int(counts.max())
        if most < 2:
            break  # no n-gram repeats, so no longer one does
        if k == 3 or k in DUP_NGRAM_LIMITS:
            mask = covered(order[np.repeat(counts, counts) > 1], k, n)
            if k == 3:
                repeat_words = int(mask.sum())
            if k in DUP_NGRAM_LIMITS:
                share = int(chars[mask].sum()) / total
                worst_dup = max(worst_dup, share)
                broken |= share > DUP_NGRAM_LIMITS[k]
        if k in TOP_NGRAM_LIMITS:
            # of equally frequent n-grams, the one with most characters counts
            spans = np.cumsum(np.r_[0, chars])
            tied = head[counts == most]
            at = tied[np.argmax((spans[k:] - spans[:-k])[order[tied]])]
            mask = covered(order[at : at + most], k, n)
            share = int(chars[mask].sum()) / total
            worst_top = max(worst_top, share)
            broken |= share > TOP_NGRAM_LIMITS[k]
    line_share = dup_line_chars / total
    broken |= dup_lines > DUP_LINE_LIMIT * lines or line_share > DUP_LINE_CHAR_LIMIT
    failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
    return (
        n, total, _symbols(raw), dup_lines, repeat_words, failed, not failed and not broken,
        worst_dup, worst_top, line_share,
    )


def _symbols(raw: bytes) -> int:
    return len(re.findall(_SYMBOLS, raw))


def repetition_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of SCHEMA for each row of ``docs``, read from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64())]
            + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
            + [(c, pa.float64()) for c in ("dup_ngram_coverage", "top_ngram_coverage", "dup_line_coverage")]
        )
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(schema) - 1)
            arrays = [batch.column(0).cast(pa.int64())]
            arrays += [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, SCHEMA)
