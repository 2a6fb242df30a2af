"""Cost-balanced packing of tokenized documents into sequences.

A block of documents (``block_tokens`` tokens, more only if one document alone has more) is packed at a time, while
its partition streams by: documents are cut at multiples of the capacity, and the pieces, longest first, each go to
the sequence of the least estimated cost (linear plus quadratic attention) that has room for the whole piece. A piece
that fits nowhere whole is cut to fill the cheapest open sequences. As many sequences are open as the block's tokens
fill exactly, so all are full; the block's last, shorter stretch is cut into sequences whose lengths are powers of
two, which need no padding.

The core is one narrow stage: no shuffle, no group that grows with the input, and a lost task is packed again to the
same result, as a block's content depends only on the order of its partition's rows.

Tokens: the tokenizer drops white space, so the pieces of a text between blanks and newlines are encoded one by one
and remembered (a bounded memo); the ids are those of encoding the text whole.

Defined results: a null or empty text is the end id alone. Repeated doc_ids are documents of their own, told apart
only by their sequences. An empty table gives no rows. Null doc_ids are carried through. Only the two named columns
are read.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import releasing

CAPACITY = 4096
#: Tokens packed together; a task holds about this many ids.
BLOCK_TOKENS = 1 << 20
#: Words of which a worker remembers the ids (some 35 MB); when as many are known it starts afresh, so that its memory
#: stays bounded in workers that go on to other stages, and the frequent words are soon known again.
MEMO_WORDS = 200_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention stays inside a piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


class Memo(dict):
    """Ids by word, as little-endian bytes, encoded when first asked for; a full memo is emptied."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        ids = self._ids(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        if plain(word):  # one token run, which the model takes as it is but for case
            low = word.lower()
            if low != word:
                return self[low]
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(BYTE_LETTERS)
            found = [t.id for t in self.model.tokenize(low)]
        elif word[-1:] in (".", ",") and plain(word[:-1]):  # the mark is a token run of its own
            return self[word[:-1]] + self[word[-1]]
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies spell bytes that print as themselves, and the others, in order, from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


def plain(w: str) -> bool:
    """Letters only, of which lower case can be taken before the tokenizer takes it (letter by letter, after NFC)."""
    if not w.isalpha():
        return False
    return w.isascii() or "\u03a3" not in w and is_normalized("NFC", w) and is_normalized("NFC", w.lower())


@cache
def memo_of(path: str) -> Memo:
    """One memo in each Python worker, which goes on from task to task."""
    from tokenizers import Tokenizer

    return Memo(Tokenizer.from_file(path))


def encode(text: str | None, memo: Memo, end_id: int) -> np.ndarray:
    """The ids of a whole text, then ``end_id``."""
    words = (text or "").replace("\n", " ").split(" ")
    found = b"".join(map(memo.__getitem__, words)) + end_id.to_bytes(4, "little")
    return np.frombuffer(found, "<u4")


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given lengths.

    Sequences are numbered from 0. All hold ``capacity`` tokens, but for the last ones, whose lengths are falling
    powers of two.
    """
    total = sum(lengths)
    room = [capacity] * (total // capacity)
    rest = total % capacity
    room += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    used, costs = [0] * len(room), [0.0] * len(room)
    pieces = [(min(capacity, n - at), d, at) for d, n in enumerate(lengths) for at in range(0, n, capacity)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    heap = [(0.0, s) for s in range(len(room))]
    out = []

    def put(n: int, d: int, at: int, s: int) -> None:
        out.append((d, at, n, s, used[s]))
        used[s] += n
        room[s] -= n
        costs[s] += cost(n)
        if room[s]:
            heapq.heappush(heap, (costs[s], s))

    for n, d, at in pieces:
        passed = []
        while heap and room[heap[0][1]] < n:
            passed.append(heapq.heappop(heap))
        if heap:
            s = heapq.heappop(heap)[1]
            put(n, d, at, s)
            for x in passed:
                heapq.heappush(heap, x)
        else:  # no room for it whole: it fills the cheapest sequences that are open
            for x in passed:
                s = x[1]
                if n:
                    part = min(n, room[s])
                    put(part, d, at, s)
                    n, at = n - part, at + part
                else:
                    heapq.heappush(heap, x)
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS,
    id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False,
) -> DataFrame:
    """A row of SCHEMA per piece; ``with_ids`` adds the piece's ids (array of int).

    sequence_id counts up within a partition and holds the partition's number in its upper bits.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = pack([len(ids) for _, ids in held], capacity)
            filled: dict[int, int] = {}
            for _, _, n, s, _ in rows:
                filled[s] = filled.get(s, 0) + n
            columns = list(zip(*(
                (held[d][0], at, n, zlib.crc32(held[d][1][at : at + n]), len(held[d][1]), sequence + s, o,
                 filled[s])
                for d, at, n, s, o in rows
            ), strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                arrays.append(pa.array([held[d][1][at : at + n].astype(np.int32) for d, at, n, _, _ in rows], pa.list_(pa.int32())))
            sequence += len(filled)
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        waiting = 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py(), memo, end_id)
                held.append((i.as_py(), ids))
                waiting += len(ids)
                if waiting >= block_tokens:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    pair = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return pair.mapInArrow(releasing(run), SCHEMA + ", ids array<int>" * with_ids)
