"""Chat formatting by columnar byte assembly.

Turns arrive sorted by conversation; for a whole Arrow batch of them, numpy computes the lengths of all segments
(headers, escaped texts, trailers), their cumulative offsets and the scatter indices of the texts' bytes, and copies
everything into one preallocated buffer, whose slices are the formatted conversations. No string is built per turn.

Template: ``<s>[INST] text [/INST]`` for a user, `` text </s>`` for an assistant, ``<s>[SYS] text [/SYS]`` for a system
turn, ``<s>[NONE] text [/NONE]`` without a role and ``<s>[ROLE]name[=] text [/ROLE]`` for any other. Escape: a
backslash follows each ``<``, ``[`` and backslash of a text (and of a role's name), so no control string can appear in a
text, and dropping those backslashes gives the text back.

Defined results: a null text is empty; a null role reads back as the empty name. Rows of a null conv_id are one
conversation. Turns stand in order of turn, then role, then text, nulls first; repeated rows are turns of their own. A
conversation longer than a batch comes in consecutive parts, so memory is bounded by a batch, some ten times its bytes
(50 MB of text read back in one turn take less than 1 GB); one conversation is one task's work, however long. An empty table gives
no rows. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: role: (header, trailer). Fixed values of the template.
TEMPLATE = {
    "user": (b"<s>[INST] ", b" [/INST]"),
    "assistant": (b" ", b" </s>"),
    "system": (b"<s>[SYS] ", b" [/SYS]"),
    None: (b"<s>[NONE] ", b" [/NONE]"),
}
OTHER = (b"<s>[ROLE]", b"[=] ", b" [/ROLE]")
_SPECIAL = np.zeros(256, np.int64)
_SPECIAL[[ord("<"), ord("["), ord("\\")]] = 1

PARTS = "conv_id long, part int, n_turns int, text string, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    return re.sub(r"[<\[\\]", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[\\])\\", r"\1", text)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets, from 0."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, at: np.ndarray, lengths: np.ndarray, pieces: list[bytes]) -> None:
    """Copies pieces[i] to out[at[i]:]."""
    if len(at):
        source = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum(lengths) - lengths
        out[np.arange(len(source)) + np.repeat(at - begins, lengths)] = source


def assemble(roles: list[str | None], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, byte offsets of the turns, starts and ends of the texts) of formatted turns."""
    raw, offsets = _bytes_of(texts)
    extra = _SPECIAL[raw]
    upto = np.r_[0, np.cumsum(extra)]
    text_lengths = np.diff(offsets) + upto[offsets[1:]] - upto[offsets[:-1]]
    headers, trailers = [], []
    for r in roles:
        known = TEMPLATE.get(r)
        head, tail = known or (OTHER[0] + escape(r).encode("utf-8", "surrogatepass") + OTHER[1], OTHER[2])
        headers.append(head)
        trailers.append(tail)
    head_lengths = np.fromiter(map(len, headers), np.int64, len(headers))
    tail_lengths = np.fromiter(map(len, trailers), np.int64, len(trailers))
    turns = np.r_[0, np.cumsum(head_lengths + text_lengths + tail_lengths)]
    starts = turns[:-1] + head_lengths
    ends = starts + text_lengths
    out = np.full(int(turns[-1]), ord("\\"), np.uint8)  # what is not copied over are the escapes
    _scatter(out, turns[:-1], head_lengths, headers)
    _scatter(out, ends, tail_lengths, trailers)
    shift = np.repeat(starts - offsets[:-1] - upto[offsets[:-1]], np.diff(offsets))
    out[np.arange(len(raw)) + upto[:-1] + shift] = raw
    return out, turns, starts, ends


def format_conversations(
    turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """Rows of PARTS, a conversation's parts in order in one partition. Loss spans (code points of the part's text)
    cover the assistants' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at, starts, ends = assemble(roles, batch.column(2))
            points = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]  # code points before each byte
            heads = [i for i, c in enumerate(convs) if not i or c != convs[i - 1]]
            bounds = [*heads, len(convs)]
            offsets = at[bounds]
            text = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out))
            numbers, loss_a, loss_b = [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                part = part + 1 if convs[a] == last and not i else 0
                last = convs[a]
                numbers.append(part)
                own = np.array([k for k in range(a, b) if roles[k] == "assistant"], np.int64)
                base = points[at[a]]
                loss_a.append((points[starts[own]] - base).astype(np.int32))
                loss_b.append((points[ends[own]] - base).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([convs[i] for i in heads], pa.int64()), pa.array(numbers, pa.int32()),
                 pa.array(np.diff(bounds), pa.int32()), text.cast(pa.string()),
                 pa.array(loss_a, pa.list_(pa.int32())), pa.array(loss_b, pa.list_(pa.int32()))],
                names=[x.split()[0] for x in PARTS.split(", ")],
            )

    rows = turns.select(
        turns[conv_column].cast("long").alias("conv_id"), turns[role_column].alias("role"), turns[text_column].alias("text"),
        turns[turn_column].alias("turn"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, PARTS)


# Possessive: no state is kept to go back to, whatever a text's length. A body takes its trailer's blank, too.
_BODY = r"((?:[^<\[\\]++|[<\[\\]\\)*+)"
_TURN = re.compile(
    rf"<s>\[(INST|SYS|NONE)\] {_BODY}(?<= )\[/\1\]|<s>\[ROLE\]{_BODY}\[=\] {_BODY}(?<= )\[/ROLE\]| {_BODY}(?<= )</s>", re.S
)
_NAMES = {"INST": "user", "SYS": "system", "NONE": ""}


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m[1]:
            yield _NAMES[m[1]], unescape(m[2][:-1])
        elif m[5] is not None:
            yield "assistant", unescape(m[5][:-1])
        else:
            yield unescape(m[3]), unescape(m[4][:-1])
        at = m.end()


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_loss_spans long"
)


def digests(parts: DataFrame) -> DataFrame:
    """One row of DIGESTS for each conversation, all read back from the formatted parts as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        open_: dict | None = None
        done: list[tuple] = []

        def close() -> None:
            if open_:
                o = open_
                done.append((o["id"], o["n"], o["turns"].hexdigest(), o["chars"], o["loss"].hexdigest(), o["all"], o["spans"]))

        for batch in batches:
            for r in batch.to_pylist():
                if not r["part"]:
                    close()
                    open_ = {"id": r["conv_id"], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "spans": 0}
                text = r["text"]
                for role, said in read_back(text):
                    open_["n"] += 1
                    open_["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True):
                    said = unescape(text[a:b])
                    open_["chars"] += len(said)
                    open_["loss"].update(said.encode("utf-8", "surrogatepass"))
                    open_["spans"] += 1
                open_["all"] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, zip(*done, strict=True), strict=True)],
                names=names,
            )

    return parts.mapInArrow(run, DIGESTS)


def with_tricky(turns: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
