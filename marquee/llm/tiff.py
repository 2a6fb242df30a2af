"""Media columns: TIFF files, one row per page.

The reader walks a file's image directories and decodes strips or tiles that are stored plainly, or packed by PackBits,
LZW or deflate, undoes the horizontal predictor and gives the samples of each page. The writer makes such files.

Defined results: a null or empty content, a broken header, a directory that points outside the file or one already
seen, unknown compressions and damaged data give one row with page null (or the page's number) and the reason in
``error``; pages before it are kept. Only 8-bit samples in chunky layout are decoded. Rows are read one by one: nothing
is shuffled, and memory is bounded by one file. Columns named in ``carry`` pass through to every page's row.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tags and codes of the format: fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZES = {1: 1, 3: 2, 4: 4}
CLEAR, END, LZW_LIMIT = 256, 257, 4094
#: Samples that a byte of stored data can stand for at most (LZW's longest run in the bits of a code), generously.
EXPANSION = 4096


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    compression: int
    tiled: bool
    predictor: int
    pixels: np.ndarray  # (height, width, samples) of uint8


# ---------------------------------------------------------------- codecs


def packbits_encode(row: bytes) -> bytes:
    out, n, at = bytearray(), len(row), 0
    data = np.frombuffer(row, np.uint8)
    edges = np.r_[0, np.flatnonzero(data[1:] != data[:-1]) + 1, n]
    lengths = np.diff(edges)
    for i in np.flatnonzero(lengths >= 3).tolist():
        start, length = int(edges[i]), int(lengths[i])
        _literal(out, row[at:start])
        at = start + length
        while length > 1:
            k = min(length, 128)
            out += bytes((257 - k, row[start]))
            length -= k
        if length:
            out += bytes((0, row[start]))
    _literal(out, row[at:])
    return bytes(out)


def _literal(out: bytearray, data: bytes) -> None:
    for a in range(0, len(data), 128):
        part = data[a : a + 128]
        out.append(len(part) - 1)
        out += part


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        h = data[at]
        if h < 128:
            out += data[at + 1 : at + 2 + h]
            at += h + 2
        elif h > 128:
            out += data[at + 1 : at + 2] * (257 - h)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that grow one entry early, as the format asks."""
    out, held, bits = bytearray(), CLEAR, 9
    table: dict[int, int] = {}
    following, width, prefix = 258, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        held = held << width | prefix
        bits += width
        table[key] = following
        following += 1
        prefix = byte
        if following > LZW_LIMIT:
            held = held << width | CLEAR
            bits += width
            table.clear()
            following, width = 258, 9
        elif following >= 1 << width:
            width += 1
        if bits > 256:
            whole, bits = bits // 8, bits % 8
            out += (held >> bits).to_bytes(whole, "big")
            held &= (1 << bits) - 1
    if prefix >= 0:
        held = held << width | prefix
        bits += width
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    held = held << width | END
    bits += width
    pad = -bits % 8
    out += (held << pad).to_bytes((bits + pad) // 8, "big")
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, width, last = first.copy(), [], 9, None
    at, held, bits, length = 0, 0, 0, 0
    while True:
        if bits < width:
            more = data[at : at + 32]
            if not more:
                break
            at += len(more)
            held = held << 8 * len(more) | int.from_bytes(more, "big")
            bits += 8 * len(more)
            if bits < width:
                break
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            table, width, last = first.copy(), 9, None
            continue
        if code == END:
            break
        if last is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of order")
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        last = entry
        length += len(entry)
        if length >= size:  # what follows is of no use, and may be endless in a damaged file
            break
    if length < size:
        raise ValueError("LZW data ends early")
    return b"".join(out)


def packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """A strip's or tile's samples (rows, width, samples), stored."""
    if predictor == 2:
        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
    if compression == PACKBITS:
        return b"".join(packbits_encode(row.tobytes()) for row in block)
    raw = block.tobytes()
    return {NONE: lambda x: x, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}[compression](raw)


def unpacked(data: bytes, rows: int, width: int, samples: int, compression: int, predictor: int) -> np.ndarray:
    size = rows * width * samples
    if size > EXPANSION * len(data):
        raise ValueError("more samples than the stored data can hold")
    if compression == NONE:
        raw = data
    elif compression == LZW:
        raw = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(data, size)
    elif compression == PACKBITS:
        raw = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(raw) < size:
        raise ValueError("a strip or tile is short")
    block = np.frombuffer(raw, np.uint8, size).reshape(rows, width, samples)
    if predictor == 2:
        block = np.cumsum(block, axis=1, dtype=np.uint8)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return block


# ---------------------------------------------------------------- files


def write(pages: list[np.ndarray], compression: int, predictor: int = 1, tile: int = 0, rows_per_strip: int = 64) -> bytes:
    """A little-endian file of 8-bit pages (height, width, samples), in strips, or in tiles of tile x tile."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width, samples = page.shape
        blocks = []
        if tile:
            down, across = -(-height // tile), -(-width // tile)
            full = np.zeros((down * tile, across * tile, samples), np.uint8)
            full[:height, :width] = page
            blocks = [full[y * tile : y * tile + tile, x * tile : x * tile + tile] for y in range(down) for x in range(across)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            data = packed(block, compression, predictor)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        layout = [(TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        if not tile:
            layout = [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        entries = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), *layout,
        ]
        out += b"\0" * (len(out) % 2)
        values = {}
        for tag, kind, numbers in entries:
            data = struct.pack(f"<{len(numbers)}{'H' if kind == 3 else 'I'}", *numbers)
            if len(data) > 4:
                values[tag] = struct.pack("<I", len(out))
                out += data + b"\0" * (len(data) % 2)
            else:
                values[tag] = data.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for tag, kind, numbers in sorted(entries):
            out += struct.pack("<HHI", tag, kind, len(numbers)) + values[tag]
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read(content: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; ValueError where it is broken."""
    if len(content) < 8 or content[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("no header")
    order = "<" if content[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", content, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", content, at)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
                if kind not in TYPE_SIZES:
                    continue
                size = TYPE_SIZES[kind] * count
                where = at + 10 + 12 * i
                if size > 4:
                    (where,) = struct.unpack_from(order + "I", content, where)
                tags[tag] = struct.unpack_from(f"{order}{count}{'.BxHI'[kind]}", content, where)
            (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * n)
            page = _page(content, tags)
        except (struct.error, LookupError, ArithmeticError, TypeError, MemoryError, zlib.error) as e:
            raise ValueError(f"damaged directory or data: {e}") from None
        yield page


def _page(content: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only 8-bit samples in chunky layout are decoded")
    tiled = TILE_OFFSETS in tags
    across = tags[TILE_WIDTH][0] if tiled else width
    down = tags[TILE_HEIGHT][0] if tiled else min(one(ROWS_PER_STRIP, height), height)
    offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    if min(width, height, samples, across, down) < 1:
        raise ValueError("a size is 0")
    if width * height * samples > EXPANSION * len(content):
        raise ValueError("more samples than the file can hold")
    columns = -(-width // across)
    if min(len(offsets), len(counts)) < columns * -(-height // down):
        raise ValueError("strips or tiles are missing")
    pixels = np.empty((height, width, samples), np.uint8)
    for k in range(columns * -(-height // down)):
        y, x = k // columns * down, k % columns * across
        rows = down if tiled else min(down, height - y)
        if offsets[k] + counts[k] > len(content):
            raise ValueError("data lies outside the file")
        block = unpacked(content[offsets[k] : offsets[k] + counts[k]], rows, across, samples, compression, predictor)
        pixels[y : y + down, x : x + across] = block[: height - y, : width - x]
    return Page(width, height, samples, compression, tiled, predictor, pixels)


# ---------------------------------------------------------------- DataFrames

PAGE_COLUMNS = (
    "file_bytes long, file_sha256 string, page int, width int, height int, samples int, compression int, tiled boolean, "
    "predictor int, pixels binary, mean double, deviation double, entropy double, thumb string, error string"
)


def thumb(pixels: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 areas is brighter than the next one."""
    grey = pixels.mean(axis=2)
    rows = np.linspace(0, grey.shape[0], 9)[:-1].astype(int)
    columns = np.linspace(0, grey.shape[1], 9)[:-1].astype(int)
    areas = np.add.reduceat(np.add.reduceat(grey, np.maximum.accumulate(rows), axis=0), columns, axis=1)
    flat = areas.ravel()
    return np.packbits(flat > np.roll(flat, -1)).tobytes().hex()


def figures(pixels: np.ndarray) -> tuple[float, float, float, str]:
    counts = np.bincount(pixels.ravel(), minlength=256)
    n = int(counts.sum())
    if not n:
        return 0.0, 0.0, 0.0, "0" * 16
    values = np.arange(256)
    mean = float(counts @ values) / n
    spread = math.sqrt(max(0.0, float(counts @ (values * values)) / n - mean * mean))
    p = counts[counts > 0] / n
    return mean, spread, float(-(p * np.log2(p)).sum()), thumb(pixels)


def pages(files: DataFrame, content_column: str = "content", carry: list[str] | None = None) -> DataFrame:
    """One row per page: the columns of ``carry``, then PAGE_COLUMNS. A carried column named like one of these is named
    ``carried_`` and its name."""
    carry = carry or []
    taken = {x.split()[0] for x in PAGE_COLUMNS.split(", ")}
    fields = [T.StructField(f"carried_{c}" if c in taken else c, files.schema[c].dataType) for c in carry]
    schema = T.StructType(fields + T.StructType.fromDDL(PAGE_COLUMNS).fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    kinds = [f.type for f in arrow][len(carry) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows, size = [], [], 0

            def flush() -> pa.RecordBatch:
                kept = [batch.column(i).take(pa.array(source, pa.int64())) for i in range(len(carry))]
                found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays(kept + found, names=schema.names)

            for i in range(batch.num_rows):
                content = batch.column(len(carry))[i].as_py() or b""
                about = (len(content), hashlib.sha256(content).hexdigest())
                number = 0
                try:
                    for p in read(content):
                        raw = p.pixels.tobytes()
                        rows.append((*about, number, p.width, p.height, p.samples, p.compression, p.tiled, p.predictor, raw, *figures(p.pixels), None))
                        source.append(i)
                        size += len(raw)
                        number += 1
                    if not number:
                        raise ValueError("no pages")
                except ValueError as e:
                    rows.append((*about, number or None, *[None] * (len(kinds) - 4), str(e)))
                    source.append(i)
                if size > 8 << 20:
                    yield flush()
                    source, rows, size = [], [], 0
            if rows:
                yield flush()

    return files.select(*carry, files[content_column]).mapInArrow(run, schema)


# ---------------------------------------------------------------- texts as media

ROW_BYTES, PAGE_ROWS = 192, 256


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the bytes padded by blanks to a positive multiple of ROW_BYTES)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES)


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, content): each text's payload as a file of 64-pixel rows of three samples. The payload's number
    of rows picks how it is stored, so that all of the format's codings are in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [(LZW, 1, 0), (DEFLATE, 2, 32), (PACKBITS, 1, 0)]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, files = [], []
                for text in part.column(1):
                    n, payload = payload_of(text.as_py())
                    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
                    split = [image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)]
                    sizes.append(n)
                    files.append(write(split, *ways[len(image) % 3]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())],
                    names=["doc_id", "n_bytes", "content"],
                )

    pair = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return pair.mapInArrow(run, "doc_id long, n_bytes long, content binary")


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_pages long"
)


def digests(paged: DataFrame) -> DataFrame:
    """One row of DIGESTS per file of ``pages(text_media(...), carry=["doc_id", "n_bytes"])``: consecutive page rows are
    folded as they stream by, so the pages are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        kinds = [pa.int64() if " long" in x else pa.string() for x in DIGESTS.split(", ")]
        o: dict | None = None
        done: list[tuple] = []

        def close() -> None:
            if o:
                feature = f"{o['n']}p;" + ";".join(o["feature"])
                done.append((o["id"], o["n_bytes"], o["size"], o["sha"].hexdigest(), zlib.crc32(o["tail"]), o["bytes"], o["file"], feature, o["n"]))

        for batch in batches:
            for r in batch.to_pylist():
                if r["error"]:
                    raise ValueError(f"document {r['doc_id']}: {r['error']}")
                if not r["page"]:
                    close()
                    o = {"id": r["doc_id"], "n_bytes": r["n_bytes"], "size": 0, "sha": hashlib.sha256(), "tail": b"", "bytes": r["file_bytes"], "file": r["file_sha256"], "feature": [], "n": 0}
                o["sha"].update(r["pixels"])
                o["size"] += len(r["pixels"])
                o["tail"] = (o["tail"] + r["pixels"][-16:])[-16:]
                o["n"] += 1
                o["feature"].append(f"{r['mean']:.4f},{r['deviation']:.4f},{r['entropy']:.4f},{r['thumb']}")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return paged.mapInArrow(run, DIGESTS)
