"""Chat formatting, TIFF pages, toxicity and mixing against plain Python, round trips and held-out rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.llm import chat, mixing, tiff, toxicity

from .helpers import DOC_SCHEMA, documents, texts

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None, "tool", "a<[\\"]), st.text("<>[]/\\sINST é😀=\n "))))
def test_chat_round_trip(turns):
    import pyarrow as pa

    out, at, starts, ends = chat.assemble([r for r, _ in turns], pa.array([t for _, t in turns], pa.string()))
    text = out.tobytes().decode()
    assert list(chat.read_back(text)) == [(r or "", t) for r, t in turns]
    for (_, t), a, b in zip(turns, starts, ends, strict=True):
        assert chat.unescape(out[a:b].tobytes().decode()) == t
    spoken = "".join(chat.escape(t) for _, t in turns)
    assert not any(c in spoken for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chat_query(spark, sf_dir):
    odd = [(-1, 2, "user", None), (-1, 1, None, "x"), (-1, 2, "user", None), (None, 1, "assistant", "a"), (-2, None, "tool", "<s>")]
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long"), "role", "text")
    turns = chat.with_tricky(turns.unionByName(spark.createDataFrame(odd, TURNS)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # conversations span batches
    try:
        got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(list)
    for r in turns.collect():
        want[r.conv_id].append(r)
    assert got.keys() == want.keys()
    for c, rows in want.items():
        rows.sort(key=lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, x) for x in (r.turn, r.role, r.text)))
        said = [(r.role or "", r.text or "") for r in rows]
        loss = "".join(t for r, t in said if r == "assistant")
        g = got[c]
        assert g.n_turns == len(rows) and g.loss_chars == len(loss)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


# ---------------------------------------------------------------- TIFF


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=6000), st.integers(0, 3))
def test_codecs_round_trip(data, repeat):
    data = data * (1 + repeat) + bytes(repeat * 300)
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_known_bytes():
    # the example of the format's specification: 7 7 7 8 8 7 7 6 6 -> Clear 7 258 8 8 258 6 6 End
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(raw) == data and tiff.lzw_decode(data, 9) == raw


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 32])
def test_pages_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 9, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (70, 33, 3), (200, 64, 4))]
    found = list(tiff.read(tiff.write(pages, compression, predictor, tile)))
    assert [p.pixels.shape for p in found] == [p.shape for p in pages]
    assert all((a == b.pixels).all() for a, b in zip(pages, found, strict=True))
    assert {(p.compression, p.predictor, p.tiled) for p in found} == {(compression, predictor, bool(tile))}


def test_big_endian_and_broken_files(spark):
    big = b"MM\0*" + struct.pack(">I", 10) + b"\x05\x06" + struct.pack(">H", 5)
    for tag, kind, value in ((256, 3, 2), (257, 3, 1), (258, 3, 8), (273, 4, 8), (279, 4, 2)):
        big += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    big += b"\0\0\0\0"
    (page,) = tiff.read(big)
    assert page.pixels.ravel().tolist() == [5, 6]
    good = tiff.write([np.zeros((4, 4, 1), np.uint8)] * 2, tiff.LZW)
    loop = bytearray(good)
    (first,) = struct.unpack_from("<I", good, 4)
    struct.pack_into("<I", loop, first + 2 + 12 * struct.unpack_from("<H", good, first)[0], first)
    files = [(1, good, "k"), (2, None, None), (3, b"", None), (4, b"II*\0", None), (5, good[:60], None), (6, bytes(loop), None), (7, b"II*\0\0\0\0\0", None)]
    frame = spark.createDataFrame(files, "doc_id long, content binary, page string")
    got = defaultdict(list)
    for r in tiff.pages(frame, carry=["doc_id"]).collect():
        got[r.doc_id].append((r.page, r.error is None))
    assert got[1] == [(0, True), (1, True)]
    assert got[6] == [(0, True), (1, False)]
    assert all(got[i] == [(None, False)] for i in (2, 3, 4, 5, 7))
    assert tiff.pages(frame.limit(0), carry=["doc_id"]).count() == 0
    assert {r.carried_page for r in tiff.pages(frame, carry=["page"]).collect()} == {"k", None}


def test_text_media(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in tiff.digests(tiff.pages(tiff.text_media(docs), carry=["doc_id", "n_bytes"])).collect()}
    files = {r.doc_id: r.content for r in tiff.text_media(docs).collect()}
    for i, t in texts(docs).items():
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        g = got[i]
        assert (g.n_bytes, g.payload_bytes) == (len(raw), len(payload))
        assert g.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert g.tail_crc32 == zlib.crc32(payload[-16:])
        assert (g.media_bytes, g.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())


# ---------------------------------------------------------------- toxicity


def test_grammar_kinds():
    g = toxicity.Grammar({"idiot": 2.0, "idiotic": 0.0}, {"moro": 3.0}, -1.0, [1.5, 3.0, 0.3, 0.1, 1.0]).prepared()
    kind = lambda t: {k: w for k, w in zip(toxicity.KINDS, np.expm1(g.features(t)).round(6).tolist(), strict=True) if w}
    assert kind("You are such an idiot.") == {"insult": 2.0}
    assert kind("What an idiot!") == {"bare": 2.0}
    assert kind("Well, you are not an idiot") == {"negated": 2.0} == kind("you aren’t an idiot")
    assert kind("They said you moron. Moronic!") == {"bare": 3.0, "reported": 3.0}
    assert kind('He is "an idiot" and an idiot') == {"reported": 2.0, "bare": 2.0}
    assert kind("an idiotic idea; the idiots") == {} == kind("you kill") == kind("it will kill time")
    assert kind("I will kill you") == {"threat": 3.0} and kind("I will not kill you") == {"negated": 3.0}
    assert g.score("I will kill you") > 0.9 > g.score("you idiot") > g.score("an idiot") > g.score("you are not an idiot")
    assert g.score("they will kill time") == g.score(None) == g.score("")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["xx", "idiot", "kill", "will", "you", "not", "says", '"'])))
def test_composition_equals_path_search(words):
    """The composed machine against a search over each match's surroundings."""
    g = toxicity.Grammar({"idiot": 2.0}, {}, 0.0, [0.0] * 5).prepared()
    want, reach = Counter(), toxicity.REACH
    for i, w in enumerate(words):
        if w not in ("idiot", "kill"):
            continue
        before, after = words[max(0, i - reach) : i], words[i + 1 : i + 1 + reach]
        aimed = "you" in before or "you" in after
        if w == "kill":
            will = max((k for k, x in enumerate(before) if x == "will"), default=None)
            if will is None or not ("you" in after or "you" in before[will:]):
                continue
        reported = False
        for x in words[:i]:
            reported = "saying" if x == "says" or reported == "saying" else not reported if x == '"' else reported
        kind = "threat" if w == "kill" else "insult" if aimed else "bare"
        kind = "reported" if reported else "negated" if "not" in before else kind
        want[kind] += 2.0 if w == "idiot" else toxicity.HARM_WEIGHT
    assert dict(zip(toxicity.KINDS, g.clause(" ".join(words)), strict=True)) == {k: want[k] for k in toxicity.KINDS}


def test_toxicity_trains_on_documents(spark, monkeypatch):
    """The bound counts documents: repeated rows and ids do not crowd others out."""
    from marquee.llm import toxicity as t

    rows = [(1, "a b c")] * 40 + [(1, "d e f")] + [(i, f"text {i}") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    seen = []
    keep = t.saved
    monkeypatch.setattr(t, "saved", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    t.learn(docs, labels, train_rows=7)
    assert dict(seen)["toxicity-train"].count() == 7


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.scores(docs, grammar).join(labels.where(toxicity.held_out()), "doc_id").select("score", "toxic").collect()
    wrong = sum((r.score >= 0.5) != (r.toxic == 1) for r in scored)
    assert wrong <= 0.06 * len(scored)
    assert all(0 <= r.score <= 1 for r in scored)


def test_toxicity_odd_tables(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    none = toxicity.learn(docs, labels)
    assert {round(r.score, 3) for r in toxicity.scores(docs, none).select("score").collect()} == {0.0}
    some = toxicity.learn(docs, spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.scores(docs.limit(0), some).count() == 0
    assert min(r.score for r in toxicity.scores(docs, some).select("score").collect()) > 0.99


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    budget, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level >= cap * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_mix(spark, sf_dir):
    docs = documents(spark, sf_dir)
    mix, _ = mixing.mixed(docs)
    order = mixing.in_order(mix).collect()
    assert [r.virtual_finish for r in order] == sorted(r.virtual_finish for r in order)
    # one cut: all but the last copy are whole, and together they are the budget
    assert all(r.taken == r.size for r in order[:-1]) and 0 < order[-1].taken <= order[-1].size
    assert sum(r.taken for r in order) == sum(len(WORD.findall(t or "")) for t in texts(docs).values())
    rows = mixing.taken_words(docs).collect()
    by_text = {r.doc_id: r for r in docs.collect()}
    size, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(WORD.findall(by_text[r.doc_id].text or "")) and r.source == by_text[r.doc_id].source
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(size)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
    longest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    again = {r.doc_id: r.taken for r in mixing.taken_words(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_of_odd_tables(spark):
    rows = [(None, "a b", "x", None, 0), (None, "a b", "x", None, 0), (1, None, "x", "s", 0), (1, "c " * 50, "x", "s", 0)]
    got = mixing.taken_words(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 54
    assert mixing.taken_words(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    empty = mixing.taken_words(spark.createDataFrame([(1, "", "x", "s", 0)], DOC_SCHEMA)).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)]


# ---------------------------------------------------------------- odd input


def test_damaged_tiff_gives_error_rows(spark):
    """Random bytes of valid files changed: no crash, whatever the reader meets."""
    rng = np.random.default_rng(9)
    pages = [rng.integers(0, 255, (20, 30, 1), dtype=np.uint8)]
    kinds = [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE]
    valid = [tiff.write(pages, c, predictor=1, tile=16 * (i % 2)) for i, c in enumerate(kinds)]
    for content in valid:
        for _ in range(1500):
            broken = bytearray(content)
            at = rng.integers(len(content) - 180, len(content), 3) if rng.random() < 0.7 else rng.integers(0, len(content), 3)
            for i in at:
                broken[i] = rng.integers(0, 256)
            try:
                for page in tiff.read(bytes(broken)):
                    assert page.pixels.size > 0
            except ValueError:
                pass
    size = tiff.write(pages, tiff.NONE)
    for tag, value in ((tiff.WIDTH, 0), (tiff.ROWS_PER_STRIP, 0), (tiff.SAMPLES, 0), (tiff.HEIGHT, 1 << 31)):
        (at,) = struct.unpack_from("<I", size, 4)
        broken = bytearray(size)
        for i in range(struct.unpack_from("<H", size, at)[0]):
            if struct.unpack_from("<H", size, at + 2 + 12 * i)[0] == tag:
                struct.pack_into("<I", broken, at + 10 + 12 * i, value)
        with pytest.raises(ValueError):
            list(tiff.read(bytes(broken)))


def test_long_turns_take_little_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "word < [ \\ " * 1_000_000
    whole = f"<s>[INST] {chat.escape(text)} [/INST]"
    assert next(chat.read_back(whole)) == ("user", text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB, for 11 MB of text
