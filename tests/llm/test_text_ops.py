"""Quality, near-duplicates, packing and substring removal against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from marquee.llm import jaccard, packing, phrases, quality, simhash

from .helpers import DOC_SCHEMA, documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_base_columns(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in quality.repetition_quality(docs).collect()}
    for i, text in texts(docs).items():
        words = WORD.findall(text or "")
        n = len(words)
        windows = [tuple(words[k : k + 3]) for k in range(n - 2)]
        seen = Counter(windows)
        inside = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
        before, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in before
                before.add(line)
        failed = n < 50 or 100 * len(inside) > 50 * n
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        want = (n, sum(map(len, words)), symbols, dup, len(inside), failed)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, i
        assert not (r.base_failed and r.kept)
        for k in quality.DUP_NGRAM_LIMITS:  # the worst coverage, by brute force
            grams = [tuple(words[j : j + k]) for j in range(n - k + 1)]
            twice = Counter(grams)
            hit = {j + x for j, g in enumerate(grams) if twice[g] > 1 for x in range(k)}
            share = sum(len(words[j]) for j in hit) / max(1, sum(map(len, words)))
            assert share <= r.dup_ngram_coverage + 1e-12
            if share > quality.DUP_NGRAM_LIMITS[k]:
                assert not r.kept
    assert quality.repetition_quality(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_components(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts(docs).items()}
    want = brute_components(prints)
    assert {i: r.fp % 2**64 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_simhash_index_and_hot_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = set()
    for c in centres:  # clusters that share long patterns, chains of small steps
        x = int(c)
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 64))
            prints.add(x)
    prints = sorted(prints)
    index = simhash.GrayIndex(np.array(prints, np.uint64))
    q, found = index.matches(np.array(prints, np.uint64), 3)
    pairs = {(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3}
    assert set(zip(q.tolist(), found.tolist(), strict=True)) == pairs
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 8)  # groups are dealt again, several times
    rows = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(rows)).collect()}
    want = brute_components(dict(zip(prints, prints, strict=True)))
    sets = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    assert sets({x: roots.get(x, x) for x in prints}) == sets(want)


def test_packing_round_trip(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark, sf_dir)
    rows = packing.pack_documents(docs, path, block_tokens=30_000, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts(docs).items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == want[i]
        for r in pieces:
            ids = want[i][r.start : r.start + r.length]
            assert r.doc_tokens == len(want[i]) and r.ids == ids
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        total = sum(r.length for r in pieces)
        assert total <= 4096 and total & (total - 1) == 0 and {r.sequence_length for r in pieces} == {total}


def test_packing_balances_cost():
    lengths = [3000, 2900, 1500, 1400, 1200, 1096, 1000, 196, 4096, 9000, 1]
    rows = packing.pack(lengths)
    fill = Counter()
    for d, start, n, s, offset in rows:
        assert n > 0 and start + n <= lengths[d]
        fill[s] += n
    assert sum(fill.values()) == sum(lengths)
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())


def brute_removed(all_texts, span=35):
    words = {i: WORD.findall(t or "") for i, t in all_texts.items()}
    found = Counter(tuple(w[k : k + span]) for w in words.values() for k in range(len(w) - span + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - span + 1):
            if found[tuple(w[k : k + span])] > 1:
                gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_removal(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove_repeats(docs).collect()}
    assert got == brute_removed(texts(docs))
    assert phrases.remove_repeats(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_substring_removal_of_equal_and_null_ids(spark):
    a = " ".join(f"a{i}" for i in range(80))
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (None, a + " x"), (2, b), (2, b), (3, "q " * 36)]
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [
        (0, 81, 80), (1, 40, 40), (1, 80, 80), (2, 40, 40), (2, 40, 40), (3, 36, 36),
    ]


def test_automata_shards(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 3)
    shard = phrases.Shard(3)
    shard.lend(b"a b c d", [(0, 7)])
    shard.lend(b"x d e f g", [(1, 8), (2, 8)])
    assert len(shard.automata) == 2 and phrases.runs([(3, 1), (1, 1), (2, 1), (4, 2), (6, 2)]) == [(1, 3), (4, 4), (6, 6)]
    assert shard.located(b"a b c d e f g a b c") == [0, 10]
    assert shard.located(b"x b c d e f g q") == [3, 7]
    assert shard.located(b"x b c") == []


def test_substring_removal_of_boilerplate(spark, monkeypatch):
    """A passage in a third of all documents, in ever different surroundings, in shards of any size."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    boilerplate = list(rng.choice(vocabulary, 45))
    rows = []
    for i in range(90):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 160))))
        if i % 3 == 0:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = boilerplate[: int(rng.integers(30, 46))]
        if i % 10 == 9:  # a part of another document, and a change in it
            words += rows[i - 1][1].split()[5:70]
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removed(dict(rows))
    assert sum(n for _, n, _ in want.values()) > 1000
    for words, chunks in ((100, 7), (1, 1)):
        monkeypatch.setattr(phrases, "SHARD_WORDS", words)
        monkeypatch.setattr(phrases, "SHARD_CHUNKS", chunks)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove_repeats(frame).collect()}
        assert got == want


def test_similar_documents(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    base = [list(rng.choice(vocabulary, 300)) for _ in range(40)]
    rows = []
    for i, words in enumerate(base):
        rows.append((10 * i, " ".join(words)))
        for k in (1, 2, 3):  # one to three changed words of 300: similarities of about 0.97 to 0.9
            copy = list(words)
            for at in rng.choice(300, k, replace=False):
                copy[at] = "changed"
            rows.append((10 * i + k, " ".join(copy).upper()))
    rows += [(9001, None), (9002, ""), (9003, "one"), (9004, "one"), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (1024, 3):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        got = simhash.similar_documents(frame).collect()
        assert len(got) == len(rows)
        wrong = sum(r.component_id != r.doc_id // 10 * 10 for r in got if r.doc_id is not None and r.doc_id < 9000)
        assert wrong <= 4
        odd = {r.doc_id: r.component_id for r in got if r.doc_id is None or r.doc_id > 9000}
        assert odd == {9001: 9001, 9002: 9001, 9003: 9003, 9004: 9003, None: 0}
    assert simhash.similar_documents(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def mutated_families(seed: int, families: int, each: int, words: int = 60, most: int = 4):
    """Texts of a few changed words each: pairs on both sides of 0.8, where a fingerprint cannot tell them."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    rows = []
    for _ in range(families):
        base = list(rng.choice(vocabulary, words))
        for _ in range(each):
            copy = list(base)
            for at in rng.choice(words, rng.integers(0, most + 1), replace=False):
                copy[at] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(copy)))
    return rows


def brute_similar_components(rows):
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            inside = len(sets[i] & sets[k])
            if 10 * inside >= 8 * (len(sets[i]) + len(sets[k]) - inside):
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_similar_documents_are_those_of_all_pairs(spark):
    rows = mutated_families(3, 40, 8)  # many pairs just under and over 0.8: none is missed, none is added
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_similar_components(rows)
    assert 40 < len(set(want.values())) < len(rows)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()} == want


def test_similar_documents_in_large_groups(spark, monkeypatch):
    rows = []
    for f in range(3):  # chains: only neighbours are similar, and all share a long end, so they meet in large groups
        first, then = ([f"{x}{f}w{k}" for k in range(400)] for x in "ab")
        rows += [(100 * f + i, " ".join(then[: 30 * i] + first[30 * i :])) for i in range(13)]
    rows += [(1000 + i, text) for i, text in mutated_families(4, 1, 60, most=8)]
    want = brute_similar_components(rows)
    assert all(want[100 * f + i] == 100 * f for f in range(3) for i in range(13)) and len(set(want.values())) > 4
    for name, value in (("COMMON", 4), ("PIECE", 5)):
        monkeypatch.setattr(jaccard, name, value)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()} == want
