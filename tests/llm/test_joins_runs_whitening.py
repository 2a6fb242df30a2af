"""Whitening, periodic runs and the Jaccard join against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from marquee.llm import jaccard, periods, whitening
from marquee.llm.queries import op11_embedding_whitening, op12_periodic_runs, op13_ngram_jaccard

from .helpers import DOC_SCHEMA, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- whitening

NAN, INF = float("nan"), float("inf")


def brute_fit(vectors):
    """Distinct integer vectors with their exact covariance, for vectors of doubles."""
    x = {tuple(int(np.floor(256 * np.float64(c))) for c in v) for v in vectors}
    n, d = len(x), len(next(iter(x)))
    sums = [sum(v[i] for v in x) for i in range(d)]
    moment = [[sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x) for j in range(d)] for i in range(d)]
    return x, n, sums, np.array([[float(Fraction(m, n**3)) for m in row] for row in moment])


def check_whitening(rows, kept):
    """``rows`` of the operator for ``kept``, a list of (id, vector), against plain integers."""
    x, n, sums, covariance = brute_fit([v for _, v in kept])
    values, vectors = np.linalg.eigh(covariance)
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    for i, v in kept:
        own = [int(np.floor(256 * np.float64(c))) for c in v]
        found = by[i, sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))]
        for k, r in found.items():
            assert r.n == n and r.identity_error < 1e-9
            assert abs(r.explained - values[-k] / covariance.trace()) <= 1e-9 * r.explained
            y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(own, sums, strict=True)])
            assert abs(abs(r.whitened) - abs(y @ vectors[:, -k]) / values[-k] ** 0.5) < 1e-6
    whole = {}
    for r in rows:
        whole.setdefault((r.vec_id, r.deviation), []).append(r.component)
    return n, {len(v) for v in whole.values()}


def test_whitening_of_the_table(spark, sf_dir):
    rows = op11_embedding_whitening(spark, sf_dir).collect()
    kept = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert len(rows) == 4 * len(kept) and check_whitening(rows, kept)[1] == {4}
    x = {tuple(int(np.floor(256 * np.float64(c))) for c in v): i for i, v in kept}
    white = {(r.vec_id, r.component): r.whitened for r in rows}
    w = np.array([[white[i, k] for k in range(1, 5)] for i in x.values()])
    assert np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-9 and np.abs(w.mean(axis=0)).max() < 1e-9


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=5)], "x") for i in range(300)]
    rows += [(7, rows[3][1], "repeat"), (None, rows[4][1], "no id"), (900, rows[5][1], "copy"), (901, [0.0] * 5, "zero"), (901, [-0.0] * 5, "zero")]
    bad = [(902, None, ""), (903, [], ""), (904, [1.0, None, 0, 0, 0], ""), (905, [NAN, 0, 0, 0, 0], ""), (906, [0, 0, 0, 0, -INF], ""), (907, [1.0, 2.0], "short")]
    bad = [(i, None if v is None else [None if c is None else float(c) for c in v], s) for i, v, s in bad]
    table = spark.createDataFrame(rows + bad, "id long, v array<double>, x string")
    x = whitening.integer_vectors(table, "id", "v")
    got = whitening.whitened(x, whitening.fitted(x)).collect()
    assert len(got) == 4 * len(rows) and {r.vec_id for r in got} == {r[0] for r in rows}
    check_whitening(got, [(i, v) for i, v, _ in rows])
    for few, want in (([], 0), ([(1, [1.0, 2.0], "")] * 3, 0), ([(1, [1.0, 2.0], ""), (2, [1.0, 3.0], "")], 2)):
        x = whitening.integer_vectors(spark.createDataFrame(few, table.schema), "id", "v")
        assert whitening.whitened(x, whitening.fitted(x)).count() == want
    huge = spark.createDataFrame([(1, [1e300, 1.0], ""), (2, [-1e300, 2.0], ""), (3, [0.0, 1.0], "")], table.schema)
    x = whitening.integer_vectors(huge, "id", "v")
    assert {int(r.deviation) if r.deviation is not None else None for r in whitening.whitened(x, whitening.fitted(x)).collect() if r.vec_id == 3} == {256**2}


@pytest.mark.parametrize("offset", [0, 10**9])
def test_moments_are_double_double(offset):
    x = np.random.default_rng(3).integers(-300, 300, (2048, 6)) + offset
    n, sums = len(x), [int(v) for v in x.sum(axis=0)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    rest = np.array([float(Fraction(s, n) - Fraction(m)) for s, m in zip(sums, mean.tolist(), strict=True)])
    high, low = whitening.moments(*whitening._centred(x, mean, rest))
    for i in range(6):
        for j in range(6):
            exact = sum((Fraction(int(a)) - Fraction(sums[i], n)) * (Fraction(int(b)) - Fraction(sums[j], n)) for a, b in zip(x[:, i], x[:, j], strict=True))
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= Fraction(1, 10**26) * max(1, abs(exact), *(abs(Fraction(high[k, k])) for k in range(6)))


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=24, periods_=3):
    n, found = len(words), {}
    for p in range(1, n // periods_ + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, periods_ * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng, total = random.Random(1), 0
    for _ in range(600):
        n, k = rng.randint(0, 120), rng.choice([1, 2, 3, 30])
        words = [rng.randrange(k) for _ in range(n)]
        if n > 30 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, (n - a) // 3 + 2)
            words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
        least = rng.choice([3, 6, 24])
        got = periods.runs_of(np.array(words, np.int32), least, 3, rng.choice([1, 7, 1 << 20]))
        want = brute_runs(words, least)
        assert [tuple(r) for r in got.tolist()] == want
        total += len(want)
    assert total > 500


def brute_row(doc_id, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(kept))


def test_periodic_runs_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).where("length(text) < 20000 or text is null")
    more = [(i, "a b c d " * 9 + "x y " * k + "e f g " * 30, "en", "s", 1) for i, k in ((7, 1), (7, 20), (None, 13), (7, 20), (1, 0))]
    docs = docs.unionByName(spark.createDataFrame(more, DOC_SCHEMA)).withColumn("n_runs", docs["lang"]).withColumn("runs", docs["lang"])
    got = periods.run_digest(periods.periodic_runs(docs)).collect()
    want = [brute_row(r.doc_id, r.text, False) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 5
    assert periods.periodic_runs(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_periodic_runs_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = {r.doc_id: brute_row(r.doc_id, r.text, True) for r in docs.collect() if len(r.text or "") < 20_000}
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == docs.count() and {i: got[i] for i in short} == short
    assert sum(r[1] > 0 for r in short.values()) > 10


# ---------------------------------------------------------------- the Jaccard join


def brute_sets(rows):
    out = []
    for r in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_components(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = brute_sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def varied(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return " ".join(words)


def families(seed, many, texts):
    """Near copies of some texts, at all similarities around the threshold, under a common passage."""
    rng, rows = random.Random(seed), []
    common = [f"c{i}" for i in range(40)]
    for k in range(texts):
        base = [f"w{k}x{i}" for i in range(rng.randint(3, 90))]
        for _ in range(many):
            rows.append(varied(rng, base, rng.randint(0, max(1, len(base) // 25))) + (" " + " ".join(common) if rng.random() < 0.4 else ""))
    return rows


@pytest.mark.parametrize(("piece", "common"), [(1024, 100), (4, 3)])
def test_jaccard_components(spark, sf_dir, monkeypatch, piece, common):
    monkeypatch.setattr(jaccard, "PIECE", piece)
    monkeypatch.setattr(jaccard, "COMMON", common)
    docs = documents(spark, sf_dir).where("doc_id not in (9009)")
    rows = [(20_000 + i, t) for i, t in enumerate(families(piece, 25, 6))]
    rows += [(None, "only without id five six"), (None, "Only WITHOUT id five six"), (30_000, rows[0][1]), (30_000, "other words of one id here"), (30_001, None)]
    rows += [(30_002, "A b"), (30_003, "a B"), (30_004, "a b c"), (None, rows[30][1])]
    more = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC_SCHEMA)
    docs = docs.unionByName(more).withColumn("n", docs["lang"]).withColumn("component_id", docs["lang"]).repartition(3)
    got = jaccard.jaccard_components(docs).collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert jaccard.jaccard_components(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_jaccard_chain_and_one_text(spark):
    """A chain of neighbours at the threshold is one component; a third of all rows are copies."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(100)] + [(500 + i, "the same text for all of these") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC_SCHEMA)
    got = jaccard.jaccard_components(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert {r.component_id for r in got} == {0, 500}


def test_word_hashes():
    """As many words as Python finds, equal where the words are, whatever the blocks are cut at."""
    rng, seen = random.Random(4), {}
    texts = ["", " ", "a", " a", "a ", "x" * 200_000, "y" * 70_000 + " z " + "x" * 65_536 + "\t" + "q" * 65_535, " " * 70_000 + "end"]
    texts += ["".join(rng.choice("abAB é\u2003\x0b\n  ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts.append(" ".join(f"W{rng.randrange(5000)}" for _ in range(60_000)))
    for t in texts:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        hashes = jaccard.word_hashes(t.encode()).tolist()
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 5000


def test_bitmaps_bound_the_overlap():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.getrandbits(64) - 2**63 for _ in range(rng.randint(1, 300))])) for _ in range(20)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], np.array([rng.getrandbits(62) for _ in range(len(s) // 12)], np.int64)]) for s in sets]
    import pyarrow as pa

    n = np.array([len(s) for s in sets])
    side = n, jaccard._bitmaps(pa.array([jaccard.bitmap(s) for s in sets], pa.binary())), n
    found = {(int(a), int(b)): c for i, j, share in jaccard._near(side, side) for a, b, c in zip(i, j, share, strict=True)}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            inside = len(np.intersect1d(a, b))
            if 9 * inside >= 4 * (len(a) + len(b)):
                assert found[i, j] * (len(a) + len(b)) >= 2 * inside - 1e-6


def test_jaccard_query_has_all_rows(spark, sf_dir):
    assert op13_ngram_jaccard(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
