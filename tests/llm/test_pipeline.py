"""The pipeline's stages, each against what it was given."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from marquee.llm import jaccard, simhash, toxicity
from marquee.llm.common import load, saved
from marquee.llm.queries import toxicity_grammar

from .test_span_ops import brute_pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    out = [load(spark, sf_dir, "documents")]
    for name, stage in pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], sf_dir), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_columns(tables):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    for df in tables[:-1]:
        assert set(df.columns) == set(pipeline.COLUMNS)


def test_toxic_go(spark, sf_dir, tables):
    before, after = rows(tables[0]), rows(tables[1])
    grammar = toxicity_grammar(spark, tables[0], sf_dir)
    grammar.prepared()
    assert after.keys() == {i for i, r in before.items() if grammar.score(r.text) < 0.5}
    assert all(after[i] == before[i] for i in after)
    assert toxicity.scores(tables[1], grammar).where("score >= 0.5").count() == 0


def test_one_of_each_group_stays(tables):
    before, after = rows(tables[1]), rows(tables[2])
    assert after.keys() <= before.keys() and all(after[i] == before[i] for i in after)
    smallest = {}
    for i, r in sorted(before.items()):
        smallest.setdefault(r.text, i)
    assert all(smallest[r.text] == i for i, r in after.items())
    sets = {i: shingles(r.text) for i, r in before.items()}
    for i in before.keys() - after.keys():  # what went is like something that went or stayed
        assert any(len(sets[i] & s) > 0.4 * len(sets[i] | s) for k, s in sets.items() if k != i), i


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_personal_data_goes(tables):
    before, after = rows(tables[2]), rows(tables[3])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not brute_pii(r.text or "") and r.n_chars == (len(r.text) if r.text is not None else None)
        if not brute_pii(before[i].text or "") and "<PII>" not in (r.text or ""):
            assert r.text == before[i].text
    assert any("<EMAIL>" in (r.text or "") for r in after.values())


def test_mix_follows_targets(tables):
    size, longest = Counter(), 0
    for r in tables[3].collect():
        n = len(WORD.findall(r.text or ""))
        size[r.source] += n
        longest = max(longest, n)
    taken = Counter()
    for r in tables[4].collect():
        taken[r.source] += len(WORD.findall(r.text or ""))
    from .test_media_chat_toxic_mix import brute_targets

    want = brute_targets(size)
    assert all(abs(taken[s] - want[s]) <= longest for s in size)  # one order, cut once
    assert sum(taken.values()) == sum(size.values())


def test_packed(tables):
    packed = tables[5].collect()
    by_doc = Counter()
    for r in packed:
        by_doc[r.doc_id] += r.length
    assert by_doc.keys() == {r.doc_id for r in tables[4].collect()}
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())


def test_run_equals_stages(spark, sf_dir, tables):
    assert pipeline.run(spark, sf_dir).count() == tables[5].count()


def test_odd_rows_go_through(spark, sf_dir):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None),
            (3, "a@b.co " * 3, "en", "s", 1), (3, "a@b.co " * 3, "en", "s", 1), (None, "call +1 555 010 9999 now", None, "t", 9),
            (5, "word " * 50_000, "en", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(9)).withColumn("same", F.lit("x"))
    kept = [docs, docs.limit(0)]
    for name, stage in pipeline.STAGES:
        kept = [saved(stage(spark, d, sf_dir), name) for d in kept]
        assert kept[1].count() == 0
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in kept[0].collect()) == [0, 1, 3, 5]
        if name == "pii":
            assert {r.text for r in kept[0].collect()} >= {"<EMAIL> " * 3, "call <PHONE> now"}
        if name == "mixing":
            assert sum(len((r.text or "").split()) for r in kept[0].collect()) == 3 + 3 + 50_000
    assert kept[0].count() > 0


def test_only_similar_documents_go(spark, sf_dir, tables):
    before, after = rows(tables[1]), rows(tables[2])
    sets = {i: shingles((r.text or "").lower()) for i, r in before.items()}

    def similar(i, k):
        inside = len(sets[i] & sets[k])
        return 10 * inside >= 8 * (len(sets[i]) + len(sets[k]) - inside)

    for i in before.keys() - after.keys():
        assert any(similar(i, k) for k in before if k != i), i
    assert not any(similar(i, k) for i in after for k in after if i < k)


def test_shared_passages_are_no_near_duplicates(spark, sf_dir):
    passage = " ".join(f"p{k}" for k in range(204))  # 200 shingles; with 40 or 20 own words, 240 and 220
    docs = [(i, passage + "".join(f" own{i}x{k}" for k in range(40))) for i in range(60)]  # 200 of 280: 0.71
    docs += [(100 + i, passage.replace("p", "q") + "".join(f" own{i}x{k}" for k in range(25))) for i in range(2)]  # 200 of 250: 0.8
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, frame, sf_dir).collect()}
    assert kept == {*range(60), 100}


def test_rows_of_one_id_are_told_apart(spark, sf_dir):
    words = lambda x: " ".join(f"{x}{k}" for k in range(30))
    docs = [(7, words("a")), (7, words("b")), (7, words("b") + " end"), (42, words("c")), (None, None), (None, words("d")), (9, words("d"))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, frame, sf_dir).select("doc_id", "text").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(7, words("a")), (42, words("c")), (None, None), (9, words("d")), *{(r.doc_id, r.text) for r in kept if r.text in (words("b"), words("b") + " end")}}
    assert len(kept) == 5


def test_fingerprints_link_what_sets_confirm(spark, sf_dir, monkeypatch):
    """Without the exact comparison the stage still finds what SimHash links, and only that which whole sets confirm."""
    words = lambda x, n: [f"{x}{k}" for k in range(n)]
    base = words("a", 3000)
    changed = next(t for k in range(0, 3000, 7) if 0 < (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(t := " ".join([*base[:k], "else", *base[k + 1 :]]))).bit_count() <= 3)
    loud = "say this again and again " * 200
    docs = [" ".join(base), changed, loud + " ".join(words("b", 30)), loud + " ".join(words("c", 30)), "alone"]
    assert (simhash.fingerprint(docs[2]) ^ simhash.fingerprint(docs[3])).bit_count() <= 3
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    none = lambda *a, **b: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(jaccard, "first_pairs", none)
    monkeypatch.setattr(jaccard, "rest_pairs", none)
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, frame, sf_dir).collect()} == {0, 2, 3, 4}
