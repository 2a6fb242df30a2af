"""The registered queries: their columns, and rows against SQL where SQL can express them."""

import glob
import os

import duckdb
import pytest

from marquee.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2_tiff_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op3_toxicity": "doc_id held_out score predicted",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_simhash_dedup": "doc_id fingerprint component_id",
    "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_source_mix": "doc_id size source_size target taken",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op11_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_ngram_jaccard": "doc_id n_shingles component_id",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    assert set(COLUMNS[name].split()) <= set(QUERIES[name](spark, sf_dir).columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = QUERIES[name](spark, sf_dir), con.execute(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(c[0] for c in want.description)
    place = {c[0]: i for i, c in enumerate(want.description)}
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[place[c]] for c in names) for r in want.fetchall())
