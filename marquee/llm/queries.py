"""The queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, mixing, packing, periods, phrases, pii, quality, secret_scan, simhash, tiff, toxicity, whitening
from .common import load


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_tricky(load(spark, sf_dir, "conversations"))
    found = chat.digests(chat.format_conversations(turns))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


# In the formatted text, each of the three special characters takes one more, and the template adds a fixed number of
# characters for each role.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[\\]')) AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE WHEN role = 'user' THEN 18 WHEN role = 'assistant' THEN 6 WHEN role = 'system' THEN 16
                               WHEN role IS NULL THEN 18
                               ELSE 22 + length(role) + len(regexp_extract_all(role, '[<\[\\]')) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tiff.text_media(load(spark, sf_dir, "documents"))
    found = tiff.digests(tiff.pages(files, carry=["doc_id", "n_bytes"]))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


def toxicity_grammar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Grammar:
    """Learned from the labels of documents that are not held out."""
    labels = load(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.learn(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = toxicity.scores(docs.select("doc_id", "text"), toxicity_grammar(spark, docs, sf_dir))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(load(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.scan_secrets(load(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.scan_pii(load(spark, sf_dir, "documents")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(load(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM d GROUP BY source
), c AS (SELECT *, 3 * CAST(source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s
), r AS (
  SELECT *, cap / weight AS ratio,
         (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), w AS (SELECT arg_min(level, ratio) AS water FROM r WHERE cap > weight * level
), t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM r, w
), q AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, md5('mix-1|' || CAST(d.doc_id AS VARCHAR)) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q
), e AS (
  SELECT *, CAST(epoch * source_size + before + size AS BIGINT) / target AS finish FROM b, range(3) r(epoch)
  WHERE size > 0 AND CAST(epoch * source_size + before AS BIGINT) / target < 1
), m AS (
  SELECT doc_id, size, (SELECT sum(size) FROM d)
         - coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM e
), k AS (SELECT doc_id, sum(least(size, left_over)) AS taken FROM m WHERE left_over > 0 GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(load(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), again AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1
), hit AS (SELECT doc_id, i FROM g JOIN again USING (h)
), gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, k: ps IS NULL OR NOT list_contains(ps, k)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""



def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.integer_vectors(load(spark, sf_dir, "embeddings"))
    found = whitening.whitened(rows, whitening.fitted(rows))
    exact = F.expr("try_cast(deviation AS bigint)")
    return found.select("vec_id", "component", "n", exact.alias("deviation"), "whitened", "explained", "identity_error")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.with_planted_runs(load(spark, sf_dir, "documents"))
    return periods.run_digest(periods.periodic_runs(docs))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(load(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g
  FROM d WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (SELECT doc_id, g FROM s SEMI JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) USING (g)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id WHERE r.c < p.b
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_tiff_media, op3_toxicity, op4_quality_rules, op5_simhash_dedup, op6_secret_scan, op7_pii,
        op8_source_mix, op9_packing, op10_substring_dedup, op11_embedding_whitening, op12_periodic_runs, op13_ngram_jaccard,
    )
}
ORACLES: dict[str, str] = {"op1_chat_format": OP1_SQL, "op8_source_mix": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op13_ngram_jaccard": OP13_SQL}
