"""A corpus pipeline over ``documents``: reject toxic texts, keep one of each near-duplicate group, redact personal
data, mix sources to target weights, and pack what is left into training sequences.

Each stage's table is written in the shared folder and read again as the next one's documents. All but the last keep
the columns of ``documents``; n_chars follows the text.

Defined results of the stages: null and empty texts pass like others. Documents are told apart by doc_id, those without
one by their text; where decisions are joined to documents, rows that repeat both are one document, so repeated rows
neither multiply nor get lost but by the near-duplicate stage, which compares all rows by their texts alone. Other columns of the input are dropped. Empty tables give
empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import mixing, packing, pii, simhash, toxicity
from marquee.llm.common import configured, load, saved
from marquee.llm.queries import toxicity_grammar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Whole texts in an Arrow batch: executors hold a batch twice, in the JVM and in Python, beside what earlier stages left.
ARROW_ROWS = 500


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5."""
    grammar = toxicity_grammar(spark, docs, sf_dir)
    return toxicity.scores(docs, grammar).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of similar texts (five-word shingles, 0.8 or more); rows without a
    doc_id come last. Links of SimHash fingerprints are confirmed first, and exact comparison adds those they miss. Rows are told apart by a number, so those that repeat an id are compared by their texts alone."""
    rows = saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_no")), "numbered")
    found = simhash.similar_documents(rows, id_column="row_no").withColumnRenamed("doc_id", "row_no")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no"))
    heads = rows.select("row_no", "doc_id").join(found, "row_no").groupBy("component_id").agg(first.alias("first"))
    return rows.join(heads.select("first.row_no"), "row_no", "left_semi").select(*COLUMNS)


def told_apart(docs: DataFrame) -> DataFrame:
    """Adds ``same``, which is equal for rows that repeat id and text; a missing id equals no other."""
    known = F.coalesce("doc_id", F.lit(0).cast("bigint"))
    return docs.withColumn("same", F.struct(known.alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("text")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in angle brackets."""
    named = told_apart(docs.where(pii.may_hold(F.col("text"))))  # other texts have nothing to redact and stay in place
    found = pii.scan_pii(named, id_column="same").where(F.size("spans") > 0).select(F.col("doc_id").alias("same"), "spans")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.redacted(F.col("text"), F.col("spans")))
    clean = named.join(found.dropDuplicates(["same"]), "same", "left").withColumn("text", text)
    rest = docs.where(~pii.may_hold(F.col("text")))
    both = clean.select(*COLUMNS).unionByName(rest.select(*COLUMNS))
    return both.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in its order, so that sources stay interleaved; one taken in part is cut there."""
    named = told_apart(docs)
    mix, _ = mixing.mixed(named, id_column="same")
    keys = ["same_id", "same_no_id", "same_text"]  # plain columns, so that dropping repeats and joining share one exchange
    of = lambda c: [F.col(f"{c}.id").alias(keys[0]), F.col(f"{c}.no_id").alias(keys[1]), F.col(f"{c}.text").alias(keys[2])]
    taken = mix.select(*of("doc_id"), F.col("size").alias("all_words"), F.col("taken").alias("taken_words"), *(c for c in mixing.ORDER if c != "source"))
    one = named.select(*COLUMNS, *of("same")).dropDuplicates(keys)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("taken_words").cast("int")), "")
    text = F.when(F.col("taken_words") >= F.col("all_words"), F.col("text")).otherwise(part)
    out = mixing.in_order(one.join(taken, keys).withColumn("text", text))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    with configured(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS):
        return saved(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")), "packed")  # small rows


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the learned filters nor the components, so the rows are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
