"""Documents for small tests: odd cases and the test table."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (9001, None, None, None, None),
    (9002, "", "en", "a", 0),
    (9003, " \t\n\x0b ", "en", "a", 5),
    (9004, "one", "en", None, 3),
    (9005, "one two", "en", "b", 7),
    (9006, "na " * 300, "en", "b", 900),
    (9007, "ab cd ef " * 200 + "\n" + "x y z\n" * 20, "en", "b", 900),
    (9008, "Ünï cödé 😀 words with nbsp   " * 30, "fr", "c", 900),
    (9009, "w" * 100_000, "en", "c", 100_000),
    (9010, " ".join(f"t{i}" for i in range(20_000)), "en", "c", 1),
    (9011, " ".join(f"t{i}" for i in range(20_000)), "en", "c", 1),
    (9012, " ".join(f"t{i}" for i in range(500)) + " end", "en", "c", 1),
    (9013, "lead " + " ".join(f"t{i}" for i in range(100, 136)) + " tail", "en", "c", 1),
]


def documents(spark, sf_dir, odd=True):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return docs.unionByName(spark.createDataFrame(ODD, DOC_SCHEMA)) if odd else docs


def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
