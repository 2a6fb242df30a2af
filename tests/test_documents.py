"""JSON documents: keys, containment, tolerant parsing, merging."""

import json

import pytest
from pyspark.sql import functions as F

from marquee.functions import documents as D
from marquee.operators import catalog, library

TEXTS = ['{"a":null,"b c":1,"n":{"x":[1,"y",{"z":true}]}}', '[1,"a",null]', '"a"', "{bad", "", None, '{"a":"s"}', '{"a":1.5}', "7", "true", "null", "[]", "{}", '{"n":{}}']


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("d", D.parsed(F.col("t")))


def parsed(text):
    """The document as Python's, or ... where it is malformed."""
    try:
        return {} if text is None else json.loads(text)
    except ValueError:
        return ...


def contains(doc, pattern, top=True):
    if isinstance(pattern, dict):
        return isinstance(doc, dict) and all(k in doc and contains(doc[k], v, False) for k, v in pattern.items())
    if isinstance(pattern, list):
        return isinstance(doc, list) and all(any(contains(e, p, False) for e in doc) for p in pattern)
    if top and isinstance(doc, list):
        return any(contains(e, pattern, False) for e in doc)
    return type(doc) is type(pattern) and doc == pattern


def column(table, c):
    return [r[0] for r in table.select(c).collect()]


@pytest.mark.parametrize("key", ["a", "b c", "n", "x", "1"])
def test_has_key(table, key):
    docs = [parsed(t) for t in TEXTS]
    want = [(isinstance(d, dict) and key in d) or (isinstance(d, list) and key in d) or d == key for d in docs]
    assert column(table, D.has_key(F.col("d"), key)) == want


@pytest.mark.parametrize("pattern", [{}, [], {"a": None}, {"a": "s"}, {"a": 1.5}, {"n": {}}, {"n": {"x": []}}, {"n": {"x": [{"z": True}, 1]}}, {"n": {"x": ["z"]}}, ["a"], [1, "a"], [None], "a", 7, True, None, {"a": {"b": 1}}])
def test_contains(table, pattern):
    docs = [parsed(t) for t in TEXTS]
    assert column(table, D.contains(F.col("d"), pattern)) == [d is not ... and contains(d, pattern) for d in docs]


def test_parsing_is_tolerant(spark, table):
    assert column(table, D.malformed(F.col("t"))) == [parsed(t) is ... for t in TEXTS]
    assert [None if x is None else json.loads(x) for x in column(table, F.to_json(F.col("d")))] == [None if parsed(t) is ... else parsed(t) for t in TEXTS]
    rows = spark.sql("SELECT named_struct('source', 'library') AS s, map('source', 'x') AS m UNION ALL SELECT NULL, NULL")
    assert column(rows, F.to_json(D.as_document(rows, "s"))) == ['{"source":"library"}', "{}"]
    assert column(rows, F.to_json(D.as_document(rows, "m"))) == ['{"source":"x"}', "{}"]
    assert library.of_source(rows, "library", "s").count() == 1 and library.of_source(rows, "library", "m").count() == 0
    assert column(table, D.text(F.col("d"), "n", "x", 1))[0] == "y" and json.loads(column(table, D.text(F.col("d"), "n"))[0]) == {"x": [1, "y", {"z": True}]}
    with pytest.raises(ValueError, match="quote"):
        D.path("it's")


@pytest.mark.parametrize(
    ("metadata", "want"),
    [
        ('{"start_year": "x", "year": 1999.9}', 1999), ('{"start_year": " 2001 "}', 2001), ('{"year": "19.5", "release_date": "1980-01-02"}', 1980),
        ('{"release_date": "198"}', None), ('{"release_date": 19800102}', None), ('{"start_year": null, "year": true}', 1), (None, None), ("{bad", None), ("[1]", None),
    ],
)
def test_year(spark, metadata, want):
    rows = spark.createDataFrame([(1, metadata)], "item_id int, metadata string")
    assert catalog.with_documents(rows).first().year == want


def test_merged(spark):
    rows = spark.createDataFrame([('{"a":1,"b":{"x":1}}', '{"b":{"y":2},"c":null}'), ("[1]", '{"a":2}'), ('{"a":1}', None), ("{bad", "{bad")], "o string, n string")
    got = column(rows, F.to_json(D.merged(D.parsed(F.col("o")), D.parsed(F.col("n")))))
    assert [json.loads(x) for x in got] == [{"a": 1, "b": {"y": 2}, "c": None}, {"a": 2}, {"a": 1}, {}]


def test_work_queue(spark):
    """Items with a key and a missing field; with force, all with the key."""
    rows = spark.createDataFrame(
        [(1, '{"tmdb_id": 862}', None, "u"), (2, '{"tmdb_id": 1}', "d", "u"), (3, "{}", None, None), (4, '{"tmdb_id": null}', "d", None), (5, None, None, None)],
        "item_id int, metadata string, description string, image_url string",
    )
    rows = rows.withColumn("metadata", D.parsed(F.col("metadata")))
    key = D.has_key(F.col("metadata"), "tmdb_id")
    ids = lambda df: sorted(r.item_id for r in df.collect())
    assert ids(catalog.needing(rows, key)) == [1, 4] and ids(catalog.needing(rows, key, force=True)) == [1, 2, 4]
    assert [tuple(r) for r in catalog.remaining(rows, {"tmdb": key}).collect()] == [("tmdb", 2)]
