"""Queries over JSON documents: work queues by key, containment, tolerant parsing, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators import catalog, library
from ..sources import testdata
from .model import Model
from .registry import query

DOCS, CONTEXTS = ("items", "docs"), ("inter", "contexts")
#: The key of an object, or a string among an array's elements, or the string itself.
KNOWN = """(coalesce(json_exists(j, '$.tmdb_id'), false) OR coalesce(json_type(j) = 'VARCHAR' AND json_extract_string(j, '$') = 'tmdb_id', false)
  OR coalesce(json_type(j) = 'ARRAY' AND list_contains(json_extract_string(j, '$[*]'), 'tmdb_id'), false))"""


def _items(m: Model) -> DataFrame:
    rows = testdata.item_documents(m.spark, m.sf_dir)
    return rows.withColumn("metadata", D.parsed(F.col("metadata")))


@query(f"SELECT item_id FROM jdocs WHERE {KNOWN} AND (description IS NULL OR image_url IS NULL)", *DOCS)
def items_needing_key(m: Model) -> DataFrame:
    return catalog.needing(_items(m), D.has_key(F.col("metadata"), "tmdb_id")).select("item_id")


@query(f"SELECT item_id FROM jdocs WHERE {KNOWN}", *DOCS)
def items_needing_key_forced(m: Model) -> DataFrame:
    return catalog.needing(_items(m), D.has_key(F.col("metadata"), "tmdb_id"), force=True).select("item_id")


@query(f"""SELECT 'document' AS source, count(*) FILTER ({KNOWN} AND (description IS NULL OR image_url IS NULL)) AS n FROM jdocs
UNION ALL SELECT 'column', count(*) FILTER (imdb_id IS NOT NULL AND (description IS NULL OR image_url IS NULL)) FROM jdocs""", *DOCS)
def items_remaining(m: Model) -> DataFrame:
    return catalog.remaining(_items(m), {"document": D.has_key(F.col("metadata"), "tmdb_id"), "column": F.col("imdb_id").isNotNull()})


@query("""+ y AS (SELECT item_id, coalesce(TRY_CAST(json_extract_string(j, '$.start_year') AS INTEGER), TRY_CAST(json_extract_string(j, '$.year') AS INTEGER),
  TRY_CAST(CASE WHEN json_type(j, '$.release_date') = 'VARCHAR' THEN substr(json_extract_string(j, '$.release_date'), 1, 4) END AS INTEGER)) AS year,
  coalesce(CAST(json_type(j) AS VARCHAR), CASE WHEN metadata IS NULL THEN 'OBJECT' ELSE 'none' END) AS t FROM jdocs)
SELECT item_id, year, CASE t WHEN 'VARCHAR' THEN 'string' ELSE lower(t) END AS kind FROM y""", *DOCS)
def item_years_of_documents(m: Model) -> DataFrame:
    rows = catalog.with_documents(testdata.item_documents(m.spark, m.sf_dir))
    return rows.select("item_id", "year", F.coalesce(D.kind(F.col("metadata")), F.lit("none")).alias("kind"))


@query("""SELECT item_id, '/posters/' || item_id || '.jpg' AS poster_path, CASE WHEN item_id % 2 = 0 THEN NULL WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.tmdb_id') END AS tmdb_id,
  CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.title') END AS title,
  CAST(1 + coalesce(CASE WHEN json_type(j) = 'OBJECT' THEN len(list_filter(json_keys(j), lambda k: k <> 'tmdb_id')) + CASE WHEN item_id % 2 = 0 OR json_exists(j, '$.tmdb_id') THEN 1 ELSE 0 END END,
    CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS keys FROM jdocs""", *DOCS)
def documents_merged(m: Model) -> DataFrame:
    """Each item's metadata after a poster's path, and for some a null key, were merged into it."""
    patch = F.concat(F.lit('{"poster_path": "/posters/'), "item_id", F.when(F.col("item_id") % 2 == 0, '.jpg", "tmdb_id": null}').otherwise('.jpg"}'))
    rows = _items(m).withColumn("d", D.merged(F.col("metadata"), F.parse_json(patch)))
    texts = (D.text(F.col("d"), k).alias(k) for k in ("poster_path", "tmdb_id", "title"))
    return rows.select("item_id", *texts, F.size(D.members(F.col("d"))).alias("keys"))


@query("SELECT interaction_id, user_id FROM jcontexts WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.source') = 'VARCHAR' AND json_extract_string(j, '$.source') = 'library'", *CONTEXTS)
def interactions_of_source(m: Model) -> DataFrame:
    return library.of_source(testdata.contexts(m.spark, m.sf_dir), "library").select("interaction_id", "user_id")


@query("""SELECT interaction_id FROM jcontexts WHERE json_type(j) = 'OBJECT' AND json_extract_string(j, '$.device.os') = 'x'
  AND list_contains(json_extract_string(j, '$.device.tags[*]'), 'b') AND CAST(json_extract_string(j, '$.rating') AS DOUBLE) = 4.5""", *CONTEXTS)
def interactions_containing(m: Model) -> DataFrame:
    """Containment of nested objects, array elements and numbers."""
    rows = testdata.contexts(m.spark, m.sf_dir)
    return rows.where(D.contains(D.as_document(rows, "context"), {"device": {"os": "x", "tags": ["b"]}, "rating": 4.5})).select("interaction_id")


@query("""SELECT type, CASE WHEN j IS NULL THEN 'malformed' WHEN json_type(j) = 'VARCHAR' THEN 'string' ELSE lower(CAST(json_type(j) AS VARCHAR)) END AS kind,
  count(*) AS n, count(json_extract_string(j, '$.source')) AS with_source FROM jcontexts GROUP BY ALL""", *CONTEXTS)
def contexts_parsed(m: Model) -> DataFrame:
    """What contexts are after tolerant parsing, and how many of them tell a source."""
    rows = testdata.contexts(m.spark, m.sf_dir)
    d = D.as_document(rows, "context")
    kind = F.when(D.malformed(F.col("context")), "malformed").otherwise(D.kind(d))
    return rows.groupBy("type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count(D.text(d, "source")).alias("with_source"))


@query("""+ t AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN NULL WHEN item_id % 9 = 1 THEN '{"tags": "none"}' WHEN item_id % 9 = 2 THEN '{"tags": [' ELSE
  concat('{"tags": ["', upper(tags[1]), '", "', tags[2], '", ', item_id % 3, ', null]}') END AS metadata FROM items
), j AS (SELECT TRY_CAST(metadata AS JSON) AS j FROM t), e AS (SELECT lower(unnest(json_extract_string(j, '$.tags[*]'))) AS tag FROM j WHERE json_type(j, '$.tags') = 'ARRAY')
SELECT tag, count(*) AS n FROM e WHERE tag IS NOT NULL GROUP BY tag HAVING n >= 5 ORDER BY n DESC, tag LIMIT 30""", "items")
def tag_counts_of_documents(m: Model) -> DataFrame:
    """Tags counted from arrays in JSON text, numbers among them as text."""
    made = """CASE WHEN item_id % 9 = 0 THEN NULL WHEN item_id % 9 = 1 THEN '{"tags": "none"}' WHEN item_id % 9 = 2 THEN '{"tags": [' ELSE
      concat('{"tags": ["', upper(tags[0]), '", "', tags[1], '", ', item_id % 3, ', null]}') END"""
    rows = m.items.select("item_id", F.expr(made).alias("metadata"))
    return catalog.tag_counts(catalog.with_document_tags(rows), min_count=5)
