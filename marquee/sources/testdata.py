"""The model's tables, read from the driver's star schema: as DataFrames and as SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_genres


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_genres():
    return F.when(F.col("p_partkey") % 11 == 0, "(no genres listed)").otherwise(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("|"), F.col("p_type"))
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, joined by sorting: its compressed file is far smaller than its rows, so by size of the file Spark would
    collect a large catalog in the driver to broadcast it, once for each join."""
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        parse_genres(raw_genres()).alias("genres"),
        (F.col("p_size") + 1970).alias("start_year"),
        F.array(F.lower("p_brand"), F.lower("p_type")).alias("tags"),
        F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("About "), "p_name", F.lit(" by "), "p_brand")).alias("description"),
        F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("https://img.example.com/p/"), "p_partkey", F.lit(".JPEG?w=1"))).alias("image_url"),
    )
    return rows.hint("merge")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid interactions; purchases stand for ratings."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    even = F.col("event_id") % 2 == 0
    rated = F.col("event_type") == "purchase"
    return e.select(
        F.col("event_id").alias("interaction_id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        "ts",
        F.when(rated, "rating").otherwise(F.col("event_type")).alias("type"),
        F.when(rated, F.least(F.lit(5.0), F.greatest(F.lit(0.5), F.floor(F.col("value") / 10 + 0.5) / 2))).alias("rating"),
        F.when(F.col("event_type") == "view", "library")
        .when((F.col("event_type") == "click") & even, "watchlist")
        .when(F.col("event_type") == "click", "dismissed")
        .when(even, "library")
        .alias("source"),
    )


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many ratings: order lines as interactions, with keys that order them totally."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("o_orderdate").alias("ts"),
        (F.col("l_quantity") / 10).alias("rating"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity",
    )


BULK_ORDER = ("ts", "l_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_extendedprice", "l_quantity")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def item_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, description, image_url, imdb_id, metadata): items with JSON text of many forms, some of it malformed."""
    rows = items(spark, sf_dir).select("item_id", "description", "image_url", F.col("start_year").alias("y"))
    return rows.select(
        "item_id", "description", "image_url", F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("tt"), "item_id")).alias("imdb_id"),
        F.expr(METADATA).alias("metadata"),
    )


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(interaction_id, user_id, type, context): valid interactions whose source stands in JSON text."""
    return interactions(spark, sf_dir).select("interaction_id", "user_id", "type", F.expr(CONTEXT).alias("context"))


# JSON text for the tables above, in words that both engines read.
METADATA = """CASE item_id % 13 WHEN 0 THEN NULL WHEN 1 THEN concat('{"tmdb_id": ', item_id) WHEN 2 THEN '["tmdb_id", 1]'
  WHEN 3 THEN '{"tmdb_id": null, "start_year": "n/a", "year": "1987"}' WHEN 4 THEN '"tmdb_id"' WHEN 5 THEN '{"imdb_id": "tt7", "release_date": "2001-05-06"}'
  WHEN 6 THEN '' WHEN 7 THEN '{"release_date": "next year", "year": null, "extra": {"tmdb_id": 1}}' WHEN 8 THEN concat('{"tmdb_id": ', item_id, ', "year": ', y, ', "extra": {"a b": [1, {"c": true}]}}')
  ELSE concat('{"start_year": "', y, '", "tmdb_id": ', item_id, ', "title": "T', item_id, '"}') END"""
CONTEXT = """CASE interaction_id % 10 WHEN 0 THEN NULL WHEN 1 THEN concat('{"source": "', coalesce(source, 'none'), '"') WHEN 2 THEN '{"source": null}'
  WHEN 3 THEN '["library", {"source": "library"}]' WHEN 4 THEN '{"source": {"name": "library"}}' WHEN 5 THEN '"library"'
  ELSE concat('{"rating": 4.5, "source": "', coalesce(source, 'none'), '", "device": {"os": "x", "tags": ["a", "b"]}}') END"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Customer#"), F.floor(F.col("c_custkey") / 2))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 2 == 1, F.upper(name)).otherwise(name).alias("username"),
        F.col("c_name").alias("display"),
    )


#: The same tables as SQL, to stand before an oracle's query.
CTES = {
    "items": """items AS (
  SELECT p_partkey AS item_id, p_name AS title,
         CASE WHEN p_partkey % 11 <> 0 THEN string_split(replace(p_name, ' ', '|') || '|' || p_type, '|') END AS genres,
         p_size + 1970 AS start_year, [lower(p_brand), lower(p_type)] AS tags,
         CASE WHEN p_size % 5 <> 0 THEN 'About ' || p_name || ' by ' || p_brand END AS description,
         CASE WHEN p_size % 7 <> 0 THEN 'https://img.example.com/p/' || p_partkey || '.JPEG?w=1' END AS image_url
  FROM part)""",
    "inter": """inter AS (
  SELECT event_id AS interaction_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts,
         CASE event_type WHEN 'purchase' THEN 'rating' ELSE event_type END AS type,
         CASE WHEN event_type = 'purchase' THEN least(CAST(5 AS DOUBLE), greatest(CAST(0.5 AS DOUBLE), floor(value / 10 + 0.5) / 2)) END AS rating,
         CASE WHEN event_type = 'view' THEN 'library' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'watchlist'
              WHEN event_type = 'click' THEN 'dismissed' WHEN event_id % 2 = 0 THEN 'library' END AS source
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))""",
    "bulk": """bulk AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, l_quantity / 10 AS rating, l_orderkey, l_linenumber,
         l_suppkey, l_extendedprice, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "emb": """emb AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE embedding IS NOT NULL)""",
    "docs": f"""docs AS (SELECT item_id, description, image_url, CASE WHEN item_id % 3 <> 0 THEN 'tt' || item_id END AS imdb_id, {METADATA} AS metadata
  FROM (SELECT *, start_year AS y FROM items)
), jdocs AS (SELECT *, TRY_CAST(metadata AS JSON) AS j FROM docs)""",
    "contexts": f"""contexts AS (SELECT interaction_id, user_id, type, {CONTEXT} AS context FROM inter
), jcontexts AS (SELECT *, CASE WHEN context IS NULL THEN JSON '{{}}' ELSE TRY_CAST(context AS JSON) END AS j FROM contexts)""",
    "users": """users AS (
  SELECT c_custkey AS id, c_name AS display,
         CASE WHEN c_custkey % 2 = 1 THEN upper('Customer#' || (c_custkey // 2)) ELSE 'Customer#' || (c_custkey // 2) END AS username
  FROM customer)""",
    # consecutive-deduplicated, rating-filtered histories over embedded items, with positions from 1
    "seqs": """kept AS (
  SELECT *, lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS before FROM inter
  WHERE item_id IN (SELECT item_id FROM emb) AND (type <> 'rating' OR rating >= 3.5)
), seq0 AS (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS pos,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM kept WHERE before IS NULL OR before <> item_id
), seqs AS (SELECT * FROM seq0 WHERE n >= 3)""",
    "pop": """pop AS (
  SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank, count(*) OVER () AS total FROM inter GROUP BY item_id)""",
    "seen": """seen AS (SELECT DISTINCT user_id, item_id FROM inter)""",
    # mean of the last 50 history vectors (the length cancels in the cosine), for users with 3 interactions or more
    "query": """last50 AS (SELECT user_id, item_id FROM seqs WHERE pos > n - 50
), parts AS (SELECT user_id, i, sum(v[i]) AS x FROM last50 JOIN unit USING (item_id), range(1, 65) r(i) GROUP BY user_id, i
), query AS (
  SELECT user_id, list(x / greatest(len, 1e-12) ORDER BY i) AS q FROM (
    SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS len FROM parts) GROUP BY user_id)""",
    "unit": """unit AS (
  SELECT item_id, list_transform(vector, lambda x: x / greatest(sqrt(list_dot_product(vector, vector)), 1e-12)) AS v FROM emb)""",
    "scored": """scored AS (
  SELECT user_id, item_id, floor(list_dot_product(q, v) * 1e6 + 0.5) / 1e6 AS score FROM query, unit
), warm AS (
  SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM scored s
  ANTI JOIN seen USING (user_id, item_id))""",
}


def sql(body: str, *names: str) -> str:
    """``body`` after the CTEs that it names, in order."""
    head = "WITH " + ",\n".join(CTES[n] for n in names)
    return head + (",\n" if body.lstrip().startswith("+") else "\n") + body.lstrip().removeprefix("+").lstrip()
