"""Catalog, library, text and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, library, merge
from ..sources.testdata import raw_genres
from .model import Model, joined
from .registry import query

LIST = "array_to_string({}, '|')"


@query("SELECT DISTINCT user_id, item_id FROM inter", "inter")
def user_seen(m: Model) -> DataFrame:
    return m.seen


@query("""+ h AS (SELECT *, lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS before FROM inter
  WHERE type <> 'rating' OR rating >= 3.5
), p AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n
  FROM h WHERE before IS NULL OR before <> item_id)
SELECT * FROM p WHERE pos > n - 50""", "inter")
def user_history(m: Model) -> DataFrame:
    return library.user_history(m.interactions).select("user_id", "item_id", "pos", "n")


@query("""+ r AS (SELECT user_id, item_id, title, type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, interaction_id DESC) AS rank FROM inter JOIN items USING (item_id))
SELECT * FROM r WHERE rank <= 20""", "items", "inter")
def history_page(m: Model) -> DataFrame:
    return library.history_page(m.interactions, m.items).select("user_id", "item_id", "title", "type", "rank")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (type = 'rating') AS ratings FROM inter GROUP BY user_id", "inter")
def user_stats(m: Model) -> DataFrame:
    return library.user_stats(m.interactions)


LIBRARY = """lib AS (
  SELECT user_id, item_id, title, genres, start_year, ts, interaction_id FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, interaction_id DESC) AS rn FROM inter
    WHERE type = 'view' AND source = 'library') JOIN items USING (item_id) WHERE rn = 1)"""


@query(f"+ {LIBRARY} SELECT user_id, item_id, title, interaction_id FROM lib", "items", "inter")
def library_items(m: Model) -> DataFrame:
    return m.library.select("user_id", "item_id", "title", "interaction_id")


@query("""SELECT user_id, item_id, title, interaction_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, interaction_id DESC) AS rn
  FROM inter WHERE type = 'click' AND source = 'watchlist') JOIN items USING (item_id) WHERE rn = 1""", "items", "inter")
def watchlist_items(m: Model) -> DataFrame:
    return library.watchlist(m.interactions, m.items).select("user_id", "item_id", "title", "interaction_id")


@query("""SELECT user_id, item_id, bool_or(type = 'view' AND coalesce(source = 'library', false)) AS in_library,
  bool_or(type = 'click' AND coalesce(source = 'watchlist', false)) AS in_watchlist, bool_or(type = 'click' AND coalesce(source = 'dismissed', false)) AS dismissed,
  arg_max(rating, (ts, interaction_id)) FILTER (type = 'rating' AND source = 'library' AND rating IS NOT NULL) AS rating
FROM inter GROUP BY user_id, item_id""", "inter")
def movie_status(m: Model) -> DataFrame:
    return library.status(m.interactions)


@query("SELECT DISTINCT user_id, item_id FROM inter WHERE source IN ('library', 'dismissed')", "inter")
def library_exclusions(m: Model) -> DataFrame:
    return library.excluded(m.interactions)


@query("""+ h AS (SELECT *, lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS before FROM inter WHERE source = 'library'
), p AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n
  FROM h WHERE before IS NULL OR before <> item_id)
SELECT * FROM p WHERE pos > n - 50""", "inter")
def library_history(m: Model) -> DataFrame:
    return library.library_history(m.interactions).select("user_id", "item_id", "pos", "n")


@query(f"+ {LIBRARY} SELECT user_id, genre, count(*) AS n FROM (SELECT user_id, lower(unnest(genres)) AS genre FROM lib) GROUP BY ALL", "items", "inter")
def genre_profile(m: Model) -> DataFrame:
    return library.genre_profile(m.library)


EVENTS = "e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type AS type FROM events)"


def _events(m: Model) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return m.table("events").select("event_id", "user_id", k.alias("item_id"), F.col("event_type").alias("type"))


@query(f"WITH {EVENTS} SELECT e.* FROM e WHERE type IN ('view', 'click', 'purchase') AND item_id IN (SELECT p_partkey FROM part)")
def valid_interactions(m: Model) -> DataFrame:
    return library.validated(_events(m), m.items).where("reason is null").drop("reason")


@query(f"""WITH {EVENTS} SELECT e.*, CASE WHEN type NOT IN ('view', 'click', 'purchase') THEN 'type' ELSE 'item' END AS reason
FROM e WHERE type NOT IN ('view', 'click', 'purchase') OR item_id NOT IN (SELECT p_partkey FROM part)""")
def rejected_interactions(m: Model) -> DataFrame:
    return library.validated(_events(m), m.items).where("reason is not null")


@query("""SELECT i.interaction_id, i.user_id, i.item_id FROM inter i
WHERE NOT (i.source IS NOT DISTINCT FROM 'watchlist' AND i.item_id % 2 = 0) AND NOT (i.source IS NOT DISTINCT FROM 'library' AND i.item_id % 3 = 0 AND i.type = 'rating')""", "inter")
def interactions_removed(m: Model) -> DataFrame:
    pairs = m.seen
    gone = pairs.where("item_id % 2 = 0").select("*", F.lit("watchlist").alias("source"), F.lit(None).cast("string").alias("type"))
    rated = pairs.where("item_id % 3 = 0").select("*", F.lit("library").alias("source"), F.lit("rating").alias("type"))
    return library.removed(m.interactions, gone.unionByName(rated)).select("interaction_id", "user_id", "item_id")


@query("SELECT interaction_id, user_id FROM inter WHERE user_id % 10 <> 3", "inter")
def account_deleted(m: Model) -> DataFrame:
    gone = m.users.where("id % 10 = 3").select(F.col("id").alias("user_id"))
    gone = gone.unionByName(m.seen.where("user_id % 10 = 3").select("user_id")).distinct()
    return library.without_user(m.interactions, m.users, gone)[0].select("interaction_id", "user_id")


SEARCH = "row_number() OVER (ORDER BY relevance, title, item_id) AS rank FROM {} ORDER BY relevance, title, item_id LIMIT 20"


@query("""+ f AS (SELECT item_id, title, CASE WHEN lower(title) = 'red box' THEN 0 WHEN title ILIKE 'red box%' THEN 1 ELSE 2 END AS relevance
  FROM items WHERE title ILIKE '%red%')
SELECT item_id, title, CAST(CASE WHEN lower(title) = 'red' THEN 0 WHEN title ILIKE 'red%' THEN 1 ELSE 2 END AS INTEGER) AS relevance FROM f ORDER BY 3, title, item_id LIMIT 20""", "items")
def search_title(m: Model) -> DataFrame:
    return catalog.page(catalog.search(m.items, q=" red ")).select("item_id", "title", "relevance")


@query("""SELECT CAST(CASE WHEN lower(title) = 'a' THEN 0 WHEN title ILIKE 'a%' THEN 1 ELSE 2 END AS INTEGER) AS relevance, count(*) AS n
FROM items WHERE title ILIKE '%a%' GROUP BY 1""", "items")
def search_relevance(m: Model) -> DataFrame:
    return catalog.search(m.items, q="a").groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT item_id, title FROM items WHERE list_has_any(genres, (SELECT [min(genres[3]), max(genres[3])] FROM items))
ORDER BY title, item_id LIMIT 20 OFFSET 5""", "items")
def search_genre(m: Model) -> DataFrame:
    ends = m.items.agg(F.min(F.get("genres", F.lit(2))).alias("a"), F.max(F.get("genres", F.lit(2))).alias("b")).first()
    return catalog.page(catalog.search(m.items, genres=[ends["a"], f" {ends['b']} "]), offset=5).select("item_id", "title")


@query("SELECT item_id, title FROM items WHERE len(list_filter(tags, lambda t: t LIKE '%brand#1%')) > 0 ORDER BY title, item_id LIMIT 20", "items")
def search_tag(m: Model) -> DataFrame:
    return catalog.page(catalog.search(m.items, tag=" Brand#1")).select("item_id", "title")


@query("SELECT count(*) AS n FROM items WHERE title ILIKE '%e%'", "items")
def search_total(m: Model) -> DataFrame:
    return catalog.search(m.items, q="e").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tag, count(*) AS n FROM (SELECT lower(unnest(tags)) AS tag FROM items) GROUP BY tag HAVING count(*) >= 25 ORDER BY n DESC, tag LIMIT 30", "items")
def tag_counts(m: Model) -> DataFrame:
    return catalog.tag_counts(m.items)


CANON = "canon(place, genre) AS (VALUES " + ", ".join(f"({i}, '{g.replace(chr(39), chr(39) * 2)}')" for i, g in enumerate(S.CANONICAL_GENRES)) + ")"
#: Part types stand for canonical genres here, by their first letter.
AS_CANON = {"SMALL": "Drama", "LARGE": "War", "MEDIUM": "Comedy", "STANDARD": "Western", "ECONOMY": "Action", "PROMO": "Sci-Fi"}
CASE = "CASE split_part(g, ' ', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AS_CANON.items()) + " ELSE g END"


@query(f"""+ {CANON}, g AS (SELECT {CASE} AS genre FROM (SELECT unnest(genres) AS g FROM items))
SELECT genre, count(*) AS n, CAST(place AS INTEGER) AS place FROM g JOIN canon USING (genre) GROUP BY genre, place HAVING count(*) >= 5""", "items")
def genre_counts(m: Model) -> DataFrame:
    head = lambda g: F.split_part(g, F.lit(" "), F.lit(1))

    def renamed(g):
        out = F
        for k, v in AS_CANON.items():
            out = out.when(head(g) == k, v)
        return out.otherwise(g)

    return catalog.genre_counts(m.items.withColumn("genres", F.transform("genres", renamed)), min_count=5)


@query("""SELECT item_id, title, start_year, coalesce(array_to_string(genres, '|'), '') AS genres, nullif(trim(image_url), '') AS poster,
  CASE WHEN image_url IS NOT NULL THEN 'jpg' END AS extension FROM items""", "items")
def item_serialized(m: Model) -> DataFrame:
    return catalog.served(m.items).withColumn("genres", joined("genres"))


@query("SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM emb)", "items", "emb")
def items_missing_embedding(m: Model) -> DataFrame:
    return catalog.without_embedding(m.items, m.embeddings).select("item_id")


@query("SELECT item_id FROM items WHERE description IS NULL OR image_url IS NULL ORDER BY item_id LIMIT 100", "items")
def items_missing_metadata(m: Model) -> DataFrame:
    return catalog.without_metadata(m.items).orderBy("item_id").limit(100)


@query("SELECT item_id, image_url FROM items WHERE trim(image_url) <> ''", "items")
def items_with_poster(m: Model) -> DataFrame:
    return catalog.with_poster_url(m.items)


@query("""SELECT item_id, coalesce(CASE WHEN item_id % 4 = 0 THEN 'New text' END, description) AS description,
  coalesce(CASE WHEN item_id % 4 = 0 AND item_id % 3 <> 0 THEN 'http://new' END, image_url) AS image_url,
  array_to_string(CASE WHEN item_id % 4 = 0 AND genres IS NULL THEN ['Drama'] ELSE genres END, '|') AS genres FROM items""", "items")
def items_patched(m: Model) -> DataFrame:
    patch = m.items.where("item_id % 4 = 0").select(
        "item_id", F.lit("New text").alias("description"),
        F.when(F.col("item_id") % 3 != 0, "http://new").otherwise("").alias("image_url"), F.array(F.lit("Drama")).alias("genres"),
    )
    out = catalog.patched(m.items, patch, overwrite_genres=False)
    return out.select("item_id", "description", "image_url", joined("genres").alias("genres"))


@query("SELECT item_id, array_to_string(genres, '|') AS genres FROM items", "items")
def genres_parsed(m: Model) -> DataFrame:
    part = m.table("part")
    return part.select(F.col("p_partkey").alias("item_id"), joined(S.parse_genres(F.concat(F.lit(" "), raw_genres(), F.lit(" ")))).alias("genres"))


@query("""SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'tt' || p_partkey ELSE 'tt' || CASE WHEN length(CAST(n AS VARCHAR)) >= 7 THEN CAST(n AS VARCHAR)
  ELSE lpad(CAST(n AS VARCHAR), 7, '0') END END AS imdb_id FROM (SELECT *, p_partkey * 54321 AS n FROM part)""")
def imdb_ids(m: Model) -> DataFrame:
    key = F.col("p_partkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit(" tt"), key.cast("string"))).otherwise((key * 54321).cast("string"))
    return m.table("part").select(key.alias("item_id"), S.format_imdb_id(raw).alias("imdb_id"))


YEARS = """y AS (SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN '' ELSE CAST(1970 + p_size AS VARCHAR) END AS s,
  CASE WHEN p_partkey % 5 = 0 THEN '199x' WHEN p_partkey % 7 <> 0 THEN CAST(1960 + p_size AS VARCHAR) END AS y, CASE WHEN p_partkey % 2 = 0 THEN '2001-05-06' ELSE '19' END AS r FROM part)"""


def _years(m: Model) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    start = F.when(key % 4 == 1, "N/A").when(key % 4 == 2, "").when(key % 4 == 3, (size + 1970).cast("string"))
    year = F.when(key % 5 == 0, "199x").when(key % 7 != 0, (size + 1960).cast("string"))
    return m.table("part").select(key.alias("item_id"), start.alias("s"), year.alias("y"), F.when(key % 2 == 0, "2001-05-06").otherwise("19").alias("r"))


@query(f"""WITH {YEARS} SELECT item_id, coalesce(TRY_CAST(s AS INTEGER), TRY_CAST(y AS INTEGER), CASE WHEN length(r) >= 4 THEN TRY_CAST(substr(r, 1, 4) AS INTEGER) END) AS year FROM y""")
def years_display(m: Model) -> DataFrame:
    return _years(m).select("item_id", S.display_year(F.col("s"), F.col("y"), F.col("r")).alias("year"))


@query(f"""WITH {YEARS} SELECT item_id, year, CASE WHEN year IS NULL THEN CAST(0.5 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (year - 1970) / CAST(54 AS DOUBLE))) END AS norm
FROM (SELECT item_id, TRY_CAST(coalesce(nullif(s, ''), y) AS INTEGER) AS year FROM y)""")
def years_ranker(m: Model) -> DataFrame:
    rows = _years(m).select("item_id", S.ranker_year(F.col("s"), F.col("y")).alias("year"))
    return rows.withColumn("norm", S.normalize_year(F.col("year")))


@query("""SELECT item_id, concat_ws('. ', nullif(title, ''), description, array_to_string(genres, ', ')) AS text FROM items""", "items")
def item_text(m: Model) -> DataFrame:
    none = F.lit(None).cast("string")
    text = S.item_text(F.col("item_id"), F.col("title"), F.col("description"), F.col("genres"), none, F.lit(""))
    return m.items.select("item_id", text.alias("text"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE regexp_replace(substr(t, 1, 97), ' [^ ]*$', '') || '...' END AS text
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""")
def text_truncated(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", S.truncate(F.replace("text", F.lit("\n"), F.lit(" ")), 100).alias("text"))


@query("SELECT c_custkey AS id, CASE WHEN length(trim(c_mktsegment)) >= 3 THEN lower(trim(c_mktsegment)) END AS name, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END), ''), c_mktsegment, '') AS display FROM customer")
def usernames(m: Model) -> DataFrame:
    shown = F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_name"))
    return m.table("customer").select(
        F.col("c_custkey").alias("id"), S.normalize_username(F.col("c_mktsegment")).alias("name"), S.display_name(shown, F.col("c_mktsegment")).alias("display")
    )


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Action|Drama|War' WHEN 1 THEN 'Comedy' ELSE '' END AS genres FROM customer""")
def preferred_genres(m: Model) -> DataFrame:
    k = F.col("c_custkey") % 3
    wanted = F.when(k == 0, F.array(*map(F.lit, (" War ", "Drama", "nope", "Action", "Drama")))).when(k == 1, F.array(F.lit("Comedy"), F.lit("comedy"))).otherwise(F.array(F.lit("")))
    return m.table("customer").select(F.col("c_custkey").alias("id"), joined(S.canonical_genres(wanted)).alias("genres"))


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('', 'N/A', 'BUILDING') THEN NULL ELSE trim(c_mktsegment) END AS value FROM customer""")
def api_strings(m: Model) -> DataFrame:
    return m.table("customer").select(F.col("c_custkey").alias("id"), S.clean_api_string(F.col("c_mktsegment"), ("N/A", "BUILDING")).alias("value"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '\\.jpe?g$') THEN 'jpg' WHEN regexp_matches(url, '\\.(png|webp)$') THEN regexp_extract(url, '\\.(png|webp)$', 1) END AS ext FROM
(SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' ELSE '/x' END AS url FROM pages)""")
def url_extensions(m: Model) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, (".jpeg?a=.png", ".PNG", ".webp#f", "/x"))), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), tail)
    return m.table("pages").select("page_id", S.url_extension(url).alias("ext"))


@query("""SELECT event_id, CAST(1000000000 + event_id AS BIGINT) AS seconds, strftime(TIMESTAMP '2001-09-09 01:46:40' + to_seconds(event_id), '%Y-%m-%dT%H:%M:%S') AS at FROM events""")
def epoch_times(m: Model) -> DataFrame:
    s = F.col("event_id") + 1000000000
    return m.table("events").select("event_id", s.alias("seconds"), F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("""SELECT event_id, array_to_string(list_sort(map_keys(merged)), ',') AS keys, merged['k'] AS k FROM (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN MAP {'src': 'x', 'k': 'new'} ELSE MAP {'k': json_extract_string(props, '$.k')} END AS merged FROM events)""")
def metadata_merged(m: Model) -> DataFrame:
    old = F.from_json("props", "map<string,string>")
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("src"), F.lit("x"), F.lit("k"), F.lit("new")))
    merged = m.table("events").select("event_id", S.merged_metadata(old, new).alias("m"))
    return merged.select("event_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.col("m")["k"].alias("k"))


@query("""SELECT id, lower(username) AS username FROM users WHERE id IN (SELECT min(id) FROM users GROUP BY lower(username))""", "users")
def users_case_merged(m: Model) -> DataFrame:
    return merge.merged_users(m.users).select("id", "username")


@query("""+ k AS (SELECT id, min(id) OVER (PARTITION BY lower(username)) AS keep_id FROM users)
SELECT interaction_id, coalesce(keep_id, user_id) AS user_id FROM inter LEFT JOIN k ON k.id = user_id""", "users", "inter")
def interactions_moved(m: Model) -> DataFrame:
    return merge.moved_interactions(m.interactions, merge.kept_ids(m.users)).select("interaction_id", "user_id")


@query("""SELECT coalesce(s.item_id, t.item_id) AS item_id, CASE WHEN s.item_id IS NOT NULL THEN s.title ELSE t.title END AS title, t.description
FROM (SELECT * FROM items WHERE item_id % 10 <> 0) t FULL JOIN (SELECT item_id, upper(title) AS title FROM items WHERE item_id % 5 = 0) s USING (item_id)""", "items")
def items_upserted(m: Model) -> DataFrame:
    target = m.items.where("item_id % 10 <> 0").select("item_id", "title", "description")
    source = m.items.where("item_id % 5 = 0").select("item_id", F.upper("title").alias("title"))
    return merge.upserted(target, source, "item_id", ["title"])
