"""Recommendation, explanation and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, library, recommend
from .catalog_queries import LIBRARY
from .model import Model, joined
from .registry import query

COLD = """pairs AS (SELECT u.user_id, p.item_id, p.rank AS prank, total FROM (SELECT DISTINCT user_id FROM inter) u, pop p
), cold AS (SELECT pairs.*, row_number() OVER (PARTITION BY user_id ORDER BY prank) AS place FROM pairs ANTI JOIN seen USING (user_id, item_id))"""


@query(f"+ {COLD} SELECT user_id, item_id, title, CAST(total - prank + 1 AS DOUBLE) AS score, place AS rank FROM cold LEFT JOIN items USING (item_id) WHERE place <= 10",
       "items", "inter", "pop", "seen")
def recommend_popular(m: Model) -> DataFrame:
    """The ten most popular items that each user has not seen, with titles."""
    found = recommend.popular_for_users(m.interactions, m.ranking, m.seen, 10)
    return recommend.attach_titles(found, m.items).select("user_id", "item_id", "title", "score", "rank")


@query("SELECT item_id, rank, total FROM pop", "inter", "pop")
def popularity_interactions(m: Model) -> DataFrame:
    return m.ranking.select("item_id", "rank", "total")


@query("""+ c AS (SELECT item_id, count(*) AS n, min((user_id, pos)) AS first FROM seqs GROUP BY item_id)
SELECT item_id, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM c""", "inter", "emb", "seqs")
def popularity_sequences(m: Model) -> DataFrame:
    return recommend.popularity_of_sequences(m.seqs, m.units).select("item_id", "n", "rank")


@query("""+ t AS (SELECT item_id, count(*) AS n FROM inter GROUP BY item_id ORDER BY n DESC, item_id LIMIT 500)
SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM t WHERE item_id IN (SELECT item_id FROM emb)""", "inter", "emb")
def popularity_embedded(m: Model) -> DataFrame:
    return recommend.popularity_top(m.interactions, m.units).select("item_id", "n", "rank")


@query("SELECT item_id, CAST(0 AS BIGINT) AS n, row_number() OVER (ORDER BY item_id) AS rank FROM items QUALIFY rank <= 500", "items")
def popularity_fallback(m: Model) -> DataFrame:
    return recommend.popularity_or_catalog(m.interactions.where("user_id < 0"), m.items).select("item_id", "n", "rank")


MATCH = "list_has_any(list_transform(coalesce(genres, []), lambda g: lower(g)), ['red', 'blue', 'small', 'standard', 'economy'])"
WANTED = [" Red", "BLUE ", "small", "Standard", "economy", ""]


@query(f"""+ {COLD}, pool AS (SELECT *, place - 1 AS i FROM cold WHERE place <= 500
), sc AS (SELECT user_id, item_id, i, CAST(len(list_intersect(list_transform(coalesce(genres, []), lambda g: lower(g)), ['red', 'blue', 'small', 'standard', 'economy'])) * 10000 + total - i AS DOUBLE) AS score
  FROM pool JOIN items USING (item_id) WHERE {MATCH})
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, i) AS rank FROM sc QUALIFY rank <= 10""", "items", "inter", "pop", "seen")
def recs_genre_filtered(m: Model) -> DataFrame:
    return recommend.genre_weighted(m.interactions, m.ranking, m.seen, m.items, 10, labels=WANTED)


PROFILE = f"{LIBRARY}, prof AS (SELECT user_id, genre, count(*) AS n FROM (SELECT user_id, lower(unnest(genres)) AS genre FROM lib) GROUP BY ALL)"
OVERLAP = "ig AS (SELECT DISTINCT item_id, genre FROM (SELECT item_id, lower(unnest(genres)) AS genre FROM items)), ov AS (SELECT user_id, item_id, sum(n) AS overlap FROM prof JOIN ig USING (genre) GROUP BY ALL)"


@query(f"""+ {COLD}, {PROFILE}, {OVERLAP}, sc AS (SELECT user_id, item_id, place - 1 AS i, CAST(coalesce(overlap, 0) * 10000 + total - (place - 1) AS DOUBLE) AS score
  FROM cold LEFT JOIN ov USING (user_id, item_id) WHERE place <= 500)
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, i) AS rank FROM sc QUALIFY rank <= 10""", "items", "inter", "pop", "seen")
def recs_genre_popularity(m: Model) -> DataFrame:
    profile = library.genre_profile(m.library)
    return recommend.genre_weighted(m.interactions, m.ranking, m.seen, m.items, 10, profile=profile)


WARM = ("inter", "emb", "seqs", "seen", "unit", "query", "scored")


@query("SELECT user_id, item_id, score, rank FROM warm WHERE rank <= 10", *WARM)
def recs_avg_embedding(m: Model) -> DataFrame:
    return m.candidates


@query(f"""+ {PROFILE}, {OVERLAP}, sc AS (SELECT user_id, item_id, rank AS prior, score + coalesce(overlap, 0) AS score FROM warm LEFT JOIN ov USING (user_id, item_id) WHERE rank <= 10)
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, prior) AS rank FROM sc""", "items", *WARM)
def recs_library_boost(m: Model) -> DataFrame:
    return recommend.boosted(m.candidates, m.items, library.genre_profile(m.library), 10)


@query(f"""+ sc AS (SELECT user_id, item_id, score, rank AS prior FROM warm JOIN items USING (item_id) WHERE rank <= 80 AND {MATCH})
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY prior) AS rank FROM sc QUALIFY rank <= 10""", "items", *WARM)
def recs_filtered_by_genre(m: Model) -> DataFrame:
    found = recommend.similar_for_users(m.queries, m.units, m.seen, 80)
    return recommend.filtered_by_genres(found, m.items, WANTED, 10).select("user_id", "item_id", "score", "rank")


@query(f"""+ {COLD} SELECT user_id, item_id, score, rank, 'model' AS strategy FROM warm WHERE rank <= 10
UNION ALL SELECT user_id, item_id, CAST(total - prank + 1 AS DOUBLE), place, 'popularity' FROM cold WHERE place <= 10 AND user_id NOT IN (SELECT user_id FROM seqs)""", *WARM[:-3], "pop", *WARM[-3:])
def recommend_full(m: Model) -> DataFrame:
    return recommend.recommend(m.interactions, m.seqs, m.queries, m.units, m.ranking, m.seen, m.items, 10)


@query("SELECT user_id, item_id FROM seen WHERE false", "inter", "seen")
def overlap_audit(m: Model) -> DataFrame:
    return recommend.overlap_audit(m.candidates, m.seen)


@query("""SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM seqs)) AS passed, CAST(0 AS BIGINT) AS failed,
  count(DISTINCT user_id) FILTER (user_id NOT IN (SELECT user_id FROM seqs)) AS empty FROM inter""", "inter", "emb", "seqs")
def audit_summary(m: Model) -> DataFrame:
    return recommend.audit_summary(m.interactions, m.candidates, m.seen)


@query("""SELECT user_id FROM inter GROUP BY user_id HAVING count(DISTINCT item_id) >= 3 ORDER BY md5(user_id || '|7'), user_id LIMIT 25""", "inter")
def audit_users(m: Model) -> DataFrame:
    enough = m.seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    order = F.md5(F.concat(F.col("user_id").cast("string"), F.lit("|7")))
    return enough.orderBy(order, "user_id").limit(25).select("user_id")


AB = "v AS (SELECT DISTINCT user_id, CASE WHEN CAST('0x' || substr(sha256('generative_vs_popularity:' || user_id), 1, 8) AS BIGINT) / CAST(4294967295 AS DOUBLE) < 0.5 THEN 'generative' ELSE 'popularity' END AS variant FROM inter)"


@query(f"+ {AB} SELECT * FROM v", "inter")
def ab_variants(m: Model) -> DataFrame:
    return recommend.variants(m.interactions)


@query(f"+ {AB} SELECT variant, count(*) AS users FROM v GROUP BY variant", "inter")
def ab_counts(m: Model) -> DataFrame:
    return recommend.variants(m.interactions).groupBy("variant").agg(F.count(F.lit(1)).alias("users"))


PAIRS = "pr AS (SELECT DISTINCT user_id, CAST(1 + (user_id * 7) % 150 AS BIGINT) AS item_id FROM inter)"


def _pairs(m: Model) -> DataFrame:
    return m.interactions.select("user_id", (F.col("user_id") * 7 % 150 + 1).alias("item_id")).distinct()


SHARED = """gc AS (SELECT user_id, genre, count(*) AS n FROM (SELECT user_id, unnest(genres) AS genre FROM lib) GROUP BY ALL
), tg AS (SELECT DISTINCT user_id, item_id, genre FROM (SELECT user_id, item_id, unnest(genres) AS genre FROM pr JOIN items USING (item_id))
), sh AS (SELECT user_id, item_id, list(genre ORDER BY n DESC, genre) AS shared FROM tg JOIN gc USING (user_id, genre) GROUP BY ALL)"""


@query(f"+ {LIBRARY}, {PAIRS}, {SHARED} SELECT user_id, item_id, array_to_string(shared, '|') AS shared FROM sh", "items", "inter")
def explain_shared_genres(m: Model) -> DataFrame:
    return explain.shared_genres(_pairs(m), m.library, m.items).withColumn("shared", joined("shared"))


NEAR = """near AS (SELECT p.user_id, p.item_id, l.title AS rtitle, l.genres AS rgenres, t.title AS ttitle, t.genres AS tgenres,
  row_number() OVER (PARTITION BY p.user_id, p.item_id ORDER BY len(list_intersect(coalesce(l.genres, []), coalesce(t.genres, []))) DESC,
    abs(t.start_year - coalesce(l.start_year, t.start_year)), l.ts DESC, l.interaction_id DESC) AS place
  FROM pr p JOIN items t USING (item_id) JOIN lib l ON l.user_id = p.user_id)"""


@query(f"+ {LIBRARY}, {PAIRS}, {NEAR} SELECT user_id, item_id, place, rtitle AS title FROM near WHERE place <= 3", "items", "inter")
def explain_related(m: Model) -> DataFrame:
    return explain.related(_pairs(m), m.library, m.items).select("user_id", "item_id", "place", "title")


CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE regexp_replace(substr({0}, 1, {1} - 3), ' [^ ]*$', '') || '...' END"


@query(f"""+ {LIBRARY}, {PAIRS}, {SHARED}, {NEAR}, a AS (SELECT * FROM near WHERE place = 1
), j AS (SELECT pr.user_id, pr.item_id, coalesce(i.title, 'this movie') AS title, shared, rtitle, list_sort(list_intersect(coalesce(rgenres, []), coalesce(tgenres, []))) AS common
  FROM pr LEFT JOIN items i USING (item_id) LEFT JOIN sh USING (user_id, item_id) LEFT JOIN a USING (user_id, item_id)
), k AS (SELECT *, CASE WHEN shared IS NOT NULL THEN 'Matches your taste for ' || shared[1] || '.' END AS r1,
  CASE WHEN len(common) > 0 THEN 'Similar vibe to ' || rtitle || ' (' || array_to_string(common[1:2], ' and ') || ').' WHEN shared IS NOT NULL THEN 'Pairs well with ' || rtitle || ' from your library.'
       ELSE 'Fits alongside ' || rtitle || ' in your library.' END AS r2 FROM j
), e AS (SELECT *, CASE WHEN shared IS NOT NULL THEN title || ' fits your ' || shared[1] || ' picks — especially if you liked ' || rtitle || '.' ELSE {CUT.format("r2", 90)} END AS said FROM k)
SELECT user_id, item_id, CASE WHEN rtitle IS NULL THEN 'Add more films to your library so we can explain why ' || title || ' might suit your taste.' ELSE {CUT.format("said", 140)} END AS explanation,
  CASE WHEN rtitle IS NULL THEN '' ELSE concat_ws('|', {CUT.format("r1", 90)}, {CUT.format("r2", 90)}) END AS reasons FROM e""", "items", "inter")
def explain_text(m: Model) -> DataFrame:
    rows = explain.explained(_pairs(m), m.library, m.items)
    return rows.select("user_id", "item_id", "explanation", joined("reasons").alias("reasons"))


@query(f"""+ {AB}, {COLD} SELECT user_id, item_id, score, rank, 'generative' AS variant FROM warm JOIN v USING (user_id) WHERE rank <= 10 AND variant = 'generative'
UNION ALL SELECT user_id, item_id, CAST(total - prank + 1 AS DOUBLE), place, 'popularity' FROM cold JOIN v USING (user_id)
WHERE place <= 10 AND (variant = 'popularity' OR user_id NOT IN (SELECT user_id FROM seqs))""", *WARM[:-3], "pop", *WARM[-3:])
def recs_by_variant(m: Model) -> DataFrame:
    popular = recommend.popular_for_users(m.interactions, m.ranking, m.seen, 10)
    return recommend.served(m.interactions, m.candidates, popular)


@query(f"""+ {PROFILE}, {OVERLAP}, lk AS (SELECT *, lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS before FROM inter WHERE source = 'library'
), lh AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM lk WHERE before IS NULL OR before <> item_id
), lp AS (SELECT user_id, i, sum(v[i]) AS x FROM lh JOIN unit USING (item_id), range(1, 65) r(i) WHERE pos > n - 50 GROUP BY user_id, i
), lq AS (SELECT user_id, list(x / greatest(len, 1e-12) ORDER BY i) AS q FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS len FROM lp) GROUP BY user_id
), le AS (SELECT DISTINCT user_id, item_id FROM inter WHERE source IN ('library', 'dismissed')
), ls AS (SELECT user_id, item_id, floor(list_dot_product(q, v) * 1e6 + 0.5) / 1e6 AS score FROM lq, unit
), lw AS (SELECT ls.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS prior FROM ls ANTI JOIN le USING (user_id, item_id)
), sc AS (SELECT user_id, item_id, prior, score + coalesce(overlap, 0) AS score FROM lw LEFT JOIN ov USING (user_id, item_id) WHERE prior <= 10)
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, prior) AS rank FROM sc""", "items", "inter", "emb", "unit")
def recs_library_mode(m: Model) -> DataFrame:
    history = library.library_history(m.interactions)
    queries = recommend.mean_vectors(history, m.units)
    return recommend.recommend_in_library(
        history, queries, m.units, library.excluded(m.interactions), m.items, library.genre_profile(m.library), 10
    )


@query(f"""+ {COLD} SELECT user_id, item_id, score AS rank_score, coalesce(1 - (p.rank - 1) / p.total, 0) AS popularity_rank_norm FROM warm w JOIN items USING (item_id) LEFT JOIN pop p USING (item_id) WHERE w.rank <= 3""",
       "items", *WARM[:-3], "pop", *WARM[-3:])
def explain_features(m: Model) -> DataFrame:
    """Without a ranker, the rank score is the retrieval score."""
    from ..operators import rank, sequences

    top = m.candidates.where("rank <= 3").select("user_id", "item_id", "score")
    rows = rank.features(top, sequences.last(m.seqs), m.items, m.ranking, m.units)
    return explain.feature_explanation(top, rows).select("user_id", "item_id", "rank_score", "popularity_rank_norm")


LIBPOP = f"""{PROFILE}, {OVERLAP}, lex AS (SELECT DISTINCT user_id, item_id FROM inter WHERE source IN ('library', 'dismissed')
), lpairs AS (SELECT u.user_id, p.item_id, p.rank AS prank, total FROM (SELECT DISTINCT user_id FROM inter) u, pop p
), lcold AS (SELECT lpairs.*, row_number() OVER (PARTITION BY user_id ORDER BY prank) AS place FROM lpairs ANTI JOIN lex USING (user_id, item_id)
), lsc AS (SELECT user_id, item_id, place, CASE WHEN user_id IN (SELECT user_id FROM prof) THEN CAST(coalesce(overlap, 0) * 10000 + total - (place - 1) AS DOUBLE)
  ELSE CAST(total - prank + 1 AS DOUBLE) END AS score FROM lcold LEFT JOIN ov USING (user_id, item_id) WHERE place <= 500
), lpop AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, place) AS rank FROM lsc)"""


def _library_popularity(m: Model, k: int, labels: list[str] | None = None) -> DataFrame:
    profile = library.genre_profile(m.library)
    return recommend.library_popularity(m.interactions, m.ranking, library.excluded(m.interactions), m.items, profile, k, labels)


@query(f"+ {LIBPOP} SELECT user_id, item_id, score, rank FROM lpop WHERE rank <= 10", "items", "inter", "pop")
def recs_library_popularity(m: Model) -> DataFrame:
    """Library mode without a model: by the library's genres, and plain for users without any."""
    return _library_popularity(m, 10)


@query(f"""+ {LIBPOP}, fsc AS (SELECT user_id, item_id, place, CAST(len(list_intersect(list_transform(coalesce(genres, []), lambda g: lower(g)), ['red', 'blue', 'small', 'standard', 'economy'])) * 10000 + total - (place - 1) AS DOUBLE) AS score
  FROM lcold JOIN items USING (item_id) WHERE place <= 500 AND {MATCH})
SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, place) AS rank FROM fsc QUALIFY rank <= 10""", "items", "inter", "pop")
def recs_library_popularity_filtered(m: Model) -> DataFrame:
    """With a genre filter the library's genres have no weight."""
    return _library_popularity(m, 10, WANTED)


CASCADE = f"""{COLD}, {LIBPOP}, s1 AS (SELECT user_id, item_id, score, rank, 'model' AS source FROM warm WHERE rank <= 6
), h1 AS (SELECT user_id, count(*) AS have FROM s1 GROUP BY user_id
), c2 AS (SELECT l.*, coalesce(have, 0) + row_number() OVER (PARTITION BY l.user_id ORDER BY l.rank) AS r FROM (SELECT * FROM lpop WHERE rank <= 3) l ANTI JOIN s1 USING (user_id, item_id) LEFT JOIN h1 USING (user_id)
), s2 AS (SELECT user_id, item_id, score, r AS rank, 'library' AS source FROM c2 WHERE r <= 10
), s12 AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2), h2 AS (SELECT user_id, count(*) AS have FROM s12 GROUP BY user_id
), c3 AS (SELECT c.user_id, c.item_id, CAST(total - prank + 1 AS DOUBLE) AS score, coalesce(have, 0) + row_number() OVER (PARTITION BY c.user_id ORDER BY c.place) AS r
  FROM (SELECT * FROM cold WHERE place <= 20) c ANTI JOIN s12 USING (user_id, item_id) LEFT JOIN h2 USING (user_id)
), served AS (SELECT * FROM s12 UNION ALL SELECT user_id, item_id, score, r, 'popularity' FROM c3 WHERE r <= 10)"""


@query(f"+ {CASCADE} SELECT user_id, item_id, score, rank, source FROM served", "items", *WARM[:-3], "pop", *WARM[-3:])
def recs_cascade(m: Model) -> DataFrame:
    """Six items by the model, three by the library, the rest by popularity; cold users and small libraries fall through."""
    popular = recommend.popular_for_users(m.interactions, m.ranking, m.seen, 20)
    _, sources = recommend.serving_sources(m.embeddings, m.candidates.where("rank <= 6"), _library_popularity(m, 3), popular)
    return recommend.cascade(m.interactions, sources, 10)


@query(f"+ {COLD} SELECT user_id, item_id, CAST(total - prank + 1 AS DOUBLE) AS score, place AS rank, 'popularity' AS source FROM cold WHERE place <= 10", "inter", "pop", "seen")
def recs_cascade_without_model(m: Model) -> DataFrame:
    """Without any vector only popularity is left."""
    popular = recommend.popular_for_users(m.interactions, m.ranking, m.seen, 10)
    _, sources = recommend.serving_sources(m.embeddings.where("item_id < 0"), m.candidates, None, popular)
    return recommend.cascade(m.interactions, sources, 10)


PLANTED = """planted AS (SELECT user_id, item_id FROM warm WHERE rank <= 10 UNION ALL SELECT user_id, min(item_id) FROM seen WHERE user_id % 7 = 0 GROUP BY user_id
  UNION ALL SELECT user_id, max(item_id) FROM seen WHERE user_id % 14 = 0 GROUP BY user_id)"""


def _planted(m: Model) -> DataFrame:
    """Recommendations into which items that were seen are put for some users."""
    wrong = lambda item, every: m.seen.where(F.col("user_id") % every == 0).groupBy("user_id").agg(item("item_id").alias("item_id"))
    return m.candidates.select("user_id", "item_id").unionByName(wrong(F.min, 7)).unionByName(wrong(F.max, 14))


@query(f"+ {PLANTED} SELECT user_id, item_id FROM planted SEMI JOIN seen USING (user_id, item_id)", *WARM)
def overlap_audit_planted(m: Model) -> DataFrame:
    return recommend.overlap_audit(_planted(m), m.seen)


@query(f"""+ {PLANTED}, b AS (SELECT DISTINCT user_id FROM planted SEMI JOIN seen USING (user_id, item_id)), u AS (SELECT DISTINCT user_id FROM inter)
SELECT count(*) AS users, count(*) FILTER (user_id IN (SELECT user_id FROM planted) AND user_id NOT IN (SELECT user_id FROM b)) AS passed,
  count(*) FILTER (user_id IN (SELECT user_id FROM b)) AS failed, count(*) FILTER (user_id NOT IN (SELECT user_id FROM planted)) AS empty FROM u""", *WARM)
def audit_summary_planted(m: Model) -> DataFrame:
    return recommend.audit_summary(m.interactions, _planted(m), m.seen)


LENGTHS = """uh AS (SELECT *, lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, interaction_id) AS before FROM inter WHERE type <> 'rating' OR rating >= 3.5
), ul AS (SELECT user_id, least(count(*), 50) AS len FROM uh WHERE before IS NULL OR before <> item_id GROUP BY user_id)"""


def _pool(m: Model) -> DataFrame:
    return recommend.similar_for_users(m.queries, m.units, m.seen, 50).select("user_id", "item_id", "score")


@query(f"""+ {PAIRS}, {LENGTHS} SELECT p.user_id, p.item_id, title, CASE WHEN coalesce(len, 0) < 3 THEN 'popularity' ELSE 'generative' END AS variant, coalesce(len, 0) AS history_length,
  CASE WHEN len >= 3 THEN w.score END AS retrieval_score, CASE WHEN len >= 3 THEN w.score END AS rank_score, CASE WHEN len >= 3 THEN coalesce(w.score, 0) END AS feature, CASE WHEN len >= 3 THEN CAST(1 AS DOUBLE) END AS importance
FROM pr p LEFT JOIN ul USING (user_id) LEFT JOIN (SELECT * FROM warm WHERE rank <= 50) w ON w.user_id = p.user_id AND w.item_id = p.item_id LEFT JOIN items i ON i.item_id = p.item_id""", "items", *WARM)
def explain_pairs(m: Model) -> DataFrame:
    """Explanations of a pair for each user without a ranker."""
    rows = explain.recommendation_explanations(_pairs(m), library.user_history(m.interactions), _pool(m), m.items, m.ranking, m.units)
    value = lambda c: F.col(c)["retrieval_score"]
    return rows.select("user_id", "item_id", "title", "variant", "history_length", "retrieval_score", "rank_score", value("features").alias("feature"), value("importance").alias("importance"))
