"""Files, caches and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from marquee.operators import library
from marquee.operators.predict import Config, weights_of
from marquee.sources import files, testdata
from marquee.streaming import interactions as streams

CSVS = {
    "movies.csv": 'movieId,title,genres\n880001,"Fixture, Movie A (1995)",Adventure|Comedy\n880002,Fixture Movie B (1995),Adventure|Children\n',
    "links.csv": "movieId,imdbId,tmdbId\n880001,0114709,862\n880002,0113497,8844\n",
    "ratings.csv": "userId,movieId,rating,timestamp\n1,880001,4.0,1000000000\n1,880002,3.5,1000000300\n2,880002,5.0,1000000400\n",
    "tags.csv": "userId,movieId,tag,timestamp\n1,880001,pixar,1000000000\n1,880001, animation,1000000100\n2,880002,adventure,1000000200\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in CSVS.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_ingest(spark, folder):
    items, rows, counts = files.ingest(spark, folder)
    assert counts == {"items": 2, "links": 2, "tags": 3, "ratings": 3} and rows.count() == 6
    a = {r.item_id: r for r in items.collect()}[880001]
    assert a.imdb_id == "tt0114709" and a.title == "Fixture, Movie A (1995)" and a.genres == ["Adventure", "Comedy"]
    assert json.loads(a.metadata["tags"]) == ["animation", "pixar"] and a.metadata["tmdb_id"] == "862"
    first = rows.where("type = 'rating' and user_id = 1").orderBy("ts").first()
    assert first.context == '{"rating":4.0}' and str(first.ts) == "2001-09-09 01:46:40"
    again, _, _ = files.ingest(spark, folder, items.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("x"), F.lit("y")))))
    assert {r.metadata["x"] for r in again.collect()} == {"y"}
    assert files.numbered(rows, 10).agg(F.countDistinct("interaction_id"), F.min("interaction_id")).first()[:] == (6, 11)


def test_portfolio(spark, folder):
    items, ratings = files.portfolio(spark, folder, most_movies=1, most_ratings=1)
    assert [r.item_id for r in items.collect()] == [880001] and ratings.count() == 1
    assert files.parse_int_list("10, 20,50,") == (10, 20, 50)


def test_tsv_enrichment(spark, tmp_path):
    def write(name, text):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
        return str(tmp_path / name)

    items = spark.createDataFrame([(1, "tt1", ["Old"], {"a": "b"}), (2, "tt2", None, None)], "item_id bigint, imdb_id string, genres array<string>, metadata map<string,string>")
    columns = ["tconst", "titleType", "primaryTitle", "originalTitle", "startYear", "runtimeMinutes", "genres"]
    path = write("b.tsv.gz", "\t".join(columns) + "\ntt1\tmovie\tP\t\\N\t1995\t\\N\t\\N\ntt2\tmovie\tQ\tQ\t\\N\t90\tAction,Comedy\ntt9\tx\tx\tx\tx\tx\tx\n")
    got = {r.item_id: r for r in files.with_basics(items, files.imdb_tsv(spark, path, columns)).collect()}
    assert got[1].genres == ["Old"] and got[1].metadata == {"a": "b", "title_type": "movie", "primary_title": "P", "start_year": "1995"}
    assert got[2].genres == ["Action", "Comedy"] and got[2].metadata["runtime_minutes"] == "90"
    path = write("r.tsv.gz", "tconst\taverageRating\tnumVotes\ntt1\t7.5\t100\ntt2\t\\N\t\\N\n")
    got = {r.item_id: r for r in files.with_title_ratings(items, files.imdb_tsv(spark, path, ["tconst", "averageRating", "numVotes"], 2)).collect()}
    assert got[1].metadata["imdb_average_rating"] == "7.5" and got[2].metadata == {}
    principals = spark.createDataFrame(
        [("tt1", str(i) if i != 3 else None, f"n{i}", "actor" if i % 2 else "actress") for i in range(1, 8)] + [("tt1", "0", "n0", "director"), ("tt5", "1", "n1", "self")],
        "tconst string, ordering string, nconst string, category string",
    )
    names = spark.createDataFrame([("n1", "One"), ("n2", None), ("n4", "Four"), ("n5", "Five"), ("n6", "Six"), ("n7", "Seven")], "nconst string, primaryName string")
    got = {r.item_id: r for r in files.with_cast(items, principals, names).collect()}
    assert got[1].metadata["actors"] == "One, Four, Five, Six" and got[2].metadata == {}  # n2 has no name, n3 comes last


def test_enrich_from_a_dump(spark, tmp_path):
    """All files of a folder in one call; those that are missing are named first."""

    items = spark.createDataFrame([(1, "tt1", None, {"a": "b"}), (2, None, ["X"], None), (3, "tt3", None, None)], "item_id bigint, imdb_id string, genres array<string>, metadata map<string,string>")
    tables = {
        "title.basics.tsv.gz": [["tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"], ["tt1", "movie", "P", "P", "0", "1995", "\\N", "81", "Drama"], ["tt8", "movie", "Q", "Q", "0", "1996", "\\N", "1", "War"]],
        "title.ratings.tsv.gz": [["tconst", "averageRating", "numVotes"], ["tt1", "8.3", "900"], ["tt3", "7.1", "5"]],
        "title.principals.tsv.gz": [["tconst", "ordering", "nconst", "category", "job", "characters"], ["tt1", "2", "n2", "actress", "\\N", "\\N"], ["tt1", "1", "n1", "actor", "\\N", "\\N"], ["tt8", "1", "n1", "actor", "\\N", "\\N"]],
        "name.basics.tsv.gz": [["nconst", "primaryName", "birthYear"], ["n1", "One", "1950"], ["n2", "Two", "\\N"]],
    }
    for name in list(tables)[:2]:
        (tmp_path / name).write_bytes(gzip.compress("\n".join("\t".join(r) for r in tables[name]).encode()))
    with pytest.raises(FileNotFoundError, match=r"title.principals.tsv.gz, name.basics.tsv.gz"):
        files.enrich(spark, f"file://{tmp_path}", items)
    assert files.required_files(False) == list(tables)[:2]
    assert files.enrich(spark, f"file://{tmp_path}", items, cast=False)[1] == {"imdb_ids": 2, "basics": 1, "ratings": 2, "cast": 0}
    for name in list(tables)[2:]:
        (tmp_path / name).write_bytes(gzip.compress("\n".join("\t".join(r) for r in tables[name]).encode()))
    out, counts = files.enrich(spark, f"file://{tmp_path}", items, partitions=2)
    got = {r.item_id: r for r in out.collect()}
    assert counts == {"imdb_ids": 2, "basics": 1, "ratings": 2, "cast": 1} and set(got) == {1, 2, 3}
    assert got[1].genres == ["Drama"] and got[1].metadata == {
        "a": "b", "primary_title": "P", "original_title": "P", "title_type": "movie", "start_year": "1995", "runtime_minutes": "81",
        "imdb_average_rating": "8.3", "imdb_num_votes": "900", "actors": "One, Two",
    }
    assert got[2].genres == ["X"] and got[3].metadata == {"imdb_average_rating": "7.1", "imdb_num_votes": "5"}


def test_timing():
    from marquee.operators.evaluate import Timing

    timing = Timing({"history": 1.234, "ranking": 2.0})
    with timing.step("ranking"):
        pass
    got = timing.as_dict()
    assert list(got) == ["history_ms", "ranking_ms", "total_ms"] and got["history_ms"] == 1.23 and 2.0 <= got["ranking_ms"] < 50
    assert got["total_ms"] == pytest.approx(got["history_ms"] + got["ranking_ms"], abs=0.02)


def test_api_documents(spark):
    tmdb = {"id": 862, "overview": " Toys. ", "poster_path": "/p.jpg", "tagline": "", "release_date": "1995-10-30", "vote_average": 7.7, "vote_count": 5, "original_language": "en", "genres": [{"id": 1, "name": "Animation"}, {"id": 2, "name": ""}]}
    omdb = {"Title": "T", "Year": "1995", "Rated": "N/A", "Genre": "Animation, , Comedy", "Plot": "P", "Poster": "N/A", "Actors": "A, B", "Ratings": [{"Source": "s", "Value": "v"}], "Type": "movie", "Response": "True"}
    rows = spark.createDataFrame([(json.dumps(tmdb), json.dumps(omdb)), ('{"success": false}', '{"Response": "False"}')], "t string, o string")
    got = rows.select(files.tmdb_patch(F.col("t")).alias("t"), files.omdb_patch(F.col("o")).alias("o")).collect()
    t, o = got[0]
    assert (t.description, t.image_url, t.genres) == ("Toys.", "https://image.tmdb.org/t/p/w500/p.jpg", ["Animation"])
    assert t.metadata == {"release_date": "1995-10-30", "tmdb_vote_average": "7.7", "tmdb_vote_count": "5", "original_language": "en"}
    assert (o.description, o.image_url, o.genres) == ("P", None, ["Animation", "Comedy"])
    assert o.metadata == {"year": "1995", "actors": "A, B", "omdb_type": "movie", "omdb_ratings": '[{"Source":"s","Value":"v"}]'}
    assert got[1].t is None and got[1].o is None


def test_posters(spark, tmp_path):
    for name, data in (("1.png", b"x"), ("1.jpg", b"x"), ("2.webp", b"x"), ("3.jpg", b""), ("x.jpg", b"x"), ("4.gif", b"x")):
        (tmp_path / name).write_bytes(data)
    assert {(r.item_id, r.file) for r in files.posters(spark, str(tmp_path)).collect()} == {(1, "1.jpg"), (2, "2.webp")}


def test_caches(spark, tmp_path):
    path, built = str(tmp_path / "c"), []

    def build():
        built.append(1)
        return spark.range(3)

    for parameters, rebuild, want in (({"min": 3.5}, False, "build"), ({"min": 3.5}, False, "cache"), ({"min": None}, False, "build"), ({"min": None}, True, "build")):
        table, source = files.cached(build, spark, path, files.fingerprint(**parameters), rebuild)
        assert source == want and table.count() == 3
    assert len(built) == 3
    w = weights_of(Config(dimension=4, hidden=4, heads=2, layers=1, feed=4))
    files.save_weights(spark, w, str(tmp_path / "w"), {"d": 4})
    back = files.load_weights(spark, str(tmp_path / "w"), {"d": 4})
    assert back.keys() == w.keys() and all((back[k] == w[k]).all() for k in w)
    assert files.load_weights(spark, str(tmp_path / "w"), {"d": 5}) is None
    files.write_json(spark, {"recall@10": 0.5}, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0]) == {"recall@10": 0.5}
    assert files.model_version("models/a", "2024-01-02", 0.01769) == "models/a@2024-01-02_r10=0.0177"


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(3, "ts")
    rows.write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_streamed_append_equals_batch(spark, sf_dir, event_files, tmp_path):
    items = testdata.items(spark, sf_dir)
    valid, rejected = streams.split_by_validity(streams.event_stream(spark, event_files), items)
    for _ in range(2):  # the second run finds nothing new
        for stream, name in ((valid, "ok"), (rejected, "bad")):
            streams.append(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    batch = library.validated(
        spark.read.parquet(event_files).select(F.col("event_id").alias("interaction_id"), F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), F.col("event_type").alias("type")), items
    )
    assert spark.read.parquet(str(tmp_path / "ok")).count() == batch.where("reason is null").count() > 0
    assert spark.read.parquet(str(tmp_path / "bad")).count() == batch.where("reason is not null").count() > 0


def run_to_memory(spark, stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_streamed_popularity(spark, event_files):
    stream = streams.event_stream(spark, event_files)
    got = {r.item_id: r.n for r in run_to_memory(spark, streams.popularity(stream), "pop", "complete").collect()}
    k = F.get_json_object("props", "$.k").cast("bigint").alias("item_id")
    assert got == {r.item_id: r["count"] for r in spark.read.parquet(event_files).groupBy(k).count().collect()}
    windows = run_to_memory(spark, streams.windowed_popularity(stream, "30 days", "1 day"), "win", "append")
    assert 0 < windows.agg(F.sum("n")).first()[0] <= sum(got.values())


def test_recent_history_state(spark, event_files):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = streams.event_stream(spark, event_files, files_per_trigger=10)
        got = {r.user_id: r.history for r in run_to_memory(spark, streams.recent_history(stream, 5, 0), "recent", "update").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for user, history in got.items():
        items = history.split("|")
        assert len(items) <= 5 and all(a != b for a, b in zip(items, items[1:], strict=False)), user
    assert len(got) == spark.read.parquet(event_files).select("user_id").distinct().count()
