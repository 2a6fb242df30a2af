"""Schemas and constants of the recommendation model."""

from __future__ import annotations

# Parameters of the model: fixed values.
INTERACTION_TYPES = ("view", "rating", "tag", "click", "purchase")
MIN_RATING, MIN_INTERACTIONS, MAX_SEQ_LEN = 3.5, 3, 50
TRAIN_RATIO, VAL_RATIO, SPLIT_SEED = 0.8, 0.1, 42
CANDIDATE_POOL, POPULARITY_LIMIT, GENRE_POOL = 50, 500, 500
RECENT_WINDOW, YEAR_MIN, YEAR_MAX = 5, 1970, 2024
TEMPERATURE, GENRE_WEIGHT = 0.07, 10_000
AB_SALT = "generative_vs_popularity"

#: Genres that can be listed and preferred, in display order. Fixed values.
CANONICAL_GENRES = (
    "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir",
    "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western",
)

# Columns and keys of the sources: fixed values.
MOVIES_CSV = "movieId int, title string, genres string"
LINKS_CSV = "movieId int, imdbId string, tmdbId int"
RATINGS_CSV = "userId int, movieId int, rating double, timestamp bigint"
TAGS_CSV = "userId int, movieId int, tag string, timestamp bigint"
ITEMS = (
    "item_id bigint, imdb_id string, title string, description string, genres array<string>, image_url string, "
    "metadata map<string,string>"
)
INTERACTIONS = (
    "interaction_id bigint, user_id bigint, item_id bigint, ts timestamp, type string, rating double, source string"
)
TMDB = (
    "id int, overview string, poster_path string, tagline string, release_date string, vote_average double, "
    "vote_count bigint, original_language string, genres array<struct<id:int,name:string>>"
)
OMDB = (
    "Title string, Year string, Rated string, Released string, Runtime string, Genre string, Director string, "
    "Writer string, Actors string, Plot string, Language string, Country string, Awards string, Poster string, "
    "Ratings array<struct<Source:string,Value:string>>, Metascore string, imdbRating string, imdbVotes string, "
    "imdbID string, BoxOffice string, Production string, Response string"
)
