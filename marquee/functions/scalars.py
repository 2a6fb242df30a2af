"""Column builders: text, dates, numbers, arrays and JSON. Pure Column to Column, no Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AB_SALT, CANONICAL_GENRES, YEAR_MAX, YEAR_MIN

# ---------------------------------------------------------------- text


def parse_delimited(value: Column, delimiter: str, nulls: tuple[str, ...] = ()) -> Column:
    """Trimmed, non-empty parts; null for null, empty, a sentinel, or no parts."""
    parts = F.filter(F.transform(F.split(value, re.escape(delimiter)), lambda x: F.trim(x)), lambda x: x != "")
    absent = value.isNull() | F.trim(value).isin("", *nulls) | (F.size(parts) == 0)
    return F.when(~absent, parts)


def parse_genres(value: Column) -> Column:
    return parse_delimited(value, "|", ("(no genres listed)",))


def parse_imdb_genres(value: Column) -> Column:
    return parse_delimited(value, ",", ("\\N",))


def format_imdb_id(value: Column) -> Column:
    """``tt`` and at least seven digits; longer ids are not cut."""
    s = F.trim(value.cast("string"))
    return F.when(s.startswith("tt"), s).otherwise(F.concat(F.lit("tt"), F.lpad(s, F.greatest(F.lit(7), F.length(s)), F.lit("0"))))


def clean_api_string(value: Column, nulls: tuple[str, ...] = ("N/A",)) -> Column:
    s = F.trim(value)
    return F.when(~s.isin("", *nulls), s)


def normalize_username(value: Column) -> Column:
    """Trimmed and lower-cased; null where shorter than three characters."""
    s = F.lower(F.trim(value))
    return F.when(F.length(s) >= 3, s)


def display_name(display: Column, username: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(display), F.lit("")), username, F.lit(""))


def listing(items: Column) -> Column:
    """"a", "a and b", "a, b, and c"; empty for no items."""
    n = F.size(items)
    last = F.element_at(items, -1)
    return (
        F.when(items.isNull() | (n == 0), "")
        .when(n == 1, F.element_at(items, 1))
        .when(n == 2, F.concat(F.element_at(items, 1), F.lit(" and "), last))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), last))
    )


def truncate(text: Column, most: int) -> Column:
    """Texts over ``most`` characters end in "..." after the last whole word of the first most - 3."""
    head = F.regexp_replace(F.substring(text, 1, most - 3), " [^ ]*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit("...")))


def item_text(item_id: Column, title: Column, description: Column, genres: Column, actors: Column, director: Column) -> Column:
    """What an encoder reads of an item."""
    none = lambda c: F.nullif(c, F.lit(""))
    text = F.concat_ws(". ", none(title), none(description), none(F.array_join(genres, ", ")), none(actors), none(director))
    return F.coalesce(none(text), none(title), F.concat(F.lit("item "), item_id.cast("string")))


def url_extension(url: Column) -> Column:
    """jpg, png or webp from a URL's path; null for others."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "jpg").when(ext.isin("png", "webp"), ext)


def poster_extension(content_type: Column, url: Column) -> Column:
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    by_type = F.when(kind.isin("image/jpeg", "image/jpg"), "jpg").when(kind == "image/png", "png").when(kind == "image/webp", "webp")
    return F.coalesce(by_type, url_extension(url), F.lit("jpg"))


# ---------------------------------------------------------------- dates


def whole_number(value: Column) -> Column:
    """Like Python's int() on a string: null for what is not a whole number."""
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("int"))


def display_year(start_year: Column, year: Column, release_date: Column) -> Column:
    head = F.when(F.length(release_date) >= 4, F.substring(release_date, 1, 4))
    return F.coalesce(whole_number(start_year), whole_number(year), whole_number(head))


def ranker_year(start_year: Column, year: Column) -> Column:
    """The first non-empty of the two; null if that one is no number."""
    return whole_number(F.coalesce(F.nullif(start_year, F.lit("")), year))


def normalize_year(year: Column) -> Column:
    share = (year.cast("double") - YEAR_MIN) / float(YEAR_MAX - YEAR_MIN)
    return F.when(year.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


# ---------------------------------------------------------------- numbers


def quantized(x: Column) -> Column:
    """Six decimals, by the same IEEE operations in every engine; ranks are taken on this."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column, floor: float = 1e-12) -> Column:
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / length)


def genre_overlap_ratio(candidate: Column, history: Column) -> Column:
    """|distinct candidate genres in history| / |candidate list|; 0 for none."""
    empty = F.array().cast("array<string>")
    c, h = F.coalesce(candidate, empty), F.coalesce(history, empty)
    return F.when(F.size(c) == 0, 0.0).otherwise(F.size(F.array_intersect(c, h)) / F.size(c))


def ab_bucket(user_id: Column, salt: str = AB_SALT) -> Column:
    """A user's place in [0, 1], from the first eight hex digits of a hash."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), user_id.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def ab_variant(user_id: Column, fraction: float = 0.5) -> Column:
    return F.when(ab_bucket(user_id) < fraction, "generative").otherwise("popularity")


# ---------------------------------------------------------------- arrays and JSON


def lowered(genres: Column) -> Column:
    return F.transform(F.coalesce(genres, F.array().cast("array<string>")), F.lower)


def distinct_labels(labels: list[str]) -> list[str]:
    """Trimmed labels without empty ones and without repeats in other case."""
    out: dict[str, str] = {}
    for label in labels:
        if label.strip():
            out.setdefault(label.strip().lower(), label.strip())
    return list(out.values())


def canonical_genres(preferred: Column) -> Column:
    """Preferred genres that are canonical, in canonical order, once each."""
    trimmed = F.transform(preferred, lambda x: F.trim(x))
    return F.filter(F.array(*map(F.lit, CANONICAL_GENRES)), lambda g: F.array_contains(trimmed, g))


def padded(items: Column, length: int) -> Column:
    """The last ``length`` items, padded on the right with 0."""
    tail = F.slice(items, F.greatest(F.lit(1), F.size(items) - length + 1), F.lit(length))
    return F.concat(tail, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), length - F.size(items))))


def padding_mask(items: Column, length: int) -> Column:
    """True where ``padded`` holds an item."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= F.size(items))


def merged_metadata(old: Column, new: Column) -> Column:
    """Shallow merge of string maps; keys of ``new`` win."""
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    kept = F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k))
    return F.map_concat(kept, n)
