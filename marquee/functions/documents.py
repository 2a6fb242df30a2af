"""JSON documents as VARIANT columns: tolerant parsing, keys, containment, text of values, merging.

A document is any JSON value. Every builder gives null for a null document, and predicates then are false, so they can
stand in a filter as they are.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType

NUMBERS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"


def path(*keys: str | int) -> str:
    """The path of nested keys and array places; keys may hold any characters but a single quote."""
    if any("'" in k for k in keys if isinstance(k, str)):
        raise ValueError("a key with a quote has no path")
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def value(document: Column, *keys: str | int) -> Column:
    """The value there, itself a document (which may be JSON's null); null where there is none."""
    return F.variant_get(document, path(*keys), "variant")


def kind(document: Column) -> Column:
    """object, array, string, number, boolean or null."""
    schema = F.schema_of_variant(document)
    return (
        F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").when(schema.rlike(NUMBERS), "number")
    )


def elements(document: Column) -> Column:
    """An array's elements, as documents; none for other values."""
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(document, "$", "array<variant>"), empty)


def members(document: Column) -> Column:
    """An object's values by key; none for other values."""
    empty = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.try_variant_get(document, "$", "map<string,variant>"), empty)


def parsed(text: Column) -> Column:
    """Text as a document: a null is an empty object, what is not JSON is null (see ``malformed``)."""
    return F.when(text.isNull(), F.parse_json(F.lit("{}"))).otherwise(F.try_parse_json(text))


def malformed(text: Column) -> Column:
    """Whether there is text that is not JSON."""
    return text.isNotNull() & F.try_parse_json(text).isNull()


def as_document(df: DataFrame, column: str) -> Column:
    """A column of text, documents, structs or maps as documents; its nulls are empty objects."""
    data = df.schema[column].dataType
    if isinstance(data, StringType):
        return parsed(F.col(column))
    document = F.col(column) if isinstance(data, VariantType) else F.to_variant_object(F.col(column))
    return F.coalesce(document, F.parse_json(F.lit("{}")))


def _is_text(document: Column, text: str) -> Column:
    return (F.schema_of_variant(document) == "STRING") & (F.try_variant_get(document, "$", "string") == text)


def has_key(document: Column, key: str) -> Column:
    """Whether an object has the key, whatever its value, null included; or an array, or the value itself, the string."""
    found = value(document, key).isNotNull() | F.exists(elements(document), lambda e: _is_text(e, key)) | _is_text(document, key)
    return F.coalesce(found, F.lit(False))


def contains(document: Column, pattern) -> Column:
    """Whether the document contains the pattern (dicts, lists, strings, numbers, booleans, None): objects by the
    pattern's keys, arrays by elements in any order, other values by equality. An array also contains a single value."""
    found = _contains(document, pattern)
    if not isinstance(pattern, (dict, list)):
        found = F.coalesce(found, F.lit(False)) | _some(document, pattern)
    return F.coalesce(found, F.lit(False))


def _some(document: Column, pattern) -> Column:
    return F.exists(elements(document), lambda e: F.coalesce(_contains(e, pattern), F.lit(False)))


def _contains(document: Column, pattern) -> Column:
    all_ = lambda tests: functools.reduce(operator.and_, tests)
    if isinstance(pattern, dict):
        return all_([kind(document) == "object", *(_contains(value(document, k), v) for k, v in pattern.items())])
    if isinstance(pattern, list):
        return all_([kind(document) == "array", *(_some(document, v) for v in pattern)])
    if pattern is None:
        return F.is_variant_null(document)
    if isinstance(pattern, bool):
        return (kind(document) == "boolean") & (F.try_variant_get(document, "$", "boolean") == pattern)
    if isinstance(pattern, (int, float)):
        return (kind(document) == "number") & (F.try_variant_get(document, "$", "double") == float(pattern))
    return _is_text(document, pattern)


def text(document: Column, *keys: str | int) -> Column:
    """The value there as text: strings as they are, objects and arrays as JSON, JSON's null as null."""
    found = value(document, *keys) if keys else document
    return F.when(kind(found).isin("object", "array"), F.to_json(found)).otherwise(F.try_variant_get(found, "$", "string"))


def whole(document: Column, *keys: str | int) -> Column:
    """The value there as a whole number: numbers without their fraction, text that spells one; null for others."""
    found, named = value(document, *keys), kind(value(document, *keys))
    spelt = F.try_variant_get(found, "$", "string")
    return (
        F.when(named == "number", F.try_variant_get(found, "$", "double").try_cast("bigint"))
        .when(named == "boolean", F.try_variant_get(found, "$", "boolean").cast("bigint"))
        .when((named == "string") & spelt.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(spelt).try_cast("bigint"))
    )


def texts(document: Column, *keys: str | int) -> Column:
    """The elements of the array there as text, JSON's null as null; none where there is no array."""
    return F.transform(elements(value(document, *keys)), lambda e: text(e))


def merged(old: Column, new: Column) -> Column:
    """Two objects as one, by their first level; keys of ``new`` win. What is no object counts as empty."""
    o, n = members(old), members(new)
    return F.to_variant_object(F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n))


def year(document: Column) -> Column:
    """The first of start_year and year that is a whole number, else the first four characters of release_date."""
    date = value(document, "release_date")
    head = F.when(kind(date) == "string", F.substring(F.try_variant_get(date, "$", "string"), 1, 4))
    spelt = F.when((F.length(head) == 4) & head.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(head).try_cast("bigint"))
    return F.coalesce(whole(document, "start_year"), whole(document, "year"), spelt).cast("int")
