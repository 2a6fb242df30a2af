"""Positions of regular-expression matches with built-in functions only.

``split`` gives what lies between matches and ``regexp_extract_all`` the matches; both scan leftmost, without overlap.
Starts are running sums of both lengths, in code points, taken over exploded matches, so that a text with very many
matches costs no more than a sort of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE, AFTER = 24, 8


def hits(text: Column, kind: str, pattern: str, may_match: Column) -> Column:
    """array<struct<kind, i, gap, hit, before, after>> of one pattern; empty where ``may_match`` is false."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # one row more than matches: the last stretch of text, whose hit is null
    found = F.zip_with(
        matched,
        between,
        lambda h, b: F.struct(
            F.lit(kind).alias("kind"),
            F.length(b).alias("gap"),
            h.alias("hit"),
            F.right(b, F.lit(BEFORE)).alias("before"),
            F.left(b, F.lit(AFTER)).alias("head"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,gap:int,hit:string,before:string,head:string>>")
    return F.when(may_match, found).otherwise(none)


def located(rows: DataFrame, found: list[str]) -> DataFrame:
    """(row, kind, start, end, hit, before, after) for each match in the array columns ``found`` of ``rows``."""
    each = None
    for name in found:
        part = rows.where(F.size(name) > 1).select("row", F.posexplode(name).alias("i", "h"))
        part = part.select("row", F.lit(name).alias("scan"), "i", "h.kind", "h.gap", "h.hit", "h.before", "h.head")
        each = part if each is None else each.unionByName(part)
    w = Window.partitionBy("row", "scan").orderBy("i")
    size = F.coalesce(F.length("hit"), F.lit(0))
    to = F.sum(F.col("gap") + size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        each.select("*", to.cast("int").alias("end"), F.lead("head").over(w).alias("after"))
        .where(F.col("hit").isNotNull())
        .select("row", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "before", "after")
    )


def numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, doc_id, text): rows are told apart even if ids repeat; numbers hold once the table is written."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_column].alias("doc_id"),
        F.coalesce(docs[text_column], F.lit("")).alias("text"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of an array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
