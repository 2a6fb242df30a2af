"""Personal data by known formats and by gradient-boosted candidates, in DataFrame functions only.

Base spans: email addresses, IPv4 addresses, card numbers (Luhn), international phone numbers. The method adds spans
of kind ``pii``: high-recall generators (anything around an @, any group of digits with separators) propose
overlapping candidates; boosted trees (``pyspark.ml``) score each from the format of its characters and from the words
next to it; thresholds calibrated for each format select what is redacted, the best of overlapping candidates.

What is to be added is what the base patterns miss, so the trees learn from more than base spans. From all candidates
that meet a base span, three kinds of rows are made: the candidate itself and a near miss of it (a
typo in a domain, a changed check digit, an octet out of range, a missing plus) as positives in its own context, and a
date, a version, an order number or a mention as a negative, in half of the cases in a plain one. Candidates of the corpus that are plainly
dates, versions or amounts are negatives, too, and never added.
Copies of a candidate in the same words count once; nothing else is left out, so models and thresholds come from the
whole table.

Two halves are cross-fitted: each is scored by trees that have not seen it. A format's threshold is the least score at
which, of near misses and negatives of that format, TARGET_PRECISION are near misses; what is added has the mean score
of both. Where candidates of one kind of label are missing, nothing can be learned and nothing is added.

Defined results: a null or empty text has no spans (counts 0, empty lists). Repeated rows and repeated or null ids
give a row each. Positions are code points, ends exclusive. Only the two named columns are read. Whole texts are
scanned; matches are never retried or capped.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .spans import hits, listed, located, numbered

TARGET_PRECISION = 0.95
TREES, DEPTH = 8, 4
#: Near misses, and look-alikes, made of each candidate that is learned from.
VARIANTS = 4
#: Bins of the calibration table.
SCORE_BINS = 200

# Possessive forms of the plain patterns: they match the same, without deep recursion on long runs. The look-behind
# starts each run once (\G: where the match before ended, from which a run may go on).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"  # a lone digit is no match, but fails on its length anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators of candidates.
LOOSE_AT = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D@]++(?:@[^\x20\x09-\x0D@]*+)++"
LOOSE_DIGITS = r"[+(]?[0-9](?:[\x20().-]?[0-9]){6,}+"
KINDS = ("email", "ip", "card", "phone", "pii")

#: Words that stand next to personal data, in the languages of the corpus.
CONTEXT = r"(?i)(?:mail|e-mail|phone|tel|mobile|call|fax|card|visa|ip|host|addr|contact|ssn|iban|kontakt|telefon|correo|carte)"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a correct check digit."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    codes = F.transform(F.split(F.reverse(number), ""), lambda c: F.ascii(c) - 48)
    total = F.aggregate(
        F.transform(codes, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def passing(kind: Column, hit: Column) -> Column:
    """Whether a base match passes its kind's check. Conditions are nested so that only few matches reach Luhn."""
    number = digits(hit)
    n = F.length(number)
    octets = F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.try_to_number(F.concat(F.lit("0"), F.right(p, F.lit(3))), F.lit("9999")) <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", octets)
        .when(kind == "card", F.when((n < 16) | (n > 19), False).otherwise(luhn(number)))
        .when(kind == "phone", (n >= 8) & (n <= 15))
    )


FEATURES = [
    "f_length", "f_digits", "f_letters", "f_dots", "f_spaces", "f_dashes", "f_at", "f_plus", "f_groups", "f_distinct",
    "f_last_dots", "f_tail_letters", "f_head", "f_context", "f_before_word", "f_after_word", "f_upper",
]


def features(df: DataFrame) -> DataFrame:
    """Format and context of candidates (hit, before, after)."""
    hit = F.col("hit")
    count = lambda pattern: F.length(F.regexp_replace(hit, pattern, "")).cast("double")
    after_at = F.substring_index(hit, "@", -1)
    return df.select(
        "*",
        F.length(hit).cast("double").alias("f_length"),
        count("[^0-9]").alias("f_digits"),
        count(r"[^\p{L}]").alias("f_letters"),
        count("[^.]").alias("f_dots"),
        count("[^ ]").alias("f_spaces"),
        count("[^-]").alias("f_dashes"),
        count("[^@]").alias("f_at"),
        hit.startswith("+").cast("double").alias("f_plus"),
        F.size(F.split(hit, "[^0-9]+")).cast("double").alias("f_groups"),
        F.size(F.array_distinct(F.split(digits(hit), ""))).cast("double").alias("f_distinct"),
        F.length(F.regexp_replace(after_at, "[^.]", "")).cast("double").alias("f_last_dots"),
        F.length(F.regexp_extract(hit, "([A-Za-z]*)$", 1)).cast("double").alias("f_tail_letters"),
        F.coalesce(F.col("before"), F.lit("")).rlike(CONTEXT).cast("double").alias("f_context"),
        F.coalesce(F.col("before"), F.lit("")).rlike(r"[\p{L}0-9]$").cast("double").alias("f_before_word"),
        F.coalesce(F.col("after"), F.lit("")).rlike(r"^[\p{L}0-9]").cast("double").alias("f_after_word"),
        count("[^A-Z]").alias("f_upper"),
        F.length(F.substring_index(hit, "@", 1)).cast("double").alias("f_head"),
    )


#: Formats of candidates, each with its own threshold.
FORMATS = ("at", "dotted", "plus", "digits")
# What is plainly no personal data: dates, versions, amounts.
HARMLESS = r"^(?:(?:1[89]|20)[0-9]{2}([-.\x20])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])(?:\x20[0-9]{1,2}(?:[.][0-9]{2})?)?|(?:0?[1-9]|[12][0-9]|3[01])([-.])(?:0?[1-9]|1[0-2])\2(?:1[89]|20)[0-9]{2}|[0-9]{1,4}(?:[.][0-9]{1,3}){4,}|[0-9]+[.][0-9]+)$"


def format_of(hit: Column) -> Column:
    return (
        F.when(hit.contains("@"), "at")
        .when(hit.startswith("+") | hit.startswith("("), "plus")
        .when(hit.rlike(r"^[0-9]+(?:\.[0-9]+){2,}$"), "dotted")
        .otherwise("digits")
    )


def near_miss(hit: Column, h: Column) -> Column:
    """A hit with an error that no base pattern takes, drawn by the hash ``h``; null if there is none for it."""
    last = F.substring_index(hit, ".", -1)
    head = F.substring(hit, 1, F.length(hit) - F.length(last) - 1)
    typo = (
        F.when(h % 3 == 0, F.concat(head, last))
        .when(h % 3 == 1, F.concat(head, F.lit(","), last))
        .otherwise(F.replace(hit, F.lit("@"), F.lit("@@")))
    )
    other = F.pmod(F.right(hit, F.lit(1)).try_cast("int") + 1 + F.pmod(h, F.lit(8)).cast("int"), F.lit(10)).cast("string")
    check = F.concat(F.substring(hit, 1, F.length(hit) - 1), other)
    kind = format_of(hit)
    return (
        F.when((kind == "at") & hit.contains("."), typo)
        .when(kind == "dotted", F.concat(head, F.lit("."), (256 + F.pmod(h, F.lit(700))).cast("string")))
        .when(kind == "plus", F.regexp_replace(hit, "^[+]", ""))
        .when(kind == "digits", F.when(F.length(digits(hit)) >= 16, check))
    )


def look_alike(kind: Column, h: Column) -> Column:
    """Harmless text that a generator of the format would propose, drawn by the hash ``h``."""
    n = lambda shift, size: F.pmod(F.shiftright(h, shift), F.lit(size)).cast("int")
    date = F.format_string("%d-%02d-%02d", 1950 + n(3, 90), 1 + n(11, 12), 1 + n(17, 28))
    order = F.format_string("%09d", n(5, 999_999_999))
    long_order = F.format_string("%05d%08d", n(5, 99_999), n(23, 99_999_999))
    version = F.format_string("%d.%d.%d.%d", n(3, 30), n(11, 100), n(17, 2100), n(29, 1000))
    mention = F.format_string("@user%d", n(3, 10_000))
    unit = F.format_string("%d@%d.%d", n(3, 100), n(11, 100), n(17, 10))
    of_digits = F.when(h % 3 == 0, date).when(h % 3 == 1, order).otherwise(long_order)
    return F.when(kind == "at", F.when(h % 2 == 0, mention).otherwise(unit)).when(kind == "dotted", version).otherwise(of_digits)


def training_rows(candidates: DataFrame) -> DataFrame:
    """(hit, before, after, label, of, format, half) from candidates (hit, before, after, label), of all of them."""
    known = candidates.select("hit", "before", "after", "label").distinct()  # copies of documents teach nothing more
    real = known.where("label = 1")
    dull = known.where((F.col("label") == 0) & F.col("hit").rlike(HARMLESS))
    half = F.pmod(F.shiftright(F.xxhash64("hit", "before"), 40), F.lit(2)).cast("int").alias("half")
    h = F.xxhash64("hit", "before", "variant")
    kind = format_of(F.col("hit"))
    plain = lambda c, other: F.when(h % 2 == 0, F.col(c)).otherwise(F.lit(other))  # noqa: E731  context alone must not tell
    row = lambda c, label, of, before, after: F.struct(
        c.alias("hit"), before.alias("before"), after.alias("after"), F.lit(label).alias("label"), F.lit(of).alias("of")
    )
    before, after = F.col("before"), F.col("after")
    rows = F.array(
        row(F.when(F.col("variant") == 0, F.col("hit")), 1.0, "base", before, after),
        row(near_miss(F.col("hit"), h), 1.0, "miss", before, after),
        row(look_alike(kind, F.shiftright(h, 1)), 0.0, "dull", plain("before", "see the "), plain("after", " and")),
    )
    varied = real.select("*", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"))
    made = varied.select(half, F.explode(rows).alias("r")).select("r.*", "half").where("hit is not null")
    own = dull.select("hit", "before", "after", F.lit(0.0).alias("label"), F.lit("dull").alias("of"), half)
    return made.unionByName(own).withColumn("format", kind)


def fit(candidates: DataFrame) -> tuple[list[PipelineModel], dict[str, tuple[float, float, float]]] | None:
    """Boosted trees of both halves, and by format: threshold, precision and recall of near misses in the half that the
    trees have not seen. Candidates: (hit, before, after, label)."""
    sample = saved(features(training_rows(candidates)), "pii-train").persist()
    try:
        labels = {(r["half"], r["label"]) for r in sample.select("half", "label").distinct().collect()}
        if len(labels) < 4:
            return None
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, labelCol="label", maxBins=16)
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        models = [
            PipelineModel([assembler, trees.fit(assembler.transform(sample.where(F.col("half") == half)).select("features", "label"))])
            for half in (0, 1)
        ]
        unseen = None
        for half, model in enumerate(models):
            other = scored(model, sample.where((F.col("half") != half) & (F.col("of") != "base"))).select("format", "label", "score")
            unseen = other if unseen is None else unseen.unionByName(other)
        bins = unseen.groupBy("format", F.floor(F.col("score") * SCORE_BINS).alias("bin")).agg(
            F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n")
        ).collect()  # fmt: skip  # (SCORE_BINS + 1) rows for each format at most
    finally:
        sample.unpersist()
    found = {}
    for name in FORMATS:
        own = sorted((r for r in bins if r["format"] == name), key=lambda r: -r["bin"])
        total, hits_, n, best = sum(r["hits"] for r in own), 0.0, 0, (2.0, 0.0, 0.0)
        below = [r["bin"] + 1 for r in own[1:]] + [0]  # scores down to the next bin that has any take the same rows
        for r, least in zip(own, below, strict=False):
            hits_, n = hits_ + r["hits"], n + r["n"]
            if hits_ >= TARGET_PRECISION * n and r["bin"] >= SCORE_BINS // 2:
                best = (max(least, SCORE_BINS // 2) / SCORE_BINS, hits_ / n, hits_ / total)
        found[name] = best
    return models, found


def best_apart(spans: DataFrame) -> DataFrame:
    """Of spans (row, start, end, score) that overlap, directly or through others, the best, and what is apart from it."""
    w = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cluster = F.sum(F.when(reach > F.col("start"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    of = Window.partitionBy("row", "cluster")
    best = F.max(F.struct("score", (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("at"), "end")).over(of)
    rows = spans.withColumn("cluster", cluster).withColumn("best", best)
    first = -F.col("best.at")
    same = (F.col("start") == first) & (F.col("end") == F.col("best.end"))
    return rows.where(same | (F.col("end") <= first) | (F.col("start") >= F.col("best.end"))).drop("cluster", "best")


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def may_hold(text: Column) -> Column:
    """False only for texts in which no pattern or generator finds anything."""
    found = text.contains("@") | text.contains("+") | text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]") | text.rlike(r"[0-9](?:[\x20().-]?[0-9]){6}")
    return F.coalesce(found, F.lit(False))


def scan_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, text, spans): all spans of each row as array<struct<kind_no, start, end, kind>>, by kind, then start."""
    text = F.col("text")
    at, digit7 = text.contains("@"), text.rlike(r"[0-9](?:[\x20().-]?[0-9]){6}")
    scans = numbered(docs, id_column, text_column).select(
        "row",
        "doc_id",
        hits(text, "email", EMAIL, at & text.rlike(EMAIL)).alias("email"),
        hits(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")).alias("ip"),
        hits(text, "card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")).alias("card"),
        hits(text, "phone", PHONE, text.contains("+") & text.rlike(PHONE)).alias("phone"),
        hits(text, "at", LOOSE_AT, at & text.rlike(LOOSE_AT)).alias("at"),
        hits(text, "digits", LOOSE_DIGITS, digit7).alias("digits"),
    )
    scans = saved(scans, "pii-scans")
    base = located(scans, ["email", "ip", "card", "phone"]).where(passing(F.col("kind"), F.col("hit")))
    base = saved(base.select("row", "kind", "start", "end"), "pii-base")
    # candidates with the share of them that a base span of the same row meets
    candidates = located(scans, ["at", "digits"])
    marks = candidates.select("row", "start", "end", "hit", "before", "after", F.lit(False).alias("base")).unionByName(
        base.select("row", "start", "end", F.lit(None).cast("string").alias("hit"), F.lit(None).cast("string").alias("before"),
                    F.lit(None).cast("string").alias("after"), F.lit(True).alias("base"))
    )
    # a candidate meets a base span if the furthest end of those that begin before its end lies behind its start
    w = Window.partitionBy("row").orderBy(F.when(F.col("base"), F.col("start")).otherwise(F.col("end")), F.col("base").cast("int"))
    furthest = F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    labelled = marks.withColumn("reach", furthest).where("not base").select(
        "row", "start", "end", "hit", "before", "after",
        F.when(F.col("reach") > F.col("start"), 1.0).otherwise(0.0).alias("label"),
    )
    labelled = saved(labelled, "pii-candidates")
    fitted = fit(labelled)
    spans = base
    if fitted:
        models, found = fitted
        open_ = features(labelled.where((F.col("label") == 0) & ~F.col("hit").rlike(HARMLESS)).drop("label"))
        both = scored(models[1], scored(models[0], open_).withColumnRenamed("score", "first"))
        both = both.withColumn("score", (F.col("first") + F.col("score")) / 2)
        least = F.create_map(*(F.lit(x) for name, (threshold, _, _) in found.items() for x in (name, threshold)))
        added = best_apart(both.where(F.col("score") >= least[format_of(F.col("hit"))]).select("row", "start", "end", "score"))
        spans = spans.unionByName(added.select("row", F.lit("pii").alias("kind"), "start", "end"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    grouped = spans.distinct().groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(number.alias("kind_no"), "start", "end", "kind"))).alias("spans")
    )
    none = F.array().cast(grouped.schema["spans"].dataType)
    return scans.select("row", "doc_id").join(grouped, "row", "left").select("row", "doc_id", F.coalesce("spans", none).alias("spans"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_pii``' spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "pii")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch covered by spans (of any kind) replaced by <KIND> of its first span."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    built = F.aggregate(
        ordered,
        start,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("parts"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, built).otherwise(text)
