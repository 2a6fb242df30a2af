"""Secrets by known formats and by a battery of randomness tests, in DataFrame functions only.

Base spans: assignments to telling names, access key ids, long hexadecimal runs. The method adds ``random`` spans:
tokens of at least MIN_TOKEN characters with letters and digits. Their encoding (base 16, 32, 36 or 64) is inferred from
their characters, and a battery measures how far they are from characters drawn evenly from that alphabet:

- chi-squared uniformity over three groups of the alphabet (so that short tokens have enough in each), exact tail,
- chi-squared uniformity over all its characters (Wilson-Hilferty normal score, upper tail),
- runs above and below the alphabet's middle (two tails),
- serial correlation of neighbours at lag 1 (two tails).

Fisher's sum of the four is the statistic; ordinary text has large ones. As neither the limit laws nor independence hold
on short tokens, its law is not assumed: the null hypothesis is "ordinary text", and its distribution is measured over
all words of all documents. Each text is written whole in each encoding and cut into tokens of NULL_LENGTHS in turn, with
a number somewhere in each, which go through the same battery (text that
looks like a candidate is left out). Base 64 is measured apart for tokens with joints (``_``, ``-``, ``/``), against words joined by
them, and without, against words in mixed case. A token's p-value is the share of such stretches, of its encoding and
at most its length, that look as random; shorter ones look more random, so this errs to the safe side. Within each
encoding and length class, Benjamini-Hochberg at level FDR
decides over all tokens of the corpus which are let out as secrets: of those, about that share at most is ordinary. The
tables joined as broadcasts have a row for each encoding, length class and bin at most.

Stretches of the null are short, so their battery counts bits of planes in longs (``packed_battery``); tokens of any length
go through arrays of ranks (``battery``). Both give the same statistic.

Defined results: a null or empty text has no spans (counts 0, empty lists). Repeated rows and repeated or null ids
give a row each. Positions are code points, ends exclusive. Only the two named columns are read. Nothing is cut: very
long tokens and texts with many matches are measured whole. Where no document has words for the null, nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import configured, saved
from .spans import hits, listed, located, numbered

MIN_TOKEN = 20
FDR = 0.05
#: Length classes are powers of two from MIN_TOKEN on; the last holds all longer tokens.
LENGTH_CLASSES = 8
#: Lengths of the stretches of ordinary text, one for each of the first length classes; each has a number of two digits.
NULL_LENGTHS = (MIN_TOKEN, 2 * MIN_TOKEN, 4 * MIN_TOKEN)
#: The shortest stretch without its number; a stretch of each length, or what a text ends with.
PIECE = MIN_TOKEN - 2
BLOCK = "(?s).{%d}(?=.{%d})|.{%d,}" % (sum(NULL_LENGTHS) - 2 * len(NULL_LENGTHS), PIECE, PIECE)
#: What joins words in ordinary tokens.
JOINTS = ("_", "-", "/")
#: Bins of the statistic; the last holds all that is further from random.
BINS, BINS_PER_UNIT = 400, 10
#: Letters and digits one by one: the JVM looks such a class up in one table, which is faster than several ranges.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets: the size, what a token of it looks like, and what of a text's words it can spell, of which letter case.
ALPHABETS = (
    (16, "^(?:[0-9a-f]+|[0-9A-F]+)$", f"[^{DIGITS}abcdef]+", F.lower),
    (32, "^[A-Z2-7]+$", f"[^{UPPER}234567]+", F.upper),
    (36, "^(?:[0-9a-z]+|[0-9A-Z]+)$", f"[^{DIGITS}{LOWER}]+", F.lower),
    (64, "", f"[^{UPPER}{LOWER}{DIGITS}+/]+", F.initcap),
)
#: What a joint of base 64 stands for.
NO_WORD = f"[^{UPPER}{LOWER}{DIGITS}]+"

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run either way, so the length can be asked for in the pattern
SIGN = f"[{UPPER}{LOWER}{DIGITS}+/_-]"
TOKEN = "(?<!%s)%s{%d,}+={0,2}" % (SIGN, SIGN, MIN_TOKEN)
KINDS = ("assign", "access", "hex", "random")


def tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z (Abramowitz and Stegun 26.2.17), never 0."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.when(z < 0, 1 - upper).otherwise(upper), F.lit(1e-300))


def _rank(code: int, size: int) -> int:
    """The place of a character in its alphabet: A-Z a-z 0-9 and signs, A-Z 2-7, or 0-9 a-z."""
    if size == 64:
        return code - 65 if 65 <= code <= 90 else code - 71 if 97 <= code <= 122 else code + 4 if 48 <= code <= 57 else 62
    if size == 32:
        return code - 65 if code >= 65 else code - 24
    return code - 87 if code >= 97 else code - 55 if code >= 65 else code - 48


def by_alphabet(of: Callable[[int], Column]) -> Column:
    """What ``of`` gives for the size of the row's alphabet."""
    out = of(36)
    for size in (16, 32, 64):
        out = F.when(F.col("alphabet") == size, of(size)).otherwise(out)
    return out


def _table(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def ranks(body: Column) -> Column:
    codes = F.split(body, "")
    return by_alphabet(lambda size: F.transform(codes, lambda c: F.get(_table([_rank(code, size) for code in range(128)]), F.ascii(c))))


#: For each alphabet, the ranks at which its second and third group begin: letter case and digits, or thirds.
GROUPS = {16: (5, 10), 32: (13, 26), 36: (10, 23), 64: (26, 52)}
#: Sums that the battery needs, and up to which length they fit in the bits of a long.
SUMS, SHORT = ("squares", "s", "ss", "sp", "high", "changes", "first", "third"), 255


def _sums(size: int) -> Column:
    """The sums of the battery over ``ranks``: squares of the characters' counts, of ranks, of neighbours, of what is above
    the middle, changes of side, and sizes of the first and third group."""
    first, third = (F.lit(x) for x in GROUPS[size])
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    # chi-squared: with sorted ranks, squares of counts come from the places where the value changes
    squares = F.aggregate(
        F.sort_array("ranks"),
        F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, x: F.when(
            a["last"] == x, F.struct(x.alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))
        ).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + a["run"] * a["run"]).alias("sum"))),
        lambda a: a["sum"] + a["run"] * a["run"],
    )
    zero = lambda x: (F.lit(-1).cast("long") if x == "last" else F.lit(0.0)).alias(x)
    moments = F.aggregate(
        "ranks",
        F.struct(*map(zero, ("last", "s", "ss", "sp", "high", "changes", "first", "third"))),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["s"] + x).alias("s"),
            (a["ss"] + x * x).alias("ss"),
            (a["sp"] + F.when(a["last"] >= 0, a["last"] * x).otherwise(0)).alias("sp"),
            (a["high"] + one(2 * x >= size)).alias("high"),
            (a["changes"] + one((a["last"] >= 0) & ((2 * a["last"] >= size) != (2 * x >= size)))).alias("changes"),
            (a["first"] + one(x < first)).alias("first"),
            (a["third"] + one(x >= third)).alias("third"),
        ),
        lambda a: F.struct(squares.alias("squares"), *(a[x].alias(x) for x in SUMS[1:])),
    )
    return moments


def _short_sums(size: int) -> Column:
    """``_sums`` of at most SHORT characters: several of them in the bits of one long, by a table of ranks."""
    above = lambda r: int(2 * r >= size)
    first, third = GROUPS[size]
    one = _table([int(r < first) | int(r >= third) << 8 | above(r) << 16 | r << 24 | r * r << 40 for r in range(size)])
    zero, total, n = F.lit(0).cast("long"), lambda a, x: a + x, F.size("ranks") - 1
    pairs = F.zip_with(F.slice("ranks", F.lit(1), n), F.slice("ranks", F.lit(2), n), lambda p, q: p * q + F.when((p >= size // 2) != (q >= size // 2), 1 << 32).otherwise(0))
    # the last rank, the length of its run so far and the sum of squares, which grows by twice that length and 1
    run = lambda a: F.shiftright(a, 8).bitwiseAND(F.lit(255))
    again = lambda a: a + 256 + F.shiftleft(2 * run(a) + 1, 16)
    anew = lambda a, x: F.shiftleft(F.shiftright(a, 16) + 1, 16) + 256 + x
    squares = F.aggregate(F.sort_array("ranks"), F.lit(255).cast("long"), lambda a, x: F.when(a.bitwiseAND(F.lit(255)) == x, again(a)).otherwise(anew(a, x)))
    packed = F.struct(F.aggregate("ranks", zero, lambda a, x: a + F.get(one, x.cast("int"))).alias("one"), F.aggregate(pairs, zero, total).alias("two"), squares.alias("squares"))
    part = lambda a, low, bits: F.shiftright(a, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("double")
    at = {"squares": ("squares", 16, 32), "first": ("one", 0, 8), "third": ("one", 8, 8), "high": ("one", 16, 8), "s": ("one", 24, 16), "ss": ("one", 40, 20), "sp": ("two", 0, 32), "changes": ("two", 32, 16)}
    return F.transform(F.array(packed), lambda p: F.struct(*(part(p[at[x][0]], *at[x][1:]).alias(x) for x in SUMS)))[0]


def battery(tokens: DataFrame) -> DataFrame:
    """(all columns of ``tokens``, n, statistic): Fisher's sum of the battery for each token (hit, alphabet)."""
    alphabet = F.col("alphabet")
    df = tokens.withColumn("ranks", ranks(F.regexp_replace("hit", "=+$", ""))).withColumn("n", F.size("ranks").cast("double"))
    k, n = alphabet.cast("double"), F.col("n")
    bounds = [F.when(alphabet == 16, GROUPS[16][i]).when(alphabet == 32, GROUPS[32][i]).when(alphabet == 36, GROUPS[36][i]).otherwise(GROUPS[64][i]) for i in (0, 1)]
    sums = F.when(n <= SHORT, by_alphabet(_short_sums)).otherwise(by_alphabet(_sums))
    ends = F.struct(F.element_at("ranks", 1).alias("head"), F.element_at("ranks", -1).alias("last"))
    df = df.select(*tokens.columns, "n", sums.alias("m"), ends.alias("e"), bounds[0].alias("b1"), bounds[1].alias("b2"))
    return _fisher(df).drop("m", "e", "b1", "b2")


def _fisher(df: DataFrame) -> DataFrame:
    """Adds the statistic to rows (alphabet, n, m: the sums, e: first and last rank, b1 and b2: the groups' bounds)."""
    names = df.columns
    k, n = F.col("alphabet").cast("double"), F.col("n")
    expected = (F.col("b1") / k * n, (F.col("b2") - F.col("b1")) / k * n, (k - F.col("b2")) / k * n)
    seen = (F.col("m.first"), n - F.col("m.first") - F.col("m.third"), F.col("m.third"))
    log_groups = -sum(((o - e) * (o - e) / e for o, e in zip(seen, expected, strict=True)), F.lit(0.0)) / 2  # 2 degrees: exact
    chi = F.greatest(k / n * F.col("m.squares") - n, F.lit(0.0)) / (k - 1)
    z_chi = (F.pow(chi, F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    high, low = F.col("m.high"), n - F.col("m.high")
    mean = F.col("m.s") / n
    # each step is a column of its own, since the next ones use it several times
    df = df.select(*names, log_groups.alias("_groups"), z_chi.alias("_chi"), (2 * high * low / n + 1).alias("_runs"), mean.alias("_mean"))
    mean_runs, mean = F.col("_runs"), F.col("_mean")
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    var = F.col("m.ss") / n - mean * mean
    cov = (F.col("m.sp") - mean * (2 * F.col("m.s") - F.col("e.last") - F.col("e.head")) + (n - 1) * mean * mean) / (n - 1)
    df = df.select(*names, "_groups", "_chi", "_runs", var_runs.alias("_var_runs"), var.alias("_var"), cov.alias("_cov"))
    var_runs, var, cov = F.col("_var_runs"), F.col("_var"), F.col("_cov")
    z_runs = F.when(var_runs > 0, (F.col("m.changes") + 1 - mean_runs) / F.sqrt(var_runs)).otherwise(F.sqrt(n))
    z_ser = F.when(var > 0, (cov / var + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    df = df.select(*names, "_groups", "_chi", F.abs(z_runs).alias("_z_runs"), F.abs(z_ser).alias("_z_ser"))
    two = lambda z: F.log(F.least(2 * tail(F.col(z)), F.lit(1.0)))
    statistic = -(F.col("_groups") + F.log(tail(F.col("_chi"))) + two("_z_runs") + two("_z_ser"))
    return df.select(*names, statistic.alias("statistic"))


#: Eight characters stand in the bytes of a long; so many longs hold a token of the packed battery.
WORDS = 13
ONES = 0x0101010101010101
#: By alphabet, what makes ranks of ASCII codes' low five bits: added to all, to letters, to small letters.
LOW5 = {16: (-16, 25, 0), 32: (8, -9, 0), 36: (-16, 25, 0), 64: (36, -37, 26)}


def _places(n: int, half: int) -> int:
    """The bits that the first n characters have in a plane: character 8 w + i has bit 8 (7 - i) + w, from w = 8 on in a second long."""
    out = sum(1 << 8 * (7 - i) + w % 8 for w in range(8 * half, min(8 * half + 8, WORDS)) for i in range(8) if 8 * w + i < n)
    return out - (1 << 64) if out >> 63 else out


def packed_battery(tokens: DataFrame) -> DataFrame:
    """``battery`` of tokens with 8 * WORDS characters at most and no padding, by bits of longs instead of arrays of ranks.

    A plane has a bit for each character: one of its rank's six bits, or whether the rank reaches a bound. Sums of products
    are counts of bits that planes have in common; characters' counts are those of the places where all six bits agree.
    """
    names, size = tokens.columns, F.col("alphabet")
    of = lambda values: F.when(size == 16, F.lit(values[16])).when(size == 32, F.lit(values[32])).when(size == 36, F.lit(values[36])).otherwise(F.lit(values[64]))
    wide = lambda v: F.lit(v).cast("long")
    known = lambda c: F.coalesce(c, wide(0))  # noqa: E731  # of a column that may be null each use would be tested
    hit = F.col("hit")
    for sign in "_-/+":  # ":" follows the digits, so signs get the rank after theirs
        hit = F.replace(hit, F.lit(sign), F.lit(":"))
    df = tokens.select(*names, F.concat(F.when(size == 64, hit).otherwise(F.col("hit")), F.lit("0" * 8)).cast("binary").alias("body"), F.coalesce(F.length("hit"), F.lit(0)).alias("size"))
    code = lambda w: known(F.conv(F.hex(F.col("body").substr(8 * w + 1, 8)), 16, 10).cast("long"))
    table = lambda half, less: known(F.get(_table([_places(max(n - less, 0), half) for n in range(8 * WORDS + 1)]), F.col("size")))
    df = df.select(
        *names, "size", *(F.when(F.col("size") > 8 * w, code(w)).otherwise(wide(0)).alias(f"c{w}") for w in range(WORDS)),
        *(table(h, less).alias(f"{x}{h}") for x, less in (("v", 0), ("u", 1)) for h in (0, 1)),
        *(of({k: v[i] * ONES if i == 0 else v[i] for k, v in LOW5.items()}).cast("long").alias(f"k{i}") for i in range(3)),
        *(of({k: (64 - b[i]) * ONES for k, b in {a: (a // 2, *GROUPS[a]) for a in GROUPS}.items()}).cast("long").alias(f"t{i}") for i in range(3)),
    )
    rest = [*names, "size", "v0", "v1", "u0", "u1"]
    bits = lambda c, low: F.shiftrightunsigned(c, low).bitwiseAND(wide(ONES))

    def rank(w: int) -> Column:
        c = F.col(f"c{w}")
        return c.bitwiseAND(wide(31 * ONES)) + F.col("k0") + F.col("k1") * bits(c, 6) + F.col("k2") * bits(c, 6).bitwiseAND(bits(c, 5))

    df = df.select(*rest, "t0", "t1", "t2", *(F.when(F.col("size") > 8 * w, rank(w)).otherwise(wide(0)).alias(f"r{w}") for w in range(WORDS)))

    def plane(half: int, of_word: Callable[[Column], Column]) -> Column:
        out = None
        for w in range(8 * half, min(8 * half + 8, WORDS)):
            part = F.shiftleft(of_word(F.col(f"r{w}")), w % 8)
            out = part if out is None else out.bitwiseOR(part)
        return out.bitwiseAND(F.col(f"v{half}"))

    of_rank = [plane(h, lambda r, b=b: bits(r, b)).alias(f"p{b}{h}") for b in range(6) for h in (0, 1)]
    reaches = [plane(h, lambda r, i=i: bits(r + F.col(f"t{i}"), 6)).alias(f"g{i}{h}") for i in range(3) for h in (0, 1)]
    df = df.select(*rest, F.shiftrightunsigned("r0", 56).alias("head"), *of_rank, *reaches)

    def next_(x: str, half: int) -> Column:
        """The plane of each character's right neighbour."""
        own = F.shiftleft(F.col(f"{x}{half}"), 8).bitwiseOR(F.shiftrightunsigned(F.col(f"{x}{half}"), 57))
        return own if half else own.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"{x}1"), 56).bitwiseAND(wide(1)), 7))

    planes = [f"{x}{h}" for x in (*(f"p{b}" for b in range(6)), "g0", "g1", "g2") for h in (0, 1)]
    df = df.select(*rest, "head", *planes, *(next_(x, h).alias(f"q{x}{h}") for x in (*(f"p{b}" for b in range(6)), "g0") for h in (0, 1)))
    total = lambda parts: sum(parts[1:], parts[0])
    count = lambda *xs: total([F.bit_count(_all_of([F.col(f"{x}{h}") for x in xs])) for h in (0, 1)])
    ones = [count(f"p{b}") for b in range(6)]
    last = [F.bit_count(F.col(f"p{b}{h}").bitwiseAND(F.col(f"v{h}").bitwiseXOR(F.col(f"u{h}")))) * (1 << b) for b in range(6) for h in (0, 1)]
    changes = [F.bit_count(F.col(f"g0{h}").bitwiseXOR(F.col(f"qg0{h}")).bitwiseAND(F.col(f"u{h}"))) for h in (0, 1)]

    def same(low: int, r: int, half: int) -> Column:
        """The plane of the characters whose rank has the three bits of ``r`` from ``low`` on."""
        return _all_of([F.col(f"v{half}"), *(F.col(f"p{low + b}{half}") if r >> b & 1 else F.bitwise_not(F.col(f"p{low + b}{half}")) for b in range(3))])

    df = df.select(
        *names, F.col("size").cast("double").alias("n"), "head", total(last).alias("last"),
        *(same(low, r, h).alias(f"e{low}{r}{h}") for low in (0, 3) for r in range(8) for h in (0, 1)),
        total([x * (1 << b) for b, x in enumerate(ones)]).alias("s"),
        total([x * (1 << 2 * b) for b, x in enumerate(ones)] + [count(f"p{b}", f"p{c}") * (2 << b + c) for b in range(6) for c in range(b)]).alias("ss"),
        *(total([count(f"p{b}", f"qp{c}") * (1 << b + c) for c in range(6)]).alias(f"sp{b}") for b in range(6)),
        count("g0").alias("high"), total(changes).alias("changes"), (F.col("size") - count("g1")).alias("first"), count("g2").alias("third"),
    )
    rest = [*names, "n", "head", "last", "s", "ss", *(f"sp{b}" for b in range(6)), "high", "changes", "first", "third"]
    df = df.select(*rest, *(count(f"e3{r >> 3}", f"e0{r & 7}").alias(f"c{r}") for r in range(63)))
    df = df.select(*rest, *(total([F.col(f"c{r}") * F.col(f"c{r}") for r in range(i, min(i + 8, 63))]).alias(f"squares{i // 8}") for i in range(0, 63, 8)))
    made = {"squares": total([F.col(f"squares{i}") for i in range(8)]), "sp": total([F.col(f"sp{i}") for i in range(6)])}
    sums = F.struct(*(made.get(x, F.col(x)).cast("double").alias(x) for x in SUMS))
    df = df.select(*names, "n", sums.alias("m"), F.struct("head", "last").alias("e"), *(of({k: g[i] for k, g in GROUPS.items()}).alias(f"b{i + 1}") for i in (0, 1)))
    return _fisher(df)


def _all_of(masks: list[Column]) -> Column:
    out = masks[0]
    for x in masks[1:]:
        out = out.bitwiseAND(x)
    return out


def binned(tokens: DataFrame, by: Callable[[DataFrame], DataFrame] = battery) -> DataFrame:
    """Adds length_class, bin of the statistic, which ``by`` measures."""
    step = F.floor(F.log2(F.col("n") / MIN_TOKEN)).cast("int")
    return by(tokens).select(
        *(c for c in tokens.columns if c != "alphabet"),
        written(F.col("hit")).alias("alphabet"),
        F.greatest(F.lit(0), F.least(step, F.lit(LENGTH_CLASSES - 1))).alias("length_class"),
        F.least(F.floor(F.col("statistic") * BINS_PER_UNIT), F.lit(BINS - 1)).cast("int").alias("bin"),
    )


def encoding(hit: Column) -> Column:
    body = F.regexp_replace(hit, "=+$", "")
    size = F.lit(64)
    for n, looks, _, _ in reversed(ALPHABETS[:-1]):
        size = F.when(body.rlike(looks), n).otherwise(size)
    return size


def written(hit: Column) -> Column:
    """What a token is compared with: its alphabet's size, one more for base 64 with joints (paths, snake case)."""
    return F.col("alphabet") + F.when((F.col("alphabet") == 64) & (hit.contains("_") | hit.contains("/") | hit.contains("-")), 1).otherwise(0)


def drawn(h: Column, name: str, n: Column | int) -> Column:
    """A number from 0 to ``n`` - 1, drawn by hash for each ``name`` anew."""
    return F.pmod(F.xxhash64(h, F.lit(name)), F.lit(n) if isinstance(n, int) else n).cast("int")


def ordinary(docs: DataFrame) -> DataFrame:
    """(alphabet, hit): all words of all texts of ``docs`` (row, text) as tokens, each word once in each encoding.

    A text is spelt whole in an encoding and cut into blocks, a block into pieces of NULL_LENGTHS, less two for a number;
    what is left over goes to the last piece. Base 64 is spelt twice: with changes of case alone, and joined by a drawn
    sign in a drawn case.
    """
    h = F.xxhash64("text")
    df = docs.select(h.alias("h"), F.regexp_replace("text", TOKEN, " ").alias("words"))  # what looks like a candidate is none
    h, cases = F.col("h"), {case: F.col(case.__name__) for case in (F.lower, F.upper, F.initcap)}
    df = df.select("h", *(case("words").alias(case.__name__) for case in cases))  # once for all encodings
    spelt = [F.struct(F.lit(n).alias("alphabet"), F.regexp_replace(cases[case], other, "").alias("words")) for n, _, other, case in ALPHABETS]
    joint = F.element_at(F.array(*map(F.lit, JOINTS)), drawn(h, "joint", len(JOINTS)) + 1)
    style = drawn(h, "case", 3)
    cased = F.when(style == 0, cases[F.lower]).when(style == 1, cases[F.upper]).otherwise(cases[F.initcap])
    cased = F.replace(F.trim(F.regexp_replace(cased, NO_WORD, " ")), F.lit(" "), joint)
    spelt.append(F.struct(F.lit(64).alias("alphabet"), cased.alias("words")))
    # arrays are made before they are exploded, as an explode's own expressions are not compiled; the outer one adds no test of them
    each = df.select(F.array(*spelt).alias("a")).select(F.explode_outer("a").alias("a")).select("a.*")
    each = each.select("alphabet", F.explode(F.regexp_extract_all("words", F.lit(BLOCK), F.lit(0))).alias("block"))
    # what is spelt is ASCII: its bytes are its characters, and are found without counting
    each = each.select("alphabet", F.col("block").cast("binary").alias("block"), F.octet_length("block").alias("size"))
    block, size, pieces, at = F.col("block"), F.col("size"), [], 0
    for i, length in enumerate(n - 2 for n in NULL_LENGTHS):
        last = size < at + length + PIECE if i + 1 < len(NULL_LENGTHS) else F.lit(True)
        piece = F.when(last, block.substr(F.lit(at + 1), size)).otherwise(block.substr(at + 1, length))
        pieces.append(F.when(size >= at + PIECE, piece))
        at += length
    each = each.select("alphabet", F.array(*pieces).alias("pieces")).select("alphabet", F.explode_outer("pieces").alias("piece"))
    each = each.where("piece is not null")
    piece, size, h = F.col("piece"), F.octet_length("piece"), F.xxhash64("piece")
    digits = [f"{i:02d}".translate(str.maketrans("0189", "2345")) for i in range(100)]  # of all alphabets
    number = F.get(F.expr(f"array({str(digits)[1:-1]})"), F.pmod(h, F.lit(100)).cast("int"))
    each = each.select("alphabet", "piece", size.alias("size"), number.cast("binary").alias("number"), drawn(h, "cut", size + 1).alias("cut"))
    cut = F.col("cut")
    return each.select("alphabet", F.concat(piece.substr(F.lit(1), cut), "number", piece.substr(cut + 1, F.col("size"))).cast("string").alias("hit"))


def let_out(tested: DataFrame, null: DataFrame) -> DataFrame:
    """(alphabet, length_class, cut): Benjamini-Hochberg over binned statistics; tokens with bin <= cut are secrets.

    ``tested`` has a row (alphabet, length_class, bin) for each token, ``null`` the numbers (times) of ordinary stretches.
    """
    key = ["alphabet", "length_class"]
    counts = tested.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*key)
    ranked = counts.select(*key, "bin", F.sum("c").over(w.orderBy("bin")).alias("rank"), F.sum("c").over(w).alias("m"))
    nulls = null.select(F.col("alphabet").alias("of"), F.col("length_class").alias("of_class"), F.col("bin").alias("of_bin"), F.col("times").alias("c"))
    near = (F.col("alphabet") == F.col("of")) & (F.col("of_class") <= F.col("length_class"))  # tables of a few thousand rows at most
    random = F.coalesce(F.sum(F.when(F.col("of_bin") <= F.col("bin"), F.col("c"))), F.lit(0))
    p = (1 + random) / (1 + F.coalesce(F.sum("c"), F.lit(0)))
    values = ranked.join(F.broadcast(nulls), near, "left").groupBy(*key, "bin", "rank", "m").agg(p.alias("p"))
    return values.where(F.col("p") * F.col("m") <= FDR * F.col("rank")).groupBy(*key).agg(F.max("bin").alias("cut"))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of each row as array<struct<start, kind_no, end, kind>>, by start, then kind."""
    text, low = F.col("text"), F.lower("text")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    scans = numbered(docs, id_column, text_column).select(
        "row",
        "doc_id",
        hits(text, "assign", ASSIGN, named & text.rlike(ASSIGN)).alias("assign"),
        hits(text, "access", ACCESS, text.contains("AKIA")).alias("access"),
        hits(text, "hex", HEX, text.rlike(HEX)).alias("hex"),
        hits(text, "random", TOKEN, text.rlike(TOKEN)).alias("random"),
    )
    scans = saved(scans, "secret-scans")
    every = located(scans, ["assign", "access", "hex", "random"])
    size = F.length("hit")
    passes = (
        F.when(F.col("kind") == "assign", F.length(F.regexp_replace("hit", ASSIGN_HEAD, "")) >= 6)
        .when(F.col("kind") == "access", size >= 20)
        .when(F.col("kind") == "random", F.col("hit").rlike("[0-9]") & F.col("hit").rlike("[A-Za-z]"))
        .otherwise(True)
    )
    every = saved(every.where(passes).select("row", "kind", "start", "end", "hit"), "secret-candidates")

    tokens = every.where("kind = 'random'").select("row", "kind", "start", "end", "hit", encoding(F.col("hit")).alias("alphabet"))
    tested = saved(binned(tokens).drop("hit"), "secret-tests")
    null = binned(ordinary(docs.select(docs[text_column].alias("text")).where("text is not null")), packed_battery)
    null = null.groupBy("alphabet", "length_class", "bin").agg(F.count(F.lit(1)).alias("times"))
    with configured(docs.sparkSession, "spark.sql.codegen.wholeStage", "false"):  # long expressions are cut into small methods only so
        null = saved(null, "secret-null")
    cuts = saved(let_out(tested, null), "secret-cuts")
    kept = tested.join(F.broadcast(cuts), ["alphabet", "length_class"]).where("bin <= cut")
    spans = every.where("kind <> 'random'").select("row", "kind", "start", "end").unionByName(kept.select("row", "kind", "start", "end"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    grouped = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", number.alias("kind_no"), "end", "kind"))).alias("spans")
    )
    base = F.filter("spans", lambda s: s["kind"] != "random")
    # a random token that meets a base span adds nothing; base spans stay
    added = F.filter(
        "spans",
        lambda s: (s["kind"] != "random") | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    grouped = grouped.withColumn("base", base).select("row", added.alias("spans"))
    none = F.array().cast(grouped.schema["spans"].dataType)
    return scans.select("row", "doc_id").join(grouped, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_secrets``' spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
