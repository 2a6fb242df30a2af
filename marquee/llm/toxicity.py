"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, whose words a lexicon transducer rewrites to weighted symbols: insults (whole words and word
beginnings, so that inflected and compounded forms are read, too), verbs of harm, words of intent, targets (words of
address), negations, verbs of saying and quotes. Wishes, commands and set threats of several words are rewritten to one
symbol by a transducer of their own. Five transducers read the symbols:

- insult: a match at each insult; threat: a match at a verb of harm within REACH symbols after a word of intent, if a
  target stands between them or after or is its ending, and at each wish; target: whether a word of address stands within REACH symbols before or, read from the clause's end,
  after; negation: whether a negation stands within REACH symbols before; report: whether a verb of saying came before
  or a quote is open.

They are composed once into one machine over product states, whose arcs emit a match's kind: reported, negated,
insult (aimed at a target), bare (an insult in a clause without one) or threat; a verb of harm alone is no match. A
document's score is logistic in the log of the summed weights of its matched clauses by kind. The path for bare
insults is kept because an ablation asks for it: without it, held-out accuracy falls to that of always saying no.

The lexicon's weights (log odds) and the kinds' signed coefficients are learned from labelled texts: at most TRAIN_ROWS
documents, the first by a hash of the text. Coefficients are held near PRIOR, so kinds that training never shows keep
their prior weight. Lexicon entries are counted in Spark; all go to the driver, a part of those texts' words. Scoring is a
narrow stage over whole texts; an automaton finds lexicon hits first, and clauses without any are not read further.

Defined results: a null or empty text has no matched clause and gets the score of such texts. Labels that are null are
not learned from; without both labels, every score is the share of positive labels (0 without any). A doc_id labelled
several times counts once, as toxic if any of its labels is; of several texts with one id, one is learned from. Repeated
rows give a row each. Only the named columns are read; language, source and ids are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, saved

TRAIN_ROWS = 20_000
#: A lexicon entry has a log odds of at least this much and is seen in at least MIN_TEXTS toxic training texts.
MIN_LOG_ODDS, MIN_TEXTS = 2.5, 3
#: Shortest and longest word beginnings that may become entries.
STEM = (4, 8)
REACH = 4
KINDS = ("insult", "threat", "negated", "reported", "bare")
#: Coefficients of the kinds without evidence, and how firmly they hold.
PRIOR, RIDGE = (1.0, 4.0, 0.0, 0.0, 0.5), 1e-2
HARM_WEIGHT = 3.0

# Closed classes of words, in the corpus's languages: fixed values.
TARGETS = frozenset(
    "you your you're he she they him her them his their u ya du dich dir ihr euch sie er ihn ihm sein tu te toi vous il "
    "elle ils leur lui ton usted tú ti él ella ellos vosotros su".split()
)
NEGATIONS = frozenset(
    "not no never cannot nobody without nicht kein keine keiner nie niemals ohne ne pas jamais aucun sans nunca jamás "
    "tampoco ningún sin".split()
)
REPORTS = frozenset(
    "said says say called calls told wrote claims quote quoted reported accused sagte sagt nannte schrieb laut dit "
    "disait appelé écrit selon dijo dice llamó escribió según".split()
)
HARMS = frozenset(
    "kill hurt destroy murder strangle stab shoot slaughter behead butcher töten umbringen verletzen erschießen erstechen "
    "erwürgen verprügeln zusammenschlagen vernichten abstechen tuer frapper étrangler égorger poignarder massacrer buter matar "
    "golpear estrangular apuñalar degollar".split()
)
#: Verbs of harm that carry their target as an ending.
AIMED = frozenset("matarte matarlo matarla matarlos golpearte apuñalarte estrangularte degollarte".split())
INTENTS = frozenset(
    "will gonna shall should must going want wanna plan planning swear promise werde werden wird sollte soll möchte vais va veux "
    "dois doit vas vont allons voy vamos va van quiero queremos debe debo you'll i'll we'll they'll he'll she'll".split()
)
#: Wishes, commands and threats in the first person, whole: the words of each place, parted by |, in order; a place that
#: ends in ? may be left out.
WISHES = (
    "kill|hang|shoot|drown yourself|yourselves", "go just? die", "kys", "drop dead", "beat you|him|her|them up",
    "you|u|ya deserve to die|suffer|burn|rot", "you|u|ya should|must|will|gonna|oughta just? die|burn|suffer|rot",
    "you're going|gonna to? die|burn|suffer", "you are going|gonna to? die|burn|suffer", "hope|wish you|u|ya die|suffer|burn|rot|choke",
    "you'll die|burn|suffer|rot", "wish you were dead", "want you dead", "you're dead", "you are dead",
    "bring|bringe|bringt dich|euch um", "stirb", "bring dich selbst? um", "du sollst|musst|wirst endlich? sterben|krepieren|leiden",
    "ihr sollt|müsst|werdet sterben|krepieren|leiden", "du bist tot", "mache|mach dich kalt|fertig",
    "töte|erschieße|ersteche|erwürge|verprügle|vernichte dich|euch", "va te? crever|mourir|pendre",
    "tu vas|dois|devrais mourir|crever|souffrir", "crève", "tu es mort|morte", "que tu meures|crèves",
    "je te|vous tue|étrangle|égorge|poignarde|massacre|bute|tuerai|étranglerai|égorgerai", "vas a morir|sufrir",
    "debes|deberías|mereces morir|sufrir", "ojalá te? mueras", "muérete", "estás muerto|muerta", "mátate", "vete a morir",
    "te|os mato|golpeo|apuñalo|estrangulo|degüello|mataré|golpearé|apuñalaré",
    "te|os voy|vamos|va|van a matar|golpear|apuñalar|estrangular|degollar",
)
CLASSES = (
    ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("harm", HARMS), ("aimed", AIMED), ("intent", INTENTS),
)
SYMBOLS = ("other", "insult", "quote", "wish", *(name for name, _ in CLASSES))

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*|\"")
#: What ends a clause (a colon may introduce reported speech, so it does not).
ENDS = ".!?;\n"


def closed_class(word: str) -> str | None:
    if word == '"':
        return "quote"
    if word.endswith("n't"):
        return "negation"
    return next((name for name, words in CLASSES if word in words), None)


def spoken(wishes: tuple[str, ...] = WISHES) -> dict[str, dict]:
    """The wish transducer as a trie over words; None marks the end of a wish."""
    root: dict = {}
    for wish in wishes:
        ends = [root]
        for place in wish.split():
            grown = [end.setdefault(word, {}) for end in ends for word in place.rstrip("?").split("|")]
            ends = grown + (ends if place.endswith("?") else [])
        for end in ends:
            end[None] = {}
    return root


def cues(trie: dict, path: tuple[str, ...] = ()) -> set[str]:
    """A word of each wish by which to find it, the longest."""
    found = {max(path, key=len)} if None in trie else set()
    return found.union(*(cues(after, (*path, word)) for word, after in trie.items() if word is not None))


class Transducer(NamedTuple):
    """States from 0 (the start) on, and arcs (state, symbol) -> state."""

    states: int
    arcs: dict[tuple[int, str], int]


def within(*openers: str, reach: int = REACH) -> Transducer:
    """The state is how many more symbols are within reach of the last opener."""
    arcs = {(s, x): reach if x in openers else max(0, s - 1) for s in range(reach + 1) for x in SYMBOLS}
    return Transducer(reach + 1, arcs)


def reporting() -> Transducer:
    """State 1 once a verb of saying was read, 2 inside a quote."""
    arcs = {(s, x): s for s in range(3) for x in SYMBOLS}
    arcs |= {(0, "report"): 1, (2, "report"): 1, (0, "quote"): 2, (2, "quote"): 0}
    return Transducer(3, arcs)


#: What a clause is read by; an insult needs no state of its own.
PARTS = {"threat": within("intent"), "target": within("target", "wish"), "negation": within("negation"), "report": reporting()}
#: Reads a clause from its end: whether a target stands ahead.
AHEAD = within("target", "wish")


def compose(parts: dict[str, Transducer] = PARTS) -> list[dict[tuple[str, bool], tuple[int, str | None]]]:
    """The product machine: for each state, arcs (symbol, whether a target stands ahead) -> (next state, kind emitted)."""
    names, start = list(parts), (0,) * len(parts)
    number, todo, machine = {start: 0}, [start], []
    for state in todo:  # grows as states are reached
        of = dict(zip(names, state, strict=True))
        arcs = {}
        for symbol in SYMBOLS:
            after = tuple(parts[n].arcs[of[n], symbol] for n in names)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            for ahead in (False, True):
                aimed = ahead or of["target"] > 0
                kind = None
                if symbol == "insult":
                    kind = "insult" if aimed else "bare"
                elif symbol == "harm" and of["threat"] and (ahead or of["target"] > of["threat"]):
                    kind = "threat"
                elif symbol == "wish" or (symbol == "aimed" and of["threat"]):
                    kind = "threat"
                if kind and of["report"]:
                    kind = "reported"
                elif kind and of["negation"]:
                    kind = "negated"
                arcs[symbol, ahead] = number[after], kind
        machine.append(arcs)
    return machine


class Grammar:
    """The lexicon transducer and the composed machine, with weights; picklable, small."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], bias: float, coefficients: list[float]):
        self.words, self.stems, self.bias, self.coefficients = words, stems, bias, coefficients

    def prepared(self) -> Grammar:
        self.machine, self.trie = compose(), spoken()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for entry in {*(w for w, weight in self.words.items() if weight), *self.stems, *HARMS, *AIMED, *cues(self.trie)}:
            self.automaton.add_word(entry)
        self.automaton.make_automaton()
        return self

    def readings(self, word: str) -> list[tuple[str, float]]:
        """Symbols that a word may be rewritten to, with weights."""
        weight = self.words.get(word)
        if weight is None:
            weight = max((self.stems.get(word[:n], 0.0) for n in range(STEM[0], min(len(word), STEM[1]) + 1)), default=0.0)
        name = closed_class(word)
        if weight:
            return [("harm", HARM_WEIGHT + weight), ("insult", weight)] if name == "harm" else [("insult", weight)]
        return [(name, HARM_WEIGHT if name in ("harm", "aimed") else 0.0)] if name else [("other", 0.0)]

    def rewritten(self, words: list[str]) -> list[list[tuple[str, float]]]:
        """Readings of a clause's words, the longest wish at each place as one symbol."""
        read, i = [], 0
        while i < len(words):
            node, end = self.trie, 0
            for j in range(i, len(words)):
                node = node.get(words[j])
                if node is None:
                    break
                end = j + 1 if None in node else end
            read.append([("wish", HARM_WEIGHT)] if end else self.readings(words[i]))
            i = end or i + 1
        return read

    def clause(self, clause: str) -> list[float]:
        """Weights by kind of what the composed machine emits for a clause: for words with two readings, of the first
        that emits anything."""
        found = [0.0] * len(KINDS)
        read = self.rewritten(WORD.findall(clause))
        ahead, back = [], 0
        for options in reversed(read):
            ahead.append(back > 0)
            back = AHEAD.arcs[back, options[0][0]]
        state = 0
        for options, target in zip(read, reversed(ahead), strict=True):
            for symbol, weight in options:
                after, kind = self.machine[state][symbol, target]
                if kind:
                    found[KINDS.index(kind)] += weight
                    break
            state = after
        return found

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + summed weight) of matched clauses by kind."""
        total = np.zeros(len(KINDS))
        low = (text or "").lower().replace("\u2019", "'")
        if low:
            done = -1
            for end, _ in self.automaton.iter(low):
                if end < done:
                    continue
                # the clause around the hit
                a, b = end, end
                while a > 0 and low[a - 1] not in ENDS:
                    a -= 1
                while b < len(low) and low[b] not in ENDS:
                    b += 1
                done = b
                total += self.clause(low[a:b])
        return np.log1p(total)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.features(text) @ np.array(self.coefficients))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _entries(train: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and word beginnings whose presence speaks for label 1, with their log odds."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: F.when(F.length(w) >= n, F.concat(F.lit("^"), w.substr(F.lit(1), n))))))
    units = F.array_compact(F.array_distinct(F.concat(words, stems)))
    total = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    seen = train.select("y", F.explode(units).alias("unit")).groupBy("unit").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")
    )
    seen = saved(seen, "toxicity-units")
    share = min(max(pos / max(pos + neg, 1), 1e-6), 1 - 1e-6)
    p, n = F.col("p"), F.col("n")
    odds = F.log((p + 0.5) / (pos + 1)) - F.log((n + 0.5) / (neg + 1))
    # log likelihood ratio against chance; more than the log of the number of units tried, so about one false entry
    ratio = p * F.log(p / (p + n) / share) + F.when(n > 0, n * F.log(n / (p + n) / (1 - share))).otherwise(0.0)
    top = (
        seen.where(p >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
        .where(ratio >= math.log(max(seen.count(), 2)))
        .orderBy(F.desc(F.col("odds") * F.sqrt("p")), "unit").collect()
    )
    stems_found = {r["unit"][1:]: float(r["odds"]) for r in top if r["unit"].startswith("^")}
    words_found = {r["unit"]: float(r["odds"]) for r in top if not r["unit"].startswith("^")}
    # words that begin like an entry but are at home in other texts: read as what they are
    begins = [F.substring("unit", 1, k).isin([w for w in stems_found if len(w) == k]) for k in range(STEM[0], STEM[1] + 1)]
    plain = seen.where(~F.col("unit").startswith("^") & (n > 0)).withColumn("odds", odds).where(F.col("odds") < MIN_LOG_ODDS)
    plain = plain.where(reduce(lambda a, b: a | b, begins)).select("unit").collect()
    words_found |= {r["unit"]: 0.0 for r in plain if r["unit"] not in words_found}
    return words_found, stems_found


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of a logistic regression, the intercept first, held near ``prior`` (Newton's method)."""
    x = np.c_[np.ones(len(x)), x]
    w = np.r_[0.0, prior]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (p - y) + ridge * np.r_[0, w[1:] - prior]
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          train_rows: int = TRAIN_ROWS) -> Grammar:
    """A grammar from the texts of labelled documents (labels: one id and one 0/1 column)."""
    label = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id")).agg(F.max(F.when(F.col(label_column) > 0, 1).otherwise(0)).alias("y"))
    )
    texts = docs.select(docs[id_column].alias("id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    first = texts.groupBy("id").agg(F.min("h").alias("h"))
    chosen = first.join(label, "id").orderBy("h", "id").limit(train_rows)
    train = texts.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["id", "h"]).select("text", "y")  # train_rows at most
    train = saved(train, "toxicity-train")
    words, stems = _entries(train)
    grammar = Grammar(words, stems, 0.0, [0.0] * len(KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = grammar.prepared()
        for batch in batches:
            x = np.array([ready.features(t.as_py()) for t in batch.column(0)]).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, x.T)], names=["y", *KINDS])

    # one row for each text in training: train_rows at most; equal rows go as one with their number
    schema = "y int, " + ", ".join(f"{k} double" for k in KINDS)
    rows = train.mapInArrow(releasing(run), schema).groupBy("y", *KINDS).count().collect()
    if not rows:
        return grammar_of_share(0, 0)
    y = np.repeat([float(r["y"]) for r in rows], [r["count"] for r in rows])
    x = np.repeat(np.array([[r[k] for k in KINDS] for r in rows]), [r["count"] for r in rows], axis=0)
    if y.min() == y.max():
        return grammar_of_share(y.sum(), len(y))
    w = logistic(x, y, np.array(PRIOR))
    grammar.bias, grammar.coefficients = float(w[0]), [float(c) for c in w[1:]]
    return grammar


def grammar_of_share(positive: float, n: int) -> Grammar:
    share = min(max(positive / n if n else 0.0, 1e-6), 1 - 1e-6)
    return Grammar({}, {}, math.log(share / (1 - share)), [0.0] * len(KINDS))  # nothing was learned


def scores(docs: DataFrame, grammar: Grammar, text_column: str = "text") -> DataFrame:
    """Adds ``score`` to ``docs`` (in place of a column of that name): all others pass through."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        ready = grammar if hasattr(grammar, "automaton") else grammar.prepared()
        return pd.Series([ready.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", score(docs[text_column]))


def held_out(id_column: str = "doc_id"):
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
