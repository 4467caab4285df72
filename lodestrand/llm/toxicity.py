"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols: insult or threat (listed, or learned from labelled texts: whole words
and word beginnings), target, negation, reported speech, or other.  Small transducers rewrite the
symbols of a clause, one after the other: a negation weakens the insults and threats in its reach, a
verb of reporting or a quotation mark tells those after it, a target close by (before or after) aims
them, insults of one clause pile up, and what is left of insults is framed by the other words
of its clause.  They are composed into one machine.  A clause is scored by the strongest pattern it
matches; a text's score is the logistic of the weighted numbers of its matched clauses.

Isolated words have no say: an insult or threat that no transducer rewrites matches nothing, and a
framed insult counts only where clauses repeat it (its feature is 0 for one such clause), so one
listed word by itself never reaches the threshold, whatever the weights.  The weights start from the
grammar's own and are fitted to labelled texts; a pattern that no labelled text shows keeps its own.

Terms and weights are learned from at most ``max_train`` labelled texts (drawn by a hash of the id), which
also bounds the number of terms.  A learned term is a threat if most of its contexts aim it at a
target, else an insult; targets, negations and reporting verbs are the listed ones.

Defined cases: null, empty and wordless texts match nothing and have the base score; without usable
labels the grammar's own weights and words stand; of labels repeated for an id the highest counts;
repeated rows and ties are scored alike; a text of any length is scored whole; an empty table gives
no rows.  lang, source and doc_id are not read in a score.  Extra columns stay as they are; the score
is the last column, ``__score``, with underscores behind it where a column of that name is there.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, crc_fold, fresh, read

#: The grammar's word lists (English, German, French, Spanish).
INSULTS = "idiot moron stupid loser pathetic worthless scum disgusting trash clown imbecile dumb fool dummkopf abschaum trottel versager crétin ordure débile imbécile escoria basura estúpido".split()
THREATS = "kill hurt destroy beat burn stab shoot töten vernichten verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yourself u he she they them people du dich ihr euch tu toi vous tú usted ustedes vosotros".split()
NEGATIONS = "not never no don't isn't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says wrote called quoted claimed reported sagte nannte schrieb dit appelé écrit dijo llamó escribió".split()

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»]")
CLAUSE = re.compile(r"[.!?;:\n]+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Symbols that the cascade writes besides: weak (denied), told, aimed at a target, a threat aimed, framed, piled up.
WEAK, TOLD, AIMED, MENACE, FRAMED, PILED = range(6, 12)
#: The patterns of a clause, the strongest first, with the grammar's own weights.
PATTERNS = (MENACE, AIMED, PILED, FRAMED, TOLD, WEAK)
PRIOR = np.array([3.5, 3.5, 3.5, 3.5, 0.5, 0.3])
BASE = -4.0
STEMS = range(3, 7)
MAX_KNOWN = 300_000


class Transducer:
    """A letter-to-letter machine: (state, symbol) -> (state, symbol); unlisted symbols pass, and ``fade`` gives the next state."""

    def __init__(self, arcs: dict, fade: dict):
        self.arcs, self.fade = arcs, fade

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol)) or (self.fade.get(state, state), symbol)


def within(trigger: int, reach: int, rewrite: dict[int, int]) -> Transducer:
    """Rewrites symbols up to ``reach`` words after a trigger (state: words of reach left)."""
    arcs = {(s, trigger): (reach, trigger) for s in range(reach + 1)}
    arcs |= {(s, a): (max(0, s - 1), b) for s in range(1, reach + 1) for a, b in rewrite.items()}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def after(trigger: int, rewrite: dict[int, int]) -> Transducer:
    """Rewrites symbols after a trigger, to the clause's end."""
    arcs = {(s, trigger): (1, trigger) for s in (0, 1)}
    return Transducer(arcs | {(1, a): (1, b) for a, b in rewrite.items()}, {})


def framed() -> Transducer:
    """An insult with any word of its clause before it, or the word after one that opens the clause."""
    return Transducer({(1, INSULT): (1, FRAMED), (0, INSULT): (2, INSULT), (2, OTHER): (1, FRAMED)}, {0: 1, 2: 1})


def compose(machines: list[Transducer], symbols: range) -> dict:
    """One machine that does what the cascade does: (state, symbol) -> (state, symbol)."""
    start = (0,) * len(machines)
    table, todo = {}, [start]
    while todo:
        states = todo.pop()
        for first in symbols:
            symbol, new = first, []
            for machine, state in zip(machines, states, strict=True):
                state, symbol = machine.step(state, symbol)
                new.append(state)
            if (states, first) not in table:
                table[states, first] = (tuple(new), symbol)
                if all((tuple(new), s) not in table for s in symbols):
                    todo.append(tuple(new))
    return table


CASCADE = [
    within(NEGATION, 2, {INSULT: WEAK, THREAT: WEAK}),
    after(REPORT, {INSULT: TOLD, THREAT: TOLD}),
    within(TARGET, 3, {INSULT: AIMED, THREAT: MENACE}),
    within(THREAT, 2, {TARGET: MENACE}),
    within(INSULT, 3, {TARGET: AIMED}),
    after(INSULT, {INSULT: PILED}),
    framed(),
]
MACHINE = compose(CASCADE, range(6))
START = (0,) * len(CASCADE)


class Grammar(dict):
    """Symbols of words (remembered; emptied at ``MAX_KNOWN``) and matched clauses of texts."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.fixed = {w: s for ws, s in ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in ws}
        self.fixed |= dict.fromkeys('"“”«»', REPORT)

    def __missing__(self, word: str) -> int:
        found = [self.terms[t] for t in (f"{word}$", *(word[:n] for n in STEMS)) if t in self.terms]
        self[word] = symbol = found[0] if found else self.fixed.get(word, OTHER)
        return symbol

    def clause(self, words: list[str]) -> int | None:
        """The place in PATTERNS of the strongest pattern that a clause matches."""
        state, out = START, set()
        for w in words:
            state, symbol = MACHINE[state, self[w]]
            out.add(symbol)
        return next((i for i, p in enumerate(PATTERNS) if p in out), None)

    def patterns(self, text: str | None) -> list[int]:
        """How many clauses of the text match each of PATTERNS."""
        count = [0] * len(PATTERNS)
        if len(self) > MAX_KNOWN:
            self.clear()
        text = (text or "").lower()
        if not any(self[w] in (INSULT, THREAT) for w in set(WORD.findall(text))):
            return count
        for part in CLAUSE.split(text):
            words = WORD.findall(part)
            if any(self[w] in (INSULT, THREAT) for w in words):
                at = self.clause(words)
                if at is not None:
                    count[at] += 1
        return count


def features(patterns: np.ndarray) -> np.ndarray:
    """Numbers of matched clauses on a log scale; one framed insult alone is none."""
    x = np.log2(1 + np.asarray(patterns, float).reshape(-1, len(PATTERNS)))
    at = PATTERNS.index(FRAMED)
    x[:, at] = np.maximum(x[:, at] - 1, 0)
    return x


def score(patterns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic of the weighted matches."""
    return 1 / (1 + np.exp(-np.clip(weights[0] + features(patterns) @ weights[1:], -30, 30)))


def term_words(text: str | None) -> list[str]:
    """Words of a text that can be terms, in order."""
    return [w for w in WORD.findall((text or "").lower()) if len(w) >= STEMS[0]]


def terms_of(word: str) -> list[str]:
    """The beginnings of a word, and the word itself (marked by $)."""
    return [word[:n] for n in STEMS if len(word) > n] + [f"{word}$"]


def learn_terms(train: DataFrame, text: str, label: str) -> dict[str, int]:
    """Whole words and word beginnings that all but only toxic texts have: term -> INSULT or THREAT.

    Terms are first counted by text; those that stand out are counted again by their contexts (the
    words before and after), so that copies of a text support no term more than once.  A term stays if
    chance would give its contexts once in 10 ** 5 terms; a beginning needs three different toxic
    words, and few clean ones.  It is a threat if a target follows in six of ten toxic contexts.
    """

    def count(batches):
        for batch in batches:
            seen: list[Counter] = [Counter(), Counter()]
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update({term for w in set(term_words(t)) for term in terms_of(w)})
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([seen[y][t] for t in terms], pa.int64()) for y in (0, 1)]], ["term", "n0", "n1"])

    n0, n1 = train.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    if not n0 or not n1:
        return {}
    base = n1 / (n0 + n1)
    rate = F.col("n1") / (F.col("n0") + F.col("n1"))
    against = F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    evidence = F.col("n1") * F.log(rate / base) + against
    good = (F.col("n1") >= 3) & (rate >= max(0.8, 1 - (1 - base) / 4)) & (evidence >= math.log(1e5))
    labelled = train.select(text, F.col(label).cast("int"))
    total = labelled.mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    likely = {r.term for r in total.where(good).select("term").collect()}  # of max_train texts
    targets = frozenset(TARGETS)

    def contexts(batches):
        for batch in batches:
            rows = set()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = WORD.findall((t or "").lower())
                for before, w, then in zip(["", *own], own, [*own[1:], ""], strict=False):
                    if len(w) >= STEMS[0]:
                        rows.update((term, w, f"{before} {then}", y, then in targets) for term in terms_of(w) if term in likely)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["term", "word", "context", "y", "aims"])

    found = labelled.mapInArrow(contexts, "term string, word string, context string, y int, aims boolean")
    by_word = found.groupBy("term", "word", "context").agg(F.max("y").alias("y1"), F.min("y").alias("y0"), F.max("aims").alias("aims"))
    toxic, clean = F.col("y1") == 1, F.col("y0") == 0
    kinds = [F.count_distinct(F.when(side, F.col("word"))).alias(n) for side, n in ((toxic, "w1"), (clean, "w0"))]
    again = by_word.groupBy("term").agg(F.count_if(clean).alias("n0"), F.count_if(toxic).alias("n1"), F.count_if(toxic & F.col("aims")).alias("aimed"), *kinds)
    whole, family = F.col("term").endswith("$"), F.expr("w1 >= 3 AND w1 >= 0.8D * (w0 + w1)")
    kept = again.where(good & (whole | family)).select("term", (F.col("aimed") >= 0.6 * F.col("n1")).alias("threat"))
    return {r.term: THREAT if r.threat else INSULT for r in kept.collect()}


def fit(train: DataFrame, text: str, label: str, terms: dict[str, int], ridge: float = 1.0) -> np.ndarray:
    """Weights (base first): logistic regression drawn towards the grammar's own, by Newton steps."""

    def matches(batches):
        grammar = Grammar(terms)
        for batch in batches:
            got = [grammar.patterns(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), batch.column(1)], ["p", "y"])

    rows = train.select(text, F.col(label).cast("int")).mapInArrow(matches, "p array<int>, y int").groupBy("p", "y").count().collect()
    weights = prior = np.r_[BASE, PRIOR]
    if not rows:
        return weights
    x = np.c_[np.ones(len(rows)), features(np.array([r.p for r in rows]))]
    y, times = np.array([r.y for r in rows], float), np.array([r["count"] for r in rows], float)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        grad = x.T @ (times * (p - y)) + ridge * (weights - prior)
        weights = weights - np.linalg.solve((x.T * (times * p * (1 - p))) @ x + ridge * np.eye(len(weights)), grad)
    return np.r_[weights[0], np.maximum(weights[1:], 0)]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = 8000) -> tuple[dict[str, int], np.ndarray]:
    """Terms and weights from labelled texts (``max_train`` at most; of rows that share an id the least text)."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("i")).agg(F.max(label).alias("y"))
    drawn = usable.orderBy(F.xxhash64("i"), "i").limit(max_train)
    known = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(drawn), "i")  # max_train rows at most
    known = known.groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    terms = learn_terms(known, "t", "y")
    return terms, fit(known, "t", "y", terms)


def scored(terms: dict[str, int], weights: np.ndarray, batches, at: int, names: list[str]):
    """Batches with the scores of the texts in column ``at`` behind their columns."""
    grammar = Grammar(terms)
    for batch in batches:
        for part in by_bytes(batch, at):
            got = np.array([grammar.patterns(t) for t in part.column(at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(got, weights))], names)


def score_texts(docs: DataFrame, text: str, terms: dict[str, int], weights: np.ndarray) -> DataFrame:
    """All rows of ``docs``, with the score as the last column."""
    names, at = docs.columns, docs.columns.index(text)
    plain = [f"c{i}" for i in range(len(names) + 1)]
    kinds = [f.dataType.simpleString() for f in docs.schema.fields] + ["double"]
    shared = docs.sparkSession.sparkContext.broadcast((terms, weights))

    def run(batches):
        return scored(*shared.value, batches, at, plain)

    schema = ", ".join(f"{p} {k}" for p, k in zip(plain, kinds, strict=True))
    return docs.toDF(*plain[:-1]).mapInArrow(run, schema).toDF(*names, fresh(names, "__score"))


THRESHOLD = 0.3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned on three of four folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold(F.col("doc_id"), 4)
    terms, weights = train(docs, read(spark, sf_dir, "labels").where(fold != 2))
    out = score_texts(docs, "text", terms, weights)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
