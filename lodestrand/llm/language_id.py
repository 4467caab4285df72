"""Language identification: words first, then shorter and shorter character n-grams.

A known word scores each language by its log frequency there.  An unseen word backs off: the
n-grams of the longest length (``MAX_GRAM`` down to 1) of which any is known are averaged.  A text's
language has the largest total; the score is the softmax of the totals.

The tables are learned from at most about ``max_train`` labelled texts of each language, drawn by a hash of
the row, so every language that has a label is learned and the model that is broadcast has a size that
depends on that parameter and the number of languages only.

Defined cases: a letter is what Unicode calls one (numbers and signs are none; marks that combine with a
letter belong to its word); null texts and texts without a letter are ``und`` with score 0; without any
training text everything is ``und``; ties go to the first language by name; repeated rows are predicted
alike and learned once; a text of any length is read whole; an empty table gives no rows.  lang, source
and doc_id are not read in a prediction.  Extra columns stay as they are; the language and the score
are the last columns, ``__lang`` and ``__score``, with underscores behind them where such columns are there.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, fresh, read

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same for texts that hold letters without marks only, and ASCII; quicker.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
COMMON = re.compile(r"[\x00-\x7fß-öø-ÿ\u2010-\u2027]*")
MAX_GRAM = 4
FLOOR = -16.0
MAX_KNOWN = 300_000
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def words(text: str | None) -> list[str]:
    """The lower-cased words of a text."""
    text = (text or "").lower()
    return PLAIN.findall(text) if COMMON.fullmatch(text) else WORD.findall(text)


def train(docs: DataFrame, text: str, lang: str) -> dict:
    """Learn from labelled texts: languages, and for each length (0: words) gram -> log frequencies."""

    def count(batches):
        for batch in batches:
            own_words: dict[str, Counter] = {}
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own_words.setdefault(label, Counter()).update(words(t))
            for label, own in own_words.items():
                for n in range(MAX_GRAM + 1):
                    seen: Counter = Counter() if n else own
                    for w, c in own.items() if n else ():
                        for g in grams(w, n):
                            seen[g] += c
                    k = len(seen)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * k, pa.string()), pa.array([n] * k, pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "n", "gram", "c"])

    counts = docs.select(text, lang).mapInArrow(count, "lang string, n int, gram string, c long")
    rows = counts.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).collect()  # the words and n-grams of the sample
    languages = sorted({r.lang for r in rows})
    place = {name: i for i, name in enumerate(languages)}
    total: Counter = Counter()
    for r in rows:
        total[r.lang, r.n] += r.c
    scores: list[dict] = [{} for _ in range(MAX_GRAM + 1)]
    for r in rows:
        scores[r.n].setdefault(r.gram, [FLOOR] * len(languages))[place[r.lang]] = math.log(r.c / total[r.lang, r.n])
    return {"languages": languages, "tables": [{g: tuple(x) for g, x in own.items()} for own in scores]}


class WordScores(dict):
    """Rows of words in a growing grid of scores; emptied at ``MAX_KNOWN`` words."""

    def __init__(self, model: dict):
        self.languages, self.tables = model["languages"], model["tables"]
        self.floor = (FLOOR,) * len(self.languages)
        self.grid = np.empty((1 << 16, len(self.languages)), np.float32)

    def back_off(self, word: str) -> tuple:
        """The mean of the longest n-grams of which any is known."""
        for n in range(MAX_GRAM, 0, -1):
            own = self.tables[n]
            known = [own[g] for g in grams(word, n) if g in own]
            if known:
                return tuple(sum(c) / len(known) for c in zip(*known, strict=True))
        return self.floor

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.grid):
            self.grid = np.concatenate([self.grid, np.empty_like(self.grid)])
        self.grid[at] = self.tables[0].get(word) or self.back_off(word)
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        if len(self) > MAX_KNOWN:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        total = self.grid[rows].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, text: str, model: dict) -> DataFrame:
    """All rows of ``docs``, with the language and the score as the last columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text)
    plain = [f"c{i}" for i in range(len(names) + 2)]
    kinds = [f.dataType.simpleString() for f in docs.schema.fields] + ["string", "double"]

    def run(batches):
        scores = WordScores(shared.value)
        for batch in batches:
            got = [scores.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], plain)

    schema = ", ".join(f"{p} {k}" for p, k in zip(plain, kinds, strict=True))
    return docs.toDF(*plain[:-2]).mapInArrow(run, schema).toDF(*names, fresh(names, "__lang"), fresh(names, "__score"))


def bounded(docs: DataFrame, key: str, text: str, lang: str, most: int) -> DataFrame:
    """(text, lang): about ``most`` different labelled rows of each language, drawn by a hash; all, if there are no more."""
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.lit(3), F.col(key), F.col(text)).alias("draw"), F.col(text).alias("text"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = labelled.join(F.broadcast(sizes), "lang").where((F.col("n") <= most) | (F.pmod("draw", "n") < most))  # a row per language
    return drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))


def op7_language(spark: SparkSession, sf_dir: str, max_train: int = 1000) -> DataFrame:
    """The language of every document, learned on two of three folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold(F.col("doc_id"), 3)
    model = train(bounded(docs.where(fold != 1), "doc_id", "text", "lang", max_train), "text", "lang")
    out = predict(docs.select("doc_id", "text"), "text", model)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def brute_force(learn: list[tuple[str, str]], texts: list[str | None]) -> list[tuple[str, float]]:
    """What train and predict give for small tables, word by word, for tests."""
    counts: dict[tuple[str, int], Counter] = {}
    for lang, text in learn:
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower()):
            for n in range(MAX_GRAM + 1):
                counts.setdefault((lang, n), Counter()).update(grams(w, n) if n else [w])
    languages = sorted({lang for lang, _ in counts})

    def log_share(lang: str, n: int, gram: str) -> float:
        own = counts.get((lang, n), Counter())
        return math.log(own[gram] / own.total()) if own[gram] else FLOOR

    def of_word(lang: str, w: str) -> float:
        for n in (0, *range(MAX_GRAM, 0, -1)):
            known = [g for g in (grams(w, n) if n else [w]) if any(counts[at][g] for at in counts if at[1] == n)]
            if known:
                return sum(log_share(lang, n, g) for g in known) / len(known)
        return FLOOR

    out = []
    for text in texts:
        found = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
        total = [sum(of_word(lang, w) for w in found) for lang in languages]
        best = max(range(len(total)), key=lambda i: total[i]) if found and total else None
        out.append((UNKNOWN, 0.0) if best is None else (languages[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out
