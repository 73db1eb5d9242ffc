"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding undoes disguises: compatibility forms, accents and look-alike letters of other scripts become plain
letters, digits and signs inside or at the start of a word become the letters they stand for. The lexicon is learned from a bounded
sample of labelled documents: words whose share among toxic documents is far above that among the others, with
their log odds as weights. So are exception phrases: two words, one of them in the lexicon, that clean documents
have as often. A match inside an exception phrase doesn't count. The weights of the matches, their number and both
by length go through a logistic function fitted on the same sample.

Defined results: null and empty texts match nothing and get the score of no match; without toxic labels the lexicon is empty
and every score is the share of toxic labels, smoothed. Repeated rows and null ids pass; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillway.llm.common import small_batches
from spillway.llm.labelled import sample

#: Labelled rows that are learned from at most.
MAX_ROWS = 20_000
#: A word of the lexicon: toxic documents that have it, log odds, and these in standard errors, at least; entries at most.
MIN_DOCS, MIN_ODDS, MIN_Z, MAX_WORDS = 4, 1.5, 3.0, 5_000
#: An exception: clean documents that have it, and their share among those that have it, at least.
MIN_CLEAN, MIN_CLEAN_SHARE = 5, 0.9

#: Letters of other scripts that look like Latin ones, after lower-casing.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ł": "l", "ø": "o", "đ": "d",
}
#: Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_letters = str.maketrans(LOOKALIKES)
_stand_ins = str.maketrans(STAND_INS)
_marks = re.compile("[̀-ͯ​-‏­]+")
_disguised = re.compile(r"(?<=[a-z])[0-9@$!|]+(?=[a-z])|(?<![a-z0-9])[0-9@$]+(?=[a-z])|(?<=[a-z])[0-9]+(?![a-z0-9])")
_suspect = re.compile(r"[0-9@$!|]")
_words = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Words in plain lower-case letters, each between single spaces."""
    if text.isascii():
        text = text.lower()
    else:
        text = _marks.sub("", unicodedata.normalize("NFKD", text).lower()).translate(_letters)
    if _suspect.search(text):
        text = _disguised.sub(lambda m: m[0].translate(_stand_ins), text)
    return f" {' '.join(_words.findall(text))} "


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, weight in self.lexicon.items():
            found.add_word(f" {word} ", (len(word), weight, word))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase), None, phrase))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, automaton, text: str) -> list[tuple[int, int, float]]:
        """(first character, end, weight) of each match in a folded text that no exception holds."""
        if not len(automaton):
            return []
        hits, safe = [], []
        for end, (length, weight, _) in automaton.iter(text):
            (safe if weight is None else hits).append((end - length, end, weight or 0.0))
        if not safe:
            return hits
        # The farthest end of any exception that starts no later: a match lies within one exactly if it doesn't go beyond that.
        safe.sort()
        starts, ends = [s[0] for s in safe], list(accumulate((s[1] for s in safe), max))
        return [h for h in hits if not (k := bisect_right(starts, h[0])) or ends[k - 1] < h[1]]

    def features(self, automaton, text: str) -> tuple[float, float, float]:
        hits = self.matches(automaton, text)
        if not hits:
            return 0.0, 0.0, 0.0
        weight, words = sum(h[2] for h in hits), max(1, text.count(" ") - 1)
        return float(np.log1p(weight)), float(np.log1p(len(hits))), float(np.log1p(1000 * weight / words))

    def scores(self, features: Iterable[tuple[float, float, float]]) -> np.ndarray:
        x = np.array(list(features), float).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ np.array(self.coefficients[1:]), -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the weights of matches can't be negative in sum, so plain ridge will do."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.array([0.01] + [1.0] * (len(w) - 1))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = ()) -> Model:
    """From at most ``max_rows`` labelled rows; the held-out fold is never among them."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = sample(docs, labels, label_col, max_rows)
    totals = {bool(r["label"]): r["n"] for r in rows.groupBy((F.col("label") > 0).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic:
        share = 0.5 / (n_clean + 1)
        return Model(coefficients=(float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))

    def counted(among: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: Counter[str] = Counter()
                for x in b.column(0):
                    words = set(folded(x.as_py() or "").split())
                    found.update(words if among is None else words & among)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        return run

    def counts(which: str, among: set[str] | None) -> DataFrame:
        return rows.where(which).select("text").mapInArrow(counted(among), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    # At most max_rows documents are behind either count; candidates are the words of MIN_DOCS toxic ones.
    toxic = {r["word"]: r["n"] for r in counts("label > 0", None).where(F.col("n") >= MIN_DOCS).collect()}
    clean = {r["word"]: r["n"] for r in counts("label <= 0", set(toxic)).collect()}
    entries = []
    for word, n in toxic.items():
        m = clean.get(word, 0)
        odds = np.log((n + 0.5) / (n_toxic + 1)) - np.log((m + 0.5) / (n_clean + 1))
        if odds >= MIN_ODDS and odds / np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)) >= MIN_Z - (m == 0):
            entries.append((odds, n, word))
    lexicon = {word: float(odds) for odds, _, word in sorted(entries, reverse=True)[:MAX_WORDS]}
    model = Model(lexicon, exceptions)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[tuple[str, bool]] = Counter()
            for x, label in zip(b.column(0), b.column(1)):
                words = folded(x.as_py() or "").split()
                found.update({(f"{v} {w}", label.as_py() > 0) for v, w in zip(words, words[1:]) if (v in lexicon) != (w in lexicon)})
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], ["phrase", "toxic", "n"])

    by = rows.select("text", "label").mapInArrow(phrases, "phrase string, toxic boolean, n long").groupBy("phrase")
    by = by.agg(F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("clean"), F.sum("n").alias("n"))
    learned = [r["phrase"] for r in by.where((F.col("clean") >= MIN_CLEAN) & (F.col("clean") >= MIN_CLEAN_SHARE * F.col("n"))).collect()]
    model.exceptions = tuple(sorted({folded(p).strip() for p in exceptions} | set(learned)))
    cells = F.arrow_udf(_features(model), "array<double>")
    data = rows.select(cells("text").alias("x"), (F.col("label") > 0).cast("int").alias("y")).collect()
    model.coefficients = fitted(np.array([r["x"] for r in data]), np.array([r["y"] for r in data], float))
    return model


def _features(model: Model):
    def run(text: pa.Array) -> pa.Array:
        automaton = model.automaton()
        return pa.array([list(model.features(automaton, folded(x.as_py() or ""))) for x in text], pa.list_(pa.float64()))

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the chance, from 0 to 1, that a text is toxic. The model (bounded by MAX_WORDS) is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        automaton = own.automaton()
        for text in batches:
            yield pa.array(own.scores(own.features(automaton, folded(x.as_py() or "")) for x in text), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scored = F.arrow_udf(run, "double")
    return docs.withColumn(score_col, scored(docs[text_col].cast("string")))
