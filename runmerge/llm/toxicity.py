"""Toxicity by a lexicon that misspelled terms cannot dodge, with context windows.

The lexicon has seed terms and terms learned from labels; an edit is allowed in each that has four letters or more,
but for look-alikes that labelled texts show to be ordinary words. Its trie is intersected with the Levenshtein automaton
of distance one: a state is the set of trie nodes and edits that a word's prefix can have reached, transitions
are worked out once and kept, so a word costs a look-up a letter and mostly ends after two or three. A hit is
weighed by the words around it: quotation marks and reporting words make it a mention, address makes it abuse.
A logistic model turns the evidence of a text into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .folds import labelled_sample, remainder

FOLDS, HELD_OUT = 3, 1
#: Terms that are abusive without any label having said so, and words that set the tone around a hit.
SEEDS = "idiot moron imbecile stupid dumb clown loser pathetic scum trash garbage vermin worthless disgusting".split()
REPORTS = frozenset("said says say called calls wrote writes quote quoted quotes word words term terms phrase reads".split())
ADDRESS = frozenset("you your yours yourself are this these such".split())
QUOTES = "\"“”„«»‘’"
#: Bounds: labelled rows; states and words that a worker keeps.
SAMPLE, STATES, CACHE = 20_000, 50_000, 300_000
TELLING = 8.0  # evidence that makes a word a term, about as four toxic texts of four
LEAST_LENGTH = 5  # of terms that a lexicon matches with an edit unless told otherwise
SHORT = 4  # the same in a model's lexicon
SPAN = 5  # words on each side of a hit
WORDS = re.compile(r"[^\W_]+")


class Lexicon:
    """Finds the term that a word is, or that of ``misspelt`` (None: all) with ``least`` letters which it is one edit away from."""

    def __init__(self, terms: Iterable[str], ordinary: Iterable[str] = (), misspelt: Iterable[str] | None = None, least: int = LEAST_LENGTH):
        terms = list(terms)
        self.misspelt = frozenset(t for t in (terms if misspelt is None else misspelt) if len(t) >= least)
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.fuzzy = [False]  # whether a term that takes an edit is at or below the node
        for t in terms:
            node = 0
            path = [0]
            for c in t:
                node = self.children[node].setdefault(c, len(self.term))
                if node == len(self.term):
                    self.children.append({})
                    self.term.append(None)
                    self.fuzzy.append(False)
                path.append(node)
            self.term[node] = t
            for n in path if t in self.misspelt else ():
                self.fuzzy[n] = True
        self.ordinary = frozenset(ordinary)
        self.states: dict[frozenset, dict] = {}
        self.start = self._state({(0, 0)})
        self.cache: dict[str, tuple[str, int] | None] = {}

    def _state(self, nodes: set[tuple[int, int]]) -> dict:
        """The state of these nodes and edits, with letters of terms that the word may lack skipped."""
        for node, edits in list(nodes):
            if not edits:
                nodes |= {(n, 1) for n in self.children[node].values() if self.fuzzy[n]}
        key = frozenset(n for n in nodes if not (n[1] and (n[0], 0) in nodes))
        if key not in self.states:
            self.states[key] = {None: key}
        return self.states[key]

    def _step(self, state: dict, letter: str) -> dict:
        nodes = set()
        for node, edits in state[None]:
            after = self.children[node].get(letter)
            if after is not None:
                nodes.add((after, edits))
            if not edits and self.fuzzy[node]:
                nodes.add((node, 1))  # a letter too many
                nodes |= {(n, 1) for n in self.children[node].values() if self.fuzzy[n]}  # another letter
        state[letter] = self._state(nodes)
        return state[letter]

    def search(self, word: str) -> tuple[str, int] | None:
        if len(self.states) >= STATES:  # with the start all others are forgotten
            self.states.clear()
            self.start = self._state({(0, 0)})
        state = self.start
        for letter in word:
            state = state.get(letter) or self._step(state, letter)
            if not state[None]:
                return None
        found = [(e, self.term[n]) for n, e in state[None] if self.term[n] and (not e or self.term[n] in self.misspelt)]
        return (lambda best: (best[1], best[0]))(min(found)) if found else None

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance; None for words known to be ordinary."""
        try:
            return self.cache[word]
        except KeyError:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.search(word)
            found = None if found and found[1] and word in self.ordinary else found
            self.cache[word] = found
            return found


@dataclass
class ToxicityModel:
    """Terms with their counts in toxic and other labelled texts, the numbers of those texts, and the weights."""

    counts: dict[str, tuple[float, float]]
    totals: tuple[float, float]
    ordinary: list[str] = field(default_factory=list)
    weights: list[float] | None = None

    def lexicon(self) -> Lexicon:
        return Lexicon(self.counts, self.ordinary, least=SHORT)

    def term_weight(self, term: str, less: tuple[int, int] = (0, 0)) -> float:
        """Log odds of a term, without the text itself when that is one of those counted; 0 if it no longer tells."""
        a, b = self.counts[term][0] - less[0], self.counts[term][1] - less[1]
        w = math.log((a + 0.2) / (self.totals[0] + 1)) - math.log((b + 0.2) / (self.totals[1] + 1))
        return min(w, 6.0) if a >= 1.5 and w > 1 else 0.0


N_FEATURES = 5
MISSPELT = 0.7  # what a misspelt term weighs against the term


def _context(tokens: list[str], spans: list[tuple[int, int]], text: str, i: int) -> float:
    """From 0.2 for a quotation to 1.5 for address: what the words around hit ``i`` make of it."""
    lo, hi = max(0, i - SPAN), min(len(tokens), i + SPAN + 1)
    around = tokens[lo:i] + tokens[i + 1 : hi]
    left, right = text[spans[lo][0] : spans[i][0]], text[spans[i][1] : spans[hi - 1][1] + 1]
    marks = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
    factor = 0.2 if marks else 0.6 if REPORTS.intersection(around) else 1.0
    return factor * (1.5 if ADDRESS.intersection(around) and not marks else 1.0)


def features(text: str, lexicon: Lexicon, model: ToxicityModel, y: int | None = None) -> list[float]:
    """Evidence of terms, of mentions; the strongest term; hits by length; length.

    ``y`` is the label of a text that was counted for the lexicon; it is then left out of the counts.
    """
    text = text.lower()
    tokens = WORDS.findall(text)
    hits = [(i, m) for i, w in enumerate(tokens) if (m := lexicon.match(w))]
    if not hits:
        return [0.0] * (N_FEATURES - 1) + [math.log1p(len(tokens))]
    spans = [m.span() for m in WORDS.finditer(text)]
    less = (0, 0) if y is None else (y, 1 - y)
    abuse: dict[str, float] = {}
    mentions = n = 0.0
    for i, (term, distance) in hits:
        w = model.term_weight(term, less if not distance else (0, 0))
        if not w:
            continue
        c = _context(tokens, spans, text, i)
        w *= MISSPELT if distance else 1
        if c < 0.3:
            mentions += w
        else:
            abuse[term] = max(abuse.get(term, 0.0), w * c)
            n += 1
    best = sorted(abuse.values(), reverse=True)[:4]
    return [sum(best) / 5, min(mentions, 20.0) / 5, (best or [0.0])[0] / 5, math.log1p(100 * n / len(tokens)), math.log1p(len(tokens))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights with the constant last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _words_of(sample: DataFrame) -> DataFrame:
    """In how many toxic and other texts each word stands."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ys = [], []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = set(WORDS.findall(text.as_py().lower()))
                words += found
                ys += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ys, pa.int32())], ["word", "y"])

    return sample.select("_text", "_y").mapInArrow(apply, "word string, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learns terms and weights from at most ``sample`` labelled rows outside the held-out fold.

    Words are counted on the executors; the driver gets the terms, their look-alikes and a row of features for each sampled
    text, which ``sample`` bounds: a term stands in four toxic texts of it or more. Without labels of both kinds the seeds and
    fixed weights stand.
    """
    rows = cut(labelled_sample(docs, labels, label, FOLDS, HELD_OUT, sample, id_col, text_col))
    total = rows.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("a"), F.coalesce(F.sum(1 - F.col("_y")), F.lit(0)).alias("b")).first()
    words = cut(_words_of(rows))
    odds = ((F.col("a") + 0.2) / (total["a"] + 1)) / ((F.col("b") + 0.2) / (total["b"] + 1))
    # how unlikely so many toxic texts are among those with the word, if it told nothing (minus the log, at most)
    share, base = F.col("a") / (F.col("a") + F.col("b")), total["a"] / max(1, total["a"] + total["b"])
    told = F.col("a") * F.log(share / max(base, 1e-9)) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / max(1 - base, 1e-9))).otherwise(0.0)
    terms = words.filter((F.col("a") >= 2) & (odds > 2) & (F.length("word") > 2)).withColumn("s", told).filter(F.col("s") >= TELLING).orderBy(F.desc("s"), "word").collect()
    counts = {r["word"]: (float(r["a"]), float(r["b"])) for r in terms}
    for t in SEEDS:
        a, b = counts.get(t, (0.0, 0.0))
        counts[t] = (a + 3.0, b)
    model = ToxicityModel(counts, (float(total["a"]) + 3, float(total["b"]) + 3))
    if not (total["a"] and total["b"]):
        model.weights = [4.0, 0.0, 2.0, 0.5, 0.0, -4.0]
        return model
    lexicon = model.lexicon()

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool((m := lexicon.search(w)) and m[1]) for w in batch.column(0).to_pylist()], pa.bool_()))

    ordinary = words.mapInArrow(alike, words.schema).filter(F.col("b") * (total["a"] + 1) > F.col("a") * (total["b"] + 1) * 0.3).orderBy("word")
    model.ordinary = [r["word"] for r in ordinary.collect()]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.lexicon()
        for batch in batches:
            ys = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py(), known, model, y) for t, y in zip(batch.column(0), ys, strict=True)], pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["x", "y"])

    got = rows.select("_text", "_y").mapInArrow(measure, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    order = np.lexsort([*x.T, y])  # rows come in any order; sums must not depend on it
    model.weights = fit_logistic(x[order], y[order]).round(9).tolist()
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text", carry: Sequence[str] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """The ``carry`` columns of each row, and ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``, else 0).

    A null text counts as empty, which has the score of a text without hits. Texts are read whole; repeated rows
    are rows; an empty table gives none. A carried column named like a new one is replaced. Texts go to the workers
    once, whether carried or not.
    """
    carry = [c for c in carry if c not in ("score", "predicted")]
    again = [c for c in carry if c == text_col and docs.schema[c].dataType == T.StringType()]
    names = {c: "_text" if c in again else f"_c{i}" for i, c in enumerate(carry)}
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(n) for c, n in names.items() if c not in again))
    passed = rows.schema.fields if again else rows.schema.fields[1:]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in passed), "score double"])
    first = len(rows.columns) - len(passed)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        *w, constant = model.weights
        for batch in batches:
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, constant + sum(a * b for a, b in zip(w, features(t.as_py() or "", lexicon, model), strict=True)))))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(scores, pa.float64())], [*batch.schema.names[first:], "score"])

    scored = rows.mapInArrow(apply, schema)
    return scored.select(*(F.col(n).alias(c) for c, n in names.items()), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id"):
    return remainder(id_col, FOLDS) == HELD_OUT
