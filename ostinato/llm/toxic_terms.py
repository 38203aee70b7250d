"""Toxicity scores from a lexicon, misspellings included, with quotation told from abuse by the context.

The lexicon is a trie of a fixed list and of words and stems that labelled rows show to be tied to the label. A word is
read by the intersection of that trie with Levenshtein automata: a state is a set of (trie node, edits so far), made
deterministic as words need it. One edit is allowed in full words of five letters and more, none in the first letter; look-alike
digits and signs count as letters. Each hit is weighed by its context: a hit between quotation marks or after a verb of
saying counts as quotation, others as abuse, and windows of ``WINDOW`` words add up neighbouring hits. A logistic model
on these sums gives the score.

Labels are learned on at most ``SAMPLE`` labelled rows of each class, chosen by a hash of the key, never on held-out rows (those with
crc32(key as text) mod 4 = 2); the true share of the classes, counted over all labelled training rows, sets the intercept.

Defined results: null, empty and blank texts have no hits and get the score of texts without hits; repeated rows get equal
scores; a label row without a label is no label, one of several for a key counts if any is 1; a row with a null key has a score and no
label; a text of any length is scored whole, word by word; extra columns are ignored, whatever their names;
without training rows the fixed list alone decides; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.runtime import persist_table

# Insults that need no labelled row to be known.
TERMS = [
    "arschloch", "bastard", "clown", "coward", "cretin", "creep", "crétin", "degenerate", "despicable", "dimwit",
    "disgusting", "dumb", "dummkopf", "estúpido", "filthy", "fool", "freak", "gilipollas", "halfwit", "idiot", "idiota",
    "ignorant", "imbecile", "imbécile", "imbécil", "jerk", "liar", "loser", "maggot", "moron", "nitwit", "parasite",
    "pathetic", "pig", "repulsive", "rubbish", "scum", "scumbag", "stupid", "stupide", "swine", "trash", "ugly", "vermin",
    "vile", "wertlos", "worthless", "wretch",
]
# Verbs that introduce another's words.
SAYING = [
    "called", "calls", "claimed", "dijo", "dit", "escribió", "nannte", "quote", "quoted", "quoting", "sagte", "said", "says",
    "schrieb", "word", "wrote", "écrit",
]
# Signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
OPENING, CLOSING = '"“„«', '"”“»'

SAMPLE, MAX_TERMS, WINDOW, THRESHOLD = 8000, 2000, 20, 0.3
#: Lengths of the stems that are tried, and words that a worker remembers at most.
STEMS, CACHE = range(3, 9), 150_000
_WORD = re.compile(r"[^\W_](?:[\w@$]*\w)?")
EXACT, FUZZY, STEM = 0, 1, 2


class Lexicon:
    """Trie of words and stems, read through lazily determinised Levenshtein automata."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.budget: list[int] = [0]  # edits that the longest term below a node allows
        for term, of in [(w, self.word_at) for w in words] + [(s, self.stem_at) for s in stems]:
            edits = int(len(term) >= 5 and of is self.word_at)
            node = 0
            self.budget[0] = max(self.budget[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            of[node] = term
        self.states: list[dict[int, int]] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._number({0: 0})
        self.known: dict[str, tuple[str, int] | None] = {}

    def _number(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return self.numbers[key]

    def _step(self, state: dict[int, int], c: str) -> dict[int, int]:
        out: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.budget[node] and edits < out.get(node, 9):
                out[node] = edits

        letters = c + LOOKALIKES.get(c, "")
        for node, edits in state.items():
            own = self.children[node]
            for letter in letters:
                if letter in own:
                    put(own[letter], edits)
            if node == 0:
                continue  # the first letter is right
            put(node, edits + 1)  # a letter too many
            for child in own.values():
                put(child, edits + 1)  # another letter
                for letter in letters:  # a letter missing before this one
                    if letter in self.children[child]:
                        put(self.children[child][letter], edits + 1)
        return out

    def find(self, word: str) -> tuple[str, int] | None:
        """The term that a word stands for, and whether exactly, with an edit, or by its stem."""
        if word in self.known:
            return self.known[word]
        at, stem = self.start, None
        for c in word:
            moves = self.moves[at]
            if c not in moves:
                if len(self.states) > 200_000:  # bounded memory: start the determinised states anew
                    self.states, self.numbers, self.moves = [], {}, []
                    self.start = self._number({0: 0})
                    return self.find(word)
                moves[c] = self._number(self._step(self.states[at], c))
            at = moves[c]
            state = self.states[at]
            if not state:
                break
            for node, edits in state.items():
                if node in self.stem_at and not edits:
                    stem = self.stem_at[node]
        best = None
        for node, edits in self.states[at].items():
            spare = self.budget[node] - edits
            if node in self.word_at and (best is None or edits < best[1]) and edits <= int(len(self.word_at[node]) >= 5):
                best = (self.word_at[node], edits)
            if spare >= 1:  # the last letter is missing
                for child in self.children[node].values():
                    if child in self.word_at and len(self.word_at[child]) >= 5 and best is None:
                        best = (self.word_at[child], edits + 1)
        found = (best[0], FUZZY if best[1] else EXACT) if best and not (stem and best[1]) else ((stem, STEM) if stem else None)
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = found
        return found


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: dict[str, float]
    coefficients: list[float]


def _quoted(text: str, start: int, end: int) -> bool:
    """Between quotation marks of its line, or after a verb of saying within four words."""
    left = text.rfind("\n", 0, start) + 1
    right = text.find("\n", end)
    before, after = text[left:start], text[end : len(text) if right < 0 else right]
    for opening, closing in zip(OPENING, CLOSING, strict=True):
        if opening == closing:
            inside = before.count(opening) % 2 == 1 and closing in after
        else:
            inside = before.rfind(opening) > before.rfind(closing) and closing in after
        if inside:
            return True
    return any(w in SAYING for w in _WORD.findall(before[-60:])[-4:])


def features(text: str | None, lexicon: Lexicon, weights: dict[str, float]) -> list[float]:
    """Logarithms of weighed hits: abuse exact, by stem, with an edit; quoted; the heaviest window; share of all words."""
    text = (text or "").lower()
    words = _WORD.findall(text)
    find, known = lexicon.find, lexicon.known
    hits = {w for w in set(words) if (known[w] if w in known else find(w)) is not None}
    if not hits:
        return [0.0] * 6
    sums, spots, number = [0.0] * 4, [], 0
    for m in _WORD.finditer(text):
        number += 1
        if m.group() not in hits:
            continue
        term, how = find(m.group())
        weight = weights.get(term, 1.0)
        if _quoted(text, *m.span()):
            sums[3] += weight
        else:
            sums[{EXACT: 0, STEM: 1, FUZZY: 2}[how]] += weight
            spots.append((number, weight * (0.5 if how == FUZZY else 1)))
    best, low, total = 0.0, 0, 0.0
    for at, weight in spots:
        total += weight
        while spots[low][0] <= at - WINDOW:
            total -= spots[low][1]
            low += 1
        best = max(best, total)
    return [math.log1p(x) for x in (*sums, best)] + [math.sqrt(sum(sums[:3]) / len(words))]


def _trained_rows(docs: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most SAMPLE rows per class, and the classes' true counts among training rows."""
    own = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    own = own.where(F.pmod(F.crc32(F.col("_key").cast("string")), F.lit(4)) != 2)
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = own.where(F.col("label") == label).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("_key")  # 2 x SAMPLE rows at most
    )
    return rows.select("_id", "text", "label"), sizes


def _term_counts(rows: DataFrame) -> DataFrame:
    """Texts of each class that hold a word or a stem (marked by *)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                words |= {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}
                for w in words:
                    counts[w][label] += 1
            yield pa.record_batch(
                [pa.array(list(counts), pa.string())] + [pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)],
                names=["term", "clean", "toxic"],
            )

    found = rows.select("text", "label").mapInArrow(run, "term string, clean long, toxic long")
    return found.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    rows, sizes = _trained_rows(docs, labels, key, text)
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = seen.get(0, 0), seen.get(1, 0)
    weights = dict.fromkeys(TERMS, 1.0)
    words, stems = list(TERMS), []
    if not n0 or not n1:
        return Model(words, stems, weights, [-3.0, 2.5, 2.5, 1.0, 0.0, 0.5, 0.5])
    odds = lambda c, t: math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))
    # terms that hold against chance: ten times as common in toxic texts, and too often for a coincidence among all terms
    share = n1 / (n0 + n1)
    excess = (F.col("toxic") + 0.0) * F.log(F.col("toxic") / (F.col("toxic") + F.col("clean")) / share)
    every = persist_table(_term_counts(rows), "term-counts")
    # words of the fixed list weigh as much as the training rows bear out, with a prior of two toxic texts
    for r in every.where(F.col("term").isin(TERMS)).collect():
        weights[r["term"]] = min(1.5, max(0.0, odds(r["clean"] + 0.1, r["toxic"] + 2) / 5))
    counts = every.where((F.col("toxic") / n1) >= 10 * F.col("clean") / n0).where(F.col("toxic") >= 4)
    best = counts.withColumn("excess", excess).where("excess > 13").orderBy(F.desc("excess"), "term").limit(MAX_TERMS).collect()
    found = {r["term"]: (r["clean"], r["toxic"]) for r in best}
    scores, taken = {r["term"]: r["excess"] for r in best}, {}
    # the most telling first; of equally telling stems of one word the longest
    for term in sorted(found, key=lambda x: (-round(scores[x], 6), -len(x), x)):
        c, t = found[term]
        bare = term.rstrip("*")
        if any(bare.startswith(x) for x in stems):
            continue
        if term.endswith("*"):
            if any(x.startswith(bare) and taken[x] >= 0.8 * t for x in taken):
                continue
            stems.append(bare)
        elif bare not in weights:
            words.append(bare)
        taken[bare] = t
        weights[bare] = max(0.3, odds(c, t) / 5)
    # a word that a stem covers needs no entry of its own, unless it is on the fixed list
    words = [w for w in words if weights[w] > 0 and (w in TERMS or not any(w.startswith(s) for s in stems))]
    model = Model(words, stems, weights, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.stems)
        for batch in batches:
            made = [features(x, lexicon, model.weights) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.list_(pa.float64())), batch.column(2)], names=["id", "x", "label"])

    # 2 x SAMPLE rows of six numbers at most; sorted, so that sums have one order
    sample = rows.mapInArrow(run, f"id {rows.schema['_id'].dataType.simpleString()}, x array<double>, label int").toPandas().sort_values("id")
    x = np.column_stack([np.ones(len(sample)), np.array(sample["x"].tolist())])
    y = sample["label"].to_numpy(dtype=float)
    true = sizes[1] / (sizes[0] + sizes[1])
    importance = np.where(y == 1, true / share, (1 - true) / (1 - share))
    model.coefficients = logistic(x, y, importance).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the intercept is not shrunk."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (importance * (y - p)) - penalty * beta
        hessian = (x * (importance * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_of(text: F.Column, model: Model) -> F.Column:
    """The score of a text column; nothing but that column is sent to Python."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.words, model.stems)
        beta = np.array(model.coefficients)
        for texts in batches:
            made = np.array([features(x, lexicon, model.weights) for x in texts]).reshape(len(texts), len(beta) - 1)
            z = np.clip(beta[0] + (made * beta[1:]).sum(axis=1), -30, 30)
            yield pd.Series(1 / (1 + np.exp(-z)))

    return score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, score and predicted."""
    scored = docs.select(F.col(key).alias("key"), score_of(F.col(text), model).alias("score"))
    return scored.select(
        F.col("key").alias(key),
        F.coalesce(F.pmod(F.crc32(F.col("key").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't predict to be toxic."""
    return docs.where(score_of(F.col(text), model) < THRESHOLD)
