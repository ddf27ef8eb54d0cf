"""Toxicity: a Levenshtein automaton over a lexicon trie, context windows, and a calibrated score.

The lexicon has whole words, which may be misspelled, and stems, which any ending may follow. Besides a short
fixed list it is learned from labelled texts. All terms stand in one trie; the automaton is its product with
the edit automaton (insertions, deletions, substitutions and swaps of neighbours, within an error count that
grows with the term's length), determinised as words are read, so a word that is like no term ends after a
few steps. A misspelling that is an ordinary word of clean labelled texts does not count.

Every hit is looked at in a window of words: a pair of quotation marks about it or words of reporting make it
a quotation, otherwise it is abuse. An apostrophe within a word is no mark. Counts of quoted, exact and misspelled hits, set against the text's
length, go through a logistic model, calibrated to the label shares of the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, unused

#: Common English insults, the part of the lexicon that is not learned.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "clown", "worthless", "pathetic", "disgusting", "imbecile", "bastard", "asshole", "bitch")
#: Words that report speech, and marks of quotation with those that may close them.
REPORTING = frozenset("said says quoted wrote called told word words term quote reported dit mot sagte schrieb wort dijo palabra escribió".split())
CLOSERS = {'"': '"', "“": "”“", "”": "”", "„": "“”", "«": "»", "»": "«»", "‘": "’", "’": "’", "'": "'", "`": "`'"}
OPENING, CLOSING = "“„«‘", "”»"
MARK = re.compile("[" + "".join(CLOSERS) + "]")
WINDOW = 6
#: What a misspelled and a quoted hit count against a plain one.
MISSPELLED, QUOTED = 0.7, 0.1
N_FEATURES = 5

#: Bounds of the training sample: labelled texts per class, and characters of the longest.
PER_CLASS, LONGEST = 4000, 50_000

WORD = re.compile(r"[^\W_]+")
STEM, WHOLE = 1, 2
#: Lengths of stems that are looked at.
STEMS = range(3, 10)


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Finds the term that a word spells, exactly or with errors; states are made as words need them."""

    def __init__(self, words: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, int] | None] = [None]  # (kind, number of the term)
        self.room = [0]  # the most errors that a term below may have
        self.terms = [(w, WHOLE) for w in words] + [(s, STEM) for s in stems]
        for number, (term, kind) in enumerate(self.terms):
            node, path = 0, [0]
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.accepts.append(None)
                    self.room.append(0)
                node = self.child[node][c]
                path.append(node)
            self.accepts[node] = (kind, number)
            for n in path if kind == WHOLE else ():
                self.room[n] = max(self.room[n], allowed_errors(term))
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.done: list[int | None] = []  # the stem that has been read in full without errors
        self.start = self.state({(0, 0, "")})

    def closed(self, configs: set[tuple[int, int, str]]) -> set[tuple[int, int, str]]:
        """With the deletions: term letters that the word lacks."""
        todo = list(configs)
        while todo:
            node, errors, waits = todo.pop()
            if not waits:
                for child in self.child[node].values():
                    if errors < self.room[child] and (new := (child, errors + 1, "")) not in configs:
                        configs.add(new)
                        todo.append(new)
        return configs

    def state(self, configs: set[tuple[int, int, str]]) -> int:
        key = frozenset(self.closed(configs))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(errors, self.accepts[node][1]) for node, errors, waits in key if not waits and self.accepts[node] and (self.accepts[node][0] == WHOLE and errors <= allowed_errors(self.terms[self.accepts[node][1]][0]))]
            best = min(ends, default=None)
            self.final.append((best[1], best[0]) if best else None)
            self.done.append(next((self.accepts[node][1] for node, errors, waits in key if not waits and not errors and self.accepts[node] and self.accepts[node][0] == STEM), None))
        return self.ids[key]

    def step(self, at: int, c: str) -> int:
        """The state after one more letter; -1 where no term is left."""
        new = set()
        for node, errors, waits in self.sets[at]:
            if waits:  # the second letter of a swap
                if c == waits[0]:
                    new.add((node, errors, ""))
                continue
            if c in self.child[node]:
                new.add((self.child[node][c], errors, ""))
            if errors < self.room[node]:
                new.add((node, errors + 1, ""))
            for letter, child in self.child[node].items():
                if letter != c and errors < self.room[child]:
                    new.add((child, errors + 1, ""))
                    if c in self.child[child] and errors < self.room[self.child[child][c]]:
                        new.add((self.child[child][c], errors + 1, letter))
        to = self.state(new) if new else -1
        self.steps[at][c] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(number of the term, errors) of the term that the word spells, or None."""
        at, stem, steps, done = self.start, None, self.steps, self.done
        for c in word:
            to = steps[at].get(c)
            if to is None:
                to = self.step(at, c)
            if to < 0:
                return None if stem is None else (stem, 0)
            at = to
            if stem is None:
                stem = done[at]
        return self.final[at] if stem is None else (stem, 0)


def evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """The log-likelihood ratio that a feature's share of toxic texts differs from that of clean ones."""

    def part(k: int, n: int, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log(1 - p) if n > k else 0.0)

    both = (toxic + clean) / (n_toxic + n_clean)
    if both >= 1:
        return 0.0
    return 2 * (part(toxic, n_toxic, toxic / n_toxic) + part(clean, n_clean, clean / n_clean) - part(toxic, n_toxic, both) - part(clean, n_clean, both))


def learn_lexicon(sample: list[tuple[str, int]], least: float = 22.0, lift: float = 3.0) -> tuple[list[str], list[str], frozenset[str]]:
    """Words and stems that mark toxic texts, and the ordinary words of clean ones (in two texts or more).

    A word counts once a text; a stem (noted with one or two stars) where one or two different words have it."""
    n = [max(1, sum(y == k for _, y in sample)) for k in (0, 1)]

    def marks(text: str) -> tuple[set[str], Counter]:
        words = set(WORD.findall(text.lower()))
        return words, Counter(w[:k] for w in words for k in STEMS if len(w) > k)

    seen: Counter = Counter()
    for text, y in sample:
        if y:
            words, starts = marks(text)
            seen.update(words)
            seen.update(s + "*" * min(2, times) for s, times in starts.items())
    # what has two stars has one as well
    for feature in [f for f in seen if f.endswith("**")]:
        seen[feature[:-1]] += seen[feature]
    seen = Counter({f: k for f, k in seen.items() if k >= 4})
    other: Counter = Counter()
    once: set[int] = set()
    ordinary: set[str] = set()
    for text, y in sample:
        if not y:
            words, starts = marks(text)
            other.update(w for w in words if w in seen)
            for s, times in starts.items():
                if s + "*" in seen:
                    other[s + "*"] += 1
                if times > 1 and s + "**" in seen:
                    other[s + "**"] += 1
            for w in words:  # in two clean texts or more; a clash of hashes does no harm
                if (h := hash(w)) in once:
                    ordinary.add(w)
                else:
                    once.add(h)
    found = []
    for feature, toxic in seen.items():
        clean = other[feature]
        if toxic / n[1] >= lift * clean / n[0] and (g := evidence(toxic, clean, n[1], n[0])) >= least:
            found.append((g, not feature.endswith("*"), len(feature.rstrip("*")), feature))
    words, stems = [], []
    for _, whole, _, feature in sorted(found, reverse=True):
        base = feature.rstrip("*")
        if not any(base.startswith(s) or (not whole and s.startswith(base)) for s in stems) and (whole or not any(w.startswith(base) for w in words)):
            (words if whole else stems).append(base)
    return words, stems, frozenset(ordinary)


def marks(text: str, lo: int, hi: int) -> list[tuple[str, bool, bool]]:
    """The quotation marks in a range of a text: (mark, may open, may close). One that opens has no letter or digit
    before it and no white space after it; one that closes the other way round; so one between letters does neither.
    White space inside does not matter to marks that show their direction."""
    out = []
    for m in MARK.finditer(text, lo, hi):
        at = m.start()
        before, after = text[at - 1 : at] if at else " ", text[at + 1 : at + 2] or " "
        opens = not before.isalnum() and (m[0] in OPENING or not after.isspace())
        closes = not after.isalnum() and (m[0] in CLOSING or not before.isspace())
        if opens or closes:
            out.append((m[0], opens, closes))
    return out


def in_quotes(text: str, lo: int, start: int, end: int, hi: int) -> bool:
    """Whether a pair of marks stands about ``start`` to ``end`` of a text, within ``lo`` to ``hi``: one opened
    before and not closed there, and the first of its closers after."""
    waits: list[str] = []
    for mark, opens, closes in marks(text, lo, start):
        at = next((k for k in range(len(waits) - 1, -1, -1) if mark in waits[k]), None) if closes else None
        if at is not None:
            del waits[at:]
        elif opens:
            waits.append(CLOSERS[mark])
    return any(closes and any(mark in w for w in waits) for mark, _, closes in marks(text, end, hi)) if waits else False


class Model:
    """The lexicon with its automaton, and the weights of the score."""

    def __init__(self, words: list[str], stems: list[str], ordinary: frozenset[str]):
        self.words, self.stems = words, stems
        self.automaton = Automaton(words, stems)
        own = set(words)
        #: Clean words that the automaton would take for misspellings.
        self.ordinary = frozenset(w for w in ordinary if w not in own and (hit := self.automaton.find(w)) and hit[1])
        self.mean, self.spread, self.weights, self.bias = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -3.0
        self.hits: dict[str, tuple[int, int] | None] = {}

    def hit(self, word: str) -> tuple[int, int] | None:
        found = self.automaton.find(word)
        return None if found and found[1] and word in self.ordinary else found

    def features(self, text: str) -> list[float]:
        """Counts of the hits in a lower-cased text, on log scales, and its length."""
        words, hits = WORD.findall(text), self.hits
        if len(hits) > 400_000:
            hits.clear()
        found = []
        for w in set(words):
            if w in hits:
                hit = hits[w]
            else:
                hit = hits[w] = self.hit(w)
            if hit:
                found.append(w)
        plain = wrong = quoted = 0
        terms: set[int] = set()
        if found:
            among, spans = set(found), list(WORD.finditer(text))
            for i, w in enumerate(words):
                if w not in among:
                    continue
                number, errors = hits[w]
                lo = spans[i - WINDOW - 1].end() if i > WINDOW else 0
                hi = spans[i + WINDOW + 1].start() if i + WINDOW + 1 < len(words) else len(text)
                if REPORTING & set(words[max(0, i - WINDOW) : i]) or in_quotes(text, lo, *spans[i].span(), hi):
                    quoted += 1
                elif errors:
                    wrong += 1
                else:
                    plain += 1
                terms.add(number)
        n = math.log1p(len(words))
        sure = plain + MISSPELLED * wrong + QUOTED * quoted
        return [math.log1p(sure), math.log1p(len(terms)), math.log1p(sure) * n / 6, n, min(1.0, sure)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features((t or "").lower()) for t in texts]).reshape(-1, N_FEATURES)
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.spread @ self.weights + self.bias, -30, 30)))

    def fit(self, sample: list[tuple[str, int]], counts: dict[int, int]) -> None:
        """Logistic regression by Newton steps; weights restore the label shares that the sampling changed."""
        x = np.array([self.features(t.lower()) for t, _ in sample])
        y = np.array([k for _, k in sample], float)
        w = np.where(y == 1, counts.get(1, 0) / max(1, y.sum()), counts.get(0, 0) / max(1, (1 - y).sum()))
        w *= len(y) / w.sum()
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([(x - self.mean) / self.spread, np.ones(len(y))])
        b = np.zeros(N_FEATURES + 1)
        ridge = np.diag([0.05] * N_FEATURES + [1e-6]) * 10
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (w * p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (w * (y - p)) - ridge @ b)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights, self.bias = b[:-1], float(b[-1])


def train(sample: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """A model of labelled texts. Without texts of both classes: the fixed words, with fixed weights."""
    if len({y for _, y in sample}) < 2:
        model = Model(list(SEEDS), [], frozenset())
        model.weights = np.array([3.0, 1.0, 0.0, -0.3, 2.0])
        return model
    words, stems, ordinary = learn_lexicon(sample)
    model = Model(list(dict.fromkeys([*SEEDS, *words])), stems, ordinary)
    model.fit(sample, counts)
    return model


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    """A model of the labelled rows that ``allowed`` (a condition on the label table) lets through, from a
    sample bounded by ``per_class`` and ``longest``."""
    return train(*labelled_sample(docs, labels, label_col, allowed, per_class, longest, id_col, text_col))


def scorer(docs: DataFrame, model: Model) -> Callable[[Column], Column]:
    """The score of a text column by a model that is sent to the executors."""
    state = (model.words, model.stems, model.automaton, model.ordinary, model.mean, model.spread, model.weights, model.bias)
    shared = docs.sparkSession.sparkContext.broadcast(state)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model.__new__(Model)
        own.words, own.stems, own.automaton, own.ordinary, own.mean, own.spread, own.weights, own.bias = shared.value
        own.hits = {}
        for part in parts:
            yield pd.Series(own.score([t if isinstance(t, str) else None for t in part]), dtype="float64")

    return run.asNondeterministic()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row's whole text.

    A null or empty text has no hits and is scored like any text without. Rows stay one to one, repeats too;
    other columns are not looked at; an empty table gives an empty result."""
    return docs.select(id_col, scorer(docs, model)(F.col(text_col).cast("string")).alias("score"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with the columns of ``docs`` whatever their names.

    Null and empty texts are scored like any text without hits; repeated rows stay or go together; an empty
    table gives an empty result."""
    (own,) = unused(docs.columns, "_score")
    return docs.withColumn(own, scorer(docs, model)(F.col(text_col).cast("string"))).where(F.col(own) < threshold).drop(own)
