"""Ratcliff-Obershelp similarity, guarded by native upper bounds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least score of a title that holds the whole query.
CONTAINED = 0.8


def matched(query: str, text: str, least: float = 0.0) -> float:
    """Twice the matched characters over both lengths, the query being the first sequence; 0 where that is below
    ``least``. Blocks are found largest first, and the search ends when what is left of both cannot reach ``least``."""
    size = len(query) + len(text)
    if not size:
        return 1.0
    matcher = SequenceMatcher(None, query, text)
    todo, done, open_size = [(0, len(query), 0, len(text))], 0, min(len(query), len(text))
    while todo:
        if 2.0 * (done + open_size) / size < least:
            return 0.0
        a, b, c, d = todo.pop()
        open_size -= min(b - a, d - c)
        i, j, k = matcher.find_longest_match(a, b, c, d)
        if k:
            done += k
            for part in ((a, i, c, j), (i + k, b, j + k, d)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append(part)
                    open_size += min(part[1] - part[0], part[3] - part[2])
    found = 2.0 * done / size
    return found if found >= least else 0.0


@lru_cache(maxsize=100_000)
def ratio(query: str, text: str, least: float = 0.0) -> float:
    """As :func:`matched`, for texts that come again and again, as names do."""
    return matched(query, text, least)


def bound(query: str, text: Column) -> Column:
    """An upper bound of the ratio of a literal query with a lower-cased text: twice the characters that
    both have, counted with repeats, over both lengths. Where both are empty it is 0, and no bound."""
    size = F.length(text)
    shared = F.lit(0)
    for c, n in sorted(Counter(query).items()):
        shared = shared + F.least(F.lit(n), size - F.length(F.replace(text, F.lit(c), F.lit(""))))
    return F.lit(2.0) * shared / F.greatest(size + len(query), F.lit(1))


def may_reach(query: str, text: Column, threshold: float) -> Column:
    """Whether the bounds allow the threshold; the length alone is tried first."""
    if threshold <= 0:
        return F.lit(True)
    size = F.length(text)
    by_length = F.lit(2.0) * F.least(size, F.lit(len(query))) / F.greatest(size + len(query), F.lit(1)) >= threshold
    return ((size + len(query)) == 0) | (by_length & (bound(query, text) >= threshold))


def ratio_udf(query: str, least: float = 0.0) -> Callable[[Column], Column]:
    """The ratio of a literal query with a text column, 0 below ``least``; null where the text is. It counts as not
    deterministic, so that a later filter on it does not run it twice: filter natively before."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else matched(query, t, least)).astype("float64")

    return run.asNondeterministic()


def best_ratio_udf(query: str, least: float = 0.0) -> Callable[[Column], Column]:
    """The best ratio over an array of texts; 0 where there are none or all are below ``least``."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda names: max((ratio(query, n, least) for n in names), default=0.0) if names is not None else 0.0).astype("float64")

    return run.asNondeterministic()


class Queries:
    """A block of queries against many texts: containment, bounds for all at once, and the ratio where they allow it."""

    #: Classes of characters in the bound; characters of one class count as equal, so it stays a bound.
    CLASSES = 128

    def __init__(self, rows: list[tuple[object, str]], least: float):
        self.ids, self.least = [i for i, _ in rows], least
        self.texts = [t.lower() for _, t in rows]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.counts = np.stack([self.histogram(t) for t in self.texts]) if rows else np.zeros((0, self.CLASSES), np.int64)

    @classmethod
    def histogram(cls, text: str) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") % cls.CLASSES, minlength=cls.CLASSES)

    def score(self, title: str) -> list[tuple[int, float]]:
        """(number of the query, score) of the queries that the title reaches ``least`` with."""
        text, size = title.lower(), len(title.lower())
        both = np.maximum(self.lengths + size, 1)
        near = 2.0 * np.minimum(self.lengths, size) / both >= self.least
        near &= 2.0 * np.minimum(self.counts, self.histogram(text)).sum(1) / both >= self.least
        near |= (self.lengths + size == 0) | (self.least <= 0)
        out = []
        for k, query in enumerate(self.texts):
            if query in text:
                found = max(CONTAINED, len(query) / size) if size else 0.0
            else:
                found = matched(query, text, self.least) if near[k] else -1.0
            if found >= self.least:
                out.append((k, found))
        return out


def contained_score(query: str, text: Column) -> Column:
    """The score of a lower-cased title that holds the query: its coverage, at least ``CONTAINED``; 0 for an
    empty title; null where the title does not hold the query."""
    size = F.length(text)
    return F.when(F.contains(text, F.lit(query)), F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(CONTAINED), F.lit(len(query)) / size)))
