"""The query language: OR of ANDs of words, each in a field or anywhere.

`` or `` between spaces separates arms, in any case. Within an arm all words must match; the word ``and`` is an
operator and dropped. ``author:``, ``title:``, ``year:`` and ``venue:`` bind to the next word only. Parentheses
are no operators: they separate words like any other sign. An arm without words matches nothing.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import words

log = logging.getLogger(__name__)

FIELDS = ("author", "title", "year", "venue")
TERM = re.compile(r"(?:\b(author|title|year|venue):\s*)?([^\W_]+)")


@dataclass(frozen=True)
class Term:
    """A word, and the field it must stand in, or None for any."""

    word: str
    field: str | None = None


def arms_of(query: str) -> list[str]:
    """The arms of an OR; a query without one is its only arm."""
    low = query.lower()
    if "(" in low or ")" in low:
        log.warning("parentheses are not operators; they only separate words")
    return [a.strip() for a in low.split(" or ") if a.strip()] if " or " in low else [low]


def parse(query: str) -> list[list[Term]]:
    """The terms of each arm."""
    return [[Term(m[2], m[1]) for m in TERM.finditer(arm) if m[1] or m[2] != "and"] for arm in arms_of(query)]


def is_or(query: str) -> bool:
    return " or " in query.lower()


def place(field: str | None) -> Column:
    """The text that a field's words stand in."""
    names = F.concat_ws(" ", "authors")
    year = F.col("year").cast("string")
    return {"author": names, "title": F.col("title"), "venue": F.col("venue"), "year": year}.get(field, F.concat_ws(" ", F.col("title"), names, F.col("venue"), year))


def matches(terms: list[Term]) -> Column:
    """Whether a publication matches all terms; the cheap containment goes before the words."""

    def one(term: Term) -> Column:
        text = F.coalesce(place(term.field), F.lit(""))
        return F.contains(F.lower(text), F.lit(term.word)) & F.array_contains(words(text), term.word)

    return reduce(lambda a, b: a & b, map(one, terms), F.lit(True)) if terms else F.lit(False)
