"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space, of any kind, and without separators of information at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank(text: Column) -> Column:
    """Whether a text is null, empty or white space only."""
    return text.isNull() | (strip(text) == "")


def holds(text: Column, part: str) -> Column:
    """Case-insensitive containment; the part is literal, and an empty one is in everything."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def replace_at(text: Column, start: Column, length: Column, new: Column) -> Column:
    """``length`` characters from ``start`` (from 1) replaced; where ``start`` is 0, the text unchanged."""
    changed = F.concat(F.substring(text, F.lit(1), start - 1), new, F.substring(text, start + length, F.length(text)))
    return F.when(start > 0, changed).otherwise(text)
