"""Venue lookup."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..schema import VENUE


def venue_info(venues: DataFrame, name: str) -> DataFrame:
    """Exactly one row: the first venue, by name and URL, all words of which query stand in its name or acronym;
    where there is none, four empty texts."""
    terms = re.findall(r"[^\W_]+", name.lower())
    text = words(F.concat_ws(" ", "venue", "acronym"))
    hit = reduce(lambda a, b: a & b, [F.array_contains(text, w) for w in terms]) if terms else F.lit(False)
    first = venues.where(hit).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in VENUE.names]).orderBy("venue", "url").limit(1)
    # an aggregate without groups gives one row even where nothing was found
    got = first.agg(F.first(F.struct(*VENUE.names)).alias("v"))
    return got.select(*[F.coalesce(F.col("v")[c], F.lit("")).alias(c) for c in VENUE.names])
