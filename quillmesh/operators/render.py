"""Text renderings of results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

#: Fixed texts of the renderings; the label of a record key is a parameter.
NOTHING = "No results found."
KEY_LABEL = "Record key"


@F.pandas_udf(T.StringType())
def two_places(x: pd.Series) -> pd.Series:
    """Two decimals, rounded as the exact binary value rounds; only limited results come here."""
    return x.map(lambda v: f"{0.0 if pd.isna(v) else v:.2f}")


def block(similarity: bool = False, bibtex: bool = False, key_label: str = KEY_LABEL) -> Column:
    """One publication as numbered lines."""
    head = F.concat(F.col("position").cast("string"), F.lit(". "), F.col("title"))
    if similarity:
        head = F.concat(head, F.lit(" [Similarity: "), two_places(F.col("similarity")), F.lit("]"))
    year = F.coalesce(F.col("year").cast("string"), F.lit("None"))
    lines = [
        head,
        F.concat(F.lit("   Authors: "), F.array_join("authors", ", ")),
        F.concat(F.lit("   Venue: "), F.coalesce("venue", F.lit("")), F.lit(" ("), year, F.lit(")")),
        F.when(F.col("rec_key") != "", F.concat(F.lit(f"   {key_label}: "), F.col("rec_key"))),
    ]
    if bibtex:
        text = F.replace(strip(F.col("bibtex")), F.lit("\n"), F.lit("\n      "))
        lines.append(F.when(F.coalesce("bibtex", F.lit("")) != "", F.concat(F.lit("\n   BibTeX:\n      "), text)))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def blocks(found: DataFrame, similarity: bool = False, bibtex: bool = False, key_label: str = KEY_LABEL) -> DataFrame:
    """``position`` and ``block`` of limited results."""
    return found.select("position", block(similarity, bibtex, key_label).alias("block"))


def text(found: DataFrame, similarity: bool = False, bibtex: bool = False, key_label: str = KEY_LABEL) -> DataFrame:
    """One row with all blocks in order as ``text``; a sentence where there are none."""
    rows = F.array_sort(F.collect_list(F.struct("position", "block")))
    joined = F.array_join(F.transform(rows, lambda r: r["block"]), "\n")
    return blocks(found, similarity, bibtex, key_label).agg(F.when(F.count("*") > 0, joined).otherwise(NOTHING).alias("text"))


def pairs(row: DataFrame) -> DataFrame:
    """Each row as ``name: value`` lines, nulls as ``None``."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in row.columns]
    return row.select(F.concat_ws("\n", *lines).alias("text"))
