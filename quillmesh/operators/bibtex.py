"""BibTeX lookup and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import candidate_keys, rekey, rekey_from
from ..functions.text import blank


def lookup(rows: DataFrame, entries: DataFrame, key: str | Column = "rec_key", out: str = "raw") -> DataFrame:
    """Adds the first entry that is not blank under the key's candidates, in order; null where there is none.

    The entries are first reduced to the keys that are asked for. Where these come from a limited result the
    planner sends them to the entries' scan, so that a few lookups shuffle a few entries."""
    key = F.col(key) if isinstance(key, str) else key
    rows = rows.withColumn("_keys", candidate_keys(key))
    asked = rows.select(F.explode("_keys").alias("rec_key")).distinct()
    found = entries.where(~blank(F.col("bibtex"))).join(asked, "rec_key", "left_semi").groupBy("rec_key").agg(F.min("bibtex").alias("bibtex"))
    for k in (0, 1):
        part = found.select(F.col("rec_key").alias(f"_k{k}"), F.col("bibtex").alias(f"_b{k}"))
        rows = rows.join(part, F.get("_keys", F.lit(k)) == F.col(f"_k{k}"), "left")
    return rows.withColumn(out, F.coalesce("_b0", "_b1")).drop("_keys", "_k0", "_k1", "_b0", "_b1")


def with_bibtex(found: DataFrame, entries: DataFrame, missing: str | None = "") -> DataFrame:
    """Adds ``bibtex`` with a generated citation key; ``missing`` where there is no entry. Call it on limited
    rows: the join then meets a few keys only."""
    rows = lookup(found, entries)
    return rows.withColumn("bibtex", F.coalesce(rekey_from(F.col("raw"), F.col("rec_key")), F.lit(missing).cast("string"))).drop("raw")


def with_own_key(adds: DataFrame, entries: DataFrame, key: str, citation_key: str) -> DataFrame:
    """Adds ``bibtex`` with the citation key that the row gives; null where there is no entry."""
    rows = lookup(adds, entries, key)
    return rows.withColumn("bibtex", rekey(F.col("raw"), F.col(citation_key))).drop("raw")
