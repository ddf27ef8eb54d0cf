"""A citation collection as an append-only log: keyed upserts, and exports that clear it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

ERROR = "% Error"


def epochs(log: DataFrame) -> DataFrame:
    """The adds with their ``epoch``, the number of exports before them in the session. Adds of blank entries
    and of error texts, whatever white space is about them, are left out."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    exports = F.coalesce(F.sum((F.col("action") == "export").cast("long")).over(before), F.lit(0))
    text = strip(F.col("bibtex"))
    good = text.isNull() | ((text != "") & ~F.startswith(text, F.lit(ERROR)))
    return log.withColumn("epoch", exports).where((F.col("action") == "add") & good)


def latest(log: DataFrame) -> DataFrame:
    """The entries of each session and epoch: the last one added under a key, at the place of the first
    (``position`` from 1), and how often the key was ``added``."""
    adds = epochs(log)
    per_key = adds.groupBy("session_id", "epoch", "citation_key").agg(F.max_by("bibtex", "seq").alias("bibtex"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("added"))
    w = Window.partitionBy("session_id", "epoch").orderBy("first_seq")
    return per_key.withColumn("position", F.row_number().over(w))


def additions(log: DataFrame) -> DataFrame:
    """Every add with whether it ``overwrote`` an entry and the ``size`` of the collection after it."""
    adds = epochs(log)
    of_key = Window.partitionBy("session_id", "epoch", "citation_key").orderBy("seq")
    adds = adds.withColumn("overwrote", F.row_number().over(of_key) > 1)
    upto = Window.partitionBy("session_id", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return adds.withColumn("size", F.sum((~F.col("overwrote")).cast("long")).over(upto))


def current(log: DataFrame) -> DataFrame:
    """The entries that are in each session's collection now, since its last export."""
    exports = log.groupBy("session_id").agg(F.sum((F.col("action") == "export").cast("long")).alias("now"))
    held = latest(log).join(exports, "session_id")
    return held.where(F.col("epoch") == F.col("now")).drop("now")


def export(entries: DataFrame, path: str) -> tuple[str, int]:
    """Write one session's entries to a ``.bib`` file in order of ``position``; the path and their number.

    Entries stream to the driver a partition at a time. An empty collection is refused before the path is
    looked at; a failed write changes nothing."""
    rows = entries.orderBy("position").select("bibtex").toLocalIterator()
    first = next(rows, None)
    if first is None:
        raise ValueError("the collection is empty")
    if not path:
        raise ValueError("missing required argument: path")
    to = Path(path if path.endswith(".bib") else f"{path}.bib")
    to.parent.mkdir(parents=True, exist_ok=True)
    part, n = to.with_name(to.name + ".part"), 0
    with part.open("w", encoding="utf-8") as f:
        while first is not None:
            f.write(f"{first.bibtex}\n\n")
            first, n = next(rows, None), n + 1
    os.replace(part, to)
    return str(to), n


def write_entries(entries: DataFrame, path: str) -> None:
    """Bulk export of many sessions as text files, a folder for each session, in order within a file."""
    rows = entries.repartition("session_id").sortWithinPartitions("session_id", "position")
    rows.select("session_id", F.concat("bibtex", F.lit("\n")).alias("value")).write.partitionBy("session_id").text(path)
