"""Fuzzy title search, for one query and for a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.similarity import Queries, contained_score, may_reach, ratio_udf
from .search import candidates, filtered, first_of, numbered, order


def scored(pubs: DataFrame, title: str, threshold: float) -> DataFrame:
    """Publications whose title reaches the threshold, with their ``similarity``. Titles that the bounds rule
    out never reach the UDF, and those that hold the query get no text to work on."""
    query, low = title.lower(), F.lower(F.col("title"))
    held = contained_score(query, low)
    near = pubs.where(F.when(held.isNotNull(), held >= threshold).otherwise(may_reach(query, low, threshold)))
    near = near.withColumn("_ratio", ratio_udf(query, threshold)(F.when(held.isNull(), low)))
    return near.withColumn("similarity", F.coalesce(held, "_ratio")).drop("_ratio").where(F.col("similarity") >= threshold)


def fuzzy_title(pubs: DataFrame, title: str, threshold: float, max_results: int = 10, year_from: int | None = None, year_to: int | None = None, venue: str | None = None, compat: bool = False) -> DataFrame:
    """The ``max_results`` titles most like the query, each title once, with ``similarity`` and ``position``.

    All titles are looked at; ``compat`` looks at the first 3 * max_results of a search in titles, then the
    first 2 * max_results of a search anywhere, with the filters after these caps."""
    if compat:
        # the title as a whole is the query: prefix and title go to the search as one string
        one = filtered(candidates(pubs, f"title:{title}", 3 * max_results), year_from, year_to, venue)
        two = filtered(candidates(pubs, title, 2 * max_results), year_from, year_to, venue)
        pool = one.withColumn("strategy", F.lit(1)).unionByName(two.withColumn("strategy", F.lit(2)))
    else:
        pool = filtered(pubs, year_from, year_to, venue).withColumn("strategy", F.lit(1)).withColumn("arm_no", F.lit(0))
    by = [F.col("strategy"), F.col("arm_no"), *order()]
    if compat:
        found = scored(first_of(pool, ["title"], by), title, threshold)
    else:  # a title's score is its own, so the bounds go first and few rows are left to tell apart
        query, low = title.lower(), F.lower(F.col("title"))
        held = contained_score(query, low)
        pool = pool.where(F.when(held.isNotNull(), held >= threshold).otherwise(may_reach(query, low, threshold)))
        found = scored(first_of(pool, ["title"], by), title, threshold)
    return numbered(found, [F.desc("similarity"), *by], max_results).drop("strategy", "arm_no")


#: Characters of queries in a block, about.
BLOCK_CHARS = 1_000_000


def fuzzy_titles(pubs: DataFrame, queries: DataFrame, threshold: float, max_results: int = 10, id_col: str = "query_id", text_col: str = "title", block: int = BLOCK_CHARS) -> DataFrame:
    """For each row of a table of queries its most similar titles: ``query_id``, ``rec_key``, ``title``, ``similarity``
    and ``position``. Queries without an id or a text are left out.

    The plan does not grow with the queries: they go to the executors in blocks of about ``block`` characters, a pass
    over the distinct titles for each, and only pairs that reach the threshold come out."""
    titles = first_of(pubs.select("title", "rec_key", "year"), ["title"], order())
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).cast("string").alias("q")).where("query_id IS NOT NULL AND q IS NOT NULL")
    kind = asked.schema["query_id"].dataType
    blocks = max(1, -(-(asked.agg(F.sum(F.length("q"))).first()[0] or 0) // block))
    schema = f"query_id {kind.simpleString()}, title string, rec_key string, year int, similarity double"
    near = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)) == k).collect()
        shared = pubs.sparkSession.sparkContext.broadcast([(r.query_id, r.q) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Queries(shared.value, threshold)
            for batch in batches:
                found = [(at, k, score) for at, title in enumerate(batch.column(0).to_pylist()) for k, score in own.score(title or "")]
                rows = batch.take(pa.array([at for at, _, _ in found], pa.int64()))
                ids, scores = pa.array([own.ids[k] for _, k, _ in found], to_arrow_type(kind)), pa.array([s for _, _, s in found], pa.float64())
                yield pa.RecordBatch.from_arrays([ids, *rows.columns, scores], names=["query_id", *batch.schema.names, "similarity"])

        part = titles.select("title", "rec_key", F.col("year").cast("int")).mapInArrow(run, schema)
        near = part if near is None else near.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *order())
    return near.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_results).select("query_id", "rec_key", "title", "similarity", "position")
