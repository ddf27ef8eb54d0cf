"""Publications and statistics of authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import best_ratio_udf, may_reach
from .search import candidates, numbered, order

TOP = 5


def best_ratios(pubs: DataFrame, name: str, threshold: float) -> DataFrame:
    """Publications of which an author's name reaches the threshold, with ``best_ratio``. Names that cannot reach it
    are ruled out natively; a publication without any left never meets Python. At a threshold of 0 or less
    publications without authors stay, with 0."""
    query = name.lower()
    low = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.lower(F.coalesce(a, F.lit(""))))
    if threshold > 0:
        low = F.filter(low, lambda a: may_reach(query, a, threshold))
        pubs = pubs.where(F.size(low) > 0)
    return pubs.withColumn("best_ratio", best_ratio_udf(query, threshold)(low)).where(F.col("best_ratio") >= threshold)


def author_publications(pubs: DataFrame, name: str, threshold: float, max_results: int = 20, compat: bool = False) -> DataFrame:
    """The first ``max_results`` publications of authors with a name like this, with ``position``."""
    pool = candidates(pubs, f"author:{name}", 2 * max_results).drop("arm_no") if compat else pubs
    return numbered(best_ratios(pool, name, threshold), order(), max_results)


def frequencies(found: DataFrame, column: str | Column, out: str) -> DataFrame:
    """Values by falling frequency, ties by first position: ``out``, ``n``, ``first_position``."""
    value = F.col(column) if isinstance(column, str) else column
    return found.groupBy(value.alias(out)).agg(F.count("*").alias("n"), F.min("position").alias("first_position"))


def top(found: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The ``k`` commonest values of a column; null is a value."""
    return frequencies(found, column, column).orderBy(F.desc("n"), "first_position").limit(k)


def types(found: DataFrame) -> DataFrame:
    """All types with their counts; a null type counts as the empty one."""
    return frequencies(found, F.coalesce(F.col("type"), F.lit("")), "type")


def author_answer(found: DataFrame, name: str) -> DataFrame:
    """One row: ``name``, ``publication_count``, the ordered ``publications`` and ``stats``.

    The limited list is evaluated once: each of its rows gives one row for itself and one for each statistic."""
    columns = [c for c in found.columns if c != "position"]
    none, kind = F.lit(None), F.col("kind")

    def part(of: str, text: Column, number: Column, own: Column) -> Column:
        return F.struct(F.lit(of).alias("kind"), text.cast("string").alias("text"), number.cast("int").alias("number"), own.alias("pub"))

    pub = F.struct("position", *columns)
    four = F.array(part("publication", none, F.col("position"), pub), part("venue", F.col("venue"), none, F.when(F.lit(False), pub)), part("year", none, F.col("year"), F.when(F.lit(False), pub)), part("type", F.coalesce("type", F.lit("")), none, F.when(F.lit(False), pub)))
    rows = found.select("position", F.explode(four).alias("x")).select("position", "x.*")
    counts = rows.groupBy("kind", "text", "number").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.first("pub").alias("pub"))

    def top_of(of: str, value: str) -> Column:
        each = F.sort_array(F.collect_list(F.when(kind == of, F.struct((-F.col("n")).alias("k"), "first", F.col(value).alias("value"), F.col("n").alias("count")))))
        return F.slice(F.transform(each, lambda r: F.struct(r["value"].alias("value"), r["count"].alias("count"))), 1, TOP)

    return counts.agg(
        F.lit(name).alias("name"),
        F.count_if(kind == "publication").alias("publication_count"),
        F.array_sort(F.collect_list("pub")).alias("publications"),
        F.struct(top_of("venue", "text").alias("venues"), top_of("year", "number").alias("years"), F.map_from_entries(F.collect_list(F.when(kind == "type", F.struct("text", "n")))).alias("types")).alias("stats"),
    )


def all_authors_top_venues(pubs: DataFrame, k: int = TOP) -> DataFrame:
    """For every author the ``k`` commonest venues: ``author``, ``venue``, ``n``, ``place``. Counts are
    pre-aggregated, so an author with very many publications costs few rows."""
    slots = pubs.select(F.explode(F.array_distinct("authors")).alias("author"), "venue", F.struct((-F.coalesce("year", F.lit(-9999))).alias("y"), "rec_key").alias("at"))
    by = slots.groupBy("author", "venue").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy("author").orderBy(F.desc("n"), "at")
    return by.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("author", "venue", "n", "place")
