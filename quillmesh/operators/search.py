"""Boolean search with post-filters, ordered union and limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import holds
from ..plans.parser import is_or, matches, parse



def order() -> list[Column]:
    """The total order of results: newest first, unknown years last."""
    return [F.desc_nulls_last("year"), F.asc("rec_key")]


def in_years(year_from: int | None, year_to: int | None) -> Column:
    """Inclusive bounds, either optional; an unknown year passes."""
    known = F.lit(True)
    if year_from is not None:
        known = known & (F.col("year") >= year_from)
    if year_to is not None:
        known = known & (F.col("year") <= year_to)
    return F.col("year").isNull() | known


def filtered(pubs: DataFrame, year_from: int | None = None, year_to: int | None = None, venue: str | None = None) -> DataFrame:
    """Publications of the years and with the text in their venue; no bound or an empty text keeps all."""
    if year_from is not None or year_to is not None:
        pubs = pubs.where(in_years(year_from, year_to))
    return pubs.where(holds(F.coalesce("venue", F.lit("")), venue)) if venue else pubs


def candidates(pubs: DataFrame, query: str, cap: int | None = None) -> DataFrame:
    """Matching publications with ``arm_no``: of an OR the first of each (title, year) by arm, then order.

    Without a cap the corpus is read once, and a row belongs to the first arm it matches. With one, each arm
    gives its first ``cap`` rows only, before anything else is filtered."""
    arms = [matches(terms) for terms in parse(query)]
    if not arms:
        return pubs.where(F.lit(False)).withColumn("arm_no", F.lit(0))
    if cap is None:
        arm = F.coalesce(*[F.when(m, F.lit(k)) for k, m in enumerate(arms)])
        found = pubs.where(reduce(lambda a, b: a | b, arms)).withColumn("arm_no", arm)
    else:
        found = reduce(DataFrame.unionByName, [pubs.where(m).orderBy(*order()).limit(cap).withColumn("arm_no", F.lit(k)) for k, m in enumerate(arms)])
    return first_of(found, ["title", "year"], [F.col("arm_no"), *order()]) if is_or(query) else found


def first_of(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key in a total order; a null key is a key like any other."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, by: list[Column], limit: int) -> DataFrame:
    """The first rows in order with their ``position`` from 1; the window sees the limited rows only."""
    top = rows.orderBy(*by).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))


def search(pubs: DataFrame, query: str, max_results: int = 10, year_from: int | None = None, year_to: int | None = None, venue: str | None = None, compat: bool = False) -> DataFrame:
    """The first ``max_results`` matches in order, with their ``position``."""
    found = filtered(candidates(pubs, query, max_results if compat else None), year_from, year_to, venue)
    return numbered(found, [F.col("arm_no"), *order()], max_results).drop("arm_no")
