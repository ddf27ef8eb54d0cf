"""Publication and venue search responses in JSON.

A response is ``result.hits`` with ``@total`` and ``hit``, which is a list, a lone object or missing; so are a
hit's authors, whose members are objects with a ``text`` or bare strings. Everything is read as variants.
A year that is no number becomes null and its row stays; a response that is no JSON goes to ``errors``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.keys import record_key
from ..schema import COLUMNS, VENUE


def listed(v: Column, path: str) -> Column:
    """The variants at a path: of a list, of a lone value, or none."""
    many = F.try_variant_get(v, path, "array<variant>")
    one = F.try_variant_get(v, path, "variant")
    none = F.array().cast("array<variant>")
    return F.coalesce(many, F.when(one.isNull() | F.is_variant_null(one), none).otherwise(F.array(one)))


def field(v: Column, path: str) -> Column:
    """Text at a path, of a list its first; null where it is missing."""
    return F.coalesce(F.try_variant_get(v, f"{path}[0]", "string"), F.try_variant_get(v, path, "string"))


def parsed(responses: DataFrame, json_col: str) -> DataFrame:
    return responses.withColumn("_v", F.try_parse_json(F.col(json_col)))


def hits(responses: DataFrame, json_col: str) -> DataFrame:
    """One row per hit of each response, ``_hit``, with its place ``_at``; the response's columns stay. Where
    the total is 0 there are none."""
    total = F.coalesce(F.try_variant_get("_v", "$.result.hits['@total']", "string").try_cast("int"), F.lit(0))
    rows = parsed(responses, json_col).where(total > 0)
    return rows.select("*", F.posexplode(listed(F.col("_v"), "$.result.hits.hit")).alias("_at", "_hit")).drop("_v")


def publications(responses: DataFrame, json_col: str = "json", config: EngineConfig | None = None) -> DataFrame:
    """The publications of all responses, in the fixed schema after the responses' own columns and ``hit_no``."""
    config = config or EngineConfig()
    hit, own = F.col("_hit"), [c for c in responses.columns if c != json_col]

    def info(name: str) -> Column:
        return F.coalesce(field(hit, f"$.info.{name}"), F.lit(""))

    def name_of(a: Column) -> Column:
        return F.coalesce(F.try_variant_get(a, "$.text", "string"), F.when(F.schema_of_variant(a).startswith("OBJECT"), F.lit("")), F.try_variant_get(a, "$", "string"), F.lit(""))

    authors = F.transform(listed(hit, "$.info.authors.author"), name_of)
    year = F.col("_year").try_cast("int")
    rows = hits(responses, json_col).withColumn("_year", field(hit, "$.info.year"))
    key = record_key(field(hit, "$.info.url"), F.try_variant_get(hit, "$.key", "string"), F.try_variant_get(hit, "$['@id']", "string"), config)
    return rows.select(
        *own,
        F.col("_at").alias("hit_no"),
        key.alias("rec_key"),
        info("title").alias("title"),
        authors.alias("authors"),
        info("venue").alias("venue"),
        year.alias("year"),
        *[info(c).alias(c) for c in COLUMNS[5:]],
    )


def venues(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """The venues of all responses, after the responses' own columns and ``hit_no``."""
    own = [c for c in responses.columns if c != json_col]
    return hits(responses, json_col).select(*own, F.col("_at").alias("hit_no"), *[F.coalesce(field(F.col("_hit"), f"$.info.{c}"), F.lit("")).alias(c) for c in VENUE.names])


def errors(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """Responses that are no JSON or have no hits object: their columns and an ``error``."""
    found = parsed(responses, json_col)
    why = F.when(F.col("_v").isNull(), "not JSON").when(F.try_variant_get("_v", "$.result.hits", "variant").isNull(), "no result.hits")
    return found.withColumn("error", why).where("error IS NOT NULL").drop("_v")
