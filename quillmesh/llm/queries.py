"""The registered queries of the training-data operators, thin over the operators themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, media, mixing, pages, quality, sharding, simhash, tokens, toxicity
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4, groups=6)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an ISO media container and read back."""
    found = media.text_media(table(spark, sf_dir, "documents"), keep_media=False)
    feature = F.format_string("codec=%s duration=%.6f samples=%d keyframes=%d ranges=%08x", "codec", "duration", "n_samples", "n_keyframes", "key_crc32")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, equal texts together."""
    found = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cut")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's raked weight, keep probability and whether it is kept."""
    found = mixing.weigh(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "prob")})


ORACLES["op1_mixing"] = mixing.oracle()


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item in a document."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows of fold 2 of 4 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, fold("doc_id", 4) != 2)
    found = language.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of fold 1 of 3 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    found = quality.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of each of its lines."""
    return tokens.count_lines(table(spark, sf_dir, "documents"))


@query
def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))
