"""Publications, venues, BibTeX entries and session logs over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import BIBTEX, COLUMNS, PUBLICATION, SESSION_LOG, VENUE

#: The host of the derived records.
HOST = "https://bib.example"


def read(spark: SparkSession, path: str, kind: str = "publications", form: str = "parquet") -> DataFrame:
    """A stored table in its fixed schema; nothing is inferred."""
    schema = {"publications": PUBLICATION, "venues": VENUE, "bibtex": BIBTEX, "log": SESSION_LOG}[kind]
    return spark.read.format(form).schema(schema).load(path)


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publication view of a data folder: one per document, its title the whole first line of the text, with the
    parts of its order as authors.

    The order's lines are joined to the documents first, so that only lines in use are grouped."""
    docs = stored(spark, sf_dir, "documents")
    ids = docs.select(F.col("doc_id").alias("l_orderkey"))
    lines = stored(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(ids, "l_orderkey", "left_semi")
    named = lines.join(stored(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    slots = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name")))
    authors = named.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(slots, lambda s: s["p_name"]).alias("authors"))
    years = stored(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("_year"))
    key = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    # titles are taken before the joins, so that texts are not shuffled
    slim = docs.select("doc_id", key.alias("rec_key"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.col("source").alias("venue"), F.col("lang").alias("type"))
    rows = slim.join(authors, "doc_id", "left").join(years, "doc_id", "left")
    rows = rows.withColumns(
        {
            "authors": F.coalesce("authors", F.array().cast("array<string>")),
            "year": F.when(F.col("doc_id") % 50 != 7, F.col("_year")).cast("int"),
            "doi": F.lit(""),
            "ee": F.lit(""),
            "url": F.concat(F.lit(f"{HOST}/rec/"), "rec_key"),
        }
    )
    return rows.select("doc_id", *COLUMNS)


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A venue table of a data folder: its nations, with their regions as types."""
    nations = stored(spark, sf_dir, "nation").join(stored(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return nations.select(F.col("n_name").alias("venue"), F.substring("n_name", 1, 3).alias("acronym"), F.col("r_name").alias("type"), F.concat(F.lit(f"{HOST}/db/"), F.lower("n_name")).alias("url"))


def entry() -> Column:
    """A publication as a generated BibTeX entry."""
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit("  year = {"), F.col("year").cast("string"), F.lit("},\n"))).otherwise("")
    return F.concat(F.lit("@article{REC:"), F.col("rec_key"), F.lit(",\n  title = {"), F.col("title"), F.lit("},\n"), year, F.lit("}"))


def bibtex(pubs: DataFrame) -> DataFrame:
    """A generated entry for each publication."""
    return pubs.select("rec_key", entry().alias("bibtex"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session log of a data folder: a user's clicks and views add an entry, purchases export."""
    events = stored(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    key = F.get_json_object("props", "$.k")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    action = F.when(F.col("event_type") == "purchase", "export").otherwise("add")
    return events.select(F.col("user_id").alias("session_id"), seq.alias("seq"), "event_id", action.alias("action"), key.alias("citation_key"), F.concat(F.lit("@misc{"), key, F.lit(", note = {"), F.col("event_id").cast("string"), F.lit("}}")).alias("bibtex"))
