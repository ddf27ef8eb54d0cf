"""The corpus pipeline: toxic texts out, near copies out, benchmark leaks out, mixed to weights, sharded.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import decontamination, mixing, sharding, simhash, toxicity
from quillmesh.llm.common import Scratch, fold, table, tidy

#: Rounds of moves in sharding; most of what is gained is gained in the first.
MOVES = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below one half; the labels of fold 0 of 5 stay unseen, as in the query.

    Null and empty texts are scored like texts without hits; repeated rows stay or go together; columns of any name
    come along; an empty table gives an empty one, and without labels a fixed lexicon decides."""
    tidy(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id.

    Five-word shingles, 6 of 64 bits. Null, empty and blank texts are one group; of rows that are equal in id and text
    one stays; rows without an id all stay; columns of any name come along; an empty table gives an empty one."""
    tidy(spark)
    return simhash.distinct(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark.

    Null and empty texts hold none; repeated rows stay or go together; columns of any name come along; an empty table
    on either side does no harm."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample calibrated to the tempered shares of source, language and topic.

    A null source or language is a value of its own; texts without words weigh nothing and are kept by the rate; rows
    with equal ids stay or go together; columns of any name come along; an empty table gives an empty one."""
    tidy(spark)
    return mixing.sample(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot, one row each: null ids and texts and repeated rows too.

    No two ids have equal texts after near_dedup, so documents are linked by the long lines that they still share."""
    tidy(spark)
    scratch = Scratch(spark, "lines")
    links = scratch.table(sharding.shared_lines(docs, scratch))
    found = sharding.shard(docs, 40, links=links, moves=MOVES)
    scratch.release()
    tidy(spark)
    return found


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: SQL cannot express the edit automaton, fingerprints, alignment and propagation of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``. One stage's table at a time lies in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.release(docs)
    found = STAGES[-1][1](spark, docs, sf_dir)
    scratch.release()
    return found
