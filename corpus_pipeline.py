"""A corpus from raw documents: ``STAGES`` in order, each on the rows that the one before kept.

``run(spark, sf_dir)`` applies them to the table documents. Every stage takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as parquet and
read again as the next one's input. All but the last return the columns of
documents; the last adds the shard of each row.
"""

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm.decontaminate import decontaminate
from lacuna.llm.langid import keep_identified
from lacuna.llm.mixing import mix
from lacuna.llm.order_minhash import deduplicate
from lacuna.llm.sharding import shard_documents
from lacuna.llm.text import table
from lacuna.session import write_and_reread

SHARDS = 40

#: SQL can express neither the trained models nor the hashed and iterative stages.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in no language that was learned."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that token shares of the domains meet the targets."""
    return mix(docs, table(spark, sf_dir, "labels"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds virtual_slot and shard; shards hold nearly equal bytes."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_reread(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
