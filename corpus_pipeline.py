"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes all rows of the one before, with whatever columns they have, and has a defined result for nulls, empty and
very long texts, repeated rows and empty tables, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revpanel.llm.common import shared_folder
from revpanel.llm.decontaminate import clean_documents
from revpanel.llm.mixing import repeat_rows
from revpanel.llm.sharding import shard_rows
from revpanel.llm.simhash import keep_one
from revpanel.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorization machine scores 0.5 or higher.

    Every row is scored by its whole text: null and empty texts get the score of a text without terms, repeated rows the
    same score. An empty table stays empty. Labels that are held out are not read.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group: five-word runs, similarity 0.8 or more.

    The smallest doc_id of a group stays, a null one only where there is no other; null and empty texts are one group;
    of repeated rows one stays. An empty table stays empty.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with any passage of the benchmark (13 words in a row, or a whole shorter item).

    Null and empty texts have none and stay, as do repeated rows without any. An empty table stays empty.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of its source asks: not at all, once or twice.

    A null source is a source; texts without words (null or empty) are not taken; repeated rows are taken
    alike. An empty table stays empty.
    """
    return repeat_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row, with all its columns, into one of 16 shards of equal numbers of rows: size, text_crc32, shard, slot.

    Equal texts stand together as far as a shard holds them; a null text has no bytes and is linked to nothing;
    repeated rows have slots of their own. An empty table stays empty.
    """
    return shard_rows(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: A learned score and a similarity search have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over the documents of ``sf_dir``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
