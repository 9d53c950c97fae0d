"""The corpus pipeline: language ID, toxicity, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's documents. All
but the last return the columns of documents, whatever else these have beside doc_id, text, lang and source.

Defined results of every stage: an empty table gives an empty result; very long texts are read whole; rows with null fields
take part as each stage says; extra columns, whatever their names, pass through all stages but the last, which ignores them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import langid, mixing, packing, simhash, toxicity
from quernstone.llm._common import shared_dir, ship, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no known language is found go: null and empty texts, those without a letter, and foreign ones. Repeated rows share
    their fate; a null tag makes no difference to a text."""
    ship(spark)
    return langid.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the labels that the model is fitted on are those of ``sf_dir``. Null and empty texts stay; repeated rows share
    their fate; without labels of both kinds all stay."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id (null last); of repeated rows one does. Rows with a
    null text stay; texts without a word go only where they are equal."""
    ship(spark)
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out for the sources to have equal weights, within the epochs allowed. A null source is one of its
    own; rows of one id have one fate; documents of a source without a character are left out."""
    ship(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of documents in sequences of fixed length. Null and empty texts aren't packed; repeated rows are, each time."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("toxicity", drop_toxic), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Fitted models and graph components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    at = os.path.join(shared_dir(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:
            drop_folder(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")  # what came before is written and read no more
    return docs
