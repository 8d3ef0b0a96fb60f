"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.  Intermediate tables go to the folder that the session names in spark.checkpoint.dir;
each is removed once the next one is written, and the last is the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import dartminhash, decontam, knn, packing, spans
from tidemark.llm.common import doc_remainder, removed, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote finds good; learnt from the labelled rows of the source table."""
    model = knn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(doc_remainder(3) != 1))
    return knn.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dartminhash.keep_first(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated sentence spans; n_chars follows the text."""
    return spans.remove(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("decontamination", decontamination), ("packing", packed)]

#: Neighbour votes, signatures and best-fit packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    top = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        to = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(to), to
    return docs
