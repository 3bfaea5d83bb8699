"""A corpus from raw documents to packed token windows, each stage by one operator of mortise.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortise.llm.common import ensure_checkpoint_dir, table
from mortise.llm.line_dedup import CHARS, dedup_lines
from mortise.llm.packing import pack
from mortise.llm.queries import BYTES
from mortise.llm.simhash import one_of_each
from mortise.llm.toxicity import fit, keep_ordinary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance model, fitted on the labelled ones among them, does not call toxic."""
    return keep_ordinary(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one; n_chars follows the text."""
    kept = dedup_lines(docs, chars=CHARS)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in docs.columns else kept


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the least doc_id."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in windows of 2048 tokens."""
    return pack(docs, BYTES)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("packing", packing)]

#: The stages train, hash and tokenise; SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage keeps is written to the shared checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
