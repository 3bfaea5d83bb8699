"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mortise.llm.common import table
from mortise.llm.gif import media_features
from mortise.llm.hilbert import shards
from mortise.llm.line_dedup import CHARS, dedup_lines
from mortise.llm.minhash import edit_fingerprints
from mortise.llm.packing import pack
from mortise.llm.piece_fst import round_trip
from mortise.llm.quotes import link_quotations
from mortise.llm.simhash import near_duplicates
from mortise.llm.token_counts import count_tokens
from mortise.llm.toxicity import fit, score

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op4_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), PIECES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), chars=CHARS, counts=True)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_counts": op1_token_counts, "op2_toxicity": op2_toxicity, "op3_minhash": op3_minhash, "op4_piece_fst": op4_piece_fst, "op5_line_dedup": op5_line_dedup, "op6_gif": op6_gif, "op7_quotes": op7_quotes, "op8_hilbert": op8_hilbert, "op9_simhash": op9_simhash, "op10_packing": op10_packing}


def oracle_sql() -> dict[str, str]:
    return {}
