"""A corpus from raw documents to token digests: each stage takes what the one before kept, as Parquet in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, lines, mixing, quality, queries, simhash
from tidemark.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or the ratio of trusted to raw text go; null and empty texts fail, repeated rows are judged alike."""
    return quality.keep_good(docs, queries.trusted_ids(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a source share go from the texts; n_chars follows. No row goes; null sources are one source, null texts stay null."""
    return lines.clean_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id (nulls last); repeated rows become one."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (up to three times) or left out so that the sources' words come near their targets; null sources are one source."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens: their number, and digests of the ids and of the text decoded from them; null texts have none."""
    return bpe.round_trip(docs, f"{queries.TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("source_mix", source_mix), ("encode", encode)]

#: SQL has neither the hashes of the quality rules and fingerprints nor the token merges; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, one row for each copy that the mix takes.

    Columns beyond those of documents are carried through to the mix, whatever their names. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
