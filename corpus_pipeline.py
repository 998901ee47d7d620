"""Corpus preparation in stages; each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.catalog import importable
from millrace.llm.common import documents, stored
from millrace.llm.line_rules import quality_rules
from millrace.llm.minhash_dedup import near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.queries import WORD_BPE
from millrace.llm.suffix_dedup import without_repeats


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines in more than 20 documents of their host.

    Null and empty texts fail. n_chars follows where lines went. Repeated rows share their fate, null ids are kept apart
    by text, null sources are one host; an empty table stays empty.
    """
    out = quality_rules(docs, limit_documents=20).where("kept")
    if "n_chars" in out.columns:
        shorter = F.when(F.col("kept_text") != F.col("text"), F.length("kept_text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(shorter, "n_chars"))
    return out.withColumn("text", F.col("kept_text")).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Documents without words, null texts included, are near to none and stay. All rows of an id share its fate, so
    repeated rows and rows without an id, which are one node, stay or go together; an empty table stays empty.
    """
    importable(spark)
    found = near_duplicates(docs)
    dropped = found.where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier; n_chars follows.

    Null texts are empty afterwards. A null id comes last; rows that repeat an id are told apart by text, and equal rows
    are one document with equal results, each still a row. An empty table stays empty.
    """
    importable(spark)
    out = without_repeats(docs, window=100)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2,048 tokens.

    Documents without tokens, null texts included, have one row without a bin. Null ids and repeated rows are documents
    of their own; of equal lengths the smaller id is placed first. An empty table gives no rows.
    """
    importable(spark)
    return pack_documents(docs, WORD_BPE, capacity=2048)


STAGES = [
    ("quality rules", rules_stage),
    ("near duplicates", near_stage),
    ("repeated strings", repeats_stage),
    ("packing", packing_stage),
]
# SQL cannot express suffix sorting over whole texts or best-fit packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs)
    return docs
