"""Stages of the corpus pipeline; each calls one operator and works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic, with all columns; clean, empty and null texts stay, repeated rows are judged each, an empty table gives none.

    Rows are told by their text alone, so that a null or repeated doc_id changes nothing.
    """
    from memlake.llm.toxicity import THRESHOLD, fit, scored

    model = fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row"), F.col("text").cast("string").alias("text"))
    clean = scored(whole, model).where(F.col("score") < THRESHOLD)
    return clean.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, with all columns: one of its smallest doc_id; rows with a null doc_id all stay.

    Null and empty texts are one class; rows that share a doc_id but not their text are judged each; an empty table gives none.
    """
    from memlake.llm.order_minhash import representatives

    return representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data marked out of their texts; null texts stay null, repeated rows and null doc_ids stay as they are, an empty table gives none."""
    from memlake.llm.pii import redact

    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, packed, of every row: a null text is empty and gives the end id, a null doc_id stays null, repeated rows are packed each, an empty table gives none."""
    from memlake.llm.packing import pack
    from memlake.llm.queries import vocabulary

    return pack(docs, vocabulary("byte_bpe_50k.json"))
