"""A pipeline over `documents`: language identification, near-duplicate removal, secret redaction, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import bpe, dartminhash, langid, mixing, secret_scan
from lodegraph.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those rejected, or without a letter (null and empty texts too), go.

    Models learn from documents with text and lang whose id isn't held out; a null id is learned from. Repeated rows share
    their fate, ties between languages go to the first by name. Columns come out as they came in, whatever their names; an
    empty table gives no rows."""
    return langid.keep_identified(docs, langid.fit(docs.where(~langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id.

    Documents without words (null and empty texts too) are classes of their own. A document without doc_id stays only where
    its class has none with one. Rows that repeat doc_id and text stay or go together; rows that repeat a doc_id alone are
    judged by their own texts. Columns come out as they came in; an empty table gives no rows."""
    return dartminhash.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks of their kind.

    Null texts stay null, empty ones empty; of overlapping spans the union is replaced. Nothing else changes: not n_chars,
    nor columns of any name; repeated rows stay repeated; an empty table gives no rows."""
    return secret_scan.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic shares follow the target.

    A null source, lang or topic is a value of its own; documents without words are kept with the target's share. Rows of
    one doc_id share their draw, a null doc_id draws as 0. Columns come out as they came in; an empty table gives no
    rows."""
    return mixing.sample_mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document.

    Null and empty texts have no tokens. Every row gives one row, repeated ones too; other columns play no part; an empty
    table gives no rows."""
    return bpe.encode_columns(docs, ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_redaction", secret_redaction), ("mixture", mixture), ("encoding", encoding)]

#: Hashed signatures, trained models and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
