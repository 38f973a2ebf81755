"""The corpus pipeline: quality filter, line dedup, near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.llm import lines, packing, quality, simhash
from chirplake.llm.queries import WORD_TOKENIZER
from chirplake.llm.util import saved, table

#: SQL cannot express the classifier, the fingerprints and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``sf_dir``, accepts; their columns stay as they are.

    A null text is judged as an empty one, a null source or lang as an empty name,
    a null doc_id has no label. Rows that repeat are judged alike. Very long texts
    count whole. Without labels all texts are judged by their sites at one half,
    and kept. An empty table gives an empty table.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text. None is dropped.

    A null text becomes an empty one. A null doc_id loses no line; rows that share a
    doc_id are one document, and each loses its own lines that an earlier one has.
    Any other columns stay, whatever their names. An empty table gives an empty table.
    """
    renamed = docs.toDF(*[c if c.lower() not in ("n_lines", "n_dropped") else f"{c} " for c in docs.columns])  # these two are the operator's own
    out = lines.dedup_lines(renamed).drop("n_lines", "n_dropped").toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Null, empty and blank texts are one group. Rows that repeat a doc_id are
    documents of their own, of which one stays; a null doc_id is no repeat. Any
    other columns stay, whatever their names. An empty table gives an empty table.
    """
    return simhash.drop_near_duplicates(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in windows of 2048 tokens.

    A null or empty text is a piece of one token, its end. Rows that repeat a
    doc_id, and null ones, are packed each for itself; very long texts are cut into
    full windows. Other columns are not returned. An empty table gives an empty table.
    """
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
