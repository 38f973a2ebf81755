"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.llm import bbpe, embed_dedup, html_density, lines, merkle, mixing, packing, pjpeg, quality, simhash, warc, word_lm
from chirplake.llm.util import BROADCAST_ROWS, join_checked, saved, table

#: Where the public vocabularies are.
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: all documents labelled good. Background: all documents."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    marked = join_checked(docs.select("doc_id", "text"), good.withColumn("is_target", F.lit(True)), ["doc_id"], "left")
    if good.count() > BROADCAST_ROWS:  # rows of a shuffle join may change their order in a task that runs again, and the models number them
        marked = saved(marked, "marked")
    out = word_lm.word_cross_entropy_difference(marked)
    return out.select("doc_id", "n_tokens", F.round("score", 6).alias("score"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pjpeg.carried_digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(table(spark, sf_dir, "pages"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_warc_derivatives, op2_quality_classifier, op3_lm_cross_entropy, op4_simhash, op5_byte_bpe,
            op6_line_dedup, op7_progressive_jpeg, op8_packing, op9_embedding_dedup, op10_html_text, op11_source_mix, op12_merkle_manifest,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": lines.LINES_SQL, "op9_embedding_dedup": embed_dedup.VECTORS_SQL, "op11_source_mix": mixing.MIX_SQL, "op12_merkle_manifest": merkle.MANIFEST_SQL}
