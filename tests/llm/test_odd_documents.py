"""Every stage of the pipeline, and operators that need it, on nulls, repeats, empty tables and clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from chirplake.llm import bbpe, html_density, packing, queries, simhash, word_lm
from test_llm_operators import ODD

CLASHING = ["f0", "node", "row", "row_key", "component", "bucket", "doc", "hashes", "n_shingles", "n_lines", "n_dropped", "lines", "gone", "positions", "text_hash", "number", "p", "host", "logit", "s", "start", "length", "sequence_id", "a.b"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, None if k % 3 else "src", None if k % 2 else "en", None if t is None else len(t)) for k, (i, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHING)])


@pytest.mark.parametrize("place", range(4))
def test_stages_on_odd_rows(spark, sf_dir, documents, place):
    name, stage = corpus_pipeline.STAGES[place]
    got = stage(spark, documents, sf_dir)
    rows = got.collect()
    if place < 3:
        assert got.columns == documents.columns and all(r["a.b"] == CLASHING.index("a.b") and r["n_lines"] == CLASHING.index("n_lines") for r in rows)
        assert {r["doc_id"] for r in rows} <= {i for i, _ in ODD}
    if name == "line_dedup":
        assert len(rows) == len(ODD) and all(r["n_chars"] == len(r["text"]) for r in rows)
    if name == "simhash_near_dedup":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 10] and sum(r["doc_id"] is None for r in rows) == 1
    if name == "packing":
        assert sorted({r["doc_id"] for r in rows if r["doc_id"] is not None}) == list(range(1, 11)) and sum(r["length"] for r in rows if r["doc_id"] in (1, 2, 3)) == 3
    assert stage(spark, documents.limit(0), sf_dir).count() == 0


def test_word_models_without_documents(spark, documents):
    none = documents.select("doc_id", "text", F.lit(True).alias("is_target"))
    assert word_lm.word_cross_entropy_difference(none.limit(0)).count() == 0
    scored = word_lm.word_cross_entropy_difference(none).collect()
    assert len(scored) == len(ODD) and all(abs(r["score"]) < 1e-9 for r in scored)  # target and background are the same


def test_other_operators_without_rows(spark, documents):
    none = documents.limit(0)
    assert bbpe.round_trip(none, queries.BYTE_RANKS).count() == packing.pack_documents(none, queries.WORD_TOKENIZER).count() == simhash.simhash_groups(none).count() == 0
    pages = documents.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), F.lit(1).alias("n_chars"))
    assert html_density.extract_pages(pages.limit(0)).count() == 0 and html_density.extract_pages(pages).count() == len(ODD)
