"""The pipeline's stages, each on what its predecessor kept."""

from itertools import combinations

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chirplake.llm import queries
from chirplake.llm.util import saved, table
from test_llm_operators import brute_lines


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "packing"]
    good, lined, single, packed = (None,) * 4
    stages = dict(corpus_pipeline.STAGES)
    good = saved(stages["quality_classifier"](spark, docs, sf_dir), "t1")
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.99 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if not q) <= 0.05 * sum(1 - q for q in labels.values())
    lined = saved(stages["line_dedup"](spark, good, sf_dir), "t2")
    assert lined.columns == docs.columns and lined.count() == good.count()
    want = brute_lines([(r["doc_id"], r["text"]) for r in good.collect()])
    got = {r["doc_id"]: r["h"] for r in lined.select("doc_id", F.sha2("text", 256).alias("h")).collect()}
    assert got == {i: w[2] for i, w in want.items()}
    single = saved(stages["simhash_near_dedup"](spark, lined, sf_dir), "t3")
    assert single.columns == docs.columns
    before = {r["doc_id"]: shingles(r["text"]) for r in lined.collect()}
    after = {r["doc_id"] for r in single.select("doc_id").collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sure = [(a, b) for a, b in combinations(sorted(before), 2) if min(len(before[a]), len(before[b])) >= 0.85 * max(len(before[a]), len(before[b])) and jaccard(before[a], before[b]) >= 0.9]
    assert sure and sum(a in after and b in after for a, b in sure) <= 0.02 * len(sure)
    lost = set(before) - after
    assert all(any(jaccard(before[i], before[k]) >= 0.55 for k in before if k != i) for i in lost)
    packed = stages["packing"](spark, single, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == after


def test_registered(spark, sf_dir):
    names = set(entry.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
