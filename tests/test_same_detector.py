"""Negatives of one detector: candidates are the anchors too, and events are split without a sort."""

import re

import pytest
from pyspark.sql import functions as F

from chirplake.operators import pairs, scratch
from chirplake.operators.ranks import hash_rank, rank_cuts, within_cut
from chirplake.plans import queries as core
from chirplake.sources import views as V

KIND = "same_detector_different_event"


def test_generated_methods_are_compiled(spark, sf_dir):
    """The JVM interprets methods of more than 8,000 bytes."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        for df in (V.astro_events(spark, sf_dir), V.samples(spark, sf_dir)):
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))
            assert sizes and max(map(int, sizes)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_only_events_and_numbered_candidates_are_written(spark, sf_dir, monkeypatch):
    labels = []
    for module in (pairs, core):
        monkeypatch.setattr(module, "saved", lambda df, label: labels.append(label) or scratch.saved(df, label))
    core.QUERIES["neg_same_det_diff_event"](spark, sf_dir)
    assert labels == ["events", "pool"]


@pytest.mark.parametrize("block", [2, 5, 10_000])
@pytest.mark.parametrize("detector", ["detector", "'H1'"])
def test_same_as_by_lookup(spark, sf_dir, monkeypatch, block, detector):
    """Also where an event has two rows in a key, which blocks of odd length cut apart."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    s = V.samples(spark, sf_dir).where("num < 600").withColumn("detector", F.expr(detector))
    anchors = s.where("has_chirp = 1").withColumn("slot", F.lit(0))
    want = pairs.described(pairs.pick(anchors, s, KIND), KIND).drop("a_ord", "slot")
    got = pairs.one_per_anchor(s, KIND)
    assert got.columns == want.columns
    rows = got.collect()
    assert len(rows) > 0 and sorted(rows) == sorted(want.collect())
    assert all(r["anchor_event_id"] != r["candidate_event_id"] for r in rows)


def test_cuts_are_ranks(spark):
    df = spark.range(10_000).withColumn("d", F.md5(F.col("id").cast("string")))
    cuts = rank_cuts(df, F.col("d"), F.col("id"), F.array(*[F.lit(k) for k in (0, 1, 5000, 5001)], F.col("__total")))
    ranked = hash_rank(df, F.col("d"), F.col("id")).crossJoin(cuts)
    for place, upto in enumerate((0, 1, 5000, 5001, 10_000)):
        inside = F.coalesce(within_cut(F.col("d"), F.col("id"), F.col("cuts")[place]), F.lit(False))
        assert ranked.where(inside != (F.col("rank") <= upto)).count() == 0


def test_names_of_events(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 7, 999_999, 1_000_000, 123_456_789, -5, None)], "n bigint")
    assert rows.where(V.six_digits(F.col("n")) != F.format_string("%06d", "n")).count() == 0
