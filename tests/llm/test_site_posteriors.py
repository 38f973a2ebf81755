"""Posteriors of hosts and paths against a computation row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.llm import quality


def strength(groups, mean):
    """Method of moments over (sum, number) of each group."""
    if len(groups) < 2:
        return 10.0
    n = sum(k for _, k in groups)
    ss = sum(k * (s / k - mean) ** 2 for s, k in groups)
    size = n - sum(k * k for _, k in groups) / n
    between = (ss - (len(groups) - 1) * mean * (1 - mean)) / max(size, 1e-9)
    return min(1e4, max(2.0, mean * (1 - mean) / max(between, 1e-9) - 1))


@pytest.fixture(scope="module")
def site_rows():
    rng = np.random.default_rng(17)
    rows = []
    for k in range(400):
        host = ["good", "good", "bad", f"h{k % 37}", None][int(rng.integers(0, 5))]
        bad = host == "bad" or rng.random() < 0.2
        text = "!!! $$$ ### buy now " * int(rng.integers(1, 9)) if bad else "The people of the town went to see what had happened there. " * int(rng.integers(1, 9))
        rows.append((k if k % 50 else 7, text if k % 41 else None, host, ["en", "de", None][k % 3]))
    labels = [(k, int("$" not in (rows[k][1] or "$"))) for k in range(0, 200, 2)] + [(3, None), (None, 1), (9, 1), (9, 0), (10**6, 1)]
    return rows, labels


@pytest.mark.parametrize("max_labelled", [quality.MAX_LABELLED, 30])
def test_posteriors_against_a_row_by_row_computation(spark, site_rows, max_labelled):
    """Also with more labels than the classifier is fitted on: all of them vote."""
    rows, labels = site_rows
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("p", F.monotonically_increasing_id()).coalesce(1)
    scored, names = quality.score(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), F.col("source"), F.col("lang"), ["doc_id", "source", "lang", "p"], max_labelled)
    got = [r.asDict() for r in scored.collect()]
    assert len(got) == len(rows) and names == ["p_doc", "p_host", "p_path", "p_"]
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known.setdefault(i, []).append(y)
    for r in got:
        r["vote"] = float(np.mean(known[r["doc_id"]])) if r["doc_id"] in known else r["p_doc"]
        r["host"], r["path"] = r["source"] or "", (r["source"] or "", r["lang"] or "")
    sums = {}
    for r in got:
        for key in (None, r["host"], r["path"]):
            s, n = sums.get(key, (0.0, 0))
            sums[key] = s + r["vote"], n + 1
    total, n = sums[None]
    mean = (total + 1) / (n + 2)
    host_k = strength([v for k, v in sums.items() if isinstance(k, str)], mean)
    path_k = strength([v for k, v in sums.items() if isinstance(k, tuple)], mean)
    for r in got:
        others = (total - r["vote"] + 1) / (n - 1 + 2)
        hs, hn = sums[r["host"]]
        host = (max(hs - r["vote"], 0) + others * host_k) / (hn - 1 + host_k)
        ps, pn = sums[r["path"]]
        path = (max(ps - r["vote"], 0) + host * path_k) / (pn - 1 + path_k)
        assert (r["p_host"], r["p_path"]) == (pytest.approx(host, abs=1e-9), pytest.approx(path, abs=1e-9))
        odds = math.log(r["p_doc"] / (1 - r["p_doc"])) + math.log(path / (1 - path)) - math.log(others / (1 - others))
        assert r["p_"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


def test_sites_shrink_and_leave_out_the_own_vote(spark):
    """A host of one document says nothing about it; a large bad host pulls its documents down."""
    rows = [(k, "Some text of a document.", "big", "a") for k in range(300)] + [(1000 + k, "Some text of a document.", "well", "a") for k in range(300)] + [(5000, "Some text of a document.", "lone", "a")]
    labels = [(k, 0) for k in range(300)] + [(1000 + k, 1) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {r["doc_id"]: r for r in quality.classify_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert got[0]["p_host"] < 0.05 and got[1000]["p_host"] > 0.95 and abs(got[5000]["p_host"] - 0.5) < 0.01 and abs(got[5000]["p_path"] - 0.5) < 0.01
    assert not got[0]["kept"] and got[1000]["kept"]


def test_clashing_names_and_empty_tables(spark, site_rows):
    rows, labels = site_rows
    docs = spark.createDataFrame(rows[:40], "doc_id bigint, text string, source string, lang string")
    names = ["p_doc", "p_host", "p_path", "p", "host", "path", "number", "body", "logit", "y", "s", "n", "hs", "hn", "__host", "a.b"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    known = spark.createDataFrame(labels, "doc_id bigint, quality int").withColumn("y", F.lit(1))
    kept = quality.keep_good(wide, known)
    assert kept.columns == wide.columns and 0 < kept.count() < 40 and {r["a.b"] for r in kept.collect()} == {names.index("a.b")}
    assert quality.keep_good(wide.limit(0), known).count() == 0 == quality.classify_documents(docs.limit(0), known.limit(0)).count()
