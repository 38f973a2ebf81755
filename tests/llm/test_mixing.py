"""The mix of sources, against a plain apportionment that hands out one block at a time, and on odd rows."""

import re
from fractions import Fraction

import pytest

from chirplake.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, start=0):
    return " ".join(f"w{k}" for k in range(start, start + n))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Reshare the excess again and again, in exact numbers."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, stopped = Fraction(share) * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > limit * sizes[s]]
        if not over:
            return stopped | {s: weight[s] * level for s in free}
        for s in over:
            stopped[s] = Fraction(limit * sizes[s])
            left -= stopped[s]


def plain_quotas(wanted, count):
    got = dict.fromkeys(wanted, 0)
    for _ in range(count):
        best = max(wanted, key=lambda c: (wanted[c] / (2 * got[c] + 1), [-x for x in c]))
        got[best] += 1
    return got


@pytest.fixture(scope="module")
def docs():
    out = [(k, words(20 + 37 * k % 400, k), "en", f"s{k % 7}" if k % 9 else None, 0) for k in range(120)]
    out += [(1000 + k, words(5, k), "en", "tiny", 0) for k in range(2)]
    return [*out, (2000, None, "en", "s1", None), (2001, "", None, "empty", 0), (2002, " \t\n ", "en", None, 4), (None, words(30), "en", "s2", 0), (None, words(30), "en", "s2", 0), (5, words(9), "en", "s3", 0)]


@pytest.fixture(scope="module")
def full(spark, docs):
    return mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()


def test_targets_and_counts(full, docs):
    assert len(full) == len(docs)
    sizes = {}
    for _, text, _, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(mixing.WORD, text or ""))
    want = plain_targets(sizes)
    for source, size in sizes.items():
        own = [r for r in full if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert all(r["target"] == pytest.approx(float(want[source])) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[source]) <= 2 * mixing.BLOCK
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in full)
    assert all(r["taken"] == r["repeats"] * r["size"] + sum(p["words"] for p in r["pieces"]) for r in full)
    for r in full:  # pieces lie within the document and apart from each other
        ends = [(p["first"], p["first"] + p["words"]) for p in r["pieces"]]
        assert all(0 <= a < b <= r["size"] for a, b in ends)
        assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:], strict=False))


def test_reruns_agree(spark, full, docs):
    again = mixing.mix(spark.createDataFrame(docs[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(full, key=repr) == sorted(again, key=repr)


@pytest.mark.parametrize(("wanted", "count"), [
    ([16.0 * k + 3 for k in range(40)], 700), ([1.0] * 30, 11), ([100.0, 100.0, 100.0, 3.0], 7), ([5.0], 3), ([0.5, 0.5, 900.0], 2), ([7.0, 7.0], 0),
])
def test_apportionment(spark, wanted, count):
    cells = {(k // 5, k % 5): w for k, w in enumerate(wanted)}
    rows = spark.createDataFrame([(r, s, w) for (r, s), w in cells.items()], "rank bigint, shard bigint, wanted double")
    got = {(r["rank"], r["shard"]): r["quota"] for r in mixing.apportioned(rows, count, sum(wanted)).collect()}
    assert got == plain_quotas(cells, count)


def test_many_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    got = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - target) <= 0.05 * target + 4 * mixing.BLOCK for (_, target), taken in by.items())


def test_texts(spark, full, docs):
    texts = mixing.mixed_texts(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sum(len(r["text"].split()) for r in texts) == sum(r["taken"] for r in full)
    whole = {" ".join(t.split()) for _, t, *_ in docs if t}
    assert all(any(r["text"] in w for w in whole) for r in texts)


def test_empty_and_clashing(spark):
    assert mixing.mix_counts(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["taken"] for r in mixing.mix_counts(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()] == [0]
    odd = spark.createDataFrame([(1, words(40), "a", 7, "x")], "doc_id bigint, text string, source string, size bigint, `place.x` string")
    got = mixing.mix(odd, carry=("size", "place.x"), share=1.0).first()
    assert (got["place.x"], got["taken"]) == ("x", 40)
