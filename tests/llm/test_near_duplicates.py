"""The pipeline's near-duplicate stage at its threshold, with repeats, and with odd doc_ids."""

import numpy as np

from chirplake.llm import simhash
from test_pipeline import shingles


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_pairs_around_the_threshold(spark):
    """Each pair has words of its own: at 0.8 to 0.85 one text of it goes, at 0.7 to 0.78 none does."""
    rng = np.random.default_rng(12)
    rows, want, kinds = [], set(), [0, 0]
    for k in range(6000):
        n = int(rng.integers(20, 300))
        words = [f"p{k}w{i}" for i in range(n)]
        other = list(words)
        if k % 3:
            for i in rng.choice(np.arange(5, n - 5), max(1, int(n * rng.uniform(0.015, 0.035))), replace=False):
                other[i] = f"p{k}c{i}"
        else:
            other = words[: int((n - 4) * rng.uniform(0.7, 0.85)) + 4]
        a, b = " ".join(words), " ".join(other)
        s = jaccard(a, b)
        if 0.8 <= s <= 0.85 or 0.7 <= s <= 0.78:
            rows += [(2 * k, a), (2 * k + 1, b)]
            want |= {2 * k} if s >= 0.8 else {2 * k, 2 * k + 1}
            kinds[s >= 0.8] += 1
    eight = [f"x{i}" for i in range(9)]
    rows += [(10**6, " ".join(eight)), (10**6 + 1, " ".join(eight[:8]))]  # 5 shingles and 4 of them
    want.add(10**6)
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert min(kinds) > 300
    assert want <= got  # no false link
    assert len(got - want) <= 0.003 * kinds[1]  # and hardly a pair missed


def test_a_large_group_and_chains(spark):
    """A group of near copies of one text, and a chain whose ends are apart, are one group each."""
    rng = np.random.default_rng(13)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(150):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"k{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"c{i}" for i in range(20 * k, 20 * k + 250))) for k in range(12)]
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0, 1000}
    prints = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert simhash.drop_near_duplicates(prints.limit(0)).count() == 0


def test_repeated_texts_are_copies(spark):
    """A text pasted twice has nearly the same set of shingles, whatever its number of words."""
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(1, text), (2, f"{text} {text}"), (3, " ".join([text] * 5)), (4, "tick tock " * 40 + "over"), (5, "tick tock " * 400 + "over")]
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1, 4}


def test_null_and_repeated_numbers(spark):
    """Rows without a number are documents of their own, also when a number is repeated elsewhere; no text is lost for a copy."""
    long = lambda name: " ".join(f"{name}{k}" for k in range(100))
    rows = [(None, long("a")), (None, long("b")), (None, long("c")), (None, long("c")), (1, long("d")), (7, long("d")), (7, long("e")), (8, long("f")), (8, long("f")), (None, long("f"))]
    for parts in (1, 5):
        got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).collect()
        assert sorted(((r["doc_id"], r["text"].split()[0]) for r in got), key=str) == sorted([(1, "d0"), (7, "e0"), (8, "f0"), (None, "a0"), (None, "b0"), (None, "c0")], key=str)
