"""The manifest, against a plain tree that is held whole, and on odd rows."""

import hashlib
import zlib

import pytest

from chirplake.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_siblings(levels, place):
    out = []
    for nodes in levels[:-1]:
        first = place // 3 * 3
        out.append((nodes[first:place], nodes[place + 1 : first + 3]))
        place //= 3
    return out


def plain_manifest(docs):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d, strict=True)) for d in docs]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[s] = own, plain_levels([plain_leaf(r) for r in own])
    top = plain_levels([levels[-1][0] for _, levels in trees.values()])
    out = []
    for k, (own, levels) in enumerate(trees.values()):
        for place, row in enumerate(own):
            path = plain_siblings(levels, place) + plain_siblings(top, k)
            changed = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                changed["text"] = row["text"].replace("\n", "")
            node = plain_leaf(changed)
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((row["doc_id"], levels[0][place], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def made(spark, docs, schema=SCHEMA):
    return sorted(map(tuple, merkle.manifest(spark.createDataFrame(docs, schema).repartition(5)).collect()), key=repr)


def text(k):
    return [None, "", "one line", f"two\nlines {k}", "\n\n", "ünïcödé\n" * 3][k % 6]


ODD = [(k, text(k), "en", f"s{k % 4}" if k % 11 else None, k) for k in range(130)]
ODD += [(None, "a\nb", None, "s1", None), (None, "a\nb", None, "s1", None), (None, "c", "de", None, 1), (7, text(7), "en", "s3", 7), (7, "other\n", "en", "s3", 7), (500, "x\n", "en", "alone", 2), (501, "y" * 300_000 + "\n", "en", "é", 300_001)]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82, 100, 243])
def test_traversal(width):
    nodes = [sha(str(k)) for k in range(width)]
    levels = plain_levels(nodes)
    got = list(merkle.traversed(nodes, len(levels) - 1))
    assert got == [(["".join(a) for a, _ in path], ["".join(b) for _, b in path]) for path in (plain_siblings(levels, k) for k in range(width))]
    assert merkle.block_root(nodes, len(levels) - 1) == levels[-1][0]


def test_memory_of_stacks():
    nodes = [sha(str(k)) for k in range(729)]
    stack = merkle.Treehash(nodes, 6, 0, 729)
    most = 0
    for _ in nodes:
        stack.update()
        most = max(most, sum(map(len, stack.pending)))
    assert most <= 2 * 6


def test_odd_rows(spark):
    assert made(spark, ODD) == plain_manifest(ODD)


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    assert made(spark, ODD[:60] + ODD[-7:]) == plain_manifest(ODD[:60] + ODD[-7:])


@pytest.mark.parametrize("docs", [[], [(1, "a\nb", "en", None, 3)], [(k, "a\n", "en", f"s{k}", 2) for k in range(4)]])
def test_small_tables(spark, docs):
    assert made(spark, docs) == plain_manifest(docs) if docs else made(spark, docs) == []


def test_kept_proofs_find_changes(spark):
    docs = spark.createDataFrame([(k, text(k), "en", f"s{k % 3}", k) for k in range(40)], SCHEMA)
    known = merkle.proofs(docs)
    later = docs.withColumn("text", merkle.F.when(merkle.F.col("doc_id") == 5, "changed").otherwise(merkle.F.col("text"))).union(docs.limit(1).withColumn("doc_id", merkle.F.lit(99).cast("bigint")))
    got = {r["doc_id"]: r["verified"] for r in merkle.verified(later, known).collect()}
    assert got == {k: k != 5 for k in range(40)} | {99: None}


def test_clashing_columns(spark):
    schema = SCHEMA + ", place bigint, node string, tree string, width int, block string, `a.b` int"
    docs = [(*d, 1, "n", "t", 2, "b", 3) for d in ODD[:20]]
    assert made(spark, docs, schema) == plain_manifest(ODD[:20])
