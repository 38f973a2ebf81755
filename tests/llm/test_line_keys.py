"""Line dedup with repeated document numbers, colliding hashes and clashing column names."""

from pyspark.sql import functions as F

from chirplake.llm import lines


def brute(rows):
    """(doc_id, text) to the texts that stay, in the order of the rows."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    stays = lambda i, line: i is None or len(key(line)) < 10 or len(holders[key(line)]) < 2 or i == min(holders[key(line)])
    return [(i, "\n".join(x for x in (t or "").split("\n") if stays(i, x))) for i, t in rows]


ROWS = [
    (1, "shared line number one\nfirst's own line"), (2, "shared line number one\nown text of two"), (2, "unique first line here\nanother unique line"),
    (2, "another unique line\nshared line number one\nown text of two"), (3, "own text of two\nown text of two\nshort"), (3, "own text of two\nown text of two\nshort"),
    (None, "shared line number one"), (4, None), (4, ""), (5, "SHARED line number one \n\n\n"), (5, "x\n" * 5000 + "own text of two"),
]


def test_rows_that_share_a_number(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for parts in (1, 4):
        got = [tuple(r)[:2] for r in lines.dedup_lines(docs.repartition(parts)).collect()]
        assert sorted(got, key=str) == sorted(brute(ROWS), key=str)


def test_a_collision_of_one_hash_drops_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    both = lines._hashes
    for place in (0, 1):
        monkeypatch.setattr(lines, "_hashes", lambda key, place=place: tuple(F.lit(0).cast("bigint") if k == place else h for k, h in enumerate(both(key))))
        assert sorted([tuple(r)[:2] for r in lines.dedup_lines(docs).collect()], key=str) == sorted(brute(ROWS), key=str)


def test_neither_hash_follows_from_the_other(spark):
    keys = spark.range(200_000).select(F.concat(F.lit("a line of text "), F.col("id")).alias("key"))
    h1, h2 = lines._hashes(F.col("key"))
    low = keys.select(F.pmod(h1, F.lit(256)).alias("a"), F.pmod(h2, F.lit(256)).alias("b")).groupBy("a", "b").count()
    assert low.count() > 60_000  # of 65,536 that independent hashes would hit
    again = [h.substr(1, 9) for h in (h1.cast("string"), h2.cast("string"))]
    assert keys.where(again[0] == again[1]).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    names = ["number", "text_hash", "positions", "lines", "gone", "__doc", "__lost", "h1", "h2", "keeper", "n_lines", "N_Dropped", "a.b", "position", "line", "key"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    out = lines.dedup_lines(wide)
    assert out.columns == [c for c in wide.columns if c.lower() not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == sorted(brute(ROWS), key=str)
    assert {r["a.b"] for r in out.collect()} == {names.index("a.b")}
