"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.llm.util import saved, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The bytes 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the key under different seeds, so that keys which share one do not share the other: 128 bits in all."""
    return F.xxhash64(key), F.xxhash64(F.lit("line"), key)  # the hash of a column is the seed of the next one's


def dropped_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The positions to drop: doc_id, text_hash, positions array<int>, for the rows that lose lines.

    Lines explode to (doc_id, text_hash, position, 128-bit hash); their texts
    never move. Rows that share a doc_id are told apart by the hash of their text.
    These rows, which both sides of the join read, are written to the shared
    scratch folder, so that the texts are read and hashed once. The count of
    documents per hash is a grouped aggregate that is combined before it moves,
    and so is the smallest document. With the threshold at two the smallest and
    largest doc_id tell as much as a distinct count. Only the rows of repeated
    hashes come out of the join. Its sides are plain tables that are shuffled on
    the hash for it alone, which lets adaptive execution split a line that a third
    of all rows hold (below an aggregate it could not).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("position", "line"))
    keyed = lines.select("doc_id", "text_hash", "position", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = _hashes(F.col("key"))
    keyed = saved(keyed.select("doc_id", "text_hash", "position", h1.alias("h1"), h2.alias("h2")), "lines")
    if min_docs <= 2:
        spread = F.min("doc_id") != F.max("doc_id") if min_docs == 2 else F.lit(True)
        repeated = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), spread.alias("often"))
    else:
        # One row per document and hash first, so that the count is a plain sum.
        once = keyed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        repeated = once.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), (F.sum("one") >= min_docs).alias("often"))
    repeated = saved(repeated.where("often").select("h1", "h2", "keeper"), "repeated")
    lost = keyed.join(repeated, ["h1", "h2"]).where("doc_id <> keeper")
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_list("position").alias("positions"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop the lines that at least ``min_docs`` documents share, except in the smallest doc_id.

    ``docs`` needs doc_id and text; all its columns come back, whatever their
    names, with ``text`` replaced and n_lines, n_dropped, both bigint, appended
    (columns of these names in ``docs`` are replaced). A null or empty text is one
    empty line and gives an empty text. Keys under ``min_chars`` code points are
    never dropped. A null doc_id takes part in no count and loses no line. Rows
    that repeat a doc_id count as one document, and each loses the lines of its
    own text that a smaller document has. An empty table gives an empty table.
    Positions lost by one row are gathered in one array, bounded by the lines of
    that text; a very long text is one row's arrays, a few times its size.
    """
    number, code, places, lines, gone = unused(docs, "number", "text_hash", "positions", "lines", "gone")
    lost = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs).toDF(number, code, places)
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    split = docs.select(*[F.col(f"`{c}`") for c in others], F.xxhash64(text).alias(code), F.split(text, "\n", -1).alias(lines))
    joined = split.join(lost.withColumnRenamed(code, gone), (F.col("doc_id") == F.col(number)) & (F.col(code) == F.col(gone)), "left")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(every, F.col(places)), lambda i: F.get(F.col(lines), i))
    text = F.when(F.col(places).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n"))
    dropped = F.coalesce(F.when(F.col(places).isNotNull(), F.size(F.array_distinct(places))), F.lit(0))
    out = {"text": text, "n_lines": F.size(lines).cast("bigint"), "n_dropped": dropped.cast("bigint")}
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*[out["text"].alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in columns], *[out[c].alias(c) for c in ("n_lines", "n_dropped")])


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> o.keeper, false) AS lost
  FROM keyed k LEFT JOIN often o ON k.key = o.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
