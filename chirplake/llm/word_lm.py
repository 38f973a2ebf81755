"""Cross-entropy difference of matched word models whose counts are tables that grow with the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.util import bounded_batches, shuffle_partitions

#: Characters whose n-grams are counted together before anything moves; a longer text is alone.
CHUNK_CHARS = 16 << 20
#: Weight of the single-word model in each context, in tokens (a Dirichlet prior, the same in both models).
PRIOR = 4.0
#: Bits of the keys of words and word pairs.
KEY_BITS = 56
#: A word, or a character that is neither of a word nor a blank. Ideographs and kana, written without blanks, are words by themselves.
_UNSPACED = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_ASCII = re.compile(r"\w+|[^\w\s]")
_ANY = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+|[^\w\s]")
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd", compression_level=1)


def words_of(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _ANY).findall(text)


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of the pairs of neighbouring word keys."""
    x = tokens[:-1] * np.uint64(_MIX[2]) + tokens[1:] + np.uint64(_MIX[2])  # the pair of two ends is no zero, as an end is
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - KEY_BITS)


def _pack(x: np.ndarray) -> bytes:
    """The array's bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(data[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, the texts' word keys with a zero before, between and after them, and whether each key but the first is of a target."""
    ids, keys, flags, size = [], [], [], 0

    def emit() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return pa.concat_arrays(ids), np.concatenate([np.zeros(1, np.uint64), *keys]), np.concatenate(flags)

    for batch in batches:
        column = batch.column(1).to_pylist()
        target = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        at = 0
        while at < len(column):
            words, lengths, begin, part = [], [], at, 0
            while at < len(column) and part < 2 << 20:  # few words as Python objects at a time
                text = column[at] or ""
                some = words_of(text)
                words += some
                words.append("")
                lengths.append(len(some) + 1)
                part += len(text)
                at += 1
            coded = pa.array(words, pa.string()).dictionary_encode()
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - KEY_BITS) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            ids.append(batch.column(0).slice(begin, at - begin))
            keys.append(hashes[coded.indices.to_numpy()])
            flags.append(np.repeat(target[begin:at], lengths))
            size += part
            if size >= CHUNK_CHARS:
                yield emit()
                ids, keys, flags, size = [], [], [], 0
    if ids:
        yield emit()


def _totals(docs: DataFrame) -> tuple[int, int, int]:
    """Distinct words, and tokens of all documents and of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, flags in _chunks(batches):
            key, place, n = np.unique(tokens[1:], return_inverse=True, return_counts=True)
            of_target = np.bincount(place, flags, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(of_target)], ["word", "n", "of_target"])

    words = docs.mapInArrow(run, "word bigint, n bigint, of_target bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("of_target").alias("of_target"))
    row = words.agg(F.count("*"), F.sum("n"), F.sum("of_target")).first()
    return row[0], row[1] or 0, row[2] or 0


_ROW = "chunk bigint, dest bigint, a binary, b binary, c binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    chunk, dest, *data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(dest, pa.int64()), *(pa.array(d, pa.binary()) for d in data)], ["chunk", "dest", "a", "b", "c"])


def _count(buckets: int):
    """Per chunk the counts of its words and pairs, one row a bucket of keys, and a row (dest below 0) of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        bounds = np.array([(k << KEY_BITS) // buckets for k in range(buckets + 1)], np.uint64)
        for ids, tokens, flags in _chunks(batches):
            words, places = np.unique(tokens, return_inverse=True)
            numbers = ids.fill_null(0).to_numpy().astype("<i8")
            about = np.concatenate([numbers, ids.is_valid().to_numpy(zero_copy_only=False).astype("<i8")])
            yield _batch([(chunk, -1 - chunk, _pack(places.astype("<u4")), _pack_sorted(words), _pack(about))])
            del places
            every = np.concatenate([tokens[1:], pair_keys(tokens)])
            key, place, n = np.unique(every, return_inverse=True, return_counts=True)
            of_target = np.bincount(place, np.concatenate([flags, flags]), len(key)).astype("<u8")
            del every, place
            n, cuts, rows = n.astype("<u8"), np.searchsorted(key, bounds).tolist(), []
            for k in range(buckets):
                s = slice(cuts[k], cuts[k + 1])
                if cuts[k] < cuts[k + 1]:
                    rows.append((chunk, k, _pack_sorted(key[s]), _pack(n[s]), _pack(of_target[s])))
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            chunk += 1

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """The rows of each value of a column that they are sorted by."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the counts of each bucket over all chunks and sends each chunk those of its keys; rows of documents go through."""
    for rows in _runs(batches, "dest"):
        if rows[0]["dest"] < 0:
            for r in rows:
                yield _batch([tuple(r.values())])
            continue
        keys = [_unpack_sorted(r["a"]) for r in rows]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = lambda name: np.bincount(place, np.concatenate([_unpack(r[name], "<u8") for r in rows]), len(key)).astype("<u8")[place]  # noqa: B023, E731
        out = [(r["chunk"], r["dest"], b"", _pack(n), _pack(t)) for r, n, t in zip(rows, np.split(total("b"), cuts), np.split(total("c"), cuts), strict=True)]
        for s in range(0, len(out), 64):
            yield _batch(out[s : s + 64])


def _score(kinds: int, n_background: int, n_target: int):
    def loss(pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int) -> np.ndarray:
        return -np.log2((pair + PRIOR * (word + 1) / (tokens + kinds)) / (context + PRIOR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "chunk"):
            (own,) = (r for r in rows if r["dest"] < 0)
            answers = sorted((r for r in rows if r["dest"] >= 0), key=lambda r: r["dest"])
            n, of_target = (np.concatenate([_unpack(r[name], "<u8") for r in answers]).astype(np.float64) for name in ("b", "c"))
            tokens = _unpack_sorted(own["b"])[_unpack(own["a"], "<u4")]
            key, place = np.unique(np.concatenate([tokens[1:], pair_keys(tokens)]), return_inverse=True)
            assert len(key) == len(n)
            word, pair = np.split(place, 2)
            # A word's number as a context is its number as a word: each text has one zero, before as well as after it.
            before = np.concatenate([[np.searchsorted(key, 0)], word[:-1]])
            difference = loss(of_target[pair], of_target[before], of_target[word], n_target) - loss(n[pair], n[before], n[word], n_background)
            ends = np.flatnonzero(tokens[1:] == 0)
            sizes = np.diff(ends, prepend=-1)
            sums = np.add.reduceat(difference, ends - sizes + 1)
            numbers, valid = np.split(_unpack(own["c"], "<i8"), 2)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64(), mask=valid == 0), pa.array(sizes, pa.int64()), pa.array(sums / sizes, pa.float64())], ["doc_id", "n_tokens", "score"])

    return run


def word_cross_entropy_difference(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score of each row of ``docs`` (doc_id, text, is_target; other columns are ignored).

    The background model counts all rows, the target model those with is_target.
    Both are bigram models of words over the one vocabulary of all rows: a word
    after another has (count of the pair + PRIOR * p) / (count of the first +
    PRIOR), where p is its add-one share of all tokens. A document's score is the
    mean over its tokens (its words and the end of the text) of the loss under the
    target model less that under the background model, in bits: low scores are
    like the target. A null text is an empty one, of a single token. A null
    is_target is false. An empty table gives an empty table.

    Nothing is broadcast or capped: words and pairs are counted per chunk of some
    16 MB of text, chunks send each bucket of keys their counts, and buckets send
    back the sums for the keys that a chunk has. A key is sent once a chunk, so
    that a very common one is no more work than another. Keys are hashes of 56
    bits: of 10^10 different pairs about one in ten million shares its key.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("is_target").cast("boolean"), F.lit(False)).alias("is_target"))
    rows = bounded_batches(rows)
    totals = _totals(rows)
    tasks = shuffle_partitions(rows)
    counted = rows.mapInArrow(_count(8 * tasks), _ROW).repartition(tasks, "dest").sortWithinPartitions("dest")
    answered = counted.mapInArrow(_answer, _ROW).repartition(tasks, "chunk").sortWithinPartitions("chunk")
    return answered.mapInArrow(_score(*totals), "doc_id bigint, n_tokens bigint, score double")
