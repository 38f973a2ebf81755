"""Packing of tokenised documents into windows by best-fit decreasing."""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.util import bounded_batches, grouped, saved

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
#: Pieces that one task packs; a shard of so many leaves next to no padding.
SHARD_PIECES = 2_000
#: Characters whose new words go to the tokenizer at once.
GROUP_CHARS = 1 << 20
#: Words whose ids a worker remembers before it begins anew.
CACHE_WORDS = 1_000_000
#: Unicode's White_Space characters, which the tokenizer drops (fixed values).
_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class WordTokenizer:
    """Ids of whole texts, word by word through a cache.

    The tokenizer splits at white space and drops it before anything else, so the
    ids of a text are those of its blank-separated words in a row.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._known: dict[str, bytes] = {"": b""}
        (self._between,) = self._tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        added = self._tokenizer.get_added_tokens_decoder()
        self._added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        self._splits = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Per text its little-endian unsigned 32-bit ids, without the end id.

        A literal added token, such as <|endoftext|>, is its own id, and the texts
        around it are tokenised apart, as the library does.
        """
        if self._splits is None or not any(a in t for t in texts for a in self._added):
            yield from self._plain_ids(texts)
            return
        parts = [self._splits.split(t) for t in texts]  # added tokens are at the odd places
        plain = self._plain_ids([p for some in parts for p in some[::2]])
        for some in parts:
            yield b"".join(self._added[p] if k % 2 else next(plain) for k, p in enumerate(some))

    def _plain_ids(self, texts: list[str]) -> Iterator[bytes]:
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        split = []
        for text in map(lowered, texts):
            split.append(text.split() if text.isascii() and not _ODD.search(text) else _BLANK.split(text))
        new: set[str] = set()
        for words in split:
            new.update(set(words).difference(known))
        # Letters and the punctuation after them are tokens apart, so most new words are known ones with another ending.
        ended = {w: m.end(1) for w in new if "\u0130" not in w and (m := _ENDED.fullmatch(w))}  # its lower case ends in a mark
        todo = new.difference(ended)
        for word, at in ended.items():
            todo.add(word[:at])
            todo.add(word[at:])
        todo = list(todo.difference(known))
        for at in range(0, len(todo), 500):
            self._learn(todo[at : at + 500])
        for word, at in ended.items():
            known[word] = known[word[:at]] + known[word[at:]]
        for words in split:
            yield b"".join(map(known.__getitem__, words))


    def _learn(self, words: list[str]) -> None:
        """Take the ids of words from one text of them, in which a word that none of them holds stands between each two."""
        known = self._known
        joined = f" {_BETWEEN} ".join(words)
        if joined.count(_BETWEEN) == len(words) - 1:
            ids = np.array(self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self._between)
            if len(cuts) == len(words) - 1:
                data, begin = ids.tobytes(), 0
                for word, end in zip(words, [*(4 * cuts).tolist(), len(data)], strict=True):
                    known[word] = data[begin:end]
                    begin = end + 4
                return
        for word, got in zip(words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            known[word] = array("I", got.ids).tobytes()


#: A word of a single id that hardly any text holds.
_BETWEEN = "\x01"
#: Letters, then ASCII punctuation but for the apostrophe, which may begin a contraction.
_ENDED = re.compile(r"([^\W\d_]+)[!-&(-/:-@\[-`{-~]+")


def lowered(text: str) -> str:
    """The text in lower case where that is what the tokenizer makes of it anyway; else the text as it is."""
    if text.isascii():
        return text.lower()
    # Its own lower case is by character, after composition; these two letters depend on their place.
    if "\u03a3" in text or "\u0130" in text:
        return text
    low = text.lower()
    return low if unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text


#: ASCII that str.split() takes for blanks and the tokenizer does not.
_ODD = re.compile("[\\x1c-\\x1f]")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Tokenise whole texts and cut each at multiples of ``window``: doc_id, start, length, ids_crc32, doc_tokens.

    Full windows come first and what is left over, if anything, last. A null text
    is an empty one: a single piece that holds the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer, end, step = _tokenizer(tokenizer_path), END_ID.to_bytes(4, "little"), 4 * window
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for i, ids in enumerate(ids for group in grouped(texts, GROUP_CHARS) for ids in tokenizer.ids(group)):
                ids += end  # noqa: PLW2901
                n = len(ids) // 4
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((i, at // 4, len(part) // 4, zlib.crc32(part), n))
            index, start, length, crc, total = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *map(pa.array, (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


class OpenWindows:
    """Segment tree over remaining capacities 0..window: leaf c counts the open windows with c tokens of room."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.open[capacity].append(name)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, length: int) -> int:
        """The smallest capacity of at least ``length`` that has an open window, or -1."""
        count, at = self.count, length + self.size
        if count[at]:
            return length
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at <<= 1
                    if not count[at]:
                        at += 1
                return at - self.size
            at >>= 1
        return -1

    def take(self, capacity: int) -> int:
        at = capacity + self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; ``lengths`` must be in descending order."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms, used = OpenWindows(window), 0
    for i, n in enumerate(lengths.tolist()):
        room = rooms.tightest(n)
        if room < 0:
            name, room = used, window
            used += 1
        else:
            name = rooms.take(room)
        where[i], offset[i] = name, window - room
        if room > n:
            rooms.add(room - n, name)
    return where, offset


def pack(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give each piece (from :func:`pieces`) its sequence_id and offset.

    Pieces are dealt by a hash of (doc_id, start) into shards of about
    ``shard_pieces``, whose number follows their count, and each shard is packed
    on its own in descending order of length (ties by doc_id, start and checksum).
    Shard and window number make up the sequence_id, so it is unique. Only
    narrow rows move; a document of many windows is spread over all shards.
    """
    count = cut.count()
    shards = max(1, -(-count // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.lit("shard")), F.lit(shards)).cast("bigint"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        name = (rows["shard"].to_numpy() << 32) + where
        return rows.drop_columns("shard").append_column("sequence_id", pa.array(name)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{c} bigint" for c in [*cut.columns, "sequence_id", "offset"])
    return dealt.groupBy("shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text; other columns are ignored) into windows.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null or empty text is a single piece that holds the end id. A very
    long text is tokenised whole, at some 100 bytes of memory a word. Rows that
    repeat a doc_id are packed each for itself. A null doc_id stays null. An empty
    table gives an empty table.
    """
    return pack(saved(pieces(docs, tokenizer_path, window), "pieces"), window)
