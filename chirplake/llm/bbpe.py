"""Byte-level BPE: vectorised splitting, cached merging, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.util import bounded_batches, grouped

#: Symbols of the splitting automaton.
LETTER, NUMBER, SPACE, BLANK, OTHER, SHORT, LONG, OUTSIDE = range(8)
#: Unicode's White_Space characters but for the space itself (fixed values).
_BLANKS = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction (fixed values).
_ONE, _TWO = "stmd", ("re", "ve", "ll")
#: Slices whose ids a worker remembers before it begins anew.
CACHE_SLICES = 400_000


@functools.lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """Class of each code point, from its general category."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    for code in range(sys.maxunicode + 1):
        if (kind := first.get(unicodedata.category(chr(code))[0])) is not None:
            kinds[code] = kind
    kinds[_BLANKS] = BLANK
    kinds[0x20] = SPACE
    return kinds


# The automaton's states, after a character: FREE (an apostrophe would begin a
# slice), RUN (it would go on with a run of other characters, or join a space
# before it), and ONE or TWO letters of a contraction still to come. A transition
# function maps the four states to four states and is packed into one byte, two
# bits a state; functions compose through a table of 256 by 256 bytes.
FREE, RUN, ONE, TWO = range(4)


def _pack(to: tuple[int, int, int, int]) -> int:
    return sum(s << (2 * k) for k, s in enumerate(to))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function of each symbol; the composition of any two; which functions are constant."""
    symbols = np.zeros(8, np.uint8)
    symbols[LETTER] = _pack((FREE, FREE, FREE, ONE))
    symbols[NUMBER] = symbols[BLANK] = _pack((FREE,) * 4)
    symbols[SPACE] = symbols[OTHER] = _pack((RUN,) * 4)
    symbols[SHORT] = _pack((ONE, RUN, FREE, FREE))
    symbols[LONG] = _pack((TWO, RUN, FREE, FREE))
    symbols[OUTSIDE] = _pack((FREE,) * 4)
    f = np.arange(256)
    images = np.stack([(f >> (2 * k)) & 3 for k in range(4)])  # state by function
    then = np.zeros((256, 256), np.uint8)
    for k in range(4):
        then |= _after(images, k) << np.uint8(2 * k)
    constant = (images == images[0]).all(0)
    return symbols, then, constant


def _after(images: np.ndarray, k: int) -> np.ndarray:
    """For functions g then f (rows g, columns f): where state k ends."""
    return images[images[k][:, None], np.arange(256)[None, :]].astype(np.uint8)


def states(symbols: np.ndarray) -> np.ndarray:
    """State after each symbol, by an associative scan over transition functions.

    Doubling steps compose each function with the one before its span; a span
    whose function is constant needs none, and most are after a few steps since
    every blank, number and plain character is constant on its own.
    """
    table, then, constant = _tables()
    scan = table[symbols]
    open_ = np.flatnonzero(~constant[scan])
    reach = 1
    while len(open_):
        before = open_ - reach
        inside = before >= 0
        # The first symbol is constant, so no span reaches beyond the start.
        open_, before = open_[inside], before[inside]
        joined = then[scan[before], scan[open_]]
        scan[open_] = joined
        open_ = open_[~constant[joined]]
        reach *= 2
    return scan & 3


def boundaries(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which slices begin in the concatenated code points of several texts.

    The slices are those of the pattern: contractions; letters, numbers or other
    characters with one space before them; blanks up to the last one before a
    non-blank; other blanks.
    """
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    kinds = codepoint_classes()[codes]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    symbols = kinds.copy()
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        padded = np.r_[codes, 0, 0]
        one, two = padded[quote + 1], padded[quote + 2]
        end1, end2 = first[quote + 1], first[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(c) for c in _ONE]) & ~end1
        long = np.zeros(len(quote), bool)
        for a, b in _TWO:
            long |= (one == ord(a)) & (two == ord(b))
        long &= ~end1 & ~end2
        symbols[quote[short]] = SHORT
        symbols[quote[long]] = LONG
    # A text begins in the state FREE: a symbol that is constant there stands before it.
    shift = np.zeros(n, np.int64)
    shift[doc_starts[doc_starts < n]] = 1
    at = np.cumsum(shift) + np.arange(n)
    spread = np.full(n + int(shift.sum()), OUTSIDE, np.uint8)
    spread[at] = symbols
    after = states(spread)
    before = after[at - 1]
    inside = (before == ONE) | (before == TWO)
    contraction = ((symbols == SHORT) | (symbols == LONG)) & (before == FREE)
    head = first[:n]
    prior = np.r_[np.uint8(OUTSIDE), kinds[:-1]]
    prior[head] = OUTSIDE
    prior_inside = np.r_[False, inside[:-1]]
    blank = (kinds == SPACE) | (kinds == BLANK)
    prior_blank = (prior == SPACE) | (prior == BLANK)
    starts = contraction.copy()
    # Letters, numbers and other characters go on with a run of their kind, or join one space.
    new_run = (prior != kinds) | (prior_inside & (kinds == LETTER))
    starts |= ~blank & ~inside & new_run & (prior != SPACE)
    # An apostrophe that belongs to a run does not begin one; a run after a contraction does (its prior is a letter).
    # Blanks: the first of a run, and the last before a non-blank.
    next_blank = np.r_[blank[1:], False]
    ends_text = first[1:]
    starts |= blank & ~prior_blank
    starts |= blank & ~next_blank & ~ends_text
    starts |= head
    return np.flatnonzero(starts)


class ByteBPE:
    """Encoder and decoder for a rank file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.widths = np.zeros(max(self.pieces) + 1, np.int64)
        self.widths[list(self.pieces)] = list(map(len, self.pieces.values()))
        self._known: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: again and again the adjacent pair of lowest rank, the leftmost of equals, becomes one."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        if len(parts) > 256:
            return self._merge_long(piece)
        never = len(ranks) + 1
        pairs = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < never:
            k = pairs.index(low)
            parts[k] += parts.pop(k + 1)
            pairs.pop(k)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], never)
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], never)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over linked parts, for slices of thousands of bytes."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # part that begins at k ends before end[k]
        back = list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, k, stop = heapq.heappop(heap)
            if not alive[k] or end[k] >= n or end[end[k]] != stop:
                continue
            gone = end[k]
            alive[gone] = False
            end[k] = stop
            if stop < n:
                back[stop] = k
                if (r := ranks.get(piece[k : end[stop]])) is not None:
                    heapq.heappush(heap, (r, k, end[stop]))
            if back[k] >= 0 and (r := ranks.get(piece[back[k] : stop])) is not None:
                heapq.heappush(heap, (r, back[k], stop))
        return tuple(ranks[piece[k : end[k]]] for k in range(n) if alive[k])

    def slices(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All slices of the texts in a row, the number of them in each text, and their byte offsets in their text."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_starts = np.cumsum(lengths) - lengths
        begin = boundaries(codes, doc_starts[lengths > 0])
        counts = np.diff(np.searchsorted(begin, np.r_[doc_starts, len(codes)]))
        raw = joined.encode()
        if len(raw) == len(codes):
            at = np.r_[begin, len(codes)]
        else:
            widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            at = np.r_[0, np.cumsum(widths)][np.r_[begin, len(codes)]]
        edges = at.tolist()
        heads = np.repeat(at[np.minimum(np.searchsorted(begin, doc_starts), len(begin))], counts)
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)], counts, at[:-1] - heads

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Per text: its ids and, for decoding in part, the byte offset of each."""
        pieces, counts, offsets = self.slices(texts)
        ids = self.piece_ids(pieces)
        out, at = [], 0
        for count in counts.tolist():
            own: list[int] = []
            for group in ids[at : at + count]:
                own.extend(group)
            at += count
            out.append((own, self.offsets(own)[:-1].tolist()))
        return out

    def piece_ids(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        known, merge = self._known, self.merge
        if len(known) > CACHE_SLICES:
            known.clear()
        try:
            return [known[p] for p in pieces]
        except KeyError:
            for p in set(pieces).difference(known):
                known[p] = merge(p)
            return [known[p] for p in pieces]

    def offsets(self, ids: list[int] | np.ndarray) -> np.ndarray:
        """Byte offset of each id in the text that they stand for, and at the end its length."""
        return np.r_[0, np.cumsum(self.widths[np.asarray(ids, np.int64)])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode_range(self, ids: list[int], offsets: list[int], start: int, stop: int) -> bytes:
        """Bytes ``start`` to ``stop`` of the text, from only those ids that lie in that range by their offsets."""
        if stop <= start or not ids:
            return b""
        first = max(bisect_right(offsets, start) - 1, 0)
        return self.decode(ids[first : bisect_left(offsets, stop)])[start - offsets[first] : stop - offsets[first]]


@functools.lru_cache(maxsize=2)
def _codec(path: str) -> ByteBPE:
    return ByteBPE(path)


#: Characters that are split at once.
GROUP_CHARS = 1 << 20


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<bigint> (bytes of the text before each id) of every row of ``docs``.

    A null text is an empty one and gives no ids. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path)
        for batch in batches:
            got = [x for group in grouped([t or "" for t in batch.column(1).to_pylist()], GROUP_CHARS) for x in codec.encode(group)]
            ids = pa.array([x[0] for x in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([x[1] for x in got], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    return bounded_batches(_rows(docs)).mapInArrow(run, "doc_id bigint, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, ranks_path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id and the bytes that ``ids`` stand for, or those from ``start`` to ``stop`` by the kept ``offsets``; null ids are empty, and so is what lies beyond a text."""
    part = start > 0 or stop is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            if part:
                got = [codec.decode_range(x or [], o or [], start, sys.maxsize if stop is None else stop) for x, o in zip(ids, batch.column(2).to_pylist(), strict=True)]
            else:
                got = [codec.decode(x or []) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["doc_id", "bytes"])

    return bounded_batches(encoded.select("doc_id", "ids", *["offsets"] * part)).mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of every row of ``docs``: both ways in one pass, so that the ids never leave the worker.

    Every slice's ids must begin at the byte offset that was kept for the slice;
    ``n_bytes`` is the offset at which the last id ends.

    A null text is an empty one, of no tokens. Rows that repeat and null doc_ids are
    carried as they are; other columns are ignored. A text is worked on whole: one
    of a hundred million characters takes some 60 bytes of memory for each, shorter
    ones share groups of a million characters. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path)
        sha = hashlib.sha256
        for batch in batches:
            totals, coded, decoded, sizes = [], [], [], []
            for group in grouped([t or "" for t in batch.column(1).to_pylist()], GROUP_CHARS):
                pieces, counts, offsets = codec.slices(group)
                ids = codec.piece_ids(pieces)
                firsts = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(firsts[-1]))
                places = codec.offsets(flat)
                edges = firsts[np.r_[0, np.cumsum(counts)]]  # of documents among ids
                if not np.array_equal(places[firsts[:-1]] - np.repeat(places[edges[:-1]], counts), offsets):
                    raise ValueError("ids of a slice do not begin at its offset")
                sizes += np.diff(places[edges]).tolist()
                totals += np.diff(edges).tolist()
                for a, b in pairwise(edges.tolist()):
                    own = flat[a:b].tolist()
                    coded.append(sha(repr(own)[1:-1].replace(",", "").encode()).hexdigest())
                    decoded.append(sha(codec.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return bounded_batches(_rows(docs)).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
