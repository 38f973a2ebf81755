"""Progressive JPEG columns: coefficient accumulation, inverse transform and RGB tensors in numpy."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.util import bounded_batches, map_rows, unused, utf8


def _zigzag() -> np.ndarray:
    """Row-major place of each zigzag index: diagonals in turn, up on even ones and down on odd ones."""
    order = sorted(((i + j, i if (i + j) % 2 else j, 8 * i + j) for i in range(8) for j in range(8)))
    return np.array([place for _, _, place in order])


ZIGZAG = _zigzag()


def _inverse_transform() -> np.ndarray:
    """64 x 64: row-major coefficients to row-major samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64).astype(np.float32)


#: Coefficients in zigzag order to row-major samples.
_IDCT = np.ascontiguousarray(_inverse_transform()[ZIGZAG])


@dataclass
class Component:
    """One colour component; coefficients are kept in zigzag order, padded to whole MCUs."""

    name: int
    h: int
    v: int
    quant: int
    blocks_w: int = 0
    blocks_h: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comments: list[bytes]

    @property
    def hmax(self) -> int:
        return max(c.h for c in self.components)

    @property
    def vmax(self) -> int:
        return max(c.v for c in self.components)


class Huffman:
    """Canonical code; a table over 16-bit windows gives symbol and length, length 0 where no code fits."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.symbol = np.zeros(65536, np.uint8)
        self.length = np.zeros(65536, np.uint8)
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                low = code << (16 - length)
                high = (code + 1) << (16 - length)
                self.symbol[low:high] = symbols[at]
                self.length[low:high] = length
                code += 1
                at += 1
            code <<= 1
        self._lists: tuple[list[int], list[int]] | None = None

    def lists(self) -> tuple[list[int], list[int]]:
        if self._lists is None:
            self._lists = self.symbol.tolist(), self.length.tolist()
        return self._lists


_HUFFMAN: dict[bytes, Huffman] = {}


def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    key = counts + symbols
    if key not in _HUFFMAN:
        if len(_HUFFMAN) > 64:
            _HUFFMAN.clear()
        _HUFFMAN[key] = Huffman(counts, symbols)
    return _HUFFMAN[key]


class Bits:
    """Entropy-coded bits of one restart interval; zeros follow its end."""

    def __init__(self, data: bytes) -> None:
        self.data = np.frombuffer(data, np.uint8)
        self.n = 8 * len(data)
        self.at = 0
        self._raw = data + b"\0" * 8
        self._all: np.ndarray | None = None

    def window(self, count: int) -> int:
        """The next ``count`` (32 at most) bits, without moving."""
        k = self.at >> 3
        return int.from_bytes(self._raw[k : k + 5], "big") >> (40 - (self.at & 7) - count) & ((1 << count) - 1) if k < len(self._raw) - 5 else 0

    def take(self, count: int) -> int:
        if not count:
            return 0
        value = self.window(count)
        self.at += count
        if self.at > self.n + 64:
            raise ValueError("entropy-coded data ends early")
        return value

    def symbol(self, code: Huffman) -> int:
        symbols, lengths = code.lists()
        w = self.window(16)
        if not lengths[w]:
            raise ValueError("no such Huffman code")
        self.take(lengths[w])
        return symbols[w]

    def all(self) -> np.ndarray:
        if self._all is None:
            self._all = np.unpackbits(self.data)
        return self._all


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


#: So many symbols of equal length in a row are worth decoding at once.
_BULK = 16
#: Most pixels (some 25 bytes of memory each) and scans of a picture from elsewhere; one with more is an error, not decoded in part.
MAX_PIXELS, MAX_SCANS = 1 << 24, 500
#: What a broken picture can raise.
BROKEN = (ValueError, IndexError, KeyError, ArithmeticError)


class Decoder:
    """Accumulates the scans of a progressive JPEG into coefficient arrays; what is no such picture is a ValueError or another of ``BROKEN``."""

    def __init__(self, data: bytes, max_pixels: int | None = None) -> None:
        self.data = data
        self.max_pixels, self.scans = max_pixels, 0
        self.quants: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], Huffman] = {}
        self.comments: list[bytes] = []
        self.restart = 0
        self.frame: Frame | None = None

    def decode(self) -> Frame:
        data, at = self.data, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind = data[at + 1]
            at += 2
            if kind == 0xFF:
                at -= 1
                continue
            if kind == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + size]
            if size < 2 or len(body) < size - 2:
                raise ValueError("a segment is cut short")
            at += size
            if kind == 0xDB:
                self._quant(body)
            elif kind == 0xC4:
                self._codes(body)
            elif kind == 0xC2:
                self._start_frame(body)
            elif kind == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif kind == 0xFE:
                self.comments.append(body)
            elif kind == 0xDA:
                end = self._scan_end(at)
                self._scan(body, self._intervals(data[at:end]))
                at = end
            elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("only progressive Huffman-coded frames are read")
        if self.frame is None:
            raise ValueError("no frame")
        return self.frame

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            kind = ">u2" if wide else np.uint8
            size = 128 if wide else 64
            if at + 1 + size > len(body):
                raise ValueError("a quantiser is cut short")
            self.quants[name] = np.frombuffer(body[at + 1 : at + 1 + size], kind).astype(np.int32)
            at += 1 + size

    def _codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.codes[body[at] >> 4, body[at] & 15] = _huffman(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _start_frame(self, body: bytes) -> None:
        if self.frame is not None:
            raise ValueError("a second frame")
        if body[0] != 8:
            raise ValueError("only 8-bit samples are read")
        height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if not height or not width or body[5] not in (1, 3):
            raise ValueError("a picture has a size and one or three components")
        if self.max_pixels is not None and height * width > self.max_pixels:
            raise ValueError(f"more than {self.max_pixels} pixels")
        parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        if not all(1 <= n <= 4 for c in parts for n in (c.h, c.v)) or len({c.name for c in parts}) < len(parts):
            raise ValueError("sampling factors are 1 to 4, and names differ")
        self.frame = Frame(width, height, parts, self.quants, self.comments)
        self.mcus_w, self.mcus_h = -(-width // (8 * self.frame.hmax)), -(-height // (8 * self.frame.vmax))
        for c in parts:
            c.blocks_w = -(-(-(-width * c.h // self.frame.hmax)) // 8)
            c.blocks_h = -(-(-(-height * c.v // self.frame.vmax)) // 8)
            c.coefs = np.zeros((self.mcus_h * c.v, self.mcus_w * c.h, 64), np.int32)

    def _scan_end(self, at: int) -> int:
        data = self.data
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return len(data)
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
                continue
            return at

    def _intervals(self, raw: bytes) -> list[bytes]:
        if not self.restart:
            return [raw.replace(b"\xff\0", b"\xff")]
        out, start, at = [], 0, 0
        while (at := raw.find(b"\xff", at)) >= 0 and at + 1 < len(raw):
            if 0xD0 <= raw[at + 1] <= 0xD7:
                out.append(raw[start:at])
                start = at + 2
            at += 2
        return [x.replace(b"\xff\0", b"\xff") for x in [*out, raw[start:]]]

    def _scan(self, body: bytes, intervals: list[bytes]) -> None:
        self.scans += 1
        if self.frame is None or self.scans > MAX_SCANS:
            raise ValueError("a scan before the frame, or too many of them")
        by_name = {c.name: c for c in self.frame.components}
        parts = [(by_name[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
        first, last, both = body[1 + 2 * body[0]], body[2 + 2 * body[0]], body[3 + 2 * body[0]]
        high, low = both >> 4, both & 15
        if not parts or low > 13 or not (first == last == 0 or (1 <= first <= last <= 63 and len(parts) == 1)):
            raise ValueError("no such scan")
        if first == 0:
            self._scan_dc(parts, intervals, high, low)
        else:
            part, _, table = parts[0]
            band = part.coefs[: part.blocks_h, : part.blocks_w].reshape(-1, 64)
            copied = not np.shares_memory(band, part.coefs)
            step = self.restart or len(band)
            for k, data in enumerate(intervals):
                rows = band[k * step : (k + 1) * step]
                if len(rows):
                    (_ac_refine if high else _ac_first)(Bits(data), rows, self.codes[1, table], first, last, low)
            if copied:
                part.coefs[: part.blocks_h, : part.blocks_w] = band.reshape(part.blocks_h, part.blocks_w, 64)

    def _scan_dc(self, parts: list[tuple[Component, int, int]], intervals: list[bytes], high: int, low: int) -> None:
        """The blocks of an MCU in a row (of a single component: its own blocks), each as a place in that component."""
        if len(parts) == 1:
            c = parts[0][0]
            grid = np.arange(c.blocks_h)[:, None] * c.coefs.shape[1] + np.arange(c.blocks_w)[None, :]
            places, counts = [grid.reshape(-1, 1)], [1]
        else:
            counts = [c.h * c.v for c, _, _ in parts]
            many = self.mcus_w * self.mcus_h > _KEPT_MCUS
            places = (_places.__wrapped__ if many else _places)(self.mcus_w, self.mcus_h, tuple((c.h, c.v) for c, _, _ in parts))
        mcus = len(places[0])
        step = self.restart or mcus
        flat = [c.coefs.reshape(-1, 64) for c, _, _ in parts]
        for k, data in enumerate(intervals):
            rows = slice(k * step, min((k + 1) * step, mcus))
            n = rows.stop - rows.start
            if n <= 0:
                break
            if high:
                values = np.unpackbits(np.frombuffer(data, np.uint8), count=n * sum(counts)).reshape(n, -1)  # zeros follow the end
            else:
                values = _dc_first(Bits(data), [self.codes[0, table] for (_, table, _), count in zip(parts, counts, strict=True) for _ in range(count)], n).reshape(n, -1)
            at = 0
            for own, place, count in zip(flat, places, counts, strict=True):
                part = values[:, at : at + count].ravel()
                at += count
                if high:
                    own[place[rows].ravel(), 0] |= part.astype(np.int32) << low
                else:
                    own[place[rows].ravel(), 0] = part.cumsum() << low


#: Pictures of up to so many MCUs have their places kept for the next one of their size (some 50 bytes an MCU).
_KEPT_MCUS = 4096


@functools.lru_cache(maxsize=128)
def _places(mcus_w: int, mcus_h: int, factors: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """Per component, the places of its blocks: a row an MCU, in the order of an interleaved scan."""
    y, x = np.arange(mcus_h)[:, None, None, None], np.arange(mcus_w)[None, :, None, None]
    return [((y * v + np.arange(v)[:, None]) * (mcus_w * h) + x * h + np.arange(h)).reshape(-1, h * v) for h, v in factors]


def _dc_first(bits: Bits, codes: list[Huffman], mcus: int) -> np.ndarray:
    """Differences, in the order of the scan."""
    out: list[int] = []
    at, raw = bits.at, bits._raw
    tables = [code.lists() for code in codes]
    end = len(raw) - 5
    for _ in range(mcus):
        for symbols, lengths in tables:
            k = at >> 3
            if k >= end:
                raise ValueError("entropy-coded data ends early")
            w = int.from_bytes(raw[k : k + 5], "big") >> (8 - (at & 7)) & 0xFFFFFFFF
            top = w >> 16
            size, length = symbols[top], lengths[top]
            if not length:
                raise ValueError("no such Huffman code")
            if size:
                value = w >> (32 - length - size) & ((1 << size) - 1)
                out.append(value if value >> (size - 1) else value - (1 << size) + 1)
            else:
                out.append(0)
            at += length + size
    bits.at = at
    return np.array(out, np.int64)


def _ac_first(bits: Bits, rows: np.ndarray, code: Huffman, first: int, last: int, low: int) -> None:
    """First scan of a band. Runs of symbols with no zeros before them and equal lengths are decoded at once."""
    block, k, n, width = 0, first, len(rows), last - first + 1
    while block < n:
        w = bits.window(16)
        length, symbol = int(code.length[w]), int(code.symbol[w])
        if not length:
            raise ValueError("no such Huffman code")
        zeros, size = symbol >> 4, symbol & 15
        if size and not zeros:
            stride = length + size
            most = min((n - block) * width - (k - first), (bits.n - bits.at) // stride)
            if most >= _BULK:
                table = bits.all()[bits.at : bits.at + most * stride].reshape(most, stride)
                if length == 1:
                    odd = table[:, 0] != table[0, 0]
                else:
                    odd = (table[:, :length] != table[0, :length]).any(1)
                same = int(odd.argmax()) if odd.any() else most
                if same >= _BULK:
                    extra = table[:same, length:]
                    packed = np.packbits(np.concatenate([np.zeros((same, 16 - size), np.uint8), extra], 1) if size != 8 else extra, axis=None)
                    value = packed.astype(np.int32) if size == 8 else packed.view(">u2").astype(np.int32)
                    value = np.where(extra[:, 0] == 1, value, value - (1 << size) + 1) << low
                    start = block * width + k - first
                    if start == 0 and same == n * width:
                        rows[:, first : last + 1] = value.reshape(n, width)
                    else:
                        place = np.arange(start, start + same)
                        rows[place // width, first + place % width] = value
                    bits.at += same * stride
                    block, k = divmod(start + same, width)
                    k += first
                    continue
        bits.take(length)
        if size:
            k += zeros
            if k > last:
                raise ValueError("a run leaves its block")
            rows[block, k] = _signed(bits.take(size), size) << low
            k += 1
        elif zeros == 15:
            k += 16
        else:
            run = (1 << zeros) + bits.take(zeros)
            block, k = block + run, first
            continue
        if k > last:
            block, k = block + 1, first


def _correct(bits: Bits, values: np.ndarray, low: int) -> np.ndarray:
    """Give each value that is not zero its next bit of magnitude."""
    there = np.flatnonzero(values)
    got = bits.all()[bits.at : bits.at + len(there)]
    bits.at += len(there)
    out = values.copy()
    if len(got) == len(out):  # none is zero
        out += np.where(out > 0, got, -got.astype(np.int32)) << low
    else:
        on = there[: len(got)][got == 1]
        out[on] += np.sign(values[on]) << low
    return out


def _ac_refine(bits: Bits, rows: np.ndarray, code: Huffman, first: int, last: int, low: int) -> None:
    """Refinement of a band. The bits of all blocks of an end-of-band run are taken at once."""
    block, n = 0, len(rows)
    while block < n:
        k = first
        while k <= last:
            symbol = bits.symbol(code)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                whole = 0 if k == first else 1  # blocks of the run that are not all left
                if whole:
                    rows[block, k : last + 1] = _correct(bits, rows[block, k : last + 1], low)
                if run > whole:
                    more = rows[block + whole : block + run, first : last + 1]
                    more[...] = _correct(bits, more.ravel(), low).reshape(more.shape)
                block += run - 1
                break
            new = 0
            if size:
                new = (1 if bits.take(1) else -1) << low
            while k <= last:
                old = rows[block, k]
                if old:
                    if bits.take(1):
                        rows[block, k] += (1 if old > 0 else -1) << low
                elif zeros:
                    zeros -= 1
                else:
                    if size:
                        rows[block, k] = new
                    k += 1
                    break
                k += 1
        block += 1


def samples(part: Component, quant: np.ndarray) -> np.ndarray:
    """Inverse transform of all blocks: an array of the component's padded size, 0 to 255."""
    h, w, _ = part.coefs.shape
    scaled = np.multiply(part.coefs.reshape(-1, 64), quant, dtype=np.float32, casting="unsafe")
    plane = (scaled @ _IDCT).reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
    plane += 128
    return np.minimum(np.maximum(plane, 0, out=plane), 255, out=plane)


def to_rgb(frame: Frame) -> np.ndarray:
    """Full-resolution RGB tensor (height, width, 3); chroma samples are repeated, one component is grey."""
    planes = []
    for c in frame.components:
        plane = samples(c, frame.quants[c.quant])
        if frame.vmax % c.v or frame.hmax % c.h:  # in odd proportions each pixel has the sample that lies over it
            y, x = np.arange(frame.height) * c.v // frame.vmax, np.arange(frame.width) * c.h // frame.hmax
            plane = plane[y[:, None], x]
        else:
            if frame.vmax > c.v:
                plane = plane.repeat(frame.vmax // c.v, axis=0)
            if frame.hmax > c.h:
                plane = plane.repeat(frame.hmax // c.h, axis=1)
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) != 3:
        return np.repeat(np.rint(planes[0]).astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, colour in enumerate((1.402 * cr, -0.344136 * cb - 0.714136 * cr, 1.772 * cb)):
        colour += y
        colour += 0.5
        out[:, :, k] = np.minimum(np.maximum(colour, 0, out=colour), 255, out=colour)
    return out


@functools.lru_cache(maxsize=256)
def _segment(kind: int, body: bytes) -> bytes:
    return b"\xff" + bytes([kind]) + (len(body) + 2).to_bytes(2, "big") + body


@functools.lru_cache(maxsize=256)
def _scan_header(names: tuple[int, ...], tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(names)]) + b"".join(bytes([c, tables]) for c in names) + bytes([first, last, high << 4 | low]))


def _coded(bits: np.ndarray) -> bytes:
    """Bits as stuffed bytes, filled up with ones."""
    out = np.packbits(bits)
    if odd := -len(bits) % 8:
        out[-1] |= (1 << odd) - 1
    return out.tobytes().replace(b"\xff", b"\xff\0")


# The carrier: three components in 4:2:0, quantisers of one, and four codes of
# fixed length. Codes are (class and number, counts by length, symbols).
_CARRIER_TABLES = (
    _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC4, b"\x00" + bytes([0, 0, 0, 12]) + bytes(12) + bytes(range(12)))
    + _segment(0xC4, b"\x10" + bytes([1]) + bytes(15) + b"\x08")
    + _segment(0xC4, b"\x11" + bytes([0, 0, 0, 15]) + bytes(12) + bytes(r << 4 for r in range(15)))
)
_SHIFTS = np.arange(15, -1, -1)
#: Bits of each magnitude that a difference of two bytes has.
_SIZES = np.array([n.bit_length() for n in range(256)], np.int32)


def store_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the bytes of ``payload`` (a positive multiple of 64).

    Each byte is one coefficient: 64 to a block, in zigzag order, blocks first of
    the luma and then of the two chroma components. The DC coefficient is the
    byte less 128, the others the byte plus 256, so that none is zero and sizes
    are even. Scans: DC without its lowest bit; luma 1 to 5, the chroma
    components, luma 6 to 63, all without their lowest bit; then the lowest bits.
    """
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    cols = min(mcus, 64) if mcus <= 64 * 4000 else 4000
    rows = -(-mcus // cols)
    mcus = cols * rows
    data = np.zeros((6 * mcus, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = data[: 4 * mcus], data[4 * mcus : 5 * mcus], data[5 * mcus :]
    y = parts[0].reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(mcus, 4, 64)  # by MCU
    dc = np.column_stack([y[:, :, 0], parts[1][:, 0], parts[2][:, 0]]).astype(np.int32) - 128
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _CARRIER_TABLES]
    out.append(_segment(0xC2, b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_scan_header((1, 2, 3), 0x00, 0, 0, 0, 1), _coded(_dc_bits(dc >> 1))]
    for k, first, last in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)):
        value = (parts[k][:, first : last + 1] >> 1) | 0x80
        bits = np.zeros((value.size, 9), np.uint8)
        bits[:, 1:] = np.unpackbits(np.ascontiguousarray(value)).reshape(-1, 8)
        out += [_scan_header((k + 1,), 0x00, first, last, 0, 1), _coded(bits.ravel())]
    out += [_scan_header((1, 2, 3), 0x00, 0, 0, 1, 0), _coded((dc & 1).astype(np.uint8).ravel())]
    for k in range(3):
        pieces = []
        for at in range(0, len(parts[k]), 0x7FFF):
            some = parts[k][at : at + 0x7FFF, 1:] & 1
            power = len(some).bit_length() - 1
            head = power << power | (len(some) - (1 << power))  # a code of four bits, then the run's lower bits
            pieces += [(head >> np.arange(power + 3, -1, -1) & 1).astype(np.uint8), some.ravel()]
        out += [_scan_header((k + 1,), 0x01, 1, 63, 1, 0), _coded(np.concatenate(pieces))]
    return b"".join([*out, b"\xff\xd9"])


def _dc_bits(dc: np.ndarray) -> np.ndarray:
    """Codes and differences, predicted within each component, of rows of MCUs (4 luma, 2 chroma)."""
    diff = dc.copy()
    diff[:, 1:4] -= dc[:, :3]
    diff[1:, 0] -= dc[:-1, 3]
    diff[1:, 4:] -= dc[:-1, 4:]
    diff = diff.ravel()
    size = _SIZES[np.abs(diff)]
    value = np.where(diff < 0, diff + (1 << size) - 1, diff) | (size << size)  # the code is the size itself, four bits
    bits = np.unpackbits(value.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return bits[_SHIFTS[None, :] < (size + 4)[:, None]]


def load_payload(frame: Frame) -> bytes:
    """The bytes that :func:`store_payload` put into the coefficients."""
    size = int(next(c for c in frame.comments if c.startswith(b"payload ")).split()[1])
    data = np.concatenate([c.coefs.reshape(-1, 64) for c in frame.components])
    data[:, 0] += 128
    data[:, 1:] -= 256
    return data.astype(np.uint8).tobytes()[:size]


#: Bytes of pictures and tensors that leave a worker at once, unless one is larger.
OUT_BYTES = 16 << 20


def padded(text: bytes) -> bytes:
    """The text and zeros up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 if text else 64)


def features(rgb: np.ndarray) -> str:
    """Size, mean of each colour to two places, and checksum of the tensor."""
    mean = rgb.reshape(-1, 3).mean(0, dtype=np.float64)
    return f"{rgb.shape[1]}x{rgb.shape[0]} rgb {mean[0]:.2f} {mean[1]:.2f} {mean[2]:.2f} crc {zlib.crc32(rgb):08x}"


_TENSOR = "height integer, width integer, rgb binary"


def decode_column(media: DataFrame, key: str, column: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Decode a binary column of progressive JPEGs: key, height, width, rgb (row-major bytes, three a pixel), error.

    A null, empty or broken image, or one of more than ``max_pixels`` pixels,
    gives nulls and the reason in ``error``; no input fails the task. Other
    columns are not returned. The key may be of any type, repeat or be null. An
    empty table gives an empty table.
    """
    (name,) = unused(media.select(F.col(f"`{key}`")), "data")
    schema = media.select(F.col(f"`{key}`")).schema
    for field_ in (*_TENSOR.split(", "), "error string"):
        schema = schema.add(*field_.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):  # a tensor each, so that only one is held
                try:
                    rgb = to_rgb(Decoder(data or b"", max_pixels).decode())
                    row = [rgb.shape[0], rgb.shape[1], rgb.tobytes(), None]
                except BROKEN as e:
                    row = [None, None, None, f"{type(e).__name__}: {e}"]
                kinds = pa.int32(), pa.int32(), pa.binary(), pa.string()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], t) for x, t in zip(row, kinds, strict=True))], schema.names)

    return map_rows(media.select(F.col(f"`{key}`"), F.col(f"`{column}`").cast("binary").alias(name)), run, schema)


def carry_texts(docs: DataFrame) -> DataFrame:
    """Store each whole text in a progressive JPEG, read it back and decode the picture.

    Returns doc_id, n_bytes, media (the JPEG), payload (as read back from it),
    height, width, rgb (the decoded tensor, row-major, three bytes a pixel) and
    feature of each row of ``docs`` (doc_id, text; other columns are ignored). A
    null text is an empty one. Equal texts give equal values. Rows that repeat and
    null doc_ids are carried as they are. A very long text takes some 25 times its
    bytes of memory, one at a time. An empty table gives an empty table.
    """
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    schema = f"doc_id bigint, n_bytes bigint, media binary, payload binary, {_TENSOR}, feature string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin = utf8(batch.column(1)), 0
            while begin < len(texts):
                rows, size, at = [], 0, begin
                while at < len(texts) and size < OUT_BYTES:
                    text = texts[at] or b""
                    media = store_payload(padded(text))
                    frame = Decoder(media).decode()
                    rgb = to_rgb(frame)
                    rows.append((len(text), media, load_payload(frame), rgb.shape[0], rgb.shape[1], rgb.tobytes(), features(rgb)))
                    size += len(media) + rgb.nbytes
                    at += 1
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)
                begin = at

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, schema)


def carried_digests(docs: DataFrame) -> DataFrame:
    """What :func:`carry_texts` stores, with digests in place of the picture and the payload, and with the tensors."""
    out = carry_texts(docs)
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "height", "width", "rgb",
    )
