"""Training-data operators against brute force, on the smallest tables and on odd rows."""

import gzip
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.llm import bbpe, components, embed_dedup, html_density, lines, packing, pjpeg, quality, queries, simhash, warc
from chirplake.llm.util import table

ODD = [(1, None), (2, ""), (3, " "), (4, "one"), (5, "one two"), (6, "The same line of words\nThe same line of words"), (7, "the SAME line of words \n\n"), (8, "é" * 3000 + "\n" + "漢字 " * 50), (9, "don't can't 'tis"), (9, "don't can't 'tis"), (None, "a row without a number"), (10, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src", "kept") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, line string").withColumn("bucket", F.lit(1)).withColumn("lang", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


def smallest_reachable(ids, linked):
    """Brute-force component labels of a list of ids."""
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return label


# ------------------------------------------------------------- components
@pytest.mark.parametrize("alone", [0, components.ONE_TASK_EDGES])
def test_components_of_a_long_path_and_a_star(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", alone)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 900)] + [(7, 7), (None, 3), (501, 500)]
    table_ = spark.createDataFrame(edges, "a bigint, b bigint")
    rows = components.connected_components(table_).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 900)} == {500} and 7 not in got and len(rows) == len(got) == 461
    assert components.connected_components(table_.limit(0)).count() == 0


# ---------------------------------------------------------------- simhash
def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op4_simhash(spark, sf_dir).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    ids = list(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == smallest_reachable(ids, linked)


def test_simhash_tiles_lose_no_link(spark):
    """Near and far words around a few centres, compared in tiny tiles, so that all routes are taken."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(60)]
    ids = list(range(len(values)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, signed, strict=True)], "doc_id bigint, f0 bigint, n_shingles bigint")
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (values[a] ^ values[b]).bit_count() <= 3]
    want = smallest_reachable(ids, linked)
    for tile_rows in (7, 50, None):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(prints, 1, 3, tile_rows=tile_rows).collect()}
        assert got == want


def test_simhash_bands_lose_no_link(spark):
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for _ in range(20):
        base = rng.integers(0, 2, 256)
        size = int(rng.integers(1, 300))
        for _ in range(6):
            bits = base.copy()
            flip = rng.choice(256, int(rng.integers(0, 40)), replace=False)
            bits[flip] ^= 1
            words = np.packbits(bits.astype(np.uint8)).view(np.int64)
            rows.append((k, *map(int, words), max(1, int(size * rng.uniform(0.85, 1.15)))))
            k += 1
    prints = spark.createDataFrame(rows, "doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint, n_shingles bigint")
    radius = simhash.radius_for(0.8, 256)

    def near(a, b):
        bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a[1:5], b[1:5], strict=True))
        return bits <= radius and min(a[5], b[5]) >= 0.8 * max(a[5], b[5])

    want = smallest_reachable([r[0] for r in rows], [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if near(a, b)])
    for tile_rows in (5, None):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(prints, 4, radius, 0.8, tile_rows).collect()}
        assert got == want


def test_simhash_odd_rows(spark, odd):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[None]["component_id"] is None
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_near_duplicates_are_dropped(spark, odd):
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(20, text), (21, text.replace("word150", "changed")), (22, " ".join(f"other{k}" for k in range(300))), (23, text), (None, "alone"), (24, None), (25, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("f0", F.lit(1))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [20, 22, 24, None]
    assert simhash.drop_near_duplicates(odd).count() <= len(ODD) - 2


# -------------------------------------------------------------------- bpe
def test_bpe_equals_the_library(spark, odd, sf_dir):
    import public_tokenizers as P
    import tiktoken

    codec = bbpe.ByteBPE(queries.BYTE_RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    want = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[r["doc_id"]] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))
    rows = bbpe.round_trip(docs, queries.BYTE_RANKS).collect()
    assert {r["doc_id"]: tuple(r)[1:4] for r in rows} == want
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == {r["doc_id"]: len((r["text"] or "").encode()) for r in docs.collect()}


def test_bpe_tables(spark, odd):
    encoded = bbpe.encode(odd, queries.BYTE_RANKS)
    decoded = {r["doc_id"]: bytes(r["bytes"]) for r in bbpe.decode(encoded, queries.BYTE_RANKS).collect()}
    assert all(decoded[i] == (t or "").encode() for i, t in ODD)
    codec = bbpe.ByteBPE(queries.BYTE_RANKS)
    for r in encoded.collect():
        assert r["offsets"] == sorted(r["offsets"]) and len(r["offsets"]) == len(r["ids"])
        if r["ids"]:
            k = len(r["ids"]) // 2
            assert decoded[r["doc_id"]][r["offsets"][k] :].startswith(codec.pieces[r["ids"][k]])
    assert bbpe.encode(odd.limit(0), queries.BYTE_RANKS).count() == 0
    for start, stop in ((0, 7), (3, 4), (5, None), (9, 9), (10**9, None)):
        some = {r["doc_id"]: bytes(r["bytes"]) for r in bbpe.decode(encoded, queries.BYTE_RANKS, start, stop).collect()}
        assert some == {i: (t or "").encode()[start:stop] for i, t in ODD}


def test_bpe_boundaries_at_random():
    import public_tokenizers as P
    import regex

    pattern = regex.compile(P.PATTERN)
    rng = np.random.default_rng(3)
    letters = list("ab'stredvlm \n\t\x85　é漢1½!.\x1c")
    codec = bbpe.ByteBPE(queries.BYTE_RANKS)
    some = ["".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(1500)]
    pieces, counts, offsets = codec.slices(some)
    at = 0
    for text, n in zip(some, counts.tolist(), strict=True):
        assert [p.decode() for p in pieces[at : at + n]] == [m[0] for m in pattern.finditer(text)]
        if n:
            assert offsets[at] == 0
        at += n


def test_long_merge_is_the_same():
    codec = bbpe.ByteBPE(queries.BYTE_RANKS)
    piece = b"thequickbrownfoxandsomemore" * 9
    assert codec._merge_long(piece) == codec.merge(piece[:256]) + () or codec.decode(list(codec._merge_long(piece))) == piece
    assert codec._merge_long(piece[:200]) == codec.merge(piece[:200])


# ------------------------------------------------------------------ lines
def brute_lines(docs):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blanks))
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(key(x)) >= 10 and len(holders.get(key(x), ())) >= 2 and i is not None and i != min(holders[key(x)]))]
        out[i] = (len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_against_brute_force(spark, sf_dir, texts, odd):
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op6_line_dedup(spark, sf_dir).collect()} == brute_lines(texts.items())
    assert {r["doc_id"]: tuple(r)[1:] for r in lines.line_digests(odd).collect()} == brute_lines(ODD)


def test_lines_keep_columns_and_thresholds(spark, odd):
    out = lines.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == len(ODD)
    docs = spark.createDataFrame([(i, "a common line\nown line number %d" % i) for i in range(5)], "doc_id bigint, text string")
    assert lines.dedup_lines(docs, min_docs=6).agg(F.sum("n_dropped")).first()[0] == 0
    assert lines.dedup_lines(docs, min_docs=5).agg(F.sum("n_dropped")).first()[0] == 4
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(lines.LINES_SQL).fetchall()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op6_line_dedup(spark, sf_dir).collect()} == want


# ------------------------------------------------------------------ jpeg
class SlowDecoder:
    """A bit-by-bit progressive decoder, written without regard to speed, to hold the fast one against."""

    def __init__(self, data):
        self.frame, self.codes, self.restart = None, {}, 0
        at = 2
        while True:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if kind == 0xD9:
                break
            at += 2 + size
            if kind == 0xC4:
                while body:
                    n, code, table, k = sum(body[1:17]), 0, {}, 17
                    for length in range(1, 17):
                        for _ in range(body[length]):
                            table[length, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.codes[body[0]] = table
                    body = body[17 + n :]
            elif kind == 0xC2:
                h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(body[5])}
                hm, vm = max(x for x, _ in parts.values()), max(y for _, y in parts.values())
                self.mw, self.mh = -(-w // (8 * hm)), -(-h // (8 * vm))
                self.parts = parts
                self.size = {c: (-(-(-(-w * x // hm)) // 8), -(-(-(-h * y // vm)) // 8)) for c, (x, y) in parts.items()}
                self.coefs = {c: np.zeros((self.mh * y, self.mw * x, 64), int) for c, (x, y) in parts.items()}
            elif kind == 0xDA:
                end = at
                while not (data[end] == 0xFF and data[end + 1] != 0):
                    end += 1
                raw = data[at:end].replace(b"\xff\0", b"\xff")
                self.bits = iter("".join(f"{b:08b}" for b in raw))
                self.scan(body)
                at = end

    def bit(self):
        return int(next(self.bits))

    def take(self, n):
        return int("".join(str(self.bit()) for _ in range(n)) or "0", 2)

    def symbol(self, table):
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table:
                return table[length, code]
        raise AssertionError

    def extend(self, n):
        v = self.take(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

    def scan(self, body):
        names = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
        first, last, approx = body[-3], body[-2], body[-1]
        high, low = approx >> 4, approx & 15
        if len(names) > 1:
            order = [(c, t, self.coefs[c][my * self.parts[c][1] + v, mx * self.parts[c][0] + h]) for my in range(self.mh) for mx in range(self.mw) for c, t in names for v in range(self.parts[c][1]) for h in range(self.parts[c][0])]
        else:
            c, t = names[0]
            w, h = self.size[c]
            order = [(c, t, self.coefs[c][y, x]) for y in range(h) for x in range(w)]
        last_dc, self.run = dict.fromkeys(self.parts, 0), 0
        for c, t, block in order:
            if first == 0:
                if high:
                    block[0] |= self.bit() << low
                else:
                    last_dc[c] += self.extend(self.symbol(self.codes[t >> 4]))
                    block[0] = last_dc[c] << low
            elif high:
                self.refine(block, self.codes[0x10 | t & 15], first, last, low)
            else:
                self.begin(block, self.codes[0x10 | t & 15], first, last, low)

    def begin(self, block, table, k, last, low):
        if self.run:
            self.run -= 1
            return
        while k <= last:
            r, s = divmod(self.symbol(table), 16)
            if s:
                k += r
                block[k] = self.extend(s) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                self.run = (1 << r) + self.take(r) - 1
                return

    def refine(self, block, table, k, last, low):
        def correct(j):
            if self.bit():
                block[j] += (1 if block[j] > 0 else -1) << low

        while k <= last and not self.run:
            r, s = divmod(self.symbol(table), 16)
            if not s and r < 15:
                self.run = (1 << r) + self.take(r)
                break
            new = ((1 if self.bit() else -1) << low) if s else 0
            while k <= last:
                if block[k]:
                    correct(k)
                elif r == 0:
                    if s:
                        block[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if self.run:
            for j in range(k, last + 1):
                if block[j]:
                    correct(j)
            self.run -= 1


class Writer:
    """Encodes arbitrary coefficients progressively, with runs, end-of-band runs and new coefficients in refinements."""

    def __init__(self):
        self.out = []

    def put(self, value, n):
        self.out += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def signed(self, v):
        n = abs(int(v)).bit_length()
        return n, int(v) if v >= 0 else int(v) + (1 << n) - 1


def arbitrary_jpeg(rng, width, height, grey=False):
    """A JPEG of random sparse coefficients and the coefficients."""
    hs = {1: (2, 2), 2: (1, 1), 3: (1, 1)} if not grey else {1: (1, 1)}
    hm, vm = (1, 1) if grey else (2, 2)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    coefs = {}
    for c, (h, v) in hs.items():
        x = np.zeros((mh * v, mw * h, 64), int)
        mask = rng.random(x.shape) < rng.choice([0.02, 0.2, 0.6])
        x[mask] = rng.integers(-40, 41, mask.sum())
        x[..., 0] = rng.integers(-200, 201, x.shape[:2])
        w8, h8 = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        x[h8:, :, 1:] = 0
        x[:, w8:, 1:] = 0
        coefs[c] = x
    seg = pjpeg._segment
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    parts = [b"\xff\xd8", seg(0xDB, b"\0" + bytes(range(1, 65))), seg(0xC4, b"\x00" + table), seg(0xC4, b"\x10" + table)]
    parts.append(seg(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(hs)]) + b"".join(bytes([c, h << 4 | v, 0]) for c, (h, v) in hs.items())))

    def finish(w, names, first, last, high, low):
        parts.extend([pjpeg._scan_header(names, 0, first, last, high, low), pjpeg._coded(np.array(w.out or [1], np.uint8))])

    names = tuple(hs)
    order = [(c, coefs[c][my * hs[c][1] + v, mx * hs[c][0] + h]) for my in range(mh) for mx in range(mw) for c in names for v in range(hs[c][1]) for h in range(hs[c][0])]
    w, last_dc = Writer(), dict.fromkeys(names, 0)
    for c, b in order:
        n, bits = w.signed((b[0] >> 1) - last_dc[c])
        last_dc[c] = b[0] >> 1
        w.put(n, 8)
        w.put(bits, n)
    finish(w, names, 0, 0, 0, 1)
    w = Writer()
    for _, b in order:
        w.put(int(b[0] & 1), 1)
    finish(w, names, 0, 0, 1, 0)
    shift = lambda v, low: (abs(int(v)) >> low) * (1 if v > 0 else -1)
    for c in names:
        h, v = hs[c]
        w8, h8 = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        blocks = [coefs[c][y, x] for y in range(h8) for x in range(w8)]
        for first, last in ((1, 5), (6, 63)):
            w, run = Writer(), 0

            def flush(w, run):
                if run:
                    r = run.bit_length() - 1
                    w.put(r << 4, 8)
                    w.put(run - (1 << r), r)

            for b in blocks:
                zeros = 0
                for k in range(first, last + 1):
                    value = shift(b[k], 1)
                    if not value:
                        zeros += 1
                        continue
                    flush(w, run)
                    run = 0
                    while zeros > 15:
                        w.put(0xF0, 8)
                        zeros -= 16
                    n, bits = w.signed(value)
                    w.put(zeros << 4 | n, 8)
                    w.put(bits, n)
                    zeros = 0
                if zeros:
                    run += 1
            flush(w, run)
            finish(w, (c,), first, last, 0, 1)
            w, run, held = Writer(), 0, []
            for b in blocks:
                zeros, own = 0, []
                last_new = max((k for k in range(first, last + 1) if abs(b[k]) == 1), default=-1)
                for k in range(first, last + 1):
                    a = abs(int(b[k]))
                    if a == 0:
                        zeros += 1
                        continue
                    while zeros > 15 and k <= last_new:
                        flush(w, run)
                        w.out += held
                        w.put(0xF0, 8)
                        w.out += own
                        run, held, own, zeros = 0, [], [], zeros - 16
                    if a > 1:
                        own.append(a & 1)
                        continue
                    flush(w, run)
                    w.out += held
                    w.put(zeros << 4 | 1, 8)
                    w.put(int(b[k] > 0), 1)
                    w.out += own
                    run, held, own, zeros = 0, [], [], 0
                if zeros or own:
                    run += 1
                    held += own
            flush(w, run)
            w.out += held
            finish(w, (c,), first, last, 1, 0)
    return b"".join([*parts, b"\xff\xd9"]), coefs


@pytest.mark.parametrize("seed", range(6))
def test_jpeg_decoder_against_the_slow_one(seed):
    rng = np.random.default_rng(seed)
    data, coefs = arbitrary_jpeg(rng, int(rng.integers(1, 60)), int(rng.integers(1, 60)), grey=seed % 3 == 2)
    slow, fast = SlowDecoder(data), pjpeg.Decoder(data).decode()
    for c in fast.components:
        assert (slow.coefs[c.name] == coefs[c.name]).all()
        assert (c.coefs == coefs[c.name]).all()
    rgb = pjpeg.to_rgb(fast)
    assert rgb.shape == (fast.height, fast.width, 3)


@pytest.mark.parametrize("size", [64, 128, 64 * 6, 64 * 7, 64 * 500])
def test_carrier_read_by_the_slow_decoder(size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    data = pjpeg.store_payload(payload)
    slow, fast = SlowDecoder(data), pjpeg.Decoder(data).decode()
    for c in fast.components:
        assert (slow.coefs[c.name] == c.coefs).all()
    assert pjpeg.load_payload(fast) == payload


def test_inverse_transform_and_colours():
    part = pjpeg.Component(1, 1, 1, 0, 1, 1, np.zeros((1, 1, 64), np.int32))
    part.coefs[0, 0, 0] = 80
    flat = pjpeg.samples(part, np.ones(64, np.int32))
    assert np.allclose(flat, 128 + 10)
    part.coefs[0, 0, 1] = 40  # first horizontal frequency
    x = np.arange(8)
    assert np.allclose(pjpeg.samples(part, np.ones(64, np.int32))[3], 138 + 40 / 4 / np.sqrt(2) * np.cos((2 * x + 1) * np.pi / 16), atol=1e-3)
    frame = pjpeg.Frame(16, 16, [pjpeg.Component(k, h, h, 0, 0, 0, np.zeros((h, h, 64), np.int32)) for k, h in ((1, 2), (2, 1), (3, 1))], {0: np.ones(64, np.int32)}, [])
    frame.components[2].coefs[0, 0, 0] = 8 * 50
    assert (pjpeg.to_rgb(frame) == np.array([round(128 + 1.402 * 50), int(128 - 0.714136 * 50 + 0.5), 128])).all()


def test_jpeg_tables(spark, odd):
    rows = {r["doc_id"]: r for r in pjpeg.carried_digests(odd).collect()}
    for i, t in ODD:
        data = pjpeg.padded((t or "").encode())
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((t or "").encode()), len(data)) and len(data) % 64 == 0 and data
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:])
        media = pjpeg.store_payload(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert bytes(r["rgb"]) == pjpeg.to_rgb(pjpeg.Decoder(media).decode()).tobytes() and len(r["rgb"]) == 3 * r["height"] * r["width"]
    stored = {r["doc_id"]: r for r in pjpeg.carry_texts(odd).collect()}
    assert all(bytes(stored[i]["payload"]) == pjpeg.padded((t or "").encode()) and bytes(stored[i]["media"]) == pjpeg.store_payload(bytes(stored[i]["payload"])) for i, t in ODD)
    assert pjpeg.carried_digests(odd.limit(0)).count() == 0
    media = spark.createDataFrame([(1, bytearray(pjpeg.store_payload(b"x" * 64))), (2, None), (3, bytearray(b"broken")), (4, bytearray(b"\xff\xd8\xff"))], "id int, data binary")
    got = {r["id"]: r for r in pjpeg.decode_column(media, "id", "data").collect()}
    assert got[1]["width"] == 16 and len(got[1]["rgb"]) == 16 * 16 * 3
    assert all(got[k]["rgb"] is None and got[k]["error"] for k in (2, 3, 4))


# ---------------------------------------------------------------- packing
def test_best_fit_decreasing_against_a_plain_search():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 2049, 800))[::-1]
    where, offset = packing.best_fit_decreasing(lengths)
    rooms = {}
    for n, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        fitting = [r for r in rooms.values() if r >= n]
        if fitting:
            assert rooms[w] == min(fitting)
        else:
            assert w not in rooms
            rooms[w] = 2048
        assert o == 2048 - rooms[w]
        rooms[w] -= n


def test_packing_against_the_tokenizer(spark, odd, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORD_TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd.where("doc_id is null or doc_id <> 9").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = packing.pack_documents(docs, queries.WORD_TOKENIZER).toPandas()
    by_doc = {k: g.sort_values("start") for k, g in got.groupby("doc_id", dropna=False)}
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        own = by_doc[r["doc_id"]] if r["doc_id"] is not None else got[got["doc_id"].isna()]
        assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        for s, n, crc in zip(own["start"], own["length"], own["ids_crc32"], strict=True):
            assert zlib.crc32(ids[s : s + n].tobytes()) == crc
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 2048 and (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all()
    assert got["length"].sum() / (2048 * got["sequence_id"].nunique()) > 0.95
    assert packing.pack_documents(odd.limit(0), queries.WORD_TOKENIZER).count() == 0


def test_words_through_the_cache_at_random():
    rng = np.random.default_rng(4)
    from tokenizers import Tokenizer

    letters = [*"aAéÉß ΣİıÅ\u0307\u0301'.,!\n\x1c\x85　漢½Ⅷ1\x01", " \x01 ", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "'s ", " 'Ve"]
    some = ["".join(rng.choice(letters, rng.integers(0, 20))) for _ in range(4000)]
    tokenizer = packing.WordTokenizer(queries.WORD_TOKENIZER)
    plain = Tokenizer.from_file(queries.WORD_TOKENIZER).encode_batch(some, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in tokenizer.ids(some)] == [e.ids for e in plain]


# ------------------------------------------------------------- embeddings
def test_vectors_against_brute_force(spark):
    """Copies at and around the threshold; at least nine in ten links must be found, and none that is not there."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 32))
    for k in range(0, 1400, 4):
        x[k + 1] = x[k] + rng.standard_normal(32) * rng.uniform(0.02, 0.33) * np.linalg.norm(x[k]) / np.sqrt(32)
    x[300:420] = x[300] + rng.standard_normal((120, 32)) * 0.05
    vectors = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = embed_dedup.similar_vectors(vectors).toPandas().sort_values("vec_id", ignore_index=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = near.sum(1)
    assert (got["n_links"].to_numpy() <= links).all()
    assert got["n_links"].sum() >= 0.97 * links.sum()
    i, j = np.nonzero(np.triu(near))
    want = smallest_reachable(range(len(x)), list(zip(i.tolist(), j.tolist(), strict=True)))
    assert np.mean([want[k] == c for k, c in zip(got["vec_id"], got["component_id"], strict=True)]) > 0.97
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_vectors_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((40, 16)), 5, axis=0) + rng.standard_normal((200, 16)) * 0.03
    vectors = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(embed_dedup.VECTORS_SQL).fetchall())
    assert sum(w[1] for w in want) >= 800 and sorted(map(tuple, embed_dedup.similar_vectors(vectors).collect())) == want


@pytest.mark.parametrize("share_rows", [200, embed_dedup.SHARE_ROWS])
def test_divided_cells_lose_hardly_a_link(spark, monkeypatch, share_rows):
    """Few cells of thousands of rows, divided into parts, and one group of near copies that stays whole."""
    for name, value in (("MAX_CELLS", 2), ("SPLIT_ROWS", 300), ("CELL_ROWS", 32), ("PART_SAMPLE", 900), ("SHARE_ROWS", share_rows)):
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(14)
    centre = rng.standard_normal((40, 32))
    x = np.repeat(centre, 60, axis=0) + rng.standard_normal((2400, 32)) * 0.9
    x[1::2] = x[::2] + rng.standard_normal((1200, 32)) * rng.uniform(0.02, 0.33, (1200, 1)) * np.linalg.norm(x[::2], axis=1, keepdims=True) / np.sqrt(32)
    x = np.concatenate([x, centre[0] * 3 + rng.standard_normal((500, 32)) * 0.05])
    rows = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id bigint, vec array<double>")
    placed = embed_dedup.assigned(rows, embed_dedup.fit_centres(rows, len(x)))
    cells = embed_dedup.divided(placed)
    sizes = lambda t: {r["c"]: r["count"] for r in t.select(F.explode("cells").alias("c")).groupBy("c").count().collect()}
    before, after = sizes(placed), sizes(cells)
    assert cells.count() == len(x) and sum(n * n for n in after.values()) < 0.6 * sum(n * n for n in before.values())
    vectors = rows.withColumnRenamed("vec", "embedding")
    got = embed_dedup.similar_vectors(vectors).toPandas().sort_values("vec_id", ignore_index=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert (got["n_links"].to_numpy() <= near.sum(1)).all() and got["n_links"].sum() >= 0.97 * near.sum()
    single = near[:2400, :2400].sum(1)
    assert got["n_links"].to_numpy()[:2400][single == 1].sum() >= 0.93 * (single == 1).sum()


def test_vectors_in_tiny_tiles(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((6, 16)), 20, axis=0) + rng.standard_normal((120, 16)) * 0.01
    vectors = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id bigint, vec array<double>")
    centres = {16: embed_dedup.spherical_kmeans(embed_dedup._unit(x), 5)}
    found = embed_dedup.find_links(embed_dedup.assigned(vectors, centres, 0.3), 0.95, tile_rows=7).groupBy("vec_id").agg(F.sum("links").alias("n"))
    assert {r["vec_id"]: r["n"] for r in found.collect()} == dict.fromkeys(range(120), 19)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("node", F.lit(0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.similar_vectors(vectors).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, None))
    assert embed_dedup.similar_vectors(vectors.limit(0)).count() == 0


# ------------------------------------------------------------------- html
PAGES = [
    ("<p>a<p>b", "a\n\nb"), ("x < y &amp; z", "x < y & z"), ("", ""), (None, ""),
    ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head&nbsp;line</h1><p>One\n two<br>three</p><aside>Side</aside><div class='comments'><p>Reader says</p></div></article><footer>Foot</footer></body></html>", "Head line\n\nOne two three"),
    ("<body><div id=sidebar><ul><li><a>l1</a></ul></div><div class=post><p>A long paragraph about something, with words.</p><p>Another long paragraph about something else.</p></div><form>Name <input></form></body>", "A long paragraph about something, with words.\n\nAnother long paragraph about something else."),
    ("<article><p>kept<script>var a='</p>';</script></p><!-- not -- this --><style>p{}</style><p class='cookie-notice'>cookies</p></article>", "kept"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<body><div class='content no-sidebar overflow-hidden'><div class='entry-header'><h1>Title</h1></div><p>Some text of the entry, long enough.</p></div><div class='site-header'>Menu</div></body>", "Title\n\nSome text of the entry, long enough."),
    ("<body><form action=/><main><h1>T</h1><p>Whole page in a form.</p><form><p>no</p></form></main></form></body>", "T\n\nWhole page in a form."),
    ("<body><form><p>Your name</p></form></body>", ""),
    ("<body><header><h1>Site</h1></header><main><p>Main text here.</p><section id='comments'><p>c1</p></section></main><div role='alert'>Notice</div></body>", "Main text here."),
    ("<article><p>a <b>bold <i>both</b> it</i></p><p title='x>y'>q</p></article>", "a bold both it\n\nq"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert html_density.main_text(html) == text


def test_pages(spark, sf_dir):
    """The article of each page, read off its own tags."""
    import html
    import re

    for r, page in zip(queries.op10_html_text(spark, sf_dir).orderBy("page_id").collect(), table(spark, sf_dir, "pages").orderBy("page_id").collect(), strict=True):
        inner = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        want = [t for t in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts) if t]
        assert r["text"] == "\n\n".join(want) and r["n_chars"] == len(r["text"]) and r["url"] == page["url"]
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>x")], "page_id bigint, url string, html string")
    assert sorted(r["n_chars"] for r in html_density.extract_pages(odd).collect()) == [0, 0, 1]
    assert html_density.extract_pages(odd.limit(0)).count() == 0


# ------------------------------------------------------------------- warc
def test_warc_records(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = warc.build_derivatives(warc.page_responses(pages), "page_id", "record").collect()
    assert len(got) == 2 * pages.count()
    source = {r["page_id"]: bytes(r["record"]) for r in warc.page_responses(pages).collect()}
    for r in got:
        headers, block = warc.read_record(source[r["page_id"]])
        own, body = warc.read_record(bytes(r["record"]))
        assert body == bytes(r["block"]) and warc.value(own, "WARC-Block-Digest") == warc.digest(body)
        assert r["refers_to"] == warc.value(headers, "WARC-Record-ID") and r["target_uri"] == warc.value(headers, "WARC-Target-URI")
        if r["record_type"] == "metadata":
            fields = dict(line.split(": ", 1) for line in body.decode().strip().split("\r\n") if ": " in line)
            assert fields["source-payload-digest"] == warc.value(headers, "WARC-Payload-Digest") == r["source_payload_digest"]
            assert fields["source-http-Content-Type"] == "text/html; charset=utf-8"
    both = {}
    for r in got:
        both.setdefault(r["page_id"], {})[r["record_type"]] = r
    for pair in both.values():
        assert pair["metadata"]["concurrent_to"] == pair["conversion"]["record_id"] != pair["metadata"]["record_id"]
    again = list(warc.read_records(b"".join(bytes(r["record"]) for r in got)))
    assert again == [bytes(r["record"]) for r in got]


def test_warc_charset_and_broken_records(spark, tmp_path):
    body = "<p>caf\u00e9</p>".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Long: a\r\n b\r\n\r\n" + body
    good = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://a/\r\nInjected: yes")], http)
    request = warc.write_record([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n")
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"nonsense")), (4, bytearray(request)), (5, bytearray(good[:-20])), (None, bytearray(good))]
    responses = spark.createDataFrame(rows, "id int, record binary").withColumn("block", F.lit(1))
    got = warc.build_derivatives(responses, "id", "record").collect()
    by = {(r["id"], r["record_type"]): r for r in got}
    assert bytes(by[1, "conversion"]["block"]).decode() == "caf\u00e9" and (None, "conversion") in by
    assert by[2, None]["error"] and by[3, None]["error"] and by[5, None]["error"] and not [r for r in got if r["id"] == 4]
    assert b"source-http-X-Long: a b" in bytes(by[1, "metadata"]["block"]) and b"\r\nInjected" not in bytes(by[1, "metadata"]["record"])
    made = warc.build_derivatives(responses, "id", "record")
    warc.write_warc(made, str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("part-*.warc.gz"))
    assert files and not list((tmp_path / "w").glob("*.txt*"))
    written = [r for f in files for r in warc.read_records(gzip.decompress(f.read_bytes()))]
    assert sorted(written) == sorted(bytes(r["record"]) for r in made.collect() if r["record"] is not None) and len(written) == 4


# ---------------------------------------------------------------- quality
def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.classify_documents(docs, train).join(held, "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in got)
    assert right >= 0.97 * len(got)
    assert sum(r["kept"] for r in got if r["quality"]) >= 0.99 * sum(r["quality"] for r in got)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.classify_documents(odd, labels).count() == len(ODD)
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.classify_documents(odd, labels.limit(0)).where("p_document = 0.5").count() == len(ODD)
    assert quality.classify_documents(odd.limit(0), labels).count() == 0


# --------------------------------------------------------------- language
def test_scores_tell_quality_apart(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_lm_cross_entropy(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("score", "quality").toPandas()
    ranks = got["score"].rank()
    bad = got["quality"] == 0
    assert (ranks[bad].mean() - (bad.sum() + 1) / 2) / (~bad).sum() > 0.95
