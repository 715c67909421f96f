"""Lossless WebP: published and hand-made files, all transforms, broken files, and texts there and back."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from itemforge.llm import media, webp

#: A public one-pixel lossless file: transparent black.
ONE = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
#: A public one-pixel lossy file.
LOSSY = base64.b64decode("UklGRiIAAABXRUJQVlA4IBYAAAAwAQCdASoBAAEADsAOJaQAA3AAAAAA")


def image(kind, h, w, seed=0):
    rng = np.random.default_rng(seed)
    noise = rng.integers(0, 1 << 32, (h, w), dtype=np.uint32)
    if kind == "noise":
        return noise
    if kind == "few":
        return noise.ravel()[rng.integers(0, min(noise.size, 5), (h, w))]
    slope = np.add.outer(np.arange(h), np.arange(w))[..., None] * np.array([1, 2, 3, 0])
    return webp.joined(slope + rng.integers(0, 9, (h, w, 4)) & 255)


SIZES = [(1, 1), (1, 9), (6, 1), (9, 13), (40, 33)]


@pytest.mark.parametrize("kind", ["noise", "few", "smooth"])
def test_codes_copies_and_cache(kind):
    for h, w in SIZES:
        p = image(kind, h, w)
        for cache in (0, 1, 6, 11):
            for text in ("", "alike", "preset"):
                assert (webp.decode(webp.encode(p, cache=cache, text=text)) == p).all()
        numbers = np.random.default_rng(1).integers(0, 4, (-(-h >> 2), -(-w >> 2)))
        assert (webp.decode(webp.encode(p, groups=(2, numbers), cache=3)) == p).all()


@pytest.mark.parametrize("kind", ["noise", "smooth"])
def test_transforms(kind):
    for h, w in SIZES:
        p, rng = image(kind, h, w), np.random.default_rng(2)
        tiles = (-(-h >> 3), -(-w >> 3))
        predict = (webp.PREDICT, 3, rng.integers(0, 16, tiles))
        cross = (webp.CROSS, 3, rng.integers(0, 1 << 32, tiles, dtype=np.uint32))
        for t in ((predict,), (cross,), ((webp.GREEN,),), (predict, cross, (webp.GREEN,)), ((webp.GREEN,), cross, predict)):
            assert (webp.decode(webp.encode(p, t, cache=4)) == p).all()
    for mode in range(14):  # every mode over a whole image
        p = image(kind, 12, 11, mode)
        assert (webp.decode(webp.encode(p, ((webp.PREDICT, 4, np.full((1, 1), mode)),))) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    p = table[rng.integers(0, colours, (21, 37))]
    bundled = -(-37 >> webp.bundle(len(np.unique(p))))
    for t in (((webp.PALETTE,),), ((webp.PALETTE,), (webp.PREDICT, 2, rng.integers(0, 14, (6, -(-bundled >> 2)))))):
        assert (webp.decode(webp.encode(p, t)) == p).all()
    with pytest.raises(ValueError):
        webp.encode(image("noise", 20, 20), ((webp.PALETTE,),))


def scalar_prediction(mode, L, T, TL, TR):
    """One pixel's expectation (blue, green, red, alpha) as the specification words it."""
    def avg(a, b):
        return [(x + y) // 2 for x, y in zip(a, b)]

    def clamp(v):
        return max(0, min(255, v))

    if mode == 11:
        p = [a + b - c for a, b, c in zip(L, T, TL)]
        return L if sum(abs(x - y) for x, y in zip(p, L)) < sum(abs(x - y) for x, y in zip(p, T)) else T
    return {0: [0, 0, 0, 255], 1: L, 2: T, 3: TR, 4: TL, 5: avg(avg(L, TR), T), 6: avg(L, TL), 7: avg(L, T), 8: avg(TL, T), 9: avg(T, TR), 10: avg(avg(L, TL), avg(T, TR)),
            12: [clamp(a + b - c) for a, b, c in zip(L, T, TL)], 13: [clamp(a + int((a - c) / 2)) for a, c in zip(avg(L, T), TL)]}[mode]


@pytest.mark.parametrize("mode", range(14))
def test_prediction_as_specified(mode):
    four = np.random.default_rng(mode).integers(0, 256, (4, 50, 4))
    four[:, :5] = four[:1, :5]
    got = webp.predicted(mode, *four)
    assert [scalar_prediction(mode, *(x[i].tolist() for x in four)) for i in range(50)] == np.broadcast_to(got, (50, 4)).tolist()


def bits(*fields):
    """A file of these (value, bits), 3 pixels wide and 2 high."""
    n = value = 0
    for v, k in ((0x2F, 8), (2, 14), (1, 14), (0, 1), (0, 3), *fields):
        value |= v << n
        n += k
    body = value.to_bytes(-(-n // 8), "little")
    data = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(data)).to_bytes(4, "little") + b"WEBP" + data


def test_hand_made_stream():
    """Subtracted green, a cache of one bit, simple codes, a code of three lengths, a near copy, and a cache hit."""
    one = ((1, 1), (0, 1), (1, 1))  # a simple code of one symbol of eight bits
    # green alphabet 256 + 24 + 2: symbols 11 (length 1), 256 = copy of one (2), 280 and 281 = cache (3 each)
    # lengths 1, 2, 3 and runs of zeros (18) have codes of two bits each: 00 01 10 11, written from the top bit
    sizes = [0, 2, 0, 2, 2, 2]  # in the order 17, 18, 0, 1, 2, 3
    code = {1: 0b00, 2: 0b10, 3: 0b01, 18: 0b11}

    def zeros(n):
        return [(code[18], 2), (n - 11, 7)]

    green = [(0, 1), (2, 4), *[(s, 3) for s in sizes], (0, 1), *zeros(11), (code[1], 2), *zeros(138), *zeros(106), (code[2], 2), *zeros(23), (code[3], 2), (code[3], 2)]
    literal, copy = (0, 1), (0b01, 2)
    distances = ((1, 1), (1, 1), (1, 1), (0, 8), (3, 8))  # distance prefixes 0 (code 1: the pixel above) and 3 (code 4)
    f = [(1, 1), (webp.GREEN, 2), (0, 1), (1, 1), (1, 4), (0, 1), *green, *one, (5, 8), *one, (7, 8), *one, (200, 8), *distances]
    pixel = 200 << 24 | 5 << 16 | 11 << 8 | 7
    slot = (pixel * webp.HASH & 0xFFFFFFFF) >> 31
    hit = (0b011 if slot == 0 else 0b111, 3)
    # literal, hit, literal, then copies of one pixel from the row above, a hit, and a literal
    p = webp.decode(bits(*f, literal, hit, literal, copy, (0, 1), hit, literal))
    want = 200 << 24 | (5 + 11) << 16 | 11 << 8 | (7 + 11)
    assert p.shape == (2, 3) and (p == want).all()
    raw = bits(*f, literal, hit, literal)
    with pytest.raises(webp.NotLossless):
        webp.decode(raw)


def test_published_file_and_distances():
    assert webp.decode(ONE).tolist() == [[0]]
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_broken_files():
    good = webp.encode(image("smooth", 8, 8))
    for raw in (b"", b"RIFF", LOSSY, good[:20], good[:-6], good[:20] + b"\x30" + good[21:], b"RIFF" + bytes(40)):
        with pytest.raises(webp.NotLossless):
            webp.decode(raw)
    rng = np.random.default_rng(0)
    for _ in range(400):  # whatever a bit that is flipped does, it ends in pixels or in that error
        raw = bytearray(good)
        raw[rng.integers(21, len(raw))] ^= 1 << rng.integers(8)
        try:
            webp.decode(bytes(raw))
        except webp.NotLossless:
            pass


def test_lengths_fit_and_fill():
    rng = np.random.default_rng(5)
    for counts in (np.array([1, 1]), 2 ** np.arange(30), rng.integers(0, 9, 300), np.ones(256, int)):
        for longest in (9, 15):
            n = webp.code_lengths(counts, longest)
            assert n.max() <= longest and (n > 0).tolist() == (counts > 0).tolist() and sum(2.0 ** -n[n > 0]) == 1


TEXTS = [None, "", "a", "x" * 63, "y" * 64, "z" * 65, "Ünïcödé 漢字 🙂\x00\n" * 9, "same text " * 500, "".join(map(chr, range(32, 2000))), " ".join(str(i * i) for i in range(20_000))]


def test_texts_there_and_back(spark, monkeypatch):
    rows = [(None if i == 3 else i % 8, t) for i, t in enumerate([*TEXTS, *TEXTS])]
    df = spark.createDataFrame([(i, t, b"x", "m", 3) for i, t in rows], "doc_id long, text string, media binary, feature string, id int").repartition(3)
    out = media.media_columns(df).collect()
    assert len(out) == len(rows)
    seen = {}
    for r in out:
        seen.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len(TEXTS) - 1  # null is as empty
    for _, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        (row,) = seen[hashlib.sha256(payload).hexdigest()]
        store = media.stored(payload)
        assert row[:2] == (len(raw), len(payload)) and row[3] == zlib.crc32(payload[-64:]) and row[4:6] == (len(store), hashlib.sha256(store).hexdigest())
        assert media.samples_of(store)[2][: len(payload)] == payload
    assert media.media_columns(df.limit(0)).collect() == []


def test_long_payloads_are_several_images(monkeypatch):
    payload = np.random.default_rng(1).integers(97, 110, 64 * 5003, dtype=np.uint8).tobytes()
    for page, rows in ((1 << 12, 1 << 14), (1 << 14, 300), (1 << 20, 1 << 14)):
        monkeypatch.setattr(media, "PAGE", page)
        monkeypatch.setattr(media, "MOST_ROWS", rows)
        raw = media.stored(payload)
        widths, heights, four = media.samples_of(raw)
        assert four[: len(payload)] == payload and not any(four[len(payload) :]) and len(widths) == -(-len(payload) // 4 // page) and max(heights) <= 1 << 14


def test_read_images(spark):
    p = image("smooth", 5, 6)
    rows = [(1, webp.encode(p, ((webp.GREEN,),))), (2, None), (3, b""), (4, LOSSY), (5, ONE), (6, b"junk"), (7, ONE + webp.encode(p))]
    df = spark.createDataFrame([(i, bytearray(r) if r is not None else None, [1, 2], None) for i, r in rows], "n int, picture binary, id array<int>, text string").repartition(2)
    out = {r.n: r for r in media.read_images(df, "picture").collect()}
    assert bytes(out[1].samples) == webp.samples(p).tobytes() and (out[1].widths, out[1].heights, out[1].id, out[1].text, out[1].error) == ([6], [5], [1, 2], None, None)
    assert all(out[i].samples is None and out[i].error for i in (2, 3, 4, 6))
    assert out[5].feature == "1:1x1:0,0,0,0:0" and out[7].widths == [1, 6]


def test_short_texts_have_codes_of_their_own(monkeypatch):
    """Every text's samples are counted and coded, however short."""
    seen, real = [], webp.code_lengths
    monkeypatch.setattr(media, "PALETTE_USE", 1 << 20)
    monkeypatch.setattr(webp, "code_lengths", lambda counts, *a: seen.append(counts) or real(counts, *a))
    texts = [(b"The cat sat on the mat. " * 3 + bytes(range(33, 121)))[:128], bytes(range(64)) * 2, b"0123456789abcdef" * 12]
    for text in texts:
        seen.clear()
        raw = media.stored(text)
        assert media.samples_of(raw)[2][: len(text)] == text
        assert [int(c.sum()) for c in seen if len(c) == webp.LITERALS] and all(c.sum() <= 3 * len(text) for c in seen)


def test_lengths_of_codes_are_read_as_written():
    rng = np.random.default_rng(9)
    for alphabet in (webp.DISTANCES, webp.LITERALS, webp.LITERALS + webp.LENGTHS + 64):
        for used in (1, 2, 3, 30, alphabet):
            counts = np.zeros(alphabet, np.int64)
            counts[rng.choice(alphabet, min(used, alphabet), replace=False)] = rng.integers(1, 10**6, min(used, alphabet))
            lengths, out = webp.code_lengths(counts), webp.Stream()
            out.many(*webp.coded(lengths))
            bits = webp.Bits(out.to_bytes() + b"\xff")
            assert (webp.read_code(bits, alphabet) == webp.code_table(lengths)).all()


def test_short_texts_are_written_and_read_together(monkeypatch):
    """What numpy does for short texts is done for many of them at once, and gives each what it gets alone."""
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in rng.integers(1, 9, 60)]
    texts = [b" ".join(words[i] for i in rng.integers(0, rng.integers(2, 60), n)) for n in rng.integers(0, 400, 300)]
    payloads = [t + bytes(-len(t) % 64 if t else 64) for t in [*texts, b"z" * 5000, bytes(rng.integers(0, 256, 1 << 19, dtype=np.uint8))]]
    alone = [media.stored(p) for p in payloads]
    calls, write, read = [], webp.encode_texts, webp.read_tokens
    monkeypatch.setattr(webp, "encode_texts", lambda images, *a: calls.append(len(images)) or write(images, *a))
    assert list(media.stored_each(payloads)) == alone and len(calls) <= 6 and max(calls) > 100
    # whole, missing and broken ones among each other
    raws = []
    for i, raw in enumerate(alone):
        broken = bytearray(raw)
        broken[rng.integers(21, len(raw))] ^= 1 << rng.integers(8)
        raws += [raw, None if i % 3 else b"", bytes(broken), raw[: rng.integers(1, len(raw))], raw + alone[i - 1]]
    want = []
    for raw in raws:
        try:
            want.append(media.samples_of(raw) if raw else None)
        except webp.NotLossless as e:
            want.append(str(e))
    one_by_one = []
    monkeypatch.setattr(webp, "read_tokens", lambda *a: one_by_one.append(a) or read(*a))
    assert [str(x) if isinstance(x, webp.NotLossless) else x for x in media.samples_each(raws)] == want
    one_by_one.clear()
    assert [x[2][: len(p)] for x, p in zip(media.samples_each(alone), payloads, strict=True)] == payloads and len(one_by_one) <= webp.FEWEST
