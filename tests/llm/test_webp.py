import base64
import hashlib
import math
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from terravane.llm import webp as W
from terravane.llm.queries import op4_webp


def channels(rgb):
    return np.concatenate([np.full((*rgb.shape[:2], 1), 255, np.uint8), rgb], axis=2)


def stream(width, height, build):
    w = W.BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    build(w)
    return W.Vp8l(w.bytes()).decode()


def _flat_codes(w):
    """Codes of 8 bits for green, red and blue; one symbol for alpha and distance."""
    for _ in range(3):
        w.put(0, 1)
        w.put(12 - 4, 4)
        for symbol in W.LENGTH_ORDER[:12]:
            w.put(int(symbol == 8), 3)
        w.put(1, 1)  # 256 lengths follow, each of no bits
        w.put(3, 3)
        w.put(256 - 2, 8)
    w.put(1 | 0 << 1 | 1 << 2 | 255 << 3, 11)
    w.put(1, 4)  # one symbol of one bit: 0


def flat_image(w, argb, outer=True):
    """Literal pixels; alpha 255."""
    w.put(0, 2 if outer else 1)
    _flat_codes(w)
    for a, r, g, b in argb.reshape(-1, 4).tolist():
        for v in (g, r, b):
            w.put(int(f"{v:08b}"[::-1], 2), 8)


def test_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 5), (70, 64)):
        rgb = rng.integers(0, 256, (*shape, 3), dtype=np.uint8)
        assert (W.decode(W.encode(rgb)) == channels(rgb)).all()


@pytest.mark.parametrize("payload", [b"", b"x", bytes(range(256)) * 9, b"a" * (W.WIDTH * W.ROWS + 1)])
def test_payloads(payload):
    back = W.load(W.store(payload)).tobytes()
    assert back.rstrip(b" ") == payload.rstrip(b" ") and len(back) % 192 == 0 and len(back) >= 192


def test_subtract_green_and_cross_colour():
    rng = np.random.default_rng(2)
    res, mult = rng.integers(0, 256, (4, 4, 4), dtype=np.uint8), rng.integers(0, 256, (1, 1, 4), dtype=np.uint8)

    def build(w):
        w.put(1 | 2 << 1, 3)
        w.put(1 | 1 << 1 | 0 << 3, 6)
        flat_image(w, mult, outer=False)
        w.put(0, 1)
        flat_image(w, res)

    got = stream(4, 4, build)
    s8 = lambda v: v - 256 if v > 127 else v
    _, rb, gb, gr = (s8(int(v)) for v in mult[0, 0])
    for y in range(4):
        for x in range(4):
            _, r, g, b = map(int, res[y, x])
            r2 = (r + (gr * s8(g) >> 5)) & 255
            b2 = (b + (gb * s8(g) >> 5) + (rb * s8(r2) >> 5)) & 255
            assert got[y, x].tolist() == [255, (r2 + g) & 255, g, (b2 + g) & 255]


def predicted(mode, left, top, corner, right):
    """One pixel's prediction, channel by channel."""
    half = lambda a, b: [(p + q) // 2 for p, q in zip(a, b)]
    clip = lambda v: min(max(v, 0), 255)
    if mode == 11:
        guess = [x + t - c for x, t, c in zip(left, top, corner)]
        far = lambda v: sum(abs(a - b) for a, b in zip(guess, v))
        return left if far(left) < far(top) else top
    if mode == 12:
        return [clip(x + t - c) for x, t, c in zip(left, top, corner)]
    if mode == 13:
        return [clip(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner)]
    return [
        [255, 0, 0, 0], left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top),
        half(corner, top), half(top, right), half(half(left, corner), half(top, right)),
    ][mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    rng = np.random.default_rng(mode)
    want = channels(rng.integers(0, 256, (9, 10, 3), dtype=np.uint8))
    res = np.zeros_like(want)
    for y in range(9):
        for x in range(10):
            at = lambda v, u: want.reshape(-1, 4)[v * 10 + u].tolist()
            guess = [255, 0, 0, 0] if not x + y else at(y, x - 1) if not y else at(y - 1, x) if not x else predicted(mode, at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), at(y - 1, x + 1))
            res[y, x] = (want[y, x].astype(int) - guess) & 255
    data = np.full((3, 3), mode << 8, np.uint32)
    assert (W.unpredict(res, 2, data) == want).all()
    assert (W.predictions(want, mode)[1:, 1:] == (want.astype(int) - res)[1:, 1:] & 255).all()


def used(monkeypatch, samples):
    """What the decoder meets in an encoded image: transforms, cached colours, copies."""
    seen = set()
    for name in ("unpredict", "uncross"):
        f = getattr(W, name)
        monkeypatch.setattr(W, name, lambda *a, f=f, name=name: (seen.add(name), f(*a))[1])
    copies, code, puts = W._copies, W.Vp8l.code, W.BitWriter.put
    monkeypatch.setattr(W, "_copies", lambda *a: (r := copies(*a), seen.add("copies") if r[0] else None)[0])
    monkeypatch.setattr(W.Vp8l, "code", lambda self, n: (seen.add("cache") if n > 280 else None, code(self, n))[1])
    monkeypatch.setattr(W.BitWriter, "put", lambda self, v, n: (seen.add("palette") if n == 11 and v & 7 == 7 else seen.add("green") if (v, n) == (5, 3) else None, puts(self, v, n))[1])
    media = W.encode(samples)
    back = W.decode(media)[..., 1:] if samples.ndim == 3 else W.decode(media)[..., 2]
    assert (back == samples).all()
    return seen, len(media)


def test_content_chooses_the_transforms(monkeypatch):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:100, :80]
    smooth = np.stack([3 * x + y * y // 9, x * 2 + y, y * 2 + x * x // 30], axis=2).astype(np.uint8)
    assert "unpredict" in used(monkeypatch, (smooth + rng.integers(0, 3, smooth.shape)).astype(np.uint8))[0]
    assert "unpredict" in used(monkeypatch, smooth[..., 0])[0]
    green = rng.integers(0, 256, (60, 64), dtype=np.uint8)
    s8 = green.astype(np.int8).astype(int)
    tinted = np.stack([(s8 * 20 >> 5) + rng.integers(0, 3, green.shape), green, (s8 * -9 >> 5)], axis=2).astype(np.uint8)
    assert "uncross" in used(monkeypatch, tinted)[0]
    few = rng.integers(0, 256, (9, 3), dtype=np.uint8)[rng.integers(0, 9, (50, 33))]
    assert "palette" in used(monkeypatch, few)[0]
    many = rng.integers(0, 256, (3000, 3), dtype=np.uint8)[np.minimum(rng.zipf(1.3, (60, 64)), 2999)]
    assert "cache" in used(monkeypatch, many)[0]
    assert "copies" in used(monkeypatch, np.tile(rng.integers(0, 256, (7, 64, 3), dtype=np.uint8), (5, 1, 1)))[0]
    text = np.frombuffer(b"some words of a text that comes again and again, some words of " * 192, np.uint8).reshape(-1, 192)
    seen, size = used(monkeypatch, text)
    assert {"green", "copies"} <= seen and size < text.size / 8


def test_a_file_of_another_encoder():
    """The one-pixel lossless file that browsers are asked with whether they know the format: a clear pixel."""
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert W.decode(data).tolist() == [[[0, 0, 0, 0]]]


@pytest.mark.parametrize("seed", range(12))
def test_any_samples(seed):
    rng = np.random.default_rng(seed)
    shape = tuple(rng.integers(1, 40, 2))
    kind = rng.integers(0, 4)
    top = 256 if kind == 0 else 2 if kind == 1 else 17 if kind == 2 else 5
    rgb = rng.integers(0, top, (*shape, 3), dtype=np.uint8)
    assert (W.decode(W.encode(rgb))[..., 1:] == rgb).all() and (W.decode(W.encode(rgb[..., 0]))[..., 2] == rgb[..., 0]).all()


def test_skewed_counts_keep_within_the_longest_code():
    count = np.array([1 << min(k, 40) for k in range(30)])
    for most in (7, 15):
        lengths = W.code_lengths(count, most)
        assert lengths.max() <= most and sum(2.0 ** -lengths) == 1


def test_truncated_stream_raises():
    media = W.store(bytes(range(256)) * 12)
    with pytest.raises((ValueError, IndexError)):
        W.load(media[: len(media) // 2])


def test_palette_with_packed_indices():
    colours = np.array([[[255, 10, 20, 30], [255, 200, 100, 50]]], np.uint8)
    delta = colours.copy()
    delta[0, 1] = colours[0, 1] - colours[0, 0]

    def build(w):
        w.put(1 | 3 << 1 | 1 << 3, 11)
        flat_image(w, delta, outer=False)
        w.put(0, 1)
        flat_image(w, np.array([[[255, 0, 0b01101, 0]], [[255, 0, 0b10010, 0]]], np.uint8))

    got = stream(5, 2, build)
    assert got[0, :, 1].tolist() == [200, 10, 200, 200, 10] and got[1, :, 1].tolist() == [10, 200, 10, 10, 200]


def test_back_reference_and_colour_cache():
    def build(w):
        w.put(0, 1)
        w.put(1 | 1 << 1, 5)  # a cache of one bit
        w.put(0, 1)
        # green: lengths 7 -> 2, 256 + 3 (copy 4) -> 2, 280 and 281 (cache) -> 2 as a code of code lengths
        w.put(0, 1)
        w.put(15, 4)
        small = {0: 2, 2: 2, 18: 2, 17: 2}
        for s in W.LENGTH_ORDER:
            w.put(small.get(s, 0), 3)
        w.put(0, 1)
        code = {0: 0b00, 2: 0b10, 17: 0b01, 18: 0b11}  # canonical 00 01 10 11, bits in reading order

        def zeros(n):
            while n:
                k = min(n, 138)
                if k >= 11:
                    w.put(code[18], 2)
                    w.put(k - 11, 7)
                elif k >= 3:
                    w.put(code[17], 2)
                    w.put(k - 3, 3)
                else:
                    w.put(code[0], 2)
                    k = 1
                n -= k

        at = 0
        for s in (7, 259, 280, 281):
            zeros(s - at)
            w.put(code[2], 2)
            at = s + 1
        for symbol in (1, 2):
            w.put(1 | 0 << 1 | 1 << 2 | symbol << 3, 11)
        w.put(1 | 0 << 1 | 1 << 2 | 255 << 3, 11)
        w.put(1 | 0 << 1 | 1 << 2 | 1 << 3, 11)  # distance symbol 1: the pixel to the left
        w.put(0b00, 2)  # literal
        w.put(0b10, 2)  # copy 4
        key = (0x1E35A7BD * 0xFF010702 & 0xFFFFFFFF) >> 31
        w.put(0b11 if key else 0b01, 2)

    assert stream(6, 1, build)[0].tolist() == [[255, 1, 7, 2]] * 6


def test_tokens_are_looked_up_at_once():
    """No step of the interpreter for each literal."""
    rng = np.random.default_rng(3)
    payload = rng.choice(np.arange(60, 100, dtype=np.uint8), 192 * 60).tobytes()
    media = W.store(payload)
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count if frame.f_code.co_filename == W.__file__ else None

    before = sys.gettrace()
    sys.settrace(count)
    try:
        back = W.load(media)
    finally:
        sys.settrace(before)
    assert back.tobytes() == payload and steps < len(payload)


@pytest.mark.parametrize("stretch", [1, 7, 64, W.STRETCH])
def test_stretches_of_a_stream(monkeypatch, stretch):
    """Tokens across the borders of stretches, codes of 15 bits, long copies, and one value only."""
    monkeypatch.setattr(W, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    skewed = np.repeat(np.arange(20), np.maximum(1, (2.0 ** np.arange(20) / 400).astype(int))).astype(np.uint8)
    rng.shuffle(skewed)
    words = [bytes(rng.integers(97, 123, k, dtype=np.uint8)) for k in (3, 9, 40)]
    text = b" ".join(words[k] for k in rng.integers(0, 3, 150))
    for payload in (skewed.tobytes(), text, b"ab" * 6000, b"\0" * 500, b"q" * 192):
        assert W.load(W.store(payload)).tobytes().rstrip(b" ") == payload


def test_damaged_streams_raise_or_differ():
    rng = np.random.default_rng(5)
    payload = b" ".join(rng.choice([b"some", b"words", b"again", b"and", b"longer passages"], 400).tolist())
    media = bytearray(W.store(payload))
    for at in rng.integers(40, len(media), 40).tolist():
        changed = media.copy()
        changed[at] ^= 1 << at % 8
        try:
            assert W.load(bytes(changed)).shape[1] > 0
        except (ValueError, IndexError):
            pass
    for end in range(60, len(media) - 2, 37):
        with pytest.raises((ValueError, IndexError)):
            W.load(bytes(media[:end]))


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_query(spark, where, edge_dir):
    where = "/root/testdata/sf0.001" if where == "sf" else edge_dir
    want = []
    for r in spark.read.parquet(f"{where}/documents.parquet").collect():
        raw = (r.text or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        media = W.store(raw)
        n, count = len(p), Counter(p)
        assert b"".join(W.decode(f)[..., 2].tobytes() for f in W.files(media)) == p
        feature = f"192x{n // 192};{sum(p) / n:.4f};{sum(-c / n * math.log2(c / n) for c in count.values()) + 0.0:.4f}"
        want.append((r.doc_id, len(raw), n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    got = op4_webp(spark, where).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.media_bytes for r in got) < 0.6 * sum(r.payload_bytes for r in got)
    assert len({r.payload_sha256 for r in got}) == len({(r.payload_sha256, r.media_sha256, r.media_bytes, r.feature) for r in got})
