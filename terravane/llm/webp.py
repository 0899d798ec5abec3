"""Lossless WebP columns: an encoder of payloads and a decoder of any VP8L stream to pixel arrays.

The encoder chooses by content: a palette, predictors by block, the cross-colour or subtract-green transform, or none,
by estimated entropy; back-references to runs seen before; a colour cache of the size that is estimated the cheapest;
and prefix codes of the symbols' own frequencies. The decoder reads prefix codes by tables, back-references, the colour
cache and entropy images, and inverts the four transforms; every stream goes through it. Payloads become grey
images of 192 samples a row and at most ROWS rows; a longer one is several images, end to end.

Defined results: null is an empty payload; payloads are filled with spaces to a positive multiple of 192 bytes; equal
payloads give equal media; an empty table gives no rows; a stream that ends too early raises; digests() returns columns
of its own and reads no others than the two it is given, and with_media() replaces a column of the name it adds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, ROWS = 192, 4096
#: Bits that a code's table looks up at once, blocks of the predictor transform, cache sizes that are tried where a
#: literal takes so many bits, and about the bits of a back-reference.
TABLE_BITS, BLOCK_BITS, CACHE_BITS, CACHED_BITS, COPY_BITS = 10, 4, (0, 6, 8, 10), 8.0, 22
#: Bytes of a stream whose tokens are looked up at once.
STRETCH = 1 << 13
HASH = 0x1E35A7BD  # fixed value of the format: the colour cache's multiplier
#: Fixed values of the format: order of code-length codes, and near distances as (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class BitWriter:
    """Fields of up to 64 bits, lowest bit first."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.held: list[int] = []
        self.bits: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.held.append(value)
        self.bits.append(bits)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values += [np.array(self.held, np.uint64), values.astype(np.uint64)]
        self.sizes += [np.array(self.bits, np.int64), sizes.astype(np.int64)]
        self.held, self.bits = [], []

    def bytes(self) -> bytes:
        self.extend(np.zeros(0), np.zeros(0))
        value, size = np.concatenate(self.values), np.concatenate(self.sizes)
        value, size = value[size > 0], size[size > 0]
        end = np.cumsum(size)
        if not len(end):
            return b""
        at = end - size
        shift, word = (at & 63).astype(np.uint64), at >> 6
        out = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
        out[word[first] + 1] |= np.bitwise_or.reduceat((value >> np.uint64(1)) >> (np.uint64(63) - shift), first)
        return out.tobytes()[: -(-int(end[-1]) // 8)]


def code_lengths(count: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code of the symbols that occur, at most so many bits each; all 0 for fewer than two."""
    used = np.flatnonzero(count)
    lengths = np.zeros(len(count), np.int64)
    if len(used) < 2:
        return lengths
    least = 1
    while True:  # rare symbols count as more until no code is too long
        own = np.maximum(count[used], least)
        order = np.argsort(own, kind="stable")
        leaves = own[order].tolist()
        n = len(leaves)
        inner: list[int] = []
        parent = [0] * (2 * n - 1)
        a = b = 0
        for k in range(n - 1):  # leaves and inner nodes are two rising queues
            total = 0
            for _ in (0, 1):
                if b >= len(inner) or (a < n and leaves[a] <= inner[b]):
                    total, child, a = total + leaves[a], a, a + 1
                else:
                    total, child, b = total + inner[b], n + b, b + 1
                parent[child] = n + k
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            lengths[used[order]] = depth[:n]
            return lengths
        least *= 2


@cache
def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits reversed."""
    out = np.zeros(1, np.int64)
    for k in range(bits):
        out = np.concatenate([out, out | 1 << (bits - 1 - k)])
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in the order of their codes, and their lengths."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, lengths[used]


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol as it stands in the stream: its first bit lowest."""
    used, size = _canonical(lengths)
    out = np.zeros(len(lengths), np.uint64)
    room = 1 << (15 - size)
    out[used] = _reversed(15)[np.cumsum(room) - room]  # codes are left-aligned places of 15 bits
    return out


def _put_code(w: BitWriter, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the prefix code of symbols with these counts; the code and its lengths."""
    used = np.flatnonzero(count)
    if len(used) == 1 and used[0] < 256:
        w.put(1 | 1 << 2 | int(used[0]) << 3, 11)
        return np.zeros(len(count), np.uint64), np.zeros(len(count), np.int64)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):  # a simple code of one or two symbols
        symbols = used.tolist() or [0]
        w.put(1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
        for s in symbols:
            w.put(s, 8)
        lengths = np.zeros(len(count), np.int64)
        lengths[used] = len(symbols) - 1
        return reversed_codes(lengths), lengths
    lengths = code_lengths(count, 15)
    if len(used) == 1:  # a symbol that a simple code can't name: it takes no bits either
        lengths[used] = 1
    symbols: list[int] = []  # of a length or a run, extra bits, how many
    extras: list[int] = []
    more: list[int] = []
    edge = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1], [True]])).tolist()
    for a, b, value in zip(edge, edge[1:], lengths[edge[:-1]].tolist()):
        n = b - a
        if value:
            symbols.append(value)
            extras.append(0)
            more.append(0)
            n -= 1
        while n:
            k, s, e, m = 1, value, 0, 0
            if n >= 3:
                if value:
                    k = min(n, 6)
                    s, e, m = 16, k - 3, 2
                else:
                    k = min(n, 138)
                    s, e, m = (17, k - 3, 3) if k <= 10 else (18, k - 11, 7)
            symbols.append(s)
            extras.append(e)
            more.append(m)
            n -= k
    small = code_lengths(np.bincount(symbols, minlength=19), 7)
    if not small.any():
        small[symbols[0]] = 1
    codes = reversed_codes(small)
    bits = np.zeros(19, np.int64) if (small > 0).sum() == 1 else small
    last = max(k for k, s in enumerate(LENGTH_ORDER) if small[s])
    w.put(0, 1)
    w.put(max(last + 1, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(last + 1, 4)]:
        w.put(int(small[s]), 3)
    w.put(0, 1)  # lengths of the whole alphabet follow
    size = bits[symbols]
    w.extend(codes[symbols] | np.array(extras, np.uint64) << size.astype(np.uint64), size + np.array(more))
    if len(used) == 1:
        lengths[used] = 0
    return reversed_codes(lengths), lengths


@cache
def _log_sums() -> np.ndarray:
    """n log2 n of every count that an image can have."""
    n = np.arange(WIDTH * ROWS + 1)
    return n * np.log2(np.maximum(n, 1))


def _entropy_bits(count: np.ndarray, totals: tuple[int, ...]) -> float:
    """Bits of the symbols of some alphabets with these counts, end to end, and about what their codes take."""
    table = _log_sums()
    return sum(float(table[t]) for t in totals) - float(table[count].sum()) + 5 * int(np.count_nonzero(count))


@cache
def _near_codes(width: int) -> np.ndarray:
    """The code of each small distance that a near place has, else 0."""
    out = np.zeros(8 * width + 9, np.int64)
    for k, (dx, dy) in reversed(list(enumerate(NEAR, 1))):
        if dy * width + dx >= 1:
            out[dy * width + dx] = k
        elif k > 1:
            out[1] = out[1] or k
    return out


@cache
def _prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and how many of every length or distance code up to an image's last place."""
    x = np.arange(-1, WIDTH * ROWS + 128)
    top = np.frexp(np.maximum(x, 1).astype(float))[1] - 1
    n = np.where(x >= 4, top - 1, 0)
    return np.where(x >= 4, 2 * top + ((x >> n) & 1), x), x & ((1 << n) - 1), n


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(values) and values.max() >= len(_prefixes()[0]):
        raise ValueError("the image is too large")
    return tuple(t[values] for t in _prefixes())


def _copies(pixels: np.ndarray, least: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Where back-references stand, their lengths and distances: of each place the longest run on from the last place
    before it with the same pixels, so many at least, taken greedily."""
    n, none = len(pixels) - least + 1, np.zeros(0, np.int64)
    if n < 2:
        return [], none, none
    if pixels.dtype == np.uint8 and least <= 8:  # the bytes are the key
        key = np.ndarray(n, "<u8", pixels.tobytes() + bytes(8), strides=(1,)) & np.uint64((1 << 8 * least) - 1)
    else:
        p = pixels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = p[:n]
        for k in range(1, least):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + p[k : n + k]
    order = np.argsort(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16), kind="stable")  # by radix
    there, before = order[1:], order[:-1]
    same = key[there] == key[before]
    distance = np.zeros(n, np.int64)
    distance[there[same]] = there[same] - before[same]
    edge = np.concatenate([[0], np.flatnonzero(distance[1:] != distance[:-1]) + 1, [n]])  # runs of one distance
    gap = distance[edge[:-1]]
    some = np.flatnonzero(gap)
    end = edge[some + 1] + (least - 1)
    at, of, upto = [], [], 0
    for k, (a, b) in enumerate(zip(edge[some].tolist(), end.tolist())):
        if a < upto:
            a = upto
        if b - a >= least:
            at.append(a)
            of.append(k)
            upto = b
            if b - a > 4096:  # several of the most that one may have
                upto = a = a + 4096
                while b - a >= least:
                    at.append(a)
                    of.append(k)
                    upto = a = min(b, a + 4096)
    of = np.array(of, np.int64)
    size, far = np.minimum(end[of] - np.array(at, np.int64), 4096), gap[some[of]]
    if at and pixels.dtype != np.uint8:  # keys are hashes
        each = np.arange(size.sum()) + np.repeat(np.array(at) - (np.cumsum(size) - size), size)
        if (pixels[each] != pixels[each - np.repeat(far, size)]).any():
            return [], none, none
    return at, size, far


def _cached(pixels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cache place of each pixel, and whether its colour is there when it comes."""
    place = (((pixels.astype(np.uint64) * np.uint64(HASH)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    same = (place[order[1:]] == place[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    hit = np.zeros(len(pixels), bool)
    hit[order[1:][same]] = True
    return place.astype(np.int64), hit


def _put_image(w: BitWriter, pixels: np.ndarray, width: int, outer: bool = False, bits_each: float = 16.0) -> None:
    """Writes an image of 32-bit ARGB pixels: cache, codes, tokens. bits_each: about what a literal pixel takes."""
    n = len(pixels)
    green_only = not ((pixels ^ pixels[0]) & np.uint32(0xFFFF00FF)).any()
    sought = (pixels >> np.uint32(8)).astype(np.uint8) if green_only else pixels
    at, size, far = _copies(sought, min(max(3, int(COPY_BITS / max(bits_each, 2.0)) + 1), 8))
    inside = np.zeros(n + 1, np.int8)
    inside[at] = 1
    inside[np.array(at, np.int64) + size] -= 1
    token = np.cumsum(inside[:-1], dtype=np.int8) == 0
    literal = np.flatnonzero(token)
    length = _prefix(size)
    near = _near_codes(width)
    code = np.where(far < len(near), near[np.minimum(far, len(near) - 1)], 0)
    distance = _prefix(np.where(code > 0, code, far + 120))
    own = pixels[literal].astype(np.int64)
    bits, hit, symbol = 0, None, own >> 8 & 255
    if green_only:
        first = int(pixels[0])
        count = [np.bincount(np.concatenate([symbol, 256 + length[0]]), minlength=280)]
        count += [first >> k & 255 for k in (16, 0, 24)]
    else:
        best, copied = None, 768 + 256 + length[0]
        for tried in CACHE_BITS if bits_each >= CACHED_BITS else (0,):
            if tried and 1 << tried > max(len(own), 32):
                break
            if tried:
                place, hit = (x[literal] for x in _cached(pixels, tried))
            else:
                place, hit = 0, np.zeros(len(own), bool)
            plain = own[~hit]
            symbol = np.where(hit, 280 + place, own >> 8 & 255)
            # the alphabets of red, blue, alpha and green end to end
            all_of = np.concatenate([plain >> 16 & 255, 256 + (plain & 255), 512 + (plain >> 24), 768 + symbol, copied])
            count = np.bincount(all_of, minlength=768 + 280 + (1 << tried if tried else 0))
            cost = _entropy_bits(count, (len(plain),) * 3 + (len(symbol) + len(copied),))
            if best is None or cost < best[0]:
                best = (cost, tried, hit, symbol, count)
        _, bits, hit, symbol, count = best
        count = [count[768:], count[:256], count[256:512], count[512:768]]
    w.put(int(bits > 0) | bits << 1, 5 if bits else 1)
    if outer:
        w.put(0, 1)  # one group of codes
    green = _put_code(w, count[0])
    parts = [(green, symbol, None)]
    for c, k in zip(count[1:], (16, 0, 24)):
        if green_only:
            w.put(1 | 1 << 2 | c << 3, 11)  # the code of one symbol
        elif (put := _put_code(w, c))[1].any():
            parts.append((put, own >> k & 255, hit if bits else None))
    to = _put_code(w, np.bincount(distance[0], minlength=40))
    value, bit = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    v, b = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64)
    for (codes, lengths), s, unless in parts:
        more, size_of = codes[s], lengths[s]
        if unless is not None:
            size_of = np.where(unless, 0, size_of)
            more = np.where(unless, np.uint64(0), more)
        v |= more << b.astype(np.uint64)
        b += size_of
    value[literal], bit[literal] = v, b
    if at:
        v, b = green[0][256 + length[0]], green[1][256 + length[0]]
        for more, size_of in ((length[1], length[2]), (to[0][distance[0]], to[1][distance[0]]), (distance[1], distance[2])):
            v = v | more.astype(np.uint64) << b.astype(np.uint64)
            b = b + size_of
        value[at], bit[at] = v, b
        token[at] = True
    w.extend(value[token], bit[token])


def _argb(pixels: np.ndarray) -> np.ndarray:
    """Samples (…, 4), alpha first, as numbers of 32 bits."""
    p = pixels.astype(np.uint32)
    return (p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]).reshape(-1)


def _sample_bits(rgb: np.ndarray) -> float:
    """About what samples (…, 3) take as literals."""
    n = rgb.size // 3
    return _entropy_bits(np.bincount((rgb + np.array([0, 256, 512], np.int16)).reshape(-1), minlength=768), (n, n, n))


def predictions(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What a mode predicts of each pixel but those of the first row and column; samples (rows, columns, 4)."""
    flat = pixels.reshape(-1, 4).astype(np.int16)
    w = pixels.shape[1]
    k = np.arange(len(flat))
    left, top, corner, right = (flat[np.maximum(k - d, 0)].reshape(pixels.shape) for d in (1, w, w + 1, w - 1))
    return _predict(mode, left, top, corner, right).astype(np.uint8)


def _predictor(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals with the best mode of each block, and the modes."""
    h, w = pixels.shape[:2]
    size = 1 << BLOCK_BITS
    bh, bw = -(-h // size), -(-w // size)
    rest, cost = [], []
    for mode in range(14):
        r = pixels - predictions(pixels, mode)
        far = np.minimum(r, 256 - r.astype(np.int16))[..., 1:].sum(axis=2)
        far = np.pad(far, ((0, bh * size - h), (0, bw * size - w)))
        rest.append(r)
        cost.append(far.reshape(bh, size, bw, size).sum(axis=(1, 3)))
    modes = np.argmin(cost, axis=0)
    each = np.repeat(np.repeat(modes, size, axis=0), size, axis=1)[:h, :w]
    out = np.take_along_axis(np.stack(rest), each[None, ..., None], axis=0)[0]
    out[0, 1:] = pixels[0, 1:] - pixels[0, :-1]
    out[1:, 0] = pixels[1:, 0] - pixels[:-1, 0]
    out[0, 0] = pixels[0, 0] - np.array([255, 0, 0, 0], np.uint8)
    return out, modes


def _slope(x: np.ndarray, y: np.ndarray) -> int:
    """The multiplier, in 32nds, that tells most of y from x; both signed."""
    xx = float((x * x).sum())
    return int(np.clip(round(32 * float((x * y).sum()) / xx), -128, 127)) if xx else 0


def _cross_factors(pixels: np.ndarray) -> tuple[int, int, int]:
    """Multipliers of green for red, green for blue and red for blue over the whole image."""
    r, g, b = (pixels[..., k].astype(np.int8).astype(np.int32) for k in (1, 2, 3))
    return _slope(g, r), _slope(g, b), _slope(r, b - (_slope(g, b) * g >> 5))


def _crossed(pixels: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    """Red and blue less what is told by green and red."""
    r, g = (pixels[..., k].astype(np.int8).astype(np.int32) for k in (1, 2))
    out = pixels.copy()
    out[..., 1] = (pixels[..., 1] - (factors[0] * g >> 5)).astype(np.uint8)
    out[..., 3] = (pixels[..., 3] - (factors[1] * g >> 5) - (factors[2] * r >> 5)).astype(np.uint8)
    return out


def _palette(w: BitWriter, argb: np.ndarray, rows: int, columns: int, plain_bits: float) -> tuple[np.ndarray, int] | None:
    """Writes the palette transform where it is estimated to pay; the index image and its width."""
    colours = np.unique(argb)
    n = len(colours)
    if n > 256:
        return None
    index = np.searchsorted(colours, argb)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    steps = np.diff(_channels(colours[None])[0].astype(np.int16), axis=0, prepend=np.zeros((1, 4), np.int16)).astype(np.uint8)
    index = index.reshape(rows, columns)
    width = (columns + (1 << pack) - 1) >> pack
    if pack:  # several indices in a pixel
        index = np.pad(index, ((0, 0), (0, (width << pack) - columns))).reshape(rows, width, 1 << pack)
        index = (index << ((8 >> pack) * np.arange(1 << pack))).sum(axis=2)
    if _one_channel_bits(index) + _sample_bits(steps[:, 1:]) >= plain_bits:
        return None
    w.put(1 | 3 << 1 | (n - 1) << 3, 11)
    _put_image(w, _argb(steps), n)
    return (np.uint32(0xFF000000) | index.astype(np.uint32) << np.uint32(8)).reshape(-1), width


def encode(samples: np.ndarray) -> bytes:
    """A WebP file of (rows, columns, 3) samples, or of (rows, columns) grey ones."""
    rows, columns = samples.shape[:2]
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(columns - 1, 14)
    w.put(rows - 1, 14)
    w.put(0, 1 + 3)  # no alpha, version
    if samples.ndim == 2:
        _put_grey(w, samples)
    else:
        _put_colours(w, samples)
    data = w.bytes()
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def _one_channel_bits(grey: np.ndarray) -> float:
    return _entropy_bits(np.bincount(grey.reshape(-1), minlength=256), (grey.size,))


def _put_grey(w: BitWriter, grey: np.ndarray) -> None:
    """A grey image: green alone varies under the subtract-green transform, of the predictor's residuals or of the samples,
    or the indices of a palette."""
    rows, columns = grey.shape
    argb = np.uint32(0xFF000000) | grey.reshape(-1).astype(np.uint32) * np.uint32(0x10101)
    count = np.bincount(grey.reshape(-1), minlength=256)
    bits = _entropy_bits(count, (grey.size,))
    # of more values a palette can't put several in a pixel
    if np.count_nonzero(count) <= 16 and (indexed := _palette(w, argb, rows, columns, bits)):
        w.put(0, 1)
        _put_image(w, *indexed, outer=True, bits_each=bits / len(indexed[0]))
        return
    if rows > 1 and min(_one_channel_bits(grey[1:] - grey[:-1]), _one_channel_bits(grey[:, 1:] - grey[:, :-1])) < 0.95 * bits:
        rest, modes = _predictor(_channels(argb.reshape(rows, columns)))
        if (less := _one_channel_bits(rest[..., 2])) + 4 * modes.size < bits:
            w.put(1 | 0 << 1 | (BLOCK_BITS - 2) << 3, 6)
            _put_image(w, 0xFF000000 | modes.reshape(-1).astype(np.uint32) << 8, modes.shape[1])
            grey, bits = rest[..., 2], less
            argb = grey.reshape(-1).astype(np.uint32) << np.uint32(8)  # alpha is predicted too
    w.put(1 | 2 << 1, 3)
    w.put(0, 1)
    _put_image(w, argb & np.uint32(0xFF00FF00), columns, outer=True, bits_each=bits / grey.size)


def _put_colours(w: BitWriter, rgb: np.ndarray) -> None:
    rows, columns = rgb.shape[:2]
    pixels = np.concatenate([np.full((rows, columns, 1), 255, np.uint8), rgb], axis=2)
    bits = _sample_bits(rgb)
    if indexed := _palette(w, _argb(pixels), rows, columns, bits):
        w.put(0, 1)
        _put_image(w, *indexed, outer=True)
        return
    if rows > 1 and columns > 1 and min(_sample_bits(rgb[1:] - rgb[:-1]), _sample_bits(rgb[:, 1:] - rgb[:, :-1])) < 0.95 * bits:
        rest, modes = _predictor(pixels)
        if (less := _sample_bits(rest[..., 1:])) + 4 * modes.size < bits:
            w.put(1 | 0 << 1 | (BLOCK_BITS - 2) << 3, 6)
            _put_image(w, 0xFF000000 | modes.reshape(-1).astype(np.uint32) << 8, modes.shape[1])
            pixels, bits = rest, less
    green = pixels.copy()
    green[..., 1] -= pixels[..., 2]
    green[..., 3] -= pixels[..., 2]
    factors = _cross_factors(pixels)
    crossed = _crossed(pixels, factors)
    no_green, no_cross = _sample_bits(green[..., 1:]), _sample_bits(crossed[..., 1:]) + 64
    if no_cross < min(bits, no_green):
        size, (gr, gb, rb) = 9, (f & 255 for f in factors)
        w.put(1 | 1 << 1 | (size - 2) << 3, 6)
        blocks = (-(-rows // 512), -(-columns // 512))
        _put_image(w, np.full(blocks[0] * blocks[1], 0xFF000000 | rb << 16 | gb << 8 | gr, np.uint32), blocks[1])
        pixels = crossed
    elif no_green < bits:
        w.put(1 | 2 << 1, 3)
        pixels = green
    w.put(0, 1)
    _put_image(w, _argb(pixels), columns, outer=True, bits_each=min(bits, no_green, no_cross) / (rgb.size // 3))


class Code:
    """A canonical prefix code as a table of the next TABLE_BITS bits: symbol and length in one number, -1 where the code
    is longer; those are in a dictionary by length and bits. One symbol takes no bits."""

    def __init__(self, lengths: list[int]) -> None:
        size = np.array(lengths, np.int64)
        used = np.flatnonzero(size)
        if len(used) < 2:
            self._one(int(used[0]) if len(used) else 0)
            return
        self.single = False
        self.used, self.size = _canonical(size)
        self.most = int(self.size[-1])
        self.mask = (1 << min(self.most, TABLE_BITS)) - 1

    def whole(self, bits: int = 15) -> np.ndarray:
        """Symbol and length in one number by the next bits, so many or as many as the longest code has; -1 for no code."""
        if self.single:
            return np.array(self.table, np.int32)
        bits = min(self.most, bits)
        short = np.searchsorted(self.size, bits, "right")
        by_first = np.full(1 << bits, -1, np.int32)  # by the bits as a code is written, first bit highest
        found = np.repeat((self.used << 4 | self.size)[:short], 1 << (bits - self.size[:short]))
        by_first[: len(found)] = found
        return by_first[_reversed(bits)]

    @cached_property
    def table(self) -> list[int]:
        return self.whole(TABLE_BITS).tolist()

    @cached_property
    def longer(self) -> dict[tuple[int, int], int]:
        short = np.searchsorted(self.size, TABLE_BITS, "right")
        size, room = self.size[short:].tolist(), 1 << (15 - self.size)
        code = _reversed(15)[(np.cumsum(room) - room)[short:]].tolist()
        return {(n, c): s << 4 | n for n, c, s in zip(size, code, self.used[short:].tolist())}

    def _one(self, symbol: int) -> None:
        self.single, self.table, self.mask = True, [symbol << 4], 0

    @classmethod
    def of_one(cls, symbol: int) -> Code:
        out = cls.__new__(cls)
        out._one(symbol)
        return out

    def long(self, value: int) -> int:
        for n in range(TABLE_BITS + 1, self.most + 1):
            found = self.longer.get((n, value & ((1 << n) - 1)))
            if found is not None:
                return found
        raise ValueError("no such prefix code")


def _fixed(red: list, r_code: Code, blue: list, b_code: Code, alpha: list, a_code: Code) -> tuple[int, int]:
    """Alpha where it is one symbol, and all but green where they are; else -1."""
    if not a_code.single:
        return -1, -1
    a = alpha[0] >> 4 << 24
    return a, a | red[0] >> 4 << 16 | blue[0] >> 4 if r_code.single and b_code.single else -1


_SHIFTS, _PLACES = np.arange(8, dtype=np.uint32), np.arange(8 * (STRETCH + 8), dtype=np.int32)


@cache
def _extra_bits() -> np.ndarray:
    """Extra bits of each symbol of a length or distance; of -1 none."""
    symbol = np.arange(256)
    return np.r_[np.where(symbol < 4, 0, (symbol - 2) >> 1)[:40], np.zeros(1, np.int64)].astype(np.int32)


def _told(symbol: np.ndarray, window: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lengths or distance codes of symbols whose extra bits begin at these places."""
    n = _extra_bits()[symbol]
    more = (window[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64) & ((1 << n) - 1)
    return np.where(symbol < 4, symbol, (2 + (symbol & 1) << n) + more) + 1


@cache
def _near_places(width: int) -> np.ndarray:
    """Distances of the codes up to 120."""
    return np.array([0] + [max(1, dy * width + dx) for dx, dy in NEAR], np.int64)


def _way(after: np.ndarray, first: int, end: int) -> np.ndarray:
    """The places before end on the way from the first, each followed by the one that after names."""
    hops = [np.concatenate([np.minimum(after, end), np.array([end], np.int32)])]
    for _ in range(3):
        hops.append(hops[-1][hops[-1]])
    eight, at, way = memoryview(hops.pop()), first, []
    while at < end:
        way.append(at)
        at = eight[at]
    out = np.array(way, np.int32)
    for hop in reversed(hops):
        both = np.empty(2 * len(out), np.int32)
        both[::2], both[1::2] = out, hop[out]
        out = both
    return out[: np.searchsorted(out, end)]


class Vp8l:
    """Decodes one stream to (rows, columns) of 32-bit ARGB."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        if self.bits(8) != 0x2F:
            raise ValueError("not a lossless stream")
        self.width, self.height = self.bits(14) + 1, self.bits(14) + 1
        self.has_alpha = self.bits(1)
        if self.bits(3):
            raise ValueError("unknown version")

    def peek(self, bits: int = 32) -> int:
        """The next bits, and perhaps some more; zeros after the end."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + bits // 8 + 1], "little") >> (self.at & 7)

    def bits(self, n: int) -> int:
        value = self.peek(max(n + 7, 32)) & ((1 << n) - 1)
        self.at += n
        return value

    def code(self, size: int) -> Code:
        if not self.bits(1):
            return self.normal_code(size)
        two, wide = self.bits(1), self.bits(1)
        first = self.bits(8 if wide else 1)
        if not two:
            return Code.of_one(first)
        lengths = [0] * size
        lengths[first] = lengths[self.bits(8)] = 1
        return Code(lengths)

    def normal_code(self, size: int) -> Code:
        lengths = [0] * size
        small = [0] * 19
        n = self.bits(4) + 4
        value = self.bits(3 * n)
        for k, symbol in enumerate(LENGTH_ORDER[:n]):
            small[symbol] = value >> 3 * k & 7
        small_code = Code(small)
        left = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else size
        table, mask = small_code.table, small_code.mask
        at, before, held, value = 0, 8, 0, 0
        while at < size and left:
            left -= 1
            if held < 14:  # no token takes more
                value, held = self.peek(120), 120
            s = table[value & mask]
            n, s = s & 15, s >> 4
            if s < 16:
                lengths[at] = s
                at += 1
                before = s or before
            else:
                extra = 2 if s == 16 else 3 if s == 17 else 7
                run = (11 if s == 18 else 3) + (value >> n & ((1 << extra) - 1))
                if s == 16:
                    lengths[at : at + run] = [before] * run
                at += run
                n += extra
            value >>= n
            held -= n
            self.at += n
        return Code(lengths[:size])

    def image(self, width: int, height: int, outer: bool = False) -> np.ndarray:
        cache_bits = self.bits(4) if self.bits(1) else 0
        cache = [0] * (1 << cache_bits) if cache_bits else []
        group_bits, groups, n_groups = 0, None, 1
        if outer and self.bits(1):
            group_bits = self.bits(3) + 2
            step = (width + (1 << group_bits) - 1) >> group_bits
            groups = (self.image(step, (height + (1 << group_bits) - 1) >> group_bits) >> 8 & 0xFFFF).tolist()
            n_groups = max(max(r) for r in groups) + 1
        codes = [[self.code(n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(n_groups)]
        if not groups and not cache and all(c.single for c in codes[0][1:4]):
            red, blue, alpha = (c.table[0] >> 4 for c in codes[0][1:4])
            return self.green(codes[0][0], codes[0][4], alpha << 24 | red << 16 | blue, width, height)
        tables = [[x for c in own for x in (c.table, c.mask, c)] for own in codes]
        (green, g_mask, g_code, red, r_mask, r_code, blue, b_mask, b_code, alpha, a_mask, a_code, to, t_mask, t_code) = tables[0]
        fixed, one = _fixed(red, r_code, blue, b_code, alpha, a_code)
        data, total = self.data, width * height
        byte, held = self.at >> 3, 0  # next byte to take, and bits that are taken but not used
        value = 0
        if self.at & 7:
            value, held, byte = data[byte] >> (self.at & 7), 8 - (self.at & 7), byte + 1
        out: list[int] = []
        filled = n_out = 0  # pixels in the cache, and in out
        shift = 32 - cache_bits
        while n_out < total:
            if held < 96:  # no token takes more
                value |= int.from_bytes(data[byte : byte + 16], "little") << held
                held += 128
                byte += 16
            if groups:
                own = tables[groups[n_out // width >> group_bits][n_out % width >> group_bits]]
                (green, g_mask, g_code, red, r_mask, r_code, blue, b_mask, b_code, alpha, a_mask, a_code, to, t_mask, t_code) = own
                fixed, one = _fixed(red, r_code, blue, b_code, alpha, a_code)
            s = green[value & g_mask]
            if s < 0:
                s = g_code.long(value)
            n = s & 15
            value >>= n
            held -= n
            if s < 4096:  # 256 << 4: a literal
                if one >= 0:
                    out.append(one | s >> 4 << 8)
                    n_out += 1
                    continue
                r = red[value & r_mask]
                if r < 0:
                    r = r_code.long(value)
                n = r & 15
                value >>= n
                held -= n
                b = blue[value & b_mask]
                if b < 0:
                    b = b_code.long(value)
                n = b & 15
                value >>= n
                held -= n
                if fixed < 0:
                    a = alpha[value & a_mask]
                    if a < 0:
                        a = a_code.long(value)
                    value >>= a & 15
                    held -= a & 15
                    out.append(a >> 4 << 24 | r >> 4 << 16 | s >> 4 << 8 | b >> 4)
                else:
                    out.append(fixed | r >> 4 << 16 | s >> 4 << 8 | b >> 4)
                n_out += 1
            elif s < 4480:  # 280 << 4: a copy
                pair = []
                for x in (s >> 4) - 256, -1:
                    if x < 0:
                        x = to[value & t_mask]
                        if x < 0:
                            x = t_code.long(value)
                        value >>= x & 15
                        held -= x & 15
                        x >>= 4
                    if x >= 4:
                        n = (x - 2) >> 1
                        x = ((2 + (x & 1)) << n) + (value & ((1 << n) - 1))
                        value >>= n
                        held -= n
                    pair.append(x + 1)
                n, d = pair
                if d > 120:
                    d -= 120
                else:
                    dx, dy = NEAR[d - 1]
                    d = max(1, dy * width + dx)
                if d > n_out:
                    raise ValueError("a copy from before the image")
                n = min(n, total - n_out)
                out += out[n_out - d : n_out - d + n] if d >= n else (out[-d:] * (n // d + 1))[:n]
                n_out += n
            else:
                for p in out[filled:]:
                    cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
                filled = n_out
                out.append(cache[(s >> 4) - 280])
                n_out += 1
        self.at = 8 * byte - held
        if self.at > 8 * len(data):
            raise ValueError("the stream ends too early")
        return np.array(out, np.uint32).reshape(height, width)

    def green(self, code: Code, to_code: Code, one: int, width: int, height: int) -> np.ndarray:
        """Pixels of which green alone varies, without a cache. Of a stretch of the stream, the token that would begin at
        each bit is looked up at once, and where the next one begins; the tokens are those on the way from the first."""
        total = width * height
        if code.single:
            if (symbol := code.table[0] >> 4) >= 256:
                raise ValueError("a copy from before the image")
            return np.full((height, width), one | symbol << 8, np.uint32)
        table, to = code.whole(), to_code.whole()
        mask, t_mask = np.uint32(len(table) - 1), np.uint32(len(to) - 1)
        extra, skip = _extra_bits(), (to & 15) + _extra_bits()[to >> 4]  # bits of a distance
        data = self.data
        starts, sizes, gaps, out, n_out = [], [], [], bytearray(), 0
        while n_out < total:
            if self.at > 8 * len(data):
                raise ValueError("the stream ends too early")
            base = self.at >> 3
            room = min(STRETCH, total - n_out, len(data) - base) + 8
            held = data[base : base + room + 16]
            window = np.ndarray(room + 12, "<u4", held.ljust(room + 16, b"\0"), strides=(1,))
            word = (window[:room, None] >> _SHIFTS).reshape(-1)
            token = table[word & mask]
            after = _PLACES[: 8 * room] + (token & 15)
            copy = np.flatnonzero(token >= 4096)  # 256 << 4
            there = after[copy] + extra[(token[copy] >> 4) - 256]
            after[copy] = there + skip[window[there >> 3] >> (there & 7).astype(np.uint32) & t_mask]
            at = _way(after, self.at & 7, 8 * room)
            found = token[at]
            if found.min() < 0:
                raise ValueError("no such prefix code")
            copied = np.flatnonzero(found >= 4096)
            size = np.ones(len(at), np.int64)
            symbol = (found[copied] >> 4) - 256
            there = at[copied] + (found[copied] & 15)
            size[copied] = _told(symbol, window, there)
            there = there + extra[symbol]
            symbol = to[window[there >> 3] >> (there & 7).astype(np.uint32) & t_mask]
            ends = n_out + np.cumsum(size)
            last = min(int(np.searchsorted(ends, total)), len(at) - 1)  # tokens behind the image's end belong to others
            copied, symbol, there = (x[: np.searchsorted(copied, last, "right")] for x in (copied, symbol, there))
            if len(copied):
                if symbol.min() < 0:
                    raise ValueError("no such prefix code")
                far = _told(symbol >> 4, window, there + (symbol & 15))
                far = np.where(far > 120, far - 120, _near_places(width)[np.minimum(far, 120)])
                start = (ends - size)[copied]
                if (far > start).any():
                    raise ValueError("a copy from before the image")
                starts += start.tolist()
                sizes += np.minimum(size[copied], total - start).tolist()
                gaps += far.tolist()
            part = np.zeros(min(int(ends[last]), total) - n_out, np.uint8)
            literal = found[: last + 1] < 4096
            part[(ends - size)[: last + 1][literal] - n_out] = found[: last + 1][literal] >> 4
            out += part.tobytes()
            n_out = len(out)
            self.at = 8 * base + int(after[at[last]])
        if self.at > 8 * len(data):
            raise ValueError("the stream ends too early")
        for a, n, d in zip(starts, sizes, gaps):
            out[a : a + n] = out[a - d : a - d + n] if d >= n else (out[a - d : a] * (n // d + 1))[:n]
        return np.uint32(one) | np.frombuffer(out, np.uint8).astype(np.uint32).reshape(height, width) << np.uint32(8)

    def decode(self) -> np.ndarray:
        steps, width = [], self.width
        while self.bits(1):
            kind = self.bits(2)
            if kind < 2:  # predictor, cross-colour
                size = self.bits(3) + 2
                block = 1 << size
                steps.append((kind, size, self.image((width + block - 1) >> size, (self.height + block - 1) >> size)))
            elif kind == 2:
                steps.append((2, 0, None))
            else:
                n = self.bits(8) + 1
                palette = _channels(self.image(n, 1)).cumsum(axis=1).astype(np.uint8)
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                steps.append((3, (pack, width), np.concatenate([palette[0], np.zeros((256, 4), np.uint8)])))
                width = (width + (1 << pack) - 1) >> pack
        pixels = _channels(self.image(width, self.height, outer=True))
        for kind, size, data in reversed(steps):
            if kind == 0:
                pixels = unpredict(pixels, size, data)
            elif kind == 1:
                pixels = uncross(pixels, size, data)
            elif kind == 2:
                pixels = pixels.copy()
                pixels[..., 1] += pixels[..., 2]
                pixels[..., 3] += pixels[..., 2]
            else:
                pack, wide = size
                index, each = pixels[..., 2], 8 >> pack
                if pack:
                    index = np.stack([(index >> (each * k)) & ((1 << each) - 1) for k in range(1 << pack)], axis=2).reshape(self.height, -1)[:, :wide]
                pixels = data[index]
        if not self.has_alpha:
            pixels[..., 0] = 255
        return pixels


def _channels(argb: np.ndarray) -> np.ndarray:
    """(rows, columns, 4) as alpha, red, green, blue."""
    return np.ascontiguousarray(argb.astype(">u4")).view(np.uint8).reshape(*argb.shape, 4)


def uncross(pixels: np.ndarray, size: int, data: np.ndarray) -> np.ndarray:
    """Adds what red and blue were predicted to be from green and red."""
    h, w = pixels.shape[:2]
    m = _channels(data).astype(np.int8).astype(np.int32)[np.arange(h)[:, None] >> size, np.arange(w)[None] >> size]
    green = pixels[..., 2].astype(np.int8).astype(np.int32)
    out = pixels.copy()
    red = (pixels[..., 1] + (m[..., 3] * green >> 5)).astype(np.uint8)
    out[..., 1] = red
    out[..., 3] = (pixels[..., 3] + (m[..., 2] * green >> 5) + (m[..., 1] * red.astype(np.int8).astype(np.int32) >> 5)).astype(np.uint8)
    return out


def _predict(mode: int, left, top, corner, right):
    """A mode's guess from the left, top, top-left and top-right samples, as arrays (…, 4) of signed numbers."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        near_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        near_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(near_left < near_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        step = mean - corner
        return np.clip(mean + (step + (step < 0) >> 1), 0, 255)  # halves go towards 0
    guess = {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top),
        8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }.get(mode)
    return guess() if guess else np.zeros_like(left) + np.array([255, 0, 0, 0], left.dtype)


def unpredict(pixels: np.ndarray, size: int, data: np.ndarray) -> np.ndarray:
    """Adds each pixel's prediction from the decoded ones before it. Stretches of a row whose mode doesn't look to the
    left are added at once, those of mode 1 as running sums, others pixel by pixel."""
    h, w = pixels.shape[:2]
    modes = (_channels(data)[..., 2] & 15).tolist()
    out = pixels.copy()
    out[0, 0] += np.array([255, 0, 0, 0], np.uint8)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    flat = out.reshape(-1, 4)
    for y in range(1, h):
        out[y, 0] += out[y - 1, 0]
        for bx, mode in enumerate(modes[y >> size]):
            a, b = max(1, bx << size), min(w, (bx + 1) << size)
            if a >= b:
                continue
            k = y * w + a  # to the right of the last column is the row's own first pixel
            if mode == 1:
                flat[k - 1 : k - 1 + b - a + 1] = np.cumsum(flat[k - 1 : k + b - a], axis=0, dtype=np.uint8)
                continue
            spans = [(k, k + b - a)] if mode in (0, 2, 3, 4, 8, 9, 14, 15) else [(j, j + 1) for j in range(k, k + b - a)]
            for i, j in spans:
                left, top, corner, right = (flat[i - d : j - d].astype(np.int16) for d in (1, w, w + 1, w - 1))
                flat[i:j] += _predict(mode, left, top, corner, right).astype(np.uint8)
    return out


def decode(data: bytes) -> np.ndarray:
    """(rows, columns, 4) samples, alpha first, of a WebP file with a lossless chunk."""
    at = 12
    while at < len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return Vp8l(data[at + 8 : at + 8 + size]).decode()
        at += 8 + size + size % 2
    raise ValueError("no lossless chunk")


def files(media: bytes) -> Iterator[bytes]:
    """The images of a media value."""
    at = 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + n]
        at += n


def store(payload: bytes) -> bytes:
    """A payload, filled up, as grey images end to end."""
    room = max(WIDTH, -(-len(payload) // WIDTH) * WIDTH)
    rows = np.frombuffer(payload.ljust(room, b" "), np.uint8).reshape(-1, WIDTH)
    return b"".join(encode(rows[k : k + ROWS]) for k in range(0, len(rows), ROWS))


def load(media: bytes) -> np.ndarray:
    """The stored samples as rows."""
    return np.concatenate([decode(f)[..., 2] for f in files(media)])


def features(samples: np.ndarray) -> str:
    """Size, mean sample and entropy of the samples in bits."""
    count = np.bincount(samples.reshape(-1), minlength=256)
    n, table = samples.size, _log_sums()
    bits = float(table[n] - table[count].sum()) / n if n < len(table) else -sum(c / n * np.log2(c / n) for c in count[count > 0].tolist())
    return f"{samples.shape[1]}x{samples.shape[0]};{int(count @ np.arange(256)) / n:.4f};{abs(bits):.4f}"


def with_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds the text's bytes as media."""
    @F.pandas_udf("binary")
    def run(texts):
        return texts.map(lambda t: store((t or "").encode()))

    return docs.withColumn(media_col, run(F.coalesce(text_col, F.lit(""))))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Media of each text, read back: digests of the samples and of the media, and features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if len(b)):
            rows = []
            for size, media in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = media.as_buffer().to_pybytes()
                samples = load(media)
                payload = samples.tobytes()
                rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    n_bytes = F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long")
    media = with_media(docs.select(F.col(id_col).cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), text_col), text_col)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
