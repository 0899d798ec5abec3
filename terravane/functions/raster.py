"""RS_* band algebra over array<double> columns, as higher-order functions. Rounding is half up, to two places.

Division by zero has the results of the JVM's own arithmetic in any mode of Spark: a quotient is rounded to the largest
long over 100 with the dividend's sign, 0 / 0 to 0; a remainder by 0 is NaN; an empty band's mean is 0, the mode none.
Bands of unequal length raise. Null bands give null. Signed zeros are kept as arithmetic makes them.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What the JVM makes of an infinite quotient: the largest and the smallest long over 100.
HIGH, LOW = (2**63 - 1) / 100, -(2**63) / 100


def _two(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def _quotient(x: Column, y: Column) -> Column:
    by_zero = F.when(x > 0, F.lit(HIGH)).when(x < 0, F.lit(LOW)).otherwise(F.lit(0.0))
    return F.when(y == 0, by_zero).otherwise(_two(x / y))


def rs_normalizeddifference(a, b) -> Column:
    fix = lambda x: F.when(x == 0, F.lit(-1.0)).otherwise(x)
    return _pairwise(lambda x, y: _quotient(fix(y) - fix(x), fix(y) + fix(x)))(a, b)


def rs_mean(a) -> Column:
    total = F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(_c(a)) == 0, F.lit(0.0)).otherwise(_two(total / F.size(_c(a))))


def rs_mode(a) -> Column:
    """All modes, in order."""
    values = F.array_distinct(_c(a))
    count = lambda v: F.size(F.filter(_c(a), lambda x: x == v))
    most = F.array_max(F.transform(values, count))
    return F.array_sort(F.filter(values, lambda v: count(v) == most))


def rs_fetchregion(a, region: list[int], dim: list[int]) -> Column:
    x0, y0, x1, y1 = region
    return F.concat(*(F.slice(_c(a), i * dim[0] + y0 + 1, y1 - y0 + 1) for i in range(x0, x1 + 1)))


def _mask(test):
    return lambda a, t: F.transform(_c(a), lambda x: F.when(test(x, t), F.lit(1.0)).otherwise(F.lit(0.0)))


rs_greaterthan = _mask(lambda x, t: x > t)
rs_greaterthanequal = _mask(lambda x, t: x >= t)
rs_lessthan = _mask(lambda x, t: x < t)
rs_lessthanequal = _mask(lambda x, t: x <= t)


def rs_count(a, t) -> Column:
    return F.size(F.filter(_c(a), lambda x: x == t))


def rs_multiplyfactor(a, k) -> Column:
    return F.transform(_c(a), lambda x: x * k)


def _pairwise(f):
    def both(a, b) -> Column:
        unequal = F.raise_error(F.lit("bands of unequal length")).cast("array<double>")
        return F.when(F.size(_c(a)) != F.size(_c(b)), unequal).otherwise(F.zip_with(_c(a), _c(b), f))

    return both


rs_addbands = _pairwise(lambda x, y: x + y)
rs_subtractbands = _pairwise(lambda x, y: y - x)  # the second less the first
rs_multiplybands = _pairwise(lambda x, y: x * y)
rs_dividebands = _pairwise(_quotient)
rs_bitwiseand = _pairwise(lambda x, y: x.cast("int").bitwiseAND(y.cast("int")).cast("double"))
rs_bitwiseor = _pairwise(lambda x, y: x.cast("int").bitwiseOR(y.cast("int")).cast("double"))
rs_logicaldifference = _pairwise(lambda x, y: F.when(x != y, x).otherwise(F.lit(0.0)))
rs_logicalover = _pairwise(lambda x, y: F.when(x != 0, x).otherwise(y))


def rs_modulo(a, d) -> Column:
    by = (d if isinstance(d, Column) else F.lit(d)).cast("double")
    return F.transform(_c(a), lambda x: F.when(by == 0, F.lit("NaN").cast("double")).otherwise(x % by))


def rs_squareroot(a) -> Column:
    return F.transform(_c(a), lambda x: F.when(x < 0, F.lit(0.0)).otherwise(_two(F.sqrt(x))))


def rs_normalize(a) -> Column:
    """Scaled to 255; of a band whose largest value is 0 zeros stay and negative values become the least int."""
    most = F.array_max(_c(a))
    return F.transform(_c(a), lambda x: F.when(most == 0, F.when(x < 0, F.lit(-2147483648.0)).otherwise(F.lit(0.0))).otherwise((x / (most / 255)).cast("int").cast("double")))


def rs_getband(data, band: int, n_bands: int) -> Column:
    size = (F.size(_c(data)) / n_bands).cast("int")
    return F.slice(_c(data), (band - 1) * size + 1, size)


def rs_array(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def _png(height, width, *bands) -> str | None:
    """Base64 of an RGBA picture of 8-bit samples; without a fourth band it is opaque."""
    if any(b is None for b in bands):
        return None
    n = height * width
    if any(len(b) != n for b in bands):
        raise ValueError("bands need height * width samples")
    pixels = np.full((n, 4), 255, np.uint8)
    for k, b in enumerate(bands):
        pixels[:, k] = np.asarray(b, float).astype(np.int64) & 255
    return base64.b64encode(png(pixels.reshape(height, width, 4))).decode()


def png(rgba: np.ndarray) -> bytes:
    """A PNG file of (rows, columns, 4) samples."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    rows, columns = rgba.shape[:2]
    raw = np.concatenate([np.zeros((rows, 1), np.uint8), rgba.reshape(rows, -1)], axis=1).tobytes()
    head = columns.to_bytes(4, "big") + rows.to_bytes(4, "big") + bytes([8, 6, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def rs_base64(height, width, red, green, blue, alpha=None) -> Column:
    """A PNG of three or four bands in row order, as base 64."""
    @F.pandas_udf("string")
    def run(h, w, *bands):
        import pandas as pd

        return pd.Series([_png(int(a), int(b), *rest) for a, b, *rest in zip(h, w, *bands)], dtype=object)

    value = lambda c: F.lit(c) if isinstance(c, int) else _c(c)
    return run(value(height), value(width), *(_c(b) for b in (red, green, blue, alpha) if b is not None))


def rs_html(b64, width: int = 200) -> Column:
    return F.concat(F.lit('<img src="data:image/png;base64,'), _c(b64), F.lit(f'" width="{width}" />'))
