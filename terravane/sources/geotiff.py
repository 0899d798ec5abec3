"""GeoTIFF images as rows of (origin, wkt, height, width, nBands, data), data band after band.

Files come through Spark's binary reader, one image a task's record. Striped and tiled files of whole-byte samples are
read, plain or packed by LZW, Deflate or PackBits, with or without horizontal differences.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "struct<origin:string,wkt:string,height:int,width:int,nBands:int,data:array<double>>"
_IMAGE = pa.struct([("origin", pa.string()), ("wkt", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nBands", pa.int32()), ("data", pa.list_(pa.float64()))])
#: Samples of an image at most, as a row must hold them.
MAX_SAMPLES = 1_000_000_000 // 8

#: Tags, field types and packings of the format.
WIDTH, HEIGHT, BITS, PACKING, OFFSETS, PER_PIXEL, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINTS, TRANSFORM = 322, 323, 324, 325, 339, 33550, 33922, 34264
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in TYPES:
            form = f"{order}{n}{TYPES[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            out[tag] = struct.unpack_from(form, data, place)
    return order, out


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a code's width grows one entry early."""
    clear, stop = 256, 257
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, bits, last, out = first.copy(), 9, 0, 0, b"", bytearray()
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == stop:
            break
        if code == clear:
            table, width, last = first.copy(), 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("damaged LZW data")
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def _unpacked(data: bytes, packing: int) -> bytes:
    if packing == PLAIN:
        return data
    if packing in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if packing == LZW:
        return unpack_lzw(data)
    if packing == PACK_BITS:
        return unpack_bits(data)
    raise ValueError(f"TIFF packing {packing} is not supported")


def decode(data: bytes) -> tuple[np.ndarray, list[tuple[float, float]] | None]:
    """(bands, rows, columns) of samples, and the world places of the corners' pixels, where the file has them."""
    order, tags = _tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(PER_PIXEL, 1)
    if width * height * bands > MAX_SAMPLES:
        raise ValueError("image is too large")
    bits, form = set(tags.get(BITS, (1,))), one(SAMPLE_FORMAT, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(form)
    if len(bits) > 1 or kind is None or min(bits) not in ((32, 64) if kind == "f" else (8, 16, 32)):
        raise ValueError(f"TIFF samples of format {form} and {sorted(bits)} bits are not supported")
    dtype = np.dtype(f"{order}{kind}{min(bits) // 8}")
    planes, deep = (bands, 1) if one(PLANAR, 1) == 2 else (1, bands)
    tiled = TILE_OFFSETS in tags
    wide = one(TILE_WIDTH, width) if tiled else width
    high = one(TILE_HEIGHT, height) if tiled else min(one(ROWS, height), height)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) < planes * across * down:
        raise ValueError("TIFF file lacks strips or tiles")
    out, predictor = np.empty((bands, height, width)), one(PREDICTOR, 1)
    if predictor not in (1, 2) or (predictor == 2 and kind == "f"):
        raise ValueError(f"TIFF predictor {predictor} is not supported")
    for k in range(planes * across * down):
        plane, place = divmod(k, across * down)
        y, x = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - y)
        raw = _unpacked(bytes(data[offsets[k] : offsets[k] + counts[k]]), one(PACKING, PLAIN))
        part = np.frombuffer(raw, dtype, rows * wide * deep).reshape(rows, wide, deep)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=dtype.newbyteorder("="))
        part = part[: height - y, : width - x].transpose(2, 0, 1)
        out[plane if planes > 1 else slice(None), y : y + rows, x : x + wide] = part[0] if planes > 1 else part
    return out, _corners(tags, width, height)


def _corners(tags: dict[int, tuple], width: int, height: int) -> list[tuple[float, float]] | None:
    """Centres of the corner pixels, from the upper left one down and around."""
    if TRANSFORM in tags:
        a, b, _, c, d, e, _, f = tags[TRANSFORM][:8]
    elif PIXEL_SCALE in tags and TIE_POINTS in tags:
        (a, e), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:2], tags[TIE_POINTS][:6]
        b, d, e, c, f = 0.0, 0.0, -e, x - i * a, y + j * e
    else:
        return None
    at = [(0.5, 0.5), (0.5, height - 0.5), (width - 0.5, height - 0.5), (width - 0.5, 0.5)]
    return [(a * x + b * y + c, d * x + e * y + f) for x, y in at]


def _wkt(corners: list[tuple[float, float]] | None) -> str | None:
    return corners and f"POLYGON (({', '.join(f'{x!r} {y!r}' for x, y in [*corners, corners[0]])}))"


def _images(drop_invalid: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                origin = path.as_py()
                try:
                    samples, corners = decode(memoryview(content.as_buffer()))
                    bands, height, width = samples.shape
                    values = samples.reshape(-1)
                except (ValueError, KeyError, IndexError, struct.error, zlib.error):
                    if drop_invalid:
                        continue
                    corners, bands, height, width, values = None, -1, -1, -1, np.zeros(0)
                data = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                parts = [pa.array([v], t.type) for v, t in zip((origin, _wkt(corners), height, width, bands), _IMAGE, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([*parts, data.cast(_IMAGE.field("data").type)], fields=list(_IMAGE))], ["image"])

    return run


def read_geotiff(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """One column, image, of a folder's files. Places are in the file's own reference system, of the corner pixels' centres;
    a file without them has a null wkt. A file that can't be read is dropped, or has -1 for its sizes and no data."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_images(drop_invalid), f"image {IMAGE}")
