"""Pixels, tiles and colours as Column expressions, and pictures of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.raster import png

#: Pixels of one picture at most, as a task holds it whole.
MAX_PIXELS = 1 << 26


def _pixel(v: Column, low, high, n: int) -> Column:
    at = F.floor((v - low) / (high - low) * n).cast("int")
    return F.when(v == high, F.lit(n - 1)).otherwise(at)  # the far edge is in the last pixel


def st_pixelize(x: Column, y: Column, res_x: int, res_y: int, boundary: tuple[float, float, float, float]) -> Column:
    """The pixel of a point; null outside the boundary."""
    xmin, ymin, xmax, ymax = map(F.lit, boundary)
    pixel = F.struct(_pixel(x, xmin, xmax, res_x).alias("x"), _pixel(y, ymin, ymax, res_y).alias("y"))
    return F.when(x.between(xmin, xmax) & y.between(ymin, ymax), pixel)


def st_tilename(pixel: Column, res_x: int, res_y: int, zoom: int) -> Column:
    """zoom-x-y, y from the top."""
    n = 1 << zoom
    tx = F.least(F.floor(pixel.x * n / res_x), F.lit(n - 1))
    ty = F.least(F.floor(pixel.y * n / res_y), F.lit(n - 1))
    return F.concat_ws("-", F.lit(zoom), tx.cast("int"), (n - 1 - ty).cast("int"))


#: Upper ends of the weight buckets.
BUCKETS = (5, 15, 25, 35, 45, 60, 80)


def st_colorize(weight: Column, most: Column) -> Column:
    """The bucket, 0 to 7, of the weight scaled to 255."""
    scaled = weight * 255 / most
    out = F.when(scaled < BUCKETS[0], 0)
    for k, edge in enumerate(BUCKETS[1:], 1):
        out = out.when(scaled < edge, k)
    return out.otherwise(len(BUCKETS))


def heat_map(points: DataFrame, x: str, y: str, res_x: int, res_y: int, boundary: tuple[float, float, float, float]) -> DataFrame:
    """(px, py, weight): points counted by pixel, with partial sums before the shuffle."""
    pixel = st_pixelize(F.col(x), F.col(y), res_x, res_y, boundary)
    return points.select(pixel.alias("p")).where("p IS NOT NULL").groupBy(F.col("p.x").alias("px"), F.col("p.y").alias("py")).agg(F.count("*").alias("weight"))


#: Red, green and blue of the buckets, and the opacity of all.
COLOURS = ((0, 255, 0), (85, 255, 0), (170, 255, 0), (255, 255, 0), (255, 255, 0), (255, 170, 0), (255, 85, 0), (255, 0, 0))
OPACITY = 150


def argb(red: int, green: int, blue: int, alpha: int = 255) -> int:
    """One signed 32-bit number."""
    value = alpha << 24 | red << 16 | green << 8 | blue
    return value - (1 << 32) if value >= 1 << 31 else value


def st_colorize_argb(weight: Column, most: Column) -> Column:
    """The bucket's colour; weight 0 is clear white."""
    codes = F.array(*(F.lit(argb(*c, OPACITY)) for c in COLOURS))
    return F.when(weight == 0, F.lit(argb(255, 255, 255, 0))).otherwise(F.get(codes, st_colorize(weight, most)))


def _pictures(width, height, xs, ys, colours):
    import pandas as pd

    out = []
    for w, h, x, y, c in zip(width, height, xs, ys, colours, strict=True):
        image = np.zeros((h, w, 4), np.uint8)
        code = np.asarray(c, np.int64)
        for k, shift in enumerate((16, 8, 0, 24)):
            image[np.asarray(y, int), np.asarray(x, int), k] = code >> shift & 255
        out.append(png(image))
    return pd.Series(out, dtype=object)


def st_render(pixels: DataFrame, x: str, y: str, color: str, res_x: int, res_y: int, zoom: int = 0) -> DataFrame:
    """(tile, image): a PNG for each tile of the zoom level, y upwards; of a pixel's colours the greatest number shows.

    Colours of a pixel are reduced before the shuffle, so a tile's task gets at most its own pixels. Pixels beyond the
    resolution and null colours are left out; a tile without pixels has no row.
    """
    n = 1 << zoom
    width, height = res_x // n, res_y // n
    if width * n != res_x or height * n != res_y or not 0 < width * height <= MAX_PIXELS:
        raise ValueError(f"tiles need whole sizes and at most {MAX_PIXELS} pixels, not {res_x / n} by {res_y / n}")
    at = pixels.select(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"), F.col(color).cast("int").alias("c"))
    at = at.where(F.col("x").between(0, res_x - 1) & F.col("y").between(0, res_y - 1) & F.col("c").isNotNull())
    at = at.groupBy("x", "y").agg(F.max("c").alias("c"))
    tile = st_tilename(F.struct("x", "y"), res_x, res_y, zoom)
    down = F.lit(res_y - 1) - F.col("y")
    parts = at.groupBy(tile.alias("tile")).agg(F.collect_list(F.struct((F.col("x") % width).alias("x"), (down % height).alias("y"), "c")).alias("p"))
    return parts.select("tile", F.pandas_udf(_pictures, "binary")(F.lit(width), F.lit(height), *(F.col(f"p.{k}") for k in "xyc")).alias("image"))


def st_encodeimage(image) -> Column:
    return F.base64(image)
