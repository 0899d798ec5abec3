"""ST_* functions that need more than Column expressions: the planar kernels in Arrow batches, and WKB.

Give geometries as columns of the frame: select an ST_GeomFromWKT first, since Spark may not take a Python function out of
an expression that holds its parsing. Rows whose answer the bounding boxes give are sent as nulls and cost next to nothing. Null in, null out; shapes that a
function isn't defined for give null too, where its docstring doesn't say otherwise.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.functions import kernels as K
from terravane.session import ship_package

SHAPE = "struct<gtype:int,paths:array<array<struct<x:double,y:double>>>>"
ARROW_SHAPE = pa.struct([("gtype", pa.int32()), ("paths", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])
ARROW = {SHAPE: ARROW_SHAPE, f"array<{SHAPE}>": pa.list_(ARROW_SHAPE), "boolean": pa.bool_(), "binary": pa.binary(), "struct<x:double,y:double,r:double>": pa.struct([("x", pa.float64()), ("y", pa.float64()), ("r", pa.float64())])}


def _packed(value):
    if isinstance(value, tuple):
        return {"gtype": value[0], "paths": [[{"x": x, "y": y} for x, y in p] for p in value[1]]}
    return [_packed(v) for v in value] if isinstance(value, list) else value


#: While SQL functions are made: the kernels registered by name.
named: list[str] | None = None


def call(kernel: Callable, returns: str, *args: Column | tuple[Column, Column]) -> Column:
    """The kernel over rows without null arguments; shapes are (gtype, paths) pairs of columns."""
    spark = SparkSession.getActiveSession()
    if spark:
        ship_package(spark)
    kind, pairs = ARROW[returns], [isinstance(a, tuple) for a in args]

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(c.to_pylist() for c in columns)):
            if any(v is None for v in row):
                out.append(None)
                continue
            rest = iter(row)
            out.append(_packed(kernel(*((next(rest), [[(v["x"], v["y"]) for v in p] for p in next(rest)]) if pair else next(rest) for pair in pairs))))
        return pa.array(out, kind)

    udf = F.arrow_udf(run, returns)
    columns = [c for a in args for c in (a if isinstance(a, tuple) else (a,))]
    if named is None:
        return udf(*columns)
    name = f"terravane_kernel_{len(named)}"
    spark.udf.register(name, udf)
    named.append(name)
    return F.call_function(name, *columns)


def _shape(g, only: Column | None = None) -> tuple[Column, Column]:
    """What kernels read; without paths, and so skipped, where only doesn't hold."""
    g = G._g(g)
    return g.gtype.cast("int"), g.paths if only is None else F.when(only, g.paths)


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _geom(kernel: Callable, g, *more: Column, only: Column | None = None) -> Column:
    out = call(kernel, SHAPE, _shape(g, only), *more)
    return G.make(out.gtype, out.paths, G._g(g).srid)


def _geoms(kernel: Callable, g, *more: Column) -> Column:
    out = call(kernel, f"array<{SHAPE}>", _shape(g), *more)
    srid = G._g(g).srid
    return F.transform(out, lambda s: G.make(s.gtype, s.paths, srid))


def _area(g) -> Column:
    return G._g(g).gtype.isin(G.POLYGON, G.MULTIPOLYGON)


def st_convexhull(g) -> Column:
    return _geom(K.convex_hull, g)


def st_buffer(g, distance) -> Column:
    """Round caps and joins of 8 segments a quadrant; a negative distance shrinks."""
    return _geom(K.buffer, g, _value(distance).cast("double"))


def st_intersection(a, b) -> Column:
    """Of disjoint shapes: an empty polygon."""
    return _geom(K.intersection, a, _shape(b))


def st_union(a, b) -> Column:
    """Of areas."""
    return _geom(lambda s, t: K.area_shape(K.union_all([s[1], t[1]])), a, _shape(b), only=_area(a) & _area(b))


def st_union_all(paths) -> Column:
    """Of an array of areas' paths; null for none."""
    kernel = lambda many: K.area_shape(K.union_all([[[(v["x"], v["y"]) for v in p] for p in rings] for rings in many])) if many else None
    out = call(kernel, SHAPE, G._g(paths))
    return G.make(out.gtype, out.paths)


def st_intersection_all(shapes) -> Column:
    """Of an array of shapes as struct<gtype, paths>; an empty polygon once nothing is common, null for none."""
    kernel = lambda many: reduce(K.intersection, [(s["gtype"], [[(v["x"], v["y"]) for v in p] for p in s["paths"]]) for s in many]) if many else None
    out = call(kernel, SHAPE, G._g(shapes))
    return G.make(out.gtype, out.paths)


def st_isvalid(g) -> Column:
    return call(K.is_valid, "boolean", _shape(g))


def st_issimple(g) -> Column:
    return call(K.is_simple, "boolean", _shape(g))


def st_isring(g) -> Column:
    """Closed and simple; null for anything but lines."""
    return F.when(G._g(g).gtype == G.LINESTRING, G.st_isclosed(g) & st_issimple(g))


def st_makevalid(g, remove_holes: bool = False) -> Column:
    """The valid polygons as an array, for F.explode; null for anything but areas."""
    return _geoms(lambda s, r: K.make_valid(s, r) if K.is_area(s) else None, g, _value(remove_holes))


def st_simplifypreservetopology(g, tolerance) -> Column:
    return _geom(K.simplify, g, _value(tolerance).cast("double"))


def st_minimumboundingcircle(g, quadrant_segments: int = K.QUADRANT_SEGMENTS) -> Column:
    return _geom(K.bounding_circle, g, _value(quadrant_segments))


def _circle(s):
    points = [p for path in s[1] for p in path]
    return dict(zip("xyr", K.enclosing(points))) if points else None


def st_minimumboundingradius(g) -> Column:
    """struct<center, radius>."""
    c = call(_circle, "struct<x:double,y:double,r:double>", _shape(g))
    return F.when(c.isNotNull(), F.struct(G.st_point(c.x, c.y).alias("center"), c.r.alias("radius")))


def st_linemerge(g) -> Column:
    """Multi-lines joined; lines as they are; anything else is null, for want of collections."""
    return F.when(G._g(g).gtype == G.LINESTRING, G._g(g)).otherwise(_geom(K.line_merge, g, only=G._g(g).gtype == G.MULTILINESTRING))


def st_subdivide(g, max_vertices: int) -> Column:
    """Parts of at most so many vertices; none for fewer than 5."""
    return _geoms(K.subdivide, g, _value(max_vertices))


def st_subdivideexplode(g, max_vertices: int) -> Column:
    return F.explode(st_subdivide(g, max_vertices)).alias("geom")


# Predicates, exact for all shapes


def _predicate(kernel: Callable, native: Callable | None, bound: Callable):
    def test(a, b) -> Column:
        a, b = G._g(a), G._g(b)
        quick = (lambda g: G.is_box(g) | (g.gtype == G.POINT)) if native else (lambda g: F.lit(False))
        near, easy = bound(a, b), quick(a) & quick(b)
        slow = call(kernel, "boolean", _shape(a, near & ~easy), _shape(b))
        return F.when(~near, F.lit(False)).when(easy, native(a, b) if native else F.lit(False)).when(near, slow)

    return test


def _same_box(a: Column, b: Column) -> Column:
    return G.box_covers(a, b) & G.box_covers(b, a)


def _box_covers(a: Column, b: Column) -> Column:
    return G.box_covers(a, b)


st_intersects = _predicate(K.intersects, G.st_intersects, G.boxes_meet)
st_contains = _predicate(K.covers, G.st_contains, _box_covers)
st_equals = _predicate(K.equals, G.st_equals, _same_box)
st_touches = _predicate(K.touches, None, G.boxes_meet)
st_overlaps = _predicate(K.overlaps, None, G.boxes_meet)
st_crosses = _predicate(K.crosses, None, G.boxes_meet)


def st_within(a, b) -> Column:
    return st_contains(b, a)


# WKB


def _write_one(s: K.Shape, srid: int = 0) -> bytes:
    kind, paths = s
    head = struct.pack("<BI", 1, kind | (0x20000000 if srid else 0)) + (struct.pack("<i", srid) if srid else b"")
    path = lambda p: struct.pack(f"<I{2 * len(p)}d", len(p), *(c for v in p for c in v))
    if kind == K.POINT:
        return head + struct.pack("<2d", *paths[0][0])
    if kind == K.LINESTRING:
        return head + path(paths[0])
    if kind == K.POLYGON:
        return head + struct.pack("<I", len(paths)) + b"".join(map(path, paths))
    parts = [(K.POINT, [[v]]) for p in paths for v in p] if kind == K.MULTIPOINT else [(K.LINESTRING, [p]) for p in paths] if kind == K.MULTILINESTRING else [(K.POLYGON, p) for p in K.split_polygons(s)]
    return head + struct.pack("<I", len(parts)) + b"".join(map(_write_one, parts))


def oriented(rings: list) -> list:
    """A polygon's shell turned left and its holes right, as multi-polygons keep them."""
    return [r if (K.signed_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]


def _read_one(data: bytes, at: int = 0) -> tuple[K.Shape, int, int]:
    """(shape, SRID, end). Third and fourth coordinates are dropped."""
    order = "<" if data[at] else ">"
    (word,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    srid = 0
    if word & 0x20000000:
        (srid,) = struct.unpack_from(order + "i", data, at)
        at += 4
    kind = word & 0x0FFFFFFF
    width = 2 + bool(word & 0x80000000) + bool(word & 0x40000000) + (kind // 1000 + 1) // 2
    kind %= 1000

    def path(at: int, n: int | None = None):
        if n is None:
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
        flat = struct.unpack_from(f"{order}{n * width}d", data, at)
        return list(zip(flat[::width], flat[1::width])), at + 8 * n * width

    if kind == K.POINT:
        p, at = path(at, 1)
        return (kind, [p]), srid, at
    if kind == K.LINESTRING:
        p, at = path(at)
        return (kind, [p]), srid, at
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    parts = []
    for _ in range(n):
        if kind == K.POLYGON:
            p, at = path(at)
            parts.append(p)
        elif kind in (K.MULTIPOINT, K.MULTILINESTRING, K.MULTIPOLYGON):
            part, _, at = _read_one(data, at)
            parts.append(part[1])
        else:
            raise ValueError("not a known shape")
    if kind == K.MULTIPOINT:
        return (kind, [[v for p in parts for v in p[0]]]), srid, at
    if kind == K.MULTIPOLYGON:
        return (kind, [r for p in parts for r in oriented(p)]), srid, at
    return (kind, parts if kind == K.POLYGON else [p[0] for p in parts]), srid, at


def _read(data: bytes):
    try:
        return _read_one(data)[0]
    except (ValueError, IndexError, struct.error):
        return None


def _srid_of(data: Column) -> Column:
    byte = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("long")
    little = byte(1) == 1
    value = sum((byte(6 + k) * F.when(little, 1 << 8 * k).otherwise(1 << 8 * (3 - k)) for k in range(4)), F.lit(0))
    flags = F.when(little, byte(5)).otherwise(byte(2))
    return F.when(flags.bitwiseAND(0x20) != 0, value).otherwise(F.lit(0)).cast("int")


def st_geomfromwkb(data, binary: bool = False) -> Column:
    """From hex text, or from bytes; either byte order, with or without SRID; anything else is null."""
    raw = G._g(data) if binary else F.unhex(G._g(data))
    out = call(_read, SHAPE, raw)
    return G.make(out.gtype, out.paths, _srid_of(raw))


def st_asbinary(g) -> Column:
    return call(_write_one, "binary", _shape(g))


def st_asewkb(g) -> Column:
    """The SRID stands in the bytes where it isn't 0."""
    return call(_write_one, "binary", _shape(g), G._g(g).srid)


# The names that Spark has for its own geometry type can't be SQL functions: they are registered as Python functions


def _row_geometry(data: bytes | None):
    shape = None if data is None else _read(data)
    if shape is None:
        return None
    points = [v for p in shape[1] for v in p]
    low, high = ([f(v[k] for v in points) if points else None for k in (0, 1)] for f in (min, max))
    return {"gtype": shape[0], "srid": _read_one(data)[1], "xmin": low[0], "ymin": low[1], "xmax": high[0], "ymax": high[1], "paths": _packed(shape)["paths"]}


def register_shadows(spark: SparkSession) -> list[str]:
    """ST_SRID, ST_SetSRID, ST_AsBinary and ST_GeomFromWKB (hex text) over this package's geometries."""
    ship_package(spark)
    row = ARROW_SHAPE.field("paths").type
    full = pa.struct([("gtype", pa.int8()), ("srid", pa.int32()), *((c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")), ("paths", row)])

    def srid(g: pa.Array) -> pa.Array:
        return pa.array([v and v["srid"] for v in g.to_pylist()], pa.int32())

    def set_srid(g: pa.Array, to: pa.Array) -> pa.Array:
        return pa.array([v and v | {"srid": s} for v, s in zip(g.to_pylist(), to.to_pylist())], full)

    def as_binary(g: pa.Array) -> pa.Array:
        return pa.array([v and _write_one((v["gtype"], [[(p["x"], p["y"]) for p in path] for path in v["paths"]])) for v in g.to_pylist()], pa.binary())

    def from_wkb(text: pa.Array) -> pa.Array:
        return pa.array([_row_geometry(_unhex(v)) for v in text.to_pylist()], full)

    made = {"ST_SRID": (srid, "int"), "ST_SetSRID": (set_srid, G.GEOM), "ST_AsBinary": (as_binary, "binary"), "ST_GeomFromWKB": (from_wkb, G.GEOM)}
    for name, (f, kind) in made.items():
        spark.udf.register(name, F.arrow_udf(f, kind))
    return list(made)


def _unhex(text: str | None) -> bytes | None:
    try:
        return None if text is None else bytes.fromhex(text)
    except ValueError:
        return None
