"""Geometry values and ST_* functions as native Column expressions.

A geometry is a struct of its type, SRID, bounding box and paths: one path of one vertex for a point, one path for a
line, rings (shell first) for a polygon, and for a multi-polygon the rings of all, shells turning left and holes right. Bounding boxes are plain columns, so their tests prune Parquet row groups and
join cells come from arithmetic. Null in, null out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON = 1, 2, 3, 4, 5, 6
NAMES = {POINT: "Point", LINESTRING: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINESTRING: "MultiLineString", MULTIPOLYGON: "MultiPolygon"}
GEOM = "struct<gtype:tinyint,srid:int,xmin:double,ymin:double,xmax:double,ymax:double,paths:array<array<struct<x:double,y:double>>>>"
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).cast("double")


def _g(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(f):
    """Bind the first argument, unless it is a plain column: nested calls would copy it each time it is named."""
    @functools.wraps(f)
    def call(g, *args, **kw):
        plain = isinstance(g, str) or re.fullmatch(r"Column<'[\w.]+'>", repr(g))
        return f(g, *args, **kw) if plain else bind(g, lambda v: f(v, *args, **kw))

    return call


def make(gtype: Column, paths: Column, srid: Column | None = None) -> Column:
    """A geometry of paths, with its bounding box."""
    raw = F.struct(gtype.cast("tinyint").alias("gtype"), paths.alias("paths"), (F.lit(0) if srid is None else srid).cast("int").alias("srid"))

    def built(r: Column) -> Column:
        flat = F.flatten(r.paths)
        xs, ys = F.transform(flat, lambda p: p.x), F.transform(flat, lambda p: p.y)
        out = F.struct(
            r.gtype.alias("gtype"), r.srid.alias("srid"), F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
            F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"), r.paths.alias("paths"),
        )
        return F.when(r.paths.isNotNull() & r.gtype.isNotNull(), out)

    return bind(raw, built)


def _bounded(gtype: int, xmin: Column, ymin: Column, xmax: Column, ymax: Column, paths: Column) -> Column:
    out = F.struct(F.lit(gtype).cast("tinyint").alias("gtype"), F.lit(0).alias("srid"), xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"), paths.alias("paths"))
    return F.when(xmin.isNotNull() & ymin.isNotNull() & xmax.isNotNull() & ymax.isNotNull(), out)


def st_point(x, y) -> Column:
    x, y = _d(x), _d(y)
    return _bounded(POINT, x, y, x, y, F.array(F.array(vertex(x, y))))


def st_polygonfromenvelope(xmin, ymin, xmax, ymax) -> Column:
    a, b, c, d = map(_d, (xmin, ymin, xmax, ymax))
    ring = F.array(vertex(a, b), vertex(a, d), vertex(c, d), vertex(c, b), vertex(a, b))
    return _bounded(POLYGON, F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d), F.array(ring))


def _exactly(delim) -> Column:
    """A pattern of the delimiter itself."""
    return F.concat(F.lit("\\Q"), delim if isinstance(delim, Column) else F.lit(delim), F.lit("\\E"))


def _pairs(text: Column, delim: str) -> Column:
    n = F.transform(F.split(text, _exactly(delim)), lambda t: F.trim(t).try_cast("double"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda k: vertex(F.get(n, 2 * k), F.get(n, 2 * k + 1)))


def st_pointfromtext(text, delim: str = ",") -> Column:
    parts = F.split(_g(text), _exactly(delim))
    return st_point(F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double"))


def st_linestringfromtext(text, delim: str = ",") -> Column:
    return make(F.lit(LINESTRING), F.array(_pairs(_g(text), delim)))


def st_polygonfromtext(text, delim: str = ",") -> Column:
    return make(F.lit(POLYGON), F.array(_pairs(_g(text), delim)))


def multi_rings(polygons: Column) -> Column:
    """The rings of all polygons, shells turned left and holes right."""
    turn = lambda r, k: F.when((_signed_area(r) > 0) == (k == 0), r).otherwise(F.reverse(r))
    return F.flatten(F.transform(polygons, lambda p: F.transform(p, turn)))


def st_geomfromwkt(wkt) -> Column:
    """POINT, LINESTRING, POLYGON and their MULTI forms; anything else is null."""
    number = r"([-+]?[0-9.]+(?:[eE][-+]?\d+)?)"
    codes = F.create_map(*(x for k, n in NAMES.items() for x in (F.lit(n.upper()), F.lit(k))))

    def parts(first: Column) -> Column:
        body = F.regexp_extract(first, r"^\s*\w+\s*(\(.*\))\s*$", 1)
        json = F.translate(F.regexp_replace(body, rf"{number}\s+{number}(?:\s+[-+0-9.eE]+)*", '{"x":$1,"y":$2}'), "()", "[]")
        return F.struct(F.upper(F.regexp_extract(first, r"^\s*(\w+)\s*\(", 1)).alias("kind"), json.alias("json"))

    def shape(t: Column) -> Column:
        kind, json = t.kind, t.json
        one = F.when(kind.isin("POLYGON", "MULTILINESTRING"), json).when(kind == "MULTIPOINT", F.concat(F.lit("["), F.regexp_replace(json, r"\[\s*(\{[^}]*\})\s*\]", "$1"), F.lit("]"))).when(kind.isin("POINT", "LINESTRING"), F.concat(F.lit("["), json, F.lit("]")))
        parsed = lambda p: F.when(~F.exists(F.flatten(p), lambda v: v.x.isNull() | v.y.isNull()), make(F.try_element_at(codes, kind), p))
        paths = F.from_json(one, "array<array<struct<x:double,y:double>>>", {"mode": "PERMISSIVE"})
        many = F.from_json(F.when(kind == "MULTIPOLYGON", json), "array<array<array<struct<x:double,y:double>>>>")
        return bind(F.when(kind == "MULTIPOLYGON", multi_rings(many)).otherwise(paths), parsed)

    # each step is bound, or the text would be made and searched again for every mention of it
    return bind(F.trim(F.split(_g(wkt), "\t")[0]), lambda first: bind(parts(first), shape))


st_geomfromtext = st_geomfromwkt


def st_geomfromgeojson(text) -> Column:
    """Features and bare geometries of Point, LineString, Polygon and their Multi forms."""
    raw = _g(text)
    at = lambda path: F.coalesce(F.get_json_object(raw, f"$.geometry.{path}"), F.get_json_object(raw, f"$.{path}"))
    kind, coords = at("type"), at("coordinates")
    flat = kind.isin("LineString", "MultiPoint")
    rings = F.from_json(F.when(kind == "Point", F.concat(F.lit("[["), coords, F.lit("]]"))).when(flat, F.concat(F.lit("["), coords, F.lit("]"))).when(kind != "MultiPolygon", coords), "array<array<array<double>>>")
    pair = lambda p: vertex(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    many = F.from_json(F.when(kind == "MultiPolygon", coords), "array<array<array<array<double>>>>")
    many = F.transform(many, lambda rings: F.transform(rings, lambda r: F.transform(r, pair)))
    paths = F.when(kind == "MultiPolygon", multi_rings(many)).otherwise(F.transform(rings, lambda r: F.transform(r, pair)))
    codes = F.create_map(*(x for k, n in NAMES.items() for x in (F.lit(n), F.lit(k))))
    return make(F.try_element_at(codes, kind), paths)


def st_geomfromgeohash(text, precision: int | None = None) -> Column:
    """The cell of a hash, in either case, cut to the precision; a bad character or a negative precision gives null."""
    if precision is not None and precision < 0:
        return F.lit(None).cast(GEOM)
    chars = F.split(F.lower(_g(text)), "")
    chars = chars if precision is None else F.slice(chars, 1, precision)
    codes = F.transform(chars, lambda c: F.instr(F.lit(BASE32), c) - 1)
    bits = F.flatten(F.transform(codes, lambda v: F.array(*(F.shiftright(v, k).bitwiseAND(1) for k in (4, 3, 2, 1, 0)))))
    state = F.struct(F.lit(-180.0).alias("a"), F.lit(180.0).alias("b"), F.lit(-90.0).alias("c"), F.lit(90.0).alias("d"), F.lit(True).alias("even"))

    def halve(s: Column, bit: Column) -> Column:
        one, midx, midy = bit == 1, (s.a + s.b) / 2, (s.c + s.d) / 2
        return F.struct(
            F.when(s.even & one, midx).otherwise(s.a).alias("a"), F.when(s.even & ~one, midx).otherwise(s.b).alias("b"),
            F.when(~s.even & one, midy).otherwise(s.c).alias("c"), F.when(~s.even & ~one, midy).otherwise(s.d).alias("d"), (~s.even).alias("even"),
        )

    cell = bind(F.aggregate(bits, state, halve), lambda box: st_polygonfromenvelope(box.a, box.c, box.b, box.d))
    return F.when(~F.exists(codes, lambda v: v < 0), cell)


def st_x(g) -> Column:
    return F.when(_g(g).gtype == POINT, _g(g).xmin)


def st_y(g) -> Column:
    return F.when(_g(g).gtype == POINT, _g(g).ymin)


def st_srid(g) -> Column:
    return _g(g).srid


def st_setsrid(g, srid) -> Column:
    return F.when(_g(g).isNotNull(), _g(g).withField("srid", (srid if isinstance(srid, Column) else F.lit(srid)).cast("int")))


def st_geometrytype(g) -> Column:
    return F.element_at(F.create_map(*(x for k, n in NAMES.items() for x in (F.lit(k).cast("tinyint"), F.lit("ST_" + n)))), _g(g).gtype)


@once
def st_npoints(g) -> Column:
    return F.aggregate(_g(g).paths, F.lit(0), lambda n, p: n + F.size(p))


def _steps(path: Column, f) -> Column:
    """f of each edge's ends."""
    return F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), f)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


@once
def st_length(g) -> Column:
    """Length of lines, perimeter of polygons, 0 for points."""
    whole = _sum(F.transform(_g(g).paths, lambda p: _sum(_steps(p, lambda a, b: F.hypot(b.x - a.x, b.y - a.y)))))
    return F.when(_g(g).gtype.isin(POINT, MULTIPOINT), F.lit(0.0)).otherwise(whole)


def _signed_area(p: Column) -> Column:
    first = F.get(p, F.lit(0))  # relative to a vertex, for precision
    return _sum(_steps(p, lambda a, b: (a.x - first.x) * (b.y - first.y) - (b.x - first.x) * (a.y - first.y))) / 2


def _ring_area(p: Column) -> Column:
    return F.abs(_signed_area(p))


@once
def st_area(g) -> Column:
    """Shell less holes; 0 for points and lines."""
    areas = F.transform(_g(g).paths, _ring_area)
    one = F.coalesce(2 * F.get(areas, F.lit(0)) - _sum(areas), F.lit(0.0))
    return F.when(_g(g).gtype == POLYGON, one).when(_g(g).gtype == MULTIPOLYGON, _sum(F.transform(_g(g).paths, _signed_area))).when(_g(g).isNotNull(), F.lit(0.0))


@once
def st_centroid(g) -> Column:
    """Of the area of all shells less their holes, of the length of all lines, of all points; null where that is 0."""
    paths, gtype = _g(g).paths, _g(g).gtype
    o = F.get(F.get(paths, F.lit(0)), F.lit(0))
    cross = lambda a, b: (a.x - o.x) * (b.y - o.y) - (b.x - o.x) * (a.y - o.y)
    size = lambda a, b: F.hypot(b.x - a.x, b.y - a.y)

    def ring(p: Column, k: Column) -> Column:  # twice the area and the moments; shells count for, holes against
        twice = _sum(_steps(p, cross))
        sign = F.when(gtype == MULTIPOLYGON, F.lit(1.0)).otherwise(F.signum(twice) * F.when(k == 0, 1.0).otherwise(-1.0))
        return F.struct((sign * twice).alias("w"), (sign * _sum(_steps(p, lambda a, b: (a.x + b.x - 2 * o.x) * cross(a, b)))).alias("x"), (sign * _sum(_steps(p, lambda a, b: (a.y + b.y - 2 * o.y) * cross(a, b)))).alias("y"))

    def line(p: Column) -> Column:
        return F.struct(_sum(_steps(p, size)).alias("w"), _sum(_steps(p, lambda a, b: (a.x + b.x) / 2 * size(a, b))).alias("x"), _sum(_steps(p, lambda a, b: (a.y + b.y) / 2 * size(a, b))).alias("y"))

    def total(parts: Column, name: str) -> Column:
        return _sum(F.transform(parts, lambda s: s[name]))

    rings, lines, points = F.transform(paths, ring), F.transform(paths, line), F.flatten(paths)
    area = bind(rings, lambda r: st_point(o.x + F.try_divide(total(r, "x"), 3 * total(r, "w")), o.y + F.try_divide(total(r, "y"), 3 * total(r, "w"))))
    along = bind(lines, lambda r: st_point(F.try_divide(total(r, "x"), total(r, "w")), F.try_divide(total(r, "y"), total(r, "w"))))
    mean = st_point(F.try_divide(_sum(F.transform(points, lambda v: v.x)), F.size(points).cast("double")), F.try_divide(_sum(F.transform(points, lambda v: v.y)), F.size(points).cast("double")))
    return F.when(gtype.isin(POLYGON, MULTIPOLYGON), area).when(gtype.isin(LINESTRING, MULTILINESTRING), along).otherwise(mean)


@once
def st_envelope(g) -> Column:
    g = _g(g)
    box = st_polygonfromenvelope(g.xmin, g.ymin, g.xmax, g.ymax)
    line = make(F.lit(LINESTRING), F.array(F.array(vertex(g.xmin, g.ymin), vertex(g.xmax, g.ymax))))
    return F.when((g.xmin == g.xmax) & (g.ymin == g.ymax), st_point(g.xmin, g.ymin)).when((g.xmin == g.xmax) | (g.ymin == g.ymax), line).otherwise(box)


def _line_end(g, at: int) -> Column:
    v = F.element_at(F.get(_g(g).paths, F.lit(0)), at)
    return F.when(_g(g).gtype == LINESTRING, st_point(v.x, v.y))


@once
def st_startpoint(g) -> Column:
    return _line_end(g, 1)


@once
def st_endpoint(g) -> Column:
    return _line_end(g, -1)


@once
def st_isclosed(g) -> Column:
    p = F.get(_g(g).paths, F.lit(0))
    return F.when(_g(g).gtype == LINESTRING, F.get(p, F.lit(0)) == F.element_at(p, -1)).when(_g(g).isNotNull(), F.lit(True))


@once
def st_exteriorring(g) -> Column:
    return F.when(_g(g).gtype == POLYGON, make(F.lit(LINESTRING), F.slice(_g(g).paths, 1, 1), _g(g).srid))


@once
def st_numinteriorrings(g) -> Column:
    return F.when(_g(g).gtype == POLYGON, F.size(_g(g).paths) - 1)


@once
def st_interiorringn(g, n: int) -> Column:
    ring = F.get(_g(g).paths, F.lit(n + 1))
    return F.when((_g(g).gtype == POLYGON) & (F.lit(n) >= 0), make(F.lit(LINESTRING), F.when(ring.isNotNull(), F.array(ring))))


@once
def _polygons(paths: Column) -> Column:
    """A multi-polygon's rings by polygon: a shell turns left and begins one."""
    starts = F.filter(F.transform(paths, lambda p, k: F.when(_signed_area(p) > 0, k)), lambda k: k.isNotNull())
    return F.transform(starts, lambda s, j: F.slice(paths, s + 1, F.coalesce(F.get(starts, j + 1), F.size(paths)) - s))


@once
def st_numgeometries(g) -> Column:
    return F.when(_g(g).gtype == MULTIPOINT, st_npoints(g)).when(_g(g).gtype == MULTILINESTRING, F.size(_g(g).paths)).when(_g(g).gtype == MULTIPOLYGON, F.size(_polygons(_g(g).paths))).when(_g(g).isNotNull(), F.lit(1))


@once
def st_dumppoints(g) -> Column:
    return F.transform(F.flatten(_g(g).paths), lambda v: st_point(v.x, v.y))


@once
def st_dump(g) -> Column:
    lines = F.transform(_g(g).paths, lambda p: make(F.lit(LINESTRING), F.array(p)))
    return F.when(_g(g).gtype == MULTIPOINT, st_dumppoints(g)).when(_g(g).gtype == MULTILINESTRING, lines).when(_g(g).gtype == MULTIPOLYGON, F.transform(_polygons(_g(g).paths), lambda p: make(F.lit(POLYGON), p))).when(_g(g).isNotNull(), F.array(_g(g)))


def st_geometryn(g, n: int) -> Column:
    return F.get(st_dump(g), F.lit(n))


@once
def st_makepolygon(line, holes=None) -> Column:
    """Of a closed line, and an array of closed lines as its holes."""
    if holes is not None:
        shell = st_makepolygon(line)
        rings = F.transform(_g(holes), lambda h: F.get(h.paths, F.lit(0)))
        closed = F.forall(rings, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1)))
        return F.when(closed, make(F.lit(POLYGON), F.concat(shell.paths, rings), _g(line).srid))
    p = F.get(_g(line).paths, F.lit(0))
    closed = (_g(line).gtype == LINESTRING) & (F.size(p) >= 4) & (F.get(p, F.lit(0)) == F.element_at(p, -1))
    return F.when(closed, make(F.lit(POLYGON), _g(line).paths, _g(line).srid))


@once
def st_addpoint(line, point, at: int = -1) -> Column:
    p, v = F.get(_g(line).paths, F.lit(0)), vertex(_g(point).xmin, _g(point).ymin)
    n = F.size(p)
    at = at if isinstance(at, Column) else F.lit(at)
    k = F.when(at == -1, n).otherwise(at)
    new = F.concat(F.slice(p, 1, F.greatest(k, F.lit(0))), F.array(v), F.slice(p, F.greatest(k, F.lit(0)) + 1, F.greatest(n - k, F.lit(0))))
    return F.when((_g(line).gtype == LINESTRING) & (_g(point).gtype == POINT) & (at <= n) & (at >= -1), make(F.lit(LINESTRING), F.array(new)))


@once
def st_removepoint(line, at: int) -> Column:
    p = F.get(_g(line).paths, F.lit(0))
    ok = (_g(line).gtype == LINESTRING) & (F.size(p) > 2) & (F.lit(at) < F.size(p)) & (F.lit(at) >= 0)
    return F.when(ok, make(F.lit(LINESTRING), F.array(F.filter(p, lambda v, k: k != at))))


def _each_vertex(g, f) -> Column:
    return make(_g(g).gtype, F.transform(_g(g).paths, lambda p: F.transform(p, f)), _g(g).srid)


@once
def _along(path: Column, share: Column) -> Column:
    """The vertex at a share of a path's length, with the edge it lies on."""
    sizes = _steps(path, lambda a, b: F.hypot(b.x - a.x, b.y - a.y))
    ends = F.aggregate(sizes, F.array(F.lit(0.0)), lambda out, v: F.concat(out, F.array(F.element_at(out, -1) + v)))

    def at(ends: Column) -> Column:
        want = F.element_at(ends, -1) * share
        k = F.greatest(F.lit(1), F.least(F.size(F.filter(ends, lambda v: v <= want)), F.size(path) - 1))
        a, b, low = F.get(path, k - 1), F.get(path, k), F.get(ends, k - 1)
        t = F.coalesce(F.try_divide(want - low, F.get(ends, k) - low), F.lit(0.0))
        return F.struct(k.alias("k"), (a.x + t * (b.x - a.x)).alias("x"), (a.y + t * (b.y - a.y)).alias("y"))

    return bind(ends, at)


@once
def st_lineinterpolatepoint(line, share) -> Column:
    """Null unless a line and a share from 0 to 1."""
    share = _d(share)
    at = bind(_along(F.get(_g(line).paths, F.lit(0)), share), lambda at: st_point(at.x, at.y))
    return F.when((_g(line).gtype == LINESTRING) & share.between(0, 1), at)


@once
def st_linesubstring(line, low, high) -> Column:
    """Null unless a line and 0 <= low <= high <= 1."""
    low, high = _d(low), _d(high)
    p = F.get(_g(line).paths, F.lit(0))
    ends = F.struct(_along(p, low).alias("a"), _along(p, high).alias("b"))
    path = bind(ends, lambda e: _between(p, e.a, e.b))
    return F.when((_g(line).gtype == LINESTRING) & (low >= 0) & (low <= high) & (high <= 1), make(F.lit(LINESTRING), F.array(path), _g(line).srid))


def _between(p: Column, a: Column, b: Column) -> Column:
    """The path's part from one place to another, without vertices twice."""
    part = F.concat(F.array(vertex(a.x, a.y)), F.slice(p, a.k + 1, F.greatest(b.k - a.k, F.lit(0))), F.array(vertex(b.x, b.y)))
    return bind(part, lambda q: F.filter(q, lambda v, k: (k == 0) | (k == F.size(q) - 1) | ((v != F.get(q, k - 1)) & (v != F.element_at(q, -1)))))


@once
def st_boundary(g) -> Column:
    """Rings of areas, ends of lines that an odd number of them share; an empty polygon where there is none."""
    g = _g(g)
    rings = make(F.when(F.size(g.paths) == 1, F.lit(LINESTRING)).otherwise(F.lit(MULTILINESTRING)), g.paths, g.srid)
    ends = F.flatten(F.transform(g.paths, lambda p: F.array(F.get(p, F.lit(0)), F.element_at(p, -1))))
    odd = F.array_distinct(F.filter(ends, lambda e: F.size(F.filter(ends, lambda o: o == e)) % 2 == 1))
    none = make(F.lit(POLYGON), F.slice(g.paths, 1, 0), g.srid)
    return F.when(g.gtype.isin(POLYGON, MULTIPOLYGON), rings).when(g.gtype.isin(LINESTRING, MULTILINESTRING) & (F.size(odd) > 0), make(F.lit(MULTIPOINT), F.array(odd), g.srid)).when(g.isNotNull(), none)


@once
def st_flipcoordinates(g) -> Column:
    return _each_vertex(g, lambda v: vertex(v.y, v.x))


@once
def st_precisionreduce(g, scale: int) -> Column:
    k = F.pow(F.lit(10.0), scale if isinstance(scale, Column) else F.lit(scale))
    return _each_vertex(g, lambda v: vertex(F.floor(v.x * k + 0.5) / k, F.floor(v.y * k + 0.5) / k))


@once
def st_transform(g, source: str, target: str) -> Column:
    """Between EPSG:4326 (latitude first, as EPSG has it) and EPSG:3857."""
    r = 6378137.0
    if source == target:
        return _g(g)
    if (source, target) == ("epsg:4326", "epsg:3857"):
        return _each_vertex(g, lambda v: vertex(F.radians(v.y) * r, F.log(F.tan(F.radians(v.x) / 2 + F.lit(3.141592653589793) / 4)) * r))
    if (source, target) == ("epsg:3857", "epsg:4326"):
        return _each_vertex(g, lambda v: vertex(F.degrees(2 * F.atan(F.exp(v.y / r)) - F.lit(3.141592653589793) / 2), F.degrees(v.x / r)))
    raise ValueError(f"no transform from {source} to {target}")


def _number(c: Column) -> Column:
    """Plain digits, without a trailing .0."""
    return F.regexp_replace(F.when((F.abs(c) < 1e15) & (c == F.floor(c)), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")), r"\.0$", "")


@once
def st_astext(g) -> Column:
    g = _g(g)
    path = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda v: F.concat_ws(" ", _number(v.x), _number(v.y))), ", "), F.lit(")"))
    nested = F.concat(F.lit("("), F.array_join(F.transform(g.paths, path), ", "), F.lit(")"))
    name = F.upper(F.substring(st_geometrytype(g), 4, 30))
    many = F.concat(F.lit("("), F.array_join(F.transform(_polygons(g.paths), lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, path), ", "), F.lit(")"))), ", "), F.lit(")"))
    return F.concat(name, F.lit(" "), F.when(F.size(g.paths) == 0, F.lit("EMPTY")).when(g.gtype == MULTIPOLYGON, many).when(g.gtype.isin(POLYGON, MULTILINESTRING), nested).otherwise(path(F.get(g.paths, F.lit(0)))))


@once
def st_asgeojson(g) -> Column:
    g = _g(g)
    pair = lambda v: F.concat(F.lit("["), v.x.cast("string"), F.lit(","), v.y.cast("string"), F.lit("]"))
    path = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, pair), ","), F.lit("]"))
    body = F.when(g.gtype == POINT, pair(F.get(F.get(g.paths, F.lit(0)), F.lit(0)))).when(g.gtype.isin(LINESTRING, MULTIPOINT), path(F.get(g.paths, F.lit(0)))).when(g.gtype == MULTIPOLYGON, F.concat(F.lit("["), F.array_join(F.transform(_polygons(g.paths), lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, path), ","), F.lit("]"))), ","), F.lit("]"))).otherwise(F.concat(F.lit("["), F.array_join(F.transform(g.paths, path), ","), F.lit("]")))
    return F.concat(F.lit('{"type":"'), F.substring(st_geometrytype(g), 4, 30), F.lit('","coordinates":'), body, F.lit("}"))


def st_azimuth(a, b) -> Column:
    angle = F.atan2(_g(b).xmin - _g(a).xmin, _g(b).ymin - _g(a).ymin)
    return F.when((_g(a).gtype == POINT) & (_g(b).gtype == POINT), F.when(angle < 0, angle + 2 * 3.141592653589793).otherwise(angle))


@once
def st_geohash(g, precision: int) -> Column:
    """Of the centre of the envelope; null outside longitude and latitude; at most 20 characters."""
    x, y = (_g(g).xmin + _g(g).xmax) / 2, (_g(g).ymin + _g(g).ymax) / 2
    precision = precision if isinstance(precision, Column) else F.lit(precision)
    bits = 5 * F.least(precision, F.lit(20))
    state = F.struct(F.lit(-180.0).alias("a"), F.lit(180.0).alias("b"), F.lit(-90.0).alias("c"), F.lit(90.0).alias("d"), F.lit(0).alias("v"), F.lit("").alias("s"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        midx, midy = (s.a + s.b) / 2, (s.c + s.d) / 2
        one = F.when(even, x >= midx).otherwise(y >= midy)
        v = s.v * 2 + one.cast("int")
        done = k % 5 == 4
        return F.struct(
            F.when(even & one, midx).otherwise(s.a).alias("a"), F.when(even & ~one, midx).otherwise(s.b).alias("b"),
            F.when(~even & one, midy).otherwise(s.c).alias("c"), F.when(~even & ~one, midy).otherwise(s.d).alias("d"),
            F.when(done, F.lit(0)).otherwise(v).alias("v"), F.when(done, F.concat(s.s, F.substring(F.lit(BASE32), v + 1, F.lit(1)))).otherwise(s.s).alias("s"),
        )

    hashed = F.when(bits > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(bits, F.lit(1)) - 1), state, step, lambda s: s.s)).otherwise(F.lit(""))
    return F.when(x.between(-180, 180) & y.between(-90, 90), hashed)


# Predicates and distance


def is_box(g) -> Column:
    """Polygons that are their own bounding box."""
    g = _g(g)
    side = (g.xmax - g.xmin) * (g.ymax - g.ymin)
    return (g.gtype == POLYGON) & (F.size(g.paths) == 1) & (F.size(F.get(g.paths, F.lit(0))) == 5) & (F.abs(_ring_area(F.get(g.paths, F.lit(0))) - side) <= 1e-12 * side)


def boxes_meet(a, b) -> Column:
    a, b = _g(a), _g(b)
    return (a.xmin <= b.xmax) & (b.xmin <= a.xmax) & (a.ymin <= b.ymax) & (b.ymin <= a.ymax)


def box_covers(a, b) -> Column:
    a, b = _g(a), _g(b)
    return (a.xmin <= b.xmin) & (b.xmax <= a.xmax) & (a.ymin <= b.ymin) & (b.ymax <= a.ymax)


def _side(a: Column, b: Column, x: Column, y: Column) -> Column:
    return (b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x)


def _on_edge(p: Column, x: Column, y: Column) -> Column:
    return F.exists(_steps(p, lambda a, b: (_side(a, b, x, y) == 0) & x.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) & y.between(F.least(a.y, b.y), F.greatest(a.y, b.y))), lambda t: t)


def _crossings(p: Column, x: Column, y: Column) -> Column:
    """Edges that a ray to the right of the point crosses."""
    up = lambda a, b: ((a.y > y) != (b.y > y)) & ((_side(a, b, x, y) > 0) == (b.y > a.y))
    return F.aggregate(_steps(p, up), F.lit(0), lambda n, t: n + t.cast("int"))


def covers_point(g, x: Column, y: Column) -> Column:
    """Boundary included; even-odd over all rings."""
    g = _g(g)
    edge = F.exists(g.paths, lambda p: _on_edge(p, x, y))
    inside = F.aggregate(g.paths, F.lit(0), lambda n, p: n + _crossings(p, x, y)) % 2 == 1
    at = F.exists(F.flatten(g.paths), lambda v: (v.x == x) & (v.y == y))
    return F.when(g.gtype.isin(POLYGON, MULTIPOLYGON), edge | inside).when(g.gtype.isin(LINESTRING, MULTILINESTRING), edge).otherwise(at)


def _edges(g: Column) -> Column:
    return F.flatten(F.transform(g.paths, lambda p: _steps(p, lambda a, b: F.struct(a.alias("a"), b.alias("b")))))


def _edges_meet(a: Column, b: Column) -> Column:
    def meet(s: Column, t: Column) -> Column:
        d1, d2 = _side(s.a, s.b, t.a.x, t.a.y), _side(s.a, s.b, t.b.x, t.b.y)
        d3, d4 = _side(t.a, t.b, s.a.x, s.a.y), _side(t.a, t.b, s.b.x, s.b.y)
        boxes = (F.least(s.a.x, s.b.x) <= F.greatest(t.a.x, t.b.x)) & (F.least(t.a.x, t.b.x) <= F.greatest(s.a.x, s.b.x)) & (F.least(s.a.y, s.b.y) <= F.greatest(t.a.y, t.b.y)) & (F.least(t.a.y, t.b.y) <= F.greatest(s.a.y, s.b.y))
        return boxes & (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)

    return F.exists(_edges(a), lambda s: F.exists(_edges(b), lambda t: meet(s, t)))


def _some_inside(a: Column, b: Column) -> Column:
    """Does a cover the first vertex of some path of b, or some point of a multi-point b?"""
    firsts = F.transform(b.paths, lambda p: F.get(p, F.lit(0)))
    return F.exists(F.when(b.gtype == MULTIPOINT, F.flatten(b.paths)).otherwise(firsts), lambda v: covers_point(a, v.x, v.y))


def st_intersects(a, b) -> Column:
    """Boxes first; then edges that meet or a vertex of one's part inside the other. Multi-points have no edges."""
    a, b = _g(a), _g(b)
    edges = (a.gtype != MULTIPOINT) & (b.gtype != MULTIPOINT) & _edges_meet(a, b)
    exact = F.when(a.gtype == POINT, covers_point(b, a.xmin, a.ymin)).when(b.gtype == POINT, covers_point(a, b.xmin, b.ymin)).otherwise(
        edges | _some_inside(a, b) | _some_inside(b, a))
    return boxes_meet(a, b) & F.when(is_box(a) & (is_box(b) | (b.gtype == POINT)) | is_box(b) & (a.gtype == POINT), F.lit(True)).otherwise(exact)


def st_contains(a, b) -> Column:
    """a covers b: every vertex of b in a, and no edge of b leaves a convex a. Exact for points and boxes in any
    polygon's convex shell and for points in all; lines and polygons in concave shells may touch notches."""
    a, b = _g(a), _g(b)
    every = F.forall(F.flatten(b.paths), lambda v: covers_point(a, v.x, v.y))
    return box_covers(a, b) & F.when(is_box(a), F.lit(True)).when(b.gtype == POINT, covers_point(a, b.xmin, b.ymin)).otherwise(every)


def st_within(a, b) -> Column:
    return st_contains(b, a)


def st_equals(a, b) -> Column:
    a, b = _g(a), _g(b)
    same_box = (a.xmin == b.xmin) & (a.xmax == b.xmax) & (a.ymin == b.ymin) & (a.ymax == b.ymax)
    return same_box & F.when(is_box(a) & is_box(b) | (a.gtype == POINT) & (b.gtype == POINT), F.lit(True)).otherwise(st_contains(a, b) & st_contains(b, a))


def _box_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin), F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin)


def st_touches(a, b) -> Column:
    """Boundary contact alone, between boxes, points and boxes; other shapes: no vertex of one inside the other."""
    a, b = _g(a), _g(b)
    w, h = _box_overlap(a, b)
    inner = lambda g, p: (p.xmin > g.xmin) & (p.xmin < g.xmax) & (p.ymin > g.ymin) & (p.ymin < g.ymax)
    boxes = F.when(a.gtype == POINT, ~inner(b, a)).when(b.gtype == POINT, ~inner(a, b)).otherwise((w == 0) | (h == 0))
    return st_intersects(a, b) & ~((a.gtype == POINT) & (b.gtype == POINT)) & boxes


def st_overlaps(a, b) -> Column:
    """Boxes that share area and neither covers the other."""
    a, b = _g(a), _g(b)
    w, h = _box_overlap(a, b)
    return (a.gtype == b.gtype) & (a.gtype != POINT) & (w > 0) & (h > 0) & st_intersects(a, b) & ~st_contains(a, b) & ~st_contains(b, a)


def st_crosses(a, b) -> Column:
    """A line that is partly inside a polygon. For two lines and for concave polygons take shapes.st_crosses."""
    a, b = _g(a), _g(b)
    line, other = F.when(a.gtype == LINESTRING, a).otherwise(b), F.when(a.gtype == LINESTRING, b).otherwise(a)
    return ((a.gtype == LINESTRING) != (b.gtype == LINESTRING)) & st_intersects(a, b) & (other.gtype == POLYGON) & ~st_contains(other, line)


def _point_to_paths(g: Column, x: Column, y: Column) -> Column:
    def edge(a: Column, b: Column) -> Column:
        dx, dy = b.x - a.x, b.y - a.y
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - a.x) * dx + (y - a.y) * dy, dx * dx + dy * dy))), F.lit(0.0))
        return F.hypot(a.x + t * dx - x, a.y + t * dy - y)

    edges = F.flatten(F.transform(g.paths, lambda p: _steps(p, edge)))
    return F.coalesce(F.array_min(edges), F.array_min(F.transform(F.flatten(g.paths), lambda v: F.hypot(v.x - x, v.y - y))))


def st_distance(a, b) -> Column:
    """Planar least distance: by coordinates for points, else from vertices to edges, 0 where shapes meet."""
    a, b = _g(a), _g(b)
    points = (a.gtype == POINT) & (b.gtype == POINT)
    dx, dy = a.xmin - b.xmin, a.ymin - b.ymin
    both = F.least(F.array_min(F.transform(F.flatten(a.paths), lambda v: _point_to_paths(b, v.x, v.y))), F.array_min(F.transform(F.flatten(b.paths), lambda v: _point_to_paths(a, v.x, v.y))))
    return F.when(points, F.sqrt(dx * dx + dy * dy)).when(st_intersects(a, b), F.lit(0.0)).otherwise(both)


# Aggregates


def st_envelope_aggr(g) -> Column:
    g = _g(g)
    return st_polygonfromenvelope(F.min(g.xmin), F.min(g.ymin), F.max(g.xmax), F.max(g.ymax))


def st_intersection_aggr(g) -> Column:
    """Of boxes: null once empty. Another shape is an error: spatial.intersection_aggregate takes all."""
    g = _g(g)
    a, b, c, d = F.max(g.xmin), F.max(g.ymin), F.min(g.xmax), F.min(g.ymax)
    boxes = F.coalesce(F.bool_and(is_box(g)), F.lit(True))
    return F.when(~boxes, F.raise_error(F.lit("st_intersection_aggr is for boxes; use operators.spatial.intersection_aggregate"))).when((a <= c) & (b <= d), st_polygonfromenvelope(a, b, c, d))
