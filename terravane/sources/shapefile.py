"""Shapefiles: `.shp` geometries with the columns of the `.dbf` beside them.

Files come through Spark's binary reader, so any file system it knows will do; a file is one task's work, since the format
ends at 2 GB. Records leave in Arrow batches of BATCH.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G

BATCH = 10_000
#: Shape codes of points, lines, polygons and multi-points; 10 or 20 more for those with z or m.
POINT, LINE, POLYGON, POINTS = 1, 3, 5, 8
_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SCHEMA = pa.schema([("gtype", pa.int8()), ("paths", pa.list_(pa.list_(_VERTEX))), ("record", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])
_COLUMNS = "gtype tinyint, paths array<array<struct<x:double,y:double>>>, record long, fields map<string,string>"


def _turn(ring: np.ndarray) -> float:
    """Twice the signed area; positive when the ring turns left."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1])


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    across = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[across], b[across]
    return bool(np.count_nonzero(p[0] < a[:, 0] + (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])) % 2)


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Shells, each with its holes, turned as the engine's geometries are: shells left and holes right.

    The first ring is a shell, as are those that turn as it does. A hole goes to the smallest shell around its first
    vertex; one that no shell holds is a shell itself. Rings of three vertices or fewer are left out.
    """
    rings = [r for r in rings if len(r) > 3]
    turns = [_turn(r) for r in rings]
    left = [r if t > 0 else r[::-1] for r, t in zip(rings, turns, strict=True)]
    shell = [(t > 0) == (turns[0] > 0) for t in turns]
    out = [[r] for r, s in zip(left, shell, strict=True) if s]
    by_size = sorted(out, key=lambda p: _turn(p[0]))
    for r, s in zip(left, shell, strict=True):
        if not s:
            home = next((p for p in by_size if _holds(p[0], r[0])), None)
            if home is None:
                out.append([r])
            else:
                home.append(r[::-1])
    return out


def _shape(body: memoryview) -> tuple[int | None, list[np.ndarray]]:
    kind = struct.unpack_from("<i", body)[0]
    kind = kind % 10 if kind in (POINT, LINE, POLYGON, POINTS) or kind // 10 in (1, 2) else kind
    if kind == 0:
        return None, []
    if kind == POINT:
        return G.POINT, [np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)]
    if kind == POINTS:
        n = struct.unpack_from("<i", body, 36)[0]
        return (G.MULTIPOINT, [np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2)]) if n else (None, [])
    if kind not in (LINE, POLYGON):
        raise ValueError(f"shape type {kind} is not supported")
    parts, n = struct.unpack_from("<ii", body, 36)
    starts = np.frombuffer(body, "<i4", parts, 44)
    xy = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    paths = [p for p in np.split(xy, starts[1:]) if len(p)] if parts else []
    if kind == POLYGON:
        found = polygons(paths)
        paths = [r for p in found for r in p]
        return (G.POLYGON if len(found) == 1 else G.MULTIPOLYGON, paths) if found else (None, [])
    return (G.LINESTRING if len(paths) == 1 else G.MULTILINESTRING, paths) if paths else (None, [])


def shapes(data: memoryview) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Type and paths of each record; null shapes have neither."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("not a shapefile")
    at, end = 100, struct.unpack_from(">i", data, 24)[0] * 2
    if end > len(data):
        raise ValueError("shapefile is cut short")
    while at < end:
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        if at + 8 + size > end:
            raise ValueError("shapefile is cut short")
        yield _shape(data[at + 8 : at + 8 + size])
        at += 8 + size


def field_names(data: bytes | memoryview) -> list[tuple[str, int]]:
    """Names and widths of a `.dbf` file's fields."""
    out, at = [], 32
    while data[at] != 0x0D:
        out.append((_text(bytes(data[at : at + 11]).split(b"\0")[0]), data[at + 16]))
        at += 32
    return out


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _rows(data: memoryview | None) -> Iterator[list[tuple[str, str]]]:
    if data is None:
        return
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields = field_names(data)
    for k in range(n):
        at, row = head + k * width + 1, []
        for name, size in fields:
            row.append((name, _text(bytes(data[at : at + size])).strip(" \0")))
            at += size
        yield row


def _batch(got: list, first: int) -> pa.RecordBatch:
    paths = [p for _, ps, _ in got for p in ps]
    xy = np.concatenate([*paths, np.zeros((0, 2))])
    inner = np.cumsum([0, *map(len, paths)]).astype(np.int32)
    outer = np.cumsum([0, *(len(ps) for _, ps, _ in got)]).astype(np.int32)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], fields=list(_VERTEX))
    nested = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, points))
    kinds, fields = pa.array([k for k, _, _ in got], pa.int8()), pa.array([f for _, _, f in got], _SCHEMA.field("fields").type)
    return pa.RecordBatch.from_arrays([kinds, nested.cast(_SCHEMA.field("paths").type), pa.array(np.arange(first, first + len(got))), fields], schema=_SCHEMA)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shp, dbf in zip(*batch.columns, strict=True):
            rows, got, first = _rows(memoryview(dbf.as_buffer()) if dbf.is_valid else None), [], 0
            for kind, paths in shapes(memoryview(shp.as_buffer())):
                got.append((kind, paths, next(rows, [])))
                if len(got) == BATCH:
                    yield _batch(got, first)
                    first, got = first + BATCH, []
            if got:
                yield _batch(got, first)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(name, k) for dbf in batch.column(0) for k, (name, _) in enumerate(field_names(memoryview(dbf.as_buffer())))]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())], ["name", "place"])


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    either = "".join(f"[{c}{c.upper()}]" for c in ending)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{either}").load(path)
    return files.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), F.col("content").alias(ending))


def read_field_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the fields of a folder's `.dbf` files, in their order there; names alone reach the driver."""
    found = _files(spark, path, "dbf").select("dbf").mapInArrow(_names, "name string, place int")
    return [r.name for r in found.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()]


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """geometry, record (its place in its file) and a text column for each field, of all shapefiles in a folder.

    Points, lines, polygons and multi-points, of those with z or m the x and y. A null or empty shape is a null
    geometry. Fields that a file lacks are null; a name taken already, in either case, gets an underscore. Other shape
    types and files cut short raise.
    """
    both = _files(spark, path, "shp").join(_files(spark, path, "dbf"), "stem", "left")
    out = both.select("shp", "dbf").mapInArrow(_records, _COLUMNS)
    columns, used = [], {"geometry", "record"}
    for name in read_field_names(spark, path):
        free = name
        while free.lower() in used:
            free += "_"
        used.add(free.lower())
        columns.append(F.try_element_at("fields", F.lit(name)).alias(free))
    return out.select(G.make(F.col("gtype"), F.col("paths")).alias("geometry"), "record", *columns)


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """One geometry: the box of all records, from the files' headers."""
    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [struct.unpack_from("<4d", memoryview(v.as_buffer()), 36) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(4)], ["a", "b", "c", "d"])

    found = _files(spark, path, "shp").select("shp").mapInArrow(boxes, "a double, b double, c double, d double")
    found = found.agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("c").alias("c"), F.max("d").alias("d"))
    return found.select(G.st_polygonfromenvelope(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))
