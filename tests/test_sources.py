import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.functions import viz as V
from terravane.sources import geotiff as T
from terravane.sources import shapefile as H
from terravane.sources import text as X


def shp(records: list[bytes]) -> bytes:
    body = b"".join(struct.pack(">ii", k + 1, len(r) // 2) + r for k, r in enumerate(records))
    return struct.pack(">i20xi", 9994, 50 + len(body) // 2) + struct.pack("<ii8d", 1000, 5, 0, 0, 9, 9, 0, 0, 0, 0) + body


def paths(kind: int, *rings) -> bytes:
    starts = np.cumsum([0, *map(len, rings)])
    flat = [v for r in rings for p in r for v in p]
    return struct.pack(f"<i4dii{len(rings)}i{len(flat)}d", kind, 0, 0, 9, 9, len(rings), starts[-1], *starts[:-1], *flat)


def dbf(names: list[str], rows: list[list[str]]) -> bytes:
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"C", 8, 0) for n in names)
    body = b"".join(b" " + b"".join(v.encode().ljust(8) for v in r) for r in rows)
    return struct.pack("<B3xIHH20x", 3, len(rows), 33 + len(fields), 1 + 8 * len(names)) + fields + b"\r" + body


SHELL = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
FAR = [(20, 0), (20, 1), (21, 1), (20, 0)]


def test_shapefile(spark, tmp_path):
    records = [
        struct.pack("<idd", 1, 3, 4), struct.pack("<i", 0), paths(3, [(0, 0), (1, 1)]), paths(3, [(0, 0), (1, 1)], [(2, 2), (3, 3)]),
        paths(5, SHELL, HOLE), paths(5, FAR, SHELL, HOLE), struct.pack("<i4di4d", 8, 0, 0, 9, 9, 2, 1, 2, 3, 4), struct.pack("<i4d", 11, 5, 6, 7, 8),
    ]
    (tmp_path / "a.shp").write_bytes(shp(records))
    (tmp_path / "a.dbf").write_bytes(dbf(["name", "Record"], [[f"é{k}", str(k)] for k in range(len(records))]))
    (tmp_path / "b.SHP").write_bytes(shp([struct.pack("<idd", 1, 7, 8)]))
    got = H.read_shapefile(spark, str(tmp_path))
    assert got.columns == ["geometry", "record", "name", "Record_"]
    rows = got.select(G.st_astext("geometry").alias("t"), G.st_area("geometry").alias("a"), G.st_geometrytype("geometry").alias("k"), "record", "name", "Record_").orderBy(F.isnull("name"), "record").collect()
    assert [r.record for r in rows] == [*range(8), 0]
    assert [r.name for r in rows] == [*(f"é{k}" for k in range(8)), None]
    assert [r.Record_ for r in rows][:2] == ["0", "1"]
    assert rows[1].t is None
    kinds = ["Point", None, "LineString", "MultiLineString", "Polygon", "MultiPolygon", "MultiPoint", "Point", "Point"]
    assert [r.k and r.k.removeprefix("ST_") for r in rows] == kinds
    assert (rows[4].a, rows[5].a) == (80, 80.5)
    box = H.read_bounds(spark, str(tmp_path)).select("geometry.xmin", "geometry.ymax").first()
    assert tuple(box) == (0, 9)


@pytest.mark.parametrize("damage", [lambda b: b[:-8], lambda b: b"\0" * 8 + b[8:]])
def test_damaged_shapefile(damage):
    with pytest.raises(ValueError):
        list(H.shapes(memoryview(damage(shp([struct.pack("<idd", 1, 3, 4)])))))


def test_holes_go_to_the_shell_around_them():
    turn = [(0.5, 0.5), (8, 0.5), (8, 8), (0.5, 8), (0.5, 0.5)]
    inner = [(1.2, 1.2), (1.2, 1.8), (1.8, 1.8), (1.2, 1.2)]
    got = H.polygons([np.array(r, float) for r in (SHELL, inner, turn, HOLE, FAR)])
    assert sorted(len(p) for p in got) == [1, 1, 3]
    back = H.polygons([np.array(r[::-1], float) for r in (SHELL, HOLE)])
    assert [len(p) for p in back] == [2]


def lzw(data: bytes) -> bytes:
    """A plain packer, to hold the reader against."""
    table, bits, n, width = {bytes([k]): k for k in range(256)}, 0, 0, 9
    size, word = 258, b""

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    put(256)
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        else:
            width = max(9, size.bit_length())
        word = c
    if word:
        put(table[word])
        width = max(9, (size + 1).bit_length())
    put(257)
    bits, n = bits << -n % 8, n + -n % 8
    return bits.to_bytes(n // 8, "big")


def test_lzw():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (1000, 2), (30000, 5), (30000, 256)):
        data = rng.integers(0, k, n).astype(np.uint8).tobytes()
        assert T.unpack_lzw(lzw(data)) == data


def test_pack_bits():
    assert T.unpack_bits(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\x80\xf7\xaa").hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10


def tiff(a: np.ndarray, order="<", packing=1, tile=None, planar=1, predictor=1, places=True) -> bytes:
    """(bands, rows, columns) in strips of 3 rows, or tiles."""
    bands, height, width = a.shape
    high, wide = tile or (3, width)
    parts = []
    for plane in ([a[k : k + 1] for k in range(bands)] if planar == 2 else [a]):
        for y in range(0, height, high):
            for x in range(0, width, wide):
                p = plane[:, y : y + high, x : x + wide].transpose(1, 2, 0)
                if tile:
                    p = np.pad(p, ((0, high - p.shape[0]), (0, wide - p.shape[1]), (0, 0)))
                if predictor == 2:
                    p = np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1]))
                raw = p.astype(a.dtype.newbyteorder(order)).tobytes()
                parts.append({1: lambda b: b, 8: zlib.compress, 5: lzw}[packing](raw))
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    where = [(324, "I", offsets), (325, "I", [len(p) for p in parts]), (322, "H", [wide]), (323, "H", [high])] if tile else [(273, "I", offsets), (278, "H", [high]), (279, "I", [len(p) for p in parts])]
    tags = [(256, "H", [width]), (257, "H", [height]), (258, "H", [a.dtype.itemsize * 8] * bands), (259, "H", [packing]), (277, "H", [bands]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [kind] * bands), *where]
    tags += [(33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [0.0, 0, 0, 100, 50, 0])] if places else []
    tags.sort()
    extra_at, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, form, values in tags:
        raw = struct.pack(f"{order}{len(values)}{form}", *values)
        if len(raw) > 4:
            place = struct.pack(order + "I", extra_at + len(extra))
            extra += raw
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[form], len(values)) + place
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + b"".join(parts) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize("options", [
    {}, {"order": ">"}, {"packing": 8}, {"packing": 5}, {"tile": (16, 16)}, {"planar": 2}, {"predictor": 2, "packing": 5}, {"planar": 2, "tile": (16, 16), "order": ">", "predictor": 2},
])
@pytest.mark.parametrize("dtype", ["u1", "i2", "u4"])
def test_tiff(options, dtype):
    a = np.random.default_rng(3).integers(0, 100, (2, 20, 35)).astype(dtype)
    got, corners = T.decode(tiff(a, **options))
    assert (got == a).all()
    assert corners == [(101, 48.5), (101, -8.5), (169, -8.5), (169, 48.5)]


def test_geotiff(spark, tmp_path):
    a = np.random.default_rng(4).random((3, 4, 5))
    (tmp_path / "a.tif").write_bytes(tiff(a))
    (tmp_path / "b.tif").write_bytes(tiff(a.astype("f4"), places=False))
    (tmp_path / "c.tif").write_bytes(b"no picture")
    rows = T.read_geotiff(spark, str(tmp_path)).select("image.*").orderBy("origin").collect()
    assert [(r.height, r.width, r.nBands) for r in rows] == [(4, 5, 3), (4, 5, 3), (-1, -1, -1)]
    assert rows[0].data == a.reshape(-1).tolist()
    assert rows[1].wkt is None and rows[2].data == []
    box = T.read_geotiff(spark, str(tmp_path), drop_invalid=True).select(G.st_geomfromwkt("image.wkt").alias("g"))
    assert sorted(r.x is None for r in box.select("g.xmin").toDF("x").collect()) == [False, True]


def test_text(spark, tmp_path):
    (tmp_path / "lines").write_text("a,0,0,1,1,2,0\nb,0,x,1,1\nc\n")
    got = X.read_lines(spark, str(tmp_path / "lines"), start=1).select(G.st_astext("geometry").alias("t"), "value").collect()
    assert [r.value[0] for r in got] == ["a"] and "2" in got[0].t
    assert X.read_lines(spark, str(tmp_path / "lines"), start=1, end=4).select(G.st_npoints("geometry")).first()[0] == 2
    (tmp_path / "poly").write_text("0,0,4,0,4,4,0,0\n")
    assert X.read_polygons(spark, str(tmp_path / "poly")).select(G.st_area("geometry")).first()[0] == 8
    (tmp_path / "wkt").write_text("MULTIPOINT((0 0),(1 2))\tred\tbig\nPOINT(3 4)\tblue\nnothing\n")
    df = X.with_fields(X.read_wkt(spark, str(tmp_path / "wkt")), ["colour", "size"])
    assert sorted((r["colour"], r["size"]) for r in df.fillna("").collect()) == [("blue", ""), ("red", "big")]
    assert X.parts(df).count() == 3
    stored = spark.createDataFrame(df.collect(), df.schema)
    X.write_wkb(stored, "geometry", str(tmp_path / "wkb"), ["colour", "size"])
    back = X.with_fields(X.read_wkb(spark, str(tmp_path / "wkb")), ["colour", "size"])
    assert sorted((r.t, r.colour) for r in back.select(G.st_astext("geometry").alias("t"), "colour").collect()) == sorted((r.t, r.colour) for r in df.select(G.st_astext("geometry").alias("t"), "colour").collect())
    X.write_geojson(df, "geometry", str(tmp_path / "json"), ["colour", "size"])
    again = X.with_properties(X.read_geojson(spark, str(tmp_path / "json")), ["colour", "none"])
    assert sorted((r.colour, r["none"]) for r in again.collect()) == [("blue", None), ("red", None)]


def test_render(spark):
    assert V.argb(0, 255, 0, 150) == -1778319616
    colours = spark.createDataFrame([(0,), (4,), (255,)], "w int").select(V.st_colorize_argb(F.col("w"), F.lit(255))).collect()
    assert [r[0] for r in colours] == [V.argb(255, 255, 255, 0), V.argb(0, 255, 0, 150), V.argb(255, 0, 0, 150)]
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 7), (3, 3, V.argb(1, 2, 3)), (9, 0, 5), (1, 1, None)], "x int, y int, c int")
    rows = {r.tile: bytes(r.image) for r in V.st_render(df, "x", "y", "c", 4, 4, 1).collect()}
    assert sorted(rows) == ["1-0-1", "1-1-0"]

    def samples(image):
        at = image.index(b"IDAT")
        raw = zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")])
        return np.frombuffer(raw, np.uint8).reshape(2, 9)[:, 1:].reshape(2, 2, 4)

    low, high = samples(rows["1-0-1"]), samples(rows["1-1-0"])
    assert low[1, 0].tolist() == [0, 0, 7, 0] and low[0].sum() == 0
    assert high[0, 1].tolist() == [1, 2, 3, 255]
    assert V.st_render(df.where("false"), "x", "y", "c", 4, 4).select(V.st_encodeimage("image")).collect() == []
    with pytest.raises(ValueError):
        V.st_render(df, "x", "y", "c", 5, 4, 1)
