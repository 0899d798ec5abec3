import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.functions import viz as V
from terravane.operators import spatial as S
from terravane.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def wkt(text):
    return G.st_geomfromwkt(F.lit(text))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "customer", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    spark_rows, sql_rows = [tuple(r) for r in got.collect()], [tuple(r[k] for k in at) for r in want.fetchall()]
    assert spark_rows, "a query without rows proves nothing"
    # repr: 0.0 and -0.0 are equal but not the same
    number = lambda v: float(v) if isinstance(v, (int, Decimal)) and not isinstance(v, bool) else [number(x) for x in v] if isinstance(v, (list, tuple)) else v
    plain = lambda rows: sorted(repr([number(v) for v in r]) for r in rows)
    assert plain(spark_rows) == plain(sql_rows)


def test_measures(spark):
    holed = wkt("POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))")
    line = wkt("LINESTRING (0 0, 3 4, 3 10)")
    r = one(spark, G.st_area(holed), G.st_length(line), G.st_npoints(holed), G.st_numinteriorrings(holed), G.st_astext(G.st_endpoint(line)), G.st_astext(G.st_interiorringn(holed, 0)), G.st_isclosed(line), G.st_distance(line, wkt("POINT (6 4)")))
    assert tuple(r) == (96.0, 11.0, 10, 1, "POINT (3 10)", "LINESTRING (2 2, 2 4, 4 4, 4 2, 2 2)", False, 3.0)


def test_predicates(spark):
    notch = wkt("POLYGON ((0 0, 0 10, 5 5, 10 10, 10 0, 0 0))")
    r = one(spark, G.st_contains(notch, wkt("POINT (5 5)")), G.st_contains(notch, wkt("POINT (5 6)")), G.st_intersects(notch, wkt("LINESTRING (4 9, 6 9)")), G.st_intersects(notch, wkt("LINESTRING (-1 1, 11 1)")), G.st_touches(wkt("POINT (0 0)"), G.st_polygonfromenvelope(0, 0, 1, 1)))
    assert tuple(r) == (True, False, False, True, True)


def test_bad_and_null(spark):
    r = one(spark, wkt("POLYGON ((1 2"), wkt("hello"), G.st_x(wkt("LINESTRING (0 0, 1 1)")), G.st_area(F.lit(None).cast(G.GEOM)), G.st_point(F.lit(None), F.lit(1.0)))
    assert tuple(r) == (None,) * 5


def test_text_formats(spark):
    p = G.st_point(F.lit(1.5), F.lit(2.0))
    geo = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1],[0,0]]]},"properties":{}}'
    r = one(spark, G.st_astext(p), G.st_asgeojson(p), G.st_astext(G.st_geomfromgeojson(F.lit(geo))), G.st_geohash(G.st_point(F.lit(21.427834), F.lit(52.042576573)), 5), G.st_astext(wkt("MULTIPOINT ((1 2), (3 4))")), G.st_astext(G.st_pointfromtext(F.lit("1.1,101.1"))))
    assert tuple(r) == ("POINT (1.5 2)", '{"type":"Point","coordinates":[1.5,2.0]}', "POLYGON ((0 0, 0 1, 1 1, 0 0))", "u3r0p", "MULTIPOINT (1 2, 3 4)", "POINT (1.1 101.1)")


def test_transform_round_trip(spark):
    p = G.st_transform(G.st_transform(G.st_point(F.lit(52.0), F.lit(21.0)), "epsg:4326", "epsg:3857"), "epsg:3857", "epsg:4326")
    r = one(spark, F.round(p.xmin, 9), F.round(p.ymin, 9))
    assert tuple(r) == (52.0, 21.0)


def test_join_of_duplicates(spark):
    rng = random.Random(5)
    boxes = [(k, rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(0, 12)) for k in range(60)]
    a = spark.createDataFrame(boxes + boxes[:5], "i long, x double, y double, w double")
    make = lambda df, name: df.select(F.col("i").alias(name), G.st_polygonfromenvelope(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias(f"{name}_g"))
    got = sorted(map(tuple, S.spatial_join(make(a, "l"), make(a, "r"), G.st_intersects, "l_g", "r_g").select("l", "r").collect()))
    rows = boxes + boxes[:5]
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3] and p[2] <= q[2] + q[3] and q[2] <= p[2] + p[3])
    assert got == want


def test_join_plan_has_no_nested_loop(spark):
    plan = QUERIES["spatial_join_contains"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_colorize(spark):
    got = spark.createDataFrame([(w,) for w in (0, 4, 5, 79, 80, 255)], "w int").select(V.st_colorize(F.col("w"), F.lit(255))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 6, 7, 7]


def test_streaming(spark, tmp_path):
    """The functions are plain columns, so they run on streams."""
    source = spark.readStream.schema(spark.read.parquet(f"{SF}/part.parquet").schema).option("pathGlobFilter", "part.parquet").parquet(SF)
    out = S.range_query(source.withColumn("pt", G.st_point("p_size", "p_retailprice")), "pt", G.st_polygonfromenvelope(0, 0, 10, 5000)).select("p_partkey")
    q = out.writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("near").count() == spark.read.parquet(f"{SF}/part.parquet").where("p_size <= 10 AND p_retailprice <= 5000").count()


def test_centroids(spark):
    shapes = ["POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (6 4, 8 4, 8 6, 6 6, 6 4))", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))", "MULTILINESTRING ((0 0, 2 0), (0 4, 6 4))", "MULTIPOINT ((0 0), (4 2))", "POINT (3 4)", "LINESTRING (1 1, 1 1)"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(shapes)], "k int, t string").select("k", G.st_geomfromwkt("t").alias("g"))
    got = [(r.x, r.y) for r in df.select("k", G.st_centroid("g").xmin.alias("x"), G.st_centroid("g").ymin.alias("y")).orderBy("k").collect()]
    assert got == [(pytest.approx((100 * 5 - 4 * 7) / 96), pytest.approx(5.0)), (6.0, 1.0), (2.5, 3.0), (2.0, 1.0), (3.0, 4.0), (None, None)]


def test_disjoint_shapes_do_not_cross(spark):
    line, other, far = wkt("LINESTRING (0 0, 5 5)"), wkt("LINESTRING (20 20, 30 30)"), G.st_polygonfromenvelope(10, 10, 12, 12)
    assert tuple(one(spark, G.st_crosses(line, far), G.st_crosses(line, other), G.st_crosses(line, G.st_polygonfromenvelope(1, 1, 2, 2)))) == (False, False, True)


def test_a_world_beside_points(spark):
    """A box of any size costs a bounded number of cells, and every pair is found once."""
    rng = random.Random(8)
    sizes = [0.0, 0.5, 3.0, 40.0, 1e4, 1e9]
    rows = [(k, rng.uniform(0, 100), rng.uniform(0, 100), rng.choice(sizes)) for k in range(150)]
    make = lambda name: spark.createDataFrame(rows, "i long, x double, y double, w double").select(F.col("i").alias(name), F.lit(7).alias(f"_x{name}"), G.st_polygonfromenvelope(F.col("x") - F.col("w"), F.col("y") - F.col("w"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias(f"{name}_g"))
    got = sorted(map(tuple, S.spatial_join(make("l"), make("r"), "intersects", "l_g", "r_g", cell=(1.0, 1.0)).select("l", "r").collect()))
    want = sorted((p[0], q[0]) for p in rows for q in rows if abs(p[1] - q[1]) <= p[3] + q[3] and abs(p[2] - q[2]) <= p[3] + q[3])
    assert got == want
    one_box = spark.range(1).select(G.st_polygonfromenvelope(0.0, 0.0, 1e9, 1e9).alias("g"))
    names = ["_x", "_y", "_level", "_join"]
    level = S._levelled(one_box, "g", 1.0, 1.0, F.lit(0.0), names)
    assert S._cells_at(level, "g", 1.0, 1.0, F.lit(0.0), names, F.array("_level")).count() <= 4 * S.MAX_CELLS


def test_joins_lose_no_column(spark):
    a = spark.createDataFrame([(1, 2, 3)], "_x int, _y int, _level int").withColumn("g", G.st_point(F.lit(1.0), F.lit(1.0)))
    b = spark.createDataFrame([(4,)], "_join int").withColumn("h", G.st_polygonfromenvelope(0, 0, 2, 2))
    assert S.spatial_join(a, b, "within", "g", "h").drop("g", "h").collect() == [(1, 2, 3, 4)]


def test_range_queries_of_concave_shapes(spark):
    notch = wkt("POLYGON ((0 0, 0 10, 5 5, 10 10, 10 0, 0 0))")
    df = spark.createDataFrame([(1, "LINESTRING (1 9, 9 9)"), (2, "LINESTRING (1 1, 9 1)"), (3, "POLYGON ((-1 -1, -1 11, 11 11, 11 -1, -1 -1))")], "i int, t string").select("i", G.st_geomfromwkt("t").alias("g"))
    df = spark.createDataFrame(df.collect(), df.schema)  # geometries as stored columns
    assert [r.i for r in S.range_query(df, "g", notch, boundary=False).collect()] == [2]
    assert [r.i for r in S.range_query(df, "g", notch, covering=True).collect()] == [3]
    grouped = S.join_grouped(S.spatial_join(df, df.select(F.col("i").alias("j"), F.col("g").alias("h")), "intersects", "g", "h"), "i", "j").orderBy("i").collect()
    assert [(r.i, [m.j for m in r.matches]) for r in grouped] == [(1, [1, 3]), (2, [2, 3]), (3, [1, 2, 3])]


def test_division_by_zero_and_uneven_bands(spark):
    from terravane.functions import raster as R

    df = spark.createDataFrame([([1.0, -1.0, 0.0, 6.0], [0.0, 0.0, 0.0, 4.0], [0.0, -2.0], [])], "a array<double>, b array<double>, z array<double>, e array<double>")
    r = df.select(R.rs_dividebands("a", "b"), R.rs_normalize("z"), R.rs_mean("e"), R.rs_modulo("a", 4.0), R.rs_normalizeddifference("a", F.array(F.lit(-1.0), F.lit(1.0), F.lit(0.0), F.lit(2.0)))).first()
    assert r[0] == [R.HIGH, R.LOW, 0.0, 1.5] and r[1] == [0.0, -2147483648.0] and r[2] == 0.0 and r[3] == [1.0, -1.0, 0.0, 2.0] and r[4] == [R.LOW, R.HIGH, 0.0, -0.5]
    with pytest.raises(Exception, match="unequal length"):
        df.select(R.rs_addbands("a", "z")).collect()


def test_base64_picture(spark):
    import base64
    import zlib

    from terravane.functions import raster as R

    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "b array<double>")
    data = base64.b64decode(df.select(R.rs_base64(2, 3, "b", "b", "b")).first()[0])
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[16:24] == (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert raw == bytes([0, 1, 1, 1, 255, 2, 2, 2, 255, 3, 3, 3, 255, 0, 4, 4, 4, 255, 5, 5, 5, 255, 6, 6, 6, 255])


@pytest.mark.parametrize("small", [True, False])
def test_repeated_geometries(spark, monkeypatch, small):
    """Rows of equal geometries are joined and counted by the distinct ones; by broadcast or in chunks."""
    if not small:
        monkeypatch.setattr(S, "SMALL_ROWS", 0)
        monkeypatch.setattr(S, "CHUNK", 3)
    boxes = [(k, float(k % 3), float(k % 2)) for k in range(40)] + [(0, 0.0, 0.0), (99, None, 1.0)]
    a = spark.createDataFrame(boxes, "i int, x double, y double").withColumn("g", G.st_polygonfromenvelope(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)).drop("x", "y")
    b = a.select(F.col("i").alias("j"), F.col("g").alias("h"))
    place = lambda k: (k % 3, k % 2) if k != 99 else None
    near = {"touches": lambda p, q: p != q and abs(p[0] - q[0]) <= 1}
    ids = [r[0] for r in boxes if r[1] is not None]
    for name, test in near.items():
        want = sorted((p, q) for p in ids for q in ids if test(place(p), place(q)))
        assert sorted(map(tuple, S.spatial_join(a, b, name, "g", "h").select("i", "j").collect())) == want
        count = {k: sum(p == k for p, _ in want) for k in ids}
        assert dict(map(tuple, S.spatial_join_count(a, b, name, "i", "g", "h").collect())) == {k: n for k, n in count.items() if n}
    points = spark.createDataFrame([(k, float(k % 4), 0.5) for k in range(20)], "j int, x double, y double").select("j", G.st_point("x", "y").alias("h"))
    want = {k: sum(place(k)[0] <= j % 4 <= place(k)[0] + 1 for j in range(20)) * ids.count(k) for k in ids if place(k)[1] == 0}
    for method in ("decomposition",):
        assert dict(map(tuple, S.layer_count(a, points, "i", "g", "h", method).collect())) == want
    lines = spark.createDataFrame([(k, f"LINESTRING ({k % 2} 0, {k % 2 + 2} 0)") for k in range(10)], "i int, t string").select("i", G.st_geomfromwkt("t").alias("g"))
    other = lines.select(F.col("i").alias("j"), F.col("g").alias("h"))
    assert sorted(map(tuple, S.spatial_join(lines, other, "equals", "g", "h").select("i", "j").collect())) == [(p, q) for p in range(10) for q in range(10) if p % 2 == q % 2]


def test_shapes_are_made_once(spark):
    """A text is parsed once for its row, and joins read the shapes that were made of it."""
    a = spark.createDataFrame([(k, f"POLYGON (({k % 3} 0, {k % 3 + 1} 0, {k % 3} 1, {k % 3} 0))") for k in range(12)], "i int, t string")
    left, right = a.select("i", G.st_geomfromwkt("t").alias("g")), a.select(F.col("i").alias("j"), G.st_geomfromwkt("t").alias("h"))
    assert left._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 2
    out = S.spatial_join(left, right, "equals", "g", "h")
    assert "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.select("i", "j").collect())) == [(p, q) for p in range(12) for q in range(12) if p % 3 == q % 3]


def test_kinds_of_shapes(spark):
    texts = ["POINT (1 2)", "POLYGON ((0 0, 0 2, 3 2, 3 0, 0 0))", "POLYGON ((3 2, 0 2, 0 0, 3 0, 3 2))", "POLYGON ((0 0, 3 2, 0 2, 3 0, 0 0))", "POLYGON ((0 0, 3 0, 3 0, 0 2, 0 0))", "POLYGON ((0 0, 3 0, 0 0, 3 2, 0 0))"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", G.st_geomfromwkt("t").alias("g"))
    assert [r.k for r in df.select("i", S._kind(F.col("g")).alias("k")).orderBy("i").collect()] == [1, 2, 2, 3, 3, 3]


def test_small_sides_are_profiled_side_by_side(spark, monkeypatch):
    import threading

    profile, threads = S._profile, []
    monkeypatch.setattr(S, "_profile", lambda *a: threads.append(threading.current_thread()) or profile(*a))
    a = spark.range(9).withColumnRenamed("id", "i").withColumn("g", G.st_polygonfromenvelope(F.col("i"), F.lit(0), F.col("i") + 1, F.lit(1)))
    b = spark.range(-9, 30).withColumnRenamed("id", "j").withColumn("h", G.st_point(F.col("j") + 0.5, F.lit(0.5)))
    assert sorted(map(tuple, S.spatial_join(a, b, "contains", "g", "h").select("i", "j").collect())) == [(k, k) for k in range(9)]
    assert len(threads) == 2 and threading.main_thread() not in threads


def _repeated_boxes(spark, n, times, key, name, hot=0):
    """n boxes on a lattice, each so many times; the first one hot times more."""
    k = spark.range(n * times).select(F.col("id").alias(key), (F.col("id") % n).alias("place"))
    if hot:
        k = k.union(spark.range(n * times, n * times + hot).select(F.col("id"), F.lit(0)))
    x, y = F.col("place") % 100, F.floor(F.col("place") / 100)
    return k.withColumn(name, G.st_polygonfromenvelope(x - 0.0, y, x + 1, y + 1)).withColumn("note_" + key, F.when(F.col(key) % 3 > 0, F.col(key).cast("string"))).drop("place")


@pytest.mark.parametrize("hot", [0, 5000])
@pytest.mark.parametrize("limit", [S.SMALL_ROWS, 10])
def test_repeated_boxes_meet_as_arrays(spark, monkeypatch, hot, limit):
    monkeypatch.setattr(S, "SMALL_ROWS", limit)  # whether the right side is broadcast
    monkeypatch.setattr(S, "CHUNK", 3)
    a, b = _repeated_boxes(spark, 1000, 3, "a", "g", hot), _repeated_boxes(spark, 400, 7, "b", "h")
    monkeypatch.setattr(S, "EVEN", 1)
    out = S.spatial_join(a, b, "equals", "g", "h")
    rows = out.select("a", "b", "note_a", "note_b", F.col("g").xmin == F.col("h").xmin).collect()
    assert len(rows) == len(set(rows)) == 400 * 3 * 7 + 7 * hot
    assert all((r[0] % 1000 if r[0] < 3000 else 0) == r[1] % 400 and r[4] for r in rows)
    assert all(r.note_a == (str(r.a) if r.a % 3 else None) and r.note_b == (str(r.b) if r.b % 3 else None) for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "_level" not in plan
    out = S.spatial_join(a, b, "overlaps", "g", "h")
    assert out.count() == 0
    out = S.spatial_join(a, b, "intersects", "g", "h").select("a", "b")
    near = [[c for c in range(400) if abs(c % 100 - k % 100) <= 1 and abs(c // 100 - k // 100) <= 1] for k in range(1000)]
    assert out.count() == out.distinct().count() == sum(21 * len(c) for c in near) + 7 * hot * len(near[0])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert limit == 10 or ("RoundRobin" in plan) == bool(hot)  # evenly dealt rows aren't dealt again
