"""Kernels against the JTS library that Spark carries, as an oracle on the driver."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.functions import kernels as K
from terravane.functions import shapes as S
from terravane.functions.sql import register_all
from terravane.operators.spatial import intersection_aggregate, spatial_join


def ring(rng, n, cx, cy, r):
    """A star-shaped ring on a grid of quarters, so that shapes share vertices and edges now and then."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(round((cx + rng.uniform(r / 3, r) * math.cos(a)) * 4) / 4, round((cy + rng.uniform(r / 3, r) * math.sin(a)) * 4) / 4) for a in angles]
    return [*pts, pts[0]]


def text(shape):
    path = lambda p: "(" + ", ".join(f"{x!r} {y!r}" for x, y in p) + ")"
    return f"POLYGON ({', '.join(map(path, shape[1]))})" if shape[0] == K.POLYGON else f"LINESTRING {path(shape[1][0])}"


@pytest.fixture(scope="module")
def jts(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    return lambda shape: reader.read(text(shape))


def cases(jts, n=150):
    rng = random.Random(11)
    made = []
    while len(made) < n:
        pair = []
        for _ in range(2):
            kind = rng.choice([K.POLYGON, K.POLYGON, K.LINESTRING])
            r = ring(rng, rng.randint(3, 9), rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(1, 5))
            pair.append((kind, [r] if kind == K.POLYGON else [r[:-1]]))
        if all(jts(s).isValid() and jts(s).isSimple() for s in pair):
            made.append(pair)
    return made


def test_predicates_and_overlay(jts):
    for a, b in cases(jts):
        p, q = jts(a), jts(b)
        want = [p.intersects(q), p.covers(q), p.touches(q), p.crosses(q), p.overlaps(q), p.equalsTopo(q)]
        assert [K.intersects(a, b), K.covers(a, b), K.touches(a, b), K.crosses(a, b), K.overlaps(a, b), K.equals(a, b)] == want, (text(a), text(b))
        if a[0] == b[0] == K.POLYGON:
            area = lambda polygons: sum(K.signed_area(r) for x in polygons for r in x)
            assert area(K.overlay(a[1], b[1], lambda x, y: x and y)) == pytest.approx(p.intersection(q).getArea(), abs=1e-6)
            assert area(K.union_all([a[1], b[1]])) == pytest.approx(p.union(q).getArea(), abs=1e-6)


def test_validity_and_measures(jts):
    rng = random.Random(3)
    seen = set()
    for _ in range(150):
        s = (rng.choice([K.POLYGON, K.LINESTRING]), [ring(rng, rng.randint(3, 7), 3, 3, 3)])
        if rng.random() < 0.5:
            rng.shuffle(mid := s[1][0][1:-1])
            s = (s[0], [[s[1][0][0], *mid, s[1][0][-1]]])
        if any(a == b for a, b in zip(s[1][0], s[1][0][1:])):
            continue  # vertices repeated in a row don't make a line crooked here, but may in the oracle
        g = jts(s)
        if s[0] == K.POLYGON:
            assert K.is_valid(s) == g.isValid(), text(s)
            seen.add(g.isValid())
        else:
            assert K.is_simple(s) == g.isSimple(), text(s)
        hull = K.convex_hull(s)
        assert abs(K.signed_area(hull[1][0])) == pytest.approx(g.convexHull().getArea())
        if g.isValid() and s[0] == K.POLYGON:
            for r in (0.5, -0.5):
                got = sum(K.signed_area(x) for x in K.buffer(s, r)[1])
                assert got == pytest.approx(g.buffer(r).getArea(), rel=0.02, abs=0.02)
            parts = K.subdivide(s, 5)
            assert sum(abs(K.signed_area(r)) for p in parts for r in p[1][:1]) == pytest.approx(g.getArea(), abs=1e-6)
    assert seen == {True, False}


def test_columns(spark):
    rows = [("MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5), (6 6, 7 6, 7 7, 6 6)))",), ("MULTILINESTRING ((0 0, 1 1), (1 1, 2 0))",), ("POINT (1 2)",), ("LINESTRING (0 0, 3 4, 3 10)",), ("nonsense",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", G.st_geomfromwkt("t").alias("g"))
    out = df.select(
        G.st_numgeometries("g").alias("n"), F.round(G.st_area("g"), 6).alias("area"), G.st_astext(S.st_linemerge("g")).alias("merged"), S.st_minimumboundingradius("g").radius.alias("r"),
        S.st_isring("g").alias("ring"), F.size(S.st_makevalid("g")).alias("made"), S.st_isvalid("g").alias("valid"),
    ).collect()
    assert [r.n for r in out] == [2, 2, 1, 1, None, None]
    assert [r.area for r in out] == [16.0, 0.0, 0.0, 0.0, None, None]
    assert [r.merged for r in out] == [None, "LINESTRING (0 0, 1 1, 2 0)", None, "LINESTRING (0 0, 3 4, 3 10)", None, None]
    assert out[2].r == 0 and out[3].r == pytest.approx(math.hypot(3, 10) / 2) and out[4].r is None
    assert [r.ring for r in out] == [None, None, None, False, None, None]
    assert out[0].made == 2 and out[0].valid and out[5].valid is None
    wkb = df.select("t", F.hex(S.st_asewkb(G.st_setsrid("g", 4326))).alias("h")).select("t", S.st_geomfromwkb("h").alias("g"))
    back = wkb.select("t", G.st_astext("g").alias("w"), G.st_srid("g").alias("s")).collect()
    assert [r.s for r in back] == [4326] * 4 + [None] * 2 and back[2].w == "POINT (1 2)" and back[0].w.startswith("MULTIPOLYGON (((0 0, 1 1, 0 1, 0 0)), ((5 5")


def test_lines_and_hashes(spark):
    line = G.st_geomfromwkt(F.lit("LINESTRING (0 0, 3 4, 3 10)"))
    r = spark.range(1).select(
        G.st_astext(G.st_lineinterpolatepoint(line, 0.75)), G.st_astext(G.st_linesubstring(line, 0.0, 1.0)), G.st_lineinterpolatepoint(line, 1.5), G.st_astext(G.st_boundary(line)),
        G.st_geohash(G.st_geomfromgeohash(F.lit("U3R0p")), 5), G.st_geomfromgeohash(F.lit("a!")), G.st_astext(G.st_addpoint(line, G.st_point(9, 9), 1)),
    ).first()
    assert tuple(r) == ("POINT (3 7.25)", "LINESTRING (0 0, 3 4, 3 10)", None, "MULTIPOINT (0 0, 3 10)", "u3r0p", None, "LINESTRING (0 0, 9 9, 3 4, 3 10)")


def test_sql_names(spark):
    names = register_all(spark)
    assert len(names) > 80
    spark.createDataFrame([("POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))",)], "t string").selectExpr("ST_GeomFromWKT(t) AS g").createOrReplaceTempView("shapes")
    r = spark.sql("SELECT ST_Area(g), ST_Touches(g, ST_Point(0D, 5D)), ST_SRID(ST_SetSRID(g, 7)), ST_AsText(ST_GeomFromWKB(hex(ST_AsBinary(g)))), round(ST_Area(ST_Buffer(g, -1)), 6), RS_Mean(array(1D, 2D)) FROM shapes").first()
    assert tuple(r) == (100.0, True, 7, "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))", 64.0, 1.5)


def test_intersection_aggregate_of_all_shapes(spark):
    groups = {
        "some": ["POLYGON ((13.274347 52.461841, 13.202927 52.590509, 13.429549 52.572151, 13.385598 52.430871, 13.274347 52.461841))", "POLYGON ((13.525691 52.484427, 13.345767 52.495297, 13.352635 52.54961, 13.539426 52.537082, 13.525691 52.484427))"],
        "none": ["POLYGON ((13.212541 52.465188, 13.113652 52.55462, 13.238637 52.57382, 13.252372 52.470207, 13.212541 52.465188))", "POLYGON ((13.561402 52.493625, 13.561402 52.566308, 13.727591 52.55128, 13.669905 52.47188, 13.561402 52.493625))"],
        "boxes": ["POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))", "POLYGON ((1 1, 1 9, 9 9, 9 1, 1 1))", "POLYGON ((2 0, 2 9, 3 9, 3 0, 2 0))", None], "one": ["POLYGON ((0 0, 2 0, 0 2, 0 0))"],
    }
    df = spark.createDataFrame([(k, t) for k, ts in groups.items() for t in ts], "k string, t string").select("k", G.st_geomfromwkt("t").alias("g"))
    got = {r.k: r.area for r in intersection_aggregate(df, "k", "g").select("k", G.st_area("g").alias("area")).collect()}
    assert got == {"some": pytest.approx(0.0034700160226227607, abs=1e-12), "none": 0.0, "boxes": pytest.approx(3.0), "one": pytest.approx(2.0)}
    with pytest.raises(Exception, match="is for boxes"):
        df.groupBy("k").agg(G.st_intersection_aggr("g")).collect()


def test_native_intersects_of_many_parts(spark):
    box, slanted = "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))", "POLYGON ((0 0, 1 10, 10 10, 10 0, 0 0))"
    ring = "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0), (1 1, 1 9, 9 9, 9 1, 1 1))"
    pairs = [
        (slanted, "MULTIPOLYGON (((20 20, 20 21, 21 21, 20 20)), ((5 5, 5 6, 6 6, 5 5)))", True), (box, "MULTILINESTRING ((-9 -9, -8 -8), (4 4, 5 6))", True),
        (box, "MULTIPOINT ((-5 5), (15 5))", False), (box, "MULTIPOINT ((-5 5), (5 5))", True), ("LINESTRING (0 -5, 0 5)", "MULTIPOINT ((-1 0), (1 0))", False), ("LINESTRING (0 -5, 0 5)", "MULTIPOINT ((-1 0), (0 1))", True),
        ("MULTIPOINT ((0 0), (2 2))", "MULTIPOINT ((1 1), (3 3))", False), ("MULTIPOINT ((0 0), (2 2))", "MULTIPOINT ((1 1), (2 2))", True), (ring, "MULTIPOLYGON (((4 4, 4 5, 5 5, 4 4)), ((6 6, 6 7, 7 7, 6 6)))", False),
        (ring, "MULTIPOLYGON (((4 4, 4 5, 5 5, 4 4)), ((0.2 2, 0.2 3, 0.8 3, 0.2 2)))", True),
    ]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, s string, t string, want boolean").select("k", "want", G.st_geomfromwkt("s").alias("a"), G.st_geomfromwkt("t").alias("b"))
    got = df.select("k", "want", G.st_intersects("a", "b").alias("ab"), G.st_intersects("b", "a").alias("ba")).collect()
    assert [r for r in got if not r.ab == r.ba == r.want] == []
    joined = spatial_join(df.select("k", "a"), df.select(F.col("k").alias("l"), "b"), left_geom="a", right_geom="b", cell=(4.0, 4.0)).where("k = l")
    assert sorted(r.k for r in joined.collect()) == [k for k, p in enumerate(pairs) if p[2]]
