"""Spatial queries over the test tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.functions import raster as R
from terravane.functions import shapes as E
from terravane.functions import viz as V
from terravane.operators import spatial as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file, which Spark reads in one task, over all cores, as shapes are made of them."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _points(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return df.withColumn("pt", G.st_point("l_quantity", "l_extendedprice"))


def _boxes(spark, sf_dir, dealt=False):
    df = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    df = _dealt(df) if dealt else df
    s, p = F.col("p_size"), F.col("p_retailprice")
    return df.withColumn("box", G.st_polygonfromenvelope(s - 1, p - 50, s + 1, p + 50))


_BOX = "SELECT p_partkey, p_size - 1.0 AS x0, p_retailprice - 50.0 AS y0, p_size + 1.0 AS x1, p_retailprice + 50.0 AS y1 FROM part"
_IN = "l_quantity BETWEEN x0 AND x1 AND l_extendedprice BETWEEN y0 AND y1"


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 20 AND l_extendedprice BETWEEN 5000 AND 20000")
def range_query(spark, sf_dir):
    window = G.st_polygonfromenvelope(5, 5000, 20, 20000)
    return S.range_query(_points(spark, sf_dir), "pt", window).select("l_orderkey", "l_linenumber")


@query(f"SELECT p_partkey, l_orderkey, l_linenumber FROM ({_BOX}), lineitem WHERE {_IN}")
def spatial_join_contains(spark, sf_dir):
    out = S.spatial_join(_boxes(spark, sf_dir), _points(spark, sf_dir), G.st_contains, "box", "pt")
    return out.select("p_partkey", "l_orderkey", "l_linenumber")


@query(f"SELECT p_partkey, count(*) AS n FROM ({_BOX}), lineitem WHERE {_IN} GROUP BY p_partkey")
def join_count_by_key(spark, sf_dir):
    return S.spatial_join_count(_boxes(spark, sf_dir), _points(spark, sf_dir), G.st_intersects, "p_partkey", "box", "pt")


@query(SQL["join_count_by_key"])
def covers_join_count(spark, sf_dir):
    return S.spatial_join_count(_boxes(spark, sf_dir), _points(spark, sf_dir), G.st_contains, "p_partkey", "box", "pt")


def _sides(spark, sf_dir):
    a = _boxes(spark, sf_dir, True).select("p_partkey", "box")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("x"), (F.col("s_suppkey") * 7 % 1000 + 900).alias("y"))
    b = s.select("s_suppkey", G.st_polygonfromenvelope(F.col("x") - 1, F.col("y") - 40, F.col("x") + 1, F.col("y") + 40).alias("sbox"))
    return a, b


_TWO = f"({_BOX}) a, (SELECT s_suppkey, s_suppkey % 50 - 1.0 AS u0, s_suppkey * 7 % 1000 + 860.0 AS v0, s_suppkey % 50 + 1.0 AS u1, s_suppkey * 7 % 1000 + 940.0 AS v1 FROM supplier) b"
_MEET = "x0 <= u1 AND u0 <= x1 AND y0 <= v1 AND v0 <= y1"
for _name, _predicate, _where in (
    ("spatial_join_intersects", G.st_intersects, _MEET),
    ("spatial_join_touches", G.st_touches, f"{_MEET} AND (least(x1, u1) = greatest(x0, u0) OR least(y1, v1) = greatest(y0, v0))"),
    ("spatial_join_overlaps", G.st_overlaps, f"{_MEET} AND least(x1, u1) > greatest(x0, u0) AND least(y1, v1) > greatest(y0, v0) AND NOT (x0 <= u0 AND u1 <= x1 AND y0 <= v0 AND v1 <= y1) AND NOT (u0 <= x0 AND x1 <= u1 AND v0 <= y0 AND y1 <= v1)"),
    ("spatial_join_covers", G.st_contains, "x0 <= u0 AND u1 <= x1 AND y0 <= v0 AND v1 <= y1"),
):
    QUERIES[_name] = lambda spark, sf_dir, p=_predicate: S.spatial_join(*_sides(spark, sf_dir), p, "box", "sbox").select("p_partkey", "s_suppkey")
    SQL[_name] = f"SELECT p_partkey, s_suppkey FROM {_TWO} WHERE {_where}"


@query(f"SELECT p_partkey, s_suppkey FROM {_TWO} WHERE x0 <= u0 AND u1 <= x1 AND y0 <= v0 AND v1 <= y1")
def spatial_join_within(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return S.spatial_join(b, a, "within", "sbox", "box").select("p_partkey", "s_suppkey")


def _whole_boxes(spark, sf_dir, key, name):
    """Boxes on whole numbers, of which some are equal."""
    k = _dealt(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias(key)))
    x, y = F.col(key) * 7 % 40, F.col(key) * 13 % 50
    return k.withColumn(name, G.st_polygonfromenvelope(x, y, x + 2, y + 3))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a, part b WHERE a.p_partkey * 7 % 40 = b.p_partkey * 7 % 40 AND a.p_partkey * 13 % 50 = b.p_partkey * 13 % 50")
def spatial_join_equals(spark, sf_dir):
    return S.spatial_join(_whole_boxes(spark, sf_dir, "a", "g"), _whole_boxes(spark, sf_dir, "b", "h"), "equals", "g", "h").select("a", "b")


# Other shapes than boxes, on whole numbers: triangles, lines, a concave polygon, holes


def _polygon(*points):
    return G.st_geomfromwkt(F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *(F.concat_ws(" ", x, y) for x, y in points)), F.lit("))")))


def _triangles(spark, sf_dir, table, key, name, upper):
    """A half of the unit square at a place of a 12 x 12 lattice: the lower left or the upper right one."""
    k = _dealt(_t(spark, sf_dir, table).select(F.col(key)))
    x, y = F.col(key) % 12, F.col(key) * 5 % 13
    points = [(x, y + 1), (x + 1, y), (x + 1, y + 1), (x, y + 1)] if upper else [(x, y), (x + 1, y), (x, y + 1), (x, y)]
    return k.withColumn(name, _polygon(*points))


_HALVES = "(SELECT p_partkey, p_partkey % 12 AS i, p_partkey * 5 % 13 AS j FROM part) a, (SELECT s_suppkey, s_suppkey % 12 AS k, s_suppkey * 5 % 13 AS l FROM supplier) b"


@query(f"SELECT p_partkey, s_suppkey FROM {_HALVES} WHERE i <= k + 1 AND j <= l + 1 AND k + l <= i + j AND i + j <= k + l + 2")
def triangles_touch(spark, sf_dir):
    a, b = _triangles(spark, sf_dir, "part", "p_partkey", "g", False), _triangles(spark, sf_dir, "supplier", "s_suppkey", "h", True)
    return S.spatial_join(a, b, "touches", "g", "h").select("p_partkey", "s_suppkey")


@query(f"SELECT p_partkey, s_suppkey FROM {_HALVES} WHERE i = k AND j = l")
def triangles_equal(spark, sf_dir):
    a, b = _triangles(spark, sf_dir, "part", "p_partkey", "g", False), _triangles(spark, sf_dir, "supplier", "s_suppkey", "h", False)
    return S.spatial_join(a, b, "equals", "g", "h").select("p_partkey", "s_suppkey")


@query("SELECT p_partkey, c_custkey FROM (SELECT p_partkey, p_partkey % 30 AS x, p_partkey * 7 % 40 AS y FROM part), (SELECT c_custkey, c_custkey % 35 AS u, c_custkey * 3 % 41 AS v FROM customer) WHERE u >= x AND v >= y AND 2 * (u - x) + (v - y) <= 6")
def triangle_join_points(spark, sf_dir):
    x, y = F.col("p_partkey") % 30, F.col("p_partkey") * 7 % 40
    a = _dealt(_t(spark, sf_dir, "part").select("p_partkey")).withColumn("g", _polygon((x, y), (x + 3, y), (x, y + 6), (x, y)))
    b = _t(spark, sf_dir, "customer").select("c_custkey", G.st_point(F.col("c_custkey") % 35, F.col("c_custkey") * 3 % 41).alias("h"))
    return S.spatial_join(a, b, "contains", "g", "h").select("p_partkey", "c_custkey")


@query("SELECT s_suppkey, s_suppkey % 17 - 1 < 10 AND s_suppkey % 17 + 2 > 10 AND s_suppkey * 3 % 9 > 0 OR s_suppkey % 17 = 0 AND s_suppkey * 3 % 9 > 0 AS crosses, s_suppkey % 17 BETWEEN 1 AND 8 AS covered FROM supplier")
def line_against_box(spark, sf_dir):
    """Lines of length 3 at whole heights 0 to 8 against a box from 0 to 10."""
    x, y = F.col("s_suppkey") % 17, F.col("s_suppkey") * 3 % 9
    line = G.st_geomfromwkt(F.concat(F.lit("LINESTRING ("), F.concat_ws(" ", x - 1, y), F.lit(", "), F.concat_ws(" ", x + 2, y), F.lit(")")))
    df = _t(spark, sf_dir, "supplier").select("s_suppkey", line.alias("g"), G.st_polygonfromenvelope(0, 0, 10, 10).alias("h"))
    return df.select("s_suppkey", E.st_crosses("g", "h").alias("crosses"), E.st_contains("h", "g").alias("covered"))


@query("SELECT s_suppkey, (s_suppkey % 9 + 1) * 100.0 - 4.0 AS area, round(((s_suppkey % 9 + 1) * 100 * ((s_suppkey % 9 + 1) * 5.0) - 4 * 3.0) / ((s_suppkey % 9 + 1) * 100 - 4), 6) AS cx FROM supplier")
def holed_centroid(spark, sf_dir):
    """A box of width 10 n and height 10 with a square hole of side 2 around (3, 5)."""
    w = (F.col("s_suppkey") % 9 + 1) * 10
    text = F.concat(F.lit("POLYGON ((0 0, "), w, F.lit(" 0, "), w, F.lit(" 10, 0 10, 0 0), (2 4, 4 4, 4 6, 2 6, 2 4))"))
    df = _t(spark, sf_dir, "supplier").select("s_suppkey", G.st_geomfromwkt(text).alias("g"))
    return df.select("s_suppkey", F.round(G.st_area("g"), 6).alias("area"), F.round(G.st_centroid("g").xmin, 6).alias("cx"))


def _near(spark, sf_dir, inclusive):
    a = _t(spark, sf_dir, "supplier").select("s_suppkey", G.st_point(F.col("s_suppkey") % 40 * 100, F.col("s_nationkey") * 100).alias("a"))
    b = _t(spark, sf_dir, "customer").select("c_custkey", G.st_point(F.col("c_custkey") % 43 * 100, F.col("c_nationkey") * 100).alias("b"))
    return S.distance_join(a, b, 100.0, inclusive, "a", "b").select("s_suppkey", "c_custkey")


_DISTANCE = "SELECT s_suppkey, c_custkey FROM supplier, customer WHERE 100.0 * sqrt((s_suppkey % 40 - c_custkey % 43) * (s_suppkey % 40 - c_custkey % 43) + (s_nationkey - c_nationkey) * (s_nationkey - c_nationkey))"


@query(f"{_DISTANCE} <= 100")
def distance_join_le(spark, sf_dir):
    return _near(spark, sf_dir, True)


@query(f"{_DISTANCE} < 100")
def distance_join_lt(spark, sf_dir):
    return _near(spark, sf_dir, False)


@query(f"{_DISTANCE} <= 100 * (s_suppkey % 3)")
def distance_join_by_row(spark, sf_dir):
    """A radius of each left row's own."""
    a = _t(spark, sf_dir, "supplier").select("s_suppkey", G.st_point(F.col("s_suppkey") % 40 * 100, F.col("s_nationkey") * 100).alias("a"), (F.col("s_suppkey") % 3 * 100.0).alias("r"))
    b = _t(spark, sf_dir, "customer").select("c_custkey", G.st_point(F.col("c_custkey") % 43 * 100, F.col("c_nationkey") * 100).alias("b"))
    return S.distance_join(a, b, F.col("r"), True, "a", "b").select("s_suppkey", "c_custkey")


@query("SELECT l_orderkey, l_linenumber, sqrt((l_quantity - 25) * (l_quantity - 25) + (l_extendedprice - 30000) * (l_extendedprice - 30000)) AS distance FROM lineitem ORDER BY distance, l_orderkey * 10 + l_linenumber LIMIT 20")
def knn(spark, sf_dir):
    df = _points(spark, sf_dir).withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return S.knn(df, "pt", 25.0, 30000.0, 20, "tie").select("l_orderkey", "l_linenumber", "distance")


for _method in ("filter_refine", "decomposition", "optimized"):
    QUERIES[f"layer_count_{_method}"] = lambda spark, sf_dir, m=_method: S.layer_count(_boxes(spark, sf_dir), _points(spark, sf_dir), "p_partkey", "box", "pt", m)
    SQL[f"layer_count_{_method}"] = SQL["join_count_by_key"]


@query("SELECT p_size % 5 AS k, min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM part JOIN (" + _BOX + ") USING (p_partkey) GROUP BY k")
def envelope_aggregate(spark, sf_dir):
    out = _boxes(spark, sf_dir).groupBy((F.col("p_size") % 5).alias("k")).agg(G.st_envelope_aggr("box").alias("e"))
    return out.select("k", "e.xmin", "e.ymin", "e.xmax", "e.ymax")


@query("SELECT p_size AS k, max(y0) AS low, min(y1) AS high FROM part JOIN (" + _BOX + ") USING (p_partkey) GROUP BY k HAVING max(y0) <= min(y1)")
def intersection_aggregate(spark, sf_dir):
    out = _boxes(spark, sf_dir).groupBy(F.col("p_size").alias("k")).agg(G.st_intersection_aggr("box").alias("e"))
    return out.where("e IS NOT NULL").select("k", F.col("e.ymin").alias("low"), F.col("e.ymax").alias("high"))


@query("SELECT k, round(2.0 * sum(run), 6) AS area FROM (SELECT p_size AS k, least(100, coalesce(lead(p_retailprice) OVER (PARTITION BY p_size ORDER BY p_retailprice) - p_retailprice, 100)) AS run FROM part) GROUP BY k")
def union_aggregate(spark, sf_dir):
    out = S.union_aggregate(_boxes(spark, sf_dir).select(F.col("p_size").alias("k"), "box"), "k", "box", (1.0, 400.0))
    return out.select("k", F.round(G.st_area("box"), 6).alias("area"))


@query("SELECT p_partkey, p_size + 0.0 AS ax, 100.0 AS half, true AS valid, 9 AS n FROM part")
def shape_functions(spark, sf_dir):
    s, p = F.col("p_size"), F.col("p_retailprice")
    line = G.st_setsrid(G.st_linestringfromtext(F.concat_ws(",", s, F.lit(0), s, F.lit(1), s + 1, F.lit(1))), 0)
    df = _boxes(spark, sf_dir).select("p_partkey", "box", G.st_polygonfromenvelope(s, p - 90, s + 3, p).alias("other"), line.alias("line"))
    half = E.st_intersection("box", "other")
    return df.select(
        "p_partkey", G.st_lineinterpolatepoint("line", 0.5).xmin.alias("ax"), F.round(2 * G.st_area(half), 6).alias("half"),
        E.st_isvalid("box").alias("valid"), (G.st_npoints(E.st_convexhull("box")) + G.st_npoints(E.st_convexhull("line"))).alias("n"),
    )


@query("SELECT p_partkey, 'POLYGON ((' || p_size || ' 0, ' || p_size || ' 1, ' || (p_size + 1) || ' 1, ' || (p_size + 1) || ' 0, ' || p_size || ' 0))' AS wkt FROM part")
def wkb_round_trip(spark, sf_dir):
    s = F.col("p_size")
    df = _boxes(spark, sf_dir).select("p_partkey", G.st_polygonfromenvelope(s, F.lit(0), s + 1, F.lit(1)).alias("g"))
    df = df.select("p_partkey", F.hex(E.st_asewkb("g")).alias("h"))
    return df.select("p_partkey", E.st_geomfromwkb("h").alias("g")).select("p_partkey", G.st_astext("g").alias("wkt"))


@query("SELECT p_partkey, 4 * 50.0 AS area, 204.0 AS length, p_size * 1.0 AS cx, round(p_retailprice, 6) AS cy, 5 AS n, 'ST_Polygon' AS kind, CAST(p_size AS DOUBLE) AS px FROM part")
def scalar_functions(spark, sf_dir):
    df = _boxes(spark, sf_dir)
    c = G.st_centroid("box")
    return df.select(
        "p_partkey", F.round(G.st_area("box"), 6).alias("area"), F.round(G.st_length("box"), 6).alias("length"), F.round(c.xmin, 6).alias("cx"), F.round(c.ymin, 6).alias("cy"),
        G.st_npoints("box").alias("n"), G.st_geometrytype("box").alias("kind"), G.st_x(G.st_point("p_size", "p_retailprice")).alias("px"),
    )


@query("SELECT p_partkey, 'POLYGON ((' || p_size || ' 0, ' || p_size || ' 1, ' || (p_size + 1) || ' 1, ' || (p_size + 1) || ' 0, ' || p_size || ' 0))' AS wkt FROM part")
def wkt_round_trip(spark, sf_dir):
    s = F.col("p_size")
    text = G.st_astext(G.st_polygonfromenvelope(s, F.lit(0), s + 1, F.lit(1)))
    return _boxes(spark, sf_dir).select("p_partkey", text.alias("t")).select("p_partkey", G.st_astext(G.st_geomfromwkt("t")).alias("wkt"))


_PIXEL = "CASE WHEN l_quantity = 50 THEN 63 ELSE CAST(floor((l_quantity - 1) / 49.0 * 64) AS INT) END AS px, CASE WHEN l_extendedprice = 110000 THEN 63 ELSE CAST(floor(l_extendedprice / 110000.0 * 64) AS INT) END AS py FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 0 AND 110000"


@query(f"SELECT px, py, count(*) AS weight FROM (SELECT {_PIXEL}) GROUP BY px, py")
def heat_map(spark, sf_dir):
    return V.heat_map(_points(spark, sf_dir), "l_quantity", "l_extendedprice", 64, 64, (1.0, 0.0, 50.0, 110000.0))


@query(f"SELECT '3-' || CAST(px * 8 // 64 AS INT) || '-' || CAST(7 - py * 8 // 64 AS INT) AS tile, count(*) AS n FROM (SELECT {_PIXEL}) GROUP BY tile")
def tile_counts(spark, sf_dir):
    pixel = V.st_pixelize(F.col("l_quantity"), F.col("l_extendedprice"), 64, 64, (1.0, 0.0, 50.0, 110000.0))
    return _points(spark, sf_dir).select(pixel.alias("p")).where("p IS NOT NULL").groupBy(V.st_tilename(F.col("p"), 64, 64, 3).alias("tile")).agg(F.count("*").alias("n"))


_BANDS = "(SELECT vec_id AS id, list_transform(embedding, lambda x: round(x::DOUBLE * 100) + 0.0::DOUBLE) AS a, list_transform(embedding, lambda x: round(x::DOUBLE * 50) + 1) AS b FROM embeddings)"


def _bands(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    whole = lambda k, d: F.transform("embedding", lambda x: F.round(x.cast("double") * k) + d)
    return df.select(F.col("vec_id").alias("id"), whole(100, 0.0).alias("a"), whole(50, 1.0).alias("b"))


def _band(name, column, sql):
    QUERIES[f"raster_{name}"] = lambda spark, sf_dir: _bands(spark, sf_dir).select("id", column().alias("v"))
    SQL[f"raster_{name}"] = f"SELECT id, {sql} AS v FROM {_BANDS}"


def _zip(e: str) -> str:
    return f"list_transform(list_zip(a, b), lambda z: {e.replace('a', 'z[1]').replace('b', 'z[2]')})"


_band("add", lambda: R.rs_addbands("a", "b"), _zip("a + b"))
_band("subtract", lambda: R.rs_subtractbands("a", "b"), _zip("b - a"))
_band("multiply", lambda: R.rs_multiplybands("a", "b"), _zip("a * b"))
_band("greater", lambda: R.rs_greaterthan("a", 3.0), "list_transform(a, lambda x: CASE WHEN x > 3 THEN 1.0::DOUBLE ELSE 0.0 END)")
_band("greater_equal", lambda: R.rs_greaterthanequal("a", 3.0), "list_transform(a, lambda x: CASE WHEN x >= 3 THEN 1.0::DOUBLE ELSE 0.0 END)")
_band("less", lambda: R.rs_lessthan("a", 3.0), "list_transform(a, lambda x: CASE WHEN x < 3 THEN 1.0::DOUBLE ELSE 0.0 END)")
_band("less_equal", lambda: R.rs_lessthanequal("a", 3.0), "list_transform(a, lambda x: CASE WHEN x <= 3 THEN 1.0::DOUBLE ELSE 0.0 END)")
_band("count", lambda: R.rs_count("a", 3.0), "len(list_filter(a, lambda x: x = 3))::INT")
_band("factor", lambda: R.rs_multiplyfactor("a", 3), "list_transform(a, lambda x: x * 3)")
_band("mean", lambda: R.rs_mean("a"), "floor(list_sum(a) / len(a) * 100 + 0.5) / 100")
_band("square_root", lambda: R.rs_squareroot("a"), "list_transform(a, lambda x: CASE WHEN x < 0 THEN 0.0 ELSE floor(sqrt(abs(x)) * 100 + 0.5) / 100 END)")
_band("modulo", lambda: R.rs_modulo("a", 7.0), "list_transform(a, lambda x: x % 7.0::DOUBLE)")
_band("logical_over", lambda: R.rs_logicalover("a", "b"), "list_transform(list_zip(a, b), lambda z: CASE WHEN z[1] <> 0 THEN z[1] ELSE z[2] END)")
_band("logical_difference", lambda: R.rs_logicaldifference("a", "b"), "list_transform(list_zip(a, b), lambda z: CASE WHEN z[1] <> z[2] THEN z[1] ELSE 0 END)")
_band("bitwise_and", lambda: R.rs_bitwiseand("a", "b"), "list_transform(list_zip(a, b), lambda z: (z[1]::INT & z[2]::INT)::DOUBLE)")
_band("bitwise_or", lambda: R.rs_bitwiseor("a", "b"), "list_transform(list_zip(a, b), lambda z: (z[1]::INT | z[2]::INT)::DOUBLE)")
_band("divide", lambda: R.rs_dividebands("a", "b"), "list_transform(list_zip(a, b), lambda z: CASE WHEN z[2] = 0 THEN CASE WHEN z[1] > 0 THEN 92233720368547758.07::DOUBLE WHEN z[1] < 0 THEN -92233720368547758.08::DOUBLE ELSE 0.0 END ELSE floor(z[1] / z[2] * 100 + 0.5) / 100 END)")
_band("mode", lambda: R.rs_mode("a"), "list_sort(list_filter(list_distinct(a), lambda v: len(list_filter(a, lambda x: x = v)) = list_max(list_transform(list_distinct(a), lambda u: len(list_filter(a, lambda x: x = u))))))")
_band("fetch_region", lambda: R.rs_fetchregion("a", [1, 2, 2, 3], [4, 4]), "list_concat(a[7:8], a[11:12])")
_band("normalize", lambda: R.rs_normalize("a"), "list_transform(a, lambda x: CASE WHEN list_max(a) = 0 THEN CASE WHEN x < 0 THEN -2147483648.0 ELSE 0.0 END ELSE trunc(x / (list_max(a) / 255)) + 0.0::DOUBLE END)")
_band("array", lambda: R.rs_array(3, 2.5), "[2.5::DOUBLE, 2.5, 2.5]")
_band("html", lambda: R.rs_html(F.concat(F.lit("x"), F.col("id").cast("string"))), "'<img src=\"data:image/png;base64,x' || id || '\" width=\"200\" />'")
_band("get_band", lambda: R.rs_getband("a", 2, 4), "a[len(a) // 4 + 1 : 2 * (len(a) // 4)]")
