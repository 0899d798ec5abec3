"""Range, distance and broadcast spatial joins, range and nearest queries, and polygon-layer counts.

Joins are equi-joins on grid cells with the exact predicate after them. A pair is kept only in the cell that holds the
lower corner of its boxes' common part, so none is doubled. Cells that hold many rows are split by Spark's skew join.

Where geometries repeat, each one is tested once: the distinct geometries of both sides are joined on cells, and the pairs
found are joined back to the rows. Counts go by the distinct geometries too and never make the pairs of rows. Sides of
points or of boxes alone are tested by their corners, without paths. Rows outside the other side's extent are left out.
Other shapes are made once and kept in the shared folder, as their making may cost more than the join.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.functions import kernels as K
from terravane.functions import shapes as E
from terravane.session import staged


#: Exact predicates of all shapes, by name; boxes and points are answered without Python.
PREDICATES = {
    "intersects": G.st_intersects, "contains": E.st_contains, "within": E.st_within, "equals": E.st_equals, "touches": E.st_touches,
    "overlaps": E.st_overlaps, "crosses": E.st_crosses,
}
#: Names of the predicates that are given as functions.
NAMED = {f: name for module in (G, E) for name in PREDICATES if (f := getattr(module, f"st_{name}"))}
#: Cells of one level that a row is put into at most; larger rows go to levels of wider cells.
MAX_CELLS, LEVELS, LEVEL_STEP = 64, 12, 8
#: Bytes of a side that is broadcast at most, by Spark's own estimate.
MAX_BROADCAST = 256 << 20
#: Rows and estimated bytes of a side that pairs of geometries are joined back to by broadcast; rows of one geometry that
#: meet in one key of the shuffle otherwise.
SMALL_ROWS, SMALL_BYTES, CHUNK = 200_000, 32 << 20, 2048
#: Distinct geometries for each partition from which rows are dealt by geometry.
EVEN = 16


def _cell(v: Column, size: float | Column) -> Column:
    return F.floor(v / size)


def _with_cells(df: DataFrame, geom: str, cx: float, cy: float, grow: Column | float = 0.0, names: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    g, pad = F.col(geom), grow if isinstance(grow, Column) else F.lit(float(grow))
    df = df.withColumn(names[0], F.explode(F.sequence(_cell(g.xmin - pad, cx), _cell(g.xmax + pad, cx))))
    return df.withColumn(names[1], F.explode(F.sequence(_cell(g.ymin - pad, cy), _cell(g.ymax + pad, cy))))


def _level(geom: str, cx: float, cy: float, grow: Column) -> Column:
    """The finest level, by its number, at which the row lies in at most MAX_CELLS cells; at the last one all do."""
    g = F.col(geom)
    wide, high = (g.xmax - g.xmin + 2 * grow) / cx + 1, (g.ymax - g.ymin + 2 * grow) / cy + 1
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        step = float(LEVEL_STEP**k)
        out = F.when((wide / step + 1) * (high / step + 1) <= MAX_CELLS, F.lit(k)).otherwise(out)
    return out


def _levelled(df: DataFrame, geom: str, cx: float, cy: float, grow: Column, names: list[str]) -> DataFrame:
    """Adds the row's own level."""
    return df.withColumn(names[2], _level(geom, cx, cy, grow).cast("int"))


def _cells_at(df: DataFrame, geom: str, cx: float, cy: float, grow: Column, names: list[str], at: Column) -> DataFrame:
    """Adds a level to join at and the row's cells of it; above the last level there is one cell."""
    g, (x, y, _, join) = F.col(geom), names
    df = df.withColumn(join, F.explode(at))
    step = F.pow(F.lit(float(LEVEL_STEP)), F.col(join).cast("double"))
    edge = lambda v, size: F.when(F.col(join) == LEVELS, F.lit(0).cast("long")).otherwise(_cell(v, size * step))
    df = df.withColumn(x, F.explode(F.sequence(edge(g.xmin - grow, cx), edge(g.xmax + grow, cx))))
    return df.withColumn(y, F.explode(F.sequence(edge(g.ymin - grow, cy), edge(g.ymax + grow, cy))))


def cell_size(df: DataFrame, geom: str) -> tuple[float, float]:
    """Twice the mean box of a side, and at least 1/256 of its extent; one aggregate row comes to the driver."""
    g = F.col(geom)
    r = df.agg(F.avg(g.xmax - g.xmin), F.max(g.xmax) - F.min(g.xmin), F.avg(g.ymax - g.ymin), F.max(g.ymax) - F.min(g.ymin)).first()
    return tuple(max(2 * (r[k] or 0), (r[k + 1] or 0) / 256) or 1.0 for k in (0, 2))


def _free(columns: list[str], *wanted: str) -> list[str]:
    used, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name in used:
            name += "_"
        out.append(name)
    return out


def _estimate(df: DataFrame) -> int:
    """Bytes of a frame as Spark's optimiser estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass
class Profile:
    """A side as one aggregate row tells it. kind: "point" or "box" if all shapes are such, boxes with an area."""

    n: int
    distinct: int
    kind: str | None
    extent: tuple[float, float, float, float] | None
    mean: tuple[float, float]
    most: tuple[float, float]

    @property
    def cell(self) -> tuple[float, float]:
        low_x, low_y, high_x, high_y = self.extent or (0.0,) * 4
        return tuple(max(2 * m, w / 256) or 1.0 for m, w in zip(self.mean, (high_x - low_x, high_y - low_y), strict=True))


def _kind(g: Column) -> Column:
    """1: a point, 2: a polygon that is its own bounding box and has an area, 3: another shape."""
    ring = F.get(g.paths, F.lit(0))
    v = [F.get(ring, F.lit(k)) for k in range(5)]
    box = (F.size(g.paths) == 1) & (F.size(ring) == 5) & (v[0].x == v[4].x) & (v[0].y == v[4].y) & (g.xmin < g.xmax) & (g.ymin < g.ymax)
    for one, other in ((v[0], v[2]), (v[1], v[3])):  # opposite corners
        box = box & (F.least(one.x, other.x) == g.xmin) & (F.greatest(one.x, other.x) == g.xmax) & (F.least(one.y, other.y) == g.ymin) & (F.greatest(one.y, other.y) == g.ymax)
    box = box & ((v[0].x == v[1].x) != (v[0].y == v[1].y))
    return F.when(g.gtype == G.POINT, 1).when((g.gtype == G.POLYGON) & box, 2).otherwise(3)


def _near(g: Column, extent: tuple, grow: Column | float = 0.0) -> Column:
    pad = grow if isinstance(grow, Column) else F.lit(float(grow))
    return (g.xmin - pad <= extent[2]) & (g.xmax + pad >= extent[0]) & (g.ymin - pad <= extent[3]) & (g.ymax + pad >= extent[1])


def _profile(df: DataFrame, geom: str) -> Profile:
    g = F.col(geom)
    code = F.when(g.gtype == G.POINT, F.xxhash64(g.xmin, g.ymin)).otherwise(F.xxhash64(g))
    kind, seen = _kind(g), lambda v: F.when(g.isNotNull(), v)
    corners = (F.min(g.xmin), F.min(g.ymin), F.max(g.xmax), F.max(g.ymax))
    sizes = [f(v) for f in (F.avg, F.max) for v in (g.xmax - g.xmin, g.ymax - g.ymin)]
    n, distinct, low, high, *r = df.agg(F.count(g), F.approx_count_distinct(seen(code)), F.min(seen(kind)), F.max(seen(kind)), *corners, *sizes).first()
    mean, most = (tuple(v or 0.0 for v in r[k : k + 2]) for k in (4, 6))
    return Profile(n, distinct, {1: "point", 2: "box"}.get(low) if low == high else None, None if r[0] is None else tuple(r[:4]), mean, most)


def _corner_test(name: str | None, a: str | None, b: str | None) -> Callable[[Column, Column], Column] | None:
    """The predicate for sides of these kinds by corners alone; None where it needs the shapes."""
    if name is None or a is None or b is None:
        return None
    share = lambda p, q: [v > 0 for v in G._box_overlap(p, q)]
    inner = lambda p, q: (q.xmin > p.xmin) & (q.xmin < p.xmax) & (q.ymin > p.ymin) & (q.ymin < p.ymax)
    if name == "touches":
        if a == b == "point":
            return lambda p, q: F.lit(False)
        if a == b:
            return lambda p, q: G.boxes_meet(p, q) & ~(share(p, q)[0] & share(p, q)[1])
        return lambda p, q: G.boxes_meet(p, q) & ~(inner(q, p) if a == "point" else inner(p, q))
    if name == "overlaps":
        if a == "point" or b == "point":
            return lambda p, q: F.lit(False)
        return lambda p, q: share(p, q)[0] & share(p, q)[1] & ~G.box_covers(p, q) & ~G.box_covers(q, p)
    return {
        "intersects": G.boxes_meet, "contains": G.box_covers, "within": lambda p, q: G.box_covers(q, p),
        "equals": lambda p, q: G.box_covers(p, q) & G.box_covers(q, p),
    }.get(name)


def _keys(geom: str, kind: str | None, names: list[str]) -> dict[str, Column]:
    """Columns that name a geometry: its corners, or 128 bits of its hash."""
    g = F.col(geom)
    corners = [g.xmin, g.ymin] if kind == "point" else [g.xmin, g.ymin, g.xmax, g.ymax] if kind == "box" else [F.xxhash64(g), F.xxhash64(F.lit(1), g)]
    return dict(zip(names, corners))


def _distinct(df: DataFrame, geom: str, kind: str | None, names: list[str], n: str) -> tuple[DataFrame, list[str]]:
    """(keys, geom, n) of each distinct geometry, and the names of the keys. Of points and boxes geom has corners alone."""
    keys = _keys(geom, kind, names)
    if kind is None:
        out = df.select(*(c.alias(k) for k, c in keys.items()), geom).groupBy(*keys, geom).agg(F.count("*").alias(n))
        return out, list(keys)
    k = list(keys)
    corners = F.struct(*(F.col(k[j % len(k)]).alias(name) for j, name in enumerate(("xmin", "ymin", "xmax", "ymax"))))
    return df.select(*(c.alias(name) for name, c in keys.items())).groupBy(*k).agg(F.count("*").alias(n)).withColumn(geom, corners), k


def _slices(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)


def _cell_join(left: DataFrame, right: DataFrame, test: Callable[[str, str], Column], left_geom: str, right_geom: str, cell: tuple[float, float], grow: Column | float = 0.0, broadcast: bool = False, most: list[tuple[float, float]] | None = None) -> DataFrame:
    """The join on cells. most: the largest width and height of each side, if known."""
    cx, cy = cell
    names = x, y, own, join = _free([*left.columns, *right.columns], "_x", "_y", "_level", "_join")
    pad, none = grow if isinstance(grow, Column) else F.lit(float(grow)), F.lit(0.0)
    a, b = _levelled(left, left_geom, cx, cy, pad, names), _levelled(right, right_geom, cx, cy, none, names)
    room = 0.0 if isinstance(grow, Column) else 2 * float(grow)
    if most and not isinstance(grow, Column) and all(((w + room) / cx + 2) * ((h + room) / cy + 2) <= MAX_CELLS for w, h in most):
        used = [[0], [0]]
    else:
        used = [sorted(r[0] for r in df.select(own).where(f"{own} IS NOT NULL").distinct().collect()) for df in (a, b)]  # at most LEVELS + 1 each
    levels = F.array(*(F.lit(k) for k in sorted({*used[0], *used[1]}))) if used[0] or used[1] else F.array().cast("array<int>")
    own_right = f"{own}_right"
    while own_right in left.columns or own_right in right.columns:
        own_right += "_"
    at = F.filter(levels, lambda k: k >= F.col(own))  # a wider level than its own: for the other side's rows of it
    a = _cells_at(a, left_geom, cx, cy, pad, names, at)
    b = _cells_at(b, right_geom, cx, cy, none, names, at).withColumnRenamed(own, own_right)
    joined = a.join(F.broadcast(b) if broadcast and _estimate(right) <= MAX_BROADCAST else b, [join, x, y])
    g, h = F.col(left_geom), F.col(right_geom)
    step = F.pow(F.lit(float(LEVEL_STEP)), F.col(join).cast("double"))
    corner = lambda v, size: F.when(F.col(join) == LEVELS, F.lit(0).cast("long")).otherwise(_cell(v, size * step))
    home = (F.col(x) == corner(F.greatest(g.xmin - pad, h.xmin), cx)) & (F.col(y) == corner(F.greatest(g.ymin - pad, h.ymin), cy))
    once = F.greatest(F.col(own), F.col(own_right)) == F.col(join)
    return joined.where(once & home & test(left_geom, right_geom)).drop(x, y, own, own_right, join)


@dataclass
class Sides:
    """Both sides, without rows that lie outside the other's extent, and their predicate."""

    left: DataFrame
    right: DataFrame
    a: Profile
    b: Profile
    cell: tuple[float, float]
    test: Callable
    corners: Callable | None
    same_corners: bool = False

    def pairs(self, left_geom: str, right_geom: str) -> tuple[DataFrame, list[str], list[str], str, str]:
        """Distinct geometries that the predicate holds for: (keys of the left one, of the right one, rows of each)."""
        names = _free([*self.left.columns, *self.right.columns], *(f"_{side}{k}" for side in "ab" for k in range(4)), "_na", "_nb")
        kinds = (self.a.kind, self.b.kind) if self.corners else (None, None)
        a, left_keys = _distinct(self.left, left_geom, kinds[0], names[:4], names[8])
        b, right_keys = _distinct(self.right, right_geom, kinds[1], names[4:8], names[9])
        test = (lambda p, q: self.corners(F.col(p), F.col(q))) if self.corners else self.test
        joined = _cell_join(a, b, test, left_geom, right_geom, self.cell, most=[self.a.most, self.b.most])
        return joined.select(*left_keys, *right_keys, *names[8:]), left_keys, right_keys, *names[8:]

    def with_keys(self, left: bool, geom: str, keys: list[str]) -> DataFrame:
        df, kind = (self.left, self.a.kind) if left else (self.right, self.b.kind)
        return df.withColumns(_keys(geom, kind if self.corners else None, keys))


def _plain(df: DataFrame, geom: str) -> bool:
    """Whether the first row is a point or a box, which cost little to make; true of no rows."""
    row = df.select(F.col(geom).alias("g")).first()
    if row is None or row.g is None or row.g.paths is None:
        return row is None
    corners = {(x, y) for x in (row.g.xmin, row.g.xmax) for y in (row.g.ymin, row.g.ymax)}
    return row.g.gtype == G.POINT or (len(row.g.paths) == 1 and len(row.g.paths[0]) == 5 and {(v.x, v.y) for v in row.g.paths[0]} == corners)


def _made_once(df: DataFrame, geom: str) -> tuple[DataFrame, bool]:
    """The rows, and whether their first is plain. If not, they come from a table in the shared folder, where there is one
    that can hold them, as making shapes may cost much. The first row decides on cost alone."""
    if plain := _plain(df, geom):
        return df, plain
    with contextlib.suppress(AnalysisException, RuntimeError):
        df = staged(df, "shapes")
    return df, plain


def _both(spark: SparkSession, *calls: Callable[[], object]) -> list:
    """Results of calls whose jobs run side by side."""
    calls = [inheritable_thread_target(spark)(c) for c in calls]
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def _sides(left: DataFrame, right: DataFrame, predicate: str | Callable, left_geom: str, right_geom: str, cell: tuple[float, float] | None, grow: Column | float = 0.0) -> Sides:
    name = predicate if isinstance(predicate, str) else NAMED.get(predicate)
    far = None if isinstance(grow, Column) else max(0.0, float(grow))
    if name and far == 0:
        (left, _), (right, plain) = _both(left.sparkSession, lambda: _made_once(left, left_geom), lambda: _made_once(right, right_geom))
    else:
        plain = _plain(right, right_geom)
    if far is not None and plain and _estimate(right) > SMALL_BYTES:  # a filter of points and boxes reaches the scan and stands first
        a = _profile(left, left_geom)
        if a.extent:
            right = right.where(_near(F.col(right_geom), a.extent, far))
        b = _profile(right, right_geom)
    else:
        a, b = _both(left.sparkSession, lambda: _profile(left, left_geom), lambda: _profile(right, right_geom))
    if not a.n or not b.n:
        left, right = left.where("false"), right.where("false")
    elif far is not None:  # filters of shapes that cost little; others are made again for each mention in one
        beyond = lambda p, q: p.kind and (p.extent[0] < q[0] or p.extent[1] < q[1] or p.extent[2] > q[2] or p.extent[3] > q[3])
        grown = (a.extent[0] - far, a.extent[1] - far, a.extent[2] + far, a.extent[3] + far)
        if beyond(b, grown):
            right = right.where(_near(F.col(right_geom), a.extent, far))
        if beyond(a, b.extent):
            left = left.where(_near(F.col(left_geom), b.extent, far))
    test = PREDICATES[predicate] if isinstance(predicate, str) else predicate
    return Sides(left, right, a, b, cell or a.cell, test, _corner_test(name, a.kind, b.kind), name == "equals" and a.kind is not None and a.kind == b.kind)


def spatial_join(left: DataFrame, right: DataFrame, predicate: str | Callable[[str, str], Column] = "intersects", left_geom: str = "left_geom", right_geom: str = "right_geom", cell: tuple[float, float] | None = None, grow: Column | float = 0.0, broadcast: bool = False) -> DataFrame:
    """Inner join on a predicate of two geometry columns of different names: one of PREDICATES by name, exact for all
    shapes, or a function of two columns. broadcast asks for the right side to be broadcast, which is done up to
    MAX_BROADCAST bytes by Spark's estimate.

    A row lies in at most about MAX_CELLS cells: rows too large for the cells are put into wider ones, of the level of
    their size. Rows meet at the wider of their two levels, so those of a level join those of all finer ones there.

    If geometries repeat, pairs of distinct ones are found first, unless the function isn't known to read them alone.
    """
    s = _sides(left, right, predicate, left_geom, right_geom, cell, grow)
    known = (isinstance(predicate, str) or predicate in NAMED) and not isinstance(grow, Column) and grow == 0
    if not known or s.a.n * s.b.n < 4 * s.a.distinct * s.b.distinct:
        test = (lambda p, q: s.corners(F.col(p), F.col(q))) if s.corners else s.test
        return _cell_join(s.left, s.right, test, left_geom, right_geom, s.cell, grow, broadcast, [s.a.most, s.b.most])
    k = _slices(left)
    if s.same_corners:  # equal points or boxes meet by their corners, without cells
        right_keys = list(_keys(right_geom, s.b.kind, _free([*left.columns, *right.columns], *(f"_b{j}" for j in range(4)))))
        first, even = s.with_keys(True, left_geom, right_keys), False
    else:
        pairs, left_keys, right_keys, *_ = s.pairs(left_geom, right_geom)
        pairs = pairs.select(*left_keys, *right_keys)
        a = s.with_keys(True, left_geom, left_keys)
        # many geometries, none with many rows, lie evenly in partitions by their keys
        even = s.a.distinct >= EVEN * k and (a.groupBy(F.xxhash64(*left_keys)).count().agg(F.max("count")).first()[0] or 0) <= max(CHUNK, s.a.n // k)
        first = _met(a, pairs, left_keys, k if even else None)
    b = s.with_keys(False, right_geom, right_keys)
    small = s.b.n <= SMALL_ROWS and _estimate(s.right) <= SMALL_BYTES
    chunk, n = _free([*first.columns, *b.columns], "_chunk", "_n")
    on = list(right_keys)
    if not small:  # a geometry's rows on the right are dealt to chunks; each row on the left meets all of them
        on.append(chunk)
        size = b.groupBy(*right_keys).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(n))
        b = b.join(size, right_keys).withColumn(chunk, F.pmod(F.xxhash64(*(c for c in s.right.columns if c != right_geom)), F.col(n)).cast("int")).drop(n)
        first = first.join(size, right_keys).withColumn(chunk, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    values = None
    if s.corners:  # points and boxes are small enough for arrays; those meet at less cost than rows one by one
        values = dict(zip(s.right.columns, _free([*first.columns, *b.columns], *(f"_all_{c}" for c in s.right.columns))))
        b = b.groupBy(*on).agg(F.count("*").cast("int").alias(n), *(F.collect_list(F.struct(F.col(c).alias("v"))).alias(v) for c, v in values.items()))
    if small:
        out = (first if even else first.repartition(k)).join(F.broadcast(b), on)
    else:
        out = _met(first, b, on, k)
    if not values:
        return out.select(*(F.col(c) for c in (*left.columns, *right.columns)))
    out = out.withColumn(chunk, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))  # arrays that nobody reads are never made
    return out.select(*(F.col(c) for c in left.columns), *(F.get(F.col(v), F.col(chunk)).v.alias(c) for c, v in values.items()))


def _met(a: DataFrame, b: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    """Rows of equal keys, in so many partitions where they are given. Rows meet by a hash of the keys, since partitions
    by floating numbers are dealt anew for a join; the keys are compared after it."""
    if partitions is None:
        return a.join(b, keys)
    h, *other = _free([*a.columns, *b.columns], "_hash", *(f"_other{j}" for j in range(len(keys))))
    a, b = a.withColumn(h, F.xxhash64(*keys)), b.withColumn(h, F.xxhash64(*keys)).withColumnsRenamed(dict(zip(keys, other)))
    out = a.repartition(partitions, h).join(b.repartition(partitions, h), h)
    return out.where(" AND ".join(f"`{k}` = `{o}`" for k, o in zip(keys, other))).drop(h, *other)


def spatial_join_count(left: DataFrame, right: DataFrame, predicate: str | Callable[[str, str], Column], key: str, left_geom: str = "left_geom", right_geom: str = "right_geom", cell: tuple[float, float] | None = None) -> DataFrame:
    """(key, n): what join_count_by_key gives for spatial_join, without its pairs of rows. The predicate may read the
    geometries alone."""
    s = _sides(left, right, predicate, left_geom, right_geom, cell)
    pairs, left_keys, _, _, n_right = s.pairs(left_geom, right_geom)
    return _count_rows(s, pairs.groupBy(*left_keys).agg(F.sum(n_right).alias("n")), left_keys, key, left_geom)


def _count_rows(s: Sides, sums: DataFrame, left_keys: list[str], key: str, left_geom: str) -> DataFrame:
    """(key, n) from the counts of distinct geometries."""
    rows = s.with_keys(True, left_geom, left_keys).select(key, *left_keys).groupBy(key, *left_keys).agg(F.count("*").alias("_rows"))
    return rows.join(sums, left_keys).groupBy(key).agg(F.sum(F.col("n") * F.col("_rows")).alias("n"))


def distance_join(left: DataFrame, right: DataFrame, radius: float | Column, inclusive: bool = True, left_geom: str = "left_geom", right_geom: str = "right_geom", cell: tuple[float, float] | None = None, broadcast: bool = False) -> DataFrame:
    """Pairs within (or nearer than) the radius, by exact distance; the radius may be a column of the left side."""
    def near(a: str, b: str) -> Column:
        d = G.st_distance(a, b)
        return d <= radius if inclusive else d < radius

    if cell is None:
        wide = left.agg(F.avg(radius)).first()[0] or 0.0 if isinstance(radius, Column) else radius
        cell = tuple(max(c, 2 * wide) for c in cell_size(left, left_geom))
    return spatial_join(left, right, near, left_geom, right_geom, cell, radius, broadcast)


def join_count_by_key(joined: DataFrame, key: str) -> DataFrame:
    return joined.groupBy(key).agg(F.count("*").alias("n"))


def join_grouped(joined: DataFrame, key: str | list[str], *values: str, name: str = "matches") -> DataFrame:
    """(key, matches): a left row's right rows as one array. A key's matches are one value in one task: count them by
    join_count_by_key where they may be many."""
    return joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*values))).alias(name))


def range_query(df: DataFrame, geom: str, window: Column, boundary: bool = True, covering: bool = False) -> DataFrame:
    """Rows that the window meets (boundary) or covers, or with covering, that cover the window; the box test stands
    first and reaches the scan. Exact for all shapes."""
    if boundary and not covering:
        return df.where(G.boxes_meet(window, geom) & G.st_intersects(window, geom))
    row = df.sparkSession.range(1).select(window.alias("w")).first()  # the window is one constant value
    if row.w is None:
        return df.where("false")
    shape = (row.w.gtype, [[(v.x, v.y) for v in path] for path in row.w.paths])
    held = (lambda s: K.covers(s, shape)) if covering else (lambda s: K.covers(shape, s))
    near = G.box_covers(geom, window) if covering else G.box_covers(window, geom)
    # a column that isn't deterministic keeps Spark from moving the Python test below the making of the geometry
    (row_id,) = _free(df.columns, "_row")
    near_rows = df.where(near).withColumn(row_id, F.monotonically_increasing_id())
    return near_rows.where(E.call(held, "boolean", (F.col(geom).gtype.cast("int"), F.col(geom).paths))).drop(row_id)


def knn(df: DataFrame, geom: str, x: float, y: float, k: int, tie: str) -> DataFrame:
    """The k nearest rows, ties by a column; a top-k without a full sort."""
    d = G.st_distance(F.col(geom), G.st_point(F.lit(x), F.lit(y)))
    return df.withColumn("distance", d).orderBy("distance", tie).limit(k)


def layer_count(polygons: DataFrame, points: DataFrame, name: str, poly_geom: str, point_geom: str, method: str = "optimized", cell: tuple[float, float] | None = None) -> DataFrame:
    """(name, n): points that meet each polygon. filter_refine tests each candidate; decomposition counts points by
    cell first, takes cells inside the polygon whole and tests points in its boundary cells alone; optimized chooses by
    the points of a cell."""
    s = _sides(polygons, points, "intersects", poly_geom, point_geom, cell)
    cell, g, p = s.cell, F.col(poly_geom), F.col(point_geom)
    if method == "optimized":
        cells = s.right.select(_cell(p.xmin, cell[0]).alias("a"), _cell(p.ymin, cell[1]).alias("b"))
        r = cells.agg(F.count("*"), F.approx_count_distinct(F.struct("a", "b"))).first()
        method = "decomposition" if r[0] > 8 * max(r[1], 1) else "filter_refine"
    if method == "filter_refine":
        return spatial_join_count(polygons, points, "intersects", name, poly_geom, point_geom, cell)
    cx, cy = (c / 4 for c in cell)
    kinds = (s.a.kind, s.b.kind) if s.corners else (None, None)
    over, keys = _distinct(s.left, poly_geom, kinds[0], [f"_a{k}" for k in range(4)], "_rows")
    placed, _ = _distinct(s.right, point_geom, kinds[1], [f"_b{k}" for k in range(4)], "c")
    placed = placed.select(point_geom, "c", _cell(p.xmin, cx).alias("_x"), _cell(p.ymin, cy).alias("_y"))
    counts = placed.groupBy("_x", "_y").agg(F.sum("c").alias("c"))
    over = _with_cells(over.select(*keys, poly_geom), poly_geom, cx, cy)
    box = G.st_polygonfromenvelope(F.col("_x") * cx, F.col("_y") * cy, (F.col("_x") + 1) * cx, (F.col("_y") + 1) * cy)
    over = over.withColumn("_inside", G.box_covers(g, box) if kinds[0] == "box" else F.lit(False) if kinds[0] else G.is_box(g) & G.box_covers(g, box))
    whole = over.where("_inside").select(*keys, "_x", "_y").join(counts, ["_x", "_y"]).select(*keys, "c")
    edge = over.where("NOT _inside").join(placed, ["_x", "_y"]).where(s.corners(g, p) if s.corners else G.st_intersects(poly_geom, point_geom))
    sums = whole.union(edge.select(*keys, "c")).groupBy(*keys).agg(F.sum("c").alias("n"))
    return _count_rows(s, sums, keys, name, poly_geom)


def union_aggregate(df: DataFrame, key: str, geom: str, cell: tuple[float, float] | None = None) -> DataFrame:
    """(key, geom): the union of each group's areas. Areas of one cell are united first, then the cells' results, so a
    large group is spread over tasks and only outlines meet in the last one."""
    cx, cy = cell or tuple(8 * c for c in cell_size(df, geom))
    g = F.col(geom)
    rows = df.where(g.gtype.isin(G.POLYGON, G.MULTIPOLYGON)).select(key, geom, _cell(g.xmin, cx).alias("_x"), _cell(g.ymin, cy).alias("_y"))
    part = rows.groupBy(key, "_x", "_y").agg(F.collect_set(g.paths).alias("_all"))
    part = part.select(key, E.st_union_all("_all").alias(geom))
    return part.groupBy(key).agg(F.collect_list(F.col(geom).paths).alias("_all")).select(key, E.st_union_all("_all").alias(geom))


def intersection_aggregate(df: DataFrame, key: str, geom: str, parts: int = 64) -> DataFrame:
    """(key, geom): the common part of each group's shapes; an empty polygon where there is none. Each group is dealt to
    parts that are folded first, so at most so many shapes meet in the last fold. Null shapes are left out."""
    g = F.col(geom)
    shape = F.struct(g.gtype.cast("int").alias("gtype"), g.paths.alias("paths"))
    rows = df.where(g.isNotNull()).select(key, shape.alias(geom)).withColumn("_part", F.pmod(F.xxhash64(geom), F.lit(parts)))
    part = rows.groupBy(key, "_part").agg(F.collect_set(geom).alias("_all")).select(key, E.st_intersection_all("_all").alias(geom))
    last = part.groupBy(key).agg(F.collect_set(F.struct(g.gtype.cast("int").alias("gtype"), g.paths.alias("paths"))).alias("_all"))
    return last.select(key, E.st_intersection_all("_all").alias(geom))


def ripley_k(points: DataFrame, others: DataFrame, radii: list[float], area: float, left_geom: str, right_geom: str) -> DataFrame:
    """(radius, pairs, k, l): K = pairs area / (n m), L = sqrt(K / pi); one join at the largest radius serves all."""
    n, m = points.count(), others.count()
    pairs = distance_join(points, others, max(radii), True, left_geom, right_geom).select(G.st_distance(left_geom, right_geom).alias("d"))
    each = pairs.select(F.explode(F.filter(F.array(*map(F.lit, radii)), lambda r: r >= F.col("d"))).alias("radius"))
    k = F.col("pairs") * area / (n * m)
    return each.groupBy("radius").agg(F.count("*").alias("pairs")).withColumn("k", k).withColumn("l", F.sqrt(F.col("k") / 3.141592653589793))
