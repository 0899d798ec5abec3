"""Readers and writers of delimited points, boxes, lines and polygons, WKT, WKB and GeoJSON.

Readers give geometry and value, the whole line; `with_fields` and `with_properties` make columns of the rest of it, and
`parts` makes a row of each part of a multi-geometry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.functions import shapes as S


def read_points(spark: SparkSession, path: str, x: int = 0, y: int = 1, delimiter: str = ",") -> DataFrame:
    parts = F.split("value", "\\" + delimiter)
    n = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double")
    return spark.read.text(path).select(G.st_point(n(x), n(y)).alias("geometry"), "value").where("geometry IS NOT NULL")


def read_rectangles(spark: SparkSession, path: str, start: int = 0, delimiter: str = ",") -> DataFrame:
    parts = F.split("value", "\\" + delimiter)
    n = lambda k: F.trim(F.get(parts, F.lit(start + k))).try_cast("double")
    return spark.read.text(path).select(G.st_polygonfromenvelope(n(0), n(1), n(2), n(3)).alias("geometry"), "value").where("geometry IS NOT NULL")


def _vertices(delimiter: str, start: int, end: int | None) -> Column:
    """Vertices of the numbers from column start to column end, the latter included; null where one isn't a number."""
    parts = F.split("value", "\\" + delimiter)
    n = F.transform(F.slice(parts, start + 1, F.greatest(F.least(F.size(parts), F.lit(1 << 30 if end is None else end + 1)) - start, F.lit(0))), lambda t: F.trim(t).try_cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda k: G.vertex(F.get(n, 2 * k), F.get(n, 2 * k + 1)))
    return F.when((F.size(n) > 1) & ~F.exists(n, F.isnull), pairs)


def read_lines(spark: SparkSession, path: str, delimiter: str = ",", start: int = 0, end: int | None = None) -> DataFrame:
    """Lines of x, y, x, y and so on; lines of text with anything else in these columns are left out."""
    found = spark.read.text(path).select(_vertices(delimiter, start, end).alias("v"), "value").where("v IS NOT NULL")
    return found.select(G.make(F.lit(G.LINESTRING), F.array("v")).alias("geometry"), "value")


def read_polygons(spark: SparkSession, path: str, delimiter: str = ",", start: int = 0, end: int | None = None) -> DataFrame:
    """As read_lines, of shells."""
    found = spark.read.text(path).select(_vertices(delimiter, start, end).alias("v"), "value").where("v IS NOT NULL")
    return found.select(G.make(F.lit(G.POLYGON), F.array("v")).alias("geometry"), "value")


def parts(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """A row for each part of a multi-geometry; other rows as they are."""
    return df.withColumn(geom, F.explode(G.st_dump(geom)))


def with_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns of what follows the geometry in a line, split at tabs; null where a line has no more."""
    fields = F.split("value", "\t")
    return df.withColumns({name: F.get(fields, F.lit(k)) for k, name in enumerate(names, 1)})


def with_properties(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns of a GeoJSON feature's properties; null where it lacks one."""
    quoted = {name: name.replace("'", "\\'") for name in names}
    return df.withColumns({name: F.get_json_object("value", f"$.properties['{q}']") for name, q in quoted.items()})


def _read(spark: SparkSession, path: str, parse, skip_invalid: bool) -> DataFrame:
    df = spark.read.text(path).select(parse("value").alias("geometry"), "value")
    return df.where("geometry IS NOT NULL") if skip_invalid else df


def read_wkt(spark: SparkSession, path: str, skip_invalid: bool = True) -> DataFrame:
    return _read(spark, path, G.st_geomfromwkt, skip_invalid)


def read_wkb(spark: SparkSession, path: str, skip_invalid: bool = True) -> DataFrame:
    """WKB as hex text, in the first of columns split at tabs."""
    return _read(spark, path, lambda value: S.st_geomfromwkb(F.split(value, "\t")[0]), skip_invalid)


def read_geojson(spark: SparkSession, path: str, skip_invalid: bool = True) -> DataFrame:
    return _read(spark, path, G.st_geomfromgeojson, skip_invalid)


def _write(df: DataFrame, shape: Column, path: str, fields: list[str]) -> None:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    df.select(F.concat_ws("\t", F.coalesce(shape, F.lit("")), *text)).write.text(path)


def write_wkt(df: DataFrame, geom: str, path: str, fields: list[str] = ()) -> None:
    """A line a row, with the fields after tabs; null fields are empty."""
    _write(df, G.st_astext(geom), path, fields)


def write_wkb(df: DataFrame, geom: str, path: str, fields: list[str] = ()) -> None:
    """As write_wkt, of WKB with its SRID as hex text."""
    _write(df, F.hex(S.st_asewkb(geom)), path, fields)


def write_geojson(df: DataFrame, geom: str, path: str, fields: list[str] = ()) -> None:
    """A bare geometry a line or, with fields, a feature that has them as its properties."""
    shape = G.st_asgeojson(geom)
    if fields:
        values = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        shape = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), values, F.lit("}"))
    df.select(shape.alias("value")).write.text(path)
