"""The ST_* and RS_* names for SQL: temporary functions whose bodies are the Column expressions as text, so Catalyst inlines
them and their box tests still reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.functions import raster as R
from terravane.functions import shapes as S

g, d, i, t, band = G.GEOM, "double", "int", "string", "array<double>"

#: name: (function, types of its arguments). SQL takes all arguments; Python has shorter forms.
FUNCTIONS = {
    "ST_Point": (G.st_point, [d, d]), "ST_PolygonFromEnvelope": (G.st_polygonfromenvelope, [d] * 4),
    "ST_PointFromText": (G.st_pointfromtext, [t, t]), "ST_LineStringFromText": (G.st_linestringfromtext, [t, t]), "ST_PolygonFromText": (G.st_polygonfromtext, [t, t]),
    "ST_GeomFromWKT": (G.st_geomfromwkt, [t]), "ST_GeomFromText": (G.st_geomfromtext, [t]), "ST_GeomFromGeoJSON": (G.st_geomfromgeojson, [t]),
    "ST_GeomFromGeoHash": (G.st_geomfromgeohash, [t]),
    "ST_X": (G.st_x, [g]), "ST_Y": (G.st_y, [g]), "ST_GeometryType": (G.st_geometrytype, [g]), "ST_NPoints": (G.st_npoints, [g]),
    "ST_Length": (G.st_length, [g]), "ST_Area": (G.st_area, [g]), "ST_Centroid": (G.st_centroid, [g]), "ST_Envelope": (G.st_envelope, [g]),
    "ST_StartPoint": (G.st_startpoint, [g]), "ST_EndPoint": (G.st_endpoint, [g]), "ST_IsClosed": (G.st_isclosed, [g]), "ST_ExteriorRing": (G.st_exteriorring, [g]),
    "ST_NumInteriorRings": (G.st_numinteriorrings, [g]), "ST_InteriorRingN": (G.st_interiorringn, [g, i]), "ST_NumGeometries": (G.st_numgeometries, [g]),
    "ST_GeometryN": (G.st_geometryn, [g, i]), "ST_Dump": (G.st_dump, [g]), "ST_DumpPoints": (G.st_dumppoints, [g]), "ST_MakePolygon": (G.st_makepolygon, [g]),
    "ST_AddPoint": (G.st_addpoint, [g, g, i]), "ST_RemovePoint": (G.st_removepoint, [g, i]), "ST_FlipCoordinates": (G.st_flipcoordinates, [g]),
    "ST_PrecisionReduce": (G.st_precisionreduce, [g, i]), "ST_AsText": (G.st_astext, [g]), "ST_AsGeoJSON": (G.st_asgeojson, [g]), "ST_Azimuth": (G.st_azimuth, [g, g]),
    "ST_GeoHash": (G.st_geohash, [g, i]), "ST_LineInterpolatePoint": (G.st_lineinterpolatepoint, [g, d]), "ST_LineSubstring": (G.st_linesubstring, [g, d, d]),
    "ST_Boundary": (G.st_boundary, [g]), "ST_Distance": (G.st_distance, [g, g]),
    "ST_AsEWKB": (S.st_asewkb, [g]), "ST_ConvexHull": (S.st_convexhull, [g]), "ST_Buffer": (S.st_buffer, [g, d]),
    "ST_Intersection": (S.st_intersection, [g, g]), "ST_IsValid": (S.st_isvalid, [g]), "ST_IsSimple": (S.st_issimple, [g]), "ST_IsRing": (S.st_isring, [g]),
    "ST_MakeValid": (S.st_makevalid, [g, "boolean"]), "ST_SimplifyPreserveTopology": (S.st_simplifypreservetopology, [g, d]),
    "ST_MinimumBoundingCircle": (S.st_minimumboundingcircle, [g, i]), "ST_MinimumBoundingRadius": (S.st_minimumboundingradius, [g]),
    "ST_LineMerge": (S.st_linemerge, [g]), "ST_SubDivide": (S.st_subdivide, [g, i]),
    "ST_Contains": (S.st_contains, [g, g]), "ST_Within": (S.st_within, [g, g]), "ST_Intersects": (S.st_intersects, [g, g]), "ST_Equals": (S.st_equals, [g, g]),
    "ST_Touches": (S.st_touches, [g, g]), "ST_Overlaps": (S.st_overlaps, [g, g]), "ST_Crosses": (S.st_crosses, [g, g]),
    "RS_NormalizedDifference": (R.rs_normalizeddifference, [band, band]), "RS_Mean": (R.rs_mean, [band]), "RS_Mode": (R.rs_mode, [band]),
    "RS_GreaterThan": (R.rs_greaterthan, [band, d]), "RS_GreaterThanEqual": (R.rs_greaterthanequal, [band, d]), "RS_LessThan": (R.rs_lessthan, [band, d]),
    "RS_LessThanEqual": (R.rs_lessthanequal, [band, d]), "RS_Count": (R.rs_count, [band, d]), "RS_MultiplyFactor": (R.rs_multiplyfactor, [band, i]),
    "RS_AddBands": (R.rs_addbands, [band, band]), "RS_SubtractBands": (R.rs_subtractbands, [band, band]), "RS_MultiplyBands": (R.rs_multiplybands, [band, band]),
    "RS_DivideBands": (R.rs_dividebands, [band, band]), "RS_Modulo": (R.rs_modulo, [band, d]), "RS_SquareRoot": (R.rs_squareroot, [band]),
    "RS_BitwiseAnd": (R.rs_bitwiseand, [band, band]), "RS_BitwiseOr": (R.rs_bitwiseor, [band, band]), "RS_LogicalDifference": (R.rs_logicaldifference, [band, band]),
    "RS_LogicalOver": (R.rs_logicalover, [band, band]), "RS_Normalize": (R.rs_normalize, [band]),
    "RS_GetBand": (R.rs_getband, [band, i, i]), "RS_HTML": (R.rs_html, [t]),
}
SYMBOL = re.compile(r"(?<![\w`'\]])(<=>|<=|>=|!=|==|[-=<>!+*/%&|^~]|and|or|not)\(")
FRACTION = re.compile(r"(?<![\w.'])(\d+\.\d+(?:[eE][-+]?\d+)?)(?![\w.])")


def text_of(c: Column) -> str:
    """The expression as SQL: operators as quoted functions, fractions as doubles."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", c._jc.node().sql())
    return "".join(p if k % 2 else SYMBOL.sub(r"`\1`(", FRACTION.sub(r"\1D", p)) for k, p in enumerate(parts))


def register_all(spark: SparkSession) -> list[str]:
    """Make every name of FUNCTIONS a temporary function of the session; the names made."""
    S.named = []
    try:
        for name, (f, kinds) in FUNCTIONS.items():
            args = [f"a{k}" for k in range(len(kinds))]
            body = text_of(f(*map(F.col, args)))
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(map(' '.join, zip(args, kinds)))}) RETURN {body}")
    finally:
        S.named = None
    return [*FUNCTIONS, *S.register_shadows(spark)]
