"""A query per function and operator over the driver's tables, with plain SQL that gives the same rows.

Geometry comes from integer keys: box k of ``part`` has its lower left corner at ((53 k) mod 1000, (97 k) mod 1000) and
the side p_size, so both engines compute the same numbers. ``CASES`` lists (name, expression over x, y, w,
plain SQL for the same); braces in a WKT template hold integer SQL expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from ..functions import call, native, register_all
from ..sql import spatial_sql


def w(template: str) -> str:
    """SQL that writes a WKT (or other) text: {expression} parts are put in."""
    parts = [f"({p[1:-1]})" if p[:1] == "{" else "'" + p.replace("'", "''") + "'" for p in re.split(r"(\{[^}]*\})", template) if p]
    return f"concat({', '.join(parts)})"


BOX = w("POLYGON(({x} {y},{x+w} {y},{x+w} {y+w},{x} {y+w},{x} {y}))")
HALF = w("POLYGON(({x+w} {y},{x+3*w} {y},{x+3*w} {y+2*w},{x+w} {y+2*w},{x+w} {y}))")  # meets DOUBLE in its right half
DOUBLE = w("POLYGON(({x} {y},{x+2*w} {y},{x+2*w} {y+2*w},{x} {y+2*w},{x} {y}))")
FRAME = w("POLYGON(({x} {y},{x+4*w} {y},{x+4*w} {y+4*w},{x} {y+4*w},{x} {y}),({x+w} {y+w},{x+w} {y+3*w},{x+3*w} {y+3*w},{x+3*w} {y+w},{x+w} {y+w}))")
LINE = w("LINESTRING({x} {y},{x+w} {y},{x+w} {y+w})")
DIAGONAL = w("LINESTRING({x} {y},{x+w} {y+w})")
POINT = w("POINT({x} {y})")
MIDDLE = w("POINT({x+w} {y+w})")  # of DOUBLE
DOTS = w("MULTIPOINT(({x} {y}),({x+w} {y}),({x+w} {y+w}),({x} {y+w}))")
LINES = w("MULTILINESTRING(({x} {y},{x+w} {y}),({x} {y+w},{x+w} {y+w}))")
OFFSET = "(x % 7) * w"  # 0 to 6 sides to the right
MOVED = w("POLYGON(({x+(x%7)*w} {y},{x+(x%7)*w+2*w} {y},{x+(x%7)*w+2*w} {y+2*w},{x+(x%7)*w} {y+2*w},{x+(x%7)*w} {y}))")
PLACE = w("POINT({x+(x%7)*w} {y+(y%4)*w})")  # inside, on the edge of or outside DOUBLE
ZIGZAG = w("LINESTRING({x} {y},{x+w} {y+(x%2)*w},{x+2*w} {y})")
MIXED = f"CASE x % 4 WHEN 0 THEN {POINT} WHEN 1 THEN {LINE} WHEN 2 THEN {BOX} END"
INNER = "((x % 7) = 1 AND (y % 4) = 1)"
RIM = "((x % 7) <= 2 AND (y % 4) <= 2)"


def d(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def text(expression: str) -> str:
    return f"ST_AsText({expression})"


def area(expression: str) -> str:
    return f"round(ST_Area({expression}), 6)"


LON, LAT = "(CAST((x * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180)", "(CAST((y * 6271) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - 85)"
HASH = "0123456789bcdefghjkmnpqrstuvwxyz"  # the letters of geohashes


def geohash(n: int) -> str:
    """Plain SQL for the geohash of LON and LAT: bits of the cell's column and row by turns, five to a letter."""
    bits = 5 * n
    lon = f"CAST(floor(({LON} + 180) / 360 * {1 << (bits + 1) // 2}) AS BIGINT)"
    lat = f"CAST(floor(({LAT} + 90) / 180 * {1 << bits // 2}) AS BIGINT)"
    each = [f"({lat if k % 2 else lon} >> {((bits // 2) if k % 2 else (bits + 1) // 2) - 1 - k // 2}) % 2 * {1 << (4 - k % 5)}" for k in range(bits)]
    letters = [f"substr('{HASH}', CAST({' + '.join(each[k : k + 5])} AS INTEGER) + 1, 1)" for k in range(0, bits, 5)]
    return f"concat({', '.join(letters)})"


HAVERSINE = f"2 * 6371008.8 * asin(least(CAST(1 AS DOUBLE), sqrt(pow(sin((radians({LAT} / 2) - radians({LAT})) / 2), 2) + cos(radians({LAT})) * cos(radians({LAT} / 2)) * pow(sin(radians(CAST(1 AS DOUBLE)) / 2), 2))))"

# the closed forms of two projections on GRS 80, for points between 4 degrees west and 6 east, 42 and 52 north
EAST, NORTH = "(CAST(x AS DOUBLE) / CAST(100 AS DOUBLE) - 4)", "(CAST(y AS DOUBLE) / CAST(100 AS DOUBLE) + 42)"
E = 0.081819191042815791  # eccentricity


def conic() -> str:
    """Plain SQL for the sum of both coordinates in Lambert-93 (standard parallels 49 and 44, origin 3 east, 46.5 north)."""

    def psi(lat: str) -> str:
        return f"(ln(tan(pi() / 4 + radians({lat}) / 2)) - {E} / 2 * ln((1 + {E} * sin(radians({lat}))) / (1 - {E} * sin(radians({lat})))))"

    def m(lat: str) -> str:
        return f"(cos(radians({lat})) / sqrt(1 - {E} * {E} * pow(sin(radians({lat})), 2)))"

    n = f"(ln({m('49')} / {m('44')}) / ({psi('44')} - {psi('49')}))"

    def r(lat: str) -> str:
        return f"(6378137 * {m('49')} / {n} * exp({n} * ({psi('49')} - {psi(lat)})))"

    turn = f"({n} * radians({EAST} - 3))"
    return f"round(700000 + {r(NORTH)} * sin({turn}), 2) + round(6600000 + {r('46.5')} - {r(NORTH)} * cos({turn}), 2)"


def azimuthal() -> str:
    """Plain SQL for the sum of both coordinates in the European equal-area system (origin 10 east, 52 north)."""

    def q(s: str) -> str:
        return f"({1 - E * E} * ({s} / (1 - {E * E} * {s} * {s}) + ln((1 + {E} * {s}) / (1 - {E} * {s})) / (2 * {E})))"

    pole = q("1")
    own, beta = f"asin({q('sin(radians(52))')} / {pole})", f"asin({q(f'sin(radians({NORTH}))')} / {pole})"
    radius, turn = f"(6378137 * sqrt({pole} / 2))", f"radians({EAST} - 10)"
    stretch = f"(6378137 * cos(radians(52)) / sqrt(1 - {E * E} * pow(sin(radians(52)), 2)) / ({radius} * cos({own})))"
    b = f"({radius} * sqrt(2 / (1 + sin({own}) * sin({beta}) + cos({own}) * cos({beta}) * cos({turn}))))"
    return f"round(4321000 + {b} * {stretch} * cos({beta}) * sin({turn}), 2) + round(3210000 + {b} / {stretch} * (cos({own}) * sin({beta}) - sin({own}) * cos({beta}) * cos({turn})), 2)"


def projected(srid: int) -> str:
    moved = f"ST_Transform(ST_SetSRID(ST_Point({EAST}, {NORTH}), 4258), {srid})"
    return f"round(ST_X({moved}), 2) + round(ST_Y({moved}), 2)"


CASES: list[tuple[str, str, str | None]] = [
    # accessors
    ("st_x", "ST_X(ST_Point(x, y))", d("x")),
    ("st_y", f"ST_Y({POINT})", d("y")),
    ("st_z", "ST_Z(ST_Point(x, y, w))", d("w")),
    ("st_m", f"ST_M({w('POINT M({x} {y} {w})')})", d("w")),
    ("st_geometrytype", f"ST_GeometryType(CASE x % 3 WHEN 0 THEN {POINT} WHEN 1 THEN {LINE} ELSE {BOX} END)", "CASE x % 3 WHEN 0 THEN 'ST_Point' WHEN 1 THEN 'ST_LineString' ELSE 'ST_Polygon' END"),
    ("st_dimension", f"ST_Dimension(CASE x % 3 WHEN 0 THEN {POINT} WHEN 1 THEN {LINE} ELSE {BOX} END)", "CAST(x % 3 AS INTEGER)"),
    ("st_coorddim", f"ST_CoordDim(CASE x % 4 WHEN 0 THEN {POINT} WHEN 1 THEN {w('POINT Z({x} {y} {w})')} WHEN 2 THEN {w('LINESTRING ZM({x} {y} 1 2,{x+w} {y} 3 4)')} END)", "CAST(CASE x % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 END AS INTEGER)"),
    ("st_npoints", f"ST_NPoints(CASE x % 5 WHEN 0 THEN {POINT} WHEN 1 THEN {LINE} WHEN 2 THEN {FRAME} WHEN 3 THEN 'POLYGON EMPTY' END)", "CAST(CASE x % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 10 WHEN 3 THEN 0 END AS INTEGER)"),
    ("st_numpoints", f"ST_NumPoints(CASE x % 2 WHEN 0 THEN {LINE} ELSE {BOX} END)", "CASE x % 2 WHEN 0 THEN CAST(3 AS INTEGER) END"),
    ("st_numgeometries", f"ST_NumGeometries(CASE x % 2 WHEN 0 THEN {DOTS} ELSE {BOX} END)", "CAST(CASE x % 2 WHEN 0 THEN 4 ELSE 1 END AS INTEGER)"),
    ("st_numinteriorrings", f"ST_NumInteriorRings(CASE x % 3 WHEN 0 THEN {FRAME} WHEN 1 THEN {BOX} ELSE {LINE} END)", "CAST(CASE x % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INTEGER)"),
    ("st_isempty", f"ST_IsEmpty(CASE x % 2 WHEN 0 THEN 'POINT EMPTY' ELSE {POINT} END)", "x % 2 = 0"),
    ("st_isclosed", f"ST_IsClosed(CASE x % 2 WHEN 0 THEN {LINE} ELSE {w('LINESTRING({x} {y},{x+w} {y},{x+w} {y+w},{x} {y})')} END)", "x % 2 = 1"),
    ("st_isring", f"ST_IsRing(CASE x % 3 WHEN 0 THEN {LINE} WHEN 1 THEN {w('LINESTRING({x} {y},{x+w} {y},{x+w} {y+w},{x} {y})')} ELSE {POINT} END)", "CASE x % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END"),
    ("st_issimple", f"ST_IsSimple(CASE x % 2 WHEN 0 THEN {w('LINESTRING({x} {y},{x+w} {y+w},{x+w} {y},{x} {y+w})')} ELSE {LINE} END)", "x % 2 = 1"),
    ("st_srid", f"ST_SRID(CASE WHEN x % 5 > 0 THEN ST_SetSRID({POINT}, CAST(27700 + x % 3 AS INT)) END)", "CASE WHEN x % 5 > 0 THEN CAST(27700 + x % 3 AS INTEGER) END"),
    # components
    ("st_startpoint", text(f"ST_StartPoint({LINE})"), POINT),
    ("st_endpoint", text(f"ST_EndPoint({LINE})"), MIDDLE),
    ("st_pointn", text(f"ST_PointN({LINE}, CAST(x % 5 AS INT))"), f"CASE x % 5 WHEN 1 THEN {POINT} WHEN 2 THEN {w('POINT({x+w} {y})')} WHEN 3 THEN {MIDDLE} END"),
    ("st_exteriorring", text(f"ST_ExteriorRing({FRAME})"), w("LINESTRING({x} {y},{x+4*w} {y},{x+4*w} {y+4*w},{x} {y+4*w},{x} {y})")),
    ("st_interiorringn", text(f"ST_InteriorRingN({FRAME}, 1)"), w("LINESTRING({x+w} {y+w},{x+w} {y+3*w},{x+3*w} {y+3*w},{x+3*w} {y+w},{x+w} {y+w})")),
    ("st_geometryn", text(f"ST_GeometryN({DOTS}, 3)"), MIDDLE),
    # dimensions and SRID
    ("st_flipcoordinates", text(f"ST_FlipCoordinates({DIAGONAL})"), w("LINESTRING({y} {x},{y+w} {x+w})")),
    ("st_force2d", text(f"ST_Force2D({w('POINT Z({x} {y} {w})')})"), POINT),
    ("st_force3d", text(f"ST_Force3D(CASE WHEN x % 2 = 0 THEN {LINE} ELSE {POINT} END)"), f"CASE WHEN x % 2 = 0 THEN {w('LINESTRING Z({x} {y} 0,{x+w} {y} 0,{x+w} {y+w} 0)')} ELSE {w('POINT Z({x} {y} 0)')} END"),
    ("st_setsrid", f"ST_SRID(ST_SetSRID(ST_SetSRID(CASE x % 3 WHEN 0 THEN {LINE} WHEN 1 THEN {BOX} END, 4326), CAST((x % 2) * 3857 AS INT)))", "CASE WHEN x % 3 < 2 THEN CAST((x % 2) * 3857 AS INTEGER) END"),
    # constructors
    ("st_point", text("ST_Point(x, y)"), POINT),
    ("st_makepoint", text("ST_MakePoint(x, y)"), POINT),
    ("st_pointz", "ST_Z(ST_PointZ(x, y, w))", d("w")),
    ("st_makeenvelope", text("ST_MakeEnvelope(x, y, x + w, y + w)"), BOX),
    ("st_makebox2d", "ST_Area(ST_MakeBox2D(x, y, x + w, y + 2 * w))", d("2 * w * w")),
    ("st_makepolygon", text(f"ST_MakePolygon({w('LINESTRING({x} {y},{x+w} {y},{x+w} {y+w},{x} {y+w},{x} {y})')})"), BOX),
    ("st_makeline", text(f"ST_MakeLine(ST_Point(x, y), {MIDDLE})"), DIAGONAL),
    # input and output
    ("st_astext", text(FRAME), FRAME),
    ("st_asbinary", f"concat(length(ST_AsBinary({MIXED})), ' ', ST_AsText(ST_GeomFromWKB(ST_AsBinary({MIXED}))))", f"CASE WHEN x % 4 < 3 THEN concat(CASE x % 4 WHEN 0 THEN 21 WHEN 1 THEN 57 ELSE 93 END, ' ', {MIXED}) END"),
    ("st_asewkb", f"concat(length(ST_AsEWKB(ST_SetSRID({MIXED}, 4326))), ' ', ST_SRID(ST_AsEWKB(ST_SetSRID({MIXED}, CAST(4326 + x % 2 AS INT)))), ' ', ST_AsText(ST_AsEWKB(ST_SetSRID({MIXED}, 4326))))", f"CASE WHEN x % 4 < 3 THEN concat(CASE x % 4 WHEN 0 THEN 25 WHEN 1 THEN 61 ELSE 97 END, ' ', 4326 + x % 2, ' ', {MIXED}) END"),
    ("st_asgeojson", f"ST_AsGeoJSON({POINT})", "concat(chr(123), '\"type\":\"Point\",\"coordinates\":[', x, ',', y, ']', chr(125))"),
    ("st_geomfromtext", text(f"ST_GeomFromText({LINES})"), LINES),
    ("st_geomfromwkb", text(f"ST_GeomFromWKB(ST_AsBinary({BOX}))"), BOX),
    ("st_geomfromewkb", f"concat(ST_SRID(ST_GeomFromEWKB(ST_AsEWKB(ST_SetSRID({MIXED}, 4326)))), ' ', ST_AsText(ST_GeomFromEWKB(ST_AsEWKB(ST_SetSRID({MIXED}, 4326)))))", f"CASE WHEN x % 4 < 3 THEN concat('0 ', {MIXED}) END"),
    ("st_geomfromgeojson", text(f"ST_GeomFromGeoJSON(ST_AsGeoJSON({LINES}))"), LINES),
    ("st_geohash", f"ST_GeoHash(ST_Point({LON}, {LAT}), 6)", geohash(6)),
    ("st_pointfromgeohash", f"ST_AsText(ST_PointFromGeoHash(substr('{HASH}', CAST(x % 32 AS INT) + 1, 1)))", "concat('POINT(', CAST((((x % 32) // 16) * 4 + ((x % 32) // 4) % 2 * 2 + x % 2) * 45 - 158 + 0.5 AS DOUBLE), ' ', CAST((((x % 32) // 8) % 2 * 2 + ((x % 32) // 2) % 2) * 45 - 68 + 0.5 AS DOUBLE), ')')"),
    # predicates: MOVED is DOUBLE moved right by 0 to 6 sides of w, PLACE a point of its grid
    ("st_intersects", f"ST_Intersects(CASE x % 11 WHEN 0 THEN NULL WHEN 1 THEN 'POLYGON EMPTY' ELSE {DOUBLE} END, {MOVED})", "CASE x % 11 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE (x % 7) <= 2 END"),
    ("st_disjoint", f"ST_Disjoint(CASE x % 11 WHEN 0 THEN NULL WHEN 1 THEN 'POLYGON EMPTY' ELSE {DOUBLE} END, {MOVED})", "CASE x % 11 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE (x % 7) > 2 END"),
    ("st_contains", f"ST_Contains({DOUBLE}, {PLACE})", INNER),
    ("st_containsproperly", f"ST_ContainsProperly({w('POLYGON(({x} {y},{x+4*w} {y},{x+4*w} {y+4*w},{x} {y+4*w},{x} {y}))')}, {w('POLYGON(({x+(x%5)*w} {y+w},{x+(x%5)*w+w} {y+w},{x+(x%5)*w+w} {y+2*w},{x+(x%5)*w} {y+2*w},{x+(x%5)*w} {y+w}))')})", "(x % 5) IN (1, 2)"),
    ("st_within", f"ST_Within({PLACE}, CASE x % 11 WHEN 0 THEN NULL WHEN 1 THEN 'POLYGON EMPTY' ELSE {DOUBLE} END)", f"CASE x % 11 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE {INNER} END"),
    ("st_covers", f"ST_Covers({DOUBLE}, {PLACE})", RIM),
    ("st_coveredby", f"ST_CoveredBy({PLACE}, {DOUBLE})", RIM),
    ("st_touches", f"ST_Touches({DOUBLE}, {MOVED})", "(x % 7) = 2"),
    ("st_crosses", f"ST_Crosses({w('LINESTRING({x+(x%7)*w-2*w} {y+w},{x+(x%7)*w+w} {y+w})')}, {DOUBLE})", "(x % 7) IN (0, 1, 2, 3)"),
    ("st_overlaps", f"ST_Overlaps({DOUBLE}, {MOVED})", "(x % 7) = 1"),
    ("st_equals", f"ST_Equals({DOUBLE}, {MOVED})", "(x % 7) = 0"),
    ("st_dwithin", f"ST_DWithin({DOUBLE}, {MOVED}, 60)", "greatest(0, (x % 7 - 2) * w) <= 60"),
    ("st_dfullywithin", f"ST_DFullyWithin({POINT}, {LINE}, 20)", "2 * w * w <= 400"),
    ("st_relate", f"ST_Relate({DOUBLE}, {MOVED})", "CASE x % 7 WHEN 0 THEN '2FFF1FFF2' WHEN 1 THEN '212111212' WHEN 2 THEN 'FF2F11212' ELSE 'FF2FF1212' END"),
    ("st_relate_pattern", f"CAST(ST_Relate({DOUBLE}, {MOVED}, 'T********') AS BOOLEAN)", "(x % 7) <= 1"),
    # measurement
    ("st_area", f"ST_Area(CASE x % 6 WHEN 0 THEN {BOX} WHEN 1 THEN {LINE} WHEN 2 THEN 'POLYGON EMPTY' WHEN 3 THEN NULL ELSE {FRAME} END)", "CASE x % 6 WHEN 0 THEN CAST(w * w AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(0 AS DOUBLE) WHEN 3 THEN NULL ELSE CAST(12 * w * w AS DOUBLE) END"),
    ("st_length", f"ST_Length(CASE x % 4 WHEN 0 THEN {LINES} WHEN 1 THEN {BOX} WHEN 2 THEN NULL ELSE {LINE} END)", "CASE x % 4 WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(2 * w AS DOUBLE) END"),
    ("st_perimeter", f"ST_Perimeter(CASE x % 4 WHEN 0 THEN {BOX} WHEN 1 THEN {LINE} WHEN 2 THEN NULL ELSE {FRAME} END)", "CASE x % 4 WHEN 0 THEN CAST(4 * w AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(24 * w AS DOUBLE) END"),
    ("st_distance", f"ST_Distance({DOUBLE}, {MOVED})", d("greatest(0, (x % 7 - 2) * w)")),
    ("st_maxdistance", f"round(ST_MaxDistance({POINT}, {LINE}), 6)", "round(sqrt(CAST(2 * w * w AS DOUBLE)), 6)"),
    ("st_hausdorffdistance", f"ST_HausdorffDistance({DOUBLE}, {MOVED})", d("(x % 7) * w")),
    ("st_frechetdistance", f"ST_FrechetDistance({LINE}, {w('LINESTRING({x} {y+w},{x+w} {y+w},{x+w} {y+w+(x%7)*w})')})", "CAST(greatest(w, (x % 7) * w) AS DOUBLE)"),
    ("st_distancesphere", f"round(ST_DistanceSphere(ST_Point({LON}, {LAT}), ST_Point({LON} + 1, {LAT} / 2)), 3)", f"round({HAVERSINE}, 3)"),
    ("st_distancespheroid", "round(ST_DistanceSpheroid(ST_Point(0, 0), ST_Point(CAST(x AS DOUBLE) / CAST(10 AS DOUBLE), 0)), 3)", "round(radians(CAST(x AS DOUBLE) / CAST(10 AS DOUBLE)) * 6378137, 3)"),
    ("st_azimuth", "round(ST_Azimuth(ST_Point(0, 0), ST_Point(CAST(CASE x % 5 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS DOUBLE) * (w + 1) / 10, CAST(CASE x % 5 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS DOUBLE) * (w + 1) / 10)), 6)", "CASE x % 5 WHEN 0 THEN round(pi() / 2, 6) WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN round(3 * pi() / 2, 6) WHEN 3 THEN round(pi(), 6) END"),
    # linear referencing
    ("st_closestpoint", text(f"ST_ClosestPoint({LINE}, {w('POINT({x+2*w} {y+(x%4-1)*w})')})"), w("POINT({x+w} {y+greatest(0,least(1,x%4-1))*w})")),
    ("st_shortestline", text(f"ST_ShortestLine({LINE}, {w('POINT({x+2*w} {y+(x%4-1)*w})')})"), w("LINESTRING({x+w} {y+greatest(0,least(1,x%4-1))*w},{x+2*w} {y+(x%4-1)*w})")),
    ("st_linelocatepoint", f"ST_LineLocatePoint(CASE WHEN x % 4 < 3 THEN {LINE} ELSE {BOX} END, {w('POINT({x+least(1,x%4)*w} {y+greatest(0,x%4-1)*w})')})", "CASE WHEN x % 4 < 3 THEN CAST(x % 4 AS DOUBLE) / 2 END"),
    ("st_lineinterpolatepoint", text(f"ST_LineInterpolatePoint({LINE}, CAST(x % 4 AS DOUBLE) / 2)"), f"CASE WHEN x % 4 < 3 THEN {w('POINT({x+least(1,x%4)*w} {y+greatest(0,x%4-1)*w})')} END"),
    ("st_project", "round(ST_X(ST_Project(ST_Point(CAST(x % 90 AS DOUBLE), 0), CAST(w AS DOUBLE) * 1000, pi() / 2 + (x % 2) * pi())), 6)", "round(x % 90 + (1 - 2 * (x % 2)) * degrees(CAST(w AS DOUBLE) * 1000 / 6378137), 6)"),
    # overlay and processing
    ("st_union", area(f"ST_Union({DOUBLE}, {MOVED})"), d("8 * w * w - 2 * w * greatest(0, 2 - x % 7) * w")),
    ("st_intersection", area(f"ST_Intersection({DOUBLE}, {MOVED})"), d("2 * w * greatest(0, 2 - x % 7) * w")),
    ("st_difference", area(f"ST_Difference({DOUBLE}, {MOVED})"), d("4 * w * w - 2 * w * greatest(0, 2 - x % 7) * w")),
    ("st_symdifference", area(f"ST_SymDifference({DOUBLE}, {MOVED})"), d("8 * w * w - 4 * w * greatest(0, 2 - x % 7) * w")),
    ("st_convexhull", area(f"ST_ConvexHull({w('MULTIPOINT(({x} {y}),({x+(x%3+1)*w} {y+w}),({x+7*w} {y}),({x+w} {y+(y%4+2)*w}),({x+2*w} {y+w}))')})"), "CAST(7 * w * (y % 4 + 2) * w AS DOUBLE) / 2"),
    ("st_orientedenvelope", area(f"ST_OrientedEnvelope({DOTS})"), d("w * w")),
    ("st_boundary", text(f"ST_Boundary({LINE})"), w("MULTIPOINT(({x} {y}),({x+w} {y+w}))")),
    ("st_centroid", text(f"ST_Centroid({DOUBLE})"), MIDDLE),
    ("st_pointonsurface", f"CASE x % 4 WHEN 0 THEN CAST(ST_Within(ST_PointOnSurface({FRAME}), {FRAME}) AS STRING) WHEN 1 THEN CAST(ST_Intersects(ST_PointOnSurface({LINE}), {LINE}) AS STRING) WHEN 2 THEN ST_AsText(ST_PointOnSurface({DOUBLE})) ELSE ST_AsText(ST_PointOnSurface('POLYGON EMPTY')) END", f"CASE x % 4 WHEN 2 THEN {MIDDLE} WHEN 3 THEN NULL ELSE 'true' END"),
    ("st_makevalid", area(f"ST_MakeValid({w('POLYGON(({x} {y},{x+2*w} {y+2*w},{x+2*w} {y},{x} {y+2*w},{x} {y}))')})"), d("2 * w * w")),
    ("st_removerepeatedpoints", text(f"ST_RemoveRepeatedPoints({w('LINESTRING({x} {y},{x} {y},{x+w} {y+w},{x+w} {y+w})')})"), DIAGONAL),
    ("st_reverse", text(f"ST_Reverse({DIAGONAL})"), w("LINESTRING({x+w} {y+w},{x} {y})")),
    ("st_forcepolygonccw", text(f"ST_ForcePolygonCCW({w('POLYGON(({x} {y},{x} {y+w},{x+w} {y+w},{x+w} {y},{x} {y}))')})"), BOX),
    ("st_forcepolygoncw", text(f"ST_ForcePolygonCW({BOX})"), w("POLYGON(({x} {y},{x} {y+w},{x+w} {y+w},{x+w} {y},{x} {y}))")),
    ("st_buffer", f"round(ST_Area(ST_Buffer({BOX}, CAST(w AS DOUBLE))) / CAST(w * w AS DOUBLE), 4)", "round(5 + 32 * sin(2 * pi() / 64), 4)"),
    ("st_simplify", text(f"ST_Simplify({ZIGZAG}, 0.5)"), f"CASE WHEN x % 2 = 0 THEN {w('LINESTRING({x} {y},{x+2*w} {y})')} ELSE {ZIGZAG} END"),
    ("st_simplifyvw", text(f"ST_SimplifyVW({ZIGZAG}, 0.5)"), f"CASE WHEN x % 2 = 0 THEN {w('LINESTRING({x} {y},{x+2*w} {y})')} ELSE {ZIGZAG} END"),
    ("st_segmentize", text(f"ST_Segmentize({w('LINESTRING({x} {y},{x+10*w} {y})')}, CAST(w * 5 AS DOUBLE))"), w("LINESTRING({x} {y},{x+5*w} {y},{x+10*w} {y})")),
    ("st_concavehull", area(f"ST_ConcaveHull({w('MULTIPOINT(({x} {y}),({x+2*w} {y}),({x+2*w} {y+2*w}),({x} {y+2*w}),({x+w} {y+w}))')}, 0.001)"), d("4 * w * w")),
    ("st_chaikinsmoothing", text(f"ST_ChaikinSmoothing({w('LINESTRING({x} {y},{x+4*w} {y},{x+4*w} {y+4*w})')}, 1)"), w("LINESTRING({x} {y},{x+3*w} {y},{x+4*w} {y+w},{x+4*w} {y+4*w})")),
    ("st_translate", text(f"ST_Translate({BOX}, w, 0)"), w("POLYGON(({x+w} {y},{x+2*w} {y},{x+2*w} {y+w},{x+w} {y+w},{x+w} {y}))")),
    ("st_scale", text(f"ST_Scale({POINT}, 2, 3)"), w("POINT({2*x} {3*y})")),
    ("st_rotate", f"round(ST_X(ST_Rotate({POINT}, pi() / 2)), 6) + 0.0", d("-y")),
    ("st_affine", text(f"ST_Affine({POINT}, 2, 1, 1, 3, 5, 7)"), w("POINT({2*x+y+5} {x+3*y+7})")),
    ("st_isvalid", f"ST_IsValid(CASE x % 2 WHEN 0 THEN {FRAME} ELSE {w('POLYGON(({x} {y},{x+2*w} {y+2*w},{x+2*w} {y},{x} {y+2*w},{x} {y}))')} END)", "x % 2 = 0"),
    ("st_isvalidreason", f"ST_IsValidReason(CASE x % 2 WHEN 0 THEN {FRAME} ELSE {w('POLYGON(({x} {y},{x+2*w} {y+2*w},{x+2*w} {y},{x} {y+2*w},{x} {y}))')} END) = 'Valid Geometry'", "x % 2 = 0"),
    # boxes
    ("st_xmin", f"ST_XMin(CASE x % 5 WHEN 0 THEN 'LINESTRING EMPTY' WHEN 1 THEN NULL WHEN 2 THEN {FRAME} ELSE {LINE} END)", "CASE WHEN x % 5 > 1 THEN CAST(x AS DOUBLE) END"),
    ("st_ymin", f"ST_YMin({LINE})", d("y")),
    ("st_zmin", f"ST_ZMin({LINE})", "CAST(NULL AS DOUBLE)"),
    ("st_xmax", "ST_XMax(ST_MakeEnvelope(x, y, x + w, y + 2 * w))", d("x + w")),
    ("st_ymax", f"ST_YMax(CASE x % 5 WHEN 0 THEN 'LINESTRING EMPTY' WHEN 1 THEN NULL WHEN 2 THEN {FRAME} ELSE {LINE} END)", "CASE x % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN CAST(y + 4 * w AS DOUBLE) ELSE CAST(y + w AS DOUBLE) END"),
    ("st_zmax", f"ST_ZMax({LINE})", "CAST(NULL AS DOUBLE)"),
    ("st_envelope", text(f"ST_Envelope({LINE})"), BOX),
    ("st_expand", text(f"ST_Expand({BOX}, w)"), w("POLYGON(({x-w} {y-w},{x+2*w} {y-w},{x+2*w} {y+2*w},{x-w} {y+2*w},{x-w} {y-w}))")),
    ("st_bboxintersects", f"ST_BBoxIntersects({DOUBLE}, {MOVED})", "(x % 7) <= 2"),
    # edits and tessellation
    ("st_multi", text(f"ST_Multi({LINE})"), w("MULTILINESTRING(({x} {y},{x+w} {y},{x+w} {y+w}))")),
    ("st_points", text(f"ST_Points({LINE})"), w("MULTIPOINT(({x} {y}),({x+w} {y}),({x+w} {y+w}))")),
    ("st_delaunaytriangles", area(f"ST_DelaunayTriangles({DOTS})"), d("w * w")),
    ("st_voronoipolygons", area(f"ST_VoronoiPolygons({DOTS})"), d("4 * w * w")),
    ("st_voronoilines", f"round(ST_Length(ST_VoronoiLines({DOTS})), 6)", d("12 * w")),
    ("st_addpoint", text(f"ST_AddPoint({DIAGONAL}, ST_Point(x + w, y), 1)"), LINE),
    ("st_removepoint", text(f"ST_RemovePoint({LINE}, 1)"), DIAGONAL),
    ("st_setpoint", text(f"ST_SetPoint({LINE}, 0, {w('POINT({x-w} {y})')})"), w("LINESTRING({x-w} {y},{x+w} {y},{x+w} {y+w})")),
    ("st_snaptogrid", text("ST_SnapToGrid(ST_Point(x + 0.3, y - 0.2), 1)"), POINT),
    ("st_transform", "round(ST_X(ST_Transform(ST_SetSRID(ST_Point(CAST(x AS DOUBLE) / CAST(10 AS DOUBLE), CAST(y AS DOUBLE) / CAST(20 AS DOUBLE)), 4326), 3857)), 2) + round(ST_Y(ST_Transform(ST_SetSRID(ST_Point(CAST(x AS DOUBLE) / CAST(10 AS DOUBLE), CAST(y AS DOUBLE) / CAST(20 AS DOUBLE)), 4326), 3857)), 2)", "round(radians(CAST(x AS DOUBLE) / CAST(10 AS DOUBLE)) * 6378137, 2) + round(6378137 * ln(tan(pi() / 4 + radians(CAST(y AS DOUBLE) / CAST(20 AS DOUBLE)) / 2)), 2)"),
    ("st_transform_conic", projected(2154), conic()),
    ("st_transform_azimuthal", projected(3035), azimuthal()),
]

BASE = "SELECT p_partkey AS k, (p_partkey * 53) % 1000 AS x, (p_partkey * 97) % 1000 AS y, CAST(p_size AS BIGINT) AS w FROM part"
DOT = "SELECT o_orderkey AS o, (o_orderkey * 37) % 1000 AS ox, (o_orderkey * 91) % 1000 AS oy FROM orders"


def dealt(df: DataFrame) -> DataFrame:
    """The rows over all cores: a function of geometries costs far more than its row, which a small file gives to one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, x, y, w of every part."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "(p_partkey * 53) % 1000 AS x", "(p_partkey * 97) % 1000 AS y", "CAST(p_size AS BIGINT) AS w")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and its box struct."""
    p = parts(spark, sf_dir)
    return p.select("k", native.st_make_envelope(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("box"))


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o and the point struct of every order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("o"), native.st_point((F.col("o_orderkey") * 37) % 1000, (F.col("o_orderkey") * 91) % 1000).alias("pt"))


def _case(expression: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_all(spark)
        return dealt(parts(spark, sf_dir)).selectExpr("k", f"{expression} AS r")
    return query


def st_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_all(spark)
    return parts(spark, sf_dir).selectExpr("k", f"explode(ST_Dump({DOTS})) AS part").selectExpr("k", "ST_AsText(part) AS r")


def st_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("g", F.col("k") % 10)
    return b.groupBy("g").agg(O.st_extent(box=F.col("box")).alias("e"), F.count(F.lit(1)).alias("n")).select("g", "e.xmin", "e.ymin", "e.xmax", "e.ymax", "n")


def st_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_all(spark)
    p = parts(spark, sf_dir).selectExpr("k % 10 AS g", f"{BOX} AS geom")
    return p.groupBy("g").agg(O.st_collect(F.col("geom")).alias("c")).selectExpr("g", "ST_NumGeometries(c) AS n", "ST_Area(c) AS area")


def st_mem_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stairs of overlapping squares: each group is a row of squares of side 10 at every 5."""
    register_all(spark)
    p = parts(spark, sf_dir).selectExpr("k % 20 AS g", w("POLYGON(({5*(k%50)} 0,{5*(k%50)+10} 0,{5*(k%50)+10} 10,{5*(k%50)} 10,{5*(k%50)} 0))") + " AS geom").distinct()
    return O.union_by(p, ["g"], "geom", "u").selectExpr("g", "round(ST_Area(u), 6) AS area")


def st_cluster_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).select("k", native.st_point((F.col("k") % 3) * 10000 + F.col("x"), F.col("y")).alias("pt"))
    found = O.cluster_kmeans(p, "pt", 3, order=["k"])
    first = found.groupBy("cluster").agg(F.min("k").alias("first"))
    return found.join(first, "cluster").select("k", "first")


def st_cluster_kmeans_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, by the form for partitions that are too large for a task."""
    p = parts(spark, sf_dir).select("k", native.st_point((F.col("k") % 3) * 10000 + F.col("x"), F.col("y")).alias("pt"))
    found = O.cluster_kmeans(p, "pt", 3, limit=0)
    return found.join(found.groupBy("cluster").agg(F.min("k").alias("first")), "cluster").select("k", "first")


def st_mem_union_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 7 at every seventh (x, y) of the parts: one union over the whole table."""
    register_all(spark)
    p = parts(spark, sf_dir).selectExpr(w("POLYGON(({x} {y},{x+7} {y},{x+7} {y+7},{x} {y+7},{x} {y}))").replace("(x)", "(x - x % 7)").replace("(y)", "(y - y % 7)").replace("(x+7)", "(x - x % 7 + 7)").replace("(y+7)", "(y - y % 7 + 7)") + " AS geom")
    return O.union_by(p, [], "geom", "u").selectExpr("round(ST_Area(u), 6) AS area", "ST_XMin(u) AS xmin", "ST_YMax(u) AS ymax")


def st_cluster_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip of 10,000 by 50 for each last digit of the keys, 90,000 from the next one, however large the keys are."""
    x, y = (F.col("k") % 10) * 100_000 + F.col("k") % 10_000, F.floor(F.col("k") / 10_000) % 50
    p = parts(spark, sf_dir).select("k", native.st_point(x, y).alias("pt"), (F.col("k") % 2).alias("side"))
    found = O.cluster_dbscan(p, "pt", 100.0, 2, by=["side"])
    first = found.groupBy("side", "cluster").agg(F.min("k").alias("first"))
    return found.join(first, ["side", "cluster"]).select("k", "first")


def join_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders inside each part's box."""
    found = O.spatial_aggregate(boxes(spark, sf_dir), dots(spark, sf_dir), "ST_Intersects", "box", "pt", {"n": ("count", None), "total": ("sum", "o")})
    return found.filter("n > 0").groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def join_dwithin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).select("k", native.st_point(F.col("x"), F.col("y")).alias("at"))
    return O.spatial_aggregate(p, dots(spark, sf_dir), "ST_DWithin", "at", "pt", {"n": ("count", None)}, distance=5.0).filter("n > 0").groupBy("k").agg(F.sum("n").alias("n"))


def join_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = boxes(spark, sf_dir)
    return O.spatial_join(a, a.selectExpr("k AS k2", "box AS box2"), "ST_BBoxIntersects", "box", "box2").filter("k < k2").select("k", "k2")


def join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles (lower right halves of boxes) that contain an order: the exact test runs in Python."""
    register_all(spark)
    t = dealt(parts(spark, sf_dir)).selectExpr("k", f"ST_GeomFromText({w('POLYGON(({x} {y},{x+w} {y},{x+w} {y+w},{x} {y}))')}) AS shape")
    return O.spatial_aggregate(t, dots(spark, sf_dir), "ST_Covers", "shape", "pt", {"n": ("count", None)}).filter("n > 0").groupBy("k").agg(F.sum("n").alias("n"))


def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.spatial_aggregate(boxes(spark, sf_dir), dots(spark, sf_dir), "ST_Intersects", "box", "pt", {"n": ("count", "o")})
    return found.groupBy("k").agg(F.sum("n").alias("n"))


def _views(spark: SparkSession, sf_dir: str) -> None:
    boxes(spark, sf_dir).join(parts(spark, sf_dir), "k").createOrReplaceTempView("tf_boxes")
    dots(spark, sf_dir).createOrReplaceTempView("tf_dots")


def sql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL: an inner join by a predicate, an equal column, one-sided terms and a rest."""
    _views(spark, sf_dir)
    return spatial_sql(spark, "SELECT k, count(*) AS n, sum(o) AS total FROM tf_boxes b JOIN tf_dots d ON ST_Intersects(b.box, d.pt) AND b.k % 3 = d.o % 3 AND b.w > 5 AND d.o % 7 <> 1 AND b.k <> d.o GROUP BY k")


def sql_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL: every box with its orders, by calls as arguments and a one-sided term that keeps boxes from having any."""
    _views(spark, sf_dir)
    return spatial_sql(spark, "SELECT k, count(o) AS n, coalesce(min(o), -1) AS first FROM tf_boxes b LEFT JOIN tf_dots d ON ST_Covers(ST_Expand(b.box, 2), d.pt) AND b.w % 4 <> 0 AND d.o > b.k GROUP BY k")


def sql_where_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL: tables listed with commas, a distance in WHERE."""
    _views(spark, sf_dir)
    return spatial_sql(spark, "SELECT b.k, count(*) AS n FROM tf_boxes b, tf_dots d WHERE ST_Distance(ST_Point(b.x, b.y), d.pt) <= 7 AND d.o % 2 = 0 GROUP BY b.k")


def sql_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL: the boxes that no order's square meets, and those that some box of their own kind is disjoint from."""
    _views(spark, sf_dir)
    alone = "SELECT b.k, 'alone' AS what FROM tf_boxes b LEFT ANTI JOIN tf_dots d ON ST_Intersects(b.box, ST_Expand(d.pt, 1)) AND d.o % 50 = 0"
    apart = "SELECT b.k, 'apart' AS what FROM tf_boxes b LEFT SEMI JOIN tf_boxes c ON ST_Disjoint(b.box, c.box) AND b.x = c.x"
    return spatial_sql(spark, f"{alone} UNION ALL {apart}")


def sql_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL: DBSCAN as a window; boxes of a group whose left sides are at most 3 apart are one cluster."""
    _views(spark, sf_dir)
    return spatial_sql(spark, "SELECT k, c, min(k) OVER (PARTITION BY k % 7, c) AS first FROM (SELECT k, ST_ClusterDBSCAN(ST_Point(x, 0), 3, 1) OVER (PARTITION BY k % 7 ORDER BY k) AS c FROM tf_boxes)")


def sql_mixed_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL: spatial aggregates beside built-in ones, with HAVING."""
    _views(spark, sf_dir)
    return spatial_sql(spark, "SELECT g, n, total, e.xmin AS xmin, e.ymax AS ymax, m FROM (SELECT k % 10 AS g, count(*) AS n, sum(w) AS total, ST_Extent(box) AS e, ST_NumGeometries(ST_Collect(ST_Point(x, y))) AS m FROM tf_boxes GROUP BY k % 10 HAVING ST_XMin(ST_Extent(box)) < 500)")


def sql_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL: orders inside a constant triangle, with native measures of their structs."""
    _views(spark, sf_dir)
    text = "SELECT o, ST_X(pt) AS x, ST_Y(ST_Translate(pt, 1, 2)) AS y, ST_Area(ST_Expand(pt, 2)) AS a, round(ST_Distance(pt, ST_Point(3, 4)), 6) AS far, ST_BBoxIntersects(pt, ST_MakeEnvelope(0, 0, 300, 200)) AS low FROM tf_dots"
    return spatial_sql(spark, f"{text} WHERE ST_Within(pt, 'POLYGON((100 100,700 100,700 700,100 100))') AND ST_DWithin(pt, ST_GeomFromText('POINT(600 400)'), 250)")


IN_BOX = "p.x <= o.ox AND o.ox <= p.x + p.w AND p.y <= o.oy AND o.oy <= p.y + p.w"
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "st_dump": (st_dump, f"WITH b AS ({BASE}) SELECT k, unnest([{POINT}, {w('POINT({x+w} {y})')}, {MIDDLE}, {w('POINT({x} {y+w})')}]) AS r FROM b"),
    "st_extent": (st_extent, f"WITH b AS ({BASE}) SELECT k % 10 AS g, CAST(min(x) AS DOUBLE) AS xmin, CAST(min(y) AS DOUBLE) AS ymin, CAST(max(x + w) AS DOUBLE) AS xmax, CAST(max(y + w) AS DOUBLE) AS ymax, count(*) AS n FROM b GROUP BY 1"),
    "st_collect": (st_collect, f"WITH b AS ({BASE}) SELECT k % 10 AS g, CAST(count(*) AS INTEGER) AS n, CAST(sum(w * w) AS DOUBLE) AS area FROM b GROUP BY 1"),
    "st_memunion": (st_mem_union, "WITH b AS (SELECT DISTINCT p_partkey % 20 AS g, 5 * (p_partkey % 50) AS s FROM part), c AS (SELECT g, s, lag(s) OVER (PARTITION BY g ORDER BY s) AS before FROM b) SELECT g, CAST(sum(10 * CASE WHEN before IS NULL OR s - before > 10 THEN 10 ELSE s - before END) AS DOUBLE) AS area FROM c GROUP BY g"),
    "st_clusterkmeans": (st_cluster_kmeans, "SELECT p_partkey AS k, min(p_partkey) OVER (PARTITION BY p_partkey % 3) AS first FROM part"),
    "st_clusterkmeans_spread": (st_cluster_kmeans_spread, "SELECT p_partkey AS k, min(p_partkey) OVER (PARTITION BY p_partkey % 3) AS first FROM part"),
    "st_memunion_tiles": (st_mem_union_tiles, f"WITH b AS ({BASE}), t AS (SELECT DISTINCT x - x % 7 AS x, y - y % 7 AS y FROM b) SELECT CAST(49 * count(*) AS DOUBLE) AS area, CAST(min(x) AS DOUBLE) AS xmin, CAST(max(y) + 7 AS DOUBLE) AS ymax FROM t"),
    "st_clusterdbscan": (st_cluster_dbscan, "SELECT p_partkey AS k, min(p_partkey) OVER (PARTITION BY p_partkey % 10) AS first FROM part"),
    "spatial_join_intersects": (join_contains, f"WITH p AS ({BASE}), o AS ({DOT}) SELECT k, count(*) AS n, CAST(sum(o) AS BIGINT) AS total FROM p JOIN o ON {IN_BOX} GROUP BY k"),
    "spatial_join_dwithin": (join_dwithin, f"WITH p AS ({BASE}), o AS ({DOT}) SELECT k, count(*) AS n FROM p JOIN o ON (x - ox) * (x - ox) + (y - oy) * (y - oy) <= 25 GROUP BY k"),
    "spatial_join_bboxintersects": (join_boxes, f"WITH p AS ({BASE}) SELECT a.k, b.k AS k2 FROM p a JOIN p b ON a.k < b.k AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.w AND b.y <= a.y + a.w"),
    "spatial_join_covers": (join_exact, f"WITH p AS ({BASE}), o AS ({DOT}) SELECT k, count(*) AS n FROM p JOIN o ON {IN_BOX} AND oy - y <= ox - x GROUP BY k"),
    "spatial_sql_join": (sql_join, f"WITH p AS ({BASE}), o AS ({DOT}) SELECT k, count(*) AS n, CAST(sum(o) AS BIGINT) AS total FROM p JOIN o ON {IN_BOX} AND k % 3 = o % 3 AND w > 5 AND o % 7 <> 1 AND k <> o GROUP BY k"),
    "spatial_sql_left_join": (sql_left_join, f"WITH p AS ({BASE}), o AS ({DOT}), m AS (SELECT k, count(*) AS n, min(o) AS first FROM p JOIN o ON x - 2 <= ox AND ox <= x + w + 2 AND y - 2 <= oy AND oy <= y + w + 2 AND w % 4 <> 0 AND o > k GROUP BY k) SELECT k, coalesce(n, 0) AS n, coalesce(first, -1) AS first FROM p LEFT JOIN m USING (k)"),
    "spatial_sql_where_join": (sql_where_join, f"WITH p AS ({BASE}), o AS ({DOT}) SELECT k, count(*) AS n FROM p, o WHERE (x - ox) * (x - ox) + (y - oy) * (y - oy) <= 49 AND o % 2 = 0 GROUP BY k"),
    "spatial_sql_anti_join": (sql_anti_join, f"WITH p AS ({BASE}), o AS ({DOT}) SELECT k, 'alone' AS what FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o % 50 = 0 AND p.x <= ox + 1 AND ox - 1 <= p.x + p.w AND p.y <= oy + 1 AND oy - 1 <= p.y + p.w) UNION ALL SELECT k, 'apart' AS what FROM p WHERE EXISTS (SELECT 1 FROM p c WHERE c.x = p.x AND (c.y > p.y + p.w OR p.y > c.y + c.w))"),
    "spatial_sql_within": (sql_within, f"WITH o AS ({DOT}) SELECT o, CAST(ox AS DOUBLE) AS x, CAST(oy + 2 AS DOUBLE) AS y, CAST(16 AS DOUBLE) AS a, round(sqrt(CAST((ox - 3) * (ox - 3) + (oy - 4) * (oy - 4) AS DOUBLE)), 6) AS far, ox <= 300 AND oy <= 200 AS low FROM o WHERE ox < 700 AND oy > 100 AND oy < ox AND (ox - 600) * (ox - 600) + (oy - 400) * (oy - 400) <= 62500"),
    "spatial_sql_clusters": (sql_clusters, f"WITH b AS ({BASE}), s AS (SELECT k, k % 7 AS g, x, CASE WHEN x - lag(x) OVER (PARTITION BY k % 7 ORDER BY x) <= 3 THEN 0 ELSE 1 END AS apart FROM b), i AS (SELECT k, g, sum(apart) OVER (PARTITION BY g ORDER BY x) AS island FROM s), f AS (SELECT k, g, min(k) OVER (PARTITION BY g, island) AS first FROM i) SELECT k, CAST(dense_rank() OVER (PARTITION BY g ORDER BY first) - 1 AS INTEGER) AS c, first FROM f"),
    "spatial_sql_mixed_aggregates": (sql_mixed_aggregates, f"WITH b AS ({BASE}) SELECT k % 10 AS g, count(*) AS n, CAST(sum(w) AS BIGINT) AS total, CAST(min(x) AS DOUBLE) AS xmin, CAST(max(y + w) AS DOUBLE) AS ymax, CAST(count(*) AS INTEGER) AS m FROM b GROUP BY 1 HAVING min(x) < 500"),
    "spatial_join_left": (join_left, f"WITH p AS ({BASE}), o AS ({DOT}) SELECT k, count(o) AS n FROM p LEFT JOIN o ON {IN_BOX} GROUP BY k"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _case(e) for name, e, _ in CASES} | {name: q for name, (q, _) in OTHERS.items()}
ORACLES: dict[str, str] = {name: f"WITH b AS ({BASE}) SELECT k, {sql} AS r FROM b" for name, _, sql in CASES if sql} | {name: sql for name, (_, sql) in OTHERS.items() if sql}

__all__ = ["ORACLES", "QUERIES", "call"]
