"""Points, lines, rectangles, polygons and places on the globe. Points are structs or pairs of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the globe in metres.
RADIUS = 6_378_100.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between two places in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.asin(F.least(F.sqrt(a), F.lit(1.0))) * (2 * RADIUS)


def parse_gps(c: Column) -> Column:
    """'47.6°, -122.3°' -> struct(lat, lon)."""
    g = lambda i: F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)\s*°?\s*,\s*(-?\d+(?:\.\d+)?)\s*°?\s*$", i).try_cast("double")
    return F.struct(g(1).alias("lat"), g(2).alias("lon"))


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as a signed decimal; S and W are negative."""
    return (degrees + minutes / 60 + seconds / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(distance, x, y): distance to a segment and the nearest point on it."""
    n = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.coalesce(F.least(F.greatest(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(n, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    return F.struct(distance(px, py, x, y).alias("distance"), x.alias("x"), y.alias("y"))


def along(d: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(x, y) at distance d from the first point towards the second."""
    n = F.nullif(distance(ax, ay, bx, by), F.lit(0.0))
    return F.struct((ax + (bx - ax) * d / n).alias("x"), (ay + (by - ay) * d / n).alias("y"))


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def rect_area(r: Column, border: int = 0) -> Column:
    """Width by height, `border` added to both; 0 for an inside-out rectangle."""
    w, h = r["x1"] - r["x0"] + border, r["y1"] - r["y0"] + border
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise((w * h).cast("double"))


def rect_centre(r: Column) -> Column:
    return F.struct(((r["x0"] + r["x1"]) / 2).alias("x"), ((r["y0"] + r["y1"]) / 2).alias("y"))


def rect_intersection(a: Column, b: Column) -> Column:
    """The common rectangle, or null."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    x1, y1 = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), rect(x0, y0, x1, y1))


def rect_overlap(a: Column, b: Column, by: str = "min") -> Column:
    """Area of the intersection over the smaller (or larger) area."""
    pick = F.least if by == "min" else F.greatest
    common = F.coalesce(rect_area(rect_intersection(a, b)), F.lit(0.0))
    return common / F.nullif(pick(rect_area(a), rect_area(b)), F.lit(0.0))


def rect_scaled(r: Column, fx: float, fy: float) -> Column:
    c = rect_centre(r)
    w, h = (r["x1"] - r["x0"]) / 2 * fx, (r["y1"] - r["y0"]) / 2 * fy
    return rect(c["x"] - w, c["y"] - h, c["x"] + w, c["y"] + h)


def rect_at(x: Column, y: Column, w: Column, h: Column) -> Column:
    return rect(x - w / 2, y - h / 2, x + w / 2, y + h / 2)


def triangle(a: Column, b: Column, c: Column) -> Column:
    """struct(area, angles) from side lengths: Heron's formula and the law of cosines, angles opposite a, b, c."""
    s = (a + b + c) / 2
    area = F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))
    angle = lambda x, y, z: F.acos(F.least(F.greatest((y * y + z * z - x * x) / (2 * y * z), F.lit(-1.0)), F.lit(1.0)))
    return F.struct(area.alias("area"), F.array(angle(a, b, c), angle(b, a, c), angle(c, a, b)).alias("angles"))


def polygon_area(poly: Column) -> Column:
    """Signed shoelace area of an array of struct(x, y)."""
    n = F.size(poly)
    nxt = F.transform(poly, lambda _, i: F.get(poly, F.pmod(i + 1, n)))
    terms = F.zip_with(poly, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Ray casting: an odd number of edges lies to the right."""
    n = F.size(poly)
    nxt = F.transform(poly, lambda _, i: F.get(poly, F.pmod(i + 1, n)))
    crosses = F.zip_with(poly, nxt, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.pmod(F.size(F.filter(crosses, lambda c: c)), F.lit(2)) == 1


def polygon_distance(x: Column, y: Column, poly: Column) -> Column:
    """struct(distance, x, y) to the nearest point of the polygon; 0 and the point itself inside."""
    n = F.size(poly)
    nxt = F.transform(poly, lambda _, i: F.get(poly, F.pmod(i + 1, n)))
    near = F.array_min(F.zip_with(poly, nxt, lambda p, q: point_segment(x, y, p["x"], p["y"], q["x"], q["y"])))
    return F.when(in_polygon(x, y, poly), F.struct(F.lit(0.0).alias("distance"), x.alias("x"), y.alias("y"))).otherwise(near)


def gps_box(lat: Column, lon: Column, metres: float) -> Column:
    """struct(lat0, lon0, lat1, lon1) reaching `metres` each way."""
    dlat = math.degrees(metres / RADIUS)
    dlon = F.lit(dlat) / F.cos(F.radians(lat))
    return F.struct((lat - dlat).alias("lat0"), (lon - dlon).alias("lon0"), (lat + dlat).alias("lat1"), (lon + dlon).alias("lon1"))


def projected(lat: Column, lon: Column, box: Column, width: int, height: int) -> Column:
    """struct(x, y) of a place on an image of a box, north at the top."""
    x = (lon - box["lon0"]) / (box["lon1"] - box["lon0"]) * width
    y = (box["lat1"] - lat) / (box["lat1"] - box["lat0"]) * height
    return F.struct(x.alias("x"), y.alias("y"))


def located(lat: Column, lon: Column, obj_lat: Column, obj_lon: Column, radius: Column, near: float) -> Column:
    """struct(kind, score): 'in' with score 1 within an object's radius, 'near' with the squared share of the way left
    to `near` metres beyond it, else null."""
    beyond = haversine(lat, lon, obj_lat, obj_lon) - radius
    share = 1 - beyond / near
    return F.when(beyond <= 0, F.struct(F.lit("in").alias("kind"), F.lit(1.0).alias("score"))).when(beyond < near, F.struct(F.lit("near").alias("kind"), (share * share).alias("score")))
