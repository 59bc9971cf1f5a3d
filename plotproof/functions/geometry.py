"""Geometry columns: WKT in and out, projection, area, bounds.

A geometry is ``array<array<array<struct<x,y>>>>``: polygons, rings, points.
A point is one polygon with one ring of one vertex.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHAPE = r"(?i)^(POINT|POLYGON|MULTIPOLYGON)\(.*\)$"
_NUMBER_PAIR = r"(-?\d+\.?\d*)\s+(-?\d+\.?\d*)"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_wkt(c: Column) -> Column:
    """POINT, POLYGON or MULTIPOLYGON; anything unreadable is null."""
    tight = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), " ?([(),]) ?", "$1")

    def vertex(pair: Column) -> Column:
        return bind(
            F.split(pair, " "),
            lambda xy: F.struct(
                F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y")
            ),
        )

    def polygons(text: Column) -> Column:
        body = F.regexp_replace(text, r"^[^(]*\(+|\)+$", "")
        return F.transform(
            F.split(body, r"\)\),\(\("),
            lambda p: F.transform(F.split(p, r"\),\("), lambda r: F.transform(F.split(r, ","), vertex)),
        )

    def checked(g: Column, text: Column) -> Column:
        rings = F.flatten(g)
        readable = F.forall(rings, lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
        closed = F.forall(rings, lambda r: F.size(r) >= 4)
        single = (F.size(rings) == 1) & F.forall(rings, lambda r: F.size(r) == 1)
        return F.when(readable & F.when(F.upper(text).startswith("POINT"), single).otherwise(closed), g)

    def shaped(text: Column) -> Column:
        known = F.when(text.rlike(_SHAPE), text)
        return F.when(known.isNotNull(), bind(polygons(text), lambda g: checked(g, text)))

    return bind(tight, shaped)


def to_wkt(g: Column) -> Column:
    """Canonical text: shortest round-trip numbers, one space, comma and space."""

    def ring(r: Column) -> Column:
        text = F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
        return F.concat(F.lit("("), F.array_join(text, ", "), F.lit(")"))

    def polygon(p: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))

    one = polygon(F.get(g, F.lit(0)))
    many = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(g, polygon), ", "), F.lit(")"))
    bare_point = F.concat(F.lit("POINT "), ring(F.get(F.get(g, F.lit(0)), F.lit(0))))
    return (
        F.when(vertex_count(g) == 1, bare_point)
        .when(F.size(g) == 1, F.concat(F.lit("POLYGON "), one))
        .when(F.size(g) > 1, many)
    )


def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g))


def vertex_count(g: Column) -> Column:
    return F.size(vertices(g))


def map_vertices(g: Column, fn) -> Column:
    """Apply ``fn(x, y) -> struct<x, y>`` to every vertex."""

    def move(p: Column) -> Column:
        return fn(p["x"], p["y"])

    return F.transform(g, lambda poly: F.transform(poly, lambda r: F.transform(r, move)))


# ---- projections ---------------------------------------------------------
# GRS80 ellipsoid and UTM zone 22 south (central meridian -51).
_A, _F = 6378137.0, 1 / 298.257222101
_LON0, _K0, _FE, _FN = -51.0, 0.9996, 500000.0, 10000000.0


def _series() -> tuple[float, list[float]]:
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # Kruger's transverse Mercator coefficients in powers of the third flattening.
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880,
        49561 * n**4 / 161280 - 179 * n**5 / 168,
        34729 * n**5 / 80640,
    ]
    return radius, alpha


def utm22s(lon: Column, lat: Column) -> Column:
    """Degrees to metres (EPSG:31982) by the Kruger series, built-in functions only."""
    radius, alpha = _series()
    ecc = math.sqrt(_F * (2 - _F))

    def series(a: Column) -> Column:
        east, north = a["eta"], a["xi"]
        for j, k in enumerate(alpha, start=1):
            east = east + F.cos(a["xi"] * (2 * j)) * F.sinh(a["eta"] * (2 * j)) * k
            north = north + F.sin(a["xi"] * (2 * j)) * F.cosh(a["eta"] * (2 * j)) * k
        return F.struct((east * (_K0 * radius) + _FE).alias("x"), (north * (_K0 * radius) + _FN).alias("y"))

    def angles(v: Column) -> Column:
        xi = F.atan2(v["t"], v["c"])
        eta = F.asinh(v["s"] / F.sqrt(v["t"] * v["t"] + v["c"] * v["c"]))
        return bind(F.struct(xi.alias("xi"), eta.alias("eta")), series)

    sin_lat, dlon = F.sin(F.radians(lat)), F.radians(lon - _LON0)
    conformal = bind(sin_lat, lambda s: F.sinh(F.atanh(s) - F.atanh(s * ecc) * ecc))
    return bind(F.struct(conformal.alias("t"), F.sin(dlon).alias("s"), F.cos(dlon).alias("c")), angles)


def plane(metres_per_degree: float = 111320.0):
    """Equal scale on both axes: boxes stay boxes, so plain SQL can check results."""

    def project(x: Column, y: Column) -> Column:
        return F.struct((x * metres_per_degree).alias("x"), (y * metres_per_degree).alias("y"))

    return project


PROJECTIONS = {"utm22s": utm22s, "plane": plane()}


# ---- measures ------------------------------------------------------------
def ring_area(r: Column) -> Column:
    """Signed shoelace area, relative to the first vertex for precision."""
    x0, y0 = r[0]["x"], r[0]["y"]
    steps = F.zip_with(
        F.slice(r, 1, F.size(r) - 1),
        F.slice(r, 2, F.size(r) - 1),
        lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0),
    )
    return F.when(F.size(r) >= 4, F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / 2).otherwise(F.lit(0.0))


def area(g: Column) -> Column:
    """Sum over polygons of shell area minus hole areas."""

    def polygon(p: Column) -> Column:
        rings = F.transform(p, lambda r: F.abs(ring_area(r)))
        total = F.aggregate(rings, F.lit(0.0), lambda s, v: s + v)
        return rings[0] * 2 - total

    return F.aggregate(F.transform(g, polygon), F.lit(0.0), lambda s, v: s + v)


def bounds(g: Column) -> dict[str, Column]:
    xs = F.transform(vertices(g), lambda p: p["x"])
    ys = F.transform(vertices(g), lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def centroid(g: Column) -> Column:
    """Area centroid of the shells; mean vertex where there is no area."""

    def moment(r: Column) -> Column:
        x0, y0 = r[0]["x"], r[0]["y"]

        def term(p: Column, q: Column) -> Column:
            cross = (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)
            return F.struct(
                cross.alias("a"),
                (cross * (p["x"] + q["x"] - x0 * 2)).alias("mx"),
                (cross * (p["y"] + q["y"] - y0 * 2)).alias("my"),
            )

        terms = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), term)
        total = F.aggregate(
            terms,
            F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")),
            lambda s, v: F.struct(
                (s["a"] + v["a"]).alias("a"), (s["mx"] + v["mx"]).alias("mx"), (s["my"] + v["my"]).alias("my")
            ),
        )
        return F.struct(
            F.abs(total["a"]).alias("w"),
            (x0 + total["mx"] / (total["a"] * 3)).alias("x"),
            (y0 + total["my"] / (total["a"] * 3)).alias("y"),
        )

    shells = F.transform(g, lambda p: p[0])
    solid = F.filter(shells, lambda r: F.abs(ring_area(r)) > 0)
    parts = F.transform(solid, moment)
    weight = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v["w"])
    pts = vertices(g)
    mean_x = F.aggregate(pts, F.lit(0.0), lambda s, p: s + p["x"]) / F.size(pts)
    mean_y = F.aggregate(pts, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(pts)
    cx = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v["x"] * v["w"])
    cy = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v["y"] * v["w"])
    return F.struct(
        F.when(F.size(parts) > 0, F.try_divide(cx, weight)).otherwise(mean_x).alias("x"),
        F.when(F.size(parts) > 0, F.try_divide(cy, weight)).otherwise(mean_y).alias("y"),
    )


def circle(lon: Column, lat: Column, radius: Column, segments: int = 64) -> Column:
    """Regular polygon around a point, clockwise from the east, closed."""
    corner = F.transform(
        F.sequence(F.lit(0), F.lit(segments)),
        lambda i: F.struct(
            (lon + radius * F.cos((i % segments) * (-2 * math.pi / segments))).alias("x"),
            (lat + radius * F.sin((i % segments) * (-2 * math.pi / segments))).alias("y"),
        ),
    )
    return F.array(F.array(corner))


# ---- text-level functions ------------------------------------------------
def vertex_mean(wkt: Column) -> Column:
    """Mean of the written vertices (the closing one counts) and their number."""
    text = F.coalesce(wkt, F.lit(""))
    xs = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER_PAIR), 1), lambda v: v.cast("double"))
    ys = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER_PAIR), 2), lambda v: v.cast("double"))
    n = F.size(xs)

    def mean(v: Column) -> Column:
        return F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, e: s + e), n)

    return F.struct(mean(ys).alias("lat"), mean(xs).alias("lon"), n.alias("vertices"))


def min_decimals(wkt: Column) -> Column:
    """Fewest decimal places among the numbers of a WKT; null without numbers."""
    numbers = F.regexp_extract_all(wkt, F.lit(r"-?\d+(?:\.\d+)?"), 0)
    places = F.transform(
        numbers, lambda v: F.when(v.contains("."), F.length(F.substring_index(v, ".", -1))).otherwise(0)
    )
    return F.array_min(places)


def fingerprint(layer: Column, label: Column, wkt: Column) -> Column:
    """Stable key of a layer polygon; a redrawn polygon is a new one."""
    return F.substring(F.sha2(F.concat_ws("|", layer, label, wkt), 256), 1, 20)


def prepare(df: DataFrame, wkt: str = "geom_wkt", crs: str = "utm22s") -> DataFrame:
    """Add what the spatial join reads: flat projected coordinates ``xs``/``ys``, signed
    ring sizes (negative for holes), bounds and ``is_box``; all null for unreadable text."""
    df = df.withColumn("_g", map_vertices(parse_wkt(F.col(wkt)), PROJECTIONS[crs]))
    signed = lambda p: F.transform(p, lambda r, i: F.when(i == 0, F.size(r)).otherwise(-F.size(r)))
    df = df.withColumn("_p", vertices(F.col("_g"))).withColumns(
        {
            "xs": F.transform("_p", lambda p: p["x"]),
            "ys": F.transform("_p", lambda p: p["y"]),
            "sizes": F.flatten(F.transform("_g", signed)),
        }
    )
    df = df.drop("_g", "_p").withColumns(
        {"xmin": F.array_min("xs"), "ymin": F.array_min("ys"), "xmax": F.array_max("xs"), "ymax": F.array_max("ys")}
    )
    on_edge = F.forall("xs", lambda x: x.isin(F.col("xmin"), F.col("xmax"))) & F.forall(
        "ys", lambda y: y.isin(F.col("ymin"), F.col("ymax"))
    )
    step = lambda c: F.zip_with(F.slice(c, 1, 4), F.slice(c, 2, 4), lambda a, b: a == b)
    sides = F.forall(F.zip_with(step("xs"), step("ys"), lambda a, b: a != b), lambda ok: ok)
    n = F.size("xs")
    box = F.when(n == 1, True).when((n == 5) & on_edge, sides).otherwise(False)
    return df.withColumn("is_box", F.when(F.col("xs").isNotNull(), box))
