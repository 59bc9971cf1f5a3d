"""Spatial join on pieces against whole-polygon measures and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotproof.functions import predicates as P
from plotproof.operators import spatial as S

M = 111320.0  # metres of a degree in the equal-scale plane


def wkt(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings) + ")"


def star(rng, cx, cy, r, n):
    """Simple ring around a centre, counter-clockwise, closed."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + r * rng.uniform(0.4, 1) * math.cos(t), cy + r * rng.uniform(0.4, 1) * math.sin(t)) for t in turns]
    return ring + ring[:1]


def square(cx, cy, h):
    return [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h), (cx - h, cy - h)]


def frame(spark, shapes):
    return S.distinct_geometries(spark.createDataFrame([(i, w) for i, w in shapes.items()], "id string, geom_wkt string"), crs="plane", extra=[F.min("id").alias("id")])


def flat(rings):
    pts = [p for r in rings for p in r]
    return [x * M for x, _ in pts], [y * M for _, y in pts], [len(r) if k == 0 else -len(r) for k, r in enumerate(rings)]


@pytest.mark.parametrize("crowded,cell,shortcut", [(4096, 250.0, True), (40, 700.0, False), (12, 90.0, True)])
def test_pieces_give_the_measures_of_whole_polygons(spark, monkeypatch, crowded, cell, shortcut):
    monkeypatch.setattr(S, "CROWDED", crowded)
    rng = random.Random(crowded)
    left, right = {}, {}
    for side, n, big in ((left, 40, 0.03), (right, 30, 0.05)):
        for i in range(n):
            cx, cy, r = rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1), rng.uniform(0.002, big)
            kind = rng.choice(["star", "square", "hole", "twisted"])
            if kind == "star":
                side[f"{i}"] = [star(rng, cx, cy, r, rng.randint(3, 40))]
            elif kind == "square":
                side[f"{i}"] = [square(cx, cy, r / 3)]
            elif kind == "hole":
                side[f"{i}"] = [square(cx, cy, r), star(rng, cx, cy, r / 2, 7)]
            else:  # a ring that crosses itself
                pts = [(cx + rng.uniform(-r, r), cy + rng.uniform(-r, r)) for _ in range(5)]
                side[f"{i}"] = [pts + pts[:1]]
    reach = 800.0
    pairs = S.spatial_pairs(frame(spark, {i: wkt(r) for i, r in left.items()}), frame(spark, {i: wkt(r) for i, r in right.items()}), reach, cell, shortcut)
    got = {(r["l_id"], r["r_id"]): r for r in pairs.collect()}
    want = {}
    for i, a in left.items():
        for j, b in right.items():
            hit, area, apart = P.measure(*flat(a), *flat(b))
            if hit or apart <= reach:
                want[i, j] = (hit, area, apart)
    assert got.keys() == want.keys() and len(want) > 20
    for key, (hit, area, apart) in want.items():
        r = got[key]
        assert r["intersects"] == hit, key
        assert r["area"] == pytest.approx(area, rel=1e-7, abs=1e-3), key
        assert r["distance"] == pytest.approx(apart, rel=1e-9, abs=1e-6), key


def test_many_vertices_meet_many_parcels_in_small_pieces(spark):
    """A ring of 20,000 vertices against 10,000 parcels that tile the plane: their common areas add up to its own."""
    n, r = 20_000, 0.09
    ring = [(r * math.cos(2 * math.pi * k / n) * (1 + 0.2 * math.sin(2 * math.pi * k * 50 / n)), r * math.sin(2 * math.pi * k / n) * (1 + 0.2 * math.sin(2 * math.pi * k * 50 / n))) for k in range(n)]
    ring.append(ring[0])
    side = 0.0022
    tiles = {f"{i}/{j}": wkt([square((i - 49.5) * side, (j - 49.5) * side, side / 2)]) for i in range(100) for j in range(100)}
    left, right = frame(spark, tiles), frame(spark, {"anel": wkt([ring])})
    pairs = S.spatial_pairs(left, right)
    total = pairs.agg(F.sum("area"), F.max("area"), F.count("*")).first()
    x, y = (np.array([p[k] for p in ring]) * M for k in (0, 1))
    own = abs(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) / 2
    assert total[0] == pytest.approx(own, rel=1e-8) and total[1] <= (side * M) ** 2 * (1 + 1e-9) and 5000 < total[2] < 10_000
    met = S.candidates(left, right.withColumn("reach", F.lit(0.0)), 250.0)
    pieces = S._cut(right, met.select(F.col("r_gkey").alias("gkey"), "level", "cx", "cy").distinct(), 250.0)
    sizes = [len(p["rx"]) for p in pieces.select("rx").collect()]
    assert max(sizes) < 2 * S.CROWDED and len(sizes) > 8


def test_candidates_carry_no_coordinates_and_a_large_polygon_makes_no_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWDED", 200)
    rng = random.Random(1)
    parcels = {str(i): wkt([square(rng.uniform(-2, 2), rng.uniform(-2, 2), 0.001)]) for i in range(3000)}
    left, right = frame(spark, parcels), frame(spark, {"estado": wkt([square(0, 0, 3.0)])})
    met = S.candidates(left, right.withColumn("reach", F.lit(0.0)), 250.0)
    assert not any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in met.schema)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "xs#" not in plan and "ys#" not in plan
    per_cell = [r["count"] for r in met.groupBy("level", "cx", "cy").count().collect()]
    assert max(per_cell) <= 200 and sum(per_cell) >= 3000
    assert S.spatial_pairs(left, right).where("intersects").count() == 3000


def test_touching_points_copies_and_empty_sides(spark):
    shapes = {"a": wkt([square(0, 0, 0.01)]), "b": wkt([square(0.02, 0, 0.01)]), "p": "POINT (0.01 0.0)", "q": "POINT (5.0 5.0)", "x": "lixo"}
    left = frame(spark, shapes)
    for shortcut in (True, False):
        got = {(r["l_id"], r["r_id"]): (r["intersects"], round(r["area"])) for r in S.spatial_pairs(left, left, 0.0, 250.0, shortcut).collect()}
        one = round((0.02 * M) ** 2)
        assert got == {
            ("a", "a"): (True, one), ("b", "b"): (True, one), ("a", "b"): (True, 0), ("b", "a"): (True, 0), ("p", "p"): (True, 0), ("q", "q"): (True, 0),
            ("a", "p"): (True, 0), ("p", "a"): (True, 0), ("b", "p"): (True, 0), ("p", "b"): (True, 0),
        }
        assert S.spatial_pairs(left, left.limit(0), 10.0, 250.0, shortcut).count() == 0


def test_clipping_keeps_areas(spark):
    rng = random.Random(3)
    for _ in range(60):
        ring = np.array(star(rng, 0, 0, 1, rng.randint(3, 30)))
        cells = np.array([[x / 4, y / 4, (x + 1) / 4, (y + 1) / 4] for x in range(-4, 4) for y in range(-4, 4)])
        area = lambda r: np.sum(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]) / 2
        parts = [sum(area(r) for r in rings) for _, rings, _ in P.cut([ring], P._own_edges([ring]), cells, 0.0)]
        assert sum(parts) == pytest.approx(area(ring), rel=1e-9)
