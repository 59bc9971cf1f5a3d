"""Joins among named pairs: only these meet and are measured; rectangles and convex rings are cut, not swept."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from test_spatial import frame, square, wkt

from plotproof.functions import predicates as P
from plotproof.operators import spatial as S


def ring(n, x, y, r, turn=0.0):
    pts = [(x + r * math.cos(2 * math.pi * k / n + turn), y + r * math.sin(2 * math.pi * k / n + turn)) for k in range(n)]
    return [*pts, pts[0]]


def text(points):
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in points) + "))"


def test_named_pairs_are_those_of_the_whole_join(spark):
    rng = random.Random(3)
    at = [(rng.uniform(0, 0.01), rng.uniform(0, 0.01)) for _ in range(40)]
    left = frame(spark, {f"c{i}": text(ring(16, x, y, 0.003)) for i, (x, y) in enumerate(at)})
    right = frame(spark, {f"f{i}": text(square(x, y, 0.002)) for i, (x, y) in enumerate(at)})
    names = [(f"c{i}", f"f{i}") for i in range(40)] + [("c0", "f1"), ("c1", "f0"), ("c2", "f9")]
    key = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.col("gkey").alias(f"{side}_gkey"))
    asked = spark.createDataFrame(names, "l_id string, r_id string").join(key(left, "l"), "l_id").join(key(right, "r"), "r_id").select("l_gkey", "r_gkey")
    rows = lambda df: sorted((r["l_id"], r["r_id"], r["intersects"], round(r["area"], 6), round(r["distance"], 6)) for r in df.collect())
    whole = S.spatial_pairs(left, right)
    want = rows(whole.join(asked, ["l_gkey", "r_gkey"], "left_semi"))
    assert 40 <= len(want) < whole.count() and rows(S.spatial_pairs(left, right, among=asked)) == want
    assert S.candidates(left, right.withColumn("reach", F.lit(0.0)), 250.0, asked).where("primeira").count() <= asked.count()


def test_cutting_a_convex_ring_gives_the_area_of_the_sweep(monkeypatch):
    rng, swept = random.Random(5), []
    shapes = [np.array(ring(64, 0, 0, 1.0)), np.array(ring(5, 0.2, 0.1, 1.2, 0.3)), np.array([(0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2), (0, 0)], float)]
    pairs = [(s, np.array(square(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.1, 2)))) for s in shapes for _ in range(20)]
    flat = lambda r: (r[:, 0], r[:, 1], [len(r)])
    fast = [P.measure(*flat(a), *flat(b)) for a, b in pairs]
    monkeypatch.setattr(P, "_area_in_box", lambda a, b: swept.append(1))
    slow = [P.measure(*flat(a), *flat(b)) for a, b in pairs]
    assert all(x[0] == y[0] and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1e-12) and x[2] == y[2] for x, y in zip(fast, slow, strict=True)) and swept
    assert P._is_convex(shapes[0]) and not P._is_convex(shapes[2]) and P._box_of(np.array(square(0, 0, 1.0))) and not P._box_of(shapes[1])
