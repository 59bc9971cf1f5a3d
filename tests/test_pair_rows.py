"""Pairs of geometries as pairs of rows: the larger side is joined last."""

from plotproof.plans.findings import of_rows


def test_pairs_of_rows_are_made_by_the_last_join(spark):
    pairs = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "l_gkey string, r_gkey string, distance double")
    parcels = spark.createDataFrame([(f"{k}{i}", k) for k in "abc" for i in range(4)], "talhao_id string, l_gkey string")
    rows = spark.createDataFrame([("T1", "x"), ("T2", "x"), ("T3", "y")], "num_tad string, r_gkey string")
    found = of_rows(pairs, parcels, rows)
    got = sorted((r["talhao_id"], r["num_tad"], r["distance"]) for r in found.collect())
    near = [("a", "T1", 1.0), ("a", "T2", 1.0), ("a", "T3", 2.0), ("b", "T1", 3.0), ("b", "T2", 3.0)]
    assert got == sorted((f"{k}{i}", t, x) for k, t, x in near for i in range(4))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_gkey" in next(line for line in plan.splitlines() if "Join Inner" in line)
