from pyspark.sql import functions as F

from plotproof.operators import relational as R
from plotproof.plans import dossier as O


def test_counts_go_to_lots_packed_and_are_those_of_the_annexes(spark):
    rows = [("d1", "p1", "ccir", "ok"), ("d2", "p1", "ccir", "ok"), ("d3", "p1", None, None), ("d4", "p2", "ccir", "ok"), ("d5", "p2", "itr", None), ("d6", "p9", "itr", "ok")]
    docs = spark.createDataFrame(rows, "id string, produtor_id string, tipo string, status string").withColumns({"arquivo_origem": F.col("id"), "hash_sha256": F.col("id")})
    links = spark.createDataFrame([("l1", "p1"), ("l1", "p2"), ("l2", "p2"), ("l3", "p3")], "lote_id string, produtor_id string")
    want = O.annexes(links, docs).groupBy("lote_id", "ordem_tipo", "status").agg(F.count("*").alias("n"))
    got = O.annex_counts(links, docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 5


def test_links_are_shuffled_once_for_their_producers(spark):
    frame = lambda n, c: spark.range(n).selectExpr(*c)
    parcels = frame(50, ["cast(id as string) id", "cast(id % 7 as string) produtor_id"])
    bridge = frame(200, ["cast(id % 50 as string) talhao_id", "cast(id % 9 as string) lote_id"])
    links = R.producers_of_lots(parcels, bridge)
    assert "hashpartitioning(lote_id" not in links._jdf.queryExecution().executedPlan().toString()
    assert links.count() == bridge.join(parcels, F.col("id") == F.col("talhao_id")).select("lote_id", "produtor_id").distinct().count()
