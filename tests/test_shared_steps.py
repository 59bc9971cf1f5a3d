"""Steps that several queries share: how often rows are shuffled, and what is left out of a job that does not read it."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plotproof.plans import checks as C
from plotproof.plans import dossier as O
from plotproof.plans.facts import count_earlier, parcel_facts
from plotproof.queries import load
from plotproof.queries.adapters import Domain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def domain(spark):
    load()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Domain(spark, FOLDER)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_out_once_for_the_documents(domain):
    shuffles = [x for x in plan(domain.documento).splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in shuffles if "hashpartitioning(l_" in x]) == 1
    assert len(shuffles) == 6  # lines, owners by customer and by parcel, customers, and nations with theirs
    by_parcel = domain.lote_talhao.join(domain.talhao.select(F.col("id").alias("talhao_id"), "produtor_id"), "talhao_id")
    assert len([x for x in plan(by_parcel).splitlines() if "Exchange hashpartitioning" in x]) == 2


def test_duplicates_are_dealt_out_by_content_once(domain, spark):
    df = load().QUERIES["duplicate_content"](spark, FOLDER)
    df.collect()
    final = plan(df)
    assert final.count("ReusedExchange") > 0


def test_annexes_are_counted_per_producer_first(domain):
    links = domain.lote_talhao.join(domain.talhao.select(F.col("id").alias("talhao_id"), "produtor_id"), "talhao_id").select("lote_id", "produtor_id").distinct()
    docs = domain.documento.withColumn("tipo", F.when(F.col("tipo") != "ccir", F.col("tipo")))
    rows = Counter((r["lote_id"], r["ordem_tipo"], r["status"]) for r in O.annexes(links, docs).collect())
    assert {(r["lote_id"], r["ordem_tipo"], r["status"]): r["n"] for r in O.annex_counts(links, docs).collect()} == rows


def test_the_first_date_comes_with_the_count(spark):
    dates = spark.createDataFrame([("p", 3), ("p", 1), ("p", 5), ("q", 9)], "produtor_id string, d int").selectExpr("produtor_id", "date_add(date'2001-01-01', d) dia")
    asked = spark.createDataFrame([("p", 1), ("p", 4), ("q", 2)], "produtor_id string, d int").selectExpr("produtor_id", "date_add(date'2001-01-01', d) dia")
    got = {(r["produtor_id"], r["dia"].day): (r["antes"], r["primeira"] and r["primeira"].day) for r in count_earlier(dates, asked).collect()}
    assert got == {("p", 2): (0, None), ("p", 5): (2, 2), ("q", 3): (0, None)}


def test_results_alone_are_those_of_the_whole_run(domain):
    from plotproof.queries.verification import context

    whole = C.verify(context(domain)).where(~F.col("codigo").startswith("R")).select("talhao_id", "codigo", "resultado")
    short = C.check_results(context(domain))
    assert Counter(map(tuple, short.collect())) == Counter(map(tuple, whole.collect()))
    assert "to_json" not in plan(short)
    assert "n_duplicidades" not in parcel_facts(context(domain), ("docs",)).columns
