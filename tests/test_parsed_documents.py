"""Fields of documents: one parse of a document, whatever is asked of them."""

import json

from pyspark.sql import functions as F

from plotproof.plans.context import parsed_documents
from plotproof.plans.facts import cpf_name_conflicts
from plotproof.schemas import conform


def test_filters_and_groupings_parse_a_document_once(spark):
    texts = [json.dumps({"cpf": "1", "nome": "Ana"}), json.dumps({"cpf": "1", "nome": "Bia"}), "quebrado", None]
    given = spark.createDataFrame([(str(i), "p", t) for i, t in enumerate(texts)], "id string, produtor_id string, campos_json string")
    parsed = parsed_documents(conform(given, "documento"))
    assert parsed.count() == 4  # documents without readable fields stay
    found = cpf_name_conflicts(parsed)
    assert [(r["cpf"], r["nomes"], r["documentos"]) for r in found.collect()] == [("1", 2, 2)]
    plan = found.withColumn("x", F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
