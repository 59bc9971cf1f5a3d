"""Classification and extraction fold a text once and look for labels only in texts that name them."""

import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from plotproof.catalog import default_params
from plotproof.functions import extract as X
from plotproof.functions import text as T
from plotproof.plans import documents as D

TEXTS = [
    "RECIBO DE INSCRIÇÃO no Cadastro Ambiental Rural\r\nTitular: Ana\rMunicípio: Uruará/PA\nÁrea total: 12,50 ha",
    "Contrato de arrendamento\nVigência de 01/02/2020 a 31/01/2021\nVigência aditada de 30/02/2020 a 05/06/2022\nArrendador: João",
    "linha sem nada\nEmissao: 0000-01-01\nValidade: 31/02/1999",
    "Data de emissão: 2020-02-29 e 01/03/2021\nValido ate 2021-13-01\nÁrea: 3 ha\nárea: 4,5 ha\nReserva: 1.5\nha",
    "NOTA FISCAL natureza\nSérie: 925\nModelo: 4\nCFOP aqui não\noutro cfop 6102\nChave " + "1" * 44 + "\nQuantidade: 1.234,5 kg",
    "CFOP: 5101\nNota fiscal " + " ".join(["1520"] * 11),
    "ﬁcha ½ ￿ ĳ CAR e ccir-itr", "", None, "Matrícula n. 12\nCartório: X\nCNPJ 12.345.678/0001-90\nmatricula n 77",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, texto string")


def test_extraction_folds_no_line_again_and_gives_what_the_lines_give(spark):
    params = default_params()
    typed = D.classify(frame(spark), params)
    plan = D.extract(frame(spark).withColumns({"_norm": F.col("texto"), "tipo": F.lit("ccir")}), params)._jdf.queryExecution().optimizedPlan().toString()
    assert T._SOURCE[:5] not in plan
    t, l = F.col("texto"), X.lines_of(F.col("texto"))
    plain = [X.areas(l), X.labelled(l, ["Titular"]), X.labelled_date(l, ["Emissao", "Data de emissao"]), X.labelled_date(l, ["Valido ate", "Validade"]), X.validity_of(l)]
    gated = [X.areas(X.lines_of(t, F.col("_norm")), F.col("_norm"))] + [
        f(X.lines_of(t, F.col("_norm")), labels, F.col("_norm")) for f, labels in (
            (X.labelled, ["Titular"]), (X.labelled_date, ["Emissao", "Data de emissao"]), (X.labelled_date, ["Valido ate", "Validade"]))
    ] + [X.validity_of(X.lines_of(t, F.col("_norm")), F.col("_norm"))]
    rows = typed.select(F.array(*[F.to_json(F.struct(c.alias("v"))) for c in plain]).alias("a"), F.array(*[F.to_json(F.struct(c.alias("v"))) for c in gated]).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and any('"Ana"' in v for r in rows for v in r["a"])
    got = {r["k"]: r["campos"] for r in D.extract(typed, params).collect()}
    assert (got[0]["nome"], got[0]["municipio"], got[0]["area_ha"]) == ("Ana", "Uruará", 12.5)
    assert (got[1]["vigencia_inicio"], got[1]["vigencia_fim"], got[1]["data_validade"]) == (None, dt.date(2022, 6, 5), dt.date(2021, 1, 31))
    assert got[2]["data_emissao"] is None and got[2]["data_validade"] is None
    assert got[3]["data_emissao"] == dt.date(2021, 3, 1) and [tuple(a) for a in got[3]["areas_ha"]] == [("area", 4.5)]
    assert (got[4]["serie"], got[4]["nota_modelo_4"], got[4]["cfop"], got[4]["elo"], got[4]["quantidade_kg"]) == ("111", None, "6102", "intermediario", 1234.5)
    assert got[5]["cfop"] == "5101" and got[5]["chave_acesso"] == "1520" * 11
    assert got[9]["numero_matricula"] == "77" and got[9]["cnpj"] == "12.345.678/0001-90" and got[8]["nome"] is None


def test_classification_takes_the_keywords_that_the_word_sets_take(spark):
    params, df = default_params(), frame(spark)
    folded = df.withColumn("n", T.fold(F.col("texto"))).withColumn("w", T.words(F.col("n")))
    words = [(t.name, k) for t in params.types for k in t.keywords]
    hits = folded.select("k", F.array_compact(F.array(*[F.when(T.keyword_hit(F.col("n"), F.col("w"), k), F.lit(k)) for _, k in words])).alias("h"))
    want = {r["k"]: r["h"] for r in hits.collect()}
    classified = D.classify(df, params)
    got = {r["k"]: r for r in classified.collect()}
    for k, row in got.items():
        mine = [w for name, w in words if name == row["tipo"] and w in want[k]]
        assert row["casadas"] == mine and (row["tipo"] != "desconhecido" or not want[k] or not (TEXTS[k] or "").strip())
    assert {got[0]["tipo"], got[1]["tipo"]} == {"car_recibo", "contrato_arrendamento"}
    assert "[^0-9a-z]+" not in classified._jdf.queryExecution().optimizedPlan().toString()  # no set of words is made per text


def test_folding_is_that_of_unicode(spark):
    def fold(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()

    texts = ["plain", "ÀÉîõÜç", "½ ﬁ ĳ ŉ", "x￿y", "x￿½", "ＡＢ\r\n１：", "", "Straße ª º"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold(F.col("t"))).collect()]
    assert got == [fold(t) for t in texts]
