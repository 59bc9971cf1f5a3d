import hashlib

from pyspark.sql import functions as F

from plotproof.operators import relational as R
from plotproof.plans import documents as D
from plotproof.plans import dossier as O
from plotproof.sources import files as FI


def test_source_record_of_plain_marked_and_empty_files(spark, tmp_path):
    plain = 'SEQ;"NOME";UF\n1;a;PA\n'.encode()
    marked = "﻿SEQ;NOME\r\n1;b\r\n".encode()
    for name, data in (("a.csv", plain), ("b.csv", marked), ("c.csv", b"\n"), ("d.csv", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r["arquivo"]: r for r in FI.source_record(spark, str(tmp_path)).collect()}
    assert got["a.csv"]["campos"] == ["SEQ", "NOME", "UF"] and got["a.csv"]["bytes"] == len(plain)
    assert got["b.csv"]["campos"] == ["SEQ", "NOME"] and got["b.csv"]["sha256"] == hashlib.sha256(marked).hexdigest()
    assert got["c.csv"]["campos"] == [] and got["c.csv"]["bytes"] == 1 and "d.csv" not in got


def test_listing_and_text_of_attachments(spark, tmp_path):
    folder = tmp_path / "maria-silva"
    folder.mkdir()
    (folder / "tabela.csv").write_bytes(b"a,b\r\n1,2\r\n3,4")
    (folder / "laudo.txt").write_bytes(b"%PDF-1.7")
    got = {r["nome"]: r for r in FI.list_files(spark, str(tmp_path)).collect()}
    assert got["laudo.txt"]["extensao"] == ".pdf" and got["laudo.txt"]["slug"] == "maria-silva"
    assert got["tabela.csv"]["hash_sha256"] == hashlib.sha256(b"a,b\r\n1,2\r\n3,4").hexdigest()
    text = lambda **k: FI.csv_text(spark, str(folder / "tabela.csv"), **k).first()["texto"]
    assert text() == "csv\na,b\n1,2\n3,4" and text(rows=1) == "csv\na,b\n1,2"


def test_producer_summary_counts_nulls_and_producers_without_documents(spark):
    people = spark.createDataFrame([("1", "Ana", "ana"), ("2", "Bia", "bia"), ("3", None, "caio")], "id string, nome string, slug string")
    docs = spark.createDataFrame(
        [("1", "ok", "ccir"), ("1", "ok", "ccir"), ("1", None, "itr"), ("3", "vencido", None)], "produtor_id string, status string, tipo string"
    )
    gaps = spark.createDataFrame([("1", ["car_recibo"]), ("2", []), ("3", ["ccir", "itr"])], "produtor_id string, faltando array<string>")
    out = D.producer_summary(people, docs, gaps)
    got = {r["produtor_id"]: r for r in out.collect()}
    assert got["1"]["arquivos"] == 3 and got["1"]["por_status"] == {"ok": 2, "sem valor": 1} and got["1"]["por_tipo"] == {"ccir": 2, "itr": 1}
    assert got["2"]["arquivos"] == 0 and got["2"]["por_status"] == {} and got["2"]["por_tipo"] == {}
    assert got["3"]["por_tipo"] == {"sem valor": 1}
    acts = {r["entidade_id"]: r for r in D.ingestion_events(out, F.lit("2001-01-01").cast("timestamp")).collect()}
    assert acts["2"]["detalhe"] == "0 arquivo(s) processado(s); lacunas: nenhuma"
    assert acts["3"]["detalhe"] == "1 arquivo(s) processado(s); lacunas: ccir, itr" and acts["3"]["acao"] == "produtor_ingerido"
    assert D.producer_summary(people.limit(0), docs, gaps).count() == 0


def test_allocations_keep_rows_of_unknown_lots(spark):
    bridge = spark.createDataFrame([("L1", "T1", 5.0), ("L9", "T1", 7.0)], "lote_id string, talhao_id string, quantidade_kg double")
    lots = spark.createDataFrame([("L1", "cod-1", None)], "id string, codigo string, data_embarque date")
    got = {r["lote_id"]: r for r in R.allocations(bridge, lots).collect()}
    assert got["L1"]["lote_codigo"] == "cod-1" and got["L9"]["lote_codigo"] is None and got["L9"]["quantidade_kg"] == 7.0


def test_report_sources_skip_blank_names(spark):
    bridge = spark.createDataFrame([("L1", "T1"), ("L1", "T2"), ("L2", "T1")], "lote_id string, talhao_id string")
    rows = [("T1", "01", "base a"), ("T2", "01", " base a "), ("T2", "02", " "), ("T1", "02", None), ("T2", "01", "base b")]
    current = spark.createDataFrame(rows, "talhao_id string, codigo string, fonte string")
    got = {(r["lote_id"], r["codigo"], r["fonte"]): r["linhas"] for r in O.report_sources(bridge, current).collect()}
    assert got == {("L1", "01", "base a"): 2, ("L1", "01", "base b"): 1, ("L2", "01", "base a"): 1}


def test_fields_are_read_of_the_wanted_types_alone(spark):
    from plotproof.queries import load
    from plotproof.queries.adapters import Domain

    load()
    from plotproof.queries.printed import _extracted

    read = _extracted(Domain(spark, "/root/testdata/sf0.001"), F.col("tipo") == "matricula_imovel")
    assert [r["tipo"] for r in read.select("tipo").distinct().collect()] == ["matricula_imovel"]


def test_texts_name_their_producer_so_equal_slugs_do_not_multiply(spark):
    from plotproof.queries import load
    from plotproof.queries.adapters import Domain

    load()
    from plotproof.queries.evidence import texts

    d = Domain(spark, "/root/testdata/sf0.001")
    d.__dict__["produtor"] = d.produtor.withColumn("slug", F.lit("same"))
    assert texts(d, "produtor_id").where("produtor_id is not null").count() == d.documento.count()
