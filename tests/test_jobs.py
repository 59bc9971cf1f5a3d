import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotproof.catalog import default_params, load_params
from plotproof.operators import tables as TB
from plotproof.operators.ranking import positions
from plotproof.operators.spatial import distinct_geometries, geometry_key, spatial_pairs
from plotproof.plans import checks as C
from plotproof.plans import dossier as O
from plotproof.plans import exceptions as E
from plotproof.plans import facts as X
from plotproof.plans.context import Context
from plotproof.schemas import TABLES, conform
from plotproof.sources import layers as L
from plotproof.streaming.watch import Watcher, alert_polygons


def frame(spark, table, rows):
    names = TABLES[table].fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table])


def box(x, y, s):
    return f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"


def context(spark, **over):
    base = dict(
        produtor=frame(spark, "produtor", [{"id": "p", "nome": "Ana Souza", "cpf": "11111111111", "uf": "PA", "cooperativa": "C"}]),
        talhao=frame(spark, "talhao", [
            {"id": t, "produtor_id": "p", "nome": n, "area_ha": a, "geom_wkt": g, "tipo_geom": k, "car_numero": "PA-1", "car_situacao": "ativo"}
            for t, n, a, g, k in (
                ("in", "Dentro", 2.0, box(0, 0, 0.001), "poligono"), ("near", "Perto", 2.0, box(0.004, 0, 0.001), "poligono"),
                ("far", "Longe", 5.0, "POINT (1.123456 1.123456)", "ponto"), ("none", "Sem", 2.0, None, "ponto"))]),
        documento=frame(spark, "documento", []),
        lote=frame(spark, "lote", [{"id": "l", "codigo": "L1", "data_embarque": dt.date(2025, 1, 1), "status": "verde"}]),
        lote_talhao=frame(spark, "lote_talhao", [{"lote_id": "l", "talhao_id": "in", "quantidade_kg": q} for q in (2700.0,)]),
        embargo=spark.createDataFrame([("T1", "99999999999", "X", "M", "PA", "GEOM", "r", box(0.0005, 0, 0.001))],
            "NUM_TAD string, CPF_CNPJ_EMBARGADO string, NOME_EMBARGADO string, MUNICIPIO string, UF string, origem_geometria string, fonte_camada string, geom_wkt string"),
        alerta=spark.createDataFrame([("A1", "2021-01-01", "S", box(0, 0, 0.0005)), ("A0", "2020-12-31", "S", box(0.004, 0, 0.001))],
            "id_alerta string, data_deteccao string, fonte_camada string, geom_wkt string"),
        protegida=spark.createDataFrame([("P1", "terra_indigena", "declarada", "TI", "S", box(0.0041, 0, 0.0001))],
            "id_area string, tipo_area string, categoria_area string, nome_area string, fonte_camada string, geom_wkt string"),
        lista_suja=spark.createDataFrame([("222.222.222-22", "M1", 1)], "cpf_cnpj string, numero_inscricao string, linha long"),
        as_of=dt.date(2025, 1, 2), crs="plane",
    )
    return Context(**{**base, **over})


def results(rows):
    return {(r["talhao_id"], r["codigo"]): (r["resultado"], r["severidade"]) for r in rows.collect()}


def test_planted_cases(spark):
    got = results(C.verify(context(spark)))
    assert got[("in", "01")] == ("bloqueio", "B") and got[("near", "01")][0] == "conforme"
    assert got[("in", "02")][0] == "bloqueio" and got[("near", "02")] == ("excecao", "B") and got[("far", "02")][0] == "conforme"
    assert got[("none", "01")][0] == got[("none", "02")][0] == got[("none", "04")][0] == "excecao"
    assert got[("near", "04")] == ("excecao", "F") and got[("near", "R18")] == ("excecao", "F")
    assert got[("far", "R14")][0] == "excecao" and got[("in", "R14")][0] == "conforme"
    assert got[("in", "R48")][0] == "excecao" and got[("in", "05")][0] == "excecao" and got[("in", "R39")][0] == "conforme"
    assert len(got) == 4 * (7 + 22)


@pytest.mark.parametrize("kg, want", [(2700.0, "conforme"), (2718.0, "excecao"), (5400.0, "excecao"), (5418.0, "bloqueio")])
def test_volume_thresholds(spark, kg, want):
    ctx = context(spark, lote_talhao=frame(spark, "lote_talhao", [{"lote_id": "l", "talhao_id": "in", "quantidade_kg": kg}]))
    assert results(C.check_rows(ctx, ("06",)))[("in", "06")][0] == want


def test_same_cpf_elsewhere_is_a_flag(spark):
    ctx = context(spark)
    own = ctx.embargo.withColumn("CPF_CNPJ_EMBARGADO", F.lit("111.111.111-11")).withColumn("geom_wkt", F.lit(box(3, 3, 0.001)))
    got = results(C.verify(context(spark, embargo=own)))
    assert got[("in", "02")] == ("excecao", "F") and got[("in", "R16")] == ("excecao", "F")


def test_spatial_join_matches_brute_force_on_copies_and_sizes(spark):
    import random

    rnd = random.Random(7)
    left = [(str(i), box(rnd.uniform(0, 50), rnd.uniform(0, 50), rnd.uniform(0.1, 2))) for i in range(120)] + [(f"c{i}", box(5, 5, 1)) for i in range(60)]
    right = [(str(i), box(rnd.uniform(0, 50), rnd.uniform(0, 50), rnd.choice([0.2, 1, 30]))) for i in range(80)]
    a = spark.createDataFrame(left, "id string, geom_wkt string")
    b = spark.createDataFrame(right, "rid string, geom_wkt string")
    for shortcut in (True, False):
        pairs = spatial_pairs(distinct_geometries(a, crs="plane"), distinct_geometries(b, crs="plane"), 50000.0, 60000.0, shortcut)
        got = {
            (r["id"], r["rid"]) for r in pairs.join(a, F.col("l_gkey") == geometry_key(a["geom_wkt"])).join(b, F.col("r_gkey") == geometry_key(b["geom_wkt"])).select("id", "rid").collect()
        }

        def edges(w):
            n = [tuple(map(float, p.split())) for p in w[10:-2].split(",")]
            return min(p[0] for p in n), min(p[1] for p in n), max(p[0] for p in n), max(p[1] for p in n)

        want = set()
        for i, w in left:
            for j, v in right:
                p, q = edges(w), edges(v)
                dx, dy = max(p[0] - q[2], q[0] - p[2], 0), max(p[1] - q[3], q[1] - p[3], 0)
                if (dx * dx + dy * dy) ** 0.5 * 111320 <= 50000:
                    want.add((i, j))
        assert got == want


def test_positions_match_sorting(spark):
    group = F.when(F.col("id") % 4 > 0, F.col("id") % 4)  # a quarter has a null group
    df = spark.range(500).select(group.alias("g"), (F.hash("id") % 40).alias("o"), "id")
    for coarse in ([F.col("o")], [F.floor(F.col("o") / 10)], [F.lit(1)]):
        got = {r["id"]: r["n"] for r in positions(df, ["g"], ["o", "id"], "n", coarse).collect()}
        rows = sorted((r["g"] or 0, r["o"], r["id"]) for r in df.collect())
        assert [got[i] for g, _, i in rows] == [n + 1 for g in range(4) for n in range(sum(r[0] == g for r in rows))]


def test_rules_from_histograms_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(300):
        day = None if rnd.random() < 0.1 else dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(200))
        rows.append((f"p{rnd.randrange(3)}", rnd.choice(["ccir", "itr"]), str(rnd.randrange(6)), day))
    docs = spark.createDataFrame(rows, "produtor_id string, tipo string, numero string, data_emissao date")
    got = {r["produtor_id"]: r["pares"] for r in X.suspicious_duplicates(docs, default_params()).collect()}
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[:2] == b[:2] and a[2] != b[2] and (a[3] is None or b[3] is None or abs((a[3] - b[3]).days) <= 30):
                want[a[0]] = want.get(a[0], 0) + 1
    assert got == want


def test_exception_merge_is_idempotent(spark):
    rows = C.verify(context(spark))
    now = F.lit("2025-01-02 00:00:00").cast("timestamp")
    first = E.merge(frame(spark, "excecao", []), E.findings(rows), rows, now)
    again = E.merge(first, E.findings(rows), rows, now)
    assert sorted(first.collect(), key=str) == sorted(again.collect(), key=str) and first.count() > 0
    cleared = rows.withColumn("resultado", F.lit("conforme"))
    closed = E.merge(first, E.findings(cleared), cleared, now)
    assert {r["status"] for r in closed.collect()} == {"resolvida"}


def test_upsert_events_and_vocabulary(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    out = TB.upsert(base, spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, o int"), ["k"], ["o"])
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    bad = spark.createDataFrame([("robo", "x", "y", "1", "d")], "ator string, acao string, entidade string, entidade_id string, detalhe string")
    with pytest.raises(Exception, match="vocabulary"):
        TB.events(bad, F.current_timestamp()).collect()


def test_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "lote")
    TB.append(frame(spark, "lote", [{"id": "1", "codigo": "A"}]).drop("status"), path, "lote")
    TB.append(frame(spark, "lote", [{"id": "2", "codigo": "B", "status": "verde"}]), path, "lote")
    assert {(r["id"], r["status"]) for r in TB.read_table(spark, path, "lote").collect()} == {("1", None), ("2", "verde")}


def test_diff_applies(spark):
    rows = lambda v: spark.createDataFrame(v, "lote_id string, secao string, chave string, valor string")
    a = rows([("l", "status", "lote", "verde"), ("l", "talhao", "t1", None), ("l", "resultado", "t1|02", "conforme"), ("l", "documento", "d", "ok")])
    b = rows([("l", "status", "lote", "bloqueado"), ("l", "talhao", "t1", None), ("l", "resultado", "t1|02", "bloqueio"), ("l", "documento", "e", "ok")])
    changes = O.diff(a, b)
    assert changes.count() == 4 and O.diff(a, a).count() == 0
    assert sorted(map(tuple, O.apply_diff(a, changes).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    h = lambda d: O.content_hash(d).first()["hash_sha256"]
    assert h(a) == h(a.repartition(3)) and h(a) != h(b)


def test_layer_precedence_and_deny_list(spark, tmp_path):
    df = spark.createDataFrame([("1", box(0, 0, 1)), ("2", ""), ("3", "POLYGON ((")], "NUM_TAD string, geom_wkt string")
    L.write_layer(df, str(tmp_path / "seed"))
    got = L.assemble(spark, str(tmp_path / "real"), str(tmp_path / "seed")).collect()
    assert [(r["NUM_TAD"], r["fonte_camada"]) for r in got] == [("1", "SEMEADO")]
    with pytest.raises(FileNotFoundError):
        L.assemble(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    assert L.base_date(spark, str(tmp_path / "nope.json")) == "desconhecida"
    (tmp_path / "deny.csv").write_text("cpf_cnpj,numero_inscricao\n1,a\n,b\n1,c\n")
    deny = X.deny_list(L.read_deny_list(spark, str(tmp_path / "deny.csv"))).collect()
    assert [(r["cpf"], r["numero_inscricao"]) for r in deny] == [("1", "c")]
    text = 'cpf_cnpj,nome,numero_inscricao\n1,short\n2,"two\nlines",b\n3,x,c\n'
    (tmp_path / "odd.csv").write_text(text)
    deny = X.deny_list(L.read_deny_list(spark, str(tmp_path / "odd.csv")))
    assert {(r["cpf"], r["nome"], r["numero_inscricao"]) for r in deny.collect()} == {
        ("1", "short", None), ("2", "two\nlines", "b"), ("3", "x", "c")
    }
    assert deny.select("cpf").count() == 3
    (tmp_path / "long.csv").write_text(text + "4,y,d,extra\n")
    with pytest.raises(Exception, match="more fields"):
        L.read_csv_text(spark, str(tmp_path / "long.csv"), ",").count()
    assert L.read_csv_text(spark, str(tmp_path / "long.csv"), ",", long_rows="skip").count() == 3
    assert L.long_row_count(spark, str(tmp_path / "long.csv"), ",") == 1


def test_watcher_cycles(spark, tmp_path):
    ctx = context(spark)
    layers = {"now": ctx.alerta}
    seen = []
    w = Watcher(spark, str(tmp_path / "w"), lambda: alert_polygons(layers["now"]), lambda: ctx.talhao,
                lambda parcels, n: seen.append(sorted(r[0] for r in parcels.collect())), "plane",
                layers=lambda: layers.get("read", ["alerta"]))
    assert w.cycle(0)["linha_de_base"] and seen == []
    assert w.cycle(1)["novos"] == 0 and seen == []
    layers["now"] = ctx.alerta.unionByName(ctx.alerta.limit(1).withColumns({"id_alerta": F.lit("N"), "geom_wkt": F.lit(box(1.123, 1.123, 0.001))}))
    assert w.cycle(2)["novos"] == 1 and seen == [["far"]]
    layers["now"] = ctx.alerta
    out = w.cycle(3)
    assert out["sumidos"] == 1 and seen == [["far"], ["far"]]
    layers["now"], layers["read"] = ctx.alerta.limit(0), []
    assert w.cycle(4)["sumidos"] == 0  # a layer that was not read removes nothing
    layers["read"] = ["alerta"]
    assert w.cycle(5)["sumidos"] == alert_polygons(ctx.alerta).count()  # one that was read and is empty loses all


def test_watcher_delta_reaches_parcels_of_new_and_vanished_polygons(spark):
    import duckdb

    import __spark_entry__ as e

    name, folder = "watcher_delta_parcels", "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("orders", "part"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = {r[0] for r in con.execute(e.oracle_sql()[name]).fetchall()}
    vanished = {r[0] for r in con.execute(e.oracle_sql()[name].replace("p_size > 45 or ", "")).fetchall()}
    got = {r[0] for r in e.queries()[name](spark, folder).collect()}
    assert got == want and vanished and vanished < want


def test_params(tmp_path):
    p = tmp_path / "p.yml"
    p.write_text("commodity: x\n")
    with pytest.raises(ValueError):
        load_params(str(p))
    p.write_text("conjunto_minimo:\n  obrigatorios: [a]\nembargo: {distancia_excecao_m: 9}\ntipos:\n  a: {palavras_chave: [k], campos: [c]}\n")
    got = load_params(str(p))
    assert got.mandatory == ("a",) and got.embargo_near_m == 9.0 and got.types[0].keywords == ("k",)
    assert len(default_params().types) == 38


def test_conform(spark):
    out = conform(spark.createDataFrame([("1", 2)], "id string, extra int"), "produtor")
    assert out.columns == TABLES["produtor"].fieldNames() and out.first()["nome"] is None


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    assert e.entry(spark).count() == 10


def test_event_keys_keep_only_what_events_are_about(spark):
    lote = frame(spark, "lote", [{"id": "l"}, {"id": "m"}])
    bridge = frame(spark, "lote_talhao", [{"lote_id": x, "talhao_id": t} for x, t in (("l", "t"), ("m", "t"), ("m", "u"))])
    links = spark.createDataFrame([("l", "p"), ("m", "p")], "lote_id string, produtor_id string")
    docs = frame(spark, "documento", [{"id": f"d{i}", "produtor_id": "p"} for i in range(50)])
    found = frame(spark, "excecao", [{"id": "e1", "talhao_id": "u"}, {"id": "e2", "documento_id": "d7"}, {"id": "e3", "talhao_id": "t"}])
    made = frame(spark, "dossie", [{"id": "D1", "lote_id": "l"}, {"id": "D2", "lote_id": "m"}])
    about = ("d3", "d3", "e2", "p", "D1", "m", "u", "e1", "nobody", None)
    events = frame(spark, "evento", [{"id": str(i), "entidade_id": e, "ator": "sistema"} for i, e in enumerate(about)])
    every = O.lot_event_keys(lote, bridge, links, docs, found, made)
    few = O.lot_event_keys(lote, bridge, links, docs, found, made, events)
    assert every.count() > 100 and few.count() == few.distinct().count() == 10
    counts = lambda keys: sorted(map(tuple, O.lot_event_counts(events, keys).collect()))
    assert counts(few) == counts(every) == [("l", 5, 5, 0), ("m", 7, 7, 0)]
