"""Lookups, joins, aggregates, latest rows, top-k and key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotproof.functions import report
from plotproof.operators import relational as R
from plotproof.operators import tables as TB
from plotproof.operators.latest import first_by, latest_aptitude, latest_checks
from plotproof.queries.registry import query
from plotproof.queries.sql import half_up
from plotproof.schemas import conform, key_id

day = lambda c: F.col(c).cast("string").alias(c)


# ---- P: lookups and filters ------------------------------------------------
@query("lookup_by_id", "select id, nome, cpf, municipio, uf, slug from produtor where id = '42'")
def _(d):
    return R.find(d.produtor, id="42").select("id", "nome", "cpf", "municipio", "uf", "slug")


@query("list_equal_filters", "select id, produtor_id, car_numero from talhao where car_situacao = 'pendente' and tipo_geom = 'ponto'")
def _(d):
    return R.listing(d.talhao, ["nome"], car_situacao="pendente", tipo_geom="ponto").select("id", "produtor_id", "car_numero")


@query(
    "documents_of_producers_in_order",
    "select produtor_id, id, row_number() over (partition by produtor_id order by arquivo_origem, id) posicao from documento",
)
def _(d):
    docs = d.documento.select("produtor_id", "id", "arquivo_origem")
    return R.documents_in_order(docs).select("produtor_id", "id", "posicao")


@query(
    "lot_by_id_or_code",
    """select ref, coalesce(min(a.id), min(b.id)) lote_id from
       (select id ref from lote union all select codigo from lote union all select 'x' || id from lote)
       left join lote a on a.id = ref left join lote b on b.codigo = ref group by ref""",
)
def _(d):
    refs = d.lote.select(F.explode(F.array("id", "codigo", F.concat(F.lit("x"), "id"))).alias("ref"))
    return R.find_lots(d.lote, refs)


@query("producer_by_slug", "select c_custkey::varchar id, lower(replace(c_name, '#', '-')) slug from customer where c_name = 'Customer#000000017'")
def _(d):
    return R.find(d.produtor, slug="customer-000000017").select("id", "slug")


@query(
    "adhoc_sql_with_parameters",
    "select municipio, count(*) n from produtor where uf = 'BA' group by municipio",
)
def _(d):
    return R.adhoc(
        d.spark, {"produtor": d.produtor},
        "select municipio, count(*) as n from produtor where uf = :uf group by municipio", uf="BA",
    )


@query("filtered_count", "select count(*) n from excecao where status = 'aberta' and tipo = 'bloqueio'")
def _(d):
    return R.listing(d.excecao, status="aberta", tipo="bloqueio").agg(F.count("*").alias("n"))


@query(
    "alerts_after_cutoff",
    """select 'ALERTA-' || p_partkey id_alerta, (date '2018-01-01' + ((p_partkey * 97) % 2500)::int)::varchar data
       from part where date '2018-01-01' + ((p_partkey * 97) % 2500)::int > date '2020-12-31'""",
)
def _(d):
    from plotproof.functions.dates import lenient_date

    when = lenient_date(F.col("data_deteccao"))
    return d.alerta.where(when > F.to_date(F.lit("2020-12-31"))).select("id_alerta", when.cast("string").alias("data"))


@query("exceptions_by_nature", "select id, descricao from excecao where natureza = 'car_e_posse' and status = 'aberta'")
def _(d):
    return R.listing(d.excecao, natureza="car_e_posse", status="aberta").select("id", "descricao")


@query("exception_vocabulary", "select tipo, count(*) n from excecao group by tipo")
def _(d):
    from plotproof.schemas import EXCEPTION_TYPES, require_vocabulary

    return R.value_counts(require_vocabulary(d.excecao, "tipo", EXCEPTION_TYPES), "tipo")


# ---- J: joins ----------------------------------------------------------------
@query(
    "parcels_of_lots",
    "select lote_id, t.id, produtor_id, area_ha, quantidade_kg kg_no_lote from lote_talhao b join talhao t on t.id = b.talhao_id",
)
def _(d):
    return R.parcels_of_lots(d.talhao, d.lote_talhao).select("lote_id", "id", "produtor_id", "area_ha", "kg_no_lote")


@query(
    "lots_of_parcels",
    "select talhao_id, l.id, codigo, data_embarque::varchar data_embarque from lote_talhao b join lote l on l.id = b.lote_id",
)
def _(d):
    return R.lots_of_parcels(d.lote, d.lote_talhao).select("talhao_id", "id", "codigo", day("data_embarque"))


@query(
    "producers_of_lots",
    "select distinct lote_id, produtor_id from lote_talhao b join talhao t on t.id = b.talhao_id",
)
def _(d):
    return R.producers_of_lots(d.talhao, d.lote_talhao)


@query(
    "parcel_allocations",
    """select talhao_id, sum(b.quantidade_kg) volume_kg, count(*) n_lotes, min(data_embarque)::varchar embarque_min,
       max(data_embarque)::varchar embarque_max from lote_talhao b join lote l on l.id = b.lote_id group by 1""",
)
def _(d):
    return R.allocation_totals(d.lote_talhao, d.lote).select(
        "talhao_id", "volume_kg", "n_lotes", day("embarque_min"), day("embarque_max")
    )


@query("parcels_outside_lots", "select id, produtor_id from talhao where id not in (select talhao_id from lote_talhao)")
def _(d):
    return R.parcels_outside_lots(d.talhao, d.lote_talhao).select("id", "produtor_id")


@query(
    "producers_outside_lots",
    """select id, cpf from produtor where cpf is not null and id not in
       (select produtor_id from lote_talhao b join talhao t on t.id = b.talhao_id) order by id limit 2""",
)
def _(d):
    return R.producers_outside_lots(d.produtor, d.talhao, d.lote_talhao).select("id", "cpf")


@query(
    "exception_lots",
    """with listada as (select distinct e.id excecao_id, l.id lote_id from (select id, unnest(lotes_afetados) x from excecao) e
         join lote l on l.id = e.x)
       select * from listada union all
       select e.id, b.lote_id from excecao e join lote_talhao b using (talhao_id)
       where e.id not in (select excecao_id from listada)""".replace("with listada as", "select * from (with listada as") + ")",
)
def _(d):
    return R.exception_lots(d.excecao, d.lote, d.lote_talhao)


@query(
    "exceptions_of_lots",
    """select distinct lote_id, e.id excecao_id from excecao e join lote_talhao using (talhao_id)
       union select unnest(lotes_afetados), id from excecao""",
)
def _(d):
    links = R.producers_of_lots(d.talhao, d.lote_talhao)
    return R.exceptions_of_lots(d.excecao, d.lote_talhao, links, d.documento)


# ---- W: latest rows ------------------------------------------------------------
_CURRENT = "select talhao_id, codigo, resultado, seq from corrente"


@query("latest_check_by_insertion", _CURRENT)
def _(d):
    return latest_checks(d.checagem).select("talhao_id", "codigo", "resultado", "seq")


@query(
    "latest_check_by_time",
    """select talhao_id, codigo, resultado, seq from checagem
       qualify row_number() over (partition by talhao_id, codigo order by data_execucao desc, seq desc) = 1""",
)
def _(d):
    return latest_checks(d.checagem, by_time=True).select("talhao_id", "codigo", "resultado", "seq")


@query(
    "latest_aptitude",
    """select produtor_id, camada, satisfeita, forca from aptidao
       qualify row_number() over (partition by produtor_id, camada order by avaliado_em desc, id desc) = 1""",
)
def _(d):
    return latest_aptitude(d.aptidao).select("produtor_id", "camada", "satisfeita", "forca")


@query(
    "duplicate_content",
    """select id, first_value(id) over (partition by produtor_id, conteudo order by arquivo_origem) duplicata_de
       from documento qualify row_number() over (partition by produtor_id, conteudo order by arquivo_origem) > 1""",
)
def _(d):
    from plotproof.plans.documents import flag_duplicates

    # Dealt out by content once, for the first of each content and for the join with it.
    docs = d.documento.select("id", "produtor_id", "hash_sha256", "arquivo_origem").where(
        "produtor_id is not null and hash_sha256 is not null and arquivo_origem is not null")
    docs = docs.repartition("produtor_id", "hash_sha256")
    flagged = flag_duplicates(docs, "arquivo_origem", "id")
    return flagged.where("duplicado").select("id", "duplicata_de")


@query(
    "worst_row_per_code",
    """select codigo, talhao_id, resultado, seq from corrente
       qualify row_number() over (partition by codigo order by posto desc, seq) = 1""",
)
def _(d):
    ranked = latest_checks(d.checagem).withColumn("_p", -report.result_rank(F.col("resultado")))
    return first_by(ranked, ["codigo"], ["_p", "seq"]).select("codigo", "talhao_id", "resultado", "seq")


@query("next_dossier_version", "select l.id lote_id, max(versao) versao_anterior, coalesce(max(versao), 0) + 1 proxima from lote l left join dossie d on d.lote_id = l.id group by 1")
def _(d):
    return R.next_versions(d.lote, d.dossie)


# ---- A: aggregates ----------------------------------------------------------
@query(
    "table_row_counts",
    """select 'produtor' tabela, count(*) linhas from produtor union all select 'talhao', count(*) from talhao
       union all select 'documento', count(*) from documento union all select 'lote', count(*) from lote
       union all select 'lote_talhao', count(*) from lote_talhao union all select 'evento', count(*) from evento""",
)
def _(d):
    return R.table_counts({n: getattr(d, n) for n in ("produtor", "talhao", "documento", "lote", "lote_talhao", "evento")})


@query(
    "autonomy_counters",
    """select count(*) filter (acao = 'checagem_executada') verificacoes_executadas,
       count(*) filter (acao = 'documento_processado') documentos_processados,
       count(*) filter (acao = 'dossie_gerado') dossies_regerados,
       (select count(*) from excecao where status = 'aberta') excecoes_para_humano from evento""",
)
def _(d):
    return R.autonomy_counters(d.evento, d.excecao)


@query(
    "producers_in_many_lots",
    """select produtor_id, count(distinct lote_id) lotes from lote_talhao b join talhao t on t.id = b.talhao_id
       group by 1 having count(distinct lote_id) >= 3""",
)
def _(d):
    return R.producers_in_many_lots(R.producers_of_lots(d.talhao, d.lote_talhao))


@query(
    "largest_parcel_in_many_lots",
    """select id, area_ha, lotes from talhao join (select talhao_id, count(distinct lote_id) lotes from lote_talhao
       group by 1 having count(distinct lote_id) >= 3) on talhao_id = id order by area_ha desc, id limit 1""",
)
def _(d):
    return R.largest_shared_parcel(d.talhao, d.lote_talhao)


@query(
    "results_per_check",
    """select codigo, count(*) filter (resultado = 'conforme') conforme, count(*) filter (resultado = 'excecao') excecao,
       count(*) filter (resultado = 'bloqueio') bloqueio from corrente group by 1""",
)
def _(d):
    return R.result_counts(latest_checks(d.checagem))


@query(
    "worst_result_per_parcel",
    "select talhao_id, max(posto) posto, ['conforme','excecao','bloqueio'][max(posto) + 1] pior from corrente group by 1",
)
def _(d):
    return R.worst_per_parcel(latest_checks(d.checagem))


_STATUS = """
    select l.id lote_id, codigo, status status_anterior,
      ['verde','atencao','bloqueado'][coalesce(max(coalesce(p.posto, 0)), 0) + 1] status,
      count(b.talhao_id) talhoes, count(b.talhao_id) filter (coalesce(p.posto, 0) = 0) conformes,
      count(*) filter (p.posto = 1) em_excecao, count(*) filter (p.posto = 2) bloqueados
    from lote l left join lote_talhao b on b.lote_id = l.id
      left join (select talhao_id, max(posto) posto from corrente group by 1) p on p.talhao_id = b.talhao_id
    group by 1, 2, 3"""


@query("lot_status_from_history", _STATUS)
def _(d):
    return R.lot_status(d.lote, d.lote_talhao, latest_checks(d.checagem))


@query(
    "lot_status_changes",
    """select lote_id, status_anterior, status, case when list_position(['verde','atencao','bloqueado'], status) >
       list_position(['verde','atencao','bloqueado'], status_anterior) then 'piorou' else 'melhorou' end sentido
       from novo_status where status <> status_anterior""",
    novo_status=_STATUS,
)
def _(d):
    status = R.lot_status(d.lote, d.lote_talhao, latest_checks(d.checagem))
    return R.status_changes(status).select("lote_id", "status_anterior", "status", "sentido")


@query(
    "lot_findings_per_leg",
    """select lote_id, coalesce(perna, 'B') perna, ['conforme','excecao','bloqueio'][max(posto) + 1] pior,
       count(*) filter (posto > 0) achados from lote_talhao join corrente using (talhao_id) group by 1, 2""",
)
def _(d):
    return R.leg_findings(d.lote_talhao, latest_checks(d.checagem))


@query(
    "lot_totals",
    f"""select lote_id, count(*) talhoes, count(distinct produtor_id) produtores, {half_up('sum(area_ha)', 2)} area_ha,
        sum(quantidade_kg) kg from lote_talhao b join talhao t on t.id = b.talhao_id group by 1""",
)
def _(d):
    from plotproof.functions.numbers import round_half_up

    return R.lot_totals(d.talhao, d.lote_talhao).withColumn("area_ha", round_half_up(F.col("area_ha"), 2))


@query(
    "rules_fired_in_evidence",
    """select regra, count(*) talhoes from (select unnest(['R' || lpad((event_id % 50)::varchar, 2, '0'), 'R31']) regra
       from events where event_id % 7 = 4) group by 1""",
)
def _(d):
    rows = d.checagem.where("codigo = '05'").withColumn(
        "evidencia_json",
        F.expr("concat('{\"evidencia\":{\"regras_disparadas\":[\"R', lpad(cast(seq % 50 as string), 2, '0'), '\",\"R31\"]}}')"),
    )
    return R.fired_rules(rows)


@query("documents_by_status", "select status, count(*) n from documento group by 1")
def _(d):
    return R.value_counts(d.documento, "status")


@query(
    "documents_top_types",
    """select tipo, count(*) n, floor(count(*) * 1000 / (select count(*) from documento) + 0.5) / 10 pct
       from documento group by 1 order by n desc, tipo limit 12""",
)
def _(d):
    from plotproof.plans.documents import type_ranking

    return type_ranking(d.documento, 12)


@query(
    "layer_origin_counts",
    """select case when p_size % 4 = 0 then 'ponto TAD bufferizado pela area declarada' else 'GEOM_AREA_EMBARGADA' end
       origem_geometria, count(*) n from part group by 1""",
)
def _(d):
    return R.value_counts(d.embargo, "origem_geometria")


@query(
    "severity_counts_per_lot",
    """select lote_id, count(*) filter (severidade = 'B') sev_b, count(*) filter (severidade = 'F') sev_f,
       count(*) filter (severidade is null) sem_classe from lote_talhao join corrente using (talhao_id)
       where posto > 0 group by 1""",
)
def _(d):
    from plotproof.plans.dossier import severity_counts

    return severity_counts(d.lote_talhao, latest_checks(d.checagem))


@query(
    "open_exceptions_by_type",
    """select coalesce(tipo, 'sem tipo') tipo, count(*) total, coalesce(tipo = 'lacuna_sanavel', false) conta_como_lacuna
       from excecao where status = 'aberta' group by tipo""",
)
def _(d):
    from plotproof.plans.exceptions import open_by_type

    return open_by_type(d.excecao)


# ---- O, U: top-k and key sets ------------------------------------------------
@query("last_events", "select id, acao, entidade_id from evento order by ts desc, id desc limit 200")
def _(d):
    return R.last_events(d.evento).select("id", "acao", "entidade_id")


@query(
    "exception_queue",
    """select id, tipo, row_number() over (partition by tipo order by id) posicao,
       list_position(['bloqueio','lacuna_sanavel','dispensa_documentada','nao_sanavel_pelo_produtor'], tipo) ordem
       from excecao where status = 'aberta' and tipo is not null
       qualify row_number() over (partition by tipo order by id) <= 15""",
)
def _(d):
    from plotproof.plans.exceptions import queue

    return queue(d.excecao, 15).select("id", "tipo", "posicao", "ordem")


@query(
    "union_of_layers",
    """select 'ibama_real' fonte_camada, count(*) n, count(p_partkey) com_tad, 0 com_alerta from part
       union all select 'SEMEADO', count(*), 0, count(p_partkey) from part""",
)
def _(d):
    both = d.embargo.unionByName(d.alerta, allowMissingColumns=True)
    return both.groupBy("fonte_camada").agg(
        F.count("*").alias("n"), F.count("NUM_TAD").alias("com_tad"), F.count("id_alerta").alias("com_alerta")
    )


@query("entity_key_union", "select id chave from lote union select id from talhao union select id from produtor")
def _(d):
    return TB.union_keys(d.lote.select("id"), d.talhao.select("id"), d.produtor.select("id"))


@query(
    "minimum_set_difference",
    """with t as (select produtor_id, list(distinct tipo) tipos from documento where tipo not in ('desconhecido','nao_documento') group by 1)
       select produtor_id, array_to_string(list_sort(list_filter(['car_recibo','car_demonstrativo','ccir','nota_fiscal_produtor'],
         lambda x: not list_contains(tipos, x))), ',') faltando,
       array_to_string(list_sort(list_filter(['matricula_imovel','titulo_assentamento','declaracao_posse'],
         lambda x: list_contains(tipos, x))), ',') posse from t""".replace("with t as", "select * from (with t as") + ")",
)
def _(d):
    from plotproof.catalog import default_params
    from plotproof.plans.documents import type_sets

    p = default_params()
    sets = type_sets(d.documento)
    lits = lambda names: F.array(*[F.lit(n) for n in names])
    return sets.select(
        "produtor_id",
        F.array_join(F.array_sort(F.array_except(lits(p.mandatory), "tipos")), ",").alias("faltando"),
        F.array_join(F.array_sort(F.array_intersect(lits(p.one_of[0]), "tipos")), ",").alias("posse"),
    )


# ---- S: writes ------------------------------------------------------------------
@query(
    "conform_unknown_and_missing",
    "select id, nome, null::varchar cpf, municipio, null::varchar uf, null::varchar cooperativa, slug from produtor",
)
def _(d):
    partial = d.produtor.drop("cpf", "uf", "cooperativa").withColumn("desconhecida", F.lit(1))
    return conform(partial, "produtor")


@query(
    "upsert_documents_by_origin",
    """select produtor_id, arquivo_origem, tipo, case when status = 'vencido' then 'ok' else status end status,
       case when status = 'vencido' then 2 else 1 end versao from documento""",
)
def _(d):
    cols = ["produtor_id", "arquivo_origem", "tipo", "status", "versao"]
    base = d.documento.select(*cols)
    changes = base.where("status = 'vencido'").withColumns({"status": F.lit("ok"), "versao": F.lit(2)})
    return TB.upsert(base, changes, ["produtor_id", "arquivo_origem"])


@query(
    "update_known_columns",
    "select id, case when status = 'verde' then 'atencao' else status end status, codigo from lote",
)
def _(d):
    patch = d.lote.where("status = 'verde'").select("id", F.lit("atencao").alias("status"), F.lit(1).alias("outra"))
    return TB.update_columns(d.lote, patch).select("id", "status", "codigo")


@query(
    "audit_event_rows",
    """select 'sistema' ator, 'checagem_executada' acao, talhao_id entidade_id, count(*) n from checagem group by 3""",
)
def _(d):
    rows = d.checagem.select(
        F.lit("sistema").alias("ator"), F.lit("checagem_executada").alias("acao"), F.lit("talhao").alias("entidade"),
        F.col("talhao_id").alias("entidade_id"), F.concat("codigo", F.lit(" "), "id").alias("detalhe"),
        "data_execucao",
    )
    stamped = TB.events(rows, F.col("data_execucao"))
    return stamped.groupBy("ator", "acao", "entidade_id").agg(F.count_distinct("id").alias("n"))


@query("deterministic_ids", "select substr(sha256(l_suppkey || '|' || l_orderkey), 1, 32) id, count(*) n from lineitem group by 1")
def _(d):
    keyed = d.raw("lineitem").select(key_id(F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string")).alias("id"))
    return R.value_counts(keyed, "id")
