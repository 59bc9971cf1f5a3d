"""Fields printed in documents, printed values, source files, allocations and ingestion summaries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plotproof.catalog import DocType, default_params
from plotproof.functions import dates, numbers, report, text
from plotproof.operators import relational as R
from plotproof.operators.latest import latest_checks
from plotproof.plans import documents as D
from plotproof.plans import dossier as O
from plotproof.plans import exceptions as E
from plotproof.queries.evidence import moment
from plotproof.queries.registry import query
from plotproof.queries.sql import VIEWS
from plotproof.session import materialise, scratch_path
from plotproof.sources import files as FI
from plotproof.sources import layers as L

# ---- fields of printed documents -------------------------------------------------------
PRINTED_TYPES = (
    DocType("nota_fiscal_produtor", None, None, ("nota fiscal", "natureza"), ("chave_acesso", "cfop", "quantidade_kg")),
    DocType("contrato_arrendamento", None, 730, ("contrato de arrendamento",), ("vigencia_inicio", "arrendatario", "cpf")),
    DocType("matricula_imovel", None, None, ("registro de imoveis", "matricula"), ("numero_matricula", "area_ha", "cartorio", "cpf")),
    DocType("car_demonstrativo", None, 365, ("demonstrativo",), ("situacao", "cpf", "area_ha")),
)

_FILLER = "Observacao impressa no rodape " + "para conferencia " * 6

#: Printed lines of each kind of document, as expressions over a line's order, number, part, supplier and day.
PRINTED_LINES = {
    0: (
        "'NOTA FISCAL de entrada'",
        "'Natureza: venda'",
        "case sk % 3 when 0 then concat('CFOP: ', if(sk % 2 = 0, '5102', '5101')) when 1 then concat('Operacao pela tabela do CFOP vigente no pais ', if(sk % 2 = 0, '6102', '5101')) end",
        "concat('Série: ', 915 + sk % 60)",
        "concat('Modelo: ', if(sk % 2 = 0, '4', '55'))",
        "case pk % 3 when 1 then concat('Chave ', chave) when 2 then concat('Chave ', regexp_replace(chave, '(\\\\d{4})(?=\\\\d)', '$1 ')) end",
        "concat('Quantidade: ', translate(format_number(cast(pk % 5000 as double) + cast(ln % 4 as double) / 4, 2), ',.', '.,'), ' kg')",
    ),
    1: (
        "'Contrato de arrendamento rural'",
        "concat('Arrendador: Dona ', translate(cast(pk as string), '0123456789', 'abcdefghij'))",
        "concat('Arrendatário: Seu ', translate(cast(sk as string), '0123456789', 'abcdefghij'))",
        "concat('Data de emissão: ', date_format(ship, 'dd/MM/yyyy'))",
        "concat('Vigência de ', date_format(ship, 'dd/MM/yyyy'), ' a ', date_format(date_add(ship, 365), 'dd/MM/yyyy'))",
        "case when sk % 2 = 1 then concat('Vigência aditada de ', date_format(date_add(ship, 30), 'dd/MM/yyyy'), ' a ', date_format(date_add(ship, 900), 'dd/MM/yyyy')) end",
    ),
    2: (
        "'Registro de imóveis da comarca'",
        "concat('Matricula n. ', pk)",
        "concat('Cartório: Oficio ', translate(cast(sk as string), '0123456789', 'abcdefghij'))",
        "concat('Numero: ', ok, '/A folha dois')",
        "'Reserva legal: 2,50 ha'",
        "concat('Area total: ', translate(format_number(cast(ok % 3000 as double) + 0.5D, 2), ',.', '.,'), ' ha')",
        "case when sk % 2 = 1 then concat('Area total: ', format_string('%.1f', cast(pk % 100 as double) + 0.5D), ' ha') end",
        "case when sk % 5 = 0 then concat('CNPJ 12.345.', lpad(cast(pk % 1000 as string), 3, '0'), '/0001-', lpad(cast(sk % 100 as string), 2, '0')) end",
    ),
    3: (
        "'Demonstrativo do imóvel'",
        "concat('Número do CAR: PA-', lpad(cast(ok as string), 9, '0'), ' emitido')",
        "concat('Situação do cadastro: ', if(pk % 7 = 0, 'Pendente', 'Ativo'))",
        "concat('CPF: 999.', lpad(cast(sk % 1000 as string), 3, '0'), '.000-01')",
        "case when sk % 2 = 1 then concat('CPF do conjuge: 111.', lpad(cast(pk % 1000 as string), 3, '0'), '.000-02') end",
        "concat('Município: Vila ', translate(cast(sk % 10 as string), '0123456789', 'abcdefghij'), '/PA')",
        "concat('Data de emissão: ', date_format(ship, 'yyyy-MM-dd'))",
        "case sk % 3 when 0 then concat('Valido até: ', date_format(date_add(ship, 100), 'dd/MM/yyyy')) when 1 then 'Valido até: 31/02/1999' end",
        "case when pk % 2 = 1 then concat('Talhao de referencia: Baixada ', translate(cast(ok as string), '0123456789', 'abcdefghij'), ' (antigo)') end",
    ),
}


def printed_documents(d):
    """One printed text per distinct line of the lots."""
    line = d.raw("lineitem").groupBy(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk")
    ).agg(F.min("l_shipdate").cast("date").alias("ship"))
    line = line.withColumn(
        "chave",
        F.expr(
            "concat('15', date_format(ship, 'yyMM'), if(sk % 2 = 0, concat('000', lpad(cast(ok as string), 11, '0')), concat('1', lpad(cast(ok as string), 13, '0'))),"
            " if(sk % 5 = 0, '04', '55'), lpad(cast(900 + pk % 90 as string), 3, '0'), lpad(cast(pk as string), 9, '0'), '1000000007')"
        ),
    )
    body = None
    for kind, lines in PRINTED_LINES.items():
        whole = F.concat_ws("\n", *[F.expr(x) for x in lines], F.lit(_FILLER))
        body = F.when(F.col("pk") % 4 == kind, whole) if body is None else body.when(F.col("pk") % 4 == kind, whole)
    return line.select(F.concat_ws("-", "ok", "ln", "pk", "sk").alias("id"), body.alias("texto"))


VIEWS["impresso"] = """
    select concat_ws('-', ok, ln, pk, sk) id, *, pk % 4 k,
      pk % 4 = 0 and pk % 3 <> 0 com_chave, sk % 2 = 0 natural_, 915 + sk % 60 serie_impressa, 900 + pk % 90 serie_chave,
      case sk % 3 when 0 then case when sk % 2 = 0 then '5102' else '5101' end when 1 then case when sk % 2 = 0 then '6102' else '5101' end end cfop_,
      '15' || strftime(ship, '%y%m') || case when sk % 2 = 0 then '000' || lpad(ok::varchar, 11, '0') else '1' || lpad(ok::varchar, 13, '0') end
        || case when sk % 5 = 0 then '04' else '55' end || (900 + pk % 90) || lpad(pk::varchar, 9, '0') || '1000000007' chave_,
      '999.' || lpad((sk % 1000)::varchar, 3, '0') || '.000-01' cpf1, '111.' || lpad((pk % 1000)::varchar, 3, '0') || '.000-02' cpf2
    from linha"""


@query("invoice_fields", """
    select id, case when com_chave then chave_ end chave_acesso, case when not com_chave then true end chave_acesso_ausente,
      case when com_chave then '15' end uf_ibge, case when com_chave then strftime(ship, '%y%m') end aamm,
      case when com_chave then case when sk % 5 = 0 then '04' else '55' end when sk % 2 = 0 then '04' else '55' end modelo,
      case when com_chave then serie_chave::varchar else serie_impressa::varchar end serie, case when com_chave then pk::varchar end numero_nf,
      case when com_chave and natural_ then regexp_replace(lpad(ok::varchar, 11, '0'), '(...)(...)(...)(..)', '\\1.\\2.\\3-\\4') end cpf_emitente,
      case when com_chave and not natural_ then '1' || lpad(ok::varchar, 13, '0') end cnpj_emitente,
      case when serie_impressa between 920 and 969 or (com_chave and serie_chave between 920 and 969) then true when com_chave then natural_ end emitente_pessoa_fisica,
      case when case when com_chave then sk % 5 = 0 else sk % 2 = 0 end then true end nota_modelo_4,
      cfop_ cfop, case when cfop_ in ('5102', '6102') then true end cfop_revenda,
      case when cfop_ in ('5102', '6102') then 'intermediario' when cfop_ is not null then 'produtor' end elo,
      (pk % 5000)::double + (ln % 4)::double / 4 quantidade_kg,
      floor((0.3 + 0.2 + case when not com_chave and cfop_ is null and sk % 2 = 1 and serie_impressa not between 920 and 969 then 0.24 else 0.25 end + 0.05 * (1 + case when com_chave then 1 else 0 end + case when cfop_ is not null then 1 else 0 end)) * 100 + 0.5) / 100 confianca
    from impresso where k = 0""")
def _(d):
    c = lambda *names: [F.col(f"campos.{n}").alias(n) for n in names]
    return _extracted(d, F.col("tipo") == "nota_fiscal_produtor").select(
        "id", *c("chave_acesso", "chave_acesso_ausente", "uf_ibge", "aamm", "modelo", "serie", "numero_nf", "cpf_emitente", "cnpj_emitente",
                 "emitente_pessoa_fisica", "nota_modelo_4", "cfop", "cfop_revenda", "elo", "quantidade_kg"), "confianca",
    )


def _extracted(d, wanted):
    params = replace(default_params(), types=PRINTED_TYPES)
    # As in ingestion, both costly steps are evaluated once. Fields are read of the types that are asked for alone.
    typed = materialise(D.classify(printed_documents(d), params), "classified").where(wanted)
    read = materialise(D.extract(typed, params), "extracted")
    read = read.withColumn("campos_presentes", D.present_fields(read))
    return read.withColumn("confianca", D.confidence(params, F.col("texto")))


@query("printed_document_fields", """
    select id, ['contrato_arrendamento', 'matricula_imovel', 'car_demonstrativo'][k] tipo,
      case k when 2 then ok || '/A' when 3 then 'PA-' || lpad(ok::varchar, 9, '0') end numero,
      case when k = 2 then pk::varchar end numero_matricula,
      case when k = 2 then 'Oficio ' || translate(sk::varchar, '0123456789', 'abcdefghij') end cartorio,
      case when k = 2 and sk % 5 = 0 then '12.345.' || lpad((pk % 1000)::varchar, 3, '0') || '/0001-' || lpad((sk % 100)::varchar, 2, '0') end cnpj,
      case when k = 2 then case when sk % 2 = 1 then pk % 100 else ok % 3000 end + 0.5::double end area_ha,
      case when k = 2 then printf('reserva legal 2.50;area total %.2f', (case when sk % 2 = 1 then pk % 100 else ok % 3000 end + 0.5)::double) end areas,
      case when k = 1 then 'Dona ' || translate(pk::varchar, '0123456789', 'abcdefghij') end arrendador,
      case when k = 1 then 'Seu ' || translate(sk::varchar, '0123456789', 'abcdefghij') end arrendatario,
      case when k = 1 then (ship + case when sk % 2 = 1 then 30 else 0 end)::varchar end vigencia_inicio,
      case when k = 1 then (ship + case when sk % 2 = 1 then 900 else 365 end)::varchar end vigencia_fim,
      case when k in (1, 3) then ship::varchar end data_emissao,
      case k when 1 then (ship + 365)::varchar when 3 then (ship + case when sk % 3 = 0 then 100 else 365 end)::varchar end data_validade,
      case when k = 3 and sk % 3 <> 0 then true end validade_derivada,
      case when k = 3 then case when pk % 7 = 0 then 'Pendente' else 'Ativo' end end situacao,
      case when k = 3 then cpf1 end cpf, case when k = 3 and sk % 2 = 1 then cpf2 || ',' || cpf1 end cpfs,
      case when k = 3 then 'Vila ' || translate((sk % 10)::varchar, '0123456789', 'abcdefghij') end municipio,
      case when k = 3 and pk % 2 = 1 then 'Baixada ' || translate(ok::varchar, '0123456789', 'abcdefghij') end talhao_citado,
      case k when 1 then 0.75 when 2 then 0.86 else 0.75 end::double confianca
    from impresso where k > 0""")
def _(d):
    c = lambda *names: [F.col(f"campos.{n}").alias(n) for n in names]
    day = lambda *names: [F.col(f"campos.{n}").cast("string").alias(n) for n in names]
    areas = F.transform("campos.areas_ha", lambda a: F.format_string("%s %.2f", a["rotulo"], a["ha"]))
    return _extracted(d, F.col("tipo") != "nota_fiscal_produtor").select(
        "id", "tipo", *c("numero", "numero_matricula", "cartorio", "cnpj", "area_ha", "arrendador", "arrendatario", "validade_derivada",
                         "situacao", "cpf", "municipio", "talhao_citado"),
        *day("vigencia_inicio", "vigencia_fim", "data_emissao", "data_validade"),
        F.array_join(areas, ";").alias("areas"), F.array_join("campos.cpfs_encontrados", ",").alias("cpfs"), "confianca",
    )


# ---- printed values -------------------------------------------------------------------
@query("printed_lot_values", """
    select id, trim(regexp_replace(lower(codigo || ' ' || comprador), '[^a-z0-9]+', '-', 'g'), '-') apelido,
      translate(format('{:,.2f}', quantidade_kg), ',.', '.,') kg, strftime(data_embarque, '%d/%m/%Y') embarque,
      strftime(data_embarque + interval 90 minute, '%d/%m/%Y %H:%M') momento, '—' vazio from lote""")
def _(d):
    return d.lote.select(
        "id", text.slug(F.concat_ws(" ", "codigo", "comprador")).alias("apelido"), numbers.format_br(F.col("quantidade_kg")).alias("kg"),
        dates.format_date_br(F.col("data_embarque")).alias("embarque"),
        dates.format_datetime_br(F.col("data_embarque").cast("timestamp") + F.expr("interval 90 minutes")).alias("momento"),
        dates.format_date_br(F.lit(None).cast("date")).alias("vazio"),
    )


@query("printed_holders", r"""
    select id, case when cpf is not null then regexp_replace(cpf, '(...)(...)(...)(..)', '\1.\2.\3-\4') end cpf_impresso from produtor""")
def _(d):
    return d.produtor.select("id", text.format_cpf(F.col("cpf")).alias("cpf_impresso"))


@query("shortened_texts", """
    select doc_id, case when length(t) <= 90 then t else rtrim(t[1:fica], ' ,;') || ' […]' end resumo from (
      select doc_id, t, case when ponto > 45 then ponto + 1 when espaco >= 0 then espaco else 90 end fica from (
        select doc_id, t, case when contains(t[1:90], '. ') then 90 - instr(reverse(t[1:90]), ' .') - 1 else -1 end ponto,
          case when contains(t[1:90], ' ') then 90 - instr(reverse(t[1:90]), ' ') else -1 end espaco
        from (select doc_id, trim(coalesce(text, '')) t from documents)))""")
def _(d):
    return d.raw("documents").select("doc_id", report.shorten(F.col("text"), 90).alias("resumo"))


@query("evidence_lines", """
    select id, case when id::bigint % 5 = 0 then 'sem objeto ' || id when id::bigint % 7 = 0 then ''
      else 'k = ' || (evidencia_json->>'k') || '; fonte = ' || fonte end linha from checagem""")
def _(d):
    named = F.to_json(F.struct(F.get_json_object("evidencia_json", "$.k").alias("k"), "fonte"))
    n = F.col("id").cast("bigint")
    stored = F.when(n % 5 == 0, F.concat(F.lit("sem objeto "), "id")).when(n % 7 != 0, named)
    return d.checagem.select("id", report.evidence_line(stored).alias("linha"))


# ---- files ------------------------------------------------------------------------------
_ATTACHMENT = """
    select 'municipio=' || municipio slug, 'id,nome,uf' || chr(10) || string_agg(id || ',' || nome || ',' || uf || chr(10), '' order by id::bigint) conteudo
    from produtor group by 1"""


def _attachments(d):
    """One CSV of producers per town, in a folder of the town's name."""
    root = scratch_path(d.spark, "anexos")
    rows = d.produtor.select("municipio", "id", "nome", "uf").repartition("municipio")
    rows = rows.sortWithinPartitions("municipio", F.col("id").cast("bigint"))
    rows.write.partitionBy("municipio").option("header", True).csv(root)
    return root


@query("file_listing", f"""
    select replace(slug, ' ', '%20') slug, strlen(conteudo) bytes, sha256(conteudo) hash_sha256, '.csv' extensao from ({_ATTACHMENT})""")
def _(d):
    found = FI.list_files(d.spark, _attachments(d)).where(F.col("nome").endswith(".csv"))
    return found.select(F.replace("slug", F.lit(" "), F.lit("%20")).alias("slug"), "bytes", "hash_sha256", "extensao")


@query("attachment_texts", f"select replace(slug, ' ', '%20') slug, 'csv' || chr(10) || conteudo texto from ({_ATTACHMENT})")
def _(d):
    read = FI.csv_text(d.spark, _attachments(d) + "/*")
    town = F.regexp_extract("arquivo_origem", r"([^/]+)/[^/]+$", 1)
    return read.select(F.replace(town, F.lit(" "), F.lit("%20")).alias("slug"), "texto")


@query("source_records", f"""
    select strlen(conteudo) bytes, sha256(conteudo) sha256, 'id|nome|uf' campos from ({_ATTACHMENT})""")
def _(d):
    read = FI.source_record(d.spark, _attachments(d) + "/*", ",")
    return read.select("bytes", "sha256", F.array_join("campos", "|").alias("campos"))


@query("layers_from_files", """
    select 'ALERTA-' || p id, (date '2018-01-01' + ((p * 97) % 2500)::int)::varchar detalhe, 5 vertices from caixa
    union all select 'PROT-' || p, case when p % 3 = 0 then 'Area "norte"; ' || chr(10) || p else 'Area ' || p end, 5 from caixa""")
def _(d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('Area "norte"; \n'), "p_partkey")).otherwise(F.concat(F.lit("Area "), "p_partkey"))
    alerts, areas = scratch_path(d.spark, "alertas"), scratch_path(d.spark, "protegidas")
    L.write_layer(d.alerta.select("id_alerta", "data_deteccao", "geom_wkt"), alerts)
    blank = d._boxes().where("p_partkey % 10 = 0").select(F.lit("PROT-x").alias("id_area"), F.lit("sem desenho").alias("nome_area"), F.lit("POLYGON ((").alias("geom_wkt"))
    known = d._boxes().select(F.concat(F.lit("PROT-"), "p_partkey").alias("id_area"), name.alias("nome_area"), "geom_wkt")
    L.write_layer(known.unionByName(blank), areas)
    a = L.read_layer(d.spark, alerts).select(F.col("id_alerta").alias("id"), F.col("data_deteccao").alias("detalhe"), "geom_wkt")
    b = L.read_layer(d.spark, areas).select(F.col("id_area").alias("id"), F.col("nome_area").alias("detalhe"), "geom_wkt")
    corners = F.regexp_count("geom_wkt", F.lit(",")) + 1
    return a.unionByName(b).select("id", "detalhe", corners.alias("vertices"))


# ---- allocations, decisions, summaries -----------------------------------------------------
@query("allocation_rows", """
    select talhao_id, lote_id, b.quantidade_kg, codigo lote_codigo, data_embarque::varchar data_embarque
    from lote_talhao b left join lote l on l.id = b.lote_id""")
def _(d):
    return R.allocations(d.lote_talhao, d.lote).withColumn("data_embarque", F.col("data_embarque").cast("string"))


@query("producers_outside_first_lots", """
    select id, cpf from produtor where cpf is not null and id not in (select produtor_id from lote_talhao b join talhao t on t.id = b.talhao_id
      join lote l on l.id = b.lote_id where data_embarque < date '1995-02-10') order by id limit 2""")
def _(d):
    first = d.lote.where("data_embarque < date'1995-02-10'").select(F.col("id").alias("lote_id"))
    return R.producers_outside_lots(d.produtor, d.talhao, d.lote_talhao.join(first, "lote_id", "left_semi")).select("id", "cpf")


@query("decision_affected_lots", """
    with decidida as (select * from excecao where status = 'aberta' and id::bigint % 700 = 0),
      listada as (select distinct e.id excecao_id, l.id lote_id from (select id, unnest(lotes_afetados) x from decidida) e join lote l on l.id = e.x)
    select distinct lote_id from (select * from listada union all
      select e.id, b.lote_id from decidida e join lote_talhao b using (talhao_id) where e.id not in (select excecao_id from listada))""")
def _(d):
    chosen = d.excecao.where("status = 'aberta' and cast(id as bigint) % 700 = 0").select("id")
    return E.affected_lots(d.excecao, chosen, d.lote, d.lote_talhao)


@query("report_sources", "select lote_id, codigo, fonte, count(*) linhas from lote_talhao join corrente using (talhao_id) group by 1, 2, 3")
def _(d):
    return O.report_sources(d.lote_talhao, latest_checks(d.checagem))


VIEWS["resumo"] = """
    select p.id produtor_id, coalesce(n, 0) arquivos, coalesce(s.por, '') por_status, coalesce(t.por, '') por_tipo, array_to_string(faltando, ',') faltando
    from produtor p left join (select produtor_id, count(*) n from documento group by 1) d on d.produtor_id = p.id
      left join (select produtor_id, string_agg(status || '=' || n, ',' order by status) por from (select produtor_id, status, count(*) n from documento group by 1, 2) group by 1) s on s.produtor_id = p.id
      left join (select produtor_id, string_agg(tipo || '=' || n, ',' order by tipo) por from (select produtor_id, tipo, count(*) n from documento group by 1, 2) group by 1) t on t.produtor_id = p.id
      join lacuna l on l.produtor_id = p.id"""


def _summary(d):
    return D.producer_summary(d.produtor, d.documento, D.gap_map(d.produtor, d.documento, default_params()))


def _listed(c: str):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(c)


@query("producer_summary", "select * from resumo")
def _(d):
    return _summary(d).select("produtor_id", "arquivos", _listed("por_status"), _listed("por_tipo"), F.array_join("faltando", ",").alias("faltando"))


@query("ingestion_events", """
    select produtor_id entidade_id, 'sistema' ator, 'produtor_ingerido' acao,
      arquivos || ' arquivo(s) processado(s); lacunas: ' || case when faltando = '' then 'nenhuma' else replace(faltando, ',', ', ') end detalhe from resumo""")
def _(d):
    return D.ingestion_events(_summary(d), moment()).select("entidade_id", "ator", "acao", "detalhe")
