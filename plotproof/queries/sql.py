"""Reference SQL of the domain views, written for DuckDB over the given tables."""

from __future__ import annotations

import re

from plotproof.queries.adapters import DOC_CYCLE


def _pick(values, index):
    return "[" + ",".join(f"'{v}'" for v in values) + f"][({index}) + 1]"


_NATURES = [
    "desmate_pos_2020", "embargo_ibama", "car_e_posse", "sobreposicao_direitos",
    "consistencia_documental", "coerencia_volume", "lista_suja_mte",
]
_RULES = ["R13", "R14", "R29", "R01", "R16", "R17", "R18", "R19", "R08", "R31"]

VIEWS: dict[str, str] = {
    "produtor": """
        select c_custkey::varchar id, c_name nome,
          case when c_custkey % 50 <> 7 then lpad(c_custkey::varchar, 11, '0') end cpf,
          n_name municipio, case when c_custkey % 4 = 0 then 'BA' else 'PA' end uf,
          case when c_mktsegment <> 'HOUSEHOLD' then c_mktsegment end cooperativa,
          lower(replace(c_name, '#', '-')) slug
        from customer left join nation on c_nationkey = n_nationkey""",
    "talhao": """
        select o_orderkey::varchar id, o_orderkey k, o_custkey::varchar produtor_id, 'Talhao ' || translate(o_orderkey::varchar, '0123456789', 'abcdefghij') nome,
          2 + (o_orderkey % 800)::double / 100 area_ha,
          case when o_orderkey % 5 < 3 then 'poligono' else 'ponto' end tipo_geom,
          o_orderkey % 211 <> 5 tem_geom,
          -54 + ((o_orderkey * 7919) % 20000)::double / 10000 cx,
          -4 + ((o_orderkey * 104729) % 10000)::double / 10000 cy,
          case when o_orderkey % 5 < 3 then sqrt((2 + (o_orderkey % 800)::double / 100) * 10000) / 222640 else 0 end h,
          case when o_orderkey % 3 = 0 then 6 else 4 end casas,
          case when o_orderkey % 29 <> 0 then 'PA-' || lpad(o_orderkey::varchar, 9, '0') end car_numero,
          case when o_orderkey % 33 = 0 then 'cancelado' when o_orderstatus = 'P' and o_orderkey % 3 = 0 then 'pendente'
            else 'ativo' end car_situacao
        from orders""",
    "lote": """
        select s_suppkey::varchar id, s_name codigo, s_acctbal quantidade_kg, 'Comprador ' || s_nationkey comprador,
          date '1995-02-01' + ((s_suppkey * 37) % 400)::int data_embarque,
          case when s_suppkey % 3 = 0 then 'verde' when s_suppkey % 3 = 1 then 'atencao' else 'bloqueado' end status
        from supplier""",
    "lote_talhao": """
        select l_suppkey::varchar lote_id, l_orderkey::varchar talhao_id, sum(l_quantity) * 100 quantidade_kg
        from lineitem group by 1, 2""",
    "linha": """
        select l_orderkey ok, l_linenumber ln, l_partkey pk, l_suppkey sk, min(l_shipdate)::date ship, min(l_returnflag) rf
        from lineitem group by 1, 2, 3, 4""",
    "documento": f"""
        select concat_ws('-', ok, ln, pk, sk) id, o_custkey::varchar produtor_id,
          case when sk % 3 = 1 then ok::varchar end talhao_id,
          'entrada/' || lower(replace(c_name, '#', '-')) || '/doc-' || concat_ws('-', ok, ln, pk, sk) || '.pdf' arquivo_origem,
          {_pick(DOC_CYCLE, "(pk + ln) % 16")} tipo,
          case when pk % 31 <> 0 then ship end data_emissao,
          case when pk % 53 = 0 then ship - 10 when pk % 17 <> 0
            then ship + (case ln % 3 when 0 then 90 when 1 then 180 else 365 end) end data_validade,
          pk::varchar || '|' || sk conteudo,
          (50 + pk % 50)::double / 100 confianca,
          case when pk % 41 = 0 then 'ilegivel' when rf = 'N' then 'vencido'
            when rf = 'R' and pk % 5 = 0 then 'divergente' else 'ok' end status,
          case when pk % 19 <> 0 then pk::varchar end numero, ln::varchar serie,
          lpad((case when (pk * 7 + sk) % 97 = 0 then pk else o_custkey end)::varchar, 11, '0') cpf,
          case when pk % 61 = 0 then 'outro titular' else trim(regexp_replace(lower(c_name), '[^a-z]+', ' ', 'g')) end nome,
          case when pk % 61 = 0 then 'Outro Títular' else c_name end nome_bruto,
          case when pk % 43 = 0 then 'altamira' else trim(regexp_replace(lower(n_name), '[^a-z]+', ' ', 'g')) end municipio,
          case when {_pick(DOC_CYCLE, "(pk + ln) % 16")} in
              ('car_recibo','car_demonstrativo','ccir','sigef','matricula_imovel','itr') and (sk % 3 <> 2 or pk % 101 = 0)
            then case when pk % 10 = 8 then (2 + (ok % 800)::double / 100) * 0.9::double
              when pk % 10 = 9 then (2 + (ok % 800)::double / 100) * 1.2::double
              else 2 + (ok % 800)::double / 100 end end area_ha,
          case when sk % 3 = 0 then ok end citado,
          case when {_pick(DOC_CYCLE, "(pk + ln) % 16")} = 'car_demonstrativo'
            then case when pk % 37 = 0 then 'Pendente' else 'Ativo' end end situacao,
          'PA-' || lpad(ok::varchar, 9, '0') numero_car,
          ship vigencia_inicio, ship + 365 vigencia_fim,
          case when pk % 71 = 0 then 'cessionario' else trim(regexp_replace(lower(c_name), '[^a-z]+', ' ', 'g')) end arrendatario
        from linha join orders on o_orderkey = ok join customer on c_custkey = o_custkey
          left join nation on c_nationkey = n_nationkey""",
    "checagem": """
        select event_id::varchar id, user_id::varchar talhao_id, '0' || (event_id % 7 + 1) codigo,
          case when event_id % 13 = 0 then null when event_id % 7 = 0 then 'A' else 'B' end perna,
          case when value < 60 then 'conforme' when value < 120 then 'excecao' else 'bloqueio' end resultado,
          case when value < 60 then 0 when value < 120 then 1 else 2 end posto,
          'base ' || event_type fonte, date_trunc('second', ts) data_execucao, props evidencia_json,
          case when event_id % 3 = 0 then 'B' when event_id % 3 = 1 then 'F' end severidade, event_id seq
        from events""",
    "corrente": """
        select * from checagem qualify row_number() over (partition by talhao_id, codigo order by seq desc) = 1""",
    "regra_checagem": f"""
        select user_id::varchar talhao_id, {_pick(_RULES, "event_id % 10")} codigo,
          case when value < 160 then 'conforme' else 'excecao' end resultado,
          case when event_id % 5 = 0 then 'F' else 'B' end severidade, event_id seq from events""",
    "excecao": f"""
        select event_id::varchar id, case event_type when 'error' then 'bloqueio' when 'click' then 'lacuna_sanavel'
            when 'view' then 'dispensa_documentada' when 'purchase' then 'nao_sanavel_pelo_produtor' end tipo,
          case when event_id % 11 <> 0 then user_id::varchar end talhao_id,
          case when event_id % 5 = 0 then [(event_id % 97)::varchar, (event_id % 89)::varchar] end lotes_afetados,
          'achado ' || event_id descricao, {_pick(_NATURES, "event_id % 7")} natureza,
          case when value < 60 then 'aberta' else 'resolvida' end status from events""",
    "dossie": """
        select 'D' || l_suppkey || '-' || l_linenumber id, l_suppkey::varchar lote_id, l_linenumber versao,
          max(l_shipdate) gerado_em, case when l_linenumber = 3 then 'aprovado' else 'rascunho' end status
        from lineitem group by l_suppkey, l_linenumber""",
    "evento": """
        select event_id::varchar id, ts, case when event_type = 'purchase' then 'humano' else 'sistema' end ator,
          case event_type when 'signup' then 'documento_processado' when 'view' then 'checagem_executada'
            when 'click' then 'dossie_gerado' when 'error' then 'excecao_aberta' else 'talhao_verificado' end acao,
          user_id::varchar entidade_id from events""",
    "aptidao": """
        select event_id::varchar id, user_id::varchar produtor_id, (event_id % 5 + 1)::int camada, value < 60 satisfeita,
          case when event_id % 3 = 0 then 'forte' when event_id % 3 = 1 then 'media' else 'fraca' end forca,
          date_trunc('second', ts) avaliado_em from events""",
    "caixa": """
        select p_partkey p, p_size, p_type, -54 + ((p_partkey * 6101) % 20000)::double / 10000 bx,
          -4 + ((p_partkey * 3557) % 10000)::double / 10000 byy, (5 + p_size)::double / 20000 bh from part""",
    # Boxes in metres of the equal-scale plane.
    "talhao_m": """
        select *, (cx - h) * 111320 x1, (cx + h) * 111320 x2, (cy - h) * 111320 y1, (cy + h) * 111320 y2
        from talhao where tem_geom""",
    "caixa_m": """
        select *, (bx - bh) * 111320 x1, (bx + bh) * 111320 x2, (byy - bh) * 111320 y1, (byy + bh) * 111320 y2 from caixa""",
    # Parcels (under 400 m wide) and boxes meet in buckets of 4 km: a parcel is in the bucket of its corner, a box in all within reach.
    "talhao_b": "select *, floor(x1 / 4000)::bigint ix, floor(y1 / 4000)::bigint iy from talhao_m",
    "caixa_b": """
        select *, unnest(range(floor((y1 - 1400) / 4000)::bigint, floor((y2 + 1000) / 4000)::bigint + 1)) iy
        from (select *, unnest(range(floor((x1 - 1400) / 4000)::bigint, floor((x2 + 1000) / 4000)::bigint + 1)) ix from caixa_m)""",
    "par": """
        select t.id talhao_id, c.p, c.p_size, c.p_type, greatest(t.x1 - c.x2, c.x1 - t.x2, 0) gx, greatest(t.y1 - c.y2, c.y1 - t.y2, 0) gy,
          greatest(least(t.x2, c.x2) - greatest(t.x1, c.x1), 0) * greatest(least(t.y2, c.y2) - greatest(t.y1, c.y1), 0) area_m2
        from talhao_b t join caixa_b c on t.ix = c.ix and t.iy = c.iy
          and t.x1 <= c.x2 + 1000 and c.x1 <= t.x2 + 1000 and t.y1 <= c.y2 + 1000 and c.y1 <= t.y2 + 1000""",
    "vizinho": "select *, sqrt(gx * gx + gy * gy) dist from par where sqrt(gx * gx + gy * gy) <= 1000",
    "negada": """
        select lpad((p_partkey % 700 * 31)::varchar, 11, '0') cpf, max_by('MTE-' || p_partkey, p_partkey) inscricao,
          max_by((2000 + p_size)::varchar, p_partkey) ano
        from part where p_partkey % 9 <> 0 group by 1""",
}


def with_views(body: str, once: bool = False, **extra: str) -> str:
    """Prefix ``body`` with the views it uses, in dependency order; ``once``: each is computed a single time."""
    known = {**VIEWS, **extra}
    order: list[str] = []

    def visit(text: str):
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in known and name not in order:
                visit_view(name)

    def visit_view(name: str):
        if name in order or name in open_views:
            return
        open_views.add(name)
        visit(known[name])
        open_views.discard(name)
        order.append(name)

    open_views: set[str] = set()
    if body.lstrip().startswith("with "):
        body = f"select * from ({body})"
    visit(body)
    if not order:
        return body
    kept = "materialized " if once else ""
    return "with " + ",\n".join(f"{n} as {kept}({known[n]})" for n in order) + "\n" + body


def half_up(expr: str, places: int) -> str:
    scale = float(10**places)
    return f"(floor(({expr}) * {scale}::double + 0.5) / {scale}::double)"
