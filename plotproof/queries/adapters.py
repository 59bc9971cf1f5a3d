"""The given star-schema tables seen as the domain tables.

Producers are customers, parcels are orders, lots are suppliers, the bridge and
the documents are lines, the layers are parts, the history tables are events.
Every column is an expression of the given rows, so all work grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotproof.schemas import conform

E = F.expr

DOC_CYCLE = (
    "car_recibo car_demonstrativo ccir nota_fiscal_produtor matricula_imovel declaracao_posse contrato_arrendamento"
    " itr sigef cndt licenca_ambiental inscricao_estadual titulo_assentamento desconhecido nao_documento due_embarque"
).split()


def _pick(values: list[str], index: str) -> str:
    listed = ",".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({index} as int) + 1)"


class Domain:
    """Lazy domain frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def produtor(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", "n_name")
        frame = self.raw("customer").join(nation, E("c_nationkey = n_nationkey"), "left").select(
            E("cast(c_custkey as string)").alias("id"),
            E("c_name").alias("nome"),
            E("case when c_custkey % 50 <> 7 then lpad(cast(c_custkey as string), 11, '0') end").alias("cpf"),
            E("n_name").alias("municipio"),
            E("case when c_custkey % 4 = 0 then 'BA' else 'PA' end").alias("uf"),
            E("case when c_mktsegment <> 'HOUSEHOLD' then c_mktsegment end").alias("cooperativa"),
            E("lower(replace(c_name, '#', '-'))").alias("slug"),
        )
        return conform(frame, "produtor")

    @cached_property
    def talhao(self) -> DataFrame:
        k = "o_orderkey"
        frame = (
            self.raw("orders")
            .withColumn("area_ha", E(f"2 + cast({k} % 800 as double) / 100"))
            .withColumn("cx", E(f"-54 + cast(({k} * 7919) % 20000 as double) / 10000"))
            .withColumn("cy", E(f"-4 + cast(({k} * 104729) % 10000 as double) / 10000"))
            .withColumn("h", E("sqrt(area_ha * 10000) / 222640"))
            .withColumn("tipo_geom", E(f"case when {k} % 5 < 3 then 'poligono' else 'ponto' end"))
        )
        precise = f"case when {k} % 3 = 0 then '%.6f' else '%.4f' end"
        point = f"format_string(concat('POINT (', {precise}, ' ', {precise}, ')'), cx, cy)"
        box = (
            "concat('POLYGON ((', cx - h, ' ', cy - h, ', ', cx + h, ' ', cy - h, ', ', cx + h, ' ', cy + h, ', ',"
            " cx - h, ' ', cy + h, ', ', cx - h, ' ', cy - h, '))')"
        )
        frame = frame.select(
            E(f"cast({k} as string)").alias("id"),
            E("cast(o_custkey as string)").alias("produtor_id"),
            E(f"concat('Talhao ', translate(cast({k} as string), '0123456789', 'abcdefghij'))").alias("nome"),
            "area_ha",
            E(f"case when {k} % 211 = 5 then null when tipo_geom = 'ponto' then {point} else {box} end").alias("geom_wkt"),
            "tipo_geom",
            E(f"case when {k} % 29 <> 0 then concat('PA-', lpad(cast({k} as string), 9, '0')) end").alias("car_numero"),
            E(
                f"case when {k} % 33 = 0 then 'cancelado' when o_orderstatus = 'P' and {k} % 3 = 0 then 'pendente'"
                " else 'ativo' end"
            ).alias("car_situacao"),
        )
        return conform(frame, "talhao")

    @cached_property
    def lote(self) -> DataFrame:
        frame = self.raw("supplier").select(
            E("cast(s_suppkey as string)").alias("id"),
            E("s_name").alias("codigo"),
            F.lit("cacau").alias("commodity"),
            F.lit("1995").alias("safra"),
            E("s_acctbal").alias("quantidade_kg"),
            E("concat('Comprador ', s_nationkey)").alias("comprador"),
            E("date_add(date'1995-02-01', cast((s_suppkey * 37) % 400 as int))").alias("data_embarque"),
            E("case when s_suppkey % 3 = 0 then 'verde' when s_suppkey % 3 = 1 then 'atencao' else 'bloqueado' end").alias("status"),
        )
        return conform(frame, "lote")

    @cached_property
    def lote_talhao(self) -> DataFrame:
        # Lines meet by parcel, so the join with the parcels finds them dealt out already.
        line = self.raw("lineitem").select(
            E("cast(l_suppkey as string)").alias("lote_id"), E("cast(l_orderkey as string)").alias("talhao_id"), "l_quantity"
        )
        return line.repartition("talhao_id").groupBy("lote_id", "talhao_id").agg((F.sum("l_quantity") * 100).alias("quantidade_kg"))

    @cached_property
    def documento(self) -> DataFrame:
        """One document per distinct line of a parcel."""
        # Lines are dealt out once, by parcel, for their grouping and for their owner; owners, one row
        # per parcel, get their names before they meet the lines.
        line = (
            self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag").repartition("l_orderkey")
            .groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .agg(F.min("l_shipdate").cast("date").alias("ship"), F.min("l_returnflag").alias("rf"))
        )
        customer = self.raw("customer").join(
            self.raw("nation").select("n_nationkey", "n_name"), E("c_nationkey = n_nationkey"), "left"
        ).select("c_custkey", "c_name", "n_name")
        owner = self.raw("orders").select("o_orderkey", "o_custkey").join(customer, E("o_custkey = c_custkey"))
        # Merged, so that the documents stay in as many tasks as their lines were dealt to, at any size.
        d = line.hint("merge").join(owner, E("l_orderkey = o_orderkey"))
        d = (
            d.withColumn("tipo", E(_pick(DOC_CYCLE, "(l_partkey + l_linenumber) % 16")))
            .withColumn("base_area", E("2 + cast(l_orderkey % 800 as double) / 100"))
        )
        fields = F.struct(
            E("case when l_partkey % 19 <> 0 then cast(l_partkey as string) end").alias("numero"),
            E("cast(l_linenumber as string)").alias("serie"),
            E(
                "lpad(cast(case when (l_partkey * 7 + l_suppkey) % 97 = 0 then l_partkey else o_custkey end as string), 11, '0')"
            ).alias("cpf"),
            E("case when l_partkey % 61 = 0 then 'Outro Títular' else c_name end").alias("nome"),
            E("case when l_partkey % 43 = 0 then 'Altamira' else n_name end").alias("municipio"),
            E(
                "case when tipo in ('car_recibo','car_demonstrativo','ccir','sigef','matricula_imovel','itr') and"
                " (l_suppkey % 3 <> 2 or l_partkey % 101 = 0) then"
                " case when l_partkey % 10 = 8 then base_area * 0.9D when l_partkey % 10 = 9 then base_area * 1.2D"
                " else base_area end end"
            ).alias("area_ha"),
            E("case when l_suppkey % 3 = 0 then concat('TALHÃO ', translate(cast(l_orderkey as string), '0123456789', 'abcdefghij')) end").alias("talhao_citado"),
            E("case when tipo = 'car_demonstrativo' then case when l_partkey % 37 = 0 then 'Pendente' else 'Ativo' end end").alias("situacao"),
            E("case when tipo in ('car_recibo','car_demonstrativo') then concat('pa-', lpad(cast(l_orderkey as string), 9, '0')) end").alias("numero_car"),
            E("case when tipo = 'contrato_arrendamento' then cast(ship as string) end").alias("vigencia_inicio"),
            E("case when tipo = 'contrato_arrendamento' then date_format(date_add(ship, 365), 'dd/MM/yyyy') end").alias("vigencia_fim"),
            E("case when tipo = 'contrato_arrendamento' then case when l_partkey % 71 = 0 then 'Cessionário' else c_name end end").alias("arrendatario"),
        )
        key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
        frame = d.select(
            E(key).alias("id"),
            E("cast(o_custkey as string)").alias("produtor_id"),
            E("case when l_suppkey % 3 = 1 then cast(l_orderkey as string) end").alias("talhao_id"),
            E(f"concat('entrada/', lower(replace(c_name, '#', '-')), '/doc-', {key}, '.pdf')").alias("arquivo_origem"),
            "tipo",
            F.to_json(fields).alias("campos_json"),
            E("case when l_partkey % 31 <> 0 then ship end").alias("data_emissao"),
            E(
                "case when l_partkey % 53 = 0 then date_add(ship, -10) when l_partkey % 17 <> 0 then"
                " date_add(ship, case l_linenumber % 3 when 0 then 90 when 1 then 180 else 365 end) end"
            ).alias("data_validade"),
            E("sha2(concat(l_partkey, '|', l_suppkey), 256)").alias("hash_sha256"),
            E("cast(50 + l_partkey % 50 as double) / 100").alias("confianca"),
            E(
                "case when l_partkey % 41 = 0 then 'ilegivel' when rf = 'N' then 'vencido'"
                " when rf = 'R' and l_partkey % 5 = 0 then 'divergente' else 'ok' end"
            ).alias("status"),
            F.lit(1).alias("versao"),
        )
        return conform(frame, "documento")

    @cached_property
    def checagem(self) -> DataFrame:
        frame = self.raw("events").select(
            E("cast(event_id as string)").alias("id"),
            E("cast(user_id as string)").alias("talhao_id"),
            E("concat('0', event_id % 7 + 1)").alias("codigo"),
            E("case when event_id % 13 = 0 then null when event_id % 7 = 0 then 'A' else 'B' end").alias("perna"),
            E("case when value < 60 then 'conforme' when value < 120 then 'excecao' else 'bloqueio' end").alias("resultado"),
            E("concat('Resultado: ', value)").alias("texto"),
            E("concat('base ', event_type)").alias("fonte"),
            E("date_trunc('second', ts)").alias("data_execucao"),
            E("props").alias("evidencia_json"),
            E("case when event_id % 3 = 0 then 'B' when event_id % 3 = 1 then 'F' end").alias("severidade"),
            E("event_id").alias("seq"),
        )
        return conform(frame, "checagem")

    @cached_property
    def regra_checagem(self) -> DataFrame:
        """Rule detail rows of earlier runs."""
        rules = ["R13", "R14", "R29", "R01", "R16", "R17", "R18", "R19", "R08", "R31"]
        frame = self.raw("events").select(
            E("cast(event_id as string)").alias("id"),
            E("cast(user_id as string)").alias("talhao_id"),
            E(_pick(rules, "event_id % 10")).alias("codigo"),
            E("case when value < 160 then 'conforme' else 'excecao' end").alias("resultado"),
            E("case when event_id % 5 = 0 then 'F' else 'B' end").alias("severidade"),
            E("date_trunc('second', ts)").alias("data_execucao"),
            E("event_id").alias("seq"),
        )
        return conform(frame, "checagem")

    @cached_property
    def excecao(self) -> DataFrame:
        natures = [
            "desmate_pos_2020", "embargo_ibama", "car_e_posse", "sobreposicao_direitos",
            "consistencia_documental", "coerencia_volume", "lista_suja_mte",
        ]
        frame = self.raw("events").select(
            E("cast(event_id as string)").alias("id"),
            E(
                "case event_type when 'error' then 'bloqueio' when 'click' then 'lacuna_sanavel'"
                " when 'view' then 'dispensa_documentada' when 'purchase' then 'nao_sanavel_pelo_produtor' end"
            ).alias("tipo"),
            E("case when event_id % 11 <> 0 then cast(user_id as string) end").alias("talhao_id"),
            E("case when event_id % 5 = 0 then array(cast(event_id % 97 as string), cast(event_id % 89 as string)) end").alias("lotes_afetados"),
            E("concat('achado ', event_id)").alias("descricao"),
            E(_pick(natures, "event_id % 7")).alias("natureza"),
            E("case when value < 60 then 'aberta' else 'resolvida' end").alias("status"),
        )
        return conform(frame, "excecao")

    @cached_property
    def dossie(self) -> DataFrame:
        frame = (
            self.raw("lineitem")
            .groupBy("l_suppkey", "l_linenumber")
            .agg(F.max("l_shipdate").alias("gerado_em"))
            .select(
                E("concat('D', l_suppkey, '-', l_linenumber)").alias("id"),
                E("cast(l_suppkey as string)").alias("lote_id"),
                E("l_linenumber").alias("versao"),
                "gerado_em",
                E("case when l_linenumber = 3 then 'aprovado' else 'rascunho' end").alias("status"),
            )
        )
        return conform(frame, "dossie")

    @cached_property
    def evento(self) -> DataFrame:
        frame = self.raw("events").select(
            E("cast(event_id as string)").alias("id"),
            E("ts").alias("timestamp"),
            E("case when event_type = 'purchase' then 'humano' else 'sistema' end").alias("ator"),
            E(
                "case event_type when 'signup' then 'documento_processado' when 'view' then 'checagem_executada'"
                " when 'click' then 'dossie_gerado' when 'error' then 'excecao_aberta' else 'talhao_verificado' end"
            ).alias("acao"),
            F.lit("talhao").alias("entidade"),
            E("cast(user_id as string)").alias("entidade_id"),
            E("concat('valor ', value)").alias("detalhe"),
        )
        return conform(frame, "evento")

    @cached_property
    def aptidao(self) -> DataFrame:
        frame = self.raw("events").select(
            E("cast(event_id as string)").alias("id"),
            E("cast(user_id as string)").alias("produtor_id"),
            E("cast(event_id % 5 + 1 as int)").alias("camada"),
            E("value < 60").alias("satisfeita"),
            E("case when event_id % 3 = 0 then 'forte' when event_id % 3 = 1 then 'media' else 'fraca' end").alias("forca"),
            E("date_trunc('second', ts)").alias("avaliado_em"),
        )
        return conform(frame, "aptidao")

    def _boxes(self) -> DataFrame:
        p = "p_partkey"
        return (
            self.raw("part")
            .withColumn("bx", E(f"-54 + cast(({p} * 6101) % 20000 as double) / 10000"))
            .withColumn("by", E(f"-4 + cast(({p} * 3557) % 10000 as double) / 10000"))
            .withColumn("bh", E("cast(5 + p_size as double) / 20000"))
            .withColumn(
                "geom_wkt",
                E(
                    "concat('POLYGON ((', bx - bh, ' ', by - bh, ', ', bx + bh, ' ', by - bh, ', ', bx + bh, ' ', by + bh,"
                    " ', ', bx - bh, ' ', by + bh, ', ', bx - bh, ' ', by - bh, '))')"
                ),
            )
        )

    @cached_property
    def embargo(self) -> DataFrame:
        return self._boxes().select(
            E("concat('TAD', p_partkey)").alias("NUM_TAD"),
            E("lpad(cast(p_partkey * 13 as string), 11, '0')").alias("CPF_CNPJ_EMBARGADO"),
            E("p_name").alias("NOME_EMBARGADO"),
            E("p_brand").alias("MUNICIPIO"),
            F.lit("PA").alias("UF"),
            E("case when p_size % 4 = 0 then 'ponto TAD bufferizado pela area declarada' else 'GEOM_AREA_EMBARGADA' end").alias("origem_geometria"),
            F.lit("ibama_real").alias("fonte_camada"),
            "geom_wkt",
        )

    @cached_property
    def alerta(self) -> DataFrame:
        return self._boxes().select(
            E("concat('ALERTA-', p_partkey)").alias("id_alerta"),
            E("cast(date_add(date'2018-01-01', cast((p_partkey * 97) % 2500 as int)) as string)").alias("data_deteccao"),
            F.lit("SEMEADO").alias("fonte_camada"),
            "geom_wkt",
        )

    @cached_property
    def protegida(self) -> DataFrame:
        return self._boxes().select(
            E("concat('PROT-', p_partkey)").alias("id_area"),
            E(
                "case when p_type in ('ECONOMY', 'SMALL') then 'terra_indigena' when p_type in ('LARGE', 'PROMO')"
                " then 'unidade_conservacao' else 'territorio_quilombola' end"
            ).alias("tipo_area"),
            E("element_at(array('homologada','declarada','protecao_integral','uso_sustentavel','titulado','em_processo'), cast(p_partkey % 6 as int) + 1)").alias("categoria_area"),
            E("concat('Area ', p_partkey)").alias("nome_area"),
            F.lit("SEMEADO").alias("fonte_camada"),
            "geom_wkt",
        )

    @cached_property
    def lista_suja(self) -> DataFrame:
        """Deny-list rows in file order; some keys repeat with another formatting."""
        return self.raw("part").select(
            E("case when p_partkey % 9 = 0 then '' when p_partkey % 2 = 0 then concat('000.', lpad(cast(p_partkey % 700 * 31 as string), 8, '0'))"
              " else lpad(cast(p_partkey % 700 * 31 as string), 11, '0') end").alias("cpf_cnpj"),
            E("concat('MTE-', p_partkey)").alias("numero_inscricao"),
            E("cast(2000 + p_size as string)").alias("ano_inclusao"),
            F.lit("PA").alias("uf"),
            E("p_partkey").alias("linha"),
        )
