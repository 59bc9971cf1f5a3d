"""Five-layer aptitude: a hierarchy of alternatives per producer, not a checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.catalog import RULES
from plotproof.functions.report import lookup
from plotproof.functions.text import digits
from plotproof.operators.latest import latest_checks
from plotproof.schemas import conform, key_id

# Document types by evidential strength.
LAND_USE = (("matricula_imovel", "forte"), ("titulo_assentamento", "media"), ("declaracao_posse", "fraca"), ("contrato_arrendamento", "fraca"))
TRANSACTION = ("nota_fiscal_produtor", "contranota", "nota_fiscal_entrada")
NEGATIVE_CHECKS = ("01", "02", "04", "07")
_TYPES = (
    "car_recibo", "car_demonstrativo", "matricula_imovel", "titulo_assentamento", "declaracao_posse", "contrato_arrendamento",
    "ccir", "itr", "caf", "dap", "inscricao_estadual", "ficha_cooperado", *TRANSACTION,
)


def first_documents(documento: DataFrame) -> DataFrame:
    """Id of the first document of each relevant type per producer, one pass."""
    first = [
        F.min(F.when(F.col("tipo") == t, F.struct("arquivo_origem", "id")))["id"].alias(f"d_{t}") for t in _TYPES
    ]
    return documento.where(F.col("tipo").isin(*_TYPES)).groupBy("produtor_id").agg(*first)


def parcel_flags(talhao: DataFrame) -> DataFrame:
    status = F.lower(F.trim(F.coalesce("car_situacao", F.lit(""))))
    failed = (F.coalesce("car_numero", F.lit("")) == "") | status.isin("cancelado", "suspenso")
    point = F.lower(F.trim(F.coalesce("tipo_geom", F.lit("")))) == "ponto"
    large = F.coalesce("area_ha", F.lit(0.0)) > 4.0
    return talhao.groupBy("produtor_id").agg(
        F.count("*").alias("talhoes"),
        F.count_if(failed | (point & large)).alias("reprovados"),
        F.count_if(~failed & (status == "pendente")).alias("pendentes"),
        F.count_if(~failed & point & ~large).alias("so_ponto"),
    )


def negative_checks(current: DataFrame, talhao: DataFrame) -> DataFrame:
    owner = talhao.select(F.col("id").alias("talhao_id"), "produtor_id")
    rows = current.where(F.col("codigo").isin(*NEGATIVE_CHECKS)).select("talhao_id", "resultado").join(owner, "talhao_id")
    return rows.groupBy("produtor_id").agg(
        F.count("*").alias("avaliadas"), F.count_if(F.col("resultado") != "conforme").alias("negativas")
    )


def open_rules(current_rules: DataFrame, talhao: DataFrame) -> DataFrame:
    """Open B rules per producer: which of the layers 1, 4/2 and 5 they contradict."""
    layers = {c: layer for c, (_, _, layer) in RULES.items() if layer}
    rows = current_rules.where(F.col("codigo").isin(*layers) & (F.col("resultado") != "conforme") & (F.col("severidade") == "B"))
    owner = talhao.select(F.col("id").alias("talhao_id"), "produtor_id")
    layer = lookup(F.col("codigo"), layers)
    joined = rows.select("talhao_id", layer.alias("camada"), "codigo").join(owner, "talhao_id")
    return joined.groupBy("produtor_id").agg(
        *[F.count_if(F.col("camada") == n).alias(f"trava_{n}") for n in (1, 4, 5)]
    )


def evaluate(
    produtor: DataFrame, talhao: DataFrame, documento: DataFrame, checagem: DataFrame, moment: Column
) -> DataFrame:
    """Five rows per producer. ``checagem`` holds check and rule rows; the latest of each counts."""
    current = latest_checks(checagem.select("talhao_id", "codigo", "resultado", "severidade", "seq"))
    wide = (
        produtor.select(F.col("id").alias("produtor_id"), digits(F.col("cpf")).alias("cpf"), "cooperativa")
        .join(first_documents(documento), "produtor_id", "left")
        .join(parcel_flags(talhao), "produtor_id", "left")
        .join(negative_checks(current, talhao), "produtor_id", "left")
        .join(open_rules(current, talhao), "produtor_id", "left")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = lambda t: F.col(f"d_{t}")
    none = F.lit(None).cast("string")

    def layer(n: int, ok: Column, strength: Column, via: Column, blocked: Column) -> Column:
        holds = F.coalesce(ok, F.lit(False))
        return F.struct(
            F.lit(n).alias("camada"),
            (holds & ~blocked).alias("satisfeita"),
            F.when(holds & ~blocked, strength).otherwise("fraca").alias("forca"),
            via.alias("via_documento_id"),
            F.when(holds & blocked, "prova presente, barrada por regra B em aberto")
            .when(blocked, "aberta, com regra B em aberto").when(holds, "fechada").otherwise("aberta").alias("detalhe"),
        )

    one = layer(
        1, (z("talhoes") > 0) & (z("reprovados") == 0),
        F.when(z("pendentes") > 0, "media").when(z("so_ponto") > 0, "fraca").otherwise("forte"),
        F.when(z("talhoes") > 0, F.coalesce(d("car_recibo"), d("car_demonstrativo"))), z("trava_1") > 0,
    )
    support = F.coalesce(d("ccir"), d("itr")).isNotNull()
    via2, strength2, ok2 = none, F.lit("fraca"), F.lit(False)
    for tipo, strength in reversed(LAND_USE):
        held = d(tipo).isNotNull()
        via2 = F.when(held, d(tipo)).otherwise(via2)
        strength2 = F.when(held, F.lit(strength)).otherwise(strength2)
        ok2 = F.when(held, support if strength == "fraca" else F.lit(True)).otherwise(ok2)
    notes = F.coalesce(*[d(t) for t in TRANSACTION]).isNotNull()
    two = layer(2, ok2, strength2, via2, (z("trava_4") > 0) & ~notes)
    via3 = F.coalesce(d("caf"), d("dap"), d("inscricao_estadual"), d("ficha_cooperado"))
    cpf_ok = F.length("cpf") == 11
    three = layer(
        3, cpf_ok & (via3.isNotNull() | (F.coalesce("cooperativa", F.lit("")) != "")),
        F.when(F.coalesce(d("caf"), d("dap")).isNotNull(), "forte").when(via3.isNotNull(), "media").otherwise("fraca"),
        F.when(cpf_ok, via3), F.lit(False),
    )
    four = layer(
        4, notes, F.when(d("nota_fiscal_produtor").isNotNull(), "forte").otherwise("media"),
        F.coalesce(*[d(t) for t in TRANSACTION]), (z("trava_4") > 0) & notes,
    )
    five = layer(5, (z("avaliadas") > 0) & (z("negativas") == 0), F.lit("forte"), none, z("trava_5") > 0)
    rows = wide.select("produtor_id", F.explode(F.array(one, two, three, four, five)).alias("a")).select("produtor_id", "a.*")
    return rows.withColumn("avaliado_em", moment).withColumn(
        "id", key_id("produtor_id", F.col("camada").cast("string"), F.col("avaliado_em").cast("string"))
    )


def as_table(rows: DataFrame) -> DataFrame:
    return conform(rows, "aptidao")


def totals(rows: DataFrame) -> DataFrame:
    """Closed and open per layer, and the strength of the closed ones."""
    closed = F.col("satisfeita")
    return rows.groupBy("camada").agg(
        F.count_if(closed).alias("satisfeitas"), F.count_if(~closed).alias("abertas"),
        *[F.count_if(closed & (F.col("forca") == f)).alias(f) for f in ("forte", "media", "fraca")],
    )
