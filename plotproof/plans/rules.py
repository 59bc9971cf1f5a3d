"""Registry of document-consistency rules over the wide parcel row.

A rule is a function ``Context -> Finding``. Adding one is one entry in
``RULE_FUNCTIONS`` and one line of severity and category in the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotproof.catalog import RULES, Params
from plotproof.plans.context import Context

z = lambda name: F.coalesce(F.col(name), F.lit(0))


@dataclass
class Finding:
    fires: Column
    text: Column | str
    severity: Column | None = None


def _disagree(a: str, b: str) -> Column:
    """Some value of ``a`` differs from some value of ``b``."""
    return (F.col(f"{a}_min") != F.col(f"{b}_max")) | (F.col(f"{a}_max") != F.col(f"{b}_min"))


def _check(code: str) -> Column:
    return F.col(f"c{code}.resultado") != "conforme"


def r01(ctx):
    return Finding(_disagree("cpf_recibo", "cpf_nota"), "CPF do recibo de CAR difere do CPF da nota fiscal")


def r08(ctx):
    return Finding(_check("07"), "CPF de elo do lote na lista suja (checagem 07)")


def r09(ctx):
    return Finding(z("n_cpf_nomes") > 0, F.format_string("%d CPF com titulares de nomes diferentes", z("n_cpf_nomes")))


def r11(ctx):
    least = F.least("t_min11", "p_min11")
    return Finding(
        (F.col("area_ha") != 0) & (F.col("area_ha") > least * 1.02),
        F.format_string("talhao com %.2f ha, documento com %.2f ha", "area_ha", F.coalesce(least, F.lit(0.0))),
    )


def r12(ctx):
    low, high = F.least("t_min12", "p_min12"), F.greatest("t_max12", "p_max12")
    return Finding(
        (z("t_n12") + z("p_n12") >= 2) & (high > low * 1.05),
        F.format_string("areas declaradas de %.2f a %.2f ha", F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0))),
    )


def r13(ctx):
    return Finding(_check("03"), "cadastro do CAR nao sustenta o talhao (checagem 03)")


def r14(ctx):
    return Finding(
        (F.col("tipo_geom") == "ponto") & (z("area_ha") > 4.0),
        F.format_string("talhao de %.2f ha entregue como ponto, limite de 4 ha", z("area_ha")),
    )


def r16(ctx):
    from plotproof.plans.checks import by_cpf_only

    return Finding(_check("02"), "area embargada (checagem 02)", F.when(by_cpf_only(), "F"))


def r17(ctx):
    precision_only = F.get_json_object("c01.evidencia_json", "$.motivo_excecao") == "precisao_coordenada"
    return Finding(_check("01") & ~F.coalesce(precision_only, F.lit(False)), "desmatamento apos o corte (checagem 01)")


def _areas(kind: str, label: str) -> Finding:
    grave = z(f"areas_{kind}_b") > 0
    return Finding(
        F.col("tem_geom") & (z(f"areas_{kind}") > 0),
        F.format_string(f"%d {label} sobre o talhao (checagem 04)", z(f"areas_{kind}")),
        F.when(z(f"areas_{kind}") > 0, F.when(grave, "B").otherwise("F")),
    )


def r18(ctx):
    return _areas("ti", "terra(s) indigena(s)")


def r19(ctx):
    return _areas("uc", "unidade(s) de conservacao")


def r21(ctx):
    return Finding(_disagree("mun_matricula", "mun_recibo"), "municipio da matricula difere do municipio do CAR")


def r22(ctx):
    from plotproof.functions.text import fold_name

    name = fold_name(F.col("produtor_nome"))
    other = (F.col("arrendatario_min") != name) | (F.col("arrendatario_max") != name)
    return Finding((name != "") & other, "arrendatario do contrato difere do produtor")


def r29(ctx):
    status = F.lower(F.trim(F.coalesce("car_situacao", F.lit(""))))
    parcel = status.isin("cancelado", "suspenso") if ctx.params.r29_only_cancelled else (status != "") & (status != "ativo")
    return Finding(
        parcel | (z("n_demos_inativos") > 0),
        F.format_string("CAR do talhao '%s', %d demonstrativo(s) sem situacao ativa", status, z("n_demos_inativos")),
    )


def r31(ctx):
    late = F.datediff("embarque_max", "validade_min")
    return Finding(late > 0, F.format_string("documento vence ate %d dias antes do embarque", F.coalesce(late, F.lit(0))))


def r32(ctx):
    return Finding(
        z("n_datas_invertidas") > 0, F.format_string("%d documento(s) emitidos depois da validade", z("n_datas_invertidas"))
    )


def r33(ctx):
    outside = (F.col("embarque_min") < F.col("inicio_max")) | (F.col("embarque_max") > F.col("fim_min"))
    return Finding(outside, "vigencia do contrato nao cobre o embarque")


def r39(ctx):
    return Finding(F.lit(False), "regra desligada: produtividade maxima sem fonte")


def r45(ctx):
    return Finding(z("n_notas_repetidas") > 0, F.format_string("%d numero(s) de nota repetidos", z("n_notas_repetidas")))


def r46(ctx):
    return Finding(z("n_duplicidades") > 0, F.format_string("%d par(es) de documentos suspeitos", z("n_duplicidades")))


def r47(ctx):
    return Finding(
        z("n_ilegiveis") + z("n_divergentes") > 0,
        F.format_string("%d documento(s) ilegiveis e %d divergentes no conjunto minimo", z("n_ilegiveis"), z("n_divergentes")),
    )


def missing_minimum(params: Params, types: Column) -> Column:
    """Missing mandatory types and one-of groups without any member."""
    held = F.coalesce(types, F.array().cast("array<string>"))
    mandatory = F.array_except(F.array(*[F.lit(t) for t in params.mandatory]), held)
    groups = [
        F.when(~F.arrays_overlap(F.array(*[F.lit(t) for t in g]), held), F.lit("um_de(" + "|".join(g) + ")"))
        for g in params.one_of
    ]
    return F.concat(mandatory, F.array_compact(F.array(*groups))) if groups else mandatory


def r48(ctx):
    missing = missing_minimum(ctx.params, F.col("tipos"))
    return Finding(F.size(missing) > 0, F.concat(F.lit("faltam: "), F.array_join(missing, ", ")))


RULE_FUNCTIONS: dict[str, Callable[[Context], Finding]] = {
    code: globals()[code.lower()] for code in RULES
}


#: What of the wide row a rule's evidence holds; rules that pass on a check hold its result.
EVIDENCE = {
    "R01": ("cpf_recibo_min", "cpf_recibo_max", "cpf_nota_min", "cpf_nota_max"),
    "R08": ("c07.resultado",),
    "R09": ("n_cpf_nomes",),
    "R11": ("area_ha", "t_min11", "p_min11"),
    "R12": ("t_min12", "p_min12", "t_max12", "p_max12"),
    "R13": ("c03.resultado",),
    "R14": ("tipo_geom", "area_ha"),
    "R16": ("c02.resultado",),
    "R17": ("c01.resultado",),
    "R18": ("areas_ti", "areas_ti_b"),
    "R19": ("areas_uc", "areas_uc_b"),
    "R21": ("mun_matricula_min", "mun_matricula_max", "mun_recibo_min", "mun_recibo_max"),
    "R22": ("produtor_nome", "arrendatario_min", "arrendatario_max"),
    "R29": ("car_situacao", "n_demos_inativos"),
    "R31": ("validade_min", "embarque_max"),
    "R32": ("n_datas_invertidas",),
    "R33": ("inicio_max", "fim_min", "embarque_min", "embarque_max"),
    "R45": ("n_notas_repetidas",),
    "R46": ("n_duplicidades",),
    "R47": ("n_ilegiveis", "n_divergentes"),
    "R48": ("tipos",),
}


def _evidence(code: str, fires: Column) -> Column:
    """JSON of what made the rule fire; null where it does not."""
    fields = [F.col(c).alias(c.replace("c0", "checagem_0").replace(".resultado", "")) for c in EVIDENCE.get(code, ())]
    return F.when(fires, F.to_json(F.struct(*fields))) if fields else F.lit(None).cast("string")


def rule_column(ctx: Context, detail: bool = True) -> Column:
    """Array of rule results; a rule that cannot be evaluated counts as ``conforme``. ``detail``: with texts and evidence."""
    out = []
    for code, rule in RULE_FUNCTIONS.items():
        severity, category, _ = RULES[code]
        f = rule(ctx)
        fires = F.coalesce(f.fires, F.lit(False))
        text = f.text if isinstance(f.text, Column) else F.lit(f.text)
        sev = F.coalesce(f.severity, F.lit(severity)) if f.severity is not None else F.lit(severity)
        short = [F.lit(code).alias("codigo"), F.when(fires, "excecao").otherwise("conforme").alias("resultado"), sev.alias("severidade")]
        if not detail:
            out.append(F.struct(*short))
            continue
        out.append(
            F.struct(
                *short,
                F.lit(category).alias("categoria"),
                F.when(fires, F.concat(F.lit(f"{code} - "), text)).otherwise(F.lit(f"{code} sem conflito")).alias("texto"),
                _evidence(code, fires).alias("evidencia_json"),
            )
        )
    return F.array(*out)
