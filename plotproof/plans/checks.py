"""The seven parcel checks as expressions over one wide parcel row.

Each check is a struct column, so a full run evaluates all of them in one stage
and unfolds the wide row into check rows at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.catalog import CHECKS, UNTYPED  # noqa: F401
from plotproof.functions.numbers import ratio, round_half_up
from plotproof.functions.report import result_rank, sentence
from plotproof.plans.context import Context
from plotproof.plans.facts import parcel_facts
from plotproof.schemas import conform, key_id

z = lambda name: F.coalesce(F.col(name), F.lit(0))


def rough_point() -> Column:
    """A point written with fewer than six decimals."""
    return (F.col("tipo_geom") == "ponto") & (F.col("casas") < 6)


NEEDS = {
    "01": ("alerta",),
    "02": ("embargo",),
    "03": ("docs", "cited"),
    "04": ("protegida",),
    "05": ("docs", "conflicts", "cited", "lots", "denied", "alerta", "embargo", "protegida"),
    "06": ("lots",),
    "07": ("denied",),
}


def _row(
    ctx: Context, code: str, result: Column, compared: Column, base: str, found: Column, verdict: Column,
    evidence: list[Column], severity: Column | None = None, kind: Column | None = None,
) -> Column:
    leg, category, default, nature = CHECKS[code]
    sev = F.coalesce(severity, F.lit(default)) if severity is not None else F.lit(default)
    standard = F.when(result == "bloqueio", "bloqueio").when(result == "excecao", "lacuna_sanavel")
    return F.struct(
        F.lit(code).alias("codigo"),
        F.lit(leg).alias("perna"),
        result.alias("resultado"),
        sentence(compared, F.lit(base), ctx.today, found, verdict).alias("texto"),
        F.lit(base).alias("fonte"),
        F.lit(category).alias("categoria"),
        sev.alias("severidade"),
        F.lit(nature).alias("natureza"),
        (F.coalesce(kind, standard) if kind is not None else standard).alias("tipo_excecao"),
        F.to_json(F.struct(*evidence)).alias("evidencia_json"),
    )


def _verdict(result: Column) -> Column:
    return (
        F.when(result == "conforme", "item conforme na data da consulta")
        .when(result == "excecao", "excecao para conferencia humana antes do embarque")
        .otherwise("bloqueio: o talhao impede o embarque ate a resolucao")
    )


def _without_geometry(result: Column) -> Column:
    return F.when(~F.col("tem_geom"), F.lit("excecao")).otherwise(result)


def check_01(ctx: Context) -> Column:
    """Deforestation alerts after the cutoff; a point with under six decimals is an exception of severity F."""
    after = z("alertas_pos") > 0
    result = _without_geometry(F.when(after, "bloqueio").when(rough_point(), "excecao").otherwise("conforme"))
    reason = F.when(~F.col("tem_geom"), "sem_geometria").when(~after & rough_point(), "precisao_coordenada")
    return _row(
        ctx, "01", result,
        F.format_string("talhao %s contra alertas de desmatamento posteriores a %s", "nome", F.lit(ctx.params.cutoff)),
        "camada de alertas de desmatamento",
        F.format_string(
            "%d alerta(s) tocam o talhao, %d apos o corte, %.4f ha em comum", z("alertas"), z("alertas_pos"),
            z("alertas_area").cast("double") / 10000,
        ),
        _verdict(result),
        [
            z("alertas").alias("alertas_intersectados"), z("alertas_pos").alias("alertas_pos_corte"),
            round_half_up(z("alertas_area") / 10000, 4).alias("area_intersecao_ha"),
            reason.alias("motivo_excecao"), F.col("casas").alias("casas_decimais"),
        ],
        F.when(reason == "precisao_coordenada", "F"),
    )


def by_cpf_only() -> Column:
    return F.col("tem_geom") & (z("embargos") == 0) & (z("embargos_perto") == 0) & (z("termos_cpf") > 0)


def check_02(ctx: Context) -> Column:
    """Embargo by polygon and by CPF: overlap blocks, closeness or a CPF match elsewhere is an exception."""
    area = z("embargos_area") / 10000
    result = _without_geometry(
        F.when(z("embargos") > 0, "bloqueio").when((z("embargos_perto") > 0) | (z("termos_cpf") > 0), "excecao").otherwise("conforme")
    )
    reason = F.when(~F.col("tem_geom"), "sem_geometria").when(by_cpf_only(), "match_por_cpf_sem_intersecao")
    caveat = F.when(z("embargos_reconstruidos") > 0, "; ha geometria reconstruida a partir do ponto do termo").otherwise("")
    return _row(
        ctx, "02", result,
        F.format_string("talhao %s e CPF do produtor contra os termos de embargo", "nome"),
        f"termos de embargo, base de {ctx.base_date}",
        F.concat(
            F.format_string(
                "%d termo(s) sobre o talhao com %.4f ha, %d a menos de %.0f m, %d no mesmo CPF", z("embargos"),
                area.cast("double"), z("embargos_perto"), F.lit(ctx.params.embargo_near_m), z("termos_cpf"),
            ),
            caveat,
        ),
        _verdict(result),
        [
            z("embargos").alias("termos"), z("embargos_perto").alias("termos_perto"), F.col("embargo_tad").alias("num_tad"),
            round_half_up(area, 4).alias("area_intersecao_ha"),
            round_half_up(F.coalesce(ratio(area * 100, F.col("area_ha")), F.lit(0.0)), 2).alias("percentual_do_talhao"),
            round_half_up(F.col("embargo_dist"), 1).alias("distancia_minima_m"),
            z("embargos_avaliados").alias("embargos_avaliados"), z("termos_cpf").alias("termos_mesmo_cpf"),
            reason.alias("motivo_excecao"),
        ],
        F.when(by_cpf_only(), "F"),
    )


def registry_findings() -> Column:
    """Kinds of registry problems of a parcel (check 03)."""
    status = F.lower(F.trim(F.coalesce("car_situacao", F.lit(""))))
    has_docs = z("n_docs_car") > 0
    number = F.upper(F.trim(F.coalesce("car_numero", F.lit(""))))
    least = F.least("t_mincar", "p_mincar")
    kinds = [
        F.when(number == "", "sem_numero"),
        F.when(status.isin("cancelado", "suspenso"), "car_cancelado")
        .when(status == "pendente", "car_pendente")
        .when((status != "") & (status != "ativo"), "car_nao_ativo"),
        F.when(~has_docs, "sem_documento_car"),
        F.when(has_docs & (number != "") & (z("n_numeros_car") > 0) & ~F.coalesce("t_car", F.lit(False)), "numero_divergente"),
        F.when(
            has_docs & (F.col("cpf") != "") & ((F.col("cpf_car_min") != F.col("cpf")) | (F.col("cpf_car_max") != F.col("cpf"))),
            "titular_divergente",
        ),
        F.when(has_docs & (F.col("area_ha") > least * 1.02), "area_maior_que_car"),
    ]
    return F.array_compact(F.array(*kinds))


def check_03(ctx: Context) -> Column:
    """Land registry: number, status, document, holder and area."""
    found = registry_findings()
    result = F.when(F.size(found) > 0, "excecao").otherwise("conforme")
    grave = F.arrays_overlap(
        found, F.array(*map(F.lit, ("sem_numero", "car_cancelado", "sem_documento_car", "numero_divergente", "titular_divergente")))
    )
    pending_only = (F.size(found) == 1) & F.array_contains(found, "car_pendente")
    return _row(
        ctx, "03", result,
        F.format_string("numero, situacao, area e titular do CAR do talhao %s", "nome"),
        "cadastro do talhao e documentos de CAR do produtor",
        F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("cadastro coerente"),
        _verdict(result),
        [found.alias("achados"), F.col("car_situacao").alias("condicao_car"), z("n_docs_car").alias("documentos_car")],
        F.when(grave, "B").otherwise("F"),
        F.when(pending_only, "nao_sanavel_pelo_produtor"),
    )


def check_04(ctx: Context) -> Column:
    """Protected areas: any area of severity B blocks, the others are an exception."""
    grave = z("areas_b") > 0
    result = _without_geometry(F.when(grave, "bloqueio").when(z("areas") > 0, "excecao").otherwise("conforme"))
    return _row(
        ctx, "04", result,
        F.format_string("talhao %s contra terras indigenas, quilombos e unidades de conservacao", "nome"),
        "camada de areas protegidas",
        F.format_string(
            "%d area(s) sobrepostas, %d de severidade B, %.4f ha em comum", z("areas"), z("areas_b"),
            (z("areas_area") / 10000).cast("double"),
        ),
        _verdict(result),
        [
            z("areas").alias("areas"), z("areas_b").alias("areas_b"), z("areas_ti").alias("terra_indigena"),
            z("areas_uc").alias("unidade_conservacao"), round_half_up(z("areas_area") / 10000, 4).alias("area_intersecao_total_ha"),
        ],
        F.when(F.col("tem_geom") & (z("areas") > 0), F.when(grave, "B").otherwise("F")),
    )


def expected_volume(ctx: Context) -> Column:
    yields = F.lit(ctx.params.yield_kg_ha.get("PA"))
    for uf, value in ctx.params.yield_kg_ha.items():
        yields = F.when(F.coalesce("uf", F.lit(ctx.params.default_uf)) == uf, F.lit(value)).otherwise(yields)
    return z("area_ha") * F.coalesce(yields, F.lit(0.0))


def check_06(ctx: Context) -> Column:
    """Allocated volume against area times reference yield."""
    volume, expected = z("volume_kg"), expected_volume(ctx)
    r = ratio(volume, expected)
    result = (
        F.when(z("n_lotes") == 0, "conforme").when(expected == 0, "excecao")
        .when(r > ctx.params.volume_block, "bloqueio").when(r > ctx.params.volume_exception, "excecao").otherwise("conforme")
    )
    return _row(
        ctx, "06", result,
        F.format_string("volume de %.0f kg do talhao %s em %d lote(s)", volume.cast("double"), "nome", z("n_lotes")),
        "produtividade de referencia por UF",
        F.format_string("capacidade estimada de %.0f kg, razao %.3f", expected, F.coalesce(r, F.lit(0.0))),
        _verdict(result),
        [
            round_half_up(z("area_ha"), 4).alias("area_ha"), round_half_up(volume, 2).alias("volume_declarado_kg"),
            round_half_up(expected, 2).alias("volume_esperado_kg"), round_half_up(r, 3).alias("razao"), z("n_lotes").alias("lotes"),
        ],
    )


def check_07(ctx: Context) -> Column:
    """Deny-list over the producer and everyone who ships in the same lots."""
    listed = F.col("inscricao_propria").isNotNull() | (z("lotes_listados") > 0)
    result = F.when(listed, "bloqueio").otherwise("conforme")
    return _row(
        ctx, "07", result,
        F.format_string("CPF dos elos dos lotes do talhao %s, nunca o nome", "nome"),
        "cadastro de empregadores (lista suja)",
        F.format_string("%d lote(s) com elo inscrito, %d elo(s) sem CPF no maior lote", z("lotes_listados"), z("elos_sem_cpf")),
        _verdict(result),
        [
            F.coalesce("inscricao_propria", "inscricao_lote").alias("inscricao"), z("lotes_listados").alias("lotes_listados"),
            F.col("inscricao_propria").isNotNull().alias("produtor_inscrito"), z("elos_sem_cpf").alias("elos_sem_cpf"),
        ],
    )


def check_05(ctx: Context, rules: Column) -> Column:
    """Document consistency: any rule that fires, or no document at all, is an exception."""
    fired = F.filter(rules, lambda r: r["resultado"] != "conforme")
    codes = F.transform(fired, lambda r: r["codigo"])
    grave = F.exists(fired, lambda r: r["severidade"] == "B")
    result = F.when((F.size(fired) > 0) | (z("n_docs") == 0), "excecao").otherwise("conforme")
    return _row(
        ctx, "05", result,
        F.format_string("%d documento(s) do produtor entre si e com o talhao %s", z("n_docs"), "nome"),
        "documentos do produtor processados pela ingestao",
        F.format_string("%d regra(s) apontaram conflito: %s", F.size(fired), F.array_join(codes, ", ")),
        _verdict(result),
        [
            F.struct(
                codes.alias("regras_disparadas"),
                F.transform(F.filter(fired, lambda r: r["severidade"] == "B"), lambda r: r["codigo"]).alias("severidade_b"),
            ).alias("evidencia"),
            z("n_docs").alias("documentos_do_produtor"),
        ],
        F.when(grave, "B").otherwise("F"),
    )


SIMPLE = {"01": check_01, "02": check_02, "03": check_03, "04": check_04, "06": check_06, "07": check_07}


def with_checks(ctx: Context, codes: tuple[str, ...], detail: bool = True) -> DataFrame:
    """Wide parcel rows with one struct column ``cNN`` per requested check and ``regras``; ``detail``: with the rules' texts and evidence."""
    from plotproof.plans.rules import rule_column

    wanted = tuple(SIMPLE) if "05" in codes else codes
    parts = {p for c in codes for p in NEEDS[c]}
    wide = parcel_facts(ctx, tuple(sorted(parts)))
    wide = wide.withColumns({f"c{c}": SIMPLE[c](ctx) for c in wanted if c in SIMPLE})
    if "05" in codes:
        wide = wide.withColumn("regras", rule_column(ctx, detail)).withColumn("c05", check_05(ctx, F.col("regras")))
    return wide


def check_rows(ctx: Context, codes: tuple[str, ...]) -> DataFrame:
    """Check rows (parcel, code) of the requested checks."""
    wide = with_checks(ctx, codes)
    listed = wide.select("talhao_id", "produtor_id", F.explode(F.array(*[f"c{c}" for c in codes])).alias("c"))
    return listed.select("talhao_id", "produtor_id", "c.*")


def check_results(ctx: Context) -> DataFrame:
    """(parcel, code, result) of all seven checks, for a job that reads no text, evidence or rule row."""
    wide = with_checks(ctx, tuple(CHECKS), detail=False)
    rows = [F.struct(F.col(f"c{c}.codigo").alias("codigo"), F.col(f"c{c}.resultado").alias("resultado")) for c in sorted(CHECKS)]
    return wide.select("talhao_id", F.explode(F.array(*rows)).alias("c")).select("talhao_id", "c.*")


def verify(ctx: Context) -> DataFrame:
    """All seven checks and the rule details of every parcel, as ``checagem`` rows.

    Bad data gives flagged rows: every parse is lenient and a missing geometry
    or document is an exception, never a silent pass.
    """
    wide = with_checks(ctx, tuple(CHECKS))
    checks = F.array(*[f"c{c}" for c in sorted(CHECKS)])
    rules = F.transform(
        "regras",
        lambda r: F.struct(
            r["codigo"].alias("codigo"), F.lit("B").alias("perna"), r["resultado"].alias("resultado"),
            r["texto"].alias("texto"), F.concat(F.lit("regra "), r["codigo"]).alias("fonte"),
            r["categoria"].alias("categoria"), r["severidade"].alias("severidade"),
            F.lit("consistencia_documental").alias("natureza"), F.lit(None).cast("string").alias("tipo_excecao"),
            r["evidencia_json"].alias("evidencia_json"),
        ),
    )
    rows = wide.select("talhao_id", "produtor_id", F.explode(F.concat(checks, rules)).alias("c")).select(
        "talhao_id", "produtor_id", "c.*"
    )
    return rows.withColumn("data_execucao", ctx.today.cast("timestamp")).withColumn(
        "id", key_id("talhao_id", "codigo", F.col("data_execucao").cast("string"))
    )


def as_table(rows: DataFrame, seq: int = 0) -> DataFrame:
    """Conform check rows to the stored table; ``seq`` numbers the run."""
    return conform(rows.withColumn("seq", F.lit(seq).cast("long")), "checagem")


def worst(rows: DataFrame) -> DataFrame:
    """Worst aggregated check per parcel; rule details do not count twice."""
    from plotproof.operators.relational import worst_per_parcel

    return worst_per_parcel(rows.where(F.col("codigo").isin(*CHECKS)))


__all__ = ["check_results", "check_rows", "verify", "with_checks", "as_table", "worst", "result_rank"]
