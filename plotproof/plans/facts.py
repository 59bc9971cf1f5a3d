"""Facts the checks and rules read: one row per producer, parcel or geometry.

Documents of one producer are reduced to a single row before they meet its
parcels, and pairwise questions ("some receipt and some invoice disagree") are
answered from minima, maxima and date histograms, so no pair is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotproof.catalog import DOWNGRADED_AREAS, UNTYPED, Params
from plotproof.functions.dates import lenient_date
from plotproof.functions.geometry import min_decimals
from plotproof.functions.text import digits, fold_name
from plotproof.operators.latest import latest_by
from plotproof.operators.spatial import distinct_geometries, geometry_key, prepared, spatial_pairs
from plotproof.plans.context import Context
from plotproof.session import materialise

CAR_TYPES = ("car_recibo", "car_demonstrativo")
AREA_TYPES = ("car_recibo", "car_demonstrativo", "ccir", "sigef", "matricula_imovel", "itr")
R11_TYPES = ("car_recibo", "car_demonstrativo", "ccir", "sigef")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _span(c: Column, when: Column, name: str) -> list[Column]:
    value = F.when(when, _filled(c))
    return [F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]


# ---- producers -----------------------------------------------------------
def document_facts(d: DataFrame, params: Params) -> DataFrame:
    """One row per producer from one pass over its parsed documents."""
    tipo = F.col("tipo")
    typed = ~F.coalesce(tipo, F.lit("desconhecido")).isin(*UNTYPED)
    car, receipt, invoice = tipo.isin(*CAR_TYPES), tipo == "car_recibo", tipo == "nota_fiscal_produtor"
    contract, statement = tipo == "contrato_arrendamento", tipo == "car_demonstrativo"
    situacao = F.col("situacao")
    inactive = situacao.isin("cancelado", "suspenso") if params.r29_only_cancelled else (situacao != "ativo")
    essential = tipo.isin(*params.minimum_set)
    known = [t.name for t in params.types]
    holder = F.col("cpf_titular")
    uncited = (F.col("citado") == "") & (F.coalesce("talhao_id", F.lit("")) == "")
    return d.groupBy("produtor_id").agg(
        F.count("*").alias("n_docs"),
        F.collect_set(F.when(tipo.isin(*known), tipo)).alias("tipos"),
        F.count_if(receipt).alias("n_recibos"),
        F.count_if(invoice).alias("n_notas"),
        F.count_if(contract).alias("n_contratos"),
        F.count_if(car).alias("n_docs_car"),
        *_span(holder, receipt, "cpf_recibo"),
        *_span(F.col("cpf_emitente"), invoice, "cpf_nota"),
        *_span(holder, car, "cpf_car"),
        *_span(F.col("municipio"), tipo == "matricula_imovel", "mun_matricula"),
        *_span(F.col("municipio"), receipt, "mun_recibo"),
        *_span(F.col("arrendatario"), contract, "arrendatario"),
        F.count(F.when(car, _filled(F.col("numero_car")))).alias("n_numeros_car"),
        F.count_if(statement & (situacao != "") & inactive).alias("n_demos_inativos"),
        F.count_if(F.col("data_emissao") > F.col("data_validade")).alias("n_datas_invertidas"),
        F.count_if(essential & (F.col("status") == "ilegivel")).alias("n_ilegiveis"),
        F.count_if(essential & (F.col("status") == "divergente")).alias("n_divergentes"),
        F.min(F.when(typed, F.col("data_validade"))).alias("validade_min"),
        F.max(F.when(contract, F.col("vigencia_inicio"))).alias("inicio_max"),
        F.min(F.when(contract, F.col("vigencia_fim"))).alias("fim_min"),
        *_area_spans("p", uncited),
    )


def _area_spans(prefix: str, when: Column | None = None) -> list[Column]:
    """Declared areas: count and span per rule, over documents that qualify."""
    area = F.col("area")
    if when is not None:
        area = F.when(when, area)
    tipo = F.col("tipo")
    r11, r12 = F.when(tipo.isin(*R11_TYPES), area), F.when(tipo.isin(*AREA_TYPES), area)
    return [
        F.count(r11).alias(f"{prefix}_n11"),
        F.min(r11).alias(f"{prefix}_min11"),
        F.count(r12).alias(f"{prefix}_n12"),
        F.min(r12).alias(f"{prefix}_min12"),
        F.max(r12).alias(f"{prefix}_max12"),
        F.min(F.when(tipo.isin(*CAR_TYPES), area)).alias(f"{prefix}_mincar"),
    ]


def cpf_name_conflicts(docs: DataFrame) -> DataFrame:
    """(producer, CPF) pairs whose holder appears under several folded names."""
    pairs = docs.where("cpf_titular <> '' and com_nome")
    names = pairs.groupBy("produtor_id", F.col("cpf_titular").alias("cpf"), "proprietario").agg(F.count("*").alias("n"))
    per_cpf = names.groupBy("produtor_id", "cpf").agg(F.count("*").alias("nomes"), F.sum("n").alias("documentos"))
    return per_cpf.where("nomes > 1")


def repeated_invoices(docs: DataFrame) -> DataFrame:
    """(producer, number/series) carried by more than one invoice."""
    keyed = docs.where("tipo = 'nota_fiscal_produtor'").select("produtor_id", F.concat_ws("/", "numero", "serie").alias("nota"))
    counted = keyed.where(F.trim("nota", F.lit("/")) != "").groupBy("produtor_id", "nota").agg(F.count("*").alias("vezes"))
    return counted.where("vezes > 1")


def invoice_holder_conflicts(docs: DataFrame) -> DataFrame:
    """Number of receipt-invoice pairs with different CPFs per producer, without building the pairs.

    All pairs minus the pairs that agree on the CPF, from counts per CPF.
    """
    receipt = F.col("tipo") == "car_recibo"
    d = docs.where(F.col("tipo").isin("car_recibo", "nota_fiscal_produtor"))
    cpf = F.when(receipt, F.col("cpf_titular")).otherwise(F.col("cpf_emitente"))
    per_cpf = (
        d.select("produtor_id", cpf.alias("cpf"), receipt.alias("recibo")).where("cpf <> ''")
        .groupBy("produtor_id", "cpf").agg(F.count_if("recibo").alias("r"), F.count_if(~F.col("recibo")).alias("n"))
    )
    total = per_cpf.groupBy("produtor_id").agg(
        (F.sum("r") * F.sum("n") - F.sum(F.col("r") * F.col("n"))).alias("pares")
    )
    return total.where("pares > 0")


def _near_pairs(counts: DataFrame, keys: list[str], days: int) -> Column:
    """Unordered pairs at most ``days`` apart, from one row per key and day."""
    before = Window.partitionBy(*keys).orderBy("dia").rangeBetween(-days, -1)
    c = F.col("c")
    return (c * (c - 1)).cast("long") / 2 + c * F.coalesce(F.sum("c").over(before), F.lit(0))


def suspicious_duplicates(docs: DataFrame, params: Params) -> DataFrame:
    """Pairs of same-type documents, different numbers, dates close or missing, per producer.

    Counted exactly from histograms: near pairs of all documents minus near
    pairs that share the number, both from one row per day.
    """
    singles = [t.name for t in params.types if not t.multiple_expected]
    keyed = docs.where(F.col("tipo").isin(*singles) & (F.col("numero") != "")).select(
        "produtor_id", "tipo", F.col("numero").alias("num"), F.unix_date("data_emissao").alias("dia")
    )
    # Counted once and written: three questions are asked of it, and the documents are parsed for it.
    base = materialise(keyed.groupBy("produtor_id", "tipo", "num", "dia").agg(F.count("*").alias("c")), "numeros_por_dia")
    dated = base.where("dia is not null")
    by_day = dated.groupBy("produtor_id", "tipo", "dia").agg(F.sum("c").alias("c"))
    window = params.duplicate_window_days
    near = by_day.select("produtor_id", _near_pairs(by_day, ["produtor_id", "tipo"], window).alias("pares"))
    same = dated.select("produtor_id", (-_near_pairs(dated, ["produtor_id", "tipo", "num"], window)).alias("pares"))
    undated = base.groupBy("produtor_id", "tipo", "num").agg(
        F.sum(F.when(F.col("dia").isNull(), F.col("c")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("dia").isNotNull(), F.col("c")).otherwise(0)).alias("nd"),
    )
    own = lambda n0, nd: n0 * (n0 - 1) / 2 + n0 * nd
    loose = undated.groupBy("produtor_id", "tipo").agg(
        F.sum("n0").alias("s0"), F.sum("nd").alias("sd"), F.sum(own(F.col("n0"), F.col("nd"))).alias("iguais")
    )
    loose = loose.select("produtor_id", (own(F.col("s0"), F.col("sd")) - F.col("iguais")).alias("pares"))
    total = near.unionByName(same).unionByName(loose).groupBy("produtor_id").agg(F.sum("pares").cast("long").alias("pares"))
    return total.where("pares > 0")


def producer_facts(ctx: Context, conflicts: bool = True) -> DataFrame:
    """Producer columns plus all document facts, one row per producer; ``conflicts``: also counts of documents against documents."""
    p = ctx.produtor.select(
        F.col("id").alias("produtor_id"), F.col("nome").alias("produtor_nome"), F.upper("uf").alias("uf"),
        digits(F.col("cpf")).alias("cpf"),
    )
    facts = document_facts(ctx.docs, ctx.params)
    if not conflicts:
        return p.join(facts, "produtor_id", "left")
    r09 = cpf_name_conflicts(ctx.docs).groupBy("produtor_id").agg(F.count("*").alias("n_cpf_nomes"))
    r45 = repeated_invoices(ctx.docs).groupBy("produtor_id").agg(F.count("*").alias("n_notas_repetidas"))
    r46 = suspicious_duplicates(ctx.docs, ctx.params).select("produtor_id", F.col("pares").alias("n_duplicidades"))
    for part in (r09, r45, r46):
        facts = facts.join(part, "produtor_id", "left")
    return p.join(facts, "produtor_id", "left")


# ---- parcels -------------------------------------------------------------
def cited_facts(ctx: Context) -> DataFrame:
    """Per parcel: areas of the documents that cite it, and whether its registry number is documented."""
    d = ctx.docs
    ref = F.when(F.col("citado") != "", F.concat(F.lit("n:"), F.col("citado_norm"))).when(
        F.col("talhao_id") != "", F.concat(F.lit("t:"), F.col("talhao_id"))
    )
    number = F.col("numero_car")
    number_ref = F.when(F.col("tipo").isin(*CAR_TYPES) & (number != ""), F.concat(F.lit("c:"), number))
    areas = d.where(ref.isNotNull() & F.col("tipo").isin(*AREA_TYPES)).groupBy("produtor_id", ref.alias("ref")).agg(
        *_area_spans("t"), F.lit(False).alias("t_car")
    )
    numbers = d.where(number_ref.isNotNull()).groupBy("produtor_id", number_ref.alias("ref")).agg(F.lit(True).alias("t_car"))
    known = areas.unionByName(numbers, allowMissingColumns=True)
    t = ctx.talhao.select(
        F.col("id").alias("talhao_id"), "produtor_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(F.lit("n:"), fold_name(F.col("nome"))), F.concat(F.lit("t:"), F.col("id")),
                    F.concat(F.lit("c:"), F.upper(F.trim("car_numero"))),
                )
            )
        ).alias("ref"),
    )
    joined = t.join(known, ["produtor_id", "ref"])
    return joined.groupBy("talhao_id").agg(
        F.sum("t_n11").alias("t_n11"), F.min("t_min11").alias("t_min11"), F.sum("t_n12").alias("t_n12"),
        F.min("t_min12").alias("t_min12"), F.max("t_max12").alias("t_max12"), F.min("t_mincar").alias("t_mincar"),
        F.max("t_car").alias("t_car"),
    )


def deny_list(lista: DataFrame, order: tuple[str, ...] = ("arquivo", "linha")) -> DataFrame:
    """Deny-list by digits-only key: blanks skipped, the last row of a key wins, by file and place."""
    keyed = lista.withColumn("cpf", digits(F.col("cpf_cnpj"))).where("cpf <> ''").drop("cpf_cnpj")
    return latest_by(keyed, ["cpf"], [c for c in order if c in keyed.columns])


def lot_denied(ctx: Context) -> DataFrame:
    """Per lot: linked producers, those without CPF, those on the deny-list.

    A lot is one row here, so the two-hop question "does any producer sharing a
    lot with this parcel appear on the list" never expands to pairs.
    """
    everyone = ctx.talhao if ctx.vinculos is None else ctx.vinculos
    links = ctx.lote_talhao.join(
        everyone.select(F.col("id").alias("talhao_id"), "produtor_id"), "talhao_id"
    ).select("lote_id", "produtor_id").distinct()
    people = ctx.produtor.select(F.col("id").alias("produtor_id"), digits(F.col("cpf")).alias("cpf"))
    listed = deny_list(ctx.lista_suja).select("cpf", "numero_inscricao")
    person = people.join(listed, "cpf", "left")
    return links.join(person, "produtor_id").groupBy("lote_id").agg(
        F.count("*").alias("elos"),
        F.count_if(F.col("cpf") == "").alias("elos_sem_cpf"),
        F.count("numero_inscricao").alias("elos_listados"),
        F.min("numero_inscricao").alias("inscricao"),
    )


def allocation_facts(ctx: Context, denied: bool = True) -> DataFrame:
    """Per parcel: allocated kg, lots, shipping span, deny-list hits of its lots."""
    lots = ctx.lote.select(F.col("id").alias("lote_id"), "data_embarque")
    extra = []
    if denied:
        lots = lots.join(lot_denied(ctx), "lote_id", "left")
        extra = [
            F.count_if(F.col("elos_listados") > 0).alias("lotes_listados"),
            F.max("elos").alias("elos_max"),
            F.max("elos_sem_cpf").alias("elos_sem_cpf"),
            F.min("inscricao").alias("inscricao_lote"),
        ]
    return ctx.lote_talhao.join(lots, "lote_id").groupBy("talhao_id").agg(
        F.sum(F.coalesce("quantidade_kg", F.lit(0.0))).alias("volume_kg"),
        F.count("*").alias("n_lotes"),
        F.min("data_embarque").alias("embarque_min"),
        F.max("data_embarque").alias("embarque_max"),
        *extra,
    )


# ---- layers ----------------------------------------------------------------
def area_severity(tipo: Column, categoria: Column) -> Column:
    """F for a downgraded category of that area type, else B."""
    kind, category = F.lower(F.trim(tipo)), F.lower(F.trim(F.coalesce(categoria, F.lit(""))))
    out = F.lit("B")
    for name, downgraded in DOWNGRADED_AREAS.items():
        out = F.when((kind == name) & category.isin(*downgraded), "F").otherwise(out)
    return out


def layer_geometries(ctx: Context, layers: tuple[str, ...]) -> DataFrame:
    """Distinct geometries of the layers with counts of the rows that share each."""
    parts = []
    if "alerta" in layers:
        after = lenient_date(F.col("data_deteccao")) > F.to_date(F.lit(ctx.params.cutoff))
        parts.append(
            ctx.alerta.select(
                F.lit("alerta").alias("layer"), "geom_wkt", F.lit(1).alias("n"), after.cast("int").alias("n_pos"),
                F.when(after, F.col("id_alerta")).alias("rotulo"),
            )
        )
    if "embargo" in layers:
        parts.append(
            ctx.embargo.select(
                F.lit("embargo").alias("layer"), "geom_wkt", F.lit(1).alias("n"),
                F.coalesce("NUM_TAD", F.lit("sem numero")).alias("rotulo"),
                F.lower("origem_geometria").contains("buffer").cast("int").alias("n_reconstruido"),
            )
        )
    if "protegida" in layers:
        severity = area_severity(F.col("tipo_area"), F.col("categoria_area"))
        ti, uc = F.col("tipo_area") == "terra_indigena", F.col("tipo_area") == "unidade_conservacao"
        parts.append(
            ctx.protegida.select(
                F.lit("protegida").alias("layer"), "geom_wkt", F.lit(1).alias("n"), F.col("nome_area").alias("rotulo"),
                (severity == "B").cast("int").alias("n_b"),
                ti.cast("int").alias("n_ti"), (ti & (severity == "B")).cast("int").alias("n_ti_b"),
                uc.cast("int").alias("n_uc"), (uc & (severity == "B")).cast("int").alias("n_uc_b"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    counters = [c for c in rows.columns if c.startswith("n")]
    grouped = rows.where(F.col("geom_wkt").isNotNull()).groupBy(
        "layer", geometry_key("geom_wkt").alias("gkey"), F.col("geom_wkt").alias("_wkt")
    ).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters], F.min("rotulo").alias("rotulo")
    )
    return prepared(grouped, ctx.crs)


def layer_pairs(ctx: Context, layers: tuple[str, ...]) -> DataFrame:
    """Measured (parcel geometry, layer geometry) pairs of all layers in one spatial join."""
    left = distinct_geometries(ctx.talhao, "geom_wkt", ctx.crs)
    right = layer_geometries(ctx, layers)
    reach = 2 * ctx.params.embargo_near_m
    radius = F.when(F.col("layer") == "embargo", F.lit(reach)).otherwise(F.lit(0.0))
    return left, spatial_pairs(left, right, radius, ctx.cell, ctx.box_shortcut)


def geometry_facts(ctx: Context, layers: tuple[str, ...] = ("alerta", "embargo", "protegida")) -> DataFrame:
    """One row per readable parcel geometry with the findings of every layer."""
    left, pairs = layer_pairs(ctx, layers)
    keep = [c for c in pairs.columns if c.startswith("r_")] + ["intersects", "area", "distance"]
    rows = left.select(F.col("gkey").alias("l_gkey")).unionByName(
        pairs.select("l_gkey", *keep), allowMissingColumns=True
    )
    out = [F.lit(True).alias("tem_geom")]
    n, hit, area = F.col("r_n"), F.col("intersects"), F.col("area")

    def total(when: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0))

    if "alerta" in layers:
        alert = (F.col("r_layer") == "alerta") & hit
        out += [
            total(alert, n).alias("alertas"),
            total(alert, F.col("r_n_pos")).alias("alertas_pos"),
            total(alert, area * F.col("r_n_pos")).alias("alertas_area"),
            F.min(F.when(alert, F.col("r_rotulo"))).alias("alerta_id"),
        ]
    if "embargo" in layers:
        near = F.col("r_layer") == "embargo"
        close = near & (F.col("distance") < ctx.params.embargo_near_m)
        out += [
            total(near & hit, n).alias("embargos"),
            total(near & hit, area * n).alias("embargos_area"),
            total(close, n).alias("embargos_perto"),
            total(near, n).alias("embargos_avaliados"),
            F.min(F.when(near, F.col("distance"))).alias("embargo_dist"),
            F.min(F.when(near & hit, F.col("r_rotulo"))).alias("embargo_tad"),
            total(close, F.col("r_n_reconstruido")).alias("embargos_reconstruidos"),
        ]
    if "protegida" in layers:
        inside = (F.col("r_layer") == "protegida") & hit
        out += [total(inside, n).alias("areas"), total(inside, area * n).alias("areas_area")]
        out += [total(inside, F.col(f"r_{c}")).alias(f"areas_{c[2:]}") for c in ("n_b", "n_ti", "n_ti_b", "n_uc", "n_uc_b")]
    return rows.groupBy(F.col("l_gkey").alias("gkey")).agg(*out)


def embargo_terms_by_cpf(embargo: DataFrame) -> DataFrame:
    """Embargo terms per digits-only key over the whole layer."""
    keyed = embargo.withColumn("cpf", digits(F.col("CPF_CNPJ_EMBARGADO"))).where("cpf <> ''")
    return keyed.groupBy("cpf").agg(F.count("*").alias("termos_cpf"), F.min("NUM_TAD").alias("tad_cpf"))


def parcel_facts(ctx: Context, parts: tuple[str, ...]) -> DataFrame:
    """Wide parcel row with the requested groups of facts.

    ``parts``: ``docs``, ``conflicts`` (of docs), ``cited``, ``lots``, ``denied``, ``alerta``, ``embargo``, ``protegida``.
    """
    t = ctx.talhao.select(
        F.col("id").alias("talhao_id"), "produtor_id", "nome", "area_ha", "geom_wkt",
        F.lower(F.trim("tipo_geom")).alias("tipo_geom"), "car_numero", "car_situacao",
    )
    layers = tuple(p for p in parts if p in ("alerta", "embargo", "protegida"))
    if layers:
        t = t.withColumn("gkey", geometry_key("geom_wkt")).join(geometry_facts(ctx, layers), "gkey", "left")
        t = t.withColumn("tem_geom", F.coalesce("tem_geom", F.lit(False))).withColumn("casas", min_decimals(F.col("geom_wkt")))
    t = t.drop("geom_wkt", "gkey")
    if "lots" in parts or "denied" in parts:
        t = t.join(allocation_facts(ctx, "denied" in parts), "talhao_id", "left")
    if "cited" in parts:
        t = t.join(cited_facts(ctx), "talhao_id", "left")
    if "docs" in parts:
        people = producer_facts(ctx, "conflicts" in parts)
    else:
        people = ctx.produtor.select(
            F.col("id").alias("produtor_id"), F.col("nome").alias("produtor_nome"), F.upper("uf").alias("uf"),
            digits(F.col("cpf")).alias("cpf"),
        )
    if "embargo" in parts:
        people = people.join(embargo_terms_by_cpf(ctx.embargo), "cpf", "left")
    if "denied" in parts:
        own = deny_list(ctx.lista_suja).select("cpf", F.col("numero_inscricao").alias("inscricao_propria"))
        people = people.join(own, "cpf", "left")
    return t.join(people, "produtor_id", "left")


# ---- (parcel, lot) date comparisons ------------------------------------------
def count_earlier(dates: DataFrame, probes: DataFrame, inclusive: bool = False) -> DataFrame:
    """For each distinct (producer, day) probe: how many dates of that producer lie before it, and the first of them.

    ``dates``: produtor_id, dia. ``probes``: produtor_id, dia. Both shrink to one
    row per producer and day, so the running sum is bounded by the calendar.
    """
    hist = dates.where("dia is not null").groupBy("produtor_id", "dia").agg(F.count("*").alias("c"))
    asked = probes.select("produtor_id", "dia").where("dia is not null").distinct()
    rows = hist.select("produtor_id", "dia", "c", F.lit(0 if inclusive else 1).alias("o")).unionByName(
        asked.select("produtor_id", "dia", F.lit(0).cast("long").alias("c"), F.lit(1 if inclusive else 0).alias("o"))
    )
    probe_order = 1 if inclusive else 0
    running = Window.partitionBy("produtor_id").orderBy("dia", "o").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("o") != probe_order, F.col("dia"))).over(running)
    counted = rows.withColumns({"antes": F.sum("c").over(running), "primeira": first}).where(F.col("o") == probe_order)
    return counted.select("produtor_id", "dia", "antes", "primeira")


def shipments(ctx: Context) -> DataFrame:
    """(parcel, lot, producer, shipping day)."""
    lots = ctx.lote.select(F.col("id").alias("lote_id"), F.col("data_embarque").alias("dia"))
    owner = ctx.talhao.select(F.col("id").alias("talhao_id"), "produtor_id")
    return ctx.lote_talhao.select("lote_id", "talhao_id").join(owner, "talhao_id").join(lots, "lote_id").where("dia is not null")


def expired_at_shipping(ctx: Context) -> DataFrame:
    """Per (parcel, lot): documents expired before shipping and the longest delay in days."""
    typed = ctx.fields("produtor_id", "tipo", "data_validade").where(~F.coalesce("tipo", F.lit("desconhecido")).isin(*UNTYPED))
    dates = typed.select("produtor_id", F.col("data_validade").alias("dia"))
    ship = shipments(ctx)
    out = ship.join(count_earlier(dates, ship).where("antes > 0"), ["produtor_id", "dia"])
    return out.select(
        "talhao_id", "lote_id", F.col("antes").alias("vencidos"), F.datediff("dia", "primeira").alias("dias_de_atraso")
    )


def contracts_outside_validity(ctx: Context) -> DataFrame:
    """Per (parcel, lot): lease contracts whose validity does not cover the shipping day."""
    c = ctx.fields("produtor_id", "tipo", "vigencia_inicio", "vigencia_fim").where("tipo = 'contrato_arrendamento'").select(
        "produtor_id", F.col("vigencia_inicio").alias("ini"), F.col("vigencia_fim").alias("fim")
    )
    # Read four times below; documents are parsed for it once.
    c = materialise(c, "contratos")
    swapped = F.coalesce(F.col("ini") > F.col("fim"), F.lit(False))
    never = c.where(swapped).groupBy("produtor_id").agg(F.count("*").alias("nunca"))
    regular = c.where(~swapped)
    ship = shipments(ctx)
    started = count_earlier(regular.select("produtor_id", F.col("ini").alias("dia")), ship, inclusive=True).drop("primeira")
    ended = count_earlier(regular.select("produtor_id", F.col("fim").alias("dia")), ship).drop("primeira")
    with_start = regular.groupBy("produtor_id").agg(F.count("ini").alias("com_inicio"))
    out = (
        ship.join(started.withColumnRenamed("antes", "iniciados"), ["produtor_id", "dia"], "left")
        .join(ended.withColumnRenamed("antes", "terminados"), ["produtor_id", "dia"], "left")
        .join(with_start, "produtor_id", "left").join(never, "produtor_id", "left")
    )
    z = lambda n: F.coalesce(n, F.lit(0))
    count = z("com_inicio") - z("iniciados") + z("terminados") + z("nunca")
    return out.select("talhao_id", "lote_id", count.alias("contratos_fora")).where("contratos_fora > 0")
