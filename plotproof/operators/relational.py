"""Joins, aggregates, top-k and lookups over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotproof.functions import report
from plotproof.operators.latest import latest_checks
from plotproof.operators.ranking import positions_by_range
from plotproof.schemas import equal_filter



def nonconforming():
    return F.col("resultado") != "conforme"


# ---- lookups and lists ---------------------------------------------------
def find(df: DataFrame, **keys) -> DataFrame:
    return equal_filter(df, **keys).limit(1)


def listing(df: DataFrame, order: list | None = None, **filters) -> DataFrame:
    out = equal_filter(df, **filters)
    return out.orderBy(*order) if order else out


def find_lots(lote: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lots for given references: the id wins, else the code."""
    by_id = lote.select(F.col("id").alias("ref"), F.col("id").alias("por_id"))
    by_code = lote.groupBy(F.col("codigo").alias("ref")).agg(F.min("id").alias("por_codigo"))
    joined = wanted.join(by_id, "ref", "left").join(by_code, "ref", "left")
    return joined.select("ref", F.coalesce("por_id", "por_codigo").alias("lote_id"))


def adhoc(spark, views: dict[str, DataFrame], text: str, **args) -> DataFrame:
    """Read-only SQL with named parameters over temporary views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)


# ---- parcels, lots, producers --------------------------------------------
def parcels_of_lots(talhao: DataFrame, lote_talhao: DataFrame) -> DataFrame:
    bridge = lote_talhao.select("lote_id", F.col("talhao_id").alias("id"), F.col("quantidade_kg").alias("kg_no_lote"))
    return bridge.join(talhao, "id")


def lots_of_parcels(lote: DataFrame, lote_talhao: DataFrame) -> DataFrame:
    return lote_talhao.select("talhao_id", F.col("lote_id").alias("id")).join(lote, "id")


def producers_of_lots(talhao: DataFrame, lote_talhao: DataFrame) -> DataFrame:
    """Distinct (lot, producer) links, dealt out by producer: those who read them go on from there."""
    owner = talhao.select(F.col("id").alias("talhao_id"), "produtor_id")
    return lote_talhao.join(owner, "talhao_id").select("lote_id", "produtor_id").repartition("produtor_id").distinct()


def parcels_outside_lots(talhao: DataFrame, lote_talhao: DataFrame) -> DataFrame:
    return talhao.join(lote_talhao.select(F.col("talhao_id").alias("id")), "id", "left_anti")


def producers_outside_lots(produtor: DataFrame, talhao: DataFrame, lote_talhao: DataFrame, n: int = 2) -> DataFrame:
    """First ``n`` producers by id, with an id number, that ship in no lot."""
    inside = producers_of_lots(talhao, lote_talhao).select(F.col("produtor_id").alias("id"))
    free = produtor.where(F.length(F.regexp_replace(F.coalesce("cpf", F.lit("")), r"\D", "")) > 0)
    return free.join(inside, "id", "left_anti").orderBy("id").limit(n)


def allocations(lote_talhao: DataFrame, lote: DataFrame) -> DataFrame:
    """Every allocation of a parcel with the code and shipping date of its lot; one of an unknown lot has neither."""
    lots = lote.select(F.col("id").alias("lote_id"), F.col("codigo").alias("lote_codigo"), "data_embarque")
    return lote_talhao.select("talhao_id", "lote_id", "quantidade_kg").join(lots, "lote_id", "left")


def allocation_totals(lote_talhao: DataFrame, lote: DataFrame) -> DataFrame:
    """Allocated kg, lots and shipping span of each parcel, one pass over the bridge."""
    lots = lote.select(F.col("id").alias("lote_id"), "data_embarque")
    return (
        lote_talhao.join(lots, "lote_id")
        .groupBy("talhao_id")
        .agg(
            F.sum(F.coalesce("quantidade_kg", F.lit(0.0))).alias("volume_kg"),
            F.count("*").alias("n_lotes"),
            F.min("data_embarque").alias("embarque_min"),
            F.max("data_embarque").alias("embarque_max"),
        )
    )


def lot_totals(talhao: DataFrame, lote_talhao: DataFrame) -> DataFrame:
    joined = parcels_of_lots(talhao.select("id", "produtor_id", "area_ha"), lote_talhao)
    by_producer = joined.groupBy("lote_id", "produtor_id").agg(
        F.count("*").alias("n"), F.sum("area_ha").alias("area"), F.sum("kg_no_lote").alias("kg")
    )
    return by_producer.groupBy("lote_id").agg(
        F.sum("n").alias("talhoes"), F.count("*").alias("produtores"),
        F.sum("area").alias("area_ha"), F.sum("kg").alias("kg"),
    )


def producers_in_many_lots(links: DataFrame, at_least: int = 3) -> DataFrame:
    return links.groupBy("produtor_id").agg(F.count("*").alias("lotes")).where(F.col("lotes") >= at_least)


def largest_shared_parcel(talhao: DataFrame, lote_talhao: DataFrame, at_least: int = 3) -> DataFrame:
    shared = (
        lote_talhao.select("talhao_id", "lote_id").distinct().groupBy("talhao_id").agg(F.count("*").alias("lotes"))
        .where(F.col("lotes") >= at_least)
    )
    joined = talhao.join(shared, talhao["id"] == shared["talhao_id"]).select("id", "area_ha", "lotes")
    return joined.orderBy(F.desc("area_ha"), "id").limit(1)


# ---- results -------------------------------------------------------------
def result_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("codigo").pivot("resultado", list(report.RESULT_RANK)).count().na.fill(0)


def worst_per_parcel(checks: DataFrame) -> DataFrame:
    worst = checks.groupBy("talhao_id").agg(F.max(report.result_rank(F.col("resultado"))).alias("posto"))
    return worst.select("talhao_id", "posto", report.result_name(F.col("posto")).alias("pior"))


def lot_status(lote: DataFrame, lote_talhao: DataFrame, current: DataFrame) -> DataFrame:
    """Status of every lot by its worst parcel, with counts and the previous status.

    Parcels are reduced to one rank before the bridge, and lots to one row of
    counters during the shuffle, so no lot is gathered in one place.
    """
    parcel = worst_per_parcel(current).select("talhao_id", "posto")
    ranked = lote_talhao.select("lote_id", "talhao_id").join(parcel, "talhao_id", "left")
    rank = F.coalesce("posto", F.lit(0))
    counts = ranked.groupBy("lote_id").agg(
        F.max(rank).alias("posto"),
        F.count("*").alias("talhoes"),
        F.count_if(rank == 0).alias("conformes"),
        F.count_if(rank == 1).alias("em_excecao"),
        F.count_if(rank == 2).alias("bloqueados"),
    )
    joined = lote.select(F.col("id").alias("lote_id"), "codigo", F.col("status").alias("status_anterior")).join(
        counts, "lote_id", "left"
    )
    return joined.select(
        "lote_id", "codigo", "status_anterior",
        report.status_name(F.coalesce("posto", F.lit(0))).alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("talhoes", "conformes", "em_excecao", "bloqueados")],
    )


def status_changes(status: DataFrame) -> DataFrame:
    """Lots whose status moved, worse or better."""
    rank = lambda c: report.lookup(F.col(c), report.STATUS_RANK, 0)
    moved = status.where(~F.col("status").eqNullSafe(F.col("status_anterior")))
    return moved.withColumn(
        "sentido", F.when(rank("status") > rank("status_anterior"), "piorou").otherwise("melhorou")
    )


def leg_findings(lote_talhao: DataFrame, current: DataFrame) -> DataFrame:
    """Worst result and number of findings per lot and leg."""
    known = current.withColumn("perna", F.coalesce("perna", F.lit("B"))).where(F.col("perna").isin("A", "B"))
    parcel = known.groupBy("talhao_id", "perna").agg(
        F.max(report.result_rank(F.col("resultado"))).alias("posto"), F.count_if(nonconforming()).alias("achados")
    )
    lots = lote_talhao.select("lote_id", "talhao_id").join(parcel, "talhao_id")
    out = lots.groupBy("lote_id", "perna").agg(F.max("posto").alias("posto"), F.sum("achados").alias("achados"))
    return out.select("lote_id", "perna", report.result_name(F.col("posto")).alias("pior"), "achados")


def fired_rules(check_05: DataFrame, field: str = "$.evidencia.regras_disparadas") -> DataFrame:
    """How many check rows name each rule in their evidence JSON, by rule number."""
    fired = F.from_json(F.get_json_object("evidencia_json", field), "array<string>")
    exploded = check_05.select(F.explode(fired).alias("regra"))
    counts = exploded.groupBy("regra").agg(F.count("*").alias("talhoes"))
    return counts.orderBy(F.coalesce(F.regexp_extract("regra", r"\d+", 0).try_cast("int"), F.lit(999)))


# ---- audit log -----------------------------------------------------------
def autonomy_counters(evento: DataFrame, excecao: DataFrame) -> DataFrame:
    """Four live counters in one pass over each table."""
    acts = evento.agg(
        F.count_if(F.col("acao") == "checagem_executada").alias("verificacoes_executadas"),
        F.count_if(F.col("acao") == "documento_processado").alias("documentos_processados"),
        F.count_if(F.col("acao") == "dossie_gerado").alias("dossies_regerados"),
    )
    # One aggregated row on each side.
    pending = excecao.agg(F.count_if(F.col("status") == "aberta").alias("excecoes_para_humano"))
    return acts.withColumn("_", F.lit(1)).join(pending.withColumn("_", F.lit(1)), "_").drop("_")


def last_events(evento: DataFrame, n: int = 200) -> DataFrame:
    return evento.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def documents_in_order(documento: DataFrame) -> DataFrame:
    """All documents of every producer with their position by file, then id."""
    return positions_by_range(documento, ["produtor_id"], ["arquivo_origem", "id"], "posicao")


def top_per_group(df: DataFrame, group: list[str], order: list, n) -> DataFrame:
    """First ``n`` rows per group; Spark prunes to ``n`` per task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("posicao", F.row_number().over(window)).where(F.col("posicao") <= n)


def exception_lots(excecao: DataFrame, lote: DataFrame, lote_talhao: DataFrame) -> DataFrame:
    """Lots of each exception: the listed ones that exist, else those of its parcel."""
    known = lote.select(F.col("id").alias("lote_id"))
    listed = (
        excecao.select(F.col("id").alias("excecao_id"), F.explode("lotes_afetados").alias("lote_id"))
        .distinct().join(known, "lote_id")
    )
    without = excecao.join(listed.select(F.col("excecao_id").alias("id")).distinct(), "id", "left_anti")
    via = (
        without.where(F.col("talhao_id").isNotNull())
        .select(F.col("id").alias("excecao_id"), "talhao_id")
        .join(lote_talhao.select("talhao_id", "lote_id"), "talhao_id").join(known, "lote_id")
    )
    return listed.select("excecao_id", "lote_id").unionByName(via.select("excecao_id", "lote_id"))


def exceptions_of_lots(
    excecao: DataFrame, lote_talhao: DataFrame, links: DataFrame, documento: DataFrame
) -> DataFrame:
    """(lot, exception) pairs: parcel in the lot, document of a producer in it, or lot listed."""
    e = excecao.select("id", "talhao_id", "documento_id", "lotes_afetados")
    by_parcel = e.join(lote_talhao.select("talhao_id", "lote_id"), "talhao_id").select("lote_id", "id")
    of_doc = e.where(F.col("documento_id").isNotNull()).join(
        documento.select(F.col("id").alias("documento_id"), "produtor_id"), "documento_id"
    )
    by_doc = of_doc.join(links, "produtor_id").select("lote_id", "id")
    by_list = e.select(F.explode("lotes_afetados").alias("lote_id"), "id")
    pairs = by_parcel.unionByName(by_doc).unionByName(by_list)
    return pairs.distinct().withColumnRenamed("id", "excecao_id")


def next_versions(lote: DataFrame, dossie: DataFrame) -> DataFrame:
    last = dossie.groupBy("lote_id").agg(F.max("versao").alias("versao_anterior"))
    joined = lote.select(F.col("id").alias("lote_id")).join(last, "lote_id", "left")
    return joined.withColumn("proxima", F.coalesce("versao_anterior", F.lit(0)) + 1)


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("linhas")).select(F.lit(n).alias("tabela"), "linhas") for n, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def current_checks_with_name(checagem: DataFrame, talhao: DataFrame) -> DataFrame:
    names = talhao.select(F.col("id").alias("talhao_id"), "nome", "produtor_id")
    return latest_checks(checagem).join(names, "talhao_id")
