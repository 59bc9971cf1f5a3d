"""The documents behind a rule, the terms behind a CPF match, the lots behind a volume.

A rule that compares documents with each other fires by least and greatest values. Here
these carry the ids of their documents along, so a conflict is named by two of them
without building pairs; what is named is itself a pair in conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotproof.functions.text import digits
from plotproof.plans.context import Context

#: Fields of the documents that :func:`rule_documents` reads.
FIELDS = ("id", "produtor_id", "tipo", "data_emissao", "data_validade", "cpf_titular", "cpf_emitente", "municipio", "proprietario", "com_nome", "numero", "serie")
ROW = ("produtor_id", "regra", "documento_id", "outro_id", "valor", "outro_valor")


def _ends(value: Column, when: Column, name: str) -> list[Column]:
    """Document with the least and with the greatest value among those that qualify; ties by id."""
    filled = F.when(when & (value != ""), F.struct(value.alias("v"), F.col("id").alias("id")))
    return [F.min(filled).alias(f"{name}_lo"), F.max(filled).alias(f"{name}_hi")]


def _named(rule: str, a: Column, b: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("regra"), a["id"].alias("documento_id"), b["id"].alias("outro_id"),
        a["v"].cast("string").alias("valor"), b["v"].cast("string").alias("outro_valor"),
    )


def _unlike(rule: str, a: str, b: str) -> Column:
    """Two documents of kinds ``a`` and ``b`` whose values differ; null when all agree."""
    lo, hi = (lambda n: F.col(f"{n}_lo")), (lambda n: F.col(f"{n}_hi"))
    first = lo(a)["v"] != hi(b)["v"]
    return F.when(first, _named(rule, lo(a), hi(b))).when(hi(a)["v"] != lo(b)["v"], _named(rule, hi(a), lo(b)))


def _between_kinds(docs: DataFrame) -> DataFrame:
    """R01 and R21: values of two kinds of documents. R32: a document issued after its expiry."""
    tipo = F.col("tipo")
    inverted = F.when(F.col("data_emissao") > F.col("data_validade"), F.struct(F.col("data_validade").alias("v"), F.col("id").alias("id")))
    ends = docs.groupBy("produtor_id").agg(
        *_ends(F.col("cpf_titular"), tipo == "car_recibo", "recibo"), *_ends(F.col("cpf_emitente"), tipo == "nota_fiscal_produtor", "nota"),
        *_ends(F.col("municipio"), tipo == "matricula_imovel", "matricula"), *_ends(F.col("municipio"), tipo == "car_recibo", "car"),
        F.min(inverted).alias("invertido"),
    )
    none = F.struct(F.lit(None).cast("string").alias("v"), F.lit(None).cast("string").alias("id"))
    single = F.when(F.col("invertido").isNotNull(), _named("R32", F.col("invertido"), none))
    found = F.array_compact(F.array(_unlike("R01", "recibo", "nota"), _unlike("R21", "matricula", "car"), single))
    return ends.select("produtor_id", F.inline(found)).select(*ROW)


def _within_groups(docs: DataFrame) -> DataFrame:
    """R09: a CPF under two names. R45: an invoice number and series carried twice. Of several, the least."""
    who = docs.where("cpf_titular <> '' and com_nome").groupBy("produtor_id", F.col("cpf_titular").alias("chave"))
    names = who.agg(*_ends(F.col("proprietario"), F.lit(True), "x")).where("x_lo.v <> x_hi.v").withColumn("regra", F.lit("R09"))
    note = F.concat_ws("/", "numero", "serie")
    notes = docs.where("tipo = 'nota_fiscal_produtor'").where(F.trim(note, F.lit("/")) != "").groupBy("produtor_id", note.alias("chave"))
    same = notes.agg(F.min(F.struct(note.alias("v"), "id")).alias("x_lo"), F.max(F.struct(note.alias("v"), "id")).alias("x_hi"), F.count("*").alias("n"))
    same = same.where("n > 1").drop("n").withColumn("regra", F.lit("R45"))
    both = names.unionByName(same)
    least = both.groupBy("produtor_id", "regra").agg(F.min(F.struct("chave", "x_lo", "x_hi")).alias("m"))
    return least.select(
        "produtor_id", "regra", F.col("m.x_lo.id").alias("documento_id"), F.col("m.x_hi.id").alias("outro_id"),
        F.col("m.x_lo.v").alias("valor"), F.col("m.x_hi.v").alias("outro_valor"),
    )


def _close_in_time(docs: DataFrame, params) -> DataFrame:
    """R46: documents of one type with different numbers, days apart no more than the window.

    If any two such documents are that close, two neighbours in the order of days are. An undated
    one is close to all of its type.
    """
    singles = [t.name for t in params.types if not t.multiple_expected]
    keyed = docs.where(F.col("tipo").isin(*singles) & (F.col("numero") != "")).select("produtor_id", "tipo", "numero", "data_emissao", "id")
    order = Window.partitionBy("produtor_id", "tipo").orderBy("data_emissao", "numero", "id")
    before = F.lag(F.struct(F.col("numero").alias("v"), F.col("id").alias("id"), "data_emissao")).over(order)
    pairs = keyed.where("data_emissao is not null").withColumn("_a", before)
    near = pairs.where((F.col("_a.v") != F.col("numero")) & (F.datediff("data_emissao", "_a.data_emissao") <= params.duplicate_window_days))
    dated = near.select("produtor_id", "tipo", F.lit(0).alias("_p"), F.struct("_a.v", "_a.id").alias("a"), F.struct(F.col("numero").alias("v"), "id").alias("b"))
    one = F.struct(F.col("numero").alias("v"), F.col("id").alias("id"))
    ends = keyed.groupBy("produtor_id", "tipo").agg(F.min(F.when(F.col("data_emissao").isNull(), one)).alias("a"), F.min(one).alias("lo"), F.max(one).alias("hi"))
    other = F.when(F.col("hi.v") != F.col("a.v"), F.col("hi")).when(F.col("lo.v") != F.col("a.v"), F.col("lo"))
    undated = ends.select("produtor_id", "tipo", F.lit(1).alias("_p"), "a", other.alias("b")).where("a is not null and b is not null")
    first = dated.unionByName(undated).groupBy("produtor_id").agg(F.min(F.struct("_p", "tipo", "a", "b")).alias("m"))
    return first.select("produtor_id", F.inline(F.array(_named("R46", F.col("m.a"), F.col("m.b"))))).select(*ROW)


def rule_documents(ctx: Context) -> DataFrame:
    """Two documents (R32: one) that show why a rule fires for a producer, with the values in conflict.

    Rows (``produtor_id``, ``regra``, ``documento_id``, ``outro_id``, ``valor``, ``outro_valor``) for R01, R09, R21, R32,
    R45 and R46; one row per producer and rule, none where the rule does not fire.
    """
    return _between_kinds(ctx.docs).unionByName(_within_groups(ctx.docs)).unionByName(_close_in_time(ctx.docs, ctx.params))


def embargo_terms_of_producers(ctx: Context) -> DataFrame:
    """Embargo terms with the CPF of a producer, wherever they lie: rows, not counts."""
    people = ctx.produtor.select(F.col("id").alias("produtor_id"), digits(F.col("cpf")).alias("cpf")).where("cpf <> ''")
    terms = ctx.embargo.select(
        digits(F.col("CPF_CNPJ_EMBARGADO")).alias("cpf"), F.coalesce("NUM_TAD", F.lit("sem numero")).alias("num_tad"),
        F.col("NOME_EMBARGADO").alias("embargado"), F.col("MUNICIPIO").alias("municipio"),
    )
    return people.join(terms, "cpf").select("produtor_id", "cpf", "num_tad", "embargado", "municipio")


def volume_lots(lote_talhao: DataFrame, lote: DataFrame, flagged: DataFrame) -> DataFrame:
    """Allocations, with the lot's code, of the parcels whose volume check does not conform (``talhao_id``)."""
    rows = lote_talhao.join(flagged.select("talhao_id"), "talhao_id", "left_semi")
    return rows.join(lote.select(F.col("id").alias("lote_id"), "codigo"), "lote_id").select("talhao_id", "lote_id", "codigo", "quantidade_kg")
